"""Helpers shared by the joins: connected components and side tables of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.session import cut_lineage, scratch_path

#: Side tables of keys up to this many rows are sent to all tasks; larger ones are joined by shuffles.
SENT_ROWS = 1_000_000


def checked(keys: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The table, to be broadcast if a count shows that it is small (it should be cheap to count)."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node with an edge (columns u, v).

    Rounds of large and small stars: every node hangs its larger neighbours on its smallest one, then its smaller
    neighbours too, until nothing changes. A node's smallest neighbour is found by a partial aggregate and joined back,
    so a hub of any degree is spread over tasks.
    """
    edges = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet below the shared folder and read again: a cut in the lineage that is compressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
