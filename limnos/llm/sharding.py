"""Shards of equal bytes, words and rows by vector bin packing.

Equal texts form a group. Groups are small or large: small ones are gathered by hash into a fixed number of cells; a
large one (over a small part of a shard's bytes) is an item of its own, cut by document key into parts of about that
size, so that a group of any size can be spread. Both kinds are bounded by the number of shards, so the packing itself
(bytes, words and rows of at most a few ten thousand items) runs on the driver: items in falling size go to the shard
where the dot product of the item with the shard's residual capacity is highest.

Defined results: null text counts no bytes and no words and is a group apart from the empty text; repeated rows are
rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from limnos.llm.mixing import word_count
from limnos.llm.registry import query, table
from limnos.session import cut_lineage

SHARDS = 24
#: Bytes that every row costs besides its text.
ROW_BYTES = 8
#: A group over 1/PARTS of a shard is large; small groups share PARTS * 2 cells per shard.
PARTS = 256
#: Rows of a shard are numbered in this many runs.
RUNS = 1024


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, words, rows); items in falling size, highest dot product with what is left."""
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), int)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        fit = left @ share[i]
        room = (left >= share[i]).all(axis=1)
        # Without room in every measure, what is left in all measures still decides.
        out[i] = int(np.argmax(np.where(room, fit, -np.inf))) if room.any() else int(np.argmax(left.min(axis=1)))
        left[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """key, size, crc, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    body = F.col(text)
    sized = cut_lineage(
        docs.select(
            F.col(key).alias("key"),
            F.when(body.isNull(), F.lit(0)).otherwise(F.xxhash64(body)).alias("group"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("crc"),
            word_count(body).alias("words"),
        )
    )
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    part_bytes = max(1, total // (shards * PARTS))
    # At most shards * PARTS groups can be that large.
    large = sized.groupBy("group").agg(F.sum("size").alias("n")).filter(F.col("n") > part_bytes)
    large = large.select(F.col("group").alias("l_group"), F.ceil(F.col("n") / part_bytes).cast("int").alias("parts"))
    cell = F.pmod(F.col("group"), F.lit(shards * PARTS * 2))
    placed = sized.join(F.broadcast(large), F.col("group") == F.col("l_group"), "left").select(
        "key", "size", "crc", "words", F.when(F.col("parts").isNull(), cell).otherwise(F.col("group")).alias("a"), F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.lit(-1)).alias("b")
    )
    sums = placed.groupBy("a", "b").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")).orderBy("a", "b").collect()
    chosen = pack(np.array([[r["size"], r["words"], r["rows"]] for r in sums], float).reshape(-1, 3), shards)
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    where = spark.createDataFrame([(r["a"], r["b"], int(s)) for r, s in zip(sums, chosen, strict=True)], schema)
    rows = placed.join(F.broadcast(where), ["a", "b"]).withColumn("run", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(RUNS)))
    counts = rows.groupBy("shard", "run").agg(F.count("*").alias("n"))
    base = counts.select(F.col("shard").alias("b_shard"), F.col("run").alias("b_run"), (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("base"))
    slot = F.col("base") + F.row_number().over(Window.partitionBy("shard", "run").orderBy("key", "crc", "size")) - 1
    return rows.join(F.broadcast(base), (F.col("shard") == F.col("b_shard")) & (F.col("run") == F.col("b_run"))).select("key", "size", "crc", "shard", slot.cast("long").alias("slot"))


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
