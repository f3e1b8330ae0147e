"""Exact quantiles that stay bounded per task, whatever the group sizes.

Groups up to ``hot_rows`` rows use the built-in exact ``percentile``. Larger
groups are never held in one task: a mergeable sketch first brackets the wanted
rank, the bracket is counted in ranges of equal width, and only the values of the
one or two ranges that hold the rank are counted and ranked one by one. Both ways
give the same rows and the same exact values; a group and column without a value
has a row with n = 0.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
ACCURACY = 20_000
#: Ranges into which a bracket is cut.
RANGES = 4096

Position = Callable[[float, Column], Column]


def linear_position(p: float, n: Column) -> Column:
    """0-based fractional position p·(n−1): medians and quartiles."""
    return F.lit(p) * (n - 1)


def floor_index(p: float, n: Column) -> Column:
    """0-based index min(n−1, floor(p·n)): an observed value, not interpolated."""
    return F.least(n - 1, F.floor(F.lit(p) * n)).cast("double")


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return cond


def _small(df: DataFrame, columns: Sequence[str], probs, keys, position: Position) -> DataFrame:
    rows = []
    for c in columns:
        if position is linear_position:
            q = F.percentile(F.col(c), F.array(*[F.lit(p) for p in probs]))
        else:
            # The group is bounded by hot_rows, so its sorted values fit one row.
            values = F.sort_array(F.collect_list(F.col(c)))
            picks = [position(p, F.count(c).cast("double")).cast("int") for p in probs]
            q = F.when(F.count(c) > 0, F.array(*[F.get(values, i) for i in picks]))
        rows.append(F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), q.alias("q")))
    packed = df.groupBy(*keys).agg(F.array(*rows).alias("rows"))
    return packed.select(*keys, F.inline("rows"))


def _hot(df: DataFrame, columns: Sequence[str], probs, keys, position: Position, accuracy: int) -> DataFrame:
    """Bracket by sketch, count the bracket's ranges, then rank only the range with the rank."""
    by = [*keys, "column"]
    long = df.unpivot(list(keys), list(columns), "column", "value")
    margin = 2.0 / accuracy
    edges = [min(max(e, 0.0), 1.0) for p in probs for e in (p - margin, p + margin)]
    sketch = long.groupBy(*by).agg(
        F.count("value").alias("n"),
        F.percentile_approx("value", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("edge"),
    )
    nothing = sketch.filter("n = 0").select(*by, "n", F.lit(None).cast("array<double>").alias("q"))
    brackets = sketch.filter("n > 0").select(
        *by,
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("i"),
                        position(p, F.col("n").cast("double")).alias("pos"),
                        F.get("edge", F.lit(2 * i)).alias("lo"),
                        F.get("edge", F.lit(2 * i + 1)).alias("hi"),
                    )
                    for i, p in enumerate(probs)
                ]
            )
        ),
    )
    # One row per hot group, column and probability: fewer than the cells by ``hot_rows``, so the values stay where they are.
    placed = (
        long.filter(F.col("value").isNotNull()).alias("l")
        .join(F.broadcast(brackets).alias("r"), _match(long, brackets, by))
        .select(*[F.col(f"r.{c}") for c in by], "r.n", "r.i", "r.pos", "r.lo", "r.hi", "l.value")
    )
    inside = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))
    side = F.when(F.col("value") < F.col("lo"), -1).when(F.col("value") > F.col("hi"), RANGES)
    placed = placed.withColumn("side", side.when(F.col("hi") > F.col("lo"), inside).otherwise(0).cast("int"))
    group = [*by, "i", "n", "pos"]
    # At most RANGES + 2 rows of a group are ordered here.
    ranges = placed.groupBy(*group, "side").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "i").orderBy("side"))
    held = ranges.withColumn("upto", upto).filter((F.col("upto") > F.floor("pos")) & (F.col("upto") - F.col("c") <= F.ceil("pos")) & F.col("side").between(0, RANGES - 1))
    held = held.select(*by, "i", "side", F.lit(True).alias("held"))
    # One or two ranges of each bracket.
    marked = placed.alias("l").join(F.broadcast(held).alias("r"), _match(placed, held, [*by, "i", "side"]), "left").select("l.*", "r.held")
    # Outside these ranges only the neighbour and the count matter; inside them, each value.
    counts = (
        marked.withColumn("slot", F.when(F.col("held"), F.col("value")))
        .groupBy(*group, "side", "slot")
        .agg(F.count("*").alias("c"), F.min("value").alias("least"), F.max("value").alias("most"))
        .withColumn("v", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")))
    )
    running = Window.partitionBy(*by, "i").orderBy("v")
    ranked = counts.withColumn("cum", F.sum("c").over(running))
    low = F.min(F.when(F.col("cum") > F.floor("pos"), F.col("v")))
    high = F.min(F.when(F.col("cum") > F.ceil("pos"), F.col("v")))
    # The sketch guarantees that the rank is inside the bracket or next to it.
    outside = F.max(F.when((F.col("side") < 0) & (F.col("cum") - 1 > F.floor("pos")), 1).otherwise(0))
    picked = ranked.groupBy(*group).agg(low.alias("a"), high.alias("b"), outside.alias("bad"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))
    value = F.when(F.col("bad") == 1, F.raise_error(F.lit("quantile bracket missed")).cast("double")).otherwise(value)
    found = (
        picked.withColumn("value", value)
        .groupBy(*by, "n")
        .agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("parts"))
        .select(*by, "n", F.col("parts.value").alias("q"))
    )
    return found.unionByName(nothing)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    position: Position = linear_position,
    hot_rows: int = HOT_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``keys…, column, n, q`` with one exact value per probability in ``q``.

    Missing cells are not counted; without any, n is 0 and ``q`` NULL. ``hot_rows``
    is the number of cells that the columns of a group may hold in one task.
    """
    keys = list(keys)
    names = keys or ["__all"]
    df = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    if not keys:
        df = df.withColumn("__all", F.lit(0))
    hot = df.groupBy(*names).agg(F.count("*").alias("__n")).filter(F.col("__n") > hot_rows // max(1, len(columns))).select(*names)
    # Hot groups are fewer than all cells by ``hot_rows``.
    hot = F.broadcast(hot)
    calm = df.alias("l").join(hot.alias("r"), _match(df, hot, names), "left_anti").select("l.*")
    busy = df.alias("l").join(hot.alias("r"), _match(df, hot, names), "left_semi").select("l.*")
    out = _small(calm, columns, probs, names, position).unionByName(
        _hot(busy, columns, probs, names, position, accuracy)
    )
    return out.drop("__all")


def exact_medians(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``keys…, column, n, median``."""
    out = exact_quantiles(df, columns, [0.5], keys, hot_rows=hot_rows)
    return out.select(*keys, "column", "n", F.get("q", F.lit(0)).alias("median"))


def widen(long: DataFrame, columns: Sequence[str], keys: Sequence[str], value: str) -> DataFrame:
    """One row per key with a column per name (the inverse of the long form above)."""
    picks = [F.max(F.when(F.col("column") == c, F.col(value))).alias(c) for c in columns]
    return long.groupBy(*keys).agg(*picks)
