"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a shuffled order and read as one stream of words, cut into equal blocks.
Slot j of the mix gets the point frac(j * golden ratio), exact on a grid of 2^31 points; the point's place in the
cumulative targets names the source, and the slot's rank within its source names pass and block of the stream.

Defined results: null text has no words; a null source is a source of its own, last in order; a document without
words takes none; repeated rows are documents of their own; an empty table gives an empty mix. Extra columns are
carried by the caller (``mix`` returns the key columns only).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.registry import query, table
from limnos.llm.text import WORD_PATTERN
from limnos.session import cut_lineage

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST_PASSES = 3
#: Words of a block: at most this, and fewer where the mix is small, so that it has SLOTS slots at least.
BLOCK_WORDS = 256
SLOTS = 1 << 14
#: Slots are ranked in runs of this many, documents in this many hash buckets per source.
RUN = 4096
BUCKET_BITS = 12
_GRID = 1 << 31
#: The golden ratio's fraction on the grid, odd, so that 2^31 slots visit each grid point once.
_STEP = round(0.6180339887498949 * _GRID) | 1
_CELLS = 1 << 16


@dataclass(frozen=True)
class Mix:
    documents: DataFrame  # key, source, size, source_size, target, taken
    schedule: DataFrame  # slot, source, pass, block, words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Words due from each source: shares of the whole by weight, none above ``most`` times the source's size.

    sizes: source, source_size. The level at which sources stop being capped is found by one pass in the order of
    cap per weight, which is where repeated resharing of the excess ends.
    """
    places = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(places) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    rise = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    rest = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    s = s.withColumn("place", F.row_number().over(rise)).withColumn(
        "level", (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    settled = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("place"))
    level = F.min_by("level", settled).over(everyone)
    s = s.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    upto = Window.partitionBy().orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.select("source", "source_size", "weight", "target", F.sum("target").over(upto).alias("upto"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = 17) -> Mix:
    """The mix of all documents and its slot schedule."""
    spark = docs.sparkSession
    sized = cut_lineage(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    targets = cut_lineage(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, min(BLOCK_WORDS, total // SLOTS))
    schedule = _schedule(spark, targets, total, block, most)
    used = schedule.groupBy("source", "block").agg(F.count("*").alias("uses"))
    pieces = _streams(sized, seed).filter("size > 0").select(
        "key", "source", "size", "first", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(first + size - 1) div {block}"))).alias("block")
    )
    p, u = pieces.alias("p"), used.alias("u")
    shared = F.least(F.col("first") + F.col("size"), (F.col("p.block") + 1) * block) - F.greatest("first", F.col("p.block") * block)
    # One row per document again: a document's place in its stream is unique among documents with words.
    taken = (
        p.join(u, F.col("p.source").eqNullSafe(F.col("u.source")) & (F.col("p.block") == F.col("u.block")), "left")
        .groupBy("p.source", "first", "key", "size")
        .agg(F.sum(shared * F.coalesce("uses", F.lit(0))).alias("taken"))
    )
    rows = taken.unionByName(sized.filter("size = 0").select("source", F.lit(0).cast("long").alias("first"), "key", "size", F.lit(0).cast("long").alias("taken")))
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    documents = rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select("key", "source", "size", "source_size", "target", "taken")
    return Mix(documents, schedule)


def _schedule(spark: SparkSession, targets: DataFrame, total: int, block: int, most: int) -> DataFrame:
    """slot, source, pass, block and words for every slot of the mix."""
    slots = spark.range(-(-total // block)).select(F.col("id").alias("slot"), (F.pmod(F.pmod("id", F.lit(_GRID)) * _STEP, F.lit(_GRID)) / float(_GRID)).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * _CELLS).cast("int"))
    share = targets.filter("target > 0").select(
        "source", "source_size", ((F.col("upto") - F.col("target")) / float(total or 1)).alias("low"), (F.col("upto") / float(total or 1)).alias("high")
    )
    share = share.select("*", F.explode(F.sequence(F.floor(F.col("low") * _CELLS).cast("int"), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS)).cast("int"))).alias("cell"))
    placed = slots.join(share, "cell").filter("low <= point and point < high").select("slot", "source", "source_size", F.expr(f"slot div {RUN}").alias("run"))
    counts = placed.groupBy("source", "run").agg(F.count("*").alias("n"))
    base = counts.select("source", "run", (F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).alias("base"))
    p, b = placed.alias("p"), base.alias("b")
    rank = F.col("base") + F.row_number().over(Window.partitionBy("p.source", "p.run").orderBy("slot")) - 1
    ranked = p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.run") == F.col("b.run"))).select("slot", "p.source", "source_size", rank.alias("rank"))
    blocks = F.ceil(F.col("source_size") / float(block)).cast("long")
    out = ranked.select("slot", "source", "source_size", F.floor(F.col("rank") / blocks).alias("pass"), F.pmod("rank", blocks).alias("block"))
    # Rounding may give a source at its cap a slot too many.
    return out.filter(F.col("pass") < most).select("slot", "source", "pass", "block", F.least(F.lit(block), F.col("source_size") - F.col("block") * block).alias("words"))


def _streams(sized: DataFrame, seed: int) -> DataFrame:
    """The first word of each document in its source's shuffled stream."""
    h = sized.withColumn("order", F.xxhash64("key", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("order", 64 - BUCKET_BITS))
    sums = h.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    h, b = h.alias("h"), base.alias("b")
    inner = Window.partitionBy("h.source", "h.bucket").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return h.join(b, F.col("h.source").eqNullSafe(F.col("b.source")) & (F.col("h.bucket") == F.col("b.bucket"))).select(
        "key", F.col("h.source").alias("source"), "size", (F.col("base") + F.sum("size").over(inner) - F.col("size")).alias("first")
    )


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1."""
    docs = mix(table(spark, sf_dir, "documents")).documents
    return docs.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken; of a document taken in part, the nearest whole number."""
    plan = mix(docs).documents.filter("size > 0").groupBy("key").agg(F.sum("taken").alias("taken"), F.sum("size").alias("all_size"))
    times = F.round(F.col("taken") / F.col("all_size")).cast("int")
    joined = docs.join(plan.select(F.col("key").alias("__key"), times.alias("__times")), F.col("doc_id").eqNullSafe(F.col("__key")))
    return joined.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[docs[f"`{c}`"] for c in docs.columns])
