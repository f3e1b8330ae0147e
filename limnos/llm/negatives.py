"""Hard negatives by Four-Russians scoring.

Components are made integers. For each group of eight dimensions an anchor has a table of the sums of all 256 subsets of
its eight components. A candidate's integers are cut into bit planes (two's complement), and the eight bits that a plane has
for a group of dimensions are packed into one byte, which is the place to look up. A plane's lookups summed over the groups are
the inner product with that plane; planes are put together from the highest (negative) one down by doubling and adding.
So every score is exact in integers, without a multiplication.

Candidates are packed in chunks and anchors in blocks, both of bounded size; a cogroup brings some blocks to a chunk. First
anchors meet the rows of their own label and each chunk hands on the best ones: the positives. Then they meet all rows, and each chunk
hands on the best rows of other labels in the band of each positive. Only these are ranked.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no part; rows of one
vec_id are one row, with the smallest label, then vector; vectors are compared only with those of the same length (empty
ones score 0); equal scores go by vec_id; an anchor without positives, or a positive without negatives, has no rows; an empty table gives
no rows; extra columns are not looked at. Vectors whose scores could exceed 62 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.graphs import checked, staged
from limnos.llm.registry import query, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative scores from LOW to HIGH percent of the positive.
LOW, HIGH = 30, 90
#: Rows of a chunk (about), anchors of a block (about), blocks that a chunk meets in one group, rows scored at once.
CHUNK = 4096
ANCHORS = 128
BLOCKS = 64
TILE = 512


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def planes_of(rows: np.ndarray, bits: int) -> np.ndarray:
    """The bit planes [plane, group of eight dimensions, row] of integer rows, a byte each."""
    n, dims = rows.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dims] = rows
    out = np.empty((bits, groups, n), np.uint8)
    for b in range(bits):
        out[b] = np.packbits(((wide >> b) & 1).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0].T
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """For each group of eight dimensions, the sums of all subsets of the anchors' components: [group, subset, anchor]."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), kind)
    wide[:, :dims] = anchors
    out = np.zeros((groups, 256, n), kind)
    for g in range(groups):
        for j in range(8):
            out[g, 1 << j : 2 << j] = out[g, : 1 << j] + wide[:, 8 * g + j]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> Iterator[np.ndarray]:
    """Inner products [row, anchor] of candidates (as planes) with anchors (as tables), a tile of rows at a time."""
    bits, groups, n = planes.shape
    for start in range(0, n, TILE):
        tile = planes[:, :, start : start + TILE]
        total = np.zeros((tile.shape[2], tables.shape[2]), tables.dtype)
        found = np.empty_like(total)
        for b in range(bits - 1, -1, -1):
            total += total
            for g in range(groups):
                np.take(tables[g], tile[b, g], axis=0, out=found, mode="clip")
                # The highest plane of two's complement counts against the others.
                (np.subtract if b == bits - 1 else np.add)(total, found, out=total)
        yield total


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties by place."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.argsort(-score[at], kind="stable")][:k]


def in_bands(score: np.ndarray, positive: np.ndarray, k: int, low: int = LOW, high: int = HIGH) -> list[np.ndarray]:
    """For each positive's score, places of the k highest scores from low to high percent of it."""
    floor, ceiling = -((-low * positive) // 100), (high * positive) // 100
    at = np.flatnonzero((score >= floor.min()) & (score <= ceiling.max()))
    at = at[np.argsort(-score[at], kind="stable")]
    down = -score[at]
    first, end = np.searchsorted(down, -ceiling, "left"), np.searchsorted(down, -floor, "right")
    return [at[a : min(b, a + k)] if b > a else at[:0] for a, b in zip(first, end, strict=True)]


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, dims and v (integers) of the rows that take part (vectors: vec_id, label, embedding)."""
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding")))
    one = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "embedding")).alias("row"))
    return staged(one.select("vec_id", "row.label", F.size("row.embedding").alias("dims"), whole(F.col("row.embedding"), scale).alias("v")), "negatives-rows")


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dims)


_KEYS = ["room", "dims", "chunk", "reach"]
_CHUNKS = "room long, dims int, chunk long, n_reaches long, ids binary, labels binary, planes binary"
_BLOCKS = "room long, dims int, block long, n_chunks long, ids binary, labels binary, v binary, positives array<array<long>>"
_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def meet(rows: DataFrame, anchors: DataFrame, room: Column, bits: int, kind: type, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, vec_id and score of what each chunk hands on.

    Anchors with positives (lists of id and score) get rows of other labels in their bands, those without the best rows of their own
    label. Only rows and anchors of one room and length meet.
    """
    rows, anchors = rows.withColumn("room", room), anchors.withColumn("room", room)
    counts = rows.groupBy("room", "dims").agg(F.ceil(F.count("*") / CHUNK).alias("n_chunks"))
    asked = anchors.groupBy("room", "dims").agg(F.ceil(F.count("*") / ANCHORS).alias("n_blocks"))
    sizes = checked(staged(counts.join(asked, ["room", "dims"]).withColumn("n_reaches", F.ceil(F.col("n_blocks") / BLOCKS)), "negatives-sizes"))

    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        planes = planes_of(_matrix(part.column("v"), key[1].as_py()), bits)
        cells = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")]
        return pa.Table.from_arrays([pa.array([k.as_py()], t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)] + [pa.array([x], pa.binary()) for x in (*cells, planes.tobytes())], [c.split()[0] for c in _CHUNKS.split(", ")])

    def gather(key: tuple, part: pa.Table) -> pa.Table:
        v = _matrix(part.column("v"), key[1].as_py())
        cells = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")]
        met = pa.array([[[n for pair in one or [] for n in pair] for one in part.column("positives").to_pylist()]], pa.list_(pa.list_(pa.int64())))
        return pa.Table.from_arrays([pa.array([k.as_py()], t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)] + [pa.array([x], pa.binary()) for x in (*cells, v.tobytes())] + [met], [c.split(" ")[0] for c in _BLOCKS.split(", ")])

    spread = lambda many: F.pmod(F.xxhash64("vec_id"), F.col(many)).cast("long")
    chunks = rows.join(sizes, ["room", "dims"]).withColumn("chunk", spread("n_chunks")).groupBy("room", "dims", "chunk", "n_reaches").applyInArrow(pack, _CHUNKS)
    blocks = anchors.join(sizes, ["room", "dims"]).withColumn("block", spread("n_blocks")).groupBy("room", "dims", "block", "n_chunks").applyInArrow(gather, _BLOCKS)
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    here = chunks.withColumn("reach", each("n_reaches")).drop("n_reaches")
    there = blocks.withColumn("reach", F.floor(F.col("block") / BLOCKS)).withColumn("chunk", each("n_chunks")).drop("n_chunks", "block")

    def score(key: tuple, chunk: pa.Table, met: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int | None, np.ndarray, np.ndarray]] = []
        for row in chunk.to_pylist():
            ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            groups = -(-key[1].as_py() // 8)
            planes = np.frombuffer(row["planes"], np.uint8).reshape(bits, groups, len(ids))
            for block in met.to_batches(max_chunksize=1):
                (names,), (own,), (raw,), (pairs,) = (block.column(c).to_pylist() for c in ("ids", "labels", "v", "positives"))
                names, own = np.frombuffer(names, np.int64), np.frombuffer(own, np.int64)
                tables = subset_sums(np.frombuffer(raw, np.int64).reshape(len(names), -1), kind)
                all_scores = np.concatenate(list(scores(tables, planes))).T
                for i, (name, label) in enumerate(zip(names.tolist(), own, strict=True)):
                    if not pairs[i]:
                        at = np.flatnonzero((labels == label) & (ids != name))
                        s = np.ascontiguousarray(all_scores[i][at])
                        chosen = best(s, positives)
                        out.append((name, None, None, ids[at][chosen], s[chosen]))
                        continue
                    known = np.array(pairs[i], np.int64).reshape(-1, 2)
                    at = np.flatnonzero(labels != label)
                    s = all_scores[i][at].astype(np.int64)
                    for (pid, ps), chosen in zip(known.tolist(), in_bands(s, known[:, 1], negatives, low, high), strict=True):
                        out.append((name, pid, ps, ids[at][chosen], s[chosen]))
        many = [len(x[3]) for x in out]
        repeated = [pa.array([x[c] for x, m in zip(out, many, strict=True) for _ in range(m)], pa.int64()) for c in range(3)]
        ends = [np.concatenate([x[c] for x in out] or [np.zeros(0)]).astype(np.int64) for c in (3, 4)]
        return pa.Table.from_arrays([*repeated, *map(pa.array, ends)], [c.split()[0] for c in _FOUND.split(", ")])

    return here.groupBy(*_KEYS).cogroup(there.groupBy(*_KEYS)).applyInArrow(score, _FOUND)


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score (vectors: vec_id, label, embedding; anchors: a condition on vec_id)."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = prepared(vectors, scale)
    least, most, dims = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max("dims")).first()
    if dims is None:
        return rows.sparkSession.createDataFrame([], schema)
    least, most = min(least or 0, 0), max(most or 0, 0)
    bound = max(-least, most) ** 2 * max(dims, 1)
    if bound >= 1 << 62:
        raise ValueError(f"components from {least} to {most} in {dims} dimensions: scores would exceed 62 bits")
    bits, kind = max(most.bit_length(), (~least).bit_length()) + 1, np.int32 if bound < 1 << 31 else np.int64
    chosen = rows.filter(anchors)
    nearest = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    none = chosen.withColumn("positives", F.lit(None).cast("array<array<bigint>>"))
    own = meet(rows, none, F.col("label"), bits, kind, positives, negatives, low, high)
    own = own.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= positives)
    listed = own.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    listed = listed.select(F.col("anchor_id").alias("vec_id"), F.transform("found", lambda x: F.array(x["vec_id"], x["score"])).alias("positives"))
    known = staged(chosen.join(listed, "vec_id"), "negatives-anchors")
    met = meet(rows, known, F.lit(0).cast("long"), bits, kind, positives, negatives, low, high)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


_CHECK = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""


@query("op12_negatives", _CHECK)
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(rows, F.expr("vec_id % 100 = 0"))
