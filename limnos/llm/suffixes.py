"""Removing long byte strings that occur more than once, by distributed prefix doubling over chosen suffixes.

Suffixes start at anchors chosen by content (see ``repeats``): every 400-byte string has one, and equal strings have it at
the same place, so the suffixes of all other positions need no rank. An anchor with the strings that chose it is a
context. Contexts are named, and those of one name are one class: all strings of a class with two members occur twice, and
one member stands for it in what follows. That leaves the classes whose anchor has other contexts too. Their first rank is
the seed at the anchor. Then, to the right and to the left of the anchors still tied, Spark brings together (rank, next
name) pairs at growing offsets - 32, 64, 128, 256 bytes - and ranks them anew; anchors that become unique leave, and the
rounds end past the threshold. How far an anchor stays tied bounds which of its strings can occur twice. Those within the
bound are ranked in blocks of neighbouring strings, which are classes again, and one by one only in blocks that agree
with others in what all their strings have in common but not in the whole.

All strings of all positions would be 16 bytes for each byte of text in every round; that is why positions are chosen.

Defined results: a null text is empty; texts shorter than the threshold lose nothing; all of equal texts that long lose
everything (each string starts elsewhere too), repeated rows included; a doc_id is taken to have one text (rows that
give it others get the spans of any); a row without a doc_id loses nothing; an empty table gives no rows; extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import repeats
from limnos.llm.graphs import checked, staged
from limnos.llm.registry import query, table
from limnos.llm.text import byte_views, hash_run, mix64, prefix_sums

LENGTH = 400
SEED = 32
#: Strings around an anchor that are ranked together.
BLOCK = 32


def doubling_lengths(seed: int, length: int) -> list[int]:
    """Lengths of the ranked strings after each round, from the seed to the threshold."""
    out = [seed]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _union_names(sums: np.ndarray, pos: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> np.ndarray:
    """Names of the strings that begin low to high symbols before the anchors: of all of them together."""
    return mix64(hash_run(sums, pos - high, high - low + span) + (high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64))


def contexts(docs: DataFrame, unit: repeats.Unit) -> DataFrame:
    """name, common (the seed's hash), n (1), doc_id, pos, low and high of every anchor; the anchor's strings begin low to high bytes before it.

    A whole text is a row too, without a common: equal texts are told by it, also those of rows without a doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[tuple[np.ndarray, ...]] = []
            wholes: list[tuple[int, int, int | None]] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), byte_views(batch.column("text")), strict=True):
                x = unit.symbols(raw)
                if len(x) < unit.span:
                    continue
                sums = prefix_sums(x)
                wholes.append((int(hash_run(sums, np.zeros(1, np.int64), len(x)).view(np.int64)[0]), len(x), doc))
                if doc is None:
                    continue
                places, grams = repeats.anchor_of_windows(x, unit, sums)
                turn = np.flatnonzero(places[1:] != places[:-1])
                first, last = np.concatenate([[0], turn + 1]), np.append(turn, len(places) - 1)
                pos = places[first]
                high, low = pos - first, pos - last
                cols.append((_union_names(sums, pos, low, high, unit.span), grams[pos], np.full(len(pos), doc), pos, low, high))
            if wholes:
                name, n, doc_ids = zip(*wholes, strict=True)
                m, k = len(wholes), sum(len(c[0]) for c in cols)
                name_, common, doc, pos, low, high = (np.concatenate(c) for c in zip(*cols, strict=True)) if cols else [np.zeros(0, np.uint64)] * 6
                zeros = np.zeros(m, np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "name": pa.array(np.concatenate([name_.view(np.int64), np.array(name, np.int64)])),
                        "common": pa.array(np.concatenate([common.view(np.int64), zeros]), mask=np.arange(k + m) >= k),
                        "n": pa.array(np.ones(k + m, np.int64)),
                        "doc_id": pa.concat_arrays([pa.array(doc.astype(np.int64)), pa.array(doc_ids, pa.int64())]),
                        "pos": pa.array(np.concatenate([pos.astype(np.int32), zeros])),
                        "low": pa.array(np.concatenate([low.astype(np.int32), zeros])),
                        "high": pa.array(np.concatenate([high.astype(np.int32), np.array(n, np.int32)])),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "name long, common long, n long, doc_id long, pos int, low int, high int")


def classes(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The names that occur twice, and one member of every class that agrees with others in common if one of these occurs once.

    rows: name, common, n (occurrences), doc_id, pos, low and high, maybe least and most (bounds of strings to rank).
    """
    bounds = [F.min("least").alias("least"), F.max("most").alias("most")] if "least" in rows.columns else []
    same = [F.sum("n").alias("n"), F.min("common").alias("common"), F.min("doc_id").alias("doc_id"), F.min_by("pos", "doc_id").alias("pos"), F.min("low").alias("low"), F.min("high").alias("high")]
    each = staged(rows.groupBy("name").agg(*same, *bounds), name)
    asked = each.filter("common is not null").groupBy("common").agg(F.count("*").alias("m"), F.min("n").alias("fewest")).filter("m > 1 and fewest = 1").select("common")
    return each.filter("n > 1").select("name"), each.join(asked, "common", "left_semi")


def _texts(docs: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """doc_id, text and items (what is asked of the text) of the documents asked."""
    item = F.struct(*[c for c in asked.columns if c != "doc_id"])
    items = staged(asked.groupBy("doc_id").agg(F.collect_list(item).alias("items")), name)
    return docs.join(checked(items.select("doc_id")), "doc_id", "left_semi").join(items, "doc_id").select("doc_id", "text", "items")


def _columns(items: pa.StructScalar, sums: np.ndarray, span: int, *more: str) -> list[np.ndarray]:
    """pos, low, high, name and more of the items that lie in this text; rows that share a doc_id have other texts."""
    cols = [items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "low", "high", "name", *more)]
    cols = [c[cols[0] - cols[1] + span < len(sums)] for c in cols]
    mine = _union_names(sums, cols[0], cols[1], cols[2], span).view(np.int64) == cols[3]
    return [c[mine] for c in cols]


def _lists(flat: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def _names(docs: DataFrame, asked: DataFrame, unit: repeats.Unit) -> DataFrame:
    """The asked contexts with names to the right and to the left (of the bytes that each round adds) and with their blocks."""
    lengths = doubling_lengths(unit.seed, unit.span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(byte_views(batch.column("text"))):
                x = unit.symbols(raw)
                sums = prefix_sums(x)
                pos, low, high, name, common, n = _columns(batch.column("items")[i].values, sums, unit.span, "common", "n")
                if not len(pos):
                    continue
                sides = []
                for side in (1, -1):
                    cols = [np.zeros((len(pos), 0), np.int64)]
                    # To the right the seed is ranked already; to the left nothing is.
                    for a, b in zip(lengths if side > 0 else [0, *lengths[1:]], lengths[1:], strict=False):
                        start, end = (pos + a, pos + b) if side > 0 else (pos - b, pos - a)
                        inside = (start >= 0) & (end <= len(x))
                        col = np.zeros(len(pos), np.uint64)
                        col[inside] = hash_run(sums, start[inside], b - a) | np.uint64(1)
                        cols.append(col.view(np.int64)[:, None])
                    flat = np.concatenate(cols, 1)
                    sides.append(_lists(pa.array(flat.ravel()), np.full(len(pos), flat.shape[1])))
                many = high // unit.block - low // unit.block + 1
                of = np.repeat(np.arange(len(pos)), many)
                k = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + (low // unit.block)[of]
                a, c = np.maximum(low[of], k * unit.block), np.minimum(high[of], k * unit.block + unit.block - 1)
                # What all strings of the block have in common, and all of them together.
                core = mix64(hash_run(sums, pos[of] - k * unit.block, unit.span - unit.block + 1) + k.astype(np.uint64))
                whole = _union_names(sums, pos[of], a, c, unit.span)
                blocks = pa.StructArray.from_arrays([pa.array(whole.view(np.int64)), pa.array(core.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32))], ["name", "common", "low", "high"])
                doc = np.full(len(pos), batch.column("doc_id")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(common), pa.array(n), pa.array(doc), pa.array(pos.astype(np.int32)), *sides, _lists(blocks, many)], ["name", "common", "n", "doc_id", "pos", "right", "left", "blocks"])

    schema = "name long, common long, n long, doc_id long, pos int, right array<long>, left array<long>, blocks array<struct<name:long,common:long,low:int,high:int>>"
    return staged(_texts(docs, asked, "suffix-places").mapInArrow(run, schema), "suffix-names")


def reaches(named: DataFrame, unit: repeats.Unit) -> DataFrame:
    """name, right and left: bytes from the anchor up to which another context can agree with it."""
    lengths = doubling_lengths(unit.seed, unit.span)
    alive = named.select("name", F.lit(1).alias("side"), F.col("common").alias("rank"), F.col("right").alias("names"))
    alive = alive.unionByName(named.select("name", F.lit(-1).alias("side"), F.col("common").alias("rank"), F.col("left").alias("names")))
    out = None
    for k in range(len(lengths) - 1):
        pairs = alive.select("*", F.col("names")[k].alias("next"))
        tied = pairs.filter("next <> 0").groupBy("side", "rank", "next").agg(F.count("*").alias("n")).filter("n > 1")
        ranked = staged(pairs.join(tied, ["side", "rank", "next"], "left"), "suffix-ranks")
        # An anchor that is now unique agrees with others on less than this round's length.
        gone = ranked.filter("n is null").select("name", "side", F.lit(lengths[k + 1] - 1).alias("reach"))
        out = gone if out is None else out.unionByName(gone)
        alive = ranked.filter("n is not null").select("name", "side", F.xxhash64("rank", "next").alias("rank"), "names")
    rest = alive.select("name", "side", F.lit(unit.span).alias("reach"))
    out = rest if out is None else out.unionByName(rest)
    return out.groupBy("name").agg(F.max(F.when(F.col("side") > 0, F.col("reach"))).alias("right"), F.max(F.when(F.col("side") < 0, F.col("reach"))).alias("left"))


def _strings(docs: DataFrame, asked: DataFrame, unit: repeats.Unit) -> DataFrame:
    """doc_id, start, n and w (name) of the strings of the asked blocks, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(byte_views(batch.column("text"))):
                sums = prefix_sums(unit.symbols(raw))
                pos, low, high, _, least, most, n = _columns(batch.column("items")[i].values, sums, unit.span, "least", "most", "n")
                low, high = np.maximum(low, least), np.minimum(high, most)
                many = np.maximum(high - low + 1, 0)
                of = np.repeat(np.arange(len(pos)), many)
                if not len(of):
                    continue
                offset = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
                start = pos[of] - offset
                # Strings of contexts that agree have the anchor at the same place.
                w = mix64(hash_run(sums, start, unit.span) + offset.astype(np.uint64))
                doc = np.full(len(of), batch.column("doc_id")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc), "start": pa.array(start.astype(np.int32)), "n": pa.array(n[of]), "w": pa.array(w.view(np.int64))})

    return staged(_texts(docs, asked, "suffix-blocks").mapInArrow(run, "doc_id long, start int, n long, w long"), "suffix-strings")


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, start and end (bytes; null end: the whole text) of what lies in a string that occurs twice."""
    unit = repeats.Unit(False, length, min(seed, length), min(BLOCK, length))
    found = staged(contexts(docs, unit), "suffix-contexts")
    twice, asked = classes(found, "suffix-classes")
    end = F.when(F.col("common").isNotNull(), F.col("pos") - F.col("low") + length).alias("end")
    start = F.when(F.col("common").isNotNull(), F.col("pos") - F.col("high")).otherwise(0).alias("start")
    spans = found.filter("doc_id is not null").join(twice, "name", "left_semi").select("doc_id", start, end)
    named = _names(docs, asked, unit)
    # Strings that others can share: those that begin and end within the reaches, if any.
    limits = reaches(named, unit).select("name", (F.lit(length) - F.col("right")).alias("least"), F.col("left").alias("most"))
    near = named.join(limits, "name").select("n", "doc_id", "pos", "least", "most", F.explode("blocks").alias("b"))
    blocks = near.select("b.*", "n", "doc_id", "pos", "least", "most").filter("low <= most and high >= least")
    blocks = staged(blocks, "suffix-ranges")
    twice, asked = classes(blocks, "suffix-ranges")
    spans = spans.unionByName(blocks.filter("n = 1").join(twice, "name", "left_semi").select("doc_id", start, end))
    strings = _strings(docs, asked, unit)
    again = strings.groupBy("w").agg(F.sum("n").alias("m")).filter("m > 1").select("w")
    single = strings.filter("n = 1").join(again, "w", "left_semi")
    return spans.unionByName(single.select("doc_id", "start", (F.col("start") + length).alias("end")))


def drop_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept_sha256 of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats.kept_pieces(docs, repeated_spans(docs, length), repeats.Unit(False, length, min(SEED, length)))


_CHECK = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS pos FROM t),
win AS (SELECT doc_id, pos, hex(b[pos:pos]) AS byte, CASE WHEN pos + {LENGTH - 1} <= octet_length(b) THEN md5(b[pos:pos + {LENGTH - 1}]) END AS s FROM p),
twice AS (SELECT doc_id, pos, byte, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS r FROM win),
cover AS (SELECT doc_id, pos, byte, bool_or(r) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM twice),
edge AS (SELECT doc_id, pos, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS first FROM cover)
SELECT t.doc_id, count(e.pos) AS n_bytes, count(*) FILTER (WHERE e.gone) AS n_removed, count(*) FILTER (WHERE e.first) AS n_spans,
       sha256(unhex(coalesce(string_agg(e.byte, '' ORDER BY e.pos) FILTER (WHERE NOT e.gone), ''))) AS kept_sha256
FROM t LEFT JOIN edge e ON e.doc_id = t.doc_id GROUP BY t.doc_id
"""


@query("op4_suffixes", _CHECK)
def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents in strings of 400 bytes that occur twice."""
    return drop_repeated(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
