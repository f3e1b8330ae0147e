"""Ranked lexical search by pipelined term partitioning.

One pass over the texts makes an index of the items' terms in slices of at most ``SLICE`` documents. Terms are dealt to
owners, rare ones first, so that each owner holds about as many postings. For every slice there is a bundle for each group
of ``GROUP`` items. It visits the owners one after the other: in each stage a cogroup brings it together with that owner's
postings of the slice, their integer contributions are added to its sparse accumulators, and it travels on. After the
last owner it hands on its best documents, of which the best of all slices are chosen.

Accumulators that cannot reach the result are left behind, exactly: contributions are never negative, so the k-th
largest score that an item has in a slice is a floor for its k-th largest final one, and a document is given up only if
its score and the most that all later owners can add (the largest contribution of each term, taken over all postings)
stay below it. Should later owners add to such a document again, its score is only smaller than it really is.

Slices come from the order in which tasks read their rows, so no key can make one large. Items are taken in blocks of
bounded bytes, each with a pass of its own; the terms of a block are broadcast.

Defined results: null, empty and termless texts count in no statistic and are never found; rows are documents of their own, whatever
their doc_id, null ones too (last among equal scores); rows of one item_id are one item with the terms of all (null is
an item_id, too); an item without terms, or whose terms weigh nothing, has no rows; texts are read whole; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.graphs import staged
from limnos.llm.registry import query, table
from limnos.llm.text import byte_views
from limnos.session import scratch_path

#: A term: a run of ASCII letters and digits and of all that is not ASCII.
TERM_PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BEST = 50
#: Documents of a slice (numbered in 16 bits), items of a bundle, owners of terms.
SLICE = 4096
GROUP = 256
OWNERS = 4
#: Bytes of items (id and distinct terms) searched in one pass.
BLOCK_BYTES = 16 << 20

#: Bytes of terms, A-Z in lower case; all others are gaps.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM_PATTERN), F.lit(0)))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def contributions(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What one unit of weight adds for tf occurrences in a document of n terms."""
    m = 100 - 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Block:
    """Items searched together: ids and, for each, the numbers of its terms."""

    ids: list[int | None]
    items: list[list[int]]
    terms: dict[bytes, int]


@dataclass
class Route:
    """What the stages need of all terms: owner, weight, items of each group that hold it, and what is to come."""

    owner: np.ndarray
    weight: np.ndarray
    holders: list[dict[int, np.ndarray]]  # by group: term -> places of items
    to_come: list[np.ndarray]  # by group: most that owners after each stage can add, [stage, item]


def blocks(items: DataFrame, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items (item_id, text) in blocks; an item is never cut."""
    pairs = staged(items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of("text")).alias("term")).distinct(), "ranking-items")
    total = pairs.agg(F.sum(F.octet_length("term") + 8)).first()[0]
    parts = -(-(total or 0) // size)
    for part in range(parts):
        rows = pairs.filter(F.pmod(F.coalesce(F.xxhash64("item_id"), F.lit(0)), F.lit(parts)) == part)
        found = rows.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy(F.col("item_id").asc_nulls_last()).collect()
        terms: dict[bytes, int] = {}
        numbered = [[terms.setdefault(t.encode(), len(terms)) for t in r["terms"]] for r in found]
        if found:
            yield Block([r["item_id"] for r in found], numbered, terms)


_INDEX = "slice long, n_docs long, n_terms long, ids array<long>, lens binary, term binary, doc binary, tf binary"


def index(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Slices of documents with their lengths and the postings (term, document, occurrences) of the given terms, by term."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = sent.value
        made = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        lens: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            term, doc, tf = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(term, kind="stable")
            n = np.array(lens, np.int64)
            blobs = [n, term[order].astype("<i4"), doc[order].astype("<u2"), tf[order].astype("<i4")]
            return pa.RecordBatch.from_arrays(
                [pa.array([made]), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                ["slice", "n_docs", "n_terms", "ids", "lens", "term", "doc", "tf"],
            )

        for batch in batches:
            for one, raw in zip(batch.column("doc_id").to_pylist(), byte_views(batch.column("text")), strict=True):
                words = raw.tobytes().translate(_TERM_BYTES).split() if raw is not None else []
                if not words:
                    continue
                known = np.fromiter(map(lookup.get, words, repeat(-1)), np.int64, len(words))
                term, tf = np.unique(known[known >= 0], return_counts=True)
                found.append((term, np.full(len(term), len(ids)), tf))
                ids.append(one)
                lens.append(len(words))
                if len(ids) == SLICE:
                    yield rows()
                    made, ids, lens, found = made + 1, [], [], []
        if ids:
            yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _INDEX)


def _postings(row: dict, documents: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and contribution of a slice's postings."""
    term, doc, tf = (np.frombuffer(row[c], t) for c, t in (("term", "<i4"), ("doc", "<u2"), ("tf", "<i4")))
    n = np.frombuffer(row["lens"], np.int64)
    return term, doc, contributions(tf.astype(np.int64), n[doc], documents, terms)


def term_counts(slices: DataFrame, size: int, documents: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each term, and its largest contribution in any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                term, _, added = _postings(row, documents, terms)
                df += np.bincount(term, minlength=size)
                np.maximum.at(top, term, added)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at), "df": pa.array(df[at]), "top": pa.array(top[at])})

    found = slices.select("lens", "term", "doc", "tf").mapInArrow(run, "term long, df long, top long").groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top")).toPandas()
    df, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
    df[found["term"].to_numpy(np.int64)], top[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64), found["top"].to_numpy(np.int64)
    return df, top


def route(block: Block, df: np.ndarray, top: np.ndarray, documents: int, owners: int = OWNERS, group: int = GROUP) -> Route:
    """Owners of terms (rare ones first, equal shares of postings), and the most that later owners add to each item."""
    weights = np.array([weight(documents, int(d)) if d else 0 for d in df], np.int64)
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    owner = np.empty(len(df), np.int64)
    owner[order] = np.minimum(owners - 1, before * owners // max(int(df.sum()), 1))
    holders, to_come = [], []
    for start in range(0, len(block.items), group):
        part = block.items[start : start + group]
        places: dict[int, list[int]] = {}
        most = np.zeros((owners, len(part)), np.int64)
        for place, terms in enumerate(part):
            for t in terms:
                if weights[t]:
                    places.setdefault(t, []).append(place)
                    most[: owner[t], place] += weights[t] * top[t]
        holders.append({t: np.array(p) for t, p in places.items()})
        to_come.append(most)
    return Route(owner, weights, holders, to_come)


_SENT = "slice long, part int, owner int, ids array<long>, term binary, doc binary, added binary"
_BUNDLE = "slice long, part int, counts binary, doc binary, score binary"


def sent_postings(slices: DataFrame, sent, owners: int, documents: int, terms: int) -> DataFrame:
    """Postings of every slice by owner, for each group of items that holds their terms; the last owner knows the doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Route = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                term, doc, added = _postings(row, documents, terms)
                for part, held in enumerate(plan.holders):
                    wanted = np.isin(term, np.fromiter(held, np.int64, len(held)))
                    for owner in range(owners):
                        at = wanted & (plan.owner[term] == owner)
                        last = owner == owners - 1
                        if at.any() or last:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([row["slice"]]), pa.array([part], pa.int32()), pa.array([owner], pa.int32()), pa.array([row["ids"] if last else None], pa.list_(pa.int64())), *(pa.array([b.tobytes()], pa.binary()) for b in (term[at], doc[at], added[at].astype("<i4")))],
                                ["slice", "part", "owner", "ids", "term", "doc", "added"],
                            )

    return slices.mapInArrow(run, _SENT)


def _packed(scores: np.ndarray) -> bytes:
    """64-bit scores, equal bytes of all side by side (the upper ones are zeros, which compress away)."""
    return np.ascontiguousarray(scores.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _accumulate(plan: Route, part: int, bundles: pa.Table, postings: pa.Table) -> np.ndarray:
    """Scores [item, document] of a bundle once an owner's postings are added."""
    held = plan.holders[part]
    scores = np.zeros((plan.to_come[part].shape[1], SLICE), np.int64)
    for row in bundles.to_pylist():
        if row["counts"]:
            items = np.repeat(np.arange(len(scores)), np.frombuffer(row["counts"], "<u2"))
            scores[items, np.frombuffer(row["doc"], "<u2")] = _unpacked(row["score"])
    for row in postings.to_pylist():
        term, doc, added = (np.frombuffer(row[c], t) for c, t in (("term", "<i4"), ("doc", "<u2"), ("added", "<i4")))
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            t = int(term[lo])
            scores[held[t][:, None], doc[lo:hi]] += plan.weight[t] * added[lo:hi].astype(np.int64)
    return scores


def _floors(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each item (0 if fewer documents have one)."""
    return np.partition(scores, SLICE - k, axis=1)[:, SLICE - k] if k <= SLICE else np.zeros(len(scores), np.int64)


def search_block(docs: DataFrame, block: Block, k: int = BEST, owners: int = OWNERS, group: int = GROUP) -> DataFrame:
    """item_id, doc_id and score of the best documents of each slice (docs: doc_id, text)."""
    spark = docs.sparkSession
    slices = staged(index(docs, block.terms), "ranking-index")
    documents, terms = slices.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    df, top = term_counts(slices, len(block.terms), documents, terms)
    sent = spark.sparkContext.broadcast(route(block, df, top, documents, owners, group))
    path = scratch_path(spark, "ranking-postings")
    sent_postings(slices, sent, owners, documents, terms).write.partitionBy("owner").parquet(path)
    postings = spark.read.schema(_SENT).parquet(path)
    names, groups = block.ids, -(-len(block.ids) // group)
    parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    nothing = F.lit(None).cast("binary")
    bundles = slices.select("slice", parts.alias("part"), nothing.alias("counts"), nothing.alias("doc"), nothing.alias("score"))

    def visit(stage: int):
        def run(key: tuple, bundle: pa.Table, met: pa.Table) -> pa.Table:
            plan, part = sent.value, key[1].as_py()
            scores = _accumulate(plan, part, bundle, met)
            hopeful = (scores > 0) & (scores + plan.to_come[part][stage][:, None] >= _floors(scores, k)[:, None])
            item, doc = np.nonzero(hopeful)
            counts = np.bincount(item, minlength=len(scores)).astype("<u2")
            blobs = [counts.tobytes(), doc.astype("<u2").tobytes(), _packed(scores[item, doc])]
            return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([part], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], ["slice", "part", "counts", "doc", "score"])

        return run

    def choose(key: tuple, bundle: pa.Table, met: pa.Table) -> pa.Table:
        plan, part = sent.value, key[1].as_py()
        scores = _accumulate(plan, part, bundle, met)
        ids = pa.array(met.column("ids").to_pylist()[0], pa.int64())
        unknown, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        item, doc = np.nonzero((scores > 0) & (scores >= _floors(scores, k)[:, None]))
        score = scores[item, doc]
        order = np.lexsort((number[doc], unknown[doc], -score, item))
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < k]
        start = part * group
        return pa.Table.from_arrays([pa.array([names[start + i] for i in item[order]], pa.int64()), ids.take(pa.array(doc[order])), pa.array(score[order])], ["item_id", "doc_id", "score"])

    keys = ["slice", "part"]
    for stage in range(owners):
        met = bundles.groupBy(*keys).cogroup(postings.filter(F.col("owner") == stage).drop("owner").groupBy(*keys))
        bundles = met.applyInArrow(choose, "item_id long, doc_id long, score long") if stage == owners - 1 else met.applyInArrow(visit(stage), _BUNDLE)
    return bundles


def search(docs: DataFrame, items: DataFrame, k: int = BEST, owners: int = OWNERS, group: int = GROUP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents (docs: doc_id, text; items: item_id, text)."""
    found = [staged(search_block(docs, block, k, owners, group), "ranking-best") for block in blocks(items, block_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHECK = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{TERM_PATTERN}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{TERM_PATTERN}')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY ALL),
t AS (SELECT p.term, floor(1000 * ln((2 * any_value(s.docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY p.term),
c AS (SELECT p.doc_id, p.term, t.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * s.docs) // s.terms))) AS v FROM p JOIN t ON p.term = t.term, s),
f AS (SELECT q.item_id, c.doc_id, sum(c.v)::BIGINT AS score FROM q JOIN c ON q.term = c.term GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f WHERE score > 0) WHERE rank <= {BEST}
"""


@query("op11_ranking", _CHECK)
def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
