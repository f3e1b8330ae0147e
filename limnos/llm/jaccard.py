"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct shingles. In one order of all shingles (rarer first, by a count sketch over all
documents, then by hash) two sets with Jaccard t or more share at least l of their first |x| - ceil(t |x|) + l
shingles, for every l. Each document takes the l whose estimated cost (postings met, candidates to verify) is least,
and a pair becomes a candidate when it shares min(l of either) prefix shingles, or more where its two sizes ask for it. Candidates are verified exactly.

Equal sets are one node. Two rounds keep groups of near copies from being listed pair by pair: first every document is
compared with the one in most of its posting lists that has the fewest shingles of its own; then, only between documents that
are not yet in one component, all candidates are verified. Pairs that need rare shingles to link are looked for in short
lists alone, and the others only where both have enough prefix tokens left to reach the number they must share, so long
lists are gone through by few documents. So every link that joins two components is found, and components are exact.

Defined results: null, empty and wordless texts have an empty set and stand alone; texts with fewer words than a shingle
are one shingle, the whole sequence; rows with one doc_id are one node, whatever their texts (a link of any of them
counts), and keep a row each; a row without a doc_id has the component of its set and links nothing; an empty table gives no rows; extra columns are untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.graphs import checked, components, staged
from limnos.llm.registry import query, table
from limnos.llm.text import WORD_PATTERN, byte_views, mix64, run_hashes, word_hashes
from limnos.session import bound_batches, cut_lineage

SHINGLE = 5
PERCENT = 75
#: Cells of the count sketch (a power of two), which every task holds.
CELL_BITS = 18
#: Every l is at least one of so many of the set's shingles; so many longer ones are tried.
LEAST_PART = 12
TRIES = 64
#: Lists of more sets than this are long: pairs are looked for in them only where the rest can't make up a link.
LONG_LIST = 32
#: Sets that a task holds at once.
HELD = 1000
#: Cost of a posting met and, per shingle of the document, of a candidate, against one posting sent.
MET, VERIFIED = 0.2, 0.05

_EMPTY = np.zeros(0, np.uint64)


def shingles(raw: np.ndarray | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(raw, lower=True)[0] if raw is not None and len(raw) else _EMPTY
    if not len(words):
        return _EMPTY
    if len(words) < size:
        return mix64(run_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(run_hashes(words, size))


def least_shared(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of n must share with any set it links with."""
    return (percent * n + 99) // 100


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefix(found: np.ndarray, cells: np.ndarray, noise: float, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """The prefix of a set, its l, and how far it reaches in the order of all shingles (coarsely: ties are possible)."""
    counts = cells[found >> np.uint64(64 - CELL_BITS)]
    order = np.lexsort((found, counts))
    base = len(found) - int(least_shared(len(found), percent))
    least = -(-len(found) // LEAST_PART)
    tries = np.arange(least, min(least + TRIES, len(found) - base + 1))
    others = np.cumsum(np.maximum(0.0, counts[order[: base + tries[-1]]] - noise))[base + least - 1 :]
    cost = tries + MET * others + VERIFIED * len(found) * others / tries
    shared = int(tries[np.argmin(cost)])
    last = order[base + shared - 1]
    return found[order[: base + shared]], shared, int(min(counts[last], (1 << 38) - 1)) << 24 | int(found[last] >> np.uint64(40))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for i in range(0, batch.num_rows, HELD):
            part = batch.slice(i, HELD)
            yield part, [shingles(raw) for raw in byte_views(part.column("text"))]


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << CELL_BITS, np.int64)
    for _, sets in _each(batches):
        total += np.bincount((np.concatenate([_EMPTY, *sets]) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
    cell = np.flatnonzero(total)
    for i in range(0, len(cell), 1 << 16):
        part = cell[i : i + (1 << 16)]
        yield _batch(cell=pa.array(part.astype(np.int32)), n=pa.array(total[part]))


def sketch(docs: DataFrame) -> np.ndarray:
    """Documents by hash cell of their shingles, over all documents; of fixed size."""
    counts = docs.select("text").mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << CELL_BITS, np.int64)
    out[counts["cell"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def profiles(docs: DataFrame, cells: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (shingles), l and reach of its prefix, and rep (the smallest doc_id with the same set) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        noise = _noise(sent.value)
        for batch, sets in _each(batches):
            digests = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
            about = np.array([prefix(s, sent.value, noise, percent)[1:] if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2)
            yield _batch(doc_id=batch.column("doc_id"), n=pa.array([len(s) for s in sets], pa.int64()), l=pa.array(about[:, 0]), reach=pa.array(about[:, 1]), d1=pa.array(digests[:, 0]), d2=pa.array(digests[:, 1]))

    rows = cut_lineage(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, l long, reach long, d1 long, d2 long"))
    first = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    return cut_lineage(rows.join(first, ["d1", "d2"], "left").select("doc_id", "n", "l", "reach", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _noise(cells: np.ndarray) -> float:
    """Counts of a cell up to here say nothing about a shingle."""
    mean = float(cells.mean())
    return mean + 3 * mean**0.5 + 1


def postings(docs: DataFrame, reps: DataFrame, cells: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """token, rep, n, l, reach, s, lone (part in no list) and long for every prefix token that two sets share."""
    sent = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        noise = _noise(sent.value)
        for batch, sets in _each(batches):
            out: list[tuple[np.ndarray, int]] = []
            for doc, s in zip(batch.column("doc_id").to_pylist(), sets, strict=True):
                # A task sends equal sets once.
                if len(s) and doc is not None and (digest := _digest(s)) not in seen:
                    seen.add(digest)
                    out.append((prefix(s, sent.value, noise, percent)[0], doc))
                if len(out) == 500:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    def _rows(out: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        many = [len(p) for p, _ in out]
        return _batch(token=pa.array(np.concatenate([p for p, _ in out]).view(np.int64)), doc_id=pa.array(np.repeat([d for _, d in out], many).astype(np.int64)))

    sent_rows = docs.select("doc_id", "text").mapInArrow(run, "token long, doc_id long")
    same = Window.partitionBy("token")
    shared = sent_rows.select("*", F.min("doc_id").over(same).alias("low"), F.max("doc_id").over(same).alias("high")).filter("low <> high")
    # Only the pairs of token and set travel; what the prefixes are like is joined at the end.
    one = staged(shared.select("token", "doc_id").join(reps.select("doc_id", "rep").distinct(), "doc_id").select("token", "rep").distinct(), "jaccard-lists")
    about = reps.groupBy("rep").agg(*[F.max(c).alias(c) for c in ("n", "l", "reach")])
    # Sets that share too few prefix tokens, with all others together, to link with any: no partner is smaller than
    # ``percent`` of a set, and none has an l below its size's least.
    smallest = F.expr(f"({percent} * n + 99) div 100")
    enough = one.groupBy("rep").agg(F.count("*").alias("k")).join(about, "rep").filter(F.col("k") >= F.least("l", F.ceil(smallest / LEAST_PART))).select("rep")
    kept = staged(one.join(enough, "rep", "left_semi"), "jaccard-lists")
    sizes = kept.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token", (F.col("k") > LONG_LIST).alias("long"))
    lists = staged(kept.join(sizes, "token"), "jaccard-lists")
    # What a set can share by long lists: what they hold of its prefix, and all that is not in its prefix.
    unlisted = F.expr(f"({percent} * n + 99) div 100 - l")
    rows = lists.groupBy("rep").agg(F.count("*").alias("k"), F.count_if("long").alias("in_long")).join(about, "rep")
    rows = rows.select("rep", "n", "l", "reach", (F.col("in_long") + unlisted).alias("s"), (F.lit(1.0) - (F.col("k") + unlisted) / F.col("n")).alias("lone"))
    return lists.join(rows, "rep").select("token", "rep", "n", "l", "reach", "s", "lone", "long")


def _verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    pairs = cut_lineage(pairs.select("a", "b"))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(checked(cut_lineage(ids)), "id", "left_semi")
    # The text of b goes to a, so where each b has one a, every text travels once more only.
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", _EMPTY)
        for batch in batches:
            keep = []
            for x, y in zip(byte_views(batch.column("text_b")), byte_views(batch.column("text_a")), strict=True):
                if y is not None and y.tobytes() != last[0]:
                    last = (y.tobytes(), shingles(y))
                keep.append(y is not None and linked(shingles(x), last[1], percent))
            chosen = pa.array(keep, pa.bool_())
            yield _batch(u=batch.column("a").filter(chosen), v=batch.column("b").filter(chosen))

    return cut_lineage(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long").distinct())


def _needed(n: str, l_: str, m: str, k: str, percent: int):
    """Prefix tokens that two sets of n and m shingles (with l and k) must share to link.

    Besides min(l, k): all that the shorter-reaching prefix does not hold is its set's rest, so what the prefixes
    share and the larger rest together must make up the overlap that the two sizes ask for.
    """
    rest = [F.expr(f"({percent} * {a} + 99) div 100") - F.col(b) for a, b in ((n, l_), (m, k))]
    return F.greatest(F.least(l_, k), _overlap(n, m, percent) - F.greatest(*rest))


def _overlap(n: str, m: str, percent: int):
    """Shingles that two sets of n and m must share to link."""
    return F.ceil(percent * (F.col(n) + F.col(m)) / float(100 + percent) - 1e-6)


def _comparable(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _candidates(open_: DataFrame, percent: int) -> DataFrame:
    """a and b of all pairs of different components that share as many of the open lists' tokens as they need.

    All sets go through their tokens in one order, short lists first. At the first token that a pair shares, each of the two
    still has as many tokens left as the pair shares in all; so a pair is named only where enough are left to both, and a set
    stays in a long list only if it has enough left for any partner there. What is named is then counted in full.
    """
    lists = open_.groupBy("token").agg(F.count("*").alias("size"), F.min("l").alias("least"))
    own = Window.partitionBy("rep")
    placed = open_.join(lists, "token").withColumn("p", F.row_number().over(own.orderBy("size", "token")))
    placed = placed.withColumn("left", F.count("*").over(own) - F.col("p") + 1).withColumn("short", F.count_if(~F.col("long")).over(own) - F.col("p") + 1)
    kept = staged(placed.filter(~F.col("long") | (F.col("left") >= F.least("l", "least"))).drop("size", "least", "p"), "jaccard-open")
    x, y = kept.alias("x"), kept.alias("y")
    # A pair that long lists and the unlisted rest can't link shares rare shingles: it is found in short lists. The set
    # whose prefix ends first has all its shared prefix tokens in the other's prefix, too.
    rest = F.when(F.col("x.reach") < F.col("y.reach"), F.col("x.s")).when(F.col("x.reach") > F.col("y.reach"), F.col("y.s")).otherwise(F.greatest("x.s", "y.s"))
    by_long = _overlap("x.n", "y.n", percent) <= rest
    need = F.when(by_long, _needed("x.n", "x.l", "y.n", "y.l", percent)).otherwise(F.greatest(F.lit(1), _overlap("x.n", "y.n", percent) - rest))
    pair = (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.c") != F.col("y.c")) & _comparable("x.n", "y.n", percent)
    enough = F.when(by_long, F.least("x.left", "y.left")).otherwise(F.least("x.short", "y.short")) >= need
    named = x.join(y, pair & (~F.col("x.long") | by_long) & enough).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), need.alias("need"), by_long.alias("by_long")).distinct()
    # A set's tokens are no more than its prefix.
    tokens = open_.groupBy("rep").agg(F.collect_list("token").alias("all"), F.collect_list(F.when(~F.col("long"), F.col("token"))).alias("rare"))
    both = named.join(tokens.select(F.col("rep").alias("a"), F.struct("all", "rare").alias("ta")), "a").join(tokens.select(F.col("rep").alias("b"), F.struct("all", "rare").alias("tb")), "b")
    shared = F.when(F.col("by_long"), F.size(F.array_intersect("ta.all", "tb.all"))).otherwise(F.size(F.array_intersect("ta.rare", "tb.rare")))
    return both.filter(shared >= F.col("need")).select("a", "b")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row (docs: doc_id, text)."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cells = sketch(docs)
    reps = profiles(docs, cells, percent)
    lists = staged(postings(docs, reps.filter("n > 0").distinct(), cells, percent), "jaccard-lists")
    # Round 1: everyone against the document of its lists with the smallest part of shingles of its own: among edited
    # copies, one that is edited little.
    hub = lists.groupBy("token").agg(F.min(F.struct("lone", "rep", "n", "l")).alias("hub"))
    met = lists.join(hub, "token").filter("rep <> hub.rep").select("rep", "n", "l", F.col("hub.rep").alias("h"), F.col("hub.n").alias("hn"), F.col("hub.l").alias("hl"))
    met = met.filter(_comparable("n", "hn", percent))
    first = met.groupBy("rep", "h").agg(F.count("*").alias("c"), F.min(_needed("n", "l", "hn", "hl", percent)).alias("need")).filter("2 * c >= need")
    # Of the lists' documents of that kind, the one that most lists name (others stand for it in some of the lists); what
    # stays unlinked is left to round 2.
    first = first.groupBy("rep").agg(F.max_by("h", F.struct("c", -F.col("h"))).alias("h"))
    found = _verified(docs, first.select(F.col("h").alias("a"), F.col("rep").alias("b")), percent)
    comp = cut_lineage(components(found))
    # Round 2: lists that still touch several components.
    named = lists.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", "n", "l", "reach", "s", "long", F.coalesce("component", "rep").alias("c"))
    parted = named.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("token")
    open_ = staged(named.join(parted, "token", "left_semi"), "jaccard-open")
    second = _candidates(open_, percent)
    more = _verified(docs, second.join(found.select(F.col("u").alias("a"), F.col("v").alias("b")), ["a", "b"], "left_anti"), percent)
    # Rows of one doc_id with different texts tie their sets together.
    twice = reps.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"), F.count_distinct("rep").alias("k")).filter("k > 1").select("doc_id", "u")
    tied = reps.join(twice, "doc_id").select("u", F.col("rep").alias("v")).filter("u <> v")
    final = cut_lineage(components(found.unionByName(more).unionByName(tied)))
    return reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document (all columns) of each component: the one with the smallest doc_id."""
    found = cut_lineage(join(docs, percent))
    later = found.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(checked(later), "doc_id", "left_anti").select(docs.columns)
    twice = cut_lineage(found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    once = kept.join(checked(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(checked(twice), "doc_id", "left_anti").unionByName(once.select(docs.columns)).select(docs.columns)


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CHECK = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD_PATTERN}') AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
win AS (SELECT doc_id, size, pos, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n FROM p
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {SHINGLE - 1} FOLLOWING)),
sh AS (SELECT DISTINCT doc_id, s FROM win WHERE n = {SHINGLE} OR (size < {SHINGLE} AND pos = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.root) AS component_id FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op1_jaccard", _CHECK)
def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return join(table(spark, sf_dir, "documents"))
