"""Toxic passages as maximum-scoring segments of token log-odds.

Learning (on a bounded sample of labelled rows, distinct texts counted once): every token gets the log-odds of its
document counts in toxic and clean texts under a Dirichlet prior, drawn towards zero by its standard error, less a
drift that makes ordinary text score downhill. Searching (every whole text): one linear scan finds all maximal scoring
segments (Ruzzo and Tompa). Aggregating: a segment of score S in a text of n tokens is expected K n exp(-lambda S)
times by chance; the logarithms of these chances below one are summed over the text's segments, and a monotone curve,
fitted on a fold of the labelled rows that the weights have not seen, turns the sum into a probability.

Defined results: a row without a key is never held out; null, empty and wordless texts have no segment and get the curve's lowest value; repeated rows are
scored alike; without labels every score is 0; extra columns pass by untouched. A label row whose mark is not 0 or 1
is ignored, and a document labelled twice is toxic if any of its rows says so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.registry import query, table
from limnos.session import bound_batches

#: Labelled rows used for learning, at most; the ones with the smallest hash of their key.
LABELLED_ROWS = 20_000
#: Pseudo-count of every token in either class.
PRIOR = 0.5
#: A weight is its log-odds less so many standard errors.
ERRORS = 2.0
#: Score that every token loses.
DRIFT = 0.25
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    decay: float  # lambda
    rate: float  # K
    knots: tuple[float, ...]  # evidence
    chances: tuple[float, ...]  # probability of a toxic text at each knot


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in order of place.

    Only places with a positive score can start or end one, so the scan visits these alone; every candidate is joined
    or set aside a bounded number of times.
    """
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    after = np.cumsum(scores)
    found: list[list[float]] = []  # start, end, sum before, sum after
    for p in places:
        part = [int(p), int(p) + 1, float(after[p] - scores[p]), float(after[p])]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= part[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= part[3]:
                found.append([*part, j])
                break
            part = [found[j][0], part[1], found[j][2], part[3]]
            del found[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi, _ in found]


def token_scores(words: list[str], weights: dict[str, float], drift: float = DRIFT) -> np.ndarray:
    get = weights.get
    return np.fromiter((get(w, 0.0) for w in words), float, len(words)) - drift


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        clean: Counter = Counter()
        toxic: Counter = Counter()
        for text, mark in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            (toxic if mark else clean).update(set(tokens(text)))
        words = list(clean | toxic)
        yield pa.RecordBatch.from_pydict(
            {"token": pa.array(words, pa.string()), "n_toxic": pa.array([toxic[w] for w in words], pa.int64()), "n_clean": pa.array([clean[w] for w in words], pa.int64())}
        )


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """text, toxic and fold (true: for the curve) of the learning sample; equal texts once."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` keys are sent to the tasks; the texts stay where they are.
    rows_ = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    once = rows_.groupBy(F.xxhash64("text").alias("same")).agg(F.max_by(F.struct("doc_id", "text", "toxic"), F.struct("toxic", -F.col("doc_id"))).alias("r")).select("r.*")
    return once.select("text", "toxic", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 3).alias("fold"))


def learn(sample: DataFrame) -> Model:
    """Weights, chance law and curve from a bounded sample (text, toxic, fold)."""
    bound_batches(sample.sparkSession)
    counts = sample.filter(~F.col("fold")).select("text", "toxic").mapInArrow(_token_counts, "token string, n_toxic long, n_clean long")
    counts = counts.groupBy("token").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    size = counts.agg(F.count("*").alias("n"), F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")).first()
    if not size["n"]:
        return Model({}, 1.0, 1.0, (0.0,), (0.0,))
    all_t, all_c = size["t"] + PRIOR * size["n"], size["c"] + PRIOR * size["n"]
    t, c = F.col("n_toxic") + PRIOR, F.col("n_clean") + PRIOR
    odds = F.log(t / (all_t - t)) - F.log(c / (all_c - c))
    weight = F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - ERRORS * F.sqrt(1 / t + 1 / c))
    # The sample is bounded, and so are its tokens; only those with a weight come here.
    rows = counts.select("token", weight.alias("weight"), (c / all_c).alias("chance")).filter("weight <> 0").orderBy("token").toPandas()
    weights = dict(zip(rows.token, rows.weight.astype(float), strict=True))
    chance = np.append(rows.chance.to_numpy(float), max(0.0, 1.0 - rows.chance.sum()))
    decay = _decay(chance, np.append(rows.weight.to_numpy(float), 0.0) - DRIFT)
    sent = sample.sparkSession.sparkContext.broadcast(weights)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(w := tokens(x)), [s for _, _, s in segments(token_scores(w, sent.value))]) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": pa.array([n for n, _ in out], pa.int64()), "scores": pa.array([s for _, s in out], pa.list_(pa.float64())), "toxic": batch.column("toxic").cast(pa.int32())})

    fold = sample.filter("fold").select("text", "toxic").mapInArrow(runs, "n long, scores array<double>, toxic int").toPandas()
    clean = fold[fold.toxic == 0]
    least = 1.0
    rate = (sum(s >= least for x in clean.scores for s in x) + 0.5) / (clean.n.sum() + 1.0) * math.exp(decay * least)
    found = np.array([evidence(n, np.asarray(s), decay, rate) for n, s in zip(fold.n, fold.scores, strict=True)])
    knots, chances = _curve(found, fold.toxic.to_numpy(float))
    return Model(weights, decay, rate, tuple(knots), tuple(chances))


def _decay(chance: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(chance * exp(x * scores)) = 1, where clean tokens have these chances."""
    low, high = 0.0, 0.01
    if not (scores > 0).any():
        return 1.0
    while (chance * np.exp(high * scores)).sum() < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (chance * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def evidence(n: int, scores: np.ndarray, decay: float, rate: float) -> float:
    """Sum over the segments of how far each is from being expected once by chance."""
    if not len(scores) or not n:
        return 0.0
    return float(np.maximum(0.0, decay * scores - math.log(rate * n)).sum())


def _curve(found: np.ndarray, toxic: np.ndarray, bins: int = 32) -> tuple[list[float], list[float]]:
    """Monotone share of toxic texts over the evidence: pooled neighbours of equal-sized bins."""
    if not len(found):
        return [0.0], [0.0]
    base = toxic.mean()
    pools: list[list[float]] = []  # sum of evidence, toxic, rows
    order = np.argsort(found, kind="stable")
    zero = int((found[order] <= 0).sum())
    rest = np.array_split(order[zero:], min(bins, max(1, (len(order) - zero) // 5))) if zero < len(order) else []
    for part in [order[:zero], *rest]:
        if len(part):
            pools.append([float(found[part].sum()), float(toxic[part].sum()) + base, len(part) + 1.0, float(len(part))])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                last = pools.pop()
                pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return [p[0] / p[3] for p in pools], [min(1.0, p[1] / p[2]) for p in pools]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_segments (significant ones), evidence, score and predicted of every row."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            many, found = [], []
            for text in batch.column("text"):
                words = tokens(text.as_py() or "")
                s = np.array([x for _, _, x in segments(token_scores(words, m.weights))])
                many.append(int((m.decay * s > math.log(m.rate * len(words))).sum()) if len(s) else 0)
                found.append(evidence(len(words), s, m.decay, m.rate))
            p = np.interp(found, m.knots, m.chances)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_segments": pa.array(many, pa.int32()), "evidence": pa.array(found, pa.float64()), "score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32))}
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_segments int, evidence double, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                words = tokens(text.as_py() or "")
                found = evidence(len(words), np.array([x for _, _, x in segments(token_scores(words, m.weights))]), m.decay, m.rate)
                keep.append(float(np.interp(found, m.knots, m.chances)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(labelled_texts(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_segments", "evidence")
