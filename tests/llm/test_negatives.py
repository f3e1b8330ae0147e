"""Hard negatives against all pairs, and the scoring tables against plain inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.llm import negatives
from limnos.llm.negatives import best, in_bands, mine, planes_of, scores, subset_sums

SCHEMA = "vec_id long, label long, embedding array<float>, score long, room string, chunk int"


def brute(rows, every, positives=5, negatives_=10):
    one = {}
    for vec, label, v, *_ in rows:
        if vec is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, tuple(float(np.float32(x)) for x in v))
        one[vec] = min(one.get(vec, row), row)
    ints = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in one.items()}
    out = []
    for a, (label, v) in ints.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other) for b, (other, w) in ints.items() if b != a and len(w) == len(v))
        for ps, p, _ in [x for x in s if x[2] == label][:positives]:
            band = [x for x in s if x[2] != label and 30 * -ps <= -100 * x[0] <= 90 * -ps]
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(band[:negatives_])]
    return sorted(out)


def vectors():
    rng = random.Random(2)
    centre = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(400):
        c = centre[min(i % 7, 3)]  # one frequent label
        rows.append((i, min(i % 5, 2), [x + rng.gauss(0, 0.7) for x in c], 1, "r", 2))
    rows += [(400 + i, 0, [float(i), -1.0, 0.25], 1, None, 1) for i in range(30)]  # another length
    rows += [(500 + i, i % 2, rows[0][2], 1, None, 1) for i in range(30)]  # ties
    rows += [(600, 1, None, 1, None, 1), (601, None, rows[3][2], 1, None, 1), (None, 1, rows[3][2], 1, None, 1), (602, 1, [], 1, None, 1), (603, 2, [], 1, None, 1), (610, 1, [], 1, None, 1)]
    rows += [(604, 1, [float("nan")] * 12, 1, None, 1), (605, 1, [float("inf")] * 12, 1, None, 1), (606, 1, [None] * 12, 1, None, 1)]
    rows += [rows[20], rows[20], (20, 0, rows[21][2], 1, None, 1)]  # repeated rows and another row of that id
    return rows


def test_tables_give_exact_inner_products():
    rng = np.random.default_rng(1)
    for dims, most in ((64, 150), (3, 5000), (8, 1), (17, 1 << 20)):
        a, c = rng.integers(-most, most + 1, (5, dims)), rng.integers(-most, most + 1, (1030, dims))
        bits = most.bit_length() + 1
        for kind in (np.int32, np.int64):
            if kind is np.int32 and most**2 * dims >= 1 << 31:
                continue
            got = np.concatenate(list(scores(subset_sums(a, kind), planes_of(c, bits))))
            assert (got == c @ a.T).all()


def test_selection_by_place():
    s = np.array([5, 9, 9, 1, 9, 7])
    assert best(s, 2).tolist() == [1, 2] and best(s, 9).tolist() == [1, 2, 4, 5, 0, 3]
    assert [x.tolist() for x in in_bands(s, np.array([10, 8, -4]), 2)] == [[1, 2], [5, 0], []]


@pytest.mark.parametrize("chunk", [4096, 50])
def test_equal_to_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "ANCHORS", max(2, chunk // 10))
    monkeypatch.setattr(negatives, "BLOCKS", 2)
    rows = vectors()
    got = mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.expr("vec_id % 10 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, 10)
    assert want and sorted(map(tuple, got.collect())) == want


def test_nothing_to_do(spark):
    assert mine(spark.createDataFrame([], SCHEMA), F.expr("vec_id % 10 = 0")).count() == 0
    alone = spark.createDataFrame([(10, 1, [1.0], 1, None, 1), (11, 2, [1.0], 1, None, 1)], SCHEMA)
    assert mine(alone, F.expr("vec_id % 10 = 0")).count() == 0
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([(10, 1, [1e12], 1, None, 1)], SCHEMA), F.expr("vec_id % 10 = 0"))
