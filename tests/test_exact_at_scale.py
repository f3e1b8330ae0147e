"""The skew-proof ways must give what the plain definitions give."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limnos.operators.long_series import median_slopes, pair_counts
from limnos.operators.neighbours import knn_fill
from limnos.operators.quantiles import exact_quantiles, floor_index
from limnos.operators.trend import rising_falling, sen_slope, tie_term


def brute_pairs(y):
    up = sum(b > a for a, b in itertools.combinations(y, 2))
    down = sum(b < a for a, b in itertools.combinations(y, 2))
    return up, down


def test_merge_counting_and_slope_search():
    rng = np.random.default_rng(1)
    for n in (2, 9, 300, 700):
        x = np.sort(rng.choice(5000, n, replace=False)).astype(float)
        y = np.round(rng.normal(0, 1, n) + 0.0005 * x, 1)
        assert rising_falling(y) == brute_pairs(y)
        slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(n), 2)]
        assert sen_slope(x, y) == pytest.approx(np.median(slopes), abs=1e-12)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_quantiles_of_hot_groups(spark, hot_rows):
    rng = random.Random(5)
    rows = [("a", float(rng.randint(0, 40))) for _ in range(901)] + [("b", rng.random()) for _ in range(240)]
    rows += [("c", 1.0), ("c", 2.0), ("d", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.25, 0.5, 0.75]
    got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["v"], probs, ["g"], hot_rows=hot_rows, accuracy=200).collect()}
    for g in ("a", "b", "c", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g][0] == len(v)
        assert got[g][1] == pytest.approx(list(np.percentile(v, [25, 50, 75])))
    top = exact_quantiles(df, ["v"], [0.9], ["g"], floor_index, hot_rows=hot_rows, accuracy=200)
    got = {r["g"]: r["q"] for r in top.collect()}
    for g in ("a", "b", "c"):
        v = sorted(x for k, x in rows if k == g)
        assert got[g] == [v[min(len(v) - 1, int(len(v) * 0.9))]]


def test_long_series_counts_split_over_tasks(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for name, n in (("p", 260), ("q", 151)):
        y = np.round(rng.normal(0, 1, n) + np.arange(n) / 300, 1)
        rows += [("s", name, float(i), float(v)) for i, v in enumerate(y)]
        want[name] = brute_pairs(y)
    points = spark.createDataFrame(rows, "station_code string, parameter string, x double, z double")
    got = pair_counts(points, ["station_code", "parameter"], limit=60).collect()
    assert {r["parameter"]: (r["up"], r["down"]) for r in got} == want


def test_long_series_slope(spark):
    rng = np.random.default_rng(8)
    n = 61
    x = np.sort(rng.choice(4000, n, replace=False)) / 365.25
    y = np.round(rng.normal(0, 1, n) + 0.4 * x, 1)
    points = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(n), 2)]
    got = median_slopes(points, ["k"], limit=1000).collect()
    assert got[0]["slope"] == pytest.approx(np.median(slopes), abs=1e-9)


def brute_knn(pdf, cols, k):
    m = pdf[cols].to_numpy(float)
    out = m.copy()
    for i, j in zip(*np.where(np.isnan(m))):
        cand = []
        for d in range(len(m)):
            if np.isnan(m[d, j]):
                continue
            both = ~np.isnan(m[i]) & ~np.isnan(m[d])
            if both.any():
                cand.append((((m[i] - m[d])[both] ** 2).sum() * len(cols) / both.sum(), d))
        cand.sort()
        near = cand[:k]
        if not near:
            out[i, j] = np.nanmean(m[:, j])
            continue
        zero = [d for dist, d in near if dist == 0]
        if zero:
            out[i, j] = m[zero, j].mean()
        else:
            w = np.array([1 / np.sqrt(dist) for dist, _ in near])
            out[i, j] = (w * m[[d for _, d in near], j]).sum() / w.sum()
    return out


@pytest.mark.parametrize("chunk, leaf", [(20, 17), (2048, 512)])
def test_nearest_neighbours_match_brute_force(spark, chunk, leaf):
    rng = np.random.default_rng(3)
    cols = ["Ca_mgL", "Mg_mgL", "Na_mgL", "F_mgL"]
    m = rng.gamma(2.0, 20.0, (160, 4))
    m[rng.random(m.shape) < 0.12] = np.nan
    m[40:60] = m[3]  # a group of copies
    m[61] = np.nan
    pdf = pd.DataFrame(m, columns=cols).assign(sample_seq=range(160), NO3_mgL=np.nan)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "Ca_mgL double, Mg_mgL double, Na_mgL double, F_mgL double, sample_seq long, NO3_mgL double")
    got = knn_fill(df, [*cols, "NO3_mgL"], 5, chunk=chunk, leaf=leaf).orderBy("sample_seq").toPandas()
    np.testing.assert_allclose(got[cols].to_numpy(), brute_knn(pdf, cols, 5), rtol=1e-9)
    assert got["NO3_mgL"].isna().all() and not got["NO3_mgL__imputed"].any()
    assert (got["Ca_mgL__imputed"] == pdf["Ca_mgL"].isna()).all()


def test_both_quantile_ways_give_the_same_rows(spark):
    from limnos.operators.quantiles import exact_quantiles, floor_index, linear_position

    rows = [(g, None if g == "empty" else float((i * 37) % 11), None, float(i * i % 97) if i % 3 else None) for g in ("a", "b", None, "empty") for i in range(60)]
    df = spark.createDataFrame(rows, "g string, ties double, nothing double, gaps double")
    for keys in ((), ("g",)):
        for position in (linear_position, floor_index):
            found = [
                sorted(map(str, exact_quantiles(df, ["ties", "nothing", "gaps"], [0.0, 0.25, 0.5, 0.99], keys, position, hot_rows=n).collect()))
                for n in (1_000_000, 0)
            ]
            assert found[0] == found[1] and len(found[0]) == 3 * (4 if keys else 1)


@pytest.mark.parametrize("leaf,fan", [(4, 2), (16, 32)])
def test_few_leaves_are_compared_and_none_is_missed(spark, monkeypatch, leaf, fan):
    """Every leaf with one of the k nearest donors is among those compared; the walk down makes no rows of nodes."""
    from limnos.operators import neighbours

    monkeypatch.setattr(neighbours, "FAN", fan)
    rng = np.random.default_rng(17)
    x = np.round(rng.normal(0, 50, (400, 3)), 1)
    x[rng.random((400, 3)) < 0.15] = np.nan
    x[:3] = np.nan
    cols = ["a", "b", "c"]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_seq long, a double, b double, c double")
    _, donors, pairs = neighbours.candidates(df, cols, 5, leaf=leaf)
    where = {r["seq"]: (r["donor_pattern"], r["part"]) for r in donors.collect()}
    near = {}
    for r in pairs.collect():
        near.setdefault((r["rid"], r["target"]), set()).add((r["donor_pattern"], r["part"]))
    leaves = len(set(where.values()))
    n = 0
    for i in range(3, 400):
        for t, c in enumerate(cols):
            common = ~np.isnan(x[i]) & ~np.isnan(x)
            able = np.flatnonzero(~np.isnan(x[:, t]) & common.any(axis=1))
            if not np.isnan(x[i, t]) or i not in where or not len(able):
                continue
            d2 = (np.where(common, np.nan_to_num(x) - np.nan_to_num(x[i]), 0.0) ** 2).sum(axis=1)[able] * 3 / common[able].sum(axis=1)
            assert {where[s] for s in able[np.argsort(d2, kind="stable")[:5]] if s in where} <= near[i, c]
            n += len(near[i, c])
    assert n / len(near) < leaves / 2
