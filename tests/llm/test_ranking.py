"""Ranked search against a plain scorer, with many slices, bundles, owners and blocks."""

import math
import re
from collections import Counter

import pytest

from limnos.llm import ranking
from limnos.llm.ranking import TERM_PATTERN, search

ITEMS = "item_id long, text string, score long, part string"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(TERM_PATTERN, lower)


def brute(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for d, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return out


def items(rows):
    texts = [t for _, t, *_ in rows if t]
    out = [(i, " ".join(texts[i * 3 % len(texts)].split()[: 5 + i]), 1, "p") for i in range(25)]
    out += [(40, None, 1, "p"), (41, "", 1, "p"), (42, "?! --", 1, "p"), (43, "nowhere-to-be-found", 1, "p"), (44, "É ß X one TWO", 1, "p")]
    return out + [out[3], (3, "w1 w2 extra", 1, "p"), (None, "w3 w4", 1, "p")]


@pytest.mark.parametrize(("k", "slice_", "group", "owners", "block"), [(50, 4096, 256, 4, 16 << 20), (7, 16, 4, 3, 16 << 20), (5, 9, 256, 5, 600), (3, 40, 8, 1, 16 << 20)])
def test_equal_to_a_plain_scorer(spark, docs, rows, monkeypatch, k, slice_, group, owners, block):
    monkeypatch.setattr(ranking, "SLICE", slice_)
    asked = items(rows)
    got = search(docs, spark.createDataFrame(asked, ITEMS), k, owners, group, block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute([(d, t) for d, t, *_ in rows], [(i, t) for i, t, *_ in asked], k), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_nothing_to_do(spark, docs, nothing):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "w1 w2", 1, "p")], ITEMS)
    assert search(docs, none).count() == 0
    assert search(nothing, some).count() == 0
    assert search(docs, spark.createDataFrame([(1, None, 1, "p"), (2, "--", 1, "p")], ITEMS)).count() == 0
