"""Byte and word repeats against brute force on every window."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from collections import Counter

from limnos.llm import repeats, substrings, suffixes
from tests.llm.conftest import prose


def by_id(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_bytes_that_occur_twice(docs, rows):
    for length in (400, 90):
        found = by_id(suffixes.drop_repeated(docs, length))
        seen = Counter()
        texts = [(i, (t or "").encode()) for i, t, *_ in rows]
        for _, b in texts:
            seen.update(b[k : k + length] for k in range(len(b) - length + 1))
        for i, b in texts:
            if i is None:
                assert found[None][0]["n_removed"] == 0
                continue
            gone = np.zeros(len(b) + 2, bool)
            for k in range(len(b) - length + 1):
                if seen[b[k : k + length]] > 1:
                    gone[k + 1 : k + 1 + length] = True
            r = found[i][0]
            kept = bytes(x for x, g in zip(b, gone[1:-1]) if not g)
            assert (r["n"], r["n_removed"], r["kept_sha256"]) == (len(b), gone.sum(), hashlib.sha256(kept).hexdigest()), i
            assert r["n_spans"] == (gone[1:] & ~gone[:-1]).sum()


def test_words_that_repeat_earlier_ones(docs, rows):
    for window in (20, 7):
        found = by_id(substrings.keep_first(docs, window))
        first: dict = {}
        texts = {i: (t or "").encode().split() for i, t, *_ in rows if i is not None}
        for i in sorted(texts):
            w = texts[i]
            gone = np.zeros(len(w), bool)
            for k in range(len(w) - window + 1):
                if first.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                    gone[k : k + window] = True
            kept = b" ".join(x for x, g in zip(w, gone) if not g)
            for r in found[i]:  # rows that repeat a document are treated alike
                assert (r["n"], r["n_removed"], r["kept_sha256"]) == (len(w), gone.sum(), hashlib.sha256(kept).hexdigest()), i


def test_copies_met_before_the_smallest_doc_id(spark):
    rng = random.Random(11)
    text = prose(rng, 300, 5000)
    text[220:260] = text[20:60]
    parts = {k: prose(rng, 60, 5000) + text[k : k + 90] + prose(rng, 60, 5000) for k in (100, 150, 205)}
    # One task meets the copies in falling order, so the first of them last; each passage is shared with one other document.
    rows = [(9, " ".join(text)), (7, " ".join(text)), (3, " ".join(text)), (1, " ".join(parts[100])), (5, " ".join(parts[150])), (8, " ".join(parts[205])), (3, " ".join(text))]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    test_bytes_that_occur_twice(table, rows)
    test_words_that_repeat_earlier_ones(table, rows)


def removed_by_brute_force(texts, length):
    seen = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        out.append((int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum())))
    return out


def test_many_near_copies_ask_for_few_strings(spark):
    rng = random.Random(3)
    base = prose(rng, 900, 5000)
    texts = []
    for _ in range(30):  # copies that differ from each other, the first included, at other places and share some edits
        copy = list(base)
        for at in rng.sample(range(0, 900, 30), 3):
            copy[at] = rng.choice(["EDIT", "EDITED", "OTHER"])
        texts.append(" ".join(copy))
    texts.append("ab" * 900 + " ".join(base[:200]))
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raw = [t.encode() for t in texts]
    want = removed_by_brute_force(raw, 400)
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.drop_repeated(docs).collect()}
    assert [found[i] for i in range(len(rows))] == want
    # What is sent to be merged: a few spans for an anchor, not a span for each string.
    spans = suffixes.repeated_spans(docs)
    assert spans.count() < sum(n for n, _ in want) / 32
    assert spans.filter("end - start > 400").count() > 0.5 * spans.filter("end is not null").count()


def test_texts_that_share_a_doc_id(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(prose(rng, 200, 5000)) for _ in range(3))
    # The second text of 1 is met under the first one's doc_id; 2 and 3 share passages with either text.
    rows = [(1, a), (1, b + "tail"), (2, c + " " + a[:500] + " " + c[::-1]), (3, b[100:700] + c[::-1][:300])]
    found = {r["doc_id"]: r["n_removed"] for r in suffixes.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] > 1}
    want = removed_by_brute_force([t.encode() for _, t in rows], 400)
    assert [found[2], found[3]] == [want[2][0], want[3][0]] and min(found[2], found[3]) > 0


def test_spans_are_merged_to_maximal_runs():
    rng = np.random.default_rng(2)
    for size in (0, 1, 40):
        for many in (0, 1, 12):
            spans = [{"start": int(s), "end": None if s % 7 == 6 else int(s + e)} for s, e in zip(rng.integers(0, 50, many), rng.integers(0, 9, many), strict=True)]
            start, end = repeats._merged(pa.array([spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))[0], size)
            gone = np.zeros(size + 2, bool)
            for s in spans:
                gone[1 + s["start"] : 1 + (size if s["end"] is None else min(size, s["end"]))] = True
            assert start.tolist() == np.flatnonzero(gone[1:] & ~gone[:-1]).tolist()
            assert end.tolist() == np.flatnonzero(gone[:-1] & ~gone[1:]).tolist()


def test_row_counts_and_empty_tables(docs, rows, nothing):
    assert suffixes.drop_repeated(docs).count() == substrings.keep_first(docs).count() == len(rows)
    assert suffixes.drop_repeated(nothing).count() == substrings.keep_first(nothing).count() == 0


def test_sliding_argmin_ties_to_the_left():
    rng = np.random.default_rng(1)
    values = (rng.integers(0, 5, 3000).astype(np.uint64)) << np.uint64(40)
    for width in (1, 2, 7, 369):
        got = repeats.sliding_argmin(values, width)
        assert list(got) == [k + int(np.argmin(values[k : k + width])) for k in range(len(values) - width + 1)]
    assert len(repeats.sliding_argmin(values[:3], 7)) == 0
