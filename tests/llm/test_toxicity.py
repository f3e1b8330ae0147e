import random
import zlib

import numpy as np

from limnos.llm import toxicity

BAD = ["vile", "scum", "idiot"]


def brute_segments(scores):
    """Maximal scoring segments by their definition: recursively the best one, then left and right of it."""

    def go(low, high):
        best = (0.0, 0, 0)
        for a in range(low, high):
            for b in range(a + 1, high + 1):
                s = sum(scores[a:b])
                if s > best[0] + 1e-12:
                    best = (s, a, b)
        if best[0] <= 0:
            return []
        return [*go(low, best[1]), best[1:], *go(best[2], high)]

    return go(0, len(scores))


def test_segments_match_their_definition():
    rng = random.Random(4)
    for _ in range(150):
        scores = np.array([rng.choice([-3.0, -1.0, 2.0, 1.5, -0.5, 4.0]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))])
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == brute_segments(list(scores))


def corpus(rng):
    docs, labels = [], []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 150))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD) for _ in range(3)]
        docs.append((i, " ".join(words), "s", 0.0, 1))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(random.Random(9))
    odd = [(2000, None, "s", 0.0, 1), (2001, "", "s", 0.0, 1), (2002, " \n", "s", 0.0, 1), (None, "vile scum idiot", "s", 0.0, 1), docs[0], (2003, "word " * 60_000 + "vile scum idiot", "s", 0.0, 1)]
    table = spark.createDataFrame(docs + odd, "doc_id long, text string, source string, score double, fold int")
    marks = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (4, 0, 7)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(toxicity.labelled_texts(table, marks))
    got = {r["doc_id"]: r for r in toxicity.score(table, model).collect()}
    held = [i for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["predicted"] == (i % 6 == 0) for i in held)
    assert got[2000]["score"] == got[2001]["score"] == got[2002]["score"] == min(r["score"] for r in got.values())
    assert got[None]["predicted"] == 1 and got[2003]["n_segments"] >= 1
    kept = toxicity.keep_clean(table, model)
    assert kept.columns == table.columns and kept.filter("doc_id % 6 = 0 and doc_id < 900").count() == 0 and kept.count() == len(docs) + len(odd) - 150 - 2 - (got[2003]["predicted"] == 1)


def test_no_labels(spark):
    table = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.learn(toxicity.labelled_texts(table, spark.createDataFrame([], "doc_id long, toxic int")))
    assert [r["score"] for r in toxicity.score(table, model).collect()] == [0.0]
