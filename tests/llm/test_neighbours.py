import numpy as np

from limnos.llm.neighbours import grow, leaves_needed, nearest


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, point long, v string")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x *= rng.uniform(0.2, 3.0, (3000, 1)).astype(np.float32)  # norms differ: inner product, not angle
    vectors = table(spark, [(i, v.tolist(), 0, 1, "a") for i, v in enumerate(x)])
    got = nearest(vectors, vectors.filter("vec_id % 60 = 0"), k=10, leaf=64).toPandas()
    exact = x.astype(float) @ x.astype(float).T
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, 11)) and part.score.is_monotonic_decreasing
        assert np.allclose(part.score, exact[q, part.vec_id], rtol=1e-12)
        row = exact[q].copy()
        row[q] = -np.inf
        hits += len(set(np.argsort(-row)[:10]) & set(part.vec_id))
    assert got.query_id.nunique() == 50 and hits >= 0.9 * 500


def test_copies_ties_and_unusable_vectors(spark):
    one, two = [1.0, 0.0], [0.5, 0.5]
    rows = [(i, one) for i in range(40)] + [(100, two), (101, two), (102, [0.0, 0.0]), (103, None), (104, [1.0, None]), (105, [float("nan"), 1.0]), (106, [float("inf"), 1.0]), (107, [1.0]), (None, one), (5, one)]
    vectors = table(spark, [(*r, 0, 1, "a") for r in rows])
    got = nearest(vectors, vectors.filter("vec_id in (3, 100, 102, 103, 107)"), k=5).toPandas().sort_values(["query_id", "rank"])
    assert list(got[got.query_id == 3].vec_id) == [0, 1, 2, 4, 5]
    assert list(got[got.query_id == 100].vec_id) == [0, 1, 2, 3, 4]
    assert set(got.query_id) == {3, 100}


def test_fewer_candidates_and_empty_tables(spark):
    vectors = table(spark, [(1, [1.0, 2.0], 0, 1, "a"), (2, [2.0, 1.0], 0, 1, "a")])
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in nearest(vectors, vectors, k=20).orderBy("query_id").collect()] == [(1, 2, 4.0), (2, 1, 4.0)]
    assert nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_leaves_hold_every_point_once():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    forest = grow(x, float(np.linalg.norm(x, axis=1).max()), trees=3, leaf=20)
    at = forest.leaves(x)
    for t in range(3):
        assert np.bincount(at[:, t]).max() <= 20
    most = sum(len(o) + 1 for _, o, _ in forest.trees)
    assert len(set(forest.search(x[0], most))) == most >= leaves_needed(forest, x, 5)


def test_length_of_the_vectors_changes_no_search():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12))
    x = np.repeat(centres, 40, axis=0) + 0.2 * rng.normal(size=(800, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest, longer = grow(x, 1.0), grow(10 * x, 10.0)
    assert leaves_needed(longer, 10 * x, 10) == leaves_needed(forest, x, 10)
    assert [longer.search(10 * v, 6) for v in x[:50]] == [forest.search(v, 6) for v in x[:50]]
