"""Near-duplicate components against all pairs."""

from limnos.llm import jaccard
from limnos.llm.graphs import components


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    ids = sorted({i for i, *_ in rows if i is not None})
    sets = {i: sets_of(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_components_match_all_pairs(docs, rows):
    want = brute(rows)
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_one_document_of_each_component_stays(docs, rows):
    want = brute(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(i for i, (_, c) in want.items() if c == i)


def test_empty_table(nothing):
    assert jaccard.join(nothing).count() == 0


def test_longer_prefixes_lose_no_link(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "MET", 0.0)
    monkeypatch.setattr(jaccard, "VERIFIED", 1e6)  # every document takes long prefixes
    want = brute(rows)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in jaccard.join(docs).collect() if r["doc_id"] is not None)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
