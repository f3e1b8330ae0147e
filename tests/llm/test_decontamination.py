import random

import pyarrow as pa

from limnos.llm import decontamination as dec
from limnos.session import ARROW_BYTES, bound_batches


def item(rng, n):
    return " ".join(f"q{rng.randrange(3000)}" for _ in range(n - 6)) + ". The answer of it " + " ".join(f"a{rng.randrange(3000)}" for _ in range(3)) + "."


def test_all_items_above_the_threshold_are_found():
    rng = random.Random(8)
    words = [f"v{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30)))) for i in range(150)]
    counts = {}
    for _, t in rows:
        for w in set(dec.words_of(t)):
            counts[w] = counts.get(w, 0) + 1
    numbers, (index,) = dec.build_indexes(rows, counts, len(rows), 19.0)
    for _ in range(60):
        passage = sorted({int(index.local[numbers[w]]) for w in rng.sample(words, 14)})
        want = {}
        for t in passage:
            for p in range(index.starts[t], index.starts[t + 1]):
                want[int(index.items[p])] = want.get(int(index.items[p]), 0.0) + float(index.shares[p])
        for least in (0.5, 0.3):
            got = index.search(list(passage), least)
            assert sorted(i for i, _ in got) == sorted(i for i, s in want.items() if s >= least)


def test_leaks_and_near_leaks(spark):
    rng = random.Random(3)
    items = [(i, item(rng, rng.choice([12, 30, 60, 200]))) for i in range(80)] + [(900, None), (901, ""), (902, "of the"), (None, "x y z a b c d")]
    fill = lambda n: " ".join(f"w{rng.randrange(800)}" for _ in range(n))
    docs, want = [], set()
    for d in range(200):
        text = fill(rng.randrange(0, 300))
        if d % 4 == 0:
            i, t = items[d % 80]
            words = t.split()
            if d % 8 == 0 and len(words) > 20:
                words[10] = "changed"
            text += " " + " ".join(words).upper() + "\n" + fill(rng.randrange(0, 300))
            want.add((d, i))
        docs.append((d, text, 1.0, "s"))
    docs += [(1000, None, 0.0, "s"), (1001, "", 0.0, "s"), docs[4], (1002, fill(20_000) + " " + items[5][1], 0.0, "s"), (1003, items[5][1].split(".")[0], 0.0, "s")]
    table = spark.createDataFrame(docs, "doc_id long, text string, score double, item_id string")
    got = dec.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(1002, 5)}
    assert len(got) == len(want) + 1


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, item(rng, 25)) for i in range(40)]
    table = spark.createDataFrame([(i, "start " + t + " end") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dec.leaks(table, bench).collect()))
    monkeypatch.setattr(dec, "ITEMS", 15)
    parts = sorted(map(tuple, dec.leaks(table, bench).collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in parts] == [(i, i) for i, _ in items]
    assert dec.leaks(table.limit(0), bench).count() == dec.leaks(table, bench.limit(0)).count() == 0


def test_short_items_leak_as_a_whole(spark):
    rng = random.Random(9)
    fill = lambda n: " ".join(f"w{rng.randrange(800)}" for _ in range(n))
    items = [(1, "Paris."), (2, "of the river"), (3, "the river Seine, Paris"), (4, "Of the RIVER!"), (5, "..."), (6, item(rng, 20)), (7, "never met")]
    docs = [
        (1, fill(100) + " paris " + fill(90)), (2, fill(30) + " of the\nriver " + fill(9)), (3, "river the of parisian"), (4, "of the"), (5, fill(70) + " The river Seine (Paris)"),
        (6, "of the blue river"), (7, "never"), (8, "met"), (9, None), (10, items[5][1] + " of"), (11, "the river x of the river of the river seine paris"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["item_id"]): r for r in dec.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 2), (2, 4), (5, 1), (5, 3), (10, 6), (11, 1), (11, 2), (11, 3), (11, 4)}
    assert [got[k]["start"] for k in ((1, 1), (2, 2), (5, 3))] == [64, 0, 32] and got[1, 1]["score"] == 1.0
    only = dec.leaks(table, spark.createDataFrame(items[:1], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in only} == {1, 5, 11}


def test_scripts_without_spaces(spark):
    assert dec.words_of("Wasser 水は H2O") == ["wasser", "水", "は", "h2o"]
    assert dec.words_of("ที่นี่ ฿5") == ["ที่", "นี่", "5"]
    rng = random.Random(10)
    fill = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items = [(1, fill(30) + "？" + fill(8) + "。"), (2, "東京都"), (3, "น้ำคืออะไร คำตอบคือของเหลว"), (4, fill(14))]
    docs = [(i, fill(60) + t + fill(60)) for i, t in items] + [(5, fill(200)), (6, "京東都"), (7, items[0][1][:30])]
    got = dec.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, i) for i in (1, 2, 3, 4)}


def test_no_rdd_of_python_and_bounded_batches(spark, tmp_path):
    spark.range(3000).selectExpr("id AS doc_id", "concat(id, repeat(' word', 1000)) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents")
    spark.range(1).selectExpr("id AS item_id", "'some question of six words? and its answer' AS text").write.parquet(f"{tmp_path}/items")
    spark.conf.unset(ARROW_BYTES)
    try:
        docs = spark.read.parquet(f"{tmp_path}/documents")
        found = dec.leaks(docs, spark.read.parquet(f"{tmp_path}/items"))
        assert "RDD" not in found._jdf.queryExecution().optimizedPlan().toString()
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r["n"] for r in sizes) == 3000 and max(r["size"] for r in sizes) < 5_000_000
        spark.conf.set(ARROW_BYTES, "32m")
        bound_batches(spark)
        assert spark.conf.get(ARROW_BYTES) == "32m"
    finally:
        spark.conf.unset(ARROW_BYTES)
