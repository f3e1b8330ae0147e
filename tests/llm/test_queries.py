"""Every registered query on the smallest tables, and the pipeline's stages one after the other."""

import corpus_pipeline
from limnos.llm.queries import QUERIES

ROWS = {"op1_jaccard": "documents", "op4_suffixes": "documents", "op5_substrings": "documents", "op6_extraction": "pages", "op7_sharding": "documents", "op8_toxicity": "documents", "op9_mixing": "documents", "op10_warc": "pages"}


def test_one_row_for_each_row(spark, sf):
    for name, source in ROWS.items():
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{source}.parquet").count(), name


def test_neighbours_of_every_twentieth_vector(spark, sf):
    ids = spark.read.parquet(f"{sf}/embeddings.parquet")
    n, asked = ids.count(), ids.filter("vec_id % 20 = 0").count()
    assert QUERIES["op3_neighbours"](spark, sf).count() >= 0.9 * asked * min(20, n - 1)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    leaked = {r["doc_id"] for r in QUERIES["op2_decontamination"](spark, sf).collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "sharding":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
        if name == "decontamination":
            assert not leaked & {r["doc_id"] for r in docs.collect()}
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] == sizes[5]


def test_stages_on_odd_rows(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    some = [r for r in given.limit(60).collect()]
    odd = [(None, some[0]["text"]), (10**9, None), (10**9 + 1, ""), (10**9 + 2, " \t\n"), (10**9 + 3, "word " * 60_000), (10**9 + 4, "é漢🙂"), (some[1]["doc_id"], some[1]["text"]), (some[1]["doc_id"], some[1]["text"])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, `group` long, shard int, toxic int, rep long"
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "k", 1, 2, 3, 4) for r in some] + [(d, t, None, None, None, None, None, None, None, None) for d, t in odd]
    for docs in (spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame([], schema)):
        empty = docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, sf)
            if name != "sharding":
                assert docs.columns == before.columns, name
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            ids = [r["doc_id"] for r in docs.collect()]
            assert bool(ids) != empty, name
            if name == "near_duplicates" and not empty:
                assert ids.count(some[1]["doc_id"]) <= 1 and {10**9, 10**9 + 1, 10**9 + 2} <= set(ids)
