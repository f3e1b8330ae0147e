"""Removing words that repeat an earlier run of words: seeds on winnowed anchors, extended to maximal repeats.

Documents meet on winnowed anchors (the least six-word gram of every run of 20 words), each occurrence of an anchor with
the first one. A meeting is extended word by word both ways; repeats of 20 words or more are kept, and every word of the
later one goes. Runs that only later occurrences share are compared by the hashes of their windows (see ``repeats``).

Defined results: null, empty and wordless texts have no words and lose none; texts of fewer words than a run lose none;
of equal texts only the one with the smallest doc_id keeps its words; rows that repeat a doc_id with the same text are
one document and treated alike; a doc_id is taken to have one text (rows that give it others get the spans of any);
a row without a doc_id loses nothing; an empty table gives no rows; extra columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import repeats
from limnos.llm.registry import query, table
from limnos.llm.text import WORD_PATTERN

WINDOW = 20
SEED = 6
#: Anchors in which two documents must meet for their texts to be brought together; fewer are compared by window hashes.
MEETINGS = 12


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start and end (words; null end: the whole text) of what repeats earlier text."""
    unit = repeats.Unit(True, window, min(SEED, window))
    copies = repeats.profiles(docs, unit)
    found = repeats.extended(docs, repeats.later_ones(repeats.occurrences(docs, unit, copies)), unit, least=MEETINGS)
    open_ = found.filter("w is not null")
    first = open_.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("w", "first")
    later = open_.join(first, "w").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    whole = copies.filter("doc_id > first").select("doc_id", F.lit(0).alias("start"), F.lit(None).cast("int").alias("end"))
    runs = found.filter("w is null").select("doc_id", "start", "end")
    return runs.unionByName(later.select("doc_id", "start", "end")).unionByName(whole)


def keep_first(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n, n_removed, n_spans and kept_sha256 of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return repeats.kept_pieces(docs, repeated_spans(docs, window), repeats.Unit(True, window, min(SEED, window)))


_CHECK = rf"""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_PATTERN}')) AS word, generate_subscripts(regexp_extract_all(text, '{WORD_PATTERN}'), 1) AS pos FROM documents),
win AS (SELECT doc_id, pos, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n FROM p
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS k FROM win WHERE n = {WINDOW}) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range({WINDOW})) AS pos FROM later)
SELECT d.doc_id, count(p.word) AS n_words, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY d.doc_id
"""


@query("op5_substrings", _CHECK)
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that repeat an earlier run of 20 words."""
    return keep_first(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")
