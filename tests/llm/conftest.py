import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that the operators use inside.
        T.StructField("key", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("size", T.LongType()),
    ]
)


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(words)]


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, null, empty, blank, short and long texts, repeated rows, a hot source."""
    rng = random.Random(5)
    texts: list[str | None] = [" ".join(prose(rng, rng.randrange(1, 200))) for _ in range(60)]
    base = prose(rng, 300)
    for _ in range(12):  # near copies
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = "EDIT" + str(rng.random())
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 8  # copies
    passage = " ".join(prose(rng, 90))
    texts += [" ".join(prose(rng, 40)) + " " + passage + "\n" + " ".join(prose(rng, 40)) for _ in range(6)]
    texts += [passage + " tail " + passage, "again and " * 300, None, "", " \t\n\x0b", "one two three", "ONE two THREE", "x"]
    texts += ["é ü ß " * 30 + passage, " ".join(prose(rng, 9000))]
    rows = [(i, t, None if i % 17 == 0 else f"s{min(i % 7, 3)}", "k", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[70]]  # repeated rows
    rows.append((None, texts[5], "s1", None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
