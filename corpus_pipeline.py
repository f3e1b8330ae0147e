"""The corpus pipeline: filter, deduplicate, decontaminate, mix and shard the documents.

Defined results of all stages: a null or empty text is not toxic, no near duplicate and not contaminated, and the mix takes it
never, as it has no words; rows without a doc_id stay rows of their own until the mix; of repeated rows of one doc_id one
stays; texts of any length are read whole; extra columns, whatever their names, go along until the last stage; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.decontamination import leaks
from limnos.llm.graphs import checked, staged
from limnos.llm.jaccard import keep_one
from limnos.llm.mixing import mixed_documents
from limnos.llm.sharding import shard
from limnos.llm.toxicity import keep_clean, labelled_texts, learn
from limnos.session import scratch_path


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic; the weights are learned from the labels of the documents at hand."""
    return keep_clean(docs, learn(labelled_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no test item leaks."""
    found = staged(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "leaking")
    return docs.join(checked(found), "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each as often as the mix takes it."""
    return mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return shard(docs).select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("mixing", mixed), ("sharding", sharded)]

#: The stages learn weights and search neighbours, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
