"""Selections and lookups that cut across the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.constants import PLAUSIBLE_RANGES
from limnos.functions.expr import number, present


def select_samples(df: DataFrame, chosen: DataFrame, key: str = "sample_seq") -> DataFrame:
    """The samples whose key is in the selection."""
    return df.join(chosen.select(key).distinct(), key, "left_semi")


def attach(df: DataFrame, block: DataFrame, key: str = "sample_seq") -> DataFrame:
    """One-to-one join of a derived block on the sample key."""
    return df.join(block, key, "left")


def long_against_limits(df: DataFrame, limits: DataFrame, key: str = "sample_seq") -> DataFrame:
    """Measured values in long form beside the limit of their parameter.

    A limits table has at most 30 rows per standard, so it is broadcast.
    """
    columns = present(df, *PLAUSIBLE_RANGES)
    values = df.select(key, *[number(c).alias(c) for c in columns]).unpivot([key], columns, "parameter", "value")
    joined = values.filter(F.col("value").isNotNull()).join(F.broadcast(limits), "parameter")
    above = F.coalesce(F.col("value") > F.col("maximum"), F.lit(False))
    below = F.coalesce(F.col("value") < F.col("minimum"), F.lit(False))
    return joined.withColumn("exceeds", above | below)
