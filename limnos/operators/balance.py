"""Charge-balance error and its acceptability flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.constants import CBE_ACCEPTABLE_PCT, CBE_MARGINAL_PCT, MAJOR_IONS, MAX_MISSING_MAJOR_IONS, mgl
from limnos.functions.expr import number, safe_div

# Flag names, from best to worst.
FLAGS = ("acceptable", "marginal", "rejected", "unknown")


def charge_balance_error(cations: Column, anions: Column, as_fraction: bool = False) -> Column:
    error = safe_div(cations - anions, cations + anions)
    return error if as_fraction else error * 100.0


def balance_flag(
    error: Column,
    acceptable: float = CBE_ACCEPTABLE_PCT,
    marginal: float = CBE_MARGINAL_PCT,
    reliable: Column | None = None,
) -> Column:
    size = F.abs(error)
    flag = (
        F.when(size <= acceptable, "acceptable")
        .when(size <= marginal, "marginal")
        .when(size > marginal, "rejected")
        .otherwise("unknown")
    )
    return flag if reliable is None else F.when(reliable, flag).otherwise("unknown")


def reliability(df: DataFrame, max_missing: int = MAX_MISSING_MAJOR_IONS) -> Column:
    """True when at most ``max_missing`` of the major ions carried by the frame are missing.

    Evaluate it on measured data, before any imputation.
    """
    majors = [mgl(i) for i in MAJOR_IONS if mgl(i) in df.columns]
    if not majors:
        return F.lit(True)
    missing = sum((number(c).isNull().cast("int") for c in majors), F.lit(0))
    return missing <= max_missing


def add_charge_balance(
    df: DataFrame,
    acceptable: float = CBE_ACCEPTABLE_PCT,
    marginal: float = CBE_MARGINAL_PCT,
    reliable: Column | None = None,
) -> DataFrame:
    """``CBE_pct`` and ``CBE_flag``; rows that are not reliable are always ``unknown``."""
    if not {"sum_cat", "sum_an"} <= set(df.columns):
        raise KeyError("sum_cat and sum_an are needed; call add_meq first")
    df = df.withColumn("CBE_pct", charge_balance_error(F.col("sum_cat"), F.col("sum_an")))
    return df.withColumn("CBE_flag", balance_flag(F.col("CBE_pct"), acceptable, marginal, reliable))


def balance_counts(df: DataFrame) -> DataFrame:
    """Samples per flag; every flag has its row even when no sample carries it."""
    counts = df.agg(*[F.count_if(F.col("CBE_flag") == f).alias(f) for f in FLAGS])
    return counts.unpivot([], list(FLAGS), "CBE_flag", "n")
