"""Concentration units and sums: mg/L, meq/L, mmol/L, alkalinity as CaCO3."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.constants import (
    ALL_IONS,
    ANIONS,
    CACO3_EQUIVALENT_WEIGHT,
    CATIONS,
    DEFAULT_EW_TABLE,
    IONS,
    equivalent_weights,
    meq,
    mgl,
    mmol,
)
from limnos.functions.expr import number, row_sum


def _carried(df: DataFrame, ions: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [i for i in ions if mgl(i) in have]


def add_meq(
    df: DataFrame,
    ions: Iterable[str] = ALL_IONS,
    ew_table: str = DEFAULT_EW_TABLE,
    add_sums: bool = True,
) -> DataFrame:
    """``<ion>_meq`` for every ion column present, then ``sum_cat`` / ``sum_an``."""
    weights = equivalent_weights(ew_table)
    ions = _carried(df, ions)
    out = df.withColumns({meq(i): number(mgl(i)) / F.lit(weights[i]) for i in ions}) if ions else df
    if not add_sums:
        return out
    return out.withColumns(
        {
            "sum_cat": row_sum(*[F.col(meq(i)) for i in ions if i in CATIONS]),
            "sum_an": row_sum(*[F.col(meq(i)) for i in ions if i in ANIONS]),
        }
    )


def add_mmol(df: DataFrame, ions: Iterable[str] = ALL_IONS) -> DataFrame:
    ions = _carried(df, ions)
    return df.withColumns({mmol(i): number(mgl(i)) / F.lit(IONS[i].molar_mass) for i in ions})


def add_alkalinity(df: DataFrame, factor: float = CACO3_EQUIVALENT_WEIGHT) -> DataFrame:
    """Carbonate alkalinity in mg/L as CaCO3; a single missing part counts as zero."""
    if meq("HCO3") not in df.columns:
        raise KeyError("HCO3_meq is needed; call add_meq first")
    parts = [F.col(meq(i)) for i in ("HCO3", "CO3") if meq(i) in df.columns]
    return df.withColumn("Alkalinity_mgCaCO3", row_sum(*parts) * F.lit(factor))


def equivalent_weight_table(spark: SparkSession, ew_table: str = DEFAULT_EW_TABLE) -> DataFrame:
    """The ion dimension (ten rows) with the weights in use."""
    weights = equivalent_weights(ew_table)
    return spark.createDataFrame(
        [
            (k, i.label, i.name_es, i.charge, i.molar_mass, weights[k], "cation" if i.charge > 0 else "anion")
            for k, i in IONS.items()
        ],
        "ion string, label string, name string, charge int, molar_mass double, equivalent_weight double, kind string",
    )
