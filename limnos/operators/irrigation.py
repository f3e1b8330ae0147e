"""Irrigation suitability indices (meq/L in, classes out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.expr import null, col_or_null

_TINY = 1e-9


def _both(value: Column, *needed: Column) -> Column:
    """``value`` only when every needed input is present (``greatest`` skips nulls)."""
    ok = F.lit(True)
    for c in needed:
        ok = ok & c.isNotNull()
    return F.when(ok, value)


def sodium_adsorption_ratio(na: Column, ca: Column, mg: Column) -> Column:
    return _both(na / F.sqrt(F.greatest((ca + mg) / 2.0, F.lit(_TINY))), na, ca, mg)


def sar_class(sar: Column) -> Column:
    return (
        F.when(sar.isNull(), "Desconocido")
        .when(sar < 10, "S1")
        .when(sar < 18, "S2")
        .when(sar < 26, "S3")
        .otherwise("S4")
    )


def residual_sodium_carbonate(hco3: Column, co3: Column, ca: Column, mg: Column) -> Column:
    return (hco3 + F.coalesce(co3, F.lit(0.0))) - (ca + mg)


def rsc_class(rsc: Column) -> Column:
    return (
        F.when(rsc.isNull(), "Desconocido")
        .when(rsc < 1.25, "Seguro")
        .when(rsc <= 2.5, "Marginal")
        .otherwise("Inadecuado")
    )


def sodium_percentage(na: Column, k: Column, ca: Column, mg: Column) -> Column:
    k = F.coalesce(k, F.lit(0.0))
    total = ca + mg + na + k
    return F.when(total > 0, (na + k) / F.greatest(total, F.lit(_TINY)) * 100.0)


def kelley_ratio(na: Column, ca: Column, mg: Column) -> Column:
    return _both(na / F.greatest(ca + mg, F.lit(_TINY)), na, ca, mg)


def magnesium_ratio(mg: Column, ca: Column) -> Column:
    return _both(mg / F.greatest(ca + mg, F.lit(_TINY)) * 100.0, mg, ca)


def wilcox_category(na_pct: Column, ec_or_tds: Column) -> Column:
    """Wilcox category; a value between 50 and 10000 is taken for TDS and turned into EC."""
    ec = F.when((ec_or_tds > 10000) | (ec_or_tds < 50), ec_or_tds).otherwise(ec_or_tds / 0.64)
    return (
        F.when(na_pct.isNull() | ec_or_tds.isNull(), "Desconocido")
        .when((na_pct < 20) & (ec < 250), "Excelente a Buena")
        .when((na_pct < 40) & (ec < 750), "Buena a Permisible")
        .when((na_pct < 60) & (ec < 2000), "Permisible a Dudosa")
        .when((na_pct < 80) & (ec < 3000), "Dudosa a Inadecuada")
        .otherwise("Inadecuada para riego")
    )


def add_irrigation(df: DataFrame) -> DataFrame:
    """All indices and classes; a frame without Na, Ca or Mg in meq/L is returned unchanged."""
    if not {"Na_meq", "Ca_meq", "Mg_meq"} <= set(df.columns):
        return df
    na, ca, mg = F.col("Na_meq"), F.col("Ca_meq"), F.col("Mg_meq")
    k, hco3, co3 = (col_or_null(df, c) for c in ("K_meq", "HCO3_meq", "CO3_meq"))
    df = df.withColumns(
        {
            "SAR": sodium_adsorption_ratio(na, ca, mg),
            "RSC": residual_sodium_carbonate(hco3, co3, ca, mg),
            "Na_pct": sodium_percentage(na, k, ca, mg),
            "Kelley_ratio": kelley_ratio(na, ca, mg),
            "Magnesium_ratio": magnesium_ratio(mg, ca),
        }
    )
    tds = col_or_null(df, "tds_mgl") if "tds_mgl" in df.columns else null()
    return df.withColumns(
        {
            "SAR_class": sar_class(F.col("SAR")),
            "RSC_class": rsc_class(F.col("RSC")),
            "Wilcox_class": wilcox_category(F.col("Na_pct"), tds),
        }
    )
