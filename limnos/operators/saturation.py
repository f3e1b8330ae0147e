"""Ionic strength, Davies activities and mineral saturation indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, CARBONATE_PK2, DAVIES_A, IONS, LOG_KSP, mgl
from limnos.functions.expr import col_or_null, positive, present


def ionic_strength(df: DataFrame) -> Column:
    """Half the sum of m·z² over the ions with a positive amount; 0 when there is none."""
    terms = []
    for i in ALL_IONS:
        if mgl(i) not in df.columns:
            continue
        amount = F.col(mgl(i)).cast("double")
        molar = amount / 1000.0 / IONS[i].molar_mass
        terms.append(F.when(amount > 0, 0.5 * molar * float(IONS[i].charge ** 2)).otherwise(0.0))
    return sum(terms, F.lit(0.0))


def davies_gamma(charge: int, strength: Column) -> Column:
    root = F.sqrt(strength)
    exponent = F.lit(-DAVIES_A * charge * charge) * (root / (1.0 + root) - 0.3 * strength)
    return F.when(strength > 0, F.pow(F.lit(10.0), exponent)).otherwise(1.0)


def add_ionic_strength(df: DataFrame) -> DataFrame:
    return df.withColumn("ionic_strength", ionic_strength(df))


def carbonate_activity(df: DataFrame, gamma1: Column, gamma2: Column) -> Column:
    """Measured carbonate when positive, else from bicarbonate and pH, else 0."""
    co3 = col_or_null(df, "CO3_mgL") / 1000.0 / IONS["CO3"].molar_mass
    hco3 = col_or_null(df, "HCO3_mgL") / 1000.0 / IONS["HCO3"].molar_mass
    ph = col_or_null(df, "ph")
    from_ph = F.pow(
        F.lit(10.0), F.log10(F.greatest(hco3 * gamma1, F.lit(1e-12))) + ph - F.lit(CARBONATE_PK2)
    )
    return F.when(co3 > 0, co3 * gamma2).when((hco3 > 0) & (ph > 0), from_ph).otherwise(0.0)


def add_activities(df: DataFrame) -> DataFrame:
    """Temporary activity columns ``__a_*`` (NULL where the ion is absent), on top of ionic strength."""
    if "ionic_strength" not in df.columns:
        df = add_ionic_strength(df)
    df = df.withColumns(
        {"__g1": davies_gamma(1, F.col("ionic_strength")), "__g2": davies_gamma(2, F.col("ionic_strength"))}
    )
    g1, g2 = F.col("__g1"), F.col("__g2")

    def activity(ion: str) -> Column:
        gamma = g2 if abs(IONS[ion].charge) == 2 else g1
        return col_or_null(df, mgl(ion)) / 1000.0 / IONS[ion].molar_mass * gamma

    acts = {f"__a_{i}": activity(i) for i in ("Ca", "SO4", "Na", "Cl", "F")}
    acts["__a_CO3"] = carbonate_activity(df, g1, g2)
    return df.withColumns(acts)


def add_saturation(df: DataFrame) -> DataFrame:
    """``SI_<mineral>`` = log10(IAP) − log10(Ksp); NULL when an activity is not positive or I is 0."""
    df = add_activities(df)

    def index(mineral: str, product: Column) -> Column:
        return F.log10(product) - F.lit(LOG_KSP[mineral])

    ca, co3, so4, na, cl, f = (positive(F.col(f"__a_{i}")) for i in ("Ca", "CO3", "SO4", "Na", "Cl", "F"))
    some = F.col("ionic_strength") > 0
    df = df.withColumns(
        {
            "SI_Calcite": F.when(some, index("Calcite", ca * co3)),
            "SI_Gypsum": F.when(some, index("Gypsum", ca * so4)),
            "SI_Fluorite": F.when(some, index("Fluorite", ca * (f * f))),
            "SI_Halite": F.when(some, index("Halite", na * cl)),
        }
    )
    return df.drop(*present(df, *[c for c in df.columns if c.startswith(("__a_", "__g"))]))
