"""Registered queries: units, balance, facies, irrigation, saturation."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, IONS, meq, mgl, mmol
from limnos.operators import balance, facies, irrigation, saturation, units
from limnos.plans import stages as S
from limnos.plans.registry import query, shown
from limnos.plans.stages import r, rs, sql

SEQ = "sample_seq"
MEQ = [meq(i) for i in ALL_IONS]
PCT = [f"pct_{g}" for g in ("Ca", "Mg", "Na", "HCO3", "SO4", "Cl")]


@query("chm_01_meq", sql(f"SELECT sample_seq, {rs(*MEQ)} FROM v9", "measured", more=[S._chem_sql("v9", "measured", "PiperStiff-v9")]))
def chm_01(spark, sf):
    return shown(units.add_meq(S.measured(spark, sf), ew_table="PiperStiff-v9", add_sums=False), SEQ, *MEQ)


@query("chm_02_ion_sums", sql(f"SELECT sample_seq, {rs('sum_cat', 'sum_an')} FROM chem", "chem"))
def chm_02(spark, sf):
    return shown(units.add_meq(S.measured(spark, sf)), SEQ, "sum_cat", "sum_an")


@query(
    "chm_03_mmol",
    sql("SELECT sample_seq, " + ", ".join(r(f"{mgl(i)} / {IONS[i].molar_mass!r}::DOUBLE", mmol(i)) for i in ALL_IONS) + " FROM measured", "measured"),
)
def chm_03(spark, sf):
    return shown(units.add_mmol(S.measured(spark, sf)), SEQ, *[mmol(i) for i in ALL_IONS])


@query("chm_04_charge_balance", sql(f"SELECT sample_seq, {rs('CBE_pct')} , {r('CBE_pct / 100', 'CBE_fraction')} FROM chem", "chem"))
def chm_04(spark, sf):
    df = S.chem(spark, sf).withColumn(
        "CBE_fraction", balance.charge_balance_error(F.col("sum_cat"), F.col("sum_an"), as_fraction=True)
    )
    return shown(df, SEQ, "CBE_pct", "CBE_fraction")


@query("chm_05_cbe_flag", sql("SELECT sample_seq, CBE_flag FROM chem", "chem"))
def chm_05(spark, sf):
    return shown(S.chem(spark, sf), SEQ, "CBE_flag")


@query("chm_06_alkalinity", sql(f"SELECT sample_seq, {rs('Alkalinity_mgCaCO3')} FROM chem", "chem"))
def chm_06(spark, sf):
    return shown(S.chem(spark, sf), SEQ, "Alkalinity_mgCaCO3")


@query("chm_07_group_percentages", sql(f"SELECT sample_seq, {rs(*PCT)} FROM fac", "fac"))
def chm_07(spark, sf):
    return shown(facies.add_percentages(S.chem(spark, sf)), SEQ, *PCT)


@query("chm_08_dominant_facies", sql("SELECT sample_seq, facies, facies_label FROM fac", "fac"))
def chm_08(spark, sf):
    return shown(facies.add_facies(S.chem(spark, sf), "dominant"), SEQ, "facies", "facies_label")


@query("chm_09_facies_label", sql("SELECT facies, facies_label AS label, count(*) AS n FROM fac GROUP BY ALL", "fac"))
def chm_09(spark, sf):
    counts = S.fac(spark, sf).groupBy("facies").agg(F.count("*").alias("n"))
    return shown(counts.withColumn("label", facies.facies_label(F.col("facies"))), "facies", "label", "n")


_ZONE = (
    "CASE WHEN coalesce(pct_Ca, pct_Mg) IS NULL OR coalesce(pct_HCO3, pct_SO4, pct_Cl) IS NULL THEN 'sin_datos' "
    "WHEN pct_Na > 50 AND pct_HCO3 > 50 THEN 'z8_alcalina_carbonatada' "
    "WHEN pct_Na > 50 AND coalesce(pct_SO4, 0) + coalesce(pct_Cl, 0) > 50 THEN 'z7_alcalina_no_carbonatada' "
    "WHEN coalesce(pct_Ca, 0) + coalesce(pct_Mg, 0) > 50 AND coalesce(pct_SO4, 0) + coalesce(pct_Cl, 0) > 50 THEN 'z6_dura_no_carbonatada' "
    "WHEN coalesce(pct_Ca, 0) + coalesce(pct_Mg, 0) > 50 AND pct_HCO3 > 50 THEN 'z5_dura_carbonatada' ELSE 'z9_mixta' END"
)


@query("chm_10_piper_zone", sql(f"SELECT sample_seq, {_ZONE} AS facies FROM fac", "fac"))
def chm_10(spark, sf):
    return shown(facies.add_facies(S.chem(spark, sf), "piper_zone"), SEQ, "facies")


@query(
    "chm_11_facies_schemes",
    sql(f"SELECT facies, ({_ZONE}) AS zone, count(*) AS n FROM fac GROUP BY ALL", "fac"),
)
def chm_11(spark, sf):
    both = facies.add_facies(S.chem(spark, sf), "dominant").withColumnRenamed("facies", "dominant")
    both = facies.classify_piper_zone(both.drop("facies_label")).select(
        F.col("dominant").alias("facies"), F.col("facies").alias("zone")
    )
    return shown(both.groupBy("facies", "zone").agg(F.count("*").alias("n")))


def _irrigation(name, *cols):
    doubles = [c for c in cols if not c.endswith("_class")]
    classes = [c for c in cols if c.endswith("_class")]
    body = ", ".join(["sample_seq", *[r(c) for c in doubles], *classes])

    @query(name, sql(f"SELECT {body} FROM irr", "irr"))
    def run(spark, sf):
        return shown(S.irr(spark, sf), SEQ, *cols)

    return run


_irrigation("chm_12_sar", "SAR")
_irrigation("chm_13_sar_class", "SAR_class")
_irrigation("chm_14_rsc", "RSC")
_irrigation("chm_15_rsc_class", "RSC_class")
_irrigation("chm_16_sodium_pct", "Na_pct")
_irrigation("chm_17_kelley_ratio", "Kelley_ratio")
_irrigation("chm_18_magnesium_ratio", "Magnesium_ratio")
_irrigation("chm_19_wilcox", "Na_pct", "Wilcox_class")
_irrigation(
    "chm_20_irrigation_indices",
    "SAR", "SAR_class", "RSC", "RSC_class", "Na_pct", "Kelley_ratio", "Magnesium_ratio", "Wilcox_class",
)


@query("chm_21_ionic_strength", sql(f"SELECT sample_seq, {r('ionic_strength', digits=9)} FROM sat", "sat"))
def chm_21(spark, sf):
    return shown(saturation.add_ionic_strength(S.measured(spark, sf)), SEQ, "ionic_strength", digits=9)


@query("chm_22_davies_gamma", sql(f"SELECT sample_seq, {r('g1', 'gamma_1')}, {r('g2', 'gamma_2')} FROM sat", "sat"))
def chm_22(spark, sf):
    df = saturation.add_ionic_strength(S.measured(spark, sf))
    strength = F.col("ionic_strength")
    gammas = {f"gamma_{z}": saturation.davies_gamma(z, strength) for z in (1, 2)}
    return shown(df.withColumns(gammas), SEQ, *gammas)


@query("chm_23_carbonate_activity", sql(f"SELECT sample_seq, {r('a_CO3 * 1e6', 'co3_activity_micro')} FROM sat", "sat"))
def chm_23(spark, sf):
    df = saturation.add_activities(S.measured(spark, sf))
    return shown(df.withColumn("co3_activity_micro", F.col("__a_CO3") * 1e6), SEQ, "co3_activity_micro")


SI = ["SI_Calcite", "SI_Gypsum", "SI_Fluorite", "SI_Halite"]


@query("chm_24_saturation_indices", sql(f"SELECT sample_seq, {rs(*SI)} FROM sat", "sat"))
def chm_24(spark, sf):
    return shown(S.sat(spark, sf), SEQ, *SI)


@query("agg_01_balance_counts", sql(
    "SELECT f.flag AS CBE_flag, count(c.sample_seq) AS n FROM (VALUES ('acceptable'), ('marginal'), ('rejected'), ('unknown')) f(flag) "
    "LEFT JOIN chem c ON c.CBE_flag = f.flag GROUP BY f.flag", "chem"))
def agg_01(spark, sf):
    return shown(balance.balance_counts(S.chem(spark, sf)))


@query("agg_02_facies_counts", sql(
    f"SELECT facies, count(*) AS n, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 'pct')} FROM fac GROUP BY facies ORDER BY n DESC, facies", "fac"))
def agg_02(spark, sf):
    return shown(facies.facies_counts(S.fac(spark, sf)))


@query("water_types_by_group", sql(
    'SELECT "group", facies, count(*) AS n, count(*) FILTER (WHERE CBE_flag = \'acceptable\') AS n_acceptable FROM fac GROUP BY ALL', "fac"))
def water_types_by_group(spark, sf):
    """Share of water types and balance quality per group (the flagship query)."""
    df = S.fac(spark, sf)
    return shown(
        df.groupBy("group", "facies").agg(
            F.count("*").alias("n"), F.count_if(F.col("CBE_flag") == "acceptable").alias("n_acceptable")
        )
    )
