"""Registered queries: cells, limits, filters, imputation, issues, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, PLAUSIBLE_RANGES, mgl
from limnos.functions import cells
from limnos.operators import balance, distributions, imputation, standards, validation
from limnos.plans import stages as S
from limnos.plans.registry import query, shown
from limnos.plans.stages import breach, r, rs, sql

SEQ = "sample_seq"
IONS = [mgl(i) for i in ALL_IONS]
MEASURED = IONS + ["ph", "temp_c", "tds_mgl"]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# --- cells ---------------------------------------------------------------------


def _cell_check(c: str) -> str:
    return (
        f"SELECT sample_seq, {r(f'v_{c}', 'value')}, {r(f'{c}__detection_limit', 'detection_limit')}, "
        f"q_{c} AS qualifier, a_{c} AS analysed FROM cells"
    )


@query("scl_01_parse_cell", sql(_cell_check("F_mgL"), "measured"))
def scl_01(spark, sf):
    df = cells.parse_column(S.raw(spark, sf), "F_mgL", "cell")
    return shown(df.select(SEQ, *[F.col("cell")[p].alias(p) for p in cells.PARTS]))


@query("scl_02_decimal_text", sql(
    f"SELECT sample_seq, {r('v_F_mgL', 'f')}, {r('v_NO3_mgL', 'no3')} FROM cells", "measured"))
def scl_02(spark, sf):
    df = S.raw(spark, sf)
    plain = r"^[0-9.,]+$"
    out = {
        k: F.when(cells.stripped(F.col(c)).rlike(plain), cells.decimal_text_to_double(cells.stripped(F.col(c))))
        for k, c in (("f", "F_mgL"), ("no3", "NO3_mgL"))
    }
    return shown(df.withColumns(out), SEQ, "f", "no3")


@query("scl_03_measured_columns", sql(
    f"SELECT sample_seq, {rs(*MEASURED, 'F_mgL__detection_limit', 'NO3_mgL__detection_limit')} FROM measured", "measured"))
def scl_03(spark, sf):
    return shown(S.measured(spark, sf), SEQ, *MEASURED, "F_mgL__detection_limit", "NO3_mgL__detection_limit")


@query("scl_04_numeric_like", sql(
    "SELECT sample_seq, coalesce(regexp_matches(trim(F_mgL), '^[<>]?[0-9.,]+$'), false) AS is_measure FROM samples", "samples"))
def scl_04(spark, sf):
    from limnos.sources.headers import looks_numeric

    return shown(S.raw(spark, sf).withColumn("is_measure", looks_numeric(F.col("F_mgL"))), SEQ, "is_measure")


@query("scl_09_missing_cleaned", sql(
    f"SELECT {', '.join(f'count({c}) AS {c}' for c in MEASURED)} FROM measured", "measured"))
def scl_09(spark, sf):
    from limnos.functions.expr import number

    return shown(S.measured(spark, sf).agg(*[F.count(number(c)).alias(c) for c in MEASURED]))


@query("scl_10_range_text", sql(
    "SELECT parameter, range_text, count(s.sample_seq) AS n FROM (VALUES ('F_mgL', '≤ 1.5 mg/L'), ('NO3_mgL', '≤ 50 mg/L'), ('Cl_mgL', '≤ 250 mg/L'), "
    "('SO4_mgL', '≤ 250 mg/L'), ('Na_mgL', '≤ 200 mg/L'), ('tds_mgl', '≤ 1000 mg/L'), ('ph', '6.5 – 8.5 u. de pH')) v(parameter, range_text) "
    "CROSS JOIN samples s GROUP BY ALL", "samples"))
def scl_10(spark, sf):
    limits = standards.limits_table(spark, ["who_drinking"])
    n = S.raw(spark, sf).select(F.count("*")).scalar()
    text = standards.range_text(F.col("minimum"), F.col("maximum"), F.col("unit"))
    return shown(limits.select("parameter", text.alias("range_text"), n.alias("n")))


_LABELS = {"Ca_mgL": "Ca²⁺", "Mg_mgL": "Mg²⁺", "Na_mgL": "Na⁺", "K_mgL": "K⁺", "HCO3_mgL": "HCO₃⁻", "CO3_mgL": "CO₃²⁻",
           "SO4_mgL": "SO₄²⁻", "Cl_mgL": "Cl⁻", "F_mgL": "F⁻", "NO3_mgL": "NO₃⁻"}
_HALF = [
    "half AS (SELECT * REPLACE (coalesce(F_mgL, F_mgL__detection_limit / 2) AS F_mgL, coalesce(NO3_mgL, NO3_mgL__detection_limit / 2) AS NO3_mgL), "
    "F_mgL IS NULL AND F_mgL__detection_limit IS NOT NULL AS f_imp, NO3_mgL IS NULL AND NO3_mgL__detection_limit IS NOT NULL AS n_imp FROM measured)"
]


@query("scl_12_estimated_ions", sql(
    "SELECT sample_seq, CASE WHEN f_imp AND n_imp THEN 'F⁻, NO₃⁻' WHEN f_imp THEN 'F⁻' WHEN n_imp THEN 'NO₃⁻' ELSE '' END AS estimated FROM half",
    "measured", more=_HALF))
def scl_12(spark, sf):
    from limnos.sinks.cards import estimated_ions

    df = imputation.impute(S.measured(spark, sf), method="half_detection_limit")
    return shown(df.withColumn("estimated", estimated_ions(df)), SEQ, "estimated")


@query("scl_13_math_functions", sql(
    f"SELECT sample_seq, {r('sqrt(Ca_mgL)', 'root')}, {r('log10(Na_mgL)', 'log')}, {r('pow(K_mgL, 1.5)', 'power')}, "
    f"{r('sin(radians(temp_c)) + cos(radians(temp_c)) + tan(radians(temp_c))', 'trig')}, {r('floor(abs(Cl_mgL))', 'whole')} FROM measured", "measured"))
def scl_13(spark, sf):
    a = F.radians("temp_c")
    return shown(
        S.measured(spark, sf).select(
            SEQ, F.sqrt("Ca_mgL").alias("root"), F.log10("Na_mgL").alias("log"), F.pow("K_mgL", F.lit(1.5)).alias("power"),
            (F.sin(a) + F.cos(a) + F.tan(a)).alias("trig"), F.floor(F.abs("Cl_mgL")).cast("double").alias("whole"),
        )
    )


@query("agg_07_censoring_summary", sql(union(
    [f"SELECT '{c}' AS \"column\", count({c}__detection_limit) AS n_censored, count(*) FILTER (WHERE q_{c} = 'nd') AS n_not_detected, "
     f"count(*) FILTER (WHERE NOT a_{c}) AS n_not_analysed, count(v_{c}) AS n_numeric FROM cells" for c in ("F_mgL", "NO3_mgL")]
    + [f"SELECT '{c}', 0, 0, count(*) - count({c}), count({c}) FROM measured" for c in MEASURED if c not in ("F_mgL", "NO3_mgL")]), "measured"))
def agg_07(spark, sf):
    return shown(cells.censoring_summary(S.raw(spark, sf)))


# --- filters -------------------------------------------------------------------


@query("flt_01_limit_predicate", sql(
    "SELECT " + ", ".join(f'count(*) FILTER (WHERE {breach(p, lo, hi)}) AS "{p}"' for p, _, lo, hi in S.WHO) + " FROM measured", "measured"))
def flt_01(spark, sf):
    limits = standards.get_standard("who_drinking").limits
    df = S.measured(spark, sf)
    return shown(df.agg(*[F.count_if(x.exceeds(F.col(x.parameter))).alias(x.parameter) for x in limits]))


@query("flt_02_exceeding_rows", sql(f"SELECT sample_seq, {r('Cl_mgL')} FROM measured WHERE Cl_mgL > 250", "measured"))
def flt_02(spark, sf):
    return shown(standards.exceeding_rows(S.measured(spark, sf), "Cl_mgL"), SEQ, "Cl_mgL")


@query("flt_04_zeros_as_missing", sql(
    f"SELECT sample_seq, {r('CASE WHEN F_mgL > 0 THEN F_mgL END', 'F_mgL')}, {r('CASE WHEN CO3_mgL > 0 THEN CO3_mgL END', 'CO3_mgL')} FROM measured", "measured"))
def flt_04(spark, sf):
    return shown(imputation.zeros_as_missing(S.measured(spark, sf), ["F_mgL", "CO3_mgL"]), SEQ, "F_mgL", "CO3_mgL")


@query("flt_06_reliability", sql("SELECT sample_seq, reliable FROM chem", "chem"))
def flt_06(spark, sf):
    df = S.measured(spark, sf)
    return shown(df.withColumn("reliable", balance.reliability(df)), SEQ, "reliable")


@query("flt_07_selection", sql(
    "SELECT facies, count(*) AS n FROM fac WHERE sample_seq IN (SELECT sample_seq FROM measured WHERE Cl_mgL > 250) GROUP BY facies", "fac"))
def flt_07(spark, sf):
    from limnos.operators.selection import select_samples

    chosen = standards.exceeding_rows(S.measured(spark, sf), "Cl_mgL").select(SEQ)
    return shown(select_samples(S.fac(spark, sf), chosen).groupBy("facies").agg(F.count("*").alias("n")))


@query("flt_08_exceedance_drilldown", sql(
    f"SELECT sample_seq, station_code, facies_label, {r('ph')}, CASE WHEN ph < 6.5 THEN 'below' ELSE 'above' END AS breach "
    "FROM fac WHERE ph < 6.5 OR ph > 8.5 ORDER BY ph DESC, sample_seq", "fac"))
def flt_08(spark, sf):
    return shown(standards.exceedance_drilldown(S.fac(spark, sf), "ph"), SEQ, "station_code", "facies_label", "ph", "breach")


_CLASS = "CASE WHEN n_evaluated = 0 THEN 'unknown' WHEN exceeds_health THEN 'health' WHEN n_exceedances > 0 THEN 'aesthetic' ELSE 'ok' END"


@query("flt_09_compliance_class", sql(f"SELECT sample_seq, {_CLASS} AS class FROM comp", "comp"))
def flt_09(spark, sf):
    return shown(S.comp(spark, sf).withColumn("class", standards.compliance_class()), SEQ, "class")


_LEVEL = "CASE WHEN F_mgL IS NULL THEN 'unmeasured' WHEN F_mgL > 1.5 THEN 'above' WHEN F_mgL > 1.5::DOUBLE * 0.66::DOUBLE THEN 'near' ELSE 'below' END"


@query("flt_10_fluoride_level", sql(f"SELECT sample_seq, {_LEVEL} AS level FROM measured", "measured"))
def flt_10(spark, sf):
    return shown(S.measured(spark, sf).withColumn("level", standards.fluoride_level()), SEQ, "level")


# --- limits --------------------------------------------------------------------


def _compliance_check(denominator: str, where: str = "", source: str = "measured") -> str:
    return union(
        f"SELECT '{p}' AS parameter, '{kind}' AS kind, count(*) AS n_total, count({p}) AS n_measured, count(*) - count({p}) AS n_missing, "
        f"count(*) FILTER (WHERE {breach(p, lo, hi)}) AS n_exceeding, "
        f"{r(f'100.0::DOUBLE * count(*) FILTER (WHERE {breach(p, lo, hi)}) / {denominator.format(p=p)}', 'pct')}, "
        f"{r(f'min({p})', 'min_observed')}, {r(f'max({p})', 'max_observed')} FROM {source}{where}"
        for p, kind, lo, hi in S.WHO
    )


_COMPLIANCE = ["parameter", "kind", "n_total", "n_measured", "n_missing", "n_exceeding", "pct", "min_observed", "max_observed"]


@query("agg_03_compliance", sql(_compliance_check("count({p})"), "measured"))
def agg_03(spark, sf):
    return shown(standards.compliance(S.measured(spark, sf)), *_COMPLIANCE)


@query("agg_03_compliance_over_all", sql(_compliance_check("count(*)"), "measured"))
def agg_03_all(spark, sf):
    return shown(standards.compliance(S.measured(spark, sf), measured_only=False), *_COMPLIANCE)


_FLAGS = [f"{p}__exceeds" for p, *_ in S.WHO]


@query("agg_04_sample_compliance", sql(
    "SELECT sample_seq, " + ", ".join(f'"{c}"' for c in _FLAGS) + ", n_evaluated, n_exceedances, exceeds_health FROM comp", "comp"))
def agg_04(spark, sf):
    return shown(S.comp(spark, sf), SEQ, *_FLAGS, "n_evaluated", "n_exceedances", "exceeds_health")


_PERU = [(p, "aesthetic" if p == "ph" else k, lo, 1.0 if p == "F_mgL" else hi) for p, k, lo, hi in S.WHO]


@query("agg_05_other_standard", sql(
    "SELECT sample_seq, n_evaluated, n_exceedances, exceeds_health FROM peru", "fac", more=[S._comp_sql(_PERU, "peru", "fac")]))
def agg_05(spark, sf):
    again = standards.add_compliance(S.comp(spark, sf), "peru_drinking")
    return shown(again, SEQ, "n_evaluated", "n_exceedances", "exceeds_health")


@query("agg_22_limits_chart", sql(
    f"SELECT parameter, n_measured, n_exceeding, pct FROM ({_compliance_check('count({p})')}) WHERE n_measured > 0 ORDER BY pct, parameter", "measured"))
def agg_22(spark, sf):
    return shown(standards.limits_chart(S.measured(spark, sf)), "parameter", "n_measured", "n_exceeding", "pct")


@query("agg_21_legend_counts", sql(union([
    f"SELECT 'compliance' AS legend, c AS class, count(sample_seq) AS n FROM (VALUES ('unknown'), ('ok'), ('aesthetic'), ('health')) v(c) "
    f"LEFT JOIN (SELECT sample_seq, {_CLASS} AS k FROM comp) ON k = c GROUP BY c",
    f"SELECT 'fluoride', c, count(sample_seq) FROM (VALUES ('above'), ('near'), ('below'), ('unmeasured')) v(c) "
    f"LEFT JOIN (SELECT sample_seq, {_LEVEL} AS k FROM comp) ON k = c GROUP BY c"]), "comp"))
def agg_21(spark, sf):
    df = S.comp(spark, sf)
    a = standards.class_counts(df, standards.compliance_class(), standards.COMPLIANCE_CLASSES)
    b = standards.class_counts(df, standards.fluoride_level(), standards.FLUORIDE_LEVELS)
    both = a.withColumn("legend", F.lit("compliance")).unionByName(b.withColumn("legend", F.lit("fluoride")))
    return shown(both, "legend", "class", "n")


@query("jon_04_parameter_limit", sql(
    "SELECT m.sample_seq, m.parameter, " + r("m.value", "value") + ", coalesce(m.value > v.hi OR m.value < v.lo, false) AS exceeds FROM ("
    + union(f"SELECT sample_seq, '{p}' AS parameter, {p} AS value FROM measured" for p, *_ in S.WHO) + ") m JOIN (VALUES "
    + ", ".join(f"('{p}', CAST({lo if lo is not None else 'NULL'} AS DOUBLE), CAST({hi} AS DOUBLE))" for p, _, lo, hi in S.WHO)
    + ") v(parameter, lo, hi) USING (parameter) WHERE m.value IS NOT NULL", "measured"))
def jon_04(spark, sf):
    from limnos.operators.selection import long_against_limits

    limits = standards.limits_table(spark, ["who_drinking"])
    out = long_against_limits(S.measured(spark, sf), limits)
    return shown(out, SEQ, "parameter", "value", "exceeds")


# --- imputation ----------------------------------------------------------------


@query("agg_08_exact_zeros", sql(
    'SELECT * FROM (' + union(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 0) AS n_zeros FROM measured" for c in IONS) + ") WHERE n_zeros > 0", "measured"))
def agg_08(spark, sf):
    return shown(imputation.zero_counts(S.measured(spark, sf)))


_GROUPED = [mgl(i) for i in ALL_IONS]


@query("agg_09_group_medians", sql(union(
    f"SELECT \"group\", '{c}' AS \"column\", count({c}) AS n, {r(f'median({c})', 'median')} FROM measured GROUP BY \"group\"" for c in _GROUPED), "measured"))
def agg_09(spark, sf):
    return shown(imputation.group_medians(S.measured(spark, sf), _GROUPED), "group", "column", "n", "median")


_MED = [
    'gm AS (SELECT "group" AS g, ' + ", ".join(f"CASE WHEN count({c}) >= 3 THEN median({c}) END AS m_{c}" for c in _GROUPED) + ' FROM measured GROUP BY "group")',
    "filled AS (SELECT measured.* REPLACE (" + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in _GROUPED) + "), "
    + ", ".join(f'{c} IS NULL AND m_{c} IS NOT NULL AS "{c}__imputed"' for c in _GROUPED) + ' FROM measured LEFT JOIN gm ON measured."group" = g)',
]
_IMPUTED = [f"{c}__imputed" for c in _GROUPED]


@query("imp_01_group_median", sql(
    f"SELECT sample_seq, {rs(*_GROUPED)}, " + ", ".join(f'"{c}"' for c in _IMPUTED) + " FROM filled", "measured", more=_MED))
def imp_01(spark, sf):
    return shown(imputation.impute(S.measured(spark, sf), method="group_median"), SEQ, *_GROUPED, *_IMPUTED)


@query("imp_02_global_median", sql(
    "SELECT sample_seq, " + ", ".join(r(f"coalesce({c}, (SELECT median({c}) FROM measured))", c) for c in _GROUPED) + " FROM measured", "measured"))
def imp_02(spark, sf):
    return shown(imputation.impute(S.measured(spark, sf), method="global_median"), SEQ, *_GROUPED)


@query("imp_03_half_detection_limit", sql(
    f'SELECT sample_seq, {rs("F_mgL", "NO3_mgL")}, f_imp AS "F_mgL__imputed", n_imp AS "NO3_mgL__imputed" FROM half', "measured", more=_HALF))
def imp_03(spark, sf):
    df = imputation.impute(S.measured(spark, sf), method="half_detection_limit")
    return shown(df, SEQ, "F_mgL", "NO3_mgL", "F_mgL__imputed", "NO3_mgL__imputed")


@query("imp_08_provenance_log", sql(union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL OR \"{c}__imputed\") AS n_missing_before, "
    f"count(*) FILTER (WHERE \"{c}__imputed\") AS n_imputed, count(*) FILTER (WHERE {c} IS NULL) AS n_missing_after, 'group_median' AS method FROM filled"
    for c in _GROUPED), "measured", more=_MED))
def imp_08(spark, sf):
    df = imputation.impute(S.measured(spark, sf), _GROUPED, "group_median")
    log = imputation.imputation_log(df, _GROUPED, "group_median")
    return shown(log, "column", "n_missing_before", "n_imputed", "n_missing_after", "method")


@query("jon_02_group_lookup", sql(
    f'SELECT sample_seq, "group", {r("m_K_mgL", "group_median")} FROM measured LEFT JOIN gm ON "group" = g', "measured", more=_MED[:1]))
def jon_02(spark, sf):
    df = S.measured(spark, sf)
    med = imputation.group_medians(df, ["K_mgL"]).select("group", F.when(F.col("n") >= 3, F.col("median")).alias("group_median"))
    return shown(df.select(SEQ, "group").join(med, "group", "left"), SEQ, "group", "group_median")


# --- issues --------------------------------------------------------------------

_ISSUE = ["severity", "code", "field", "n_rows"]


def _issue(severity: str, code: str, field: str | None, n: str, when: str, source: str = "measured") -> str:
    f = f"'{field}'" if field else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{severity}' AS severity, '{code}' AS code, {f} AS field, CAST({n} AS BIGINT) AS n_rows FROM {source} HAVING {when}"


def _rule(name: str, family: list[str], checks: list[str]):
    @query(name, sql(union(checks), "measured"))
    def run(spark, sf):
        return shown(validation.validate(S.measured(spark, sf), family), *_ISSUE)

    return run


_rule("val_02_identity", ["identity"], [
    _issue("error", "estacion_vacia", "station_code", "count(*) FILTER (WHERE coalesce(trim(station_code), '') IN ('', 'nan', 'None'))",
           "count(*) FILTER (WHERE coalesce(trim(station_code), '') IN ('', 'nan', 'None')) > 0"),
    _issue("error", "sin_datos", None, "0", "count(*) = 0"),
])
_rule("val_04_ions_present", ["ions"], [
    _issue("warning", "columna_sin_medidas", c, "0", f"count({c}) = 0") for c in IONS
])
_RANGES = []
for _c, (_lo, _hi) in PLAUSIBLE_RANGES.items():
    if _c in MEASURED:
        for sev, code, test in (("warning", "fuera_de_rango", f"{_c} < {_lo} OR {_c} > {_hi}"), ("error", "valor_negativo", f"{_c} < 0")):
            _RANGES.append(_issue(sev, code, _c, f"count(*) FILTER (WHERE {test})", f"count(*) FILTER (WHERE {test}) > 0"))
_rule("val_05_ranges", ["ranges"], _RANGES)
_rule("val_06_suspicious_zeros", ["zeros"], [
    _issue("warning", "ceros_sospechosos", c, f"count(*) FILTER (WHERE {c} = 0)", f"count(*) FILTER (WHERE {c} = 0) >= 0.1 * count(*)")
    for c in IONS if c != "CO3_mgL"
])
_rule("val_07_coordinates", ["positions"], [
    _issue("warning", "coordenada_incompleta", "longitude", "count(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL)",
           "count(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL) > 0"),
    _issue("info", "coordenadas_proyectadas", None, "0", "max(abs(latitude)) > 90 OR max(abs(longitude)) > 180"),
])
_rule("val_08_dates", ["dates"], [
    _issue("info", "sin_fecha", None, "0", "count(sampled_at) = 0"),
    _issue("warning", "fecha_ilegible", "sampled_at", "count(*) - count(sampled_at)", "count(sampled_at) > 0 AND count(*) > count(sampled_at)"),
    _issue("info", "campanas_detectadas", "sampled_at", "0", "count(sampled_at) > 0"),
])


@query("val_01_empty_table", sql(
    "SELECT 'error' AS severity, 'sin_datos' AS code, CAST(NULL AS VARCHAR) AS field, CAST(0 AS BIGINT) AS n_rows FROM measured WHERE Ca_mgL < 0 HAVING count(*) = 0",
    "measured"))
def val_01(spark, sf):
    return shown(validation.validate(S.measured(spark, sf).filter("Ca_mgL < 0")), *_ISSUE)


@query("val_03_duplicate_stations", sql(
    "SELECT 'warning' AS severity, 'estacion_duplicada' AS code, 'station_code' AS field, CAST(sum(n) AS BIGINT) AS n_rows FROM "
    "(SELECT station_code, count(*) AS n FROM measured GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0", "measured"))
def val_03(spark, sf):
    return shown(validation.duplicate_station_issue(S.measured(spark, sf).drop("sampled_at")), *_ISSUE)


@query("val_09_rows_read", sql(
    "SELECT 'info' AS severity, 'filas_leidas' AS code, CAST(NULL AS VARCHAR) AS field, count(*) AS n_rows FROM samples", "samples"))
def val_09(spark, sf):
    return shown(validation.rows_read(S.raw(spark, sf)), *_ISSUE)


@query("val_10_balance_issues", sql(union([
    _issue("warning", "balance_rechazado", "CBE_pct", "count(*) FILTER (WHERE CBE_flag = 'rejected')", "count(*) FILTER (WHERE CBE_flag = 'rejected') > 0", "chem"),
    _issue("info", "balance_marginal", "CBE_pct", "count(*) FILTER (WHERE CBE_flag = 'marginal')", "count(*) FILTER (WHERE CBE_flag = 'marginal') > 0", "chem"),
]), "chem"))
def val_10(spark, sf):
    return shown(validation.balance_issues(S.chem(spark, sf)), *_ISSUE)


@query("val_11_compliance_issues", sql(union([
    _issue("warning" if k == "health" else "info", "excede_umbral", p, f"count(*) FILTER (WHERE {breach(p, lo, hi)})",
           f"count(*) FILTER (WHERE {breach(p, lo, hi)}) > 0")
    for p, k, lo, hi in [(p, k, lo, 1.0 if p == "F_mgL" else hi) for p, k, lo, hi in S.WHO]
] + ["SELECT 'warning', 'estandar_sin_cotejar', NULL, 0"]), "measured"))
def val_11(spark, sf):
    return shown(validation.compliance_issues(S.measured(spark, sf), "peru_drinking_template"), *_ISSUE)


@query("val_12_crs_issues", sql(_issue("warning", "crs_sin_declarar", None, "0", "max(abs(longitude)) > 180 OR max(abs(latitude)) > 90"), "measured"))
def val_12(spark, sf):
    return shown(validation.crs_issues(S.measured(spark, sf)), *_ISSUE)


@query("val_14_stop_on_errors", sql(
    "SELECT station_code, count(*) AS n_errors FROM measured WHERE Ca_mgL - 60 < 0 GROUP BY station_code", "measured"))
def val_14(spark, sf):
    """Rows that would stop an analysis: negative calcium after a wrong blank correction, per station."""
    df = S.measured(spark, sf).withColumn("Ca_mgL", F.col("Ca_mgL") - 60.0)
    if not validation.has_errors(validation.validate(df, ["ranges"])):
        raise RuntimeError("the error rule did not fire")
    bad = validation.issue_rows(df).filter("code = 'valor_negativo'")
    return shown(bad.join(df.select(SEQ, "station_code"), SEQ).groupBy("station_code").agg(F.count("*").alias("n_errors")))


@query("val_15_automatic_zero_policy", sql(
    f"SELECT sample_seq, {r('CASE WHEN F_mgL > 0 THEN F_mgL END', 'F_mgL')}, {r('CO3_mgL')} FROM measured", "measured"))
def val_15(spark, sf):
    from limnos.plans.analysis import automatic_zero_ions

    df = S.measured(spark, sf)
    columns = [mgl(i) for i in automatic_zero_ions(df)]
    return shown(imputation.zeros_as_missing(df, columns), SEQ, "F_mgL", "CO3_mgL")


@query("issue_rows", sql(
    "SELECT code, field, sample_seq FROM (" + union(
        [f"SELECT 'fuera_de_rango' AS code, '{c}' AS field, sample_seq FROM measured WHERE {c} < {lo} OR {c} > {hi}"
         for c, (lo, hi) in PLAUSIBLE_RANGES.items() if c in MEASURED]
        + ["SELECT 'ceros_sospechosos', 'F_mgL', sample_seq FROM measured WHERE F_mgL = 0"]) + ")", "measured"))
def issue_rows(spark, sf):
    return shown(validation.issue_rows(S.measured(spark, sf)), "code", "field", SEQ)


def _all_issues(spark, sf):
    df = S.chem(spark, sf)
    return validation.validate(df).unionByName(validation.balance_issues(df))


_FOUND = [
    "SELECT 'warning' AS severity, 'balance_rechazado' AS code, 'CBE_pct' AS field, count(*) FILTER (WHERE CBE_flag = 'rejected') AS n_rows FROM chem HAVING count(*) FILTER (WHERE CBE_flag = 'rejected') > 0",
    "SELECT 'warning', 'ceros_sospechosos', 'F_mgL', count(*) FILTER (WHERE F_mgL = 0) FROM chem HAVING count(*) FILTER (WHERE F_mgL = 0) >= 0.1 * count(*)",
    "SELECT 'info', 'balance_marginal', 'CBE_pct', count(*) FILTER (WHERE CBE_flag = 'marginal') FROM chem HAVING count(*) FILTER (WHERE CBE_flag = 'marginal') > 0",
    "SELECT 'info', 'campanas_detectadas', 'sampled_at', 0 FROM chem HAVING count(sampled_at) > 0",
    "SELECT 'info', 'coordenadas_proyectadas', NULL, 0 FROM chem HAVING max(abs(latitude)) > 90 OR max(abs(longitude)) > 180",
]


@query("agg_17_issue_counts", sql(
    "SELECT v.severity, count(i.code) AS n FROM (VALUES ('error'), ('warning'), ('info')) v(severity) LEFT JOIN ("
    + union(_FOUND) + ") i USING (severity) GROUP BY 1", "chem"))
def agg_17(spark, sf):
    return shown(validation.issue_counts(_all_issues(spark, sf)))


@query("srt_02_sorted_issues", sql(union(_FOUND), "chem"))
def srt_02(spark, sf):
    return shown(validation.sorted_issues(_all_issues(spark, sf)), *_ISSUE)


@query("agg_06_column_statistics", sql(union(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_present, count(*) - count({c}) AS n_missing, count({c}) AS n_numeric, "
    f"{r(f'min({c})', 'min')}, {r(f'max({c})', 'max')}, {r(f'avg({c})', 'mean')}, {r(f'median({c})', 'median')} FROM measured"
    for c in MEASURED), "measured"))
def agg_06(spark, sf):
    return shown(validation.column_statistics(S.measured(spark, sf), MEASURED))


# --- summaries -----------------------------------------------------------------


@query("agg_10_fluoride_summary", sql(
    "SELECT count(F_mgL) AS n_measured, count(*) FILTER (WHERE F_mgL > 1.5) AS n_above_guide, count(*) FILTER (WHERE F_mgL > 4) AS n_severe, "
    "count(*) FILTER (WHERE F_mgL < 0.5) AS n_low, count(*) FILTER (WHERE F_mgL BETWEEN 0.5 AND 1.5) AS n_optimal, "
    + ", ".join([r("min(F_mgL)", "min"), r("max(F_mgL)", "max"), r("median(F_mgL)", "median"),
                 r("100.0::DOUBLE * count(*) FILTER (WHERE F_mgL > 1.5) / count(F_mgL)", "pct_above_guide"),
                 r("100.0::DOUBLE * count(*) FILTER (WHERE F_mgL < 0.5) / count(F_mgL)", "pct_low"),
                 r("100.0::DOUBLE * count(*) FILTER (WHERE F_mgL BETWEEN 0.5 AND 1.5) / count(F_mgL)", "pct_optimal")]) + " FROM measured", "measured"))
def agg_10(spark, sf):
    return shown(distributions.fluoride_summary(S.measured(spark, sf)))


@query("agg_11_groups", sql('SELECT "group", min(sample_seq) AS first_seq FROM samples GROUP BY 1 ORDER BY 2', "samples"))
def agg_11(spark, sf):
    return shown(distributions.groups_in_order(S.raw(spark, sf)))


@query("agg_11_campaigns", sql("SELECT DISTINCT sampled_at AS campaign_day FROM samples ORDER BY 1", "samples"))
def agg_11_campaigns(spark, sf):
    from limnos.operators.series import campaigns

    return shown(campaigns(S.raw(spark, sf)))


@query("agg_11_measured_ions", sql(
    "SELECT * FROM (" + union(f"SELECT '{i}' AS ion, count({mgl(i)}) AS n FROM measured" for i in ALL_IONS) + ") WHERE n > 0", "measured"))
def agg_11_ions(spark, sf):
    return shown(distributions.measured_ions(S.measured(spark, sf)))


_HIST = [
    "span AS (SELECT greatest(max(abs(CBE_pct)), 10.0::DOUBLE) * 1.1::DOUBLE AS half FROM chem)",
    "binned AS (SELECT least(CAST(floor((CBE_pct + half) / (half * 2) * 24) AS BIGINT), 23) AS b FROM chem, span WHERE CBE_pct IS NOT NULL)",
]


@query("agg_14_balance_histogram", sql(
    f"SELECT k AS bin, {r('k * (half * 2 / 24) - half', 'low')}, {r('(k + 1) * (half * 2 / 24) - half', 'high')}, count(b) AS n "
    "FROM range(24) t(k) CROSS JOIN span LEFT JOIN binned ON b = k GROUP BY k, half", "chem", more=_HIST))
def agg_14(spark, sf):
    return shown(distributions.balance_histogram(S.chem(spark, sf)))


@query("agg_14_balance_share", sql(
    "SELECT count(CBE_pct) AS n, count(*) FILTER (WHERE abs(CBE_pct) <= 5) AS n_within FROM chem", "chem"))
def agg_14_share(spark, sf):
    return shown(distributions.balance_share(S.chem(spark, sf)))


_BOX = [
    'bx AS (SELECT "group" AS g, count(F_mgL) AS n, quantile_cont(F_mgL, 0.25) AS q1, median(F_mgL) AS md, quantile_cont(F_mgL, 0.75) AS q3 FROM measured WHERE F_mgL IS NOT NULL GROUP BY 1)'
]


@query("agg_15_fluoride_boxes", sql(
    f'SELECT "group", n, {r("q1")}, {r("md", "median")}, {r("q3")}, {r("min(F_mgL) FILTER (WHERE F_mgL >= q1 - (q3 - q1) * 1.5)", "whisker_low")}, '
    f'{r("max(F_mgL) FILTER (WHERE F_mgL <= q3 + (q3 - q1) * 1.5)", "whisker_high")} FROM measured JOIN bx ON "group" = g GROUP BY "group", n, q1, md, q3',
    "measured", more=_BOX))
def agg_15(spark, sf):
    return shown(distributions.box_statistics(S.measured(spark, sf)))


@query("agg_18_color_ramp", sql(
    f"SELECT sample_seq, {r('(tds_mgl - (SELECT min(tds_mgl) FROM measured)) / ((SELECT max(tds_mgl) FROM measured) - (SELECT min(tds_mgl) FROM measured))', 'ramp')} FROM measured", "measured"))
def agg_18(spark, sf):
    return shown(distributions.color_ramp(S.measured(spark, sf)), SEQ, "ramp")


@query("agg_23_fluoride_calcium", sql(
    f'SELECT sample_seq, "group", {rs("Ca_mgL", "F_mgL")} FROM measured WHERE F_mgL IS NOT NULL AND Ca_mgL IS NOT NULL', "measured"))
def agg_23(spark, sf):
    return shown(distributions.fluoride_calcium(S.measured(spark, sf)))


@query("agg_23_fluoride_counts", sql(
    "SELECT count(F_mgL) AS n_measured, count(*) FILTER (WHERE F_mgL > 1.5) AS n_above, count(*) - count(F_mgL) AS n_unmeasured FROM measured", "measured"))
def agg_23_counts(spark, sf):
    return shown(distributions.fluoride_counts(S.measured(spark, sf), 1.5))


@query("agg_24_availability", sql(
    "SELECT v.result, v.ok AS available FROM (SELECT count(longitude) > 0 AS a, count(sampled_at) > 0 AS b, count(DISTINCT sampled_at) >= 2 AS c, "
    "count(F_mgL) > 0 AS d, count(facies) > 0 AS e FROM fac) s, LATERAL (VALUES ('coordinates', s.a), ('dates', s.b), ('series', s.b AND s.c), ('fluoride', s.d), ('facies', s.e)) v(result, ok)", "fac"))
def agg_24(spark, sf):
    return shown(distributions.availability(S.fac(spark, sf)), "result", "available")
