"""Registered queries: dates, series, changes, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import dates
from limnos.operators import distributions, selection, series, trend
from limnos.operators.diagrams import VERTICES, stiff_labels, vertex_labels
from limnos.plans import stages as S
from limnos.plans.registry import query, shown
from limnos.plans.stages import r, rs, sql

SEQ = "sample_seq"
SEVEN = ["tds_mgl", "ph", "temp_c", "CBE_pct", "Alkalinity_mgCaCO3", "sum_cat", "sum_an"]
THREE = ["tds_mgl", "ph", "CBE_pct"]


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


@query("scl_05_parse_dates", sql(
    "SELECT sample_seq, sampled_at AS iso_day, CASE WHEN sample_seq % 7 = 0 THEN NULL ELSE sampled_at END AS local_day FROM samples", "samples"))
def scl_05(spark, sf):
    """An ISO text column and a day-first one with unreadable cells."""
    df = S.raw(spark, sf)
    iso = df.select(SEQ, F.date_format("sampled_at", "yyyy-MM-dd").alias("sampled_at"))
    local = df.select(
        SEQ, F.when(F.col(SEQ) % 7 == 0, "pending").otherwise(F.date_format("sampled_at", "dd/MM/yyyy")).alias("sampled_at")
    )
    a = dates.normalise_dates(iso).select(SEQ, F.to_date("sampled_at").alias("iso_day"))
    b = dates.normalise_dates(local).select(SEQ, F.to_date("sampled_at").alias("local_day"))
    return shown(a.join(b, SEQ))


@query("scl_06_day_text", sql(
    "SELECT sample_seq, strftime(sampled_at, '%Y-%m-%d') AS day FROM samples", "samples"))
def scl_06(spark, sf):
    return shown(S.raw(spark, sf).withColumn("day", dates.day_text("sampled_at")), SEQ, "day")


@query("scl_07_elapsed_years", sql(
    f"SELECT sample_seq, {r('date_diff(' + chr(39) + 'day' + chr(39) + ', DATE ' + chr(39) + '1990-01-01' + chr(39) + ', sampled_at) / 365.25::DOUBLE', 'years')} FROM samples", "samples"))
def scl_07(spark, sf):
    start = F.lit("1990-01-01").cast("timestamp")
    return shown(S.raw(spark, sf).withColumn("years", dates.days_between(F.col("sampled_at"), start) / 365.25), SEQ, "years")


_SERIES_V = union(
    f"SELECT sample_seq, station_code, sampled_at, '{v}' AS vertex, '{label}' AS label, '{'cation' if 'cat' in v else 'anion'}' AS side, {r(f'{v} * 100', 'pct')} FROM piper"
    for v, label in vertex_labels().items()
)


@query("tmp_01_vertex_series", sql(_SERIES_V, "piper"))
def tmp_01(spark, sf):
    return shown(series.vertex_series(S.piper(spark, sf)), SEQ, "station_code", "sampled_at", "vertex", "label", "side", "pct")


@query("tmp_02_stiff_series", sql(union(
    f"SELECT sample_seq, station_code, sampled_at, CAST({c[3]} AS BIGINT) AS \"row\", '{c[5:]}' AS side, '{label}' AS label, {r(c, 'meq')} FROM stiff"
    for c, label in stiff_labels().items()), "stiff"))
def tmp_02(spark, sf):
    return shown(series.stiff_series(S.stiff(spark, sf)), SEQ, "station_code", "sampled_at", "row", "side", "label", "meq")


_SERIES_P = union(f"SELECT sample_seq, station_code, sampled_at, '{p}' AS parameter, {r(p, 'value')} FROM chem" for p in SEVEN)


@query("tmp_03_parameter_series", sql(_SERIES_P, "chem"))
def tmp_03(spark, sf):
    return shown(series.parameter_series(S.chem(spark, sf), SEVEN), SEQ, "station_code", "sampled_at", "parameter", "value")


@query("set_01_wide_to_long", sql(
    "SELECT parameter, count(value) AS n, " + r("sum(value)", "total", 2) + f" FROM ({_SERIES_P}) GROUP BY parameter", "chem"))
def set_01(spark, sf):
    long = series.parameter_series(S.chem(spark, sf), SEVEN)
    out = long.withColumn("value", F.round("value", 6)).groupBy("parameter").agg(F.count("value").alias("n"), F.sum("value").alias("total"))
    return shown(out, digits=2)


@query("tmp_04_trajectories", sql(
    f"SELECT sample_seq, station_code, sampled_at, {rs('x_cat', 'y_cat', 'x_an', 'y_an', 'x_diamond', 'y_diamond')} FROM "
    "(SELECT *, count(*) OVER (PARTITION BY station_code) AS k FROM piper WHERE x_cat IS NOT NULL AND x_diamond IS NOT NULL) WHERE k >= 2", "piper"))
def tmp_04(spark, sf):
    return shown(series.trajectories(S.piper(spark, sf)))


_CHANGES = union(
    f"SELECT station_code, '{v}' AS vertex, '{label}' AS label, {r(f'arg_min({v}, ROW(sampled_at, sample_seq)) * 100', 'first')}, "
    f"{r(f'arg_max({v}, ROW(sampled_at, sample_seq)) * 100', 'last')}, "
    f"{r(f'arg_max({v}, ROW(sampled_at, sample_seq)) * 100 - arg_min({v}, ROW(sampled_at, sample_seq)) * 100', 'delta_pp')}, "
    f"count(DISTINCT sampled_at) AS n_campaigns FROM piper WHERE {v} IS NOT NULL GROUP BY station_code HAVING count(*) >= 2"
    for v, label in vertex_labels().items()
)


@query("win_01_change_summary", sql(_CHANGES, "piper"))
def win_01(spark, sf):
    return shown(series.change_summary(S.piper(spark, sf)))


@query("tmp_05_change_by_vertex", sql(
    f"SELECT vertex, count(*) AS n_stations, {r('sum(delta_pp)', 'total_change', 3)} FROM ({_CHANGES}) GROUP BY vertex", "piper"))
def tmp_05(spark, sf):
    out = shown(series.change_summary(S.piper(spark, sf))).groupBy("vertex")
    return shown(out.agg(F.count("*").alias("n_stations"), F.sum("delta_pp").alias("total_change")), digits=3)


@query("win_05_direction", sql(
    f"SELECT station_code, vertex, CASE WHEN delta_pp > 0.5 THEN 'up' WHEN delta_pp < -0.5 THEN 'down' ELSE 'flat' END AS direction FROM ({_CHANGES})", "piper"))
def win_05(spark, sf):
    out = series.change_summary(S.piper(spark, sf))
    return shown(out.withColumn("direction", series.change_direction(F.round("delta_pp", 6))), "station_code", "vertex", "direction")


@query("jon_09_series_with_change", sql(
    "SELECT s.sample_seq, s.vertex, s.pct, c.delta_pp FROM (" + _SERIES_V + ") s LEFT JOIN (" + _CHANGES + ") c USING (station_code, vertex)", "piper"))
def jon_09(spark, sf):
    return shown(series.series_with_change(S.piper(spark, sf)), SEQ, "vertex", "pct", "delta_pp")


@query("agg_12_inventory", sql(
    "SELECT count(DISTINCT sampled_at) AS n_campaigns, (SELECT count(DISTINCT station_code) FROM samples WHERE sampled_at IS NOT NULL) AS n_stations, "
    "(SELECT count(*) FROM (SELECT station_code FROM samples GROUP BY 1 HAVING count(DISTINCT sampled_at) > 1)) AS n_repeated, "
    "count(*) FILTER (WHERE sampled_at IS NULL) AS n_undated, count(DISTINCT sampled_at) > 0 AS has_dates, "
    "count(DISTINCT sampled_at) >= 8 AS can_discuss_trend FROM samples", "samples"))
def agg_12(spark, sf):
    out = series.inventory(S.raw(spark, sf))
    return shown(out, "n_campaigns", "n_stations", "n_repeated", "n_undated", "has_dates", "can_discuss_trend")


@query("tmp_09_availability", sql(
    "SELECT c AS n_campaigns, CASE WHEN c = 0 THEN 'no dates' WHEN rep = 0 THEN 'no station repeated' WHEN c < 8 THEN 'series without trend' ELSE 'series and trend' END AS message "
    "FROM (SELECT count(DISTINCT sampled_at) AS c, (SELECT count(*) FROM (SELECT station_code FROM samples GROUP BY 1 HAVING count(DISTINCT sampled_at) > 1)) AS rep FROM samples)", "samples"))
def tmp_09(spark, sf):
    return shown(series.inventory_message(series.inventory(S.raw(spark, sf))), "n_campaigns", "message")


@query("jon_08_repeated_stations", sql(
    "SELECT sample_seq, station_code FROM samples WHERE station_code IN (SELECT station_code FROM samples GROUP BY 1 HAVING count(DISTINCT sampled_at) > 1)", "samples"))
def jon_08(spark, sf):
    df = S.raw(spark, sf)
    return shown(series.dated(df, series.repeated_stations(df)), SEQ, "station_code")


@query("win_02_repeated_codes", sql(
    "SELECT station_code, count(*) AS n FROM samples GROUP BY 1 HAVING count(*) > 1", "samples"))
def win_02(spark, sf):
    from limnos.operators.validation import duplicate_stations

    return shown(duplicate_stations(S.raw(spark, sf)))


@query("flt_03_dated_rows", sql(
    "SELECT sample_seq, station_code, sampled_at FROM samples WHERE sampled_at IS NOT NULL AND station_code IN ('ST-1', 'ST-3', 'ST-7') ORDER BY station_code, sampled_at, sample_seq", "samples"))
def flt_03(spark, sf):
    out = series.ordered(series.dated(S.raw(spark, sf), ["ST-1", "ST-3", "ST-7"]))
    return shown(out, SEQ, "station_code", "sampled_at")


@query("srt_01_series_order", sql(
    f"SELECT station_code, sampled_at, sample_seq, {r('tds_mgl', 'value')} FROM chem ORDER BY 1, 2, 3", "chem"))
def srt_01(spark, sf):
    out = series.ordered(series.parameter_series(S.chem(spark, sf), ["tds_mgl"]))
    return shown(out, "station_code", "sampled_at", SEQ, "value")


@query("srt_04_first_samples", sql("SELECT sample_seq, station_code FROM samples ORDER BY sample_seq LIMIT 24", "samples"))
def srt_04(spark, sf):
    return shown(S.raw(spark, sf).orderBy(SEQ).limit(24), SEQ, "station_code")


@query("srt_04_first_repeated_stations", sql(
    "SELECT station_code, count(DISTINCT sampled_at) AS n_days FROM samples GROUP BY 1 HAVING count(DISTINCT sampled_at) > 1 ORDER BY 1 LIMIT 12", "samples"))
def srt_04_stations(spark, sf):
    return shown(series.repeated_stations(S.raw(spark, sf)).orderBy("station_code").limit(12))


@query("srt_03_by_value", sql(
    f"SELECT sample_seq, {r('SO4_mgL')} FROM measured WHERE SO4_mgL > 250 ORDER BY SO4_mgL DESC, sample_seq", "measured"))
def srt_03(spark, sf):
    from limnos.operators.standards import exceedance_drilldown

    return shown(exceedance_drilldown(S.measured(spark, sf), "SO4_mgL"), SEQ, "SO4_mgL")


@query("srt_05_leading_ions", sql(
    "SELECT sample_seq, r_cat[1].k AS cation_1, r_cat[2].k AS cation_2, r_an[1].k AS anion_1, r_an[2].k AS anion_2 FROM f5", "fac"))
def srt_05(spark, sf):
    from limnos.operators.facies import ANION_GROUPS, CATION_GROUPS, add_percentages, leading_groups

    df = add_percentages(S.chem(spark, sf))
    return shown(
        df.select(SEQ, *leading_groups(df, CATION_GROUPS, "cation"), *leading_groups(df, ANION_GROUPS, "anion"))
    )


@query("agg_13_median_per_date", sql(
    f"SELECT sampled_at, count(tds_mgl) AS n, {r('median(tds_mgl)', 'tds_mgl')} FROM chem WHERE tds_mgl IS NOT NULL GROUP BY 1", "chem"))
def agg_13(spark, sf):
    return shown(series.median_per_date(S.chem(spark, sf), "tds_mgl"))


@query("agg_13_median_per_vertex", sql(
    "SELECT sampled_at, vertex, count(pct) AS n, " + r("median(p)", "pct") + " FROM ("
    + union(f"SELECT sampled_at, '{v}' AS vertex, {v} * 100 AS p, {v} AS pct FROM piper" for v in VERTICES) + ") WHERE p IS NOT NULL GROUP BY 1, 2", "piper"))
def agg_13_vertex(spark, sf):
    return shown(series.median_per_date(series.vertex_series(S.piper(spark, sf)), "pct", ["vertex"]))


def _points(parameters) -> list[str]:
    meds = union(
        f"SELECT station_code, '{p}' AS parameter, sampled_at AS d, median({p}) AS y FROM chem WHERE sampled_at IS NOT NULL GROUP BY station_code, sampled_at"
        for p in parameters
    )
    return [
        f"med AS MATERIALIZED ({meds})",
        "pts AS MATERIALIZED (SELECT * FROM med WHERE y IS NOT NULL)",
        "sizes AS (SELECT station_code, parameter, count(y) AS n FROM med GROUP BY 1, 2)",
        "ties AS (SELECT station_code, parameter, CAST(sum(t * (t - 1) * (2 * t + 5)) AS DOUBLE) AS tt FROM (SELECT station_code, parameter, y, count(*) AS t FROM pts GROUP BY 1, 2, 3) GROUP BY 1, 2)",
        "pairs AS (SELECT a.station_code, a.parameter, CAST(sum(CASE WHEN b.y > a.y THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN b.y < a.y THEN 1 ELSE 0 END) AS BIGINT) AS down, "
        "median((b.y - a.y) / date_diff('day', a.d, b.d) * 365.25::DOUBLE) AS slope FROM pts a JOIN pts b ON a.station_code = b.station_code AND a.parameter = b.parameter AND a.d < b.d GROUP BY 1, 2)",
    ]


_TREND = (
    "tr AS (SELECT station_code, parameter, n AS n_campaigns, 8 AS minimum, up - down AS s, (CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - tt) / 18 AS var, slope FROM sizes "
    "LEFT JOIN ties USING (station_code, parameter) LEFT JOIN pairs USING (station_code, parameter)),\n"
    "tz AS (SELECT *, CASE WHEN n_campaigns >= 8 AND var > 0 THEN (s - sign(s)) / sqrt(var) END AS z FROM tr)"
)
_TREND_OUT = (
    "SELECT station_code, parameter, n_campaigns, minimum, CASE WHEN n_campaigns >= 8 THEN s END AS s, " + r("z") + ", "
    + r("CASE WHEN n_campaigns < 8 THEN NULL WHEN var <= 0 THEN 0.0 ELSE slope END", "sen_slope_year")
    + ", CASE WHEN n_campaigns < 8 THEN 'insufficient' WHEN var <= 0 THEN 'flat' WHEN abs(z) > 1.959963984540054 AND slope > 0 THEN 'increasing' "
    "WHEN abs(z) > 1.959963984540054 AND slope < 0 THEN 'decreasing' ELSE 'no_trend' END AS status FROM tz"
)


@query("tmp_06_mann_kendall", sql(_TREND_OUT, "chem", more=[*_points(SEVEN), _TREND]))
def tmp_06(spark, sf):
    out = trend.trend_summary(S.chem(spark, sf), SEVEN)
    return shown(out, "station_code", "parameter", "n_campaigns", "minimum", "s", "z", "sen_slope_year", "status")


@query("tmp_07_trend_summary", sql(_TREND_OUT, "chem", more=[*_points(SEVEN), _TREND]))
def tmp_07(spark, sf):
    out = trend.trend_summary(S.chem(spark, sf), SEVEN)
    return shown(out, "station_code", "parameter", "n_campaigns", "minimum", "s", "z", "sen_slope_year", "status")


@query("scl_08_two_sided_p", sql(
    f"SELECT station_code, parameter, {r('z', 'z')}, {r('CASE WHEN n_campaigns < 8 THEN NULL WHEN var <= 0 THEN 1.0 ELSE ' + trend.two_sided_p_sql('z') + ' END', 'p_value')} FROM tz",
    "chem", more=[*_points(SEVEN), _TREND]))
def scl_08(spark, sf):
    return shown(trend.trend_summary(S.chem(spark, sf), SEVEN), "station_code", "parameter", "z", "p_value")


@query("jon_06_ordered_pairs", sql(
    "SELECT station_code, parameter, n AS n_campaigns, n * (n - 1) // 2 AS n_pairs, up, down, n * (n - 1) // 2 - up - down AS tied "
    "FROM sizes JOIN pairs USING (station_code, parameter) WHERE n >= 2", "chem", more=_points(SEVEN)))
def jon_06(spark, sf):
    return shown(trend.ordered_pair_counts(S.chem(spark, sf), SEVEN))


@query("tmp_08_station_bundle", sql(
    "SELECT 'vertices' AS part, 6 * count(*) AS n FROM piper UNION ALL SELECT 'parameters', 7 * count(*) FROM piper UNION ALL SELECT 'stiff', 6 * count(*) FROM piper "
    f"UNION ALL SELECT 'changes', count(*) FROM ({_CHANGES}) UNION ALL SELECT 'trajectories', count(*) FROM piper WHERE x_cat IS NOT NULL AND x_diamond IS NOT NULL "
    "UNION ALL SELECT 'trends', 7 * count(DISTINCT station_code) FROM piper", "piper"))
def tmp_08(spark, sf):
    from limnos.operators.diagrams import add_stiff

    bundle = series.station_bundle(add_stiff(S.piper(spark, sf)))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in bundle.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return shown(out)


@query("win_04_share_of_total", sql(
    f"SELECT facies, {r('count(*) * 1.0::DOUBLE / sum(count(*)) OVER ()', 'share')} FROM fac GROUP BY facies", "fac"))
def win_04(spark, sf):
    counts = S.fac(spark, sf).groupBy("facies").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return shown(counts.select("facies", (F.col("n") / total).alias("share")))


@query("win_06_row_key", sql("SELECT 's' || CAST(sample_seq AS VARCHAR) AS id, count(*) AS n FROM samples GROUP BY 1", "samples"))
def win_06(spark, sf):
    return shown(S.raw(spark, sf).groupBy(F.concat(F.lit("s"), F.col(SEQ)).alias("id")).agg(F.count("*").alias("n")))


@query("jon_01_derived_block", sql(f"SELECT sample_seq, {r('Ca_mgL')}, {r('sum_cat')} FROM chem", "chem"))
def jon_01(spark, sf):
    block = S.chem(spark, sf).select(SEQ, "sum_cat")
    return shown(selection.attach(S.measured(spark, sf), block), SEQ, "Ca_mgL", "sum_cat")


@query("jon_03_station_group", sql("SELECT station_code, arg_min(\"group\", sample_seq) AS \"group\" FROM samples GROUP BY 1", "samples"))
def jon_03(spark, sf):
    return shown(distributions.station_groups(S.raw(spark, sf)))
