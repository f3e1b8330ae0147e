"""Registered queries: diagrams and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import diagrams, positions
from limnos.operators.distributions import stiff_scale
from limnos.plans import stages as S
from limnos.plans.registry import query, shown
from limnos.plans.stages import r, rs, sql

SEQ = "sample_seq"
XY = ["x_cat", "y_cat", "x_an", "y_an", "x_diamond", "y_diamond"]
ROWS = [f"row{i}_{s}" for i in range(3) for s in ("left", "right")]
ROWS4 = [f"row{i}_{s}" for i in range(4) for s in ("left", "right")]


@query("geo_01_normalise", sql(f"SELECT sample_seq, {rs(*diagrams.VERTICES)} FROM piper", "piper"))
def geo_01(spark, sf):
    return shown(S.piper(spark, sf), SEQ, *diagrams.VERTICES)


@query("geo_02_ternary_xy", sql(f"SELECT sample_seq, {rs('x_cat', 'y_cat', 'x_an', 'y_an')} FROM piper", "piper"))
def geo_02(spark, sf):
    return shown(S.piper(spark, sf), SEQ, "x_cat", "y_cat", "x_an", "y_an")


@query("geo_03_piper_classic", sql(f"SELECT sample_seq, {rs(*XY)} FROM piper", "piper"))
def geo_03(spark, sf):
    return shown(S.piper(spark, sf), SEQ, *XY)


@query("geo_03_piper_notebook", sql(f"SELECT sample_seq, {rs(*XY, *diagrams.VERTICES)} FROM pn", "chem", more=[S._piper_sql(False, "pn", "chem")]))
def geo_03_notebook(spark, sf):
    return shown(diagrams.add_piper(S.chem(spark, sf), "notebook"), SEQ, *XY, *diagrams.VERTICES)


@query("geo_04_stiff_rows", sql(f"SELECT sample_seq, {rs(*ROWS)} FROM stiff", "stiff"))
def geo_04(spark, sf):
    return shown(S.stiff(spark, sf), SEQ, *ROWS)


@query("geo_04_stiff_extended", sql(f"SELECT sample_seq, {rs(*ROWS4)} FROM st4", "chem", more=[S._stiff_sql(S.STIFF_EXTENDED, "st4", "chem")]))
def geo_04_extended(spark, sf):
    return shown(diagrams.add_stiff(S.chem(spark, sf), "extended"), SEQ, *ROWS4)


_CORNERS = [("-row2_left", 0), ("-row1_left", 1), ("-row0_left", 2), ("row0_right", 2), ("row1_right", 1), ("row2_right", 0), ("-row2_left", 0)]


@query("geo_05_stiff_polygon", sql(
    "SELECT sample_seq, corner, " + r("x") + ", " + r("y") + " FROM ("
    + " UNION ALL ".join(f"SELECT sample_seq, {i} AS corner, {x} AS x, {y} AS y FROM stiff" for i, (x, y) in enumerate(_CORNERS)) + ")", "stiff"))
def geo_05(spark, sf):
    df = S.stiff(spark, sf).select(SEQ, F.posexplode(diagrams.stiff_polygon()).alias("corner", "p"))
    return shown(df.select(SEQ, "corner", "p.x", "p.y"))


_TOP = "greatest(" + ", ".join(ROWS) + ")"


@query("geo_06_stiff_axis_limit", sql(f"SELECT {r(f'greatest(max({_TOP}) * 1.2::DOUBLE, 0.5::DOUBLE)', 'axis_limit')} FROM stiff", "stiff"))
def geo_06(spark, sf):
    return shown(diagrams.stiff_axis_limit(S.stiff(spark, sf)))


@query("agg_20_nice_axis", sql(
    f"SELECT {r('raw')}, {r('coalesce(list_min(list_filter([1.0::DOUBLE * mag, 2.0::DOUBLE * mag, 2.5::DOUBLE * mag, 5.0::DOUBLE * mag, 10.0::DOUBLE * mag], lambda v: v >= raw)), raw)', 'axis_limit')} "
    "FROM (SELECT raw, pow(10.0::DOUBLE, floor(log10(raw))) AS mag FROM (SELECT greatest(coalesce(max(" + _TOP + "), 0) * 1.15::DOUBLE, 0.5::DOUBLE) AS raw FROM stiff))", "stiff"))
def agg_20(spark, sf):
    return shown(diagrams.stiff_nice_axis(S.stiff(spark, sf)))


_RANK = (
    "SELECT {keys}n, {p}, {s} FROM (SELECT {keys}top, row_number() OVER ({part}ORDER BY top) AS rn, count(*) OVER ({win}) AS n "
    "FROM (SELECT \"group\", " + _TOP + " AS top FROM stiff) WHERE top > 0) WHERE rn = least(n, CAST(floor(n * 0.9::DOUBLE) AS BIGINT) + 1)"
)


@query("agg_19_stiff_scale", sql(_RANK.format(keys="", p=r("top", "p90"), s=r("32 / top", "scale"), part="", win=""), "stiff"))
def agg_19(spark, sf):
    return shown(stiff_scale(S.stiff(spark, sf), target=32.0), "n", "p90", "scale")


@query("agg_19_stiff_scale_by_group", sql(
    _RANK.format(keys='"group", ', p=r("top", "p90"), s=r("32 / top", "scale"), part='PARTITION BY "group" ', win='PARTITION BY "group"'), "stiff"))
def agg_19_group(spark, sf):
    return shown(stiff_scale(S.stiff(spark, sf), group="group", target=32.0), "group", "n", "p90", "scale")


DUROV = [f"durov_{k}" for k in ("x", "y", "cat_x", "cat_y", "an_x", "an_y")] + [f"durov_pct_{k}" for k in ("Ca", "NaK", "Mg", "HCO3", "Cl", "SO4")]


@query("geo_08_durov", sql(f"SELECT sample_seq, {rs(*DUROV)} FROM durov", "durov"))
def geo_08(spark, sf):
    return shown(S.durov(spark, sf), SEQ, *DUROV)


def _panel(c: str, start: str) -> str:
    low, high = f"(SELECT min({c}) FROM measured)", f"(SELECT max({c}) FROM measured)"
    return f"{start} + ({c} - {low}) / ({high} - {low}) * 0.55::DOUBLE"


@query("geo_09_durov_panels", sql(
    f"SELECT sample_seq, {r('durov_x', 'durov_ph_x')}, {r(_panel('ph', '-0.67::DOUBLE'), 'durov_ph_y')}, "
    f"{r(_panel('tds_mgl', '1.12::DOUBLE'), 'durov_tds_x')}, {r('durov_y', 'durov_tds_y')} FROM durov", "durov"))
def geo_09(spark, sf):
    df = diagrams.add_durov_panels(S.durov(spark, sf))
    return shown(df, SEQ, "durov_ph_x", "durov_ph_y", "durov_tds_x", "durov_tds_y")


@query("geo_09_panel_ranges", sql(
    f"SELECT 'ph' AS panel, count(ph) AS n, {r('min(ph)', 'low')}, {r('max(ph)', 'high')} FROM measured UNION ALL "
    f"SELECT 'tds', count(tds_mgl), {r('min(tds_mgl)', 'low')}, {r('max(tds_mgl)', 'high')} FROM measured", "measured"))
def geo_09_ranges(spark, sf):
    return shown(diagrams.durov_panels(S.measured(spark, sf)), "panel", "n", "low", "high")


# --- coordinates ---------------------------------------------------------------


@query("crs_02_utm_zone", sql(
    f"SELECT sample_seq, CAST(floor((lon_wgs84 + 180) / 6) % 60 + 1 AS BIGINT) AS zone, "
    f"{r('(floor((lon_wgs84 + 180) / 6) % 60 + 1) * 6 - 183', 'central_meridian')} FROM placed", "placed"))
def crs_02(spark, sf):
    df = S.placed(spark, sf).withColumn("zone", positions.utm_zone(F.col("lon_wgs84")))
    return shown(df.withColumn("central_meridian", positions.zone_meridian(F.col("zone"))), SEQ, "zone", "central_meridian")


@query("crs_03_suggestion", sql(
    "SELECT CASE WHEN max(abs(longitude)) <= 180 AND max(abs(latitude)) <= 90 THEN 4326 WHEN median(latitude) > 5000000 THEN 32718 ELSE 32618 END AS epsg FROM measured", "measured"))
def crs_03(spark, sf):
    return shown(positions.suggest_crs_row(S.measured(spark, sf)))


_E2 = "0.0066943799901413165::DOUBLE"
_ARC = (
    f"6378137 * ((1 - {_E2} / 4 - 3 * pow({_E2}, 2) / 64 - 5 * pow({_E2}, 3) / 256) * phi - (3 * {_E2} / 8 + 3 * pow({_E2}, 2) / 32 + 45 * pow({_E2}, 3) / 1024) * sin(2 * phi) "
    f"+ (15 * pow({_E2}, 2) / 256 + 45 * pow({_E2}, 3) / 1024) * sin(4 * phi) - (35 * pow({_E2}, 3) / 3072) * sin(6 * phi))"
)


@query("crs_04_meridian_arc", sql(
    f"SELECT sample_seq, {r(_ARC, 'arc', 3)} FROM (SELECT sample_seq, radians(lat_wgs84) AS phi FROM placed)", "placed"))
def crs_04(spark, sf):
    df = S.placed(spark, sf).withColumn("arc", positions.meridian_arc(F.radians("lat_wgs84")))
    return shown(df, SEQ, "arc", digits=3)


@query("crs_05_geographic_to_utm", sql(
    f"SELECT sample_seq, {r('longitude', 'utm_e', 2)}, {r('latitude', 'utm_n', 2)} FROM measured", "measured"))
def crs_05(spark, sf):
    """Round trip: degrees computed from the given metres must lead back to them."""
    df = positions.add_utm(S.placed(spark, sf), positions.utm(18, "S"))
    return shown(df, SEQ, "utm_e", "utm_n", digits=2)


@query("crs_06_utm_to_geographic", sql(f"SELECT sample_seq, {rs('lon_wgs84', 'lat_wgs84')} FROM placed", "placed"))
def crs_06(spark, sf):
    df = positions.add_degrees(S.measured(spark, sf), positions.utm(18, "S"), "longitude", "latitude")
    return shown(df, SEQ, "lon_wgs84", "lat_wgs84")


@query("crs_07_wgs84_columns", sql(f"SELECT station_code, count(*) AS n, {r('min(lon_wgs84)', 'lon')}, {r('min(lat_wgs84)', 'lat')} FROM placed GROUP BY 1", "placed"))
def crs_07(spark, sf):
    df = positions.add_wgs84(S.measured(spark, sf))
    out = df.groupBy("station_code").agg(F.count("*").alias("n"), F.min("lon_wgs84").alias("lon"), F.min("lat_wgs84").alias("lat"))
    return shown(out)


@query("flt_05_valid_positions", sql(
    "SELECT count(*) FILTER (WHERE coalesce(lon_wgs84 BETWEEN -180 AND 180 AND lat_wgs84 BETWEEN -90 AND 90, false)) AS n_placed, "
    "count(*) FILTER (WHERE NOT coalesce(lon_wgs84 BETWEEN -180 AND 180 AND lat_wgs84 BETWEEN -90 AND 90, false)) AS n_skipped FROM placed", "placed"))
def flt_05(spark, sf):
    return shown(positions.position_counts(S.placed(spark, sf)))
