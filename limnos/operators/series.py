"""Campaign series: what each station did over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.constants import MIN_CAMPAIGNS_FOR_TREND
from limnos.functions.dates import DATE, campaign_day
from limnos.functions.expr import keep_rows, present
from limnos.operators.diagrams import VERTICES, stiff_labels, vertex_labels
from limnos.operators.quantiles import HOT_ROWS, exact_medians

STATION = "station_code"
SEQ = "sample_seq"
# Parameters of the station bundle.
BUNDLE_PARAMETERS = ("tds_mgl", "ph", "temp_c", "CBE_pct", "Alkalinity_mgCaCO3", "sum_cat", "sum_an")
# Station lists up to this length become an IN filter that reaches the scan.
IN_LIST = 200


def dated(df: DataFrame, stations: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Rows with a date, optionally of some stations (a list, or a frame for long selections)."""
    out = df.filter(F.col(DATE).isNotNull())
    if stations is None:
        return out
    if isinstance(stations, DataFrame):
        return out.join(stations.select(STATION).distinct(), STATION, "left_semi")
    if len(stations) <= IN_LIST:
        return out.filter(F.col(STATION).isin(list(stations))) if stations else out
    schema = T.StructType([T.StructField(STATION, T.StringType())])
    listed = df.sparkSession.createDataFrame([(s,) for s in stations], schema)
    return out.join(listed.distinct(), STATION, "left_semi")


def ordered(series: DataFrame) -> DataFrame:
    """Station, key, date order (a range sort, so a large station spreads over partitions)."""
    keys = [c for c in (STATION, "vertex", "row", "side", "parameter") if c in series.columns]
    return series.orderBy(*keys, DATE, *present(series, SEQ))


def _long(df: DataFrame, columns: Sequence[str], key: str, value: str) -> DataFrame:
    ids = present(df, STATION, DATE, SEQ)
    return df.select(*ids, *columns).unpivot(ids, list(columns), key, value)


def _lookup(labels: dict[str, str], key: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, text in labels.items():
        out = out.when(key == k, text)
    return out


def vertex_series(df: DataFrame, stations=None, convention: str = "classic") -> DataFrame:
    """Share of each Piper vertex in percent, one row per sample and vertex."""
    out = _long(dated(df, stations), present(df, *VERTICES), "vertex", "pct")
    key = F.col("vertex")
    return out.withColumns(
        {
            "pct": F.col("pct") * 100.0,
            "label": _lookup(vertex_labels(convention), key),
            "side": F.when(key.contains("cat"), "cation").otherwise("anion"),
        }
    )


def stiff_series(df: DataFrame, stations=None, template: str = "standard") -> DataFrame:
    """Each side of each Stiff row in meq/L."""
    labels = stiff_labels(template)
    out = _long(dated(df, stations), present(df, *labels), "__key", "meq")
    key = F.col("__key")
    return out.withColumns(
        {
            "row": F.substring(F.split(key, "_")[0], 4, 9).cast("int"),
            "side": F.split(key, "_")[1],
            "label": _lookup(labels, key),
        }
    ).drop("__key")


def parameter_series(df: DataFrame, parameters: Sequence[str], stations=None) -> DataFrame:
    parameters = present(df, *parameters)
    rows = dated(df, stations)
    rows = rows.withColumns({p: F.col(p).cast("double") for p in parameters})
    return _long(rows, parameters, "parameter", "value")


def trajectories(df: DataFrame, stations=None) -> DataFrame:
    """Path of each station through the Piper diagram, one row per plottable point.

    Only stations with at least two plottable points appear. Points stay rows, so
    a station with very many samples is never packed into one record; sort with
    ``ordered`` to draw.
    """
    names = ("x_cat", "y_cat", "x_an", "y_an", "x_diamond", "y_diamond")
    rows = dated(df, stations).filter(F.col(STATION).isNotNull())
    plottable = F.col("x_cat").isNotNull() & F.col("x_diamond").isNotNull()
    points = keep_rows(rows.select(STATION, DATE, *present(df, SEQ), *names), plottable)
    paths = points.groupBy(STATION).agg(F.count("*").alias("n")).filter("n >= 2").select(STATION)
    return points.join(paths, STATION, "left_semi")


def change_summary(df: DataFrame, stations=None, convention: str = "classic") -> DataFrame:
    """First and last share of every vertex per station, and the change in points.

    Two aggregations: per (station, date) first, which spreads a large station over
    its dates and keeps primitive buffers; then per station over the few dates.
    """
    vertices = present(df, *VERTICES)
    rows = dated(df, stations).filter(F.col(STATION).isNotNull())
    parts = []
    for v in vertices:
        seq = F.when(F.col(v).isNotNull(), F.col(SEQ))
        parts += [
            F.min_by(v, seq).alias(f"a_{v}"), F.max_by(v, seq).alias(f"z_{v}"), F.count(v).alias(f"n_{v}"),
        ]
    days = rows.groupBy(STATION, DATE).agg(*parts)
    parts = []
    for v in vertices:
        when = F.when(F.col(f"n_{v}") > 0, F.col(DATE))
        parts += [
            F.min_by(f"a_{v}", when).alias(f"a_{v}"),
            F.max_by(f"z_{v}", when).alias(f"z_{v}"),
            F.sum(f"n_{v}").alias(f"n_{v}"),
            F.count(when).alias(f"d_{v}"),
        ]
    labels = vertex_labels(convention)
    packed = F.array(
        *[
            F.struct(
                F.lit(v).alias("vertex"), F.lit(labels[v]).alias("label"),
                (F.col(f"a_{v}") * 100.0).alias("first"), (F.col(f"z_{v}") * 100.0).alias("last"),
                F.col(f"n_{v}").alias("n_points"), F.col(f"d_{v}").alias("n_campaigns"),
            )
            for v in vertices
        ]
    )
    out = days.groupBy(STATION).agg(*parts).select(STATION, F.inline(packed)).filter("n_points >= 2")
    return out.withColumn("delta_pp", F.col("last") - F.col("first")).drop("n_points")


def change_direction(delta: Column) -> Column:
    return F.when(delta > 0.5, "up").when(delta < -0.5, "down").otherwise("flat")


def series_with_change(df: DataFrame, stations=None, convention: str = "classic") -> DataFrame:
    """Vertex series with the change of its (station, vertex) beside every point."""
    series = vertex_series(df, stations, convention)
    change = change_summary(df, stations, convention).select(STATION, "vertex", "delta_pp")
    return series.join(change, [STATION, "vertex"], "left").withColumn(
        "direction", F.when(F.col("delta_pp").isNotNull(), change_direction(F.col("delta_pp")))
    )


def campaigns(df: DataFrame) -> DataFrame:
    """Distinct sampling days in order."""
    return df.select(campaign_day().alias("campaign_day")).filter("campaign_day IS NOT NULL").distinct().orderBy("campaign_day")


def station_days(df: DataFrame) -> DataFrame:
    """Sampling days per station: distinct pairs first, so no station is counted in one task."""
    pairs = df.select(F.col(STATION).cast("string").alias(STATION), campaign_day().alias("day"))
    pairs = pairs.filter("day IS NOT NULL").distinct()
    return pairs.groupBy(STATION).agg(F.count("*").alias("n_days"))


def repeated_stations(df: DataFrame) -> DataFrame:
    return station_days(df).filter("n_days > 1")


def inventory(df: DataFrame) -> DataFrame:
    """One row: campaigns, stations, repeated stations, undated samples and what they allow."""
    if DATE not in df.columns or STATION not in df.columns:
        stats = df.agg(F.count("*").alias("n_undated"))
        zero = F.lit(0).cast("bigint")
        n_campaigns = n_stations = n_repeated = zero
    else:
        stats = df.agg(F.count_if(F.col(DATE).isNull()).alias("n_undated"))
        per_station = station_days(df)
        n_campaigns = df.select(F.countDistinct(campaign_day())).scalar()
        n_stations = per_station.select(F.count("*")).scalar()
        n_repeated = per_station.select(F.count_if(F.col("n_days") > 1)).scalar()
    out = stats.select(
        n_campaigns.alias("n_campaigns"), n_stations.alias("n_stations"),
        n_repeated.alias("n_repeated"), "n_undated",
    )
    return out.select(
        "*",
        (F.col("n_campaigns") > 0).alias("has_dates"),
        (F.col("n_repeated") > 0).alias("can_plot_series"),
        (F.col("n_campaigns") >= MIN_CAMPAIGNS_FOR_TREND).alias("can_discuss_trend"),
    )


def inventory_message(index: DataFrame) -> DataFrame:
    """Why series can or cannot be shown, from the inventory row."""
    text = (
        F.when(~F.col("has_dates"), "no dates")
        .when(~F.col("can_plot_series"), "no station repeated")
        .when(~F.col("can_discuss_trend"), "series without trend")
        .otherwise("series and trend")
    )
    return index.withColumn("message", text)


def median_per_date(
    series: DataFrame, value: str, by: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Median across stations on every date (and per extra key)."""
    keys = [DATE, *by]
    out = exact_medians(series, [value], keys, hot_rows).filter("n > 0")
    return out.select(*keys, F.col("n"), F.col("median").alias(value))


def station_bundle(df: DataFrame, stations=None, convention: str = "classic", template: str = "standard") -> dict:
    """All series of the chosen stations, as lazy tables over one analysed frame."""
    from limnos.operators.trend import trend_summary

    parameters = present(df, *BUNDLE_PARAMETERS)
    return {
        "vertices": vertex_series(df, stations, convention),
        "changes": change_summary(df, stations, convention),
        "parameters": parameter_series(df, parameters, stations),
        "trends": trend_summary(df, parameters, stations),
        "stiff": stiff_series(df, stations, template),
        "trajectories": trajectories(df, stations),
    }
