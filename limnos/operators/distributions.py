"""Summary tables behind the report figures and legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, CBE_ACCEPTABLE_PCT, CBE_MARGINAL_PCT, mgl
from limnos.functions.dates import DATE, campaign_day
from limnos.functions.expr import col_or_null, number, present, safe_div
from limnos.operators.diagrams import widest_side
from limnos.operators.quantiles import HOT_ROWS, exact_medians, exact_quantiles, floor_index

# Fluoride bands of the summary, mg/L.
FLUORIDE_GUIDE, FLUORIDE_SEVERE, FLUORIDE_LOW = 1.5, 4.0, 0.5
HISTOGRAM_BINS = 24


def fluoride_summary(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row: measured samples per fluoride band, shares and extremes."""
    v = number("F_mgL")
    stats = df.agg(
        F.count(v).alias("n_measured"),
        F.count_if(v > FLUORIDE_GUIDE).alias("n_above_guide"),
        F.count_if(v > FLUORIDE_SEVERE).alias("n_severe"),
        F.count_if(v < FLUORIDE_LOW).alias("n_low"),
        F.count_if((v >= FLUORIDE_LOW) & (v <= FLUORIDE_GUIDE)).alias("n_optimal"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    n = F.col("n_measured").cast("double")
    stats = stats.withColumns(
        {f"pct_{k}": safe_div(F.col(f"n_{k}").cast("double"), n) * 100.0 for k in ("above_guide", "low", "optimal")}
    )
    median = exact_medians(df, ["F_mgL"], (), hot_rows).select("median").scalar()
    return stats.withColumn("median", median)


def balance_histogram(
    df: DataFrame, marginal: float = CBE_MARGINAL_PCT, bins: int = HISTOGRAM_BINS
) -> DataFrame:
    """Charge-balance histogram over ±1.1·max(|error|, marginal); every bin is listed."""
    span = df.agg(F.greatest(F.coalesce(F.max(F.abs("CBE_pct")), F.lit(0.0)), F.lit(marginal)).alias("m"))
    half = span.select(F.col("m") * 1.1).scalar()
    at = F.floor((F.col("CBE_pct") + half) / (half * 2.0) * bins).cast("int")
    # Samples without an error go to bin -1, which joins nothing below. A key that is
    # never NULL also keeps the join from pushing a null test below the chemistry.
    binned = df.select(F.coalesce(at, F.lit(-1)).alias("bin")).select(F.least("bin", F.lit(bins - 1)).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(counts, "bin", "left")
    width = half * 2.0 / bins
    return out.select(
        "bin",
        (F.col("bin") * width - half).alias("low"),
        ((F.col("bin") + 1) * width - half).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def balance_share(df: DataFrame, acceptable: float = CBE_ACCEPTABLE_PCT) -> DataFrame:
    return df.agg(
        F.count("CBE_pct").alias("n"), F.count_if(F.abs("CBE_pct") <= acceptable).alias("n_within")
    )


def box_statistics(df: DataFrame, value: str = "F_mgL", group: str = "group", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Quartiles, Tukey whiskers (1.5·IQR, observed values) and size per group."""
    rows = df.select(F.col(group).cast("string").alias(group), number(value).alias(value))
    rows = rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = exact_quantiles(rows, [value], [0.25, 0.5, 0.75], [group], hot_rows=hot_rows)
    q = q.select(group, "n", *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(("q1", "median", "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    # No broadcast hint: the number of groups is not bounded.
    inside = rows.join(q, group).groupBy(group).agg(
        F.min(F.when(F.col(value) >= F.col("q1") - reach, F.col(value))).alias("whisker_low"),
        F.max(F.when(F.col(value) <= F.col("q3") + reach, F.col(value))).alias("whisker_high"),
    )
    return q.join(inside, group)


def fluoride_calcium(df: DataFrame) -> DataFrame:
    """Samples with both fluoride and calcium measured."""
    keep = present(df, "sample_seq", "group", "Ca_mgL", "F_mgL")
    return df.select(*keep).filter(F.col("F_mgL").isNotNull() & F.col("Ca_mgL").isNotNull())


def fluoride_counts(df: DataFrame, limit: float | None) -> DataFrame:
    v = number("F_mgL")
    above = F.count_if(v > limit) if limit is not None else F.lit(0).cast("bigint")
    return df.agg(
        F.count(v).alias("n_measured"), above.alias("n_above"), F.count_if(v.isNull()).alias("n_unmeasured")
    )


def color_ramp(df: DataFrame, value: str = "tds_mgl", target: str = "ramp") -> DataFrame:
    """Value scaled to 0..1 over its range (0.5 for a constant column)."""
    stats = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    low, high = stats.select("low").scalar(), stats.select("high").scalar()
    scaled = F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.5)
    return df.withColumn(target, F.when(F.col(value).isNotNull(), scaled))


def stiff_scale(
    df: DataFrame, template: str = "standard", group: str | None = None, target: float = 1.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Icon scale: ``target`` over the value at floor(0.9·n) of the positive sample maxima.

    One row overall, or one per group. A group without positive maxima scales to 1.
    """
    keys = [group] if group else []
    tops = df.select(*keys, widest_side(template).alias("top"))
    tops = tops.withColumn("top", F.when(F.col("top") > 0, F.col("top")))
    out = exact_quantiles(tops, ["top"], [0.9], keys, floor_index, hot_rows)
    p90 = F.get("q", F.lit(0))
    return out.select(*keys, "n", p90.alias("p90"), F.coalesce(F.lit(target) / p90, F.lit(1.0)).alias("scale"))


def groups_in_order(df: DataFrame, group: str = "group", seq: str = "sample_seq") -> DataFrame:
    """Distinct groups in the order they first appear."""
    first = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(seq).alias("first_seq"))
    return first.orderBy("first_seq")


def station_groups(df: DataFrame) -> DataFrame:
    """The group each station was first seen in."""
    return df.groupBy("station_code").agg(F.min_by("group", "sample_seq").alias("group"))


def measured_ions(df: DataFrame) -> DataFrame:
    """Ions with at least one value."""
    ions = [i for i in ALL_IONS if mgl(i) in df.columns]
    counts = df.agg(*[F.count(number(mgl(i))).alias(i) for i in ions])
    return counts.unpivot([], ions, "ion", "n").filter("n > 0")


def _outcome(key: str, ok: Column, reason: str) -> Column:
    return F.struct(
        F.lit(key).alias("result"), ok.alias("available"), F.when(~ok, F.lit(reason)).alias("reason")
    )


def availability(df: DataFrame) -> DataFrame:
    """Which result sets can be produced, and why not (one scan plus one distinct count)."""
    have = set(df.columns)
    days = F.lit(0)
    if DATE in have:
        days = df.select(F.countDistinct(campaign_day())).scalar()
    stats = df.agg(
        F.count(col_or_null(df, "longitude")).alias("n_lon"),
        F.count(F.col(DATE) if DATE in have else F.lit(None)).alias("n_dates"),
        F.count(col_or_null(df, "F_mgL")).alias("n_f"),
        F.count(F.col("facies") if "facies" in have else F.lit(None)).alias("n_facies"),
    )
    located = (F.col("n_lon") > 0) if {"longitude", "latitude"} <= have else F.lit(False)
    return stats.select(
        F.inline(
            F.array(
                _outcome("coordinates", located, "no coordinates"),
                _outcome("dates", F.col("n_dates") > 0, "no dates"),
                _outcome("series", (F.col("n_dates") > 0) & (days >= 2), "fewer than two campaigns"),
                _outcome("fluoride", F.col("n_f") > 0, "fluoride not measured"),
                _outcome("facies", F.col("n_facies") > 0, "no facies"),
            )
        )
    )


def cluster_summary(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, most frequent facies (ties by name) and mean TDS per cluster."""
    parts = df.groupBy(cluster, "facies_label").agg(
        F.count("*").alias("n"), F.sum("tds_mgl").alias("tds"), F.count("tds_mgl").alias("n_tds")
    )
    # Largest count first, then the alphabetically first label: both in one comparable key.
    rank = F.when(F.col("facies_label").isNotNull(), F.struct(-F.col("n"), F.col("facies_label")))
    return parts.groupBy(cluster).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.min_by("facies_label", rank), F.lit("Mixta")).alias("dominant_facies"),
        safe_div(F.sum("tds"), F.sum("n_tds").cast("double")).alias("mean_tds"),
    )
