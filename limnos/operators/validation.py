"""Data-quality rules. Nothing is corrected here: every rule yields rows of an ``issues`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.constants import ALL_IONS, MAJOR_IONS, PLAUSIBLE_RANGES, SUSPICIOUS_ZERO_SHARE, mgl
from limnos.functions.dates import DATE, campaign_day
from limnos.functions.expr import number, present
from limnos.operators.quantiles import HOT_ROWS, exact_medians

SEVERITIES = ("error", "warning", "info")
ISSUE_COLUMNS = ("severity", "code", "field", "n_rows", "message", "hint")
STATION = "station_code"
# Texts that stand for an empty station code.
BLANK_CODES = ["", "nan", "None"]


def _issue(when: Column, severity: str, code: str, field: str | None, n: Column, message: Column | str,
           hint: str | None = None) -> Column:
    return F.struct(
        when.alias("raised"),
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        F.lit(field).cast("string").alias("field"),
        F.coalesce(n, F.lit(0)).cast("bigint").alias("n_rows"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        F.lit(hint).cast("string").alias("hint"),
    )


def _rows(stats: DataFrame, issues: list[Column]) -> DataFrame:
    return (
        stats.select(F.inline(F.array(*issues)))
        .filter(F.coalesce("raised", F.lit(False)))
        .select(*ISSUE_COLUMNS)
    )


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _blank_code() -> Column:
    return F.coalesce(F.trim(F.col(STATION).cast("string")), F.lit("")).isin(BLANK_CODES)


def profile(df: DataFrame) -> DataFrame:
    """One row with every count the rules need, from one scan without distinct counts."""
    have = set(df.columns)
    parts = [F.count("*").alias("n")]
    for c in present(df, *PLAUSIBLE_RANGES):
        low, high = PLAUSIBLE_RANGES[c]
        v = number(c)
        parts += [
            F.count(v).alias(f"n_{c}"),
            F.count_if((v < low) | (v > high)).alias(f"out_{c}"),
            F.count_if(v < 0).alias(f"neg_{c}"),
        ]
        if c.endswith("_mgL"):
            parts.append(F.count_if(v == 0).alias(f"zero_{c}"))
    if STATION in have:
        parts.append(F.count_if(_blank_code()).alias("blank_station"))
    if {"longitude", "latitude"} <= have:
        lon, lat = number("longitude"), number("latitude")
        parts += [
            F.count_if(lon.isNull() | lat.isNull()).alias("no_position"),
            F.count(lon).alias("n_lon"),
            F.max(F.abs(lon)).alias("abs_lon"),
            F.max(F.abs(lat)).alias("abs_lat"),
        ]
    if DATE in have:
        parts.append(F.count(DATE).alias("n_dated"))
    return df.agg(*parts)


def _identity(df: DataFrame) -> list[Column]:
    if STATION not in df.columns:
        return [_issue(F.lit(True), "error", "sin_estacion", None, F.lit(0), "no station column was recognised")]
    n = F.col("blank_station")
    return [_issue(n > 0, "error", "estacion_vacia", STATION, n, _text(n, " sample(s) without a station code"))]


def _ions(df: DataFrame) -> list[Column]:
    ions = present(df, *[mgl(i) for i in ALL_IONS])
    if not ions:
        return [_issue(F.lit(True), "error", "sin_iones", None, F.lit(0), "no major-ion column was recognised")]
    lacking = [i for i in MAJOR_IONS if mgl(i) not in ions]
    out = [
        _issue(
            F.lit(bool(lacking)), "warning", "falta_ion_mayoritario", None, F.lit(0),
            f"{len(lacking)} major ion(s) not measured: {', '.join(lacking)}",
            "charge balance and Piper positions are computed without them",
        )
    ]
    for c in ions:
        out.append(
            _issue(F.col(f"n_{c}") == 0, "warning", "columna_sin_medidas", c, F.lit(0),
                   f"{c} has no value at all", "it is left out; nothing is filled in")
        )
    return out


def _ranges(df: DataFrame) -> list[Column]:
    out = []
    for c in present(df, *PLAUSIBLE_RANGES):
        low, high = PLAUSIBLE_RANGES[c]
        n, neg = F.col(f"out_{c}"), F.col(f"neg_{c}")
        out += [
            _issue(n > 0, "warning", "fuera_de_rango", c, n, _text(n, f" value(s) of {c} outside {low:g} to {high:g}"),
                   "usually a wrong unit or a typing error"),
            _issue(neg > 0, "error", "valor_negativo", c, neg, _text(neg, f" negative value(s) in {c}")),
        ]
    return out


def suspicious_zero_columns(df: DataFrame) -> list[str]:
    """Ion columns the zero rule looks at (an exact zero of carbonate is normal chemistry)."""
    return [c for c in present(df, *[mgl(i) for i in ALL_IONS]) if c != mgl("CO3")]


def _zeros(df: DataFrame) -> list[Column]:
    out = []
    for c in suspicious_zero_columns(df):
        n = F.col(f"zero_{c}")
        out.append(
            _issue((n > 0) & (n / F.col("n") >= SUSPICIOUS_ZERO_SHARE), "warning", "ceros_sospechosos", c, n,
                   _text(n, " of ", F.col("n"), f" samples have {c} exactly 0"),
                   "an exact zero often means 'not measured'; consider reading it as missing")
        )
    return out


def _positions(df: DataFrame) -> list[Column]:
    if not {"longitude", "latitude"} <= set(df.columns):
        return [_issue(F.lit(True), "info", "sin_coordenadas", None, F.lit(0), "no coordinates: nothing can be mapped")]
    n, lon, lat = F.col("no_position"), F.col("abs_lon"), F.col("abs_lat")
    projected = F.coalesce(lat > 90, F.lit(False)) | F.coalesce(lon > 180, F.lit(False))
    low_lon, low_lat = F.coalesce(lon, F.lit(0.0)), F.coalesce(lat, F.lit(0.0))
    swapped = ~projected & (F.col("n_lon") > 0) & (low_lat <= 90) & (low_lon <= 90) & (low_lon > low_lat)
    return [
        _issue(n > 0, "warning", "coordenada_incompleta", "longitude", n, _text(n, " sample(s) without full coordinates"),
               "they do not appear on maps"),
        _issue(projected, "info", "coordenadas_proyectadas", None, F.lit(0), "coordinates are not degrees",
               "declare the coordinate system"),
        _issue(swapped, "info", "posible_intercambio", None, F.lit(0), "check that longitude and latitude are not swapped"),
    ]


def _dates(df: DataFrame) -> list[Column]:
    if DATE not in df.columns:
        return [_issue(F.lit(True), "info", "sin_fecha", None, F.lit(0), "no sampling dates: one undated campaign")]
    dated, bad = F.col("n_dated"), F.col("n") - F.col("n_dated")
    days = df.select(F.countDistinct(campaign_day())).scalar()
    return [
        _issue(dated == 0, "info", "sin_fecha", None, F.lit(0), "no sampling dates: one undated campaign"),
        _issue((dated > 0) & (bad > 0), "warning", "fecha_ilegible", DATE, bad, _text(bad, " date(s) could not be read")),
        _issue(dated > 0, "info", "campanas_detectadas", DATE, F.lit(0), _text(days, " distinct sampling date(s)")),
    ]


def duplicate_stations(df: DataFrame) -> DataFrame:
    """Station codes used more than once, with their row counts (partial counts before the shuffle)."""
    counts = df.filter(~_blank_code()).groupBy(F.trim(F.col(STATION).cast("string")).alias(STATION))
    return counts.agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_station_issue(df: DataFrame) -> DataFrame:
    """Repeated codes are a problem only in a table without any date."""
    if STATION not in df.columns:
        return _rows(df.sparkSession.range(1), [_issue(F.lit(False), "warning", "estacion_duplicada", STATION, F.lit(0), "")])
    stats = duplicate_stations(df).agg(F.count("*").alias("codes"), F.sum("n").alias("rows"))
    undated = F.lit(True)
    if DATE in df.columns:
        undated = df.select(F.count(DATE)).scalar() == 0
    codes, rows = F.col("codes"), F.col("rows")
    return _rows(
        stats,
        [
            _issue(undated & (codes > 0), "warning", "estacion_duplicada", STATION, rows,
                   _text(codes, " station code(s) repeated over ", rows, " rows without a date"),
                   "add a date column or tell the codes apart")
        ],
    )


RULES = {
    "identity": _identity,
    "ions": _ions,
    "ranges": _ranges,
    "zeros": _zeros,
    "positions": _positions,
    "dates": _dates,
}


def validate(df: DataFrame, rules: Sequence[str] = tuple(RULES)) -> DataFrame:
    """The issues of the chosen rule families; an empty table raises ``sin_datos`` and nothing else."""
    some = F.col("n") > 0
    found = [i for name in rules for i in RULES[name](df)]
    guarded = [i.withField("raised", some & i["raised"]) for i in found]
    empty = _issue(F.col("n") == 0, "error", "sin_datos", None, F.lit(0), "the table has no samples")
    out = _rows(profile(df), [empty, *guarded])
    return out.unionByName(duplicate_station_issue(df)) if "identity" in rules else out


def rows_read(df: DataFrame, source: str = "table") -> DataFrame:
    stats = df.agg(F.count("*").alias("n"))
    return _rows(
        stats, [_issue(F.lit(True), "info", "filas_leidas", None, F.col("n"), _text(F.col("n"), f" samples read from {source}"))]
    )


def balance_issues(df: DataFrame, acceptable: float = 5.0, marginal: float = 10.0) -> DataFrame:
    stats = df.agg(
        F.count_if(F.col("CBE_flag") == "rejected").alias("rejected"),
        F.count_if(F.col("CBE_flag") == "marginal").alias("marginal"),
    )
    r, m = F.col("rejected"), F.col("marginal")
    return _rows(
        stats,
        [
            _issue(r > 0, "warning", "balance_rechazado", "CBE_pct", r, _text(r, f" sample(s) above {marginal:g} %"),
                   "an ion may be missing or a zero too many"),
            _issue(m > 0, "info", "balance_marginal", "CBE_pct", m,
                   _text(m, f" sample(s) between {acceptable:g} % and {marginal:g} %")),
        ],
    )


def compliance_issues(df: DataFrame, standard) -> DataFrame:
    from limnos.operators.standards import KIND_LABELS, compliance, get_standard

    std = get_standard(standard)
    table = compliance(df, std).filter("n_exceeding > 0")
    kind = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])[F.col("kind")]
    found = table.select(
        F.when(F.col("kind") == "health", "warning").otherwise("info").alias("severity"),
        F.lit("excede_umbral").alias("code"),
        F.col("parameter").alias("field"),
        F.col("n_exceeding").alias("n_rows"),
        _text(F.col("n_exceeding"), " of ", F.col("n_measured"), " measured samples outside ", kind, " limit ",
              F.col("range_text")).alias("message"),
        F.lit(None).cast("string").alias("hint"),
    )
    if std.verified:
        return found
    unchecked = _rows(
        df.sparkSession.range(1),
        [_issue(F.lit(True), "warning", "estandar_sin_cotejar", None, F.lit(0), f"{std.name}: not checked against the official text")],
    )
    return found.unionByName(unchecked)


def crs_issues(df: DataFrame, crs=None) -> DataFrame:
    from limnos.operators.positions import parse_crs, suggest_crs_row

    spark = df.sparkSession
    if not {"longitude", "latitude"} <= set(df.columns):
        return _rows(spark.range(1), [_issue(F.lit(False), "info", "crs_supuesto", None, F.lit(0), "")])
    if crs is not None:
        system = parse_crs(crs)
        return _rows(
            spark.range(1),
            [_issue(F.lit(True), "info", "crs_declarado", None, F.lit(0), f"coordinates read as {system.name} (EPSG:{system.epsg})")],
        )
    degrees = F.col("epsg") == 4326
    return _rows(
        suggest_crs_row(df),
        [
            _issue(degrees, "info", "crs_supuesto", None, F.lit(0), "coordinates look like WGS84 degrees"),
            _issue(~degrees, "warning", "crs_sin_declarar", None, F.lit(0),
                   _text("coordinates look projected; assumed EPSG:", F.col("epsg")),
                   "declare the system: a wrong zone moves points by hundreds of kilometres"),
        ],
    )


def issue_rows(df: DataFrame, key: str = "sample_seq") -> DataFrame:
    """``code, field, <key>`` of every row a row-level rule points at (row-local, no shuffle).

    Rows behind the zero rule are listed for columns that reach its share.
    """
    marks = []

    def mark(when: Column, code: str, field: str) -> None:
        marks.append(F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))))

    if STATION in df.columns:
        mark(_blank_code(), "estacion_vacia", STATION)
    for c in present(df, *PLAUSIBLE_RANGES):
        low, high = PLAUSIBLE_RANGES[c]
        v = number(c)
        mark((v < low) | (v > high), "fuera_de_rango", c)
        mark(v < 0, "valor_negativo", c)
    zeros = suspicious_zero_columns(df)
    shares = df.agg(*[(F.count_if(number(c) == 0) / F.count("*")).alias(c) for c in zeros]) if zeros else None
    for c in zeros:
        mark((number(c) == 0) & (shares.select(c).scalar() >= SUSPICIOUS_ZERO_SHARE), "ceros_sospechosos", c)
    if {"longitude", "latitude"} <= set(df.columns):
        mark(number("longitude").isNull() | number("latitude").isNull(), "coordenada_incompleta", "longitude")
    hits = df.select(key, F.explode(F.array_compact(F.array(*marks))).alias("hit"))
    return hits.select("hit.code", "hit.field", key)


def issue_counts(issues: DataFrame) -> DataFrame:
    """Issues per severity, every severity listed."""
    counts = issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.unpivot([], list(SEVERITIES), "severity", "n")


def sorted_issues(issues: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return issues.orderBy(rank, "code", F.col("field").asc_nulls_first())


def has_errors(issues: DataFrame) -> bool:
    return not issues.filter("severity = 'error'").isEmpty()


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Present, missing, numeric, min, max, mean and exact median per column.

    Dates carry counts only.
    """
    columns = list(df.columns) if columns is None else present(df, *columns)
    kinds = {c: df.schema[c].dataType for c in columns}
    numeric = {
        c: F.lit(None).cast("double") if isinstance(kinds[c], (T.DateType, T.TimestampType, T.BooleanType)) else number(c)
        for c in columns
    }
    parts, rows = [F.count("*").alias("n")], []
    for i, c in enumerate(columns):
        v = numeric[c]
        parts += [
            F.count(c).alias(f"p{i}"), F.count(v).alias(f"k{i}"), F.min(v).alias(f"lo{i}"),
            F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"mean{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"p{i}").alias("n_present"),
                (F.col("n") - F.col(f"p{i}")).alias("n_missing"), F.col(f"k{i}").alias("n_numeric"),
                F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"mean{i}").alias("mean"),
            )
        )
    stats = df.agg(*parts).select(F.inline(F.array(*rows)))
    values = df.select(*[numeric[c].alias(c) for c in columns])
    medians = exact_medians(values, columns, (), hot_rows).select("column", "median")
    return stats.join(medians, "column", "left")
