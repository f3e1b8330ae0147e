"""Sampling dates: never invented, ISO first, day-first formats only as a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE = "sampled_at"

# Accepted non-ISO layouts, in the order they are tried.
_DAY_FIRST = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy"]
_MONTH_FIRST = ["M/d/yyyy", "M-d-yyyy"]
_CLOCK = ["", " H:mm", " H:mm:ss"]


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text to TIMESTAMP_NTZ-like wall time in the session zone; NULL when it is not a date."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{2}(-\d{2}([T ].*)?)?$"), text.try_cast("timestamp"))


def loose_timestamp(c: Column) -> Column:
    text = F.trim(c)
    tries = [
        F.try_to_timestamp(text, F.lit(layout + clock))
        for layout in _DAY_FIRST + _MONTH_FIRST
        for clock in _CLOCK
    ]
    return F.coalesce(iso_timestamp(c), *tries)


def normalise_dates(df: DataFrame, column: str = DATE) -> DataFrame:
    """Turn the date column into TIMESTAMP.

    The column is read as ISO when any value is ISO; otherwise day-first layouts
    are tried value by value. The choice is a scalar subquery (one ``max`` over
    the column), so no action runs here.
    """
    if column not in df.columns:
        return df
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StringType):
        return df
    any_iso = df.agg(F.coalesce(F.max(iso_timestamp(F.col(column)).isNotNull()), F.lit(True))).scalar()
    return df.withColumn(
        column,
        F.when(any_iso, iso_timestamp(F.col(column))).otherwise(loose_timestamp(F.col(column))),
    )


def campaign_day(c: Column | str = DATE) -> Column:
    return F.to_date(F.col(c) if isinstance(c, str) else c)


def day_text(c: Column | str = DATE) -> Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd")


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days with fraction; dates and timestamps alike."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)
