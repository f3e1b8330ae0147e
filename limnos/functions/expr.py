"""Null-safe column expressions shared by all operators.

Missing is always NULL, never NaN: Spark orders NaN above every number, so one
leaked NaN would turn into a false exceedance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def null() -> Column:
    """Missing double."""
    return F.lit(None).cast("double")


def number(c: Column | str) -> Column:
    """Double with NaN read as missing; unparsable text becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.try_cast("double"), null())


def row_sum(*cols: Column) -> Column:
    """Sum of the present cells of a row; NULL only when every cell is missing."""
    if not cols:
        return null()
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    if len(cols) == 1:
        return cols[0]
    return F.when(F.coalesce(*cols).isNotNull(), total)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or missing."""
    return a / F.nullif(b, F.lit(0.0))


def positive(c: Column) -> Column:
    """The value when it is above zero, otherwise NULL."""
    return F.when(c > 0, c)


def present(df: DataFrame, *names: str) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def col_or_null(df: DataFrame, name: str) -> Column:
    """The named column as double, or NULL when the frame does not carry it."""
    return F.col(name).cast("double") if name in df.columns else null()


def rounded(c: Column, digits: int = 6) -> Column:
    """Presentation rounding; adding zero turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition holds, tested on finished columns.

    A plain filter on long derived columns would be pushed below the steps that
    derive them and repeat all of them inside the predicate; an empty ``inline``
    drops the row in place.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.inline(F.when(condition, F.array(row))))
