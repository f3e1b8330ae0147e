"""Laboratory cells: split raw text into value, detection limit and qualifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.constants import ALL_IONS, PHYSCHEM, mgl
from limnos.functions.expr import null, number, present

# Texts meaning "analysed, not detected"; texts meaning "not analysed"
# need no list, since they hold no number.
NOT_DETECTED = ["nd", "n.d.", "n.d", "no detectado", "not detected", "bdl", "bld", "<ld", "<dl", "ud"]

# Optional comparison mark, then a number with any mix of commas and points.
_CELL = r"^(<=?|>=?)?\s*([-+]?[0-9.,]+(?:[eE][-+]?[0-9]+)?)$"
_BLANKS = " \t\n\r\f\u000b "

def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def decimal_text_to_double(text: Column) -> Column:
    """Number text with decimal comma or thousand marks; the last separator is the decimal one."""
    tail = F.reverse(text)
    comma, point = F.instr(tail, ","), F.instr(tail, ".")
    plain = (
        F.when(comma == 0, text)
        .when(point == 0, F.replace(text, F.lit(","), F.lit(".")))
        .when(comma < point, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .otherwise(F.replace(text, F.lit(","), F.lit("")))
    )
    return plain.try_cast("double")


# Parts of a split cell, kept as temporary columns ``__<part>_<column>``.
PARTS = ("value", "detection_limit", "qualifier", "analysed")


def _part(part: str, name: str) -> str:
    return f"__{part}_{name}"


def split_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the four parts of every cell as temporary columns.

    Text is split in steps (trim, number text, number) so that each step is
    computed once. Anything that is neither a number, a censored number nor a
    known mark counts as not analysed; ``NaN`` text never becomes a number.
    """
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    plain = [c for c in columns if c not in text]
    if text:
        df = df.withColumns({f"__text_{c}": stripped(F.col(c)) for c in text})
        df = df.withColumns({f"__digits_{c}": F.regexp_extract(F.col(f"__text_{c}"), _CELL, 2) for c in text})
        out = {}
        for c in text:
            raw, digits = F.col(f"__text_{c}"), F.col(f"__digits_{c}")
            out[f"__amount_{c}"] = decimal_text_to_double(digits)
            # The number closes the text, so whatever stands before it is the mark.
            out[f"__mark_{c}"] = F.rtrim(F.left(raw, F.length(raw) - F.length(digits)))
            out[f"__nd_{c}"] = F.coalesce(F.lower(raw).isin(NOT_DETECTED), F.lit(False))
        df = df.withColumns(out)
        out = {}
        for c in text:
            amount, mark, nd = (F.col(f"__{k}_{c}") for k in ("amount", "mark", "nd"))
            out[_part("value", c)] = F.when(mark == "", amount)
            out[_part("detection_limit", c)] = F.when(mark != "", amount)
            out[_part("qualifier", c)] = F.when(nd, "nd").when(amount.isNotNull() & (mark != ""), mark)
            out[_part("analysed", c)] = nd | amount.isNotNull()
        df = df.withColumns(out).drop(
            *[f"__{k}_{c}" for k in ("text", "digits", "amount", "mark", "nd") for c in text]
        )
    if plain:
        out = {}
        for c in plain:
            out[_part("value", c)] = number(c)
            out[_part("detection_limit", c)] = null()
            out[_part("qualifier", c)] = F.lit(None).cast("string")
            out[_part("analysed", c)] = number(c).isNotNull()
        df = df.withColumns(out)
    return df


def parse_column(df: DataFrame, name: str, target: str) -> DataFrame:
    """One column as STRUCT<value, detection_limit, qualifier, analysed>."""
    df = split_cells(df, [name])
    cell = F.struct(*[F.col(_part(p, name)).alias(p) for p in PARTS])
    return df.withColumn(target, cell).drop(*[_part(p, name) for p in PARTS])


def limit_column(name: str) -> str:
    return f"{name}__detection_limit"


def measured_columns(df: DataFrame) -> list[str]:
    """Ion and physico-chemical columns the frame carries, in schema order."""
    return present(df, *[mgl(i) for i in ALL_IONS], *PHYSCHEM)


def apply_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Make the measured columns numeric and keep declared limits beside them.

    Every text column gains ``<col>__detection_limit`` so that the schema does
    not depend on the content; numeric columns cannot be censored and gain none.
    """
    columns = measured_columns(df) if columns is None else present(df, *columns)
    text = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    plain = [c for c in columns if c not in text]
    if plain:
        df = df.withColumns({c: number(c) for c in plain})
    if text:
        df = split_cells(df, text)
        df = df.withColumns(
            {c: F.col(_part("value", c)) for c in text}
            | {limit_column(c): F.col(_part("detection_limit", c)) for c in text}
        ).drop(*[_part(p, c) for p in PARTS for c in text])
    return df


def censoring_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: censored, not detected, not analysed and numeric cells (one scan)."""
    columns = measured_columns(df) if columns is None else present(df, *columns)
    df = split_cells(df, columns)
    aggregates, rows = [], []
    for i, name in enumerate(columns):
        value, limit, qualifier, analysed = (F.col(_part(p, name)) for p in PARTS)
        parts = {
            "n_censored": F.count(limit),
            "n_not_detected": F.count_if(qualifier == "nd"),
            "n_not_analysed": F.count_if(~analysed),
            "n_numeric": F.count(value),
        }
        aggregates += [c.alias(f"{key}_{i}") for key, c in parts.items()]
        rows.append(F.struct(F.lit(name).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in parts]))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
