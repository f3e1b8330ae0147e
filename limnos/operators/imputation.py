"""Missing-value policies: zeros as missing, median and half-limit fills, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.constants import ALL_IONS, mgl
from limnos.functions.cells import limit_column
from limnos.functions.expr import number, present
from limnos.operators.quantiles import HOT_ROWS, exact_medians

METHODS = ("none", "group_median", "global_median", "knn", "half_detection_limit")
MIN_GROUP_SIZE = 3
NO_OBSERVATION = "no observed value; the parameter was not measured"


def ion_columns(df: DataFrame) -> list[str]:
    return present(df, *[mgl(i) for i in ALL_IONS])


def imputed_column(name: str) -> str:
    return f"{name}__imputed"


def zeros_as_missing(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Values at or below the threshold become missing in the named columns only."""
    columns = present(df, *columns)
    return df.withColumns({c: F.when(number(c) > threshold, number(c)) for c in columns}) if columns else df


def zero_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact zeros per ion; only ions that have any."""
    columns = ion_columns(df) if columns is None else present(df, *columns)
    counts = df.agg(*[F.count_if(number(c) == 0).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_zeros").filter("n_zeros > 0")


def group_medians(
    df: DataFrame, columns: Sequence[str], group: str = "group", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``group, column, n, median`` of every group that has a name."""
    return exact_medians(df.filter(F.col(group).isNotNull()), columns, [group], hot_rows)


def _flagged(df: DataFrame, filled: dict[str, str]) -> DataFrame:
    """Swap in the filled columns and mark the cells they completed."""
    return df.withColumns(
        {imputed_column(c): F.col(c).isNull() & F.col(t).isNotNull() for c, t in filled.items()}
        | {c: F.col(t) for c, t in filled.items()}
    ).drop(*filled.values())


def overall_medians(df: DataFrame, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> dict[str, float | None]:
    """The median of each column over all rows: one row for each column comes back."""
    found = {r["column"]: r["median"] for r in exact_medians(df, columns, (), hot_rows).collect()}
    return {c: found.get(c) for c in columns}


def _median_fill(df: DataFrame, columns: list[str], group: str | None, min_size: int, hot_rows: int) -> DataFrame:
    if group is None:
        values = overall_medians(df, columns, hot_rows)
        df = df.withColumns({f"__fill_{c}": F.coalesce(F.col(c), F.lit(values[c]).cast("double")) for c in columns})
    else:
        usable = F.when(F.col("n") >= min_size, F.col("median"))
        wide = (
            group_medians(df, columns, group, hot_rows)
            .groupBy(F.col(group).alias("__group"))
            .agg(*[F.max(F.when(F.col("column") == c, usable)).alias(f"__m_{c}") for c in columns])
        )
        # No broadcast hint: the number of groups is not bounded, sizes decide at run time.
        df = df.join(wide, F.col(group) == F.col("__group"), "left")
        df = df.withColumns({f"__fill_{c}": F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in columns})
        df = df.drop("__group", *[f"__m_{c}" for c in columns])
    return _flagged(df, {c: f"__fill_{c}" for c in columns})


def _half_limit_fill(df: DataFrame, columns: list[str], left_censored_only: bool) -> DataFrame:
    """Half of the declared limit; a column without any observed value stays missing.

    Limits of "above" cells are halved too, as laboratories using this policy do,
    unless ``left_censored_only`` is set (needs ``<col>__qualifier``).
    """
    observed = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    filled = {}
    for c in columns:
        limit = limit_column(c)
        if limit not in df.columns:
            filled[f"__fill_{c}"] = F.col(c)
            continue
        half = F.col(limit) / 2.0
        if left_censored_only:
            half = F.when(F.col(f"{c}__qualifier").startswith("<"), half)
        filled[f"__fill_{c}"] = F.coalesce(F.col(c), half) if observed[c] else F.col(c)
    return _flagged(df.withColumns(filled), {c: f"__fill_{c}" for c in columns})


def impute(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "none",
    group: str | None = "group",
    min_group_size: int = MIN_GROUP_SIZE,
    neighbours: int = 5,
    left_censored_only: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Fill missing ions and mark every filled cell in ``<col>__imputed``."""
    if method not in METHODS:
        raise ValueError(f"unknown imputation method {method!r}; known: {METHODS}")
    columns = ion_columns(df) if columns is None else present(df, *columns)
    if method == "group_median" and (group is None or group not in df.columns):
        method = "none"
    if method == "none" or not columns:
        return df.withColumns({imputed_column(c): F.lit(False) for c in columns}) if columns else df
    if method == "knn":
        from limnos.operators.neighbours import knn_fill

        return knn_fill(df, columns, neighbours)
    if method == "half_detection_limit":
        return _half_limit_fill(df, columns, left_censored_only)
    return _median_fill(df, columns, group if method == "group_median" else None, min_group_size, hot_rows)


def imputation_log(df: DataFrame, columns: Sequence[str] | None = None, method: str = "none") -> DataFrame:
    """Outcome per column of an imputed frame (one scan)."""
    columns = ion_columns(df) if columns is None else present(df, *columns)
    aggregates, rows = [F.count("*").alias("n")], []
    for i, c in enumerate(columns):
        aggregates += [
            F.count_if(F.col(imputed_column(c))).alias(f"filled_{i}"),
            F.count_if(F.col(c).isNull()).alias(f"left_{i}"),
        ]
        filled, left = F.col(f"filled_{i}"), F.col(f"left_{i}")
        empty = (filled + left == F.col("n")) & (F.lit(method) != "none")
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                (filled + left).alias("n_missing_before"),
                filled.alias("n_imputed"),
                left.alias("n_missing_after"),
                F.lit(method).alias("method"),
                F.when(empty, NO_OBSERVATION).alias("skipped_reason"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
