"""Water samples derived from the order-line tables.

Spark and the SQL check build the samples from the same list of formulas, so the
two derivations cannot drift apart. ``F_mgL`` and ``NO3_mgL`` stay raw laboratory
text (censored marks, decimal commas); everything else is typed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.session import prepare

_KEYS = [
    ("ok", "l_orderkey"),
    ("ln", "l_linenumber"),
]
_MINS = [
    ("pk", "l_partkey"),
    ("sk", "l_suppkey"),
    ("q", "l_quantity"),
    ("tx", "l_tax"),
    ("sd", "l_shipdate"),
]

# Formulas valid in Spark SQL and in DuckDB alike, in dependency order.
_BASE = [
    ("ca0", "10.0D + 2.0D * q"),
    ("mg0", "CAST(2 + pk % 40 AS DOUBLE)"),
    ("na0", "CAST(5 + (ok * 7919) % 397 AS DOUBLE)"),
    ("k0", "0.5D + 1.1D * ln"),
    ("wh", "CAST(1 + pk % 9 AS DOUBLE)"),
    ("ws", "CAST(1 + ok % 5 AS DOUBLE)"),
    ("wc", "CAST(1 + ok % 7 AS DOUBLE)"),
]
_TOTAL = [
    (
        "ta",
        "(ca0 / 20.039D + mg0 / 12.1525D + na0 / 22.989769D + k0 / 39.0983D) * (0.78D + 5.5D * tx)",
    ),
    ("wt", "wh + ws + wc"),
]
_CANONICAL = [
    ("sample_seq", "ok * 10 + ln"),
    ("station_code", "'ST-' || CAST(sk AS STRING)"),
    ("grp", "n_name"),
    ("sampled_at", "CAST(date_trunc('month', sd) AS DATE)"),
    ("longitude", "CAST(200000 + (sk * 7919) % 600000 AS DOUBLE)"),
    ("latitude", "CAST(8000000 + (sk * 104729) % 1500000 AS DOUBLE)"),
    ("ph", "CASE WHEN ok % 29 = 0 THEN NULL ELSE 6.2D + (pk % 30) / 10.0D END"),
    ("temp_c", "CAST(15 + ln AS DOUBLE)"),
    ("tds_mgl", "ca0 + mg0 + na0 + k0 + 30.0D * ta"),
    ("Ca_mgL", "ca0"),
    ("Mg_mgL", "CASE WHEN ok % 23 = 0 OR ok % 97 = 0 THEN NULL ELSE mg0 END"),
    ("Na_mgL", "na0"),
    ("K_mgL", "CASE WHEN ok % 31 = 0 OR ok % 97 = 0 THEN NULL ELSE k0 END"),
    ("HCO3_mgL", "ta * (wh / wt) * 61.016D"),
    ("CO3_mgL", "CASE WHEN ln = 7 THEN 12.4D ELSE 0.0D END"),
    ("SO4_mgL", "CASE WHEN ok % 97 = 0 THEN NULL ELSE ta * (ws / wt) * 48.028D END"),
    ("Cl_mgL", "ta * (wc / wt) * 35.45D"),
    (
        "F_mgL",
        "CASE ok % 10 WHEN 0 THEN '<0,05' WHEN 1 THEN 'ND' WHEN 2 THEN '' WHEN 3 THEN '0' "
        "WHEN 4 THEN '0' ELSE CAST(ok % 4 AS STRING) || ',' || CAST(pk % 10 AS STRING) END",
    ),
    (
        "NO3_mgL",
        "CASE ok % 13 WHEN 0 THEN 'ND' WHEN 1 THEN NULL WHEN 2 THEN '>100' "
        "ELSE CAST(pk % 60 AS STRING) || '.' || CAST(ok % 10 AS STRING) END",
    ),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical sample table: one row per (order, line), F and NO3 as raw text.

    The two dimension joins carry no hint: their size grows with the data, so the
    join strategy is left to the measured sizes.
    """
    prepare(spark)
    lines = (
        table(spark, sf_dir, "lineitem")
        .select(*[F.col(src).alias(name) for name, src in _KEYS + _MINS])
        .groupBy("ok", "ln")
        .agg(*[F.min(name).alias(name) for name, _ in _MINS])
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = lines.join(suppliers, F.col("sk") == F.col("s_suppkey")).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    for step in (_BASE, _TOTAL):
        joined = joined.select("*", *[F.expr(sql).alias(name) for name, sql in step])
    return joined.select(
        *[F.expr(sql).alias("group" if name == "grp" else name) for name, sql in _CANONICAL]
    )


def samples_sql() -> str:
    """The same derivation as DuckDB text: ``CREATE``-free CTE list ending in ``samples``."""

    def items(step):
        out = []
        for name, sql in step:
            sql = re.sub(r"(\d)D\b", r"\1::DOUBLE", sql)
            out.append(f'{sql} AS "{"group" if name == "grp" else name}"')
        return ", ".join(out)

    keys = ", ".join(f"{src} AS {name}" for name, src in _KEYS)
    mins = ", ".join(f"min({src}) AS {name}" for name, src in _MINS)
    by = ", ".join(src for _, src in _KEYS)
    return (
        f"lines AS (SELECT {keys}, {mins} FROM lineitem GROUP BY {by}),\n"
        "located AS (SELECT lines.*, n_name FROM lines JOIN supplier ON sk = s_suppkey "
        "JOIN nation ON s_nationkey = n_nationkey),\n"
        f"base AS (SELECT *, {items(_BASE)} FROM located),\n"
        f"tot AS (SELECT *, {items(_TOTAL)} FROM base),\n"
        f"samples AS (SELECT {items(_CANONICAL)} FROM tot)"
    )
