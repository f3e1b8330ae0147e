"""Synthetic campaigns grown from measured stations (load generator)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sampling days of the drift profile.
CAMPAIGN_DAYS = (
    "2021-04-12", "2021-10-18", "2022-04-11", "2022-10-17",
    "2023-04-10", "2023-10-16", "2024-04-15", "2024-10-21",
)
# Drift per ion (slope of the change over the campaigns).
DRIFT = {"Na_mgL": 3.0, "Cl_mgL": 3.4, "SO4_mgL": 1.2, "Ca_mgL": -0.6, "Mg_mgL": -0.3, "HCO3_mgL": -0.25, "K_mgL": 0.0, "F_mgL": 0.0}
NOISE = 0.03


def _noise(key: Column, k: Column, salt: int) -> Column:
    """Repeatable factor within ±3 %, from the station key and the campaign."""
    return 1.0 + NOISE * (((key * 7919 + k * 104729 + F.lit(salt * 1299709)) % 2001) - 1000) / 1000.0


def drifting_campaigns(stations: DataFrame, key: str = "sample_seq") -> DataFrame:
    """Eight dated campaigns per station with a slow drift to sodium chloride water.

    Every station row is expanded in place, so the work is a scan.
    """
    days = F.array(*[F.lit(d).cast("date") for d in CAMPAIGN_DAYS])
    out = stations.select("*", F.posexplode(days).alias("__k", "__day"))
    k = F.col("__k")
    strength = 0.05 + 0.30 * (F.col(key) % 12) / 11.0
    progress = k / (len(CAMPAIGN_DAYS) - 1)
    changed = {
        c: F.round(F.col(c) * (1.0 + strength * progress * slope) * _noise(F.col(key), k, i), 2)
        for i, (c, slope) in enumerate(DRIFT.items())
        if c in stations.columns
    }
    out = out.withColumns(changed | {"sampled_at": F.col("__day"), "campaign": F.format_string("C%02d", k + 1)})
    return out.drop("__k", "__day")


# Three zones with growing salinity and their campaigns.
ZONES = ("Acuifero superior", "Zona de transicion", "Cuna salina")
ZONE_DAYS = ("2024-03-18", "2024-09-16", "2025-03-17")
FACTORS = (1.0, 2.0, 4.0)


def zoned_campaigns(stations: DataFrame, key: str = "sample_seq") -> DataFrame:
    """Three campaigns per station in three zones, with closed charge balance, censored cells and gaps.

    Cells are laboratory text (``<0,05``, ``ND``); one magnesium in 23 is left blank.
    """
    days = F.array(*[F.lit(d).cast("date") for d in ZONE_DAYS])
    out = stations.select("station_code", key, "longitude", "latitude", F.posexplode(days).alias("__k", "sampled_at"))
    zone = F.col(key) % 3
    factor = F.get(F.array(*[F.lit(f) for f in FACTORS]), zone.cast("int"))
    total = factor * (4.0 + (F.col(key) % 7) * 0.5) * (1.0 + F.when(zone == 2, 0.16).otherwise(0.03) * F.col("__k"))
    shares = {"Ca": (0.40, 20.039), "Mg": (0.20, 12.1525), "Na": (0.40, 22.989769), "HCO3": (0.5, 61.016), "SO4": (0.2, 48.028), "Cl": (0.3, 35.45)}
    ions = {f"{i}_mgL": F.round(total * s * w, 2).cast("string") for i, (s, w) in shares.items()}
    ions["Mg_mgL"] = F.when(F.col(key) % 23 != 0, ions["Mg_mgL"])
    ions["F_mgL"] = F.when(zone == 0, "<0,05").otherwise(F.concat(zone, F.lit(","), F.col(key) % 10))
    ions["NO3_mgL"] = F.when(F.col(key) % 11 == 0, "ND").otherwise(F.round(2 + F.col(key) % 26, 1).cast("string"))
    return out.select(
        "station_code", F.get(F.array(*[F.lit(z) for z in ZONES]), zone.cast("int")).alias("group"),
        "sampled_at", F.format_string("C%02d", F.col("__k") + 1).alias("campaign"), "longitude", "latitude",
        *[c.alias(name) for name, c in ions.items()],
    )
