"""Coordinate systems: WGS84 degrees and its UTM zones (Snyder 1987, USGS PP 1395)."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions.expr import null, number

# WGS84 ellipsoid and UTM constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500_000.0
FALSE_NORTHING_SOUTH = 10_000_000.0

E2 = FLATTENING * (2.0 - FLATTENING)
EP2 = E2 / (1.0 - E2)
E4, E6 = E2 * E2, E2 * E2 * E2


@dataclass(frozen=True)
class CRS:
    """Geographic WGS84 (``zone`` is None) or one UTM zone."""

    epsg: int
    zone: int | None = None
    hemisphere: str | None = None

    @property
    def is_geographic(self) -> bool:
        return self.zone is None

    @property
    def name(self) -> str:
        return "WGS 84" if self.is_geographic else f"WGS 84 / UTM {self.zone}{self.hemisphere}"

    @property
    def central_meridian(self) -> float:
        return 0.0 if self.zone is None else 6.0 * self.zone - 183.0


WGS84 = CRS(4326)


def utm(zone: int, hemisphere: str) -> CRS:
    hemisphere = str(hemisphere).strip().upper()[:1]
    if not 1 <= zone <= 60:
        raise ValueError(f"UTM zone out of range: {zone}")
    if hemisphere not in ("N", "S"):
        raise ValueError(f"unknown hemisphere: {hemisphere!r}")
    return CRS((32600 if hemisphere == "N" else 32700) + zone, zone, hemisphere)


def parse_crs(spec) -> CRS:
    """Accepts 4326, "EPSG:32718", "32718", "UTM 18S", "18S", "WGS84" or a CRS."""
    if isinstance(spec, CRS):
        return spec
    text = "" if spec is None else str(spec).strip().upper().replace("_", " ")
    if text in ("", "4326", "EPSG:4326", "WGS84", "WGS 84", "GEOGRAFICAS", "GRADOS", "DD"):
        return WGS84
    code = re.fullmatch(r"(?:EPSG:)?\s*(\d+)(?:\.0)?", text)
    if code:
        family, zone = divmod(int(code.group(1)), 100)
        if family in (326, 327) and 1 <= zone <= 60:
            return utm(zone, "N" if family == 326 else "S")
        raise ValueError(f"EPSG:{code.group(1)} is not supported (4326, 32601-32660, 32701-32760)")
    named = re.fullmatch(r"(?:UTM|ZONA|ZONE|\s)*(\d+)\s*([NS])", text)
    if named:
        return utm(int(named.group(1)), named.group(2))
    raise ValueError(f"unknown coordinate system {spec!r}; try 'EPSG:32718', 'UTM 18S' or 4326")


def crs_table(spark: SparkSession) -> DataFrame:
    """WGS84 and the 120 UTM zones; ``position`` puts 18S, 19S and 17S first."""
    first = {"18S": 1, "19S": 2, "17S": 3}
    zones = spark.range(1, 61).select(
        F.col("id").cast("int").alias("zone"), F.explode(F.array(F.lit("S"), F.lit("N"))).alias("hemisphere")
    )
    code = F.concat("zone", "hemisphere")
    rank = F.coalesce(
        *[F.when(code == k, v) for k, v in first.items()],
        F.when(F.col("hemisphere") == "S", 100).otherwise(200) + F.col("zone"),
    )
    epsg = F.when(F.col("hemisphere") == "N", 32600).otherwise(32700) + F.col("zone")
    geographic = spark.range(1).select(
        F.lit(4326).alias("epsg"), F.lit(None).cast("int").alias("zone"),
        F.lit(None).cast("string").alias("hemisphere"), F.lit(0).alias("position"),
    )
    return geographic.unionByName(zones.select(epsg.alias("epsg"), "zone", "hemisphere", rank.alias("position")))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) % 60 + 1).cast("int")


def zone_meridian(zone: Column) -> Column:
    return zone * 6.0 - 183.0


def suggest_crs_row(df: DataFrame, x: str = "longitude", y: str = "latitude", default_zone: int = 18) -> DataFrame:
    """Suggested EPSG code as one row, from one scan and constant state.

    Degrees when every |x| ≤ 180 and |y| ≤ 90 (or nothing is there), else the
    default zone; south when median(y) > 5 000 000. The side of the median follows
    from counts on both sides; only an exact half split needs the two middle values.
    """
    split = 5_000_000.0
    vx, vy = number(x), number(y)
    stats = df.agg(
        F.count(vx).alias("nx"),
        F.count(vy).alias("ny"),
        F.max(F.abs(vx)).alias("ax"),
        F.max(F.abs(vy)).alias("ay"),
        F.count_if(vy > split).alias("above"),
        F.max(F.when(vy <= split, vy)).alias("below_max"),
        F.min(F.when(vy > split, vy)).alias("above_min"),
    )
    twice, n = F.col("above") * 2, F.col("ny")
    south = (twice > n) | ((twice == n) & ((F.col("below_max") + F.col("above_min")) / 2.0 > split))
    degrees = (F.col("nx") == 0) | (n == 0) | ((F.col("ax") <= 180) & (F.col("ay") <= 90))
    epsg = F.when(degrees, 4326).when(south, 32700 + default_zone).otherwise(32600 + default_zone)
    return stats.select(epsg.alias("epsg"))


def suggest_crs(df: DataFrame, x: str = "longitude", y: str = "latitude", default_zone: int = 18) -> CRS:
    """The suggestion as an object; runs one aggregate."""
    return parse_crs(suggest_crs_row(df, x, y, default_zone).first()["epsg"])


def meridian_arc(phi: Column) -> Column:
    """Distance along the meridian from the equator (Snyder 3-21)."""
    return F.lit(SEMI_MAJOR) * (
        F.lit(1 - E2 / 4 - 3 * E4 / 64 - 5 * E6 / 256) * phi
        - F.lit(3 * E2 / 8 + 3 * E4 / 32 + 45 * E6 / 1024) * F.sin(2.0 * phi)
        + F.lit(15 * E4 / 256 + 45 * E6 / 1024) * F.sin(4.0 * phi)
        - F.lit(35 * E6 / 3072) * F.sin(6.0 * phi)
    )


def _power(c: Column, n: int) -> Column:
    out = c
    for _ in range(n - 1):
        out = out * c
    return out


def add_utm(
    df: DataFrame, crs: CRS, lon: str = "lon_wgs84", lat: str = "lat_wgs84",
    east: str = "utm_e", north: str = "utm_n",
) -> DataFrame:
    """Degrees to metres of one UTM zone (Snyder 8-9, 8-10), in staged projections."""
    if crs.is_geographic:
        raise ValueError("the target must be a UTM zone")
    phi = F.radians(number(lat))
    df = df.withColumns({"__phi": phi, "__t": F.tan(phi), "__cos": F.cos(phi), "__sin": F.sin(phi)})
    df = df.withColumns(
        {
            "__n": F.lit(SEMI_MAJOR) / F.sqrt(1.0 - F.lit(E2) * F.col("__sin") * F.col("__sin")),
            "__t2": F.col("__t") * F.col("__t"),
            "__c": F.lit(EP2) * F.col("__cos") * F.col("__cos"),
            "__a": (F.radians(number(lon)) - F.lit(math.radians(crs.central_meridian))) * F.col("__cos"),
            "__m": meridian_arc(F.col("__phi")),
        }
    )
    n, t, c, a = (F.col(k) for k in ("__n", "__t2", "__c", "__a"))
    x = a + (1.0 - t + c) * _power(a, 3) / 6.0
    x = x + (5.0 - 18.0 * t + t * t + 72.0 * c - 58.0 * EP2) * _power(a, 5) / 120.0
    y = _power(a, 2) / 2.0 + (5.0 - t + 9.0 * c + 4.0 * c * c) * _power(a, 4) / 24.0
    y = y + (61.0 - 58.0 * t + t * t + 600.0 * c - 330.0 * EP2) * _power(a, 6) / 720.0
    shift = FALSE_NORTHING_SOUTH if crs.hemisphere == "S" else 0.0
    df = df.withColumns(
        {
            east: F.lit(FALSE_EASTING) + F.lit(SCALE) * n * x,
            north: F.lit(SCALE) * (F.col("__m") + n * F.col("__t") * y) + F.lit(shift),
        }
    )
    return df.drop("__phi", "__t", "__cos", "__sin", "__n", "__t2", "__c", "__a", "__m")


def add_degrees(
    df: DataFrame, crs: CRS, east: str, north: str, lon: str = "lon_wgs84", lat: str = "lat_wgs84"
) -> DataFrame:
    """Metres of one UTM zone to degrees (Snyder 8-17, 8-18), in staged projections."""
    if crs.is_geographic:
        raise ValueError("the source must be a UTM zone")
    shift = FALSE_NORTHING_SOUTH if crs.hemisphere == "S" else 0.0
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    arc = SCALE * SEMI_MAJOR * (1 - E2 / 4 - 3 * E4 / 64 - 5 * E6 / 256)
    # A point needs both coordinates.
    both = F.when(number(east).isNotNull(), number(north))
    df = df.withColumns(
        {"__mu": (both - F.lit(shift)) / F.lit(arc), "__x": number(east) - F.lit(FALSE_EASTING)}
    )
    mu = F.col("__mu")
    df = df.withColumn(
        "__p",
        mu
        + F.lit(3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2.0 * mu)
        + F.lit(21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4.0 * mu)
        + F.lit(151 * e1**3 / 96) * F.sin(6.0 * mu)
        + F.lit(1097 * e1**4 / 512) * F.sin(8.0 * mu),
    )
    p = F.col("__p")
    df = df.withColumns({"__cos": F.cos(p), "__t": F.tan(p), "__w": 1.0 - F.lit(E2) * F.sin(p) * F.sin(p)})
    df = df.withColumns(
        {
            "__n": F.lit(SEMI_MAJOR) / F.sqrt("__w"),
            "__r": F.lit(SEMI_MAJOR * (1 - E2)) / (F.col("__w") * F.sqrt("__w")),
            "__c": F.lit(EP2) * F.col("__cos") * F.col("__cos"),
            "__t2": F.col("__t") * F.col("__t"),
        }
    ).withColumn("__d", F.col("__x") / (F.col("__n") * F.lit(SCALE)))
    n, r, c, t, d = (F.col(k) for k in ("__n", "__r", "__c", "__t2", "__d"))
    bend = _power(d, 2) / 2.0
    bend = bend - (5.0 + 3.0 * t + 10.0 * c - 4.0 * c * c - 9.0 * EP2) * _power(d, 4) / 24.0
    bend = bend + (61.0 + 90.0 * t + 298.0 * c + 45.0 * t * t - 252.0 * EP2 - 3.0 * c * c) * _power(d, 6) / 720.0
    turn = d - (1.0 + 2.0 * t + c) * _power(d, 3) / 6.0
    turn = turn + (5.0 - 2.0 * c + 28.0 * t - 3.0 * c * c + 8.0 * EP2 + 24.0 * t * t) * _power(d, 5) / 120.0
    df = df.withColumns(
        {
            lon: F.lit(crs.central_meridian) + F.degrees(turn / F.col("__cos")),
            lat: F.degrees(p - (n * F.col("__t") / r) * bend),
        }
    )
    return df.drop("__mu", "__x", "__p", "__cos", "__t", "__w", "__n", "__r", "__c", "__t2", "__d")


def add_wgs84(df: DataFrame, crs=None, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """``lon_wgs84`` / ``lat_wgs84``: copied from degrees, computed from UTM, NULL without coordinates.

    Without a declared system the suggestion is used, which runs one aggregate.
    """
    if x not in df.columns or y not in df.columns:
        return df.withColumns({"lon_wgs84": null(), "lat_wgs84": null()})
    system = suggest_crs(df, x, y) if crs is None else parse_crs(crs)
    if system.is_geographic:
        return df.withColumns({"lon_wgs84": number(x), "lat_wgs84": number(y)})
    return add_degrees(df, system, x, y)


def valid_position(lon: str = "lon_wgs84", lat: str = "lat_wgs84") -> Column:
    """True for points on the globe; missing or out-of-range coordinates are False."""
    ok = F.col(lon).between(-180.0, 180.0) & F.col(lat).between(-90.0, 90.0)
    return F.coalesce(ok, F.lit(False))


def position_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(valid_position()).alias("n_placed"), F.count_if(~valid_position()).alias("n_skipped")
    )
