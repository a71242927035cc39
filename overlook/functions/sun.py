"""Where the sun stands: the public NOAA solar equations as columns. Sessions must run in UTC."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlook.functions.geo import clip

#: Half the sun's width; the centre's geometric elevation at sunset; the lowest useful sun.
SEMIDIAMETER = 0.2665
HORIZON = -0.833
LOWEST = -1.0


def sunset_azimuth(lat: Column, day_of_year: Column) -> Column:
    """Bearing of sunset from a cosine of the declination; polar day and night are held at north and south."""
    declination = F.radians(F.lit(-23.44) * F.cos(F.radians(360 / 365.25 * (day_of_year + 10))))
    return F.lit(360.0) - F.degrees(F.acos(clip(F.sin(declination) / F.cos(F.radians(lat)), -1.0, 1.0)))


def refraction_arcsec(elevation: Column) -> Column:
    """Four pieces: nothing near the zenith, a series, a polynomial near the horizon, and a tail below it."""
    t = F.tan(F.radians(elevation))
    series = F.lit(58.1) / t - 0.07 / F.pow(t, F.lit(3.0)) + 0.000086 / F.pow(t, F.lit(5.0))
    e = elevation
    low = 1735 + e * (-518.2 + e * (103.4 + e * (-12.79 + e * 0.711)))
    return F.when(e > 85, 0.0).when(e > 5, series).when(e > -0.575, low).otherwise(F.lit(-20.772) / t)


def with_instant(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds ``declination``, ``equation_minutes`` and ``utc_minutes``: what hangs on the instant alone."""
    at = F.col(ts).cast("timestamp")
    sin, cos, rad = F.sin, F.cos, F.radians
    df = df.withColumn("_t", (F.unix_millis(at) / F.lit(86400000.0) + 2440587.5 - 2451545.0) / 36525.0)
    t = F.col("_t")
    df = df.withColumns({
        "_long": F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0)),
        "_anom": 357.52911 + t * (35999.05029 - 0.0001537 * t),
        "_ecc": 0.016708634 - t * (0.000042037 + 0.0000001267 * t),
        "_node": 125.04 - 1934.136 * t,
    })
    m = rad("_anom")
    centre = sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * m) * (0.019993 - 0.000101 * t) + sin(3 * m) * 0.000289
    tilt = 23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60
    df = df.withColumns({"_app": F.col("_long") + centre - 0.00569 - 0.00478 * sin(rad("_node")), "_obl": tilt + 0.00256 * cos(rad("_node"))})
    df = df.withColumns({"declination": F.degrees(F.asin(sin(rad("_obl")) * sin(rad("_app")))), "_y": F.pow(F.tan(rad(F.col("_obl") / 2)), F.lit(2.0))})
    y, e, el = F.col("_y"), F.col("_ecc"), rad("_long")
    minutes = 4 * F.degrees(y * sin(2 * el) - 2 * e * sin(m) + 4 * e * y * sin(m) * cos(2 * el) - 0.5 * y * y * sin(4 * el) - 1.25 * e * e * sin(2 * m))
    day = F.pmod(F.unix_millis(at), F.lit(86400000).cast("long"))
    df = df.withColumns({"equation_minutes": minutes, "utc_minutes": F.floor(day / F.lit(1000.0)) / 60.0})
    return df.drop("_t", "_long", "_anom", "_ecc", "_node", "_app", "_obl", "_y")


def hour_angle(lon: Column) -> Column:
    """0 at noon by the sun, 15 degrees an hour."""
    return F.pmod(F.col("utc_minutes") + F.col("equation_minutes") + 4 * lon, F.lit(1440.0)) / 4 - 180


def with_position(df: DataFrame, ts: str = "ts", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds ``declination``, ``geometric``, ``elevation`` (refracted) and ``azimuth`` in degrees."""
    sin, cos, rad = F.sin, F.cos, F.radians
    df = with_instant(df, ts).withColumn("_ha", hour_angle(F.col(lon)))
    la, de = rad(lat), rad("declination")
    df = df.withColumn("_zen", F.degrees(F.acos(clip(sin(la) * sin(de) + cos(la) * cos(de) * cos(rad("_ha")), -1.0, 1.0))))
    z = rad("_zen")
    north = F.degrees(F.acos(clip((sin(la) * cos(z) - sin(de)) / (cos(la) * sin(z)), -1.0, 1.0)))
    azimuth = F.when(F.abs(sin(z)) <= 1e-9, 180.0).when(F.col("_ha") > 0, F.pmod(north + 180, F.lit(360.0))).otherwise(F.pmod(540 - north, F.lit(360.0)))
    df = df.withColumns({"geometric": 90 - F.col("_zen"), "azimuth": azimuth})
    df = df.withColumn("elevation", F.col("geometric") + refraction_arcsec(F.col("geometric")) / 3600)
    return df.drop("_ha", "_zen", "equation_minutes", "utc_minutes")


def tan_upper_limb(s: Column) -> Column:
    """Tangent of the upper limb's apparent elevation, from the sine of the centre's true elevation.

    Refraction and half the width are carried onto the tangent by its derivative; near the zenith the plain tangent does.
    """
    tan = s / F.sqrt(1 - s * s)
    degrees = F.degrees(s * (1 + s * s / 6))
    series = F.lit(58.1) / tan - 0.07 / F.pow(tan, F.lit(3.0)) + 0.000086 / F.pow(tan, F.lit(5.0))
    low = 1735 + degrees * (-518.2 + degrees * (103.4 + degrees * (-12.79 + degrees * 0.711)))
    arcsec = F.when(s > math.sin(math.radians(5)), series).when(degrees > -0.575, low).otherwise(F.lit(-20.772) / F.radians(degrees))
    lift = F.radians(arcsec / 3600 + SEMIDIAMETER)
    return F.when(s > math.sin(math.radians(85)), tan).otherwise(tan + lift * (1 + tan * tan))


def with_sun_tangent(df: DataFrame, ts: str = "ts", lat: str = "lat", lon: str = "lon", name: str = "sun_tangent") -> DataFrame:
    """Adds the tangent of the upper limb at each row's place and instant."""
    df = with_instant(df, ts)
    s = F.sin(F.radians(lat)) * F.sin(F.radians("declination")) + F.cos(F.radians(lat)) * F.cos(F.radians("declination")) * F.cos(F.radians(hour_angle(F.col(lon))))
    return df.withColumn(name, tan_upper_limb(s)).drop("declination", "equation_minutes", "utc_minutes")


def with_separable_tangent(cells: DataFrame, when: str, lat0: float, dlat: float, lon0: float, dlon: float, edges: tuple[int, int, int, int], name: str = "sun_tangent") -> DataFrame:
    """Adds the same tangent to cells ``iy, ix`` of a latitude-longitude grid at one instant (UTC).

    A row's latitude and a column's hour angle are worked out once each, in two tables of a raster's rows and columns
    (``edges``: first and last of both), and meet in the cell: no trigonometry of place is left there.
    """
    spark = cells.sparkSession
    line = lambda first, last, key, lat, lon: with_instant(spark.range(first, last + 1).select(F.col("id").alias(key), F.lit(when).cast("timestamp").alias("ts"), lat.alias("_lat"), lon.alias("_lon")))
    by_row = line(edges[0], edges[1], "iy", lat0 + F.col("id") * dlat, F.lit(lon0))
    by_row = by_row.select("iy", (F.sin(F.radians("_lat")) * F.sin(F.radians("declination"))).alias("_up"), (F.cos(F.radians("_lat")) * F.cos(F.radians("declination"))).alias("_level"))
    by_col = line(edges[2], edges[3], "ix", F.lit(lat0), lon0 + F.col("id") * dlon).select("ix", F.cos(F.radians(hour_angle(F.col("_lon")))).alias("_turn"))
    return cells.join(by_row, "iy").join(by_col, "ix").withColumn(name, tan_upper_limb(F.col("_up") + F.col("_level") * F.col("_turn"))).drop("_up", "_level", "_turn")


def horizon_crossing(places: DataFrame, day: str = "day", lat: str = "lat", lon: str = "lon", setting: bool = True, key: list[str] | None = None) -> DataFrame:
    """``key`` columns with ``minute`` (of the UTC day) at which the sun first sets or rises; null where it does not.

    Each place and day is spread over its 1441 minutes and folded again by a grouped minimum; a minute's predecessor is
    computed beside it, so nothing is sorted.
    """
    key = key or [day, lat, lon]
    minutes = places.select(*key, F.explode(F.sequence(F.lit(0), F.lit(1440))).alias("minute"))
    at = lambda back: F.timestamp_millis((F.unix_date(F.col(day)).cast("long") * 86400 + (F.col("minute") - back) * 60) * 1000)
    both = with_position(minutes.withColumns({"_ts": at(0), "_tb": at(1)}), "_ts", lat, lon).withColumn("up", F.col("geometric") > HORIZON)
    both = with_position(both.drop("declination", "geometric", "azimuth", "elevation"), "_tb", lat, lon).withColumn("was", F.col("geometric") > HORIZON)
    cross = (F.col("minute") > 0) & (F.col("up") != F.col("was")) & (F.col("up") != F.lit(setting))
    return both.groupBy(*key).agg(F.min(F.when(cross, F.col("minute"))).alias("minute"))


def arc(day: int, minutes: np.ndarray, lat: float, lon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(geometric elevation, refracted elevation, azimuth) at minutes of a UTC day (days since 1970), by the same equations on arrays."""
    t = (day + minutes / 1440 + 2440587.5 - 2451545.0) / 36525.0
    long, anomaly = np.radians((280.46646 + t * (36000.76983 + t * 0.0003032)) % 360), np.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    eccentric, node = 0.016708634 - t * (0.000042037 + 0.0000001267 * t), np.radians(125.04 - 1934.136 * t)
    centre = np.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + np.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + np.sin(3 * anomaly) * 0.000289
    apparent = np.radians(np.degrees(long) + centre - 0.00569 - 0.00478 * np.sin(node))
    tilt = np.radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * np.cos(node))
    declination, y = np.arcsin(np.sin(tilt) * np.sin(apparent)), np.tan(tilt / 2) ** 2
    equation = 4 * np.degrees(y * np.sin(2 * long) - 2 * eccentric * np.sin(anomaly) + 4 * eccentric * y * np.sin(anomaly) * np.cos(2 * long) - 0.5 * y * y * np.sin(4 * long) - 1.25 * eccentric**2 * np.sin(2 * anomaly))
    hour = ((minutes % 1440 + equation + 4 * lon) % 1440) / 4 - 180
    la = math.radians(lat)
    zenith = np.arccos(np.clip(math.sin(la) * np.sin(declination) + math.cos(la) * np.cos(declination) * np.cos(np.radians(hour)), -1, 1))
    geometric, level = 90 - np.degrees(zenith), np.abs(np.sin(zenith)) <= 1e-9
    north = np.degrees(np.arccos(np.clip((math.sin(la) * np.cos(zenith) - np.sin(declination)) / np.where(level, 1.0, math.cos(la) * np.sin(zenith)), -1, 1)))
    azimuth = np.where(level, 180.0, np.where(hour > 0, north + 180, 540 - north) % 360)
    with np.errstate(divide="ignore", invalid="ignore"):
        tan = np.tan(np.radians(geometric))
        low = 1735 + geometric * (-518.2 + geometric * (103.4 + geometric * (-12.79 + geometric * 0.711)))
        lift = np.select([geometric > 85, geometric > 5, geometric > -0.575], [0.0, 58.1 / tan - 0.07 / tan**3 + 0.000086 / tan**5, low], -20.772 / tan)
    return geometric, geometric + lift / 3600, azimuth
