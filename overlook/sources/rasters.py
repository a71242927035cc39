"""Readers of raw elevation tiles, tile indices, region metadata and landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlook.sources import ranged

#: Rows of a one-degree tile; the columns follow from the file's size. Fixed value of the format.
ROWS = 3600


def read_elevation(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """``(lat_i, lon_i, row, col, ncols, z)`` of raw little-endian int16 tiles called ``<lat>_<lon>``; row 0 is north, the nodata number is null."""
    return ranged.read_raw(spark, path, rows)


def read_mosaic(spark: SparkSession, path: str, lat_high: int, lon_low: int, rows: int = ROWS) -> DataFrame:
    """``(iy, ix, z)`` of a folder of tiles set side by side, row 0 in the north; what must hold is asked of the files' names and sizes alone.

    Tiles of several latitude bands are an error, as is a mosaic whose first tile, in the north-west, is missing; other
    missing tiles are missing rows.
    """
    found = ranged.tile_list(path, rows)
    if not any((lat, lon) == (lat_high, lon_low) for _, lat, lon, _ in found):
        raise FileNotFoundError(f"tile {lat_high}_{lon_low} is missing")
    if len({cols for *_, cols in found}) > 1:
        raise ValueError("tiles of several latitude bands do not fit one mosaic")
    return _placed(ranged.read_raw(spark, path, rows), lat_high, lon_low, rows, found[0][3])


def _placed(tiles: DataFrame, lat_high: int, lon_low: int, rows: int, cols: int) -> DataFrame:
    return tiles.select(((lat_high - F.col("lat_i")) * rows + F.col("row")).cast("long").alias("iy"), ((F.col("lon_i") - lon_low) * cols + F.col("col")).cast("long").alias("ix"), "z")


def mosaic(tiles: DataFrame, lat_high: int, lon_low: int, rows: int = ROWS) -> DataFrame:
    """``(iy, ix, z)`` of tiles set side by side, row 0 in the north; missing tiles are missing rows.

    Tiles of one mosaic must have one column count; tiles of several raise an error, as does a mosaic whose first tile,
    in the north-west, is missing.
    """
    if tiles.where((F.col("lat_i") == lat_high) & (F.col("lon_i") == lon_low)).isEmpty():
        raise FileNotFoundError(f"tile {lat_high}_{lon_low} is missing")
    bands = [r[0] for r in tiles.select("ncols").distinct().limit(2).collect()]
    if len(bands) > 1:
        raise ValueError("tiles of several latitude bands do not fit one mosaic")
    return _placed(tiles, lat_high, lon_low, rows, bands[0] if bands else 0)


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """``(tile, west, east, south, north)`` of a GeoJSON feature collection of polygons."""
    feature = spark.read.schema("features array<struct<geometry:struct<coordinates:array<array<array<double>>>>,properties:struct<tile:string>>>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    ring = F.flatten("f.geometry.coordinates")
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return feature.select(F.col("f.properties.tile").alias("tile"), F.array_min(x).alias("west"), F.array_max(x).alias("east"), F.array_min(y).alias("south"), F.array_max(y).alias("north"))


REGION = "lat0 double, lat1 double, lon0 double, lon1 double, rows int, cols int, azimuths int, obs_m double, max_dist_km double, eyes array<struct<cm:int,m:double>>, veg array<string>"


def read_region(spark: SparkSession, path: str) -> DataFrame:
    """A region's metadata, one row."""
    return spark.read.schema(REGION).json(path, multiLine=True)


CANOPY = "cell double, col0 double, row0 double, cols int, rows int, half double, r_earth double"


def read_canopy(spark: SparkSession, path: str) -> DataFrame:
    """The affine values of a canopy raster, one row."""
    return spark.read.schema(CANOPY).json(path, multiLine=True)


def variants(region: DataFrame) -> DataFrame:
    """``(veg, eye_cm)``: every signature set that the metadata names."""
    return region.select(F.explode("veg").alias("veg"), "eyes").select("veg", F.explode("eyes.cm").alias("eye_cm"))
