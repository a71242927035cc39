"""Tile work lists, box overlaps and missing inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_of(value: Column, low: float, size: float) -> Column:
    """The tile that holds a coordinate; a tile owns its lower edge."""
    return F.floor((value - low) / size).cast("long")


def work_list(spark: SparkSession, lat0: float, lat1: float, lon0: float, lon1: float, tile_lat: float = 0.45, tile_lon: float = 0.75) -> DataFrame:
    """``(key, south, north, west, east)`` of a box's tiles, cut at its far edges."""
    rows, cols = math.ceil((lat1 - lat0) / tile_lat - 1e-9), math.ceil((lon1 - lon0) / tile_lon - 1e-9)
    n = spark.range(rows * cols).withColumns({"_r": F.expr(f"id div {cols}"), "_c": F.col("id") % cols})
    south, west = lat0 + F.col("_r") * tile_lat, lon0 + F.col("_c") * tile_lon
    box = n.select(south.alias("south"), F.least(south + tile_lat, F.lit(lat1)).alias("north"), west.alias("west"), F.least(west + tile_lon, F.lit(lon1)).alias("east"))
    return box.withColumn("key", F.format_string("%.2f_%.2f", "south", "west"))


def chosen(tiles: DataFrame, only: list[str] | None = None, limit: int | None = None, key: str = "key") -> DataFrame:
    """The named tiles, and the first ``limit`` of those in order of their keys."""
    named = tiles if only is None else tiles.where(F.col(key).isin(only))
    return named if limit is None else named.orderBy(key).limit(limit)


def pending(tiles: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """All tiles except those done."""
    return tiles.join(done.select(key).distinct(), key, "left_anti")


def missing(needed: DataFrame, present: DataFrame, key: str = "key") -> DataFrame:
    """Inputs that are needed and not there, once each."""
    return needed.select(key).distinct().join(present.select(key), key, "left_anti")


def overlaps(west: Column, east: Column, south: Column, north: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a box and ``box`` (west, east, south, north) share an area; touching is not enough."""
    w, e, s, n = box
    return (west < e) & (east > w) & (south < n) & (north > s)


def tiles_in_boxes(tiles: DataFrame, boxes: DataFrame, size: float = 3.0) -> DataFrame:
    """Pairs of tiles and boxes that share an area, by an equi-join on a grid of ``size`` degrees instead of a range join.

    Both have ``west, east, south, north``; tiles ``tile``, boxes ``box``. Each is sent to the grid cells that it
    touches; a pair counts in the first cell that both share only, so it comes out once.
    """
    cell = lambda c: F.floor(F.col(c) / size).cast("long")

    def sent(df: DataFrame, name: str) -> DataFrame:
        got = df.select(name, *[F.col(c).alias(f"{name}_{c}") for c in ("west", "east", "south", "north")], F.explode(F.sequence(cell("west"), cell("east"))).alias("_x"), cell("south").alias("_s"), cell("north").alias("_n"), cell("west").alias(f"{name}_x"))
        return got.withColumn("_y", F.explode(F.sequence("_s", "_n"))).withColumn(f"{name}_y", F.col("_s")).drop("_s", "_n")

    a, b = sent(tiles, "tile"), sent(boxes, "box")
    met = a.join(b, ["_x", "_y"]).where((F.col("_x") == F.greatest("tile_x", "box_x")) & (F.col("_y") == F.greatest("tile_y", "box_y")))
    met = met.where((F.col("tile_west") < F.col("box_east")) & (F.col("tile_east") > F.col("box_west")) & (F.col("tile_south") < F.col("box_north")) & (F.col("tile_north") > F.col("box_south")))
    # what of the tile lies in the box
    return met.select("tile", "box", F.greatest("tile_west", "box_west").alias("west"), F.least("tile_east", "box_east").alias("east"), F.greatest("tile_south", "box_south").alias("south"), F.least("tile_north", "box_north").alias("north"))
