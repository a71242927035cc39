"""Lattices of cells and observers, and sampling of rasters at points.

A raster is a table of cells ``(iy, ix, z)``. Sampling joins points to cells by integer keys; a raster's four corner
values are brought together once, so that a bilinear sample is one equi-join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlook.functions.geo import half_up, known, metres_per_degree_at


def lattice(spark: SparkSession, rows: int, cols: int, y0: float = 0.0, x0: float = 0.0, dy: float = 1.0, dx: float = 1.0) -> DataFrame:
    """``(obs_id, iy, ix, y, x)`` of a dense grid, generated in parallel; obs_id counts along rows."""
    n = spark.range(rows * cols).withColumnRenamed("id", "obs_id")
    n = n.withColumns({"iy": F.expr(f"obs_id div {cols}"), "ix": F.col("obs_id") % cols})
    return n.withColumns({"y": y0 + F.col("iy") * float(dy), "x": x0 + F.col("ix") * float(dx)})


def metric_lattice(spark: SparkSession, half_km: float, step: float, half_km_x: float | None = None) -> DataFrame:
    """Observers every ``step`` metres around a centre, row 0 in the south."""
    ny, nx = (int(round(2000 * h / step)) + 1 for h in (half_km, half_km if half_km_x is None else half_km_x))
    return lattice(spark, ny, nx, -(ny - 1) / 2 * step, -(nx - 1) / 2 * step, step, step)


def region_lattice(spark: SparkSession, lat0: float, lat1: float, lon0: float, lon1: float, step: float = 100.0) -> DataFrame:
    """``(obs_id, iy, ix, lat, lon)`` every ``step`` metres of a box, by the scale at its middle latitude."""
    north, east = metres_per_degree_at((lat0 + lat1) / 2)
    rows, cols = (int(math.floor((b - a + 1e-9) / (step / m))) + 1 for a, b, m in ((lat0, lat1, north), (lon0, lon1, east)))
    return lattice(spark, rows, cols, lat0, lon0, step / north, step / east).withColumnsRenamed({"y": "lat", "x": "lon"})


def corners(cells: DataFrame, value: str = "z", iy: str = "iy", ix: str = "ix", tile: list[str] | None = None) -> DataFrame:
    """Cells with ``z00, z01, z10, z11``: own value and those one up in x, y and both, by one grouped pass.

    Each cell is sent to the four keys that it is a corner of; only keys with all four known corners stay.
    """
    key = [*(tile or []), iy, ix]
    sent = F.explode(F.array(*[F.struct((F.col(iy) - a).alias("ky"), (F.col(ix) - b).alias("kx"), F.lit(f"{a}{b}").alias("c"), known(F.col(value).cast("double")).alias("v")) for a in (0, 1) for b in (0, 1)]))
    spread = cells.select(*(tile or []), sent.alias("s")).select(*(tile or []), F.col("s.ky").alias(iy), F.col("s.kx").alias(ix), "s.c", "s.v")
    got = spread.groupBy(*key).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"z{c}") for c in ("00", "01", "10", "11")])
    return got.where("z00 IS NOT NULL AND z01 IS NOT NULL AND z10 IS NOT NULL AND z11 IS NOT NULL")


def lerp2(fy: Column, fx: Column) -> Column:
    low = F.col("z00") * (1 - fx) + F.col("z01") * fx
    high = F.col("z10") * (1 - fx) + F.col("z11") * fx
    return low * (1 - fy) + high * fy


def bilinear(points: DataFrame, raster: DataFrame, y: Column, x: Column, name: str = "z", tile: list[str] | None = None) -> DataFrame:
    """``points`` with the raster's bilinear value at cell coordinates (y, x), null outside or next to unknown cells.

    ``raster`` is what ``corners`` gives, on ``iy`` and ``ix``. The last row and column have no upper neighbour: a point
    there is outside, as is one that falls on them exactly.
    """
    at = points.withColumns({"iy": F.floor(y), "ix": F.floor(x), "_fy": y - F.floor(y), "_fx": x - F.floor(x)})
    met = at.join(raster, [*(tile or []), "iy", "ix"], "left")
    return met.withColumn(name, lerp2(F.col("_fy"), F.col("_fx"))).drop("iy", "ix", "_fy", "_fx", "z00", "z01", "z10", "z11")


def mosaic_index(lat: Column, lon: Column, lat_top: float, lon_left: float, dlat: float, dlon: float) -> tuple[Column, Column]:
    """Cell coordinates of a latitude and longitude on a mosaic whose values stand at cell centres (dlat below 0)."""
    return (lat - lat_top) / dlat - 0.5, (lon - lon_left) / dlon - 0.5


def nearest(points: DataFrame, cells: DataFrame, y: Column, x: Column, value: str, default, name: str | None = None, tile: list[str] | None = None) -> DataFrame:
    """``points`` with a cell's value at the nearest cell, ``default`` outside; halves go to the even cell."""
    side = cells.select(*(tile or []), F.col("iy").alias("_ky"), F.col("ix").alias("_kx"), F.col(value).alias("_v"))
    at = points.withColumns({"_ky": F.rint(y).cast("long"), "_kx": F.rint(x).cast("long")})
    return at.join(side, [*(tile or []), "_ky", "_kx"], "left").withColumn(name or value, F.coalesce("_v", F.lit(default))).drop("_ky", "_kx", "_v")


def canopy_index(x: Column, y: Column, cell: float, col0: float, row0: float, half: float, compat: bool = False) -> tuple[Column, Column]:
    """(row from the north, column) of a Mercator canopy raster. The cells are cut down when built, so they are here; ``compat`` rounds, half a cell off."""
    row, col = (half - y) / cell - row0, (x + half) / cell - col0
    pick = F.rint if compat else F.floor
    return pick(row).cast("long"), pick(col).cast("long")


def resample(spark: SparkSession, raster: DataFrame, half_km: float, step: float, lat0: float, lon0: float, mosaic: tuple[float, float, float, float], half_km_x: float | None = None) -> DataFrame:
    """A metric grid ``(obs_id, gy, gx, y, x, z)`` around (lat0, lon0), sampled from a latitude-longitude raster's corners."""
    north, east = metres_per_degree_at(lat0)
    grid = metric_lattice(spark, half_km, step, half_km_x).withColumnsRenamed({"iy": "gy", "ix": "gx"})
    lat, lon = lat0 + F.col("y") / north, lon0 + F.col("x") / east
    return bilinear(grid, raster, *mosaic_index(lat, lon, *mosaic))


def pick_every(cells: DataFrame, rows: int, cols: int, want_rows: int, want_cols: int, iy: str = "iy", ix: str = "ix") -> DataFrame:
    """The cells at evenly spaced indices, cut down; ``oy`` and ``ox`` count the picked ones."""
    spark = cells.sparkSession

    def index(n: int, want: int, out: str, key: str) -> DataFrame:
        share = (n - 1) / (want - 1) if want > 1 else 0.0
        return spark.range(want).select(F.col("id").alias(out), F.floor(F.col("id") * share).alias(key))

    return cells.join(index(rows, want_rows, "oy", iy), iy).join(index(cols, want_cols, "ox", ix), ix)


def mercator_image(spark: SparkSession, cells: DataFrame, size: int, west: float, east: float, south: float, north: float, dlat: float, dlon: float, lat0: float, lon0: float, value: str = "score", up: bool = False) -> DataFrame:
    """``(py, px, value)`` of a Mercator-linear image from a latitude-longitude grid, nearest cell; null outside.

    ``up`` sends halves up, as a browser does; otherwise they go to the even cell.
    """
    top, bottom = (math.log(math.tan(math.pi / 4 + math.radians(max(-85.05, min(85.05, v))) / 2)) for v in (north, south))
    pick = half_up if up else F.rint
    # rows and columns are mapped apart: two short tables, each joined by its key
    row = spark.range(size).select(F.col("id").alias("py"), (F.lit(top) + F.col("id") / F.lit(float(max(1, size - 1))) * (bottom - top)).alias("m"))
    row = row.select("py", pick((F.degrees(2 * F.atan(F.exp("m")) - math.pi / 2) - lat0) / dlat).cast("long").alias("iy"))
    col = spark.range(size).select(F.col("id").alias("px"), pick((F.lit(west) + F.col("id") / F.lit(float(max(1, size - 1))) * (east - west) - lon0) / dlon).cast("long").alias("ix"))
    return cells.select("iy", "ix", value).join(F.broadcast(row), "iy").join(F.broadcast(col), "ix").select("py", "px", value)
