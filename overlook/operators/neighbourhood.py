"""Neighbourhoods on a grid: each cell is sent to the cells around it and met by equi-join or grouping, never by a range."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType


def _offsets(radius: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]))


def spread(cells: DataFrame, radius: int, value: str, y: str = "gy", x: str = "gx") -> DataFrame:
    """``(y, x, v)``: every cell's value at each cell within ``radius``; a grouped aggregate over it combines map-side."""
    out = cells.select(F.col(y).alias("_y"), F.col(x).alias("_x"), F.col(value).alias("v"), _offsets(radius).alias("o"))
    return out.select((F.col("_y") + F.col("o.dy")).alias(y), (F.col("_x") + F.col("o.dx")).alias(x), "v")


def moving_range(cells: DataFrame, value: str = "z", radius: int = 1, y: str = "iy", x: str = "ix") -> DataFrame:
    """``(y, x, low, high, known)`` over the window around each cell; cells outside the raster do not count.

    ``known`` is whether every cell of the window that exists has a value.
    """
    got = spread(cells, radius, value, y, x).groupBy(y, x).agg(F.min("v").alias("low"), F.max("v").alias("high"), (F.count("v") == F.count("*")).alias("known"))
    return cells.select(y, x).join(got, [y, x])


def flat_cells(cells: DataFrame, tolerance: float = 0.01, value: str = "z", y: str = "iy", x: str = "ix") -> DataFrame:
    """``(y, x, flat)``: no more than ``tolerance`` between the heights around; an unknown neighbour makes it not flat."""
    got = moving_range(cells, value, 1, y, x)
    return got.select(y, x, F.coalesce(F.col("known") & (F.col("high") - F.col("low") <= tolerance), F.lit(False)).alias("flat"))


#: Cells of a tile's side.
SIDE = 128


def on_tiles(cells: DataFrame, value: str, radius: int, work, kind: str, y: str = "gy", x: str = "gx", side: int = SIDE) -> DataFrame:
    """``cells`` with ``value`` made what ``work(grid, y0, x0)`` gives, tile by tile.

    ``grid`` has a tile's values and a ring of ``radius`` cells around it, NaN where there are none; its first cell is at
    ``y0, x0``; ``work`` returns an array of the same shape. Each cell moves once, and its value alone once more for
    each other tile whose ring it is in: a tenth and less of what sending it to all cells around would move.
    """
    side = max(side, radius)
    tiles = lambda c: F.sequence(F.floor((F.col(c) - radius) / side).cast("long"), F.floor((F.col(c) + radius) / side).cast("long"))
    rest = [c for c in cells.columns if c not in (y, x, value)]
    home = (F.col("_ty") == F.floor(F.col(y) / side)) & (F.col("_tx") == F.floor(F.col(x) / side))
    sent = cells.select(F.col(y).alias(y), F.col(x).alias(x), F.col(value).cast("double").alias("_v"), F.struct(F.lit(1).alias("_"), *rest).alias("_own"), F.explode(tiles(y)).alias("_ty")).withColumn("_tx", F.explode(tiles(x)))
    sent = sent.withColumn("_own", F.when(home, F.col("_own")))
    types = {f.name: f.dataType for f in cells.schema.fields}
    out = StructType([StructField("_own", sent.schema["_own"].dataType), StructField(y, types[y]), StructField(x, types[x]), StructField("_v", DoubleType())])
    span = side + 2 * radius

    def run(key: tuple, t: pa.Table) -> pa.Table:
        y0, x0 = (k.as_py() * side - radius for k in key)
        r, c = t.column(y).to_numpy() - y0, t.column(x).to_numpy() - x0
        grid = np.full((span, span), np.nan)
        grid[r, c] = t.column("_v").to_pandas().to_numpy()
        own = (r >= radius) & (r < radius + side) & (c >= radius) & (c < radius + side)
        got = work(grid, y0, x0)[r[own], c[own]]
        mine = t.filter(pa.array(own))
        return pa.table({"_own": mine.column("_own"), y: mine.column(y), x: mine.column(x), "_v": pa.array(got, mask=np.isnan(got))})

    made = sent.groupBy("_ty", "_tx").applyInArrow(run, out)
    return made.select(*[F.col("_v").cast(kind).alias(value) if c == value else F.col(c) if c in (y, x) else F.col(f"_own.{c}") for c in cells.columns])


def _around(grid: np.ndarray, radius: int) -> np.ndarray:
    """Every cell's values within ``radius``, in order, those that are unknown last."""
    wide = np.pad(grid, radius, constant_values=np.nan)
    n, m = grid.shape
    every = np.stack([wide[dy : dy + n, dx : dx + m] for dy in range(2 * radius + 1) for dx in range(2 * radius + 1)])
    every.sort(axis=0)
    return every


def land_quartile(cells: DataFrame, value: str, radius: int, rows: int | None = None, cols: int | None = None, share: float = 0.25, y: str = "gy", x: str = "gx") -> DataFrame:
    """``cells`` with ``value`` made the floor(n * share)-th smallest value of the land cells around each land cell.

    ``cells`` holds land only, so water neither scores nor counts. With ``rows`` and ``cols`` the border ring of
    ``radius`` cells gets 0. A radius of 0 leaves values as they are. One shuffle of tiles with a ring, no join.
    """
    if radius < 1:
        return cells

    def work(grid: np.ndarray, y0: int, x0: int) -> np.ndarray:
        near = _around(grid, radius)
        n = (~np.isnan(near)).sum(axis=0)
        low = np.take_along_axis(near, np.minimum(np.floor(n * share).astype(np.int64), len(near) - 1)[None], axis=0)[0]
        if rows is not None and cols is not None:
            at_y, at_x = np.arange(y0, y0 + len(grid))[:, None], np.arange(x0, x0 + grid.shape[1])
            low = np.where((at_y >= radius) & (at_y < rows - radius) & (at_x >= radius) & (at_x < cols - radius), low, 0.0)
        return low

    return on_tiles(cells, value, radius, work, cells.schema[value].dataType.simpleString(), y, x)


def _mirrored(i: Column, n: int) -> Column:
    """An index beyond the border reflected about the edge: -1 is 0, n is n - 1."""
    m = F.pmod(i, F.lit(2 * n))
    return F.when(m >= n, 2 * n - 1 - m).otherwise(m)


def plot_percentile(cells: DataFrame, value: str, rows: int, cols: int, step: float, radius_m: float = 50.0, percentile: float = 25.0, y: str = "gy", x: str = "gx") -> DataFrame:
    """The other scorer's rule over a dense grid: borders reflect, all cells count, the radius is one cell at least."""
    r = max(1, int(round(radius_m / step)))
    n = (2 * r + 1) ** 2
    rank = min(n - 1, int(n * percentile / 100))

    def mirrored(first: int, length: int, end: int) -> np.ndarray:
        """Places within the grid of what lies there, or of what is reflected there, as far as the grid has it."""
        m = np.arange(first, first + length) % (2 * end)
        return np.clip(np.where(m >= end, 2 * end - 1 - m, m) - first, 0, length - 1)

    def work(grid: np.ndarray, y0: int, x0: int) -> np.ndarray:
        full = grid[np.ix_(mirrored(y0, len(grid), rows), mirrored(x0, grid.shape[1], cols))]
        return _around(full, r)[rank]

    return on_tiles(cells.select(y, x, value), value, r, work, cells.schema[value].dataType.simpleString(), y, x)


def gradient(cells: DataFrame, value: str = "z", step: float = 1.0, y: str = "iy", x: str = "ix") -> DataFrame:
    """Adds ``gy`` and ``gx``: central differences, one-sided at the ends of each row and column.

    Windows run along single rows and columns, so no partition is larger than a line of the raster.
    """

    def along(order: str, by: str) -> Column:
        w = W.partitionBy(by).orderBy(order)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        v = F.col(value)
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2) / step

    return cells.withColumn("gx", along(x, y)).withColumn("gy", along(y, x))


def hillshade(cells: DataFrame, value: str = "z", step: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 2.0, y: str = "iy", x: str = "ix", compat: bool = False) -> DataFrame:
    """Adds ``shade``, 0 to 1: light from ``azimuth`` (clockwise from north; rows run northward) at ``altitude`` on exaggerated slopes.

    ``compat`` turns the light as the first maps had it: from a quarter turn on, and the same from north and south.
    """
    g = gradient(cells.withColumn("_h", F.col(value) * float(exaggeration)), "_h", step, y, x)
    turn, up = math.radians(azimuth), math.radians(altitude)
    # the light's level part along the ground's fall, against its upright part, over the length of the ground's normal
    level = F.col("gy") * math.sin(turn) - F.col("gx") * math.cos(turn) if compat else -(F.col("gx") * math.sin(turn) + F.col("gy") * math.cos(turn))
    light = (level * math.cos(up) + math.sin(up)) / F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + 1)
    return g.withColumn("shade", F.greatest(F.least(light, F.lit(1.0)), F.lit(0.0))).drop("_h", "gx", "gy")


def gaussian(cells: DataFrame, rows: int, cols: int, sigma: float = 1.0, value: str = "z", y: str = "iy", x: str = "ix") -> DataFrame:
    """``(y, x, value)`` smoothed along columns, then rows; weights end at four sigma, borders reflect."""
    reach = int(4.0 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    taps = F.explode(F.array(*[F.struct(F.lit(k - reach).alias("k"), F.lit(w / total).alias("w")) for k, w in enumerate(weights)]))
    for axis, n in ((y, rows), (x, cols)):
        want = cells.select(y, x, taps.alias("t")).withColumn("_s", _mirrored(F.col(axis) + F.col("t.k"), n))
        other = x if axis == y else y
        side = cells.select(F.col(other).alias("_o"), F.col(axis).alias("_s"), F.col(value).alias("_v"))
        cells = want.join(side, (want[other] == side["_o"]) & (want["_s"] == side["_s"])).groupBy(y, x).agg(F.sum(F.col("_v") * F.col("t.w")).alias(value))
    return cells
