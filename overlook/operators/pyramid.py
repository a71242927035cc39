"""Coarser levels of a region, its tiles, and which of them a viewport reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlook.functions.geo import NODATA
from overlook.plans.shared import written


def _blocks(df: DataFrame, factor: int, rows: int, cols: int, y: str, x: str) -> DataFrame:
    """Whole blocks only: cells of short blocks at the far edges go."""
    whole = df.where((F.col(y) < rows // factor * factor) & (F.col(x) < cols // factor * factor))
    return whole.withColumns({"by": F.floor(F.col(y) / factor).cast("long"), "bx": F.floor(F.col(x) / factor).cast("long")})


def overview_terrain(cells: DataFrame, factor: int, rows: int, cols: int, compat: bool = False, y: str = "gy", x: str = "gx") -> DataFrame:
    """``(by, bx, elev, valid, canopy)`` of blocks: mean height over all cells, land if any cell is, least canopy on land.

    Heights that are missing (null or the nodata number) have no part in the mean; ``compat`` averages the nodata number
    in, as the format's first writer did.
    """
    elev = F.col("elev_m").cast("double")
    height = F.coalesce(elev, F.lit(float(NODATA))) if compat else F.when(elev != NODATA, elev)
    return _blocks(cells, factor, rows, cols, y, x).groupBy("by", "bx").agg(
        F.rint(F.avg(height)).cast("long").alias("elev"), F.bool_or("valid").alias("valid"), F.coalesce(F.min(F.when(F.col("valid"), F.col("canopy_m"))), F.lit(0)).cast("long").alias("canopy")
    )


def overview_mean(values: DataFrame, factor: int, rows: int, cols: int, value: str = "dist_u8", y: str = "gy", x: str = "gx") -> DataFrame:
    """``(by, bx, az, value)``: mean over land cells by azimuth, halves to even, 0 without land. ``values`` has one row a cell and azimuth."""
    mean = F.avg(F.when(F.col("valid"), F.col(value).cast("double")))
    return _blocks(values, factor, rows, cols, y, x).groupBy("by", "bx", "az").agg(F.coalesce(F.rint(mean), F.lit(0.0)).cast("long").alias(value))


def overview_distances(cells: DataFrame, factor: int, rows: int, cols: int, azimuths: int = 32, values: str = "dist", y: str = "gy", x: str = "gx") -> DataFrame:
    """``(by, bx, dist)``: the same means as arrays, one aggregate a bearing in one pass, without a row a bearing."""
    mean = [F.avg(F.when(F.col("valid"), F.get(F.col(values), F.lit(a)).cast("double"))).alias(f"m{a}") for a in range(azimuths)]
    got = _blocks(cells, factor, rows, cols, y, x).groupBy("by", "bx").agg(*mean)
    return got.select("by", "bx", F.array(*[F.coalesce(F.rint(f"m{a}"), F.lit(0.0)).cast("long") for a in range(azimuths)]).alias(values))


def overview_water(cells: DataFrame, factor: int, rows: int, cols: int, compat: bool = False, y: str = "gy", x: str = "gx") -> DataFrame:
    """``(by, bx, water)``: directions in which any land cell of the block sees water; ``compat`` takes the largest number instead, which loses directions."""
    own = F.when(F.col("valid"), F.col("water")).otherwise(F.lit(0)).cast("long")
    return _blocks(cells, factor, rows, cols, y, x).groupBy("by", "bx").agg((F.max(own) if compat else F.bit_or(own)).alias("water"))


@dataclass
class Level:
    """A level's shape and place; ``lat0, lon0`` are the centre of its first cell."""

    id: int
    step_m: float
    rows: int
    cols: int
    tile: int
    lat0: float
    dlat: float
    lon0: float
    dlon: float

    @property
    def tiles(self) -> tuple[int, int]:
        return -(-self.rows // self.tile), -(-self.cols // self.tile)

    def tile_shape(self, ty: int, tx: int) -> tuple[int, int]:
        return min(self.tile, self.rows - ty * self.tile), min(self.tile, self.cols - tx * self.tile)


def levels(rows: int, cols: int, step: float, lat0: float, lat1: float, lon0: float, lon1: float, factor: int = 4, tile: int = 256) -> list[Level]:
    """Overview and native level; an overview cell stands at the centre of its block, half a block off its corner."""
    dlat, dlon = (lat1 - lat0) / (rows - 1), (lon1 - lon0) / (cols - 1)
    shift = (factor - 1) / 2
    r0, c0 = rows // factor, cols // factor
    return [Level(0, step * factor, r0, c0, max(r0, c0, 1), lat0 + shift * dlat, factor * dlat, lon0 + shift * dlon, factor * dlon), Level(1, step, rows, cols, tile, lat0, dlat, lon0, dlon)]


def tiled(cells: DataFrame, level: Level, y: str = "gy", x: str = "gx") -> DataFrame:
    """Adds ``level, tile_y, tile_x, row, col``: where a cell stands in its tile."""
    t = level.tile
    return cells.withColumns({
        "level": F.lit(level.id), "tile_y": F.floor(F.col(y) / t).cast("int"), "tile_x": F.floor(F.col(x) / t).cast("int"),
        "row": (F.col(y) % t).cast("int"), "col": (F.col(x) % t).cast("int"),
    })


@dataclass
class Window:
    """The cells on screen, ends included."""

    level: Level
    x0: int
    x1: int
    y0: int
    y1: int

    def scan(self, pyramid: DataFrame) -> DataFrame:
        """Only the tiles that overlap: conditions on partition columns, then on cells."""
        t = self.level.tile
        tiles = pyramid.where((F.col("level") == self.level.id) & F.col("tile_y").between(self.y0 // t, self.y1 // t) & F.col("tile_x").between(self.x0 // t, self.x1 // t))
        cy, cx = F.col("tile_y") * t + F.col("row"), F.col("tile_x") * t + F.col("col")
        return tiles.where(cy.between(self.y0, self.y1) & cx.between(self.x0, self.x1))


def view_window(all_levels: list[Level], west: float, east: float, south: float, north: float, zoom: float, detail_zoom: float = 10.5, budget: int = 700 * 700) -> Window | None:
    """The window of a viewport, at the finest level that the zoom asks for and the budget of cells allows."""
    import math

    first, last = all_levels[-1], all_levels[-1]
    west, east = max(west, first.lon0), min(east, last.lon0 + (last.cols - 1) * last.dlon)
    south, north = max(south, first.lat0), min(north, last.lat0 + (last.rows - 1) * last.dlat)
    if east <= west or north <= south:
        return None
    at = len(all_levels) - 1 if zoom >= detail_zoom else 0
    while True:
        g = all_levels[at]
        hold = lambda v, n: max(0, min(n - 1, v))
        x0, x1 = hold(math.floor((west - g.lon0) / g.dlon), g.cols), hold(math.ceil((east - g.lon0) / g.dlon), g.cols)
        y0, y1 = hold(math.floor((south - g.lat0) / g.dlat), g.rows), hold(math.ceil((north - g.lat0) / g.dlat), g.rows)
        if (x1 - x0 + 1) * (y1 - y0 + 1) > budget and at > 0:
            at -= 1
            continue
        return Window(g, x0, x1, y0, y1)


def viewports(views: DataFrame, all_levels: list[Level], detail_zoom: float = 10.5, budget: int = 700 * 700) -> DataFrame:
    """``views`` (``west, east, south, north, zoom``, degrees) with the level and cells that each reads: ``level, tile, x0, x1, y0, y1``.

    The same rule as ``view_window``, in columns: the finest level that the zoom asks for and the budget of cells allows;
    views that miss the region go.
    """
    native = all_levels[-1]
    west, east = F.greatest("west", F.lit(native.lon0)), F.least("east", F.lit(native.lon0 + (native.cols - 1) * native.dlon))
    south, north = F.greatest("south", F.lit(native.lat0)), F.least("north", F.lit(native.lat0 + (native.rows - 1) * native.dlat))
    hold = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")
    chosen = None
    for g in all_levels:
        cells = {"x0": hold(F.floor((west - g.lon0) / g.dlon), g.cols), "x1": hold(F.ceil((east - g.lon0) / g.dlon), g.cols), "y0": hold(F.floor((south - g.lat0) / g.dlat), g.rows), "y1": hold(F.ceil((north - g.lat0) / g.dlat), g.rows)}
        own = F.struct(F.lit(g.id).alias("level"), F.lit(g.tile).alias("tile"), *[v.alias(k) for k, v in cells.items()])
        fits = (F.col("zoom") >= detail_zoom) & ((cells["x1"] - cells["x0"] + 1) * (cells["y1"] - cells["y0"] + 1) <= budget)
        chosen = own if chosen is None else F.when(fits, own).otherwise(chosen)
    return views.where((east > west) & (north > south)).withColumn("_w", chosen).select("*", "_w.*").drop("_w")


def scan_viewports(pyramid: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells of each view of ``viewports``: an equi-join on the store's partitions, so that files of other tiles are pruned while the plan runs."""
    spread = wanted.withColumn("tile_y", F.explode(F.expr("sequence(y0 div tile, y1 div tile)"))).withColumn("tile_x", F.explode(F.expr("sequence(x0 div tile, x1 div tile)")))
    cy, cx = F.col("tile_y") * F.col("tile") + F.col("row"), F.col("tile_x") * F.col("tile") + F.col("col")
    at = [F.col(c).cast("int").alias(c) for c in ("level", "tile_y", "tile_x")]
    met = pyramid.join(spread.select(*[c for c in spread.columns if c not in ("level", "tile_y", "tile_x")], *at), ["level", "tile_y", "tile_x"])
    return met.where(cy.between(F.col("y0"), F.col("y1")) & cx.between(F.col("x0"), F.col("x1")))


def _running(df: DataFrame, keys: list[str], along: str, values: list[str], block: int = 4096) -> DataFrame:
    """``values`` added up along a line of each of ``keys``, rows at one place together.

    Lines are cut in blocks, whose totals run on their own, so a task holds no more than a block or the blocks of a line.
    """
    cut = df.withColumn("_block", F.floor(F.col(along) / block).cast("long"))
    within, before = W.partitionBy(*keys, "_block").orderBy(along), W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_block").agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select(*keys, "_block", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before{v}") for v in values])
    own = cut.withColumns({v: F.sum(v).over(within) for v in values}).join(totals, [*keys, "_block"])
    return own.withColumns({v: F.col(v) + F.col(f"_before{v}") for v in values}).drop("_block", *[f"_before{v}" for v in values])


def view_totals(pyramid: DataFrame, wanted: DataFrame, all_levels: list[Level], values: dict[str, Column]) -> DataFrame:
    """``wanted`` (of ``viewports``) with ``cells`` and the sums of ``values`` (whole numbers) over what each view shows; views that show no cell go.

    The sums of ``scan_viewports`` without its rows: cells are added up along rows and then along columns once, and a view
    takes the four corners of its window. So work grows with the cells and the views, not with what all views show.
    """
    window = ["level", "x0", "x1", "y0", "y1"]
    by_level = lambda of: F.coalesce(*[F.when(F.col("level") == g.id, F.lit(of(g))) for g in all_levels])
    sums = ["_cells", *[f"_{kind}_{v}" for v in values for kind in ("sum", "known")]]
    told = [F.lit(1).cast("long"), *[c for v in values.values() for c in (F.coalesce(v.cast("long"), F.lit(0).cast("long")), v.isNotNull().cast("long"))]]
    tile = by_level(lambda g: g.tile)
    at = [F.col("level").cast("int").alias("level"), (F.col("tile_y") * tile + F.col("row")).cast("long").alias("y"), (F.col("tile_x") * tile + F.col("col")).cast("long").alias("x")]
    cells = pyramid.select(*at, *[c.alias(n) for c, n in zip(told, sums)]).groupBy("level", "y").agg(F.collect_list(F.struct("x", *sums)).alias("_c"))
    nothing = [F.lit(0).cast("long").alias(n) for n in sums]
    # rows that hold cells have all their places, so that each corner meets its column
    places = F.transform(F.sequence(F.lit(0).cast("long"), by_level(lambda g: g.cols - 1).cast("long")), lambda x: F.struct(x.alias("x"), *nothing))
    rows = cells.select("level", "y", F.explode(F.concat("_c", places)).alias("_c")).select("level", "y", "_c.*").groupBy("level", "y", "x").agg(*[F.sum(n).alias(n) for n in sums])
    along = W.partitionBy("level", "y").orderBy("x")
    # written, since both blocks and their totals read it, and a store has many files
    rows = written(rows.select("level", "y", "x", *[F.sum(n).over(along).alias(n) for n in sums]), "view-rows").withColumn("asked", F.lit(False))

    # views of one window are answered once
    windows = wanted.select(F.col("level").cast("int").alias("level"), *window[1:]).distinct()
    corner = lambda x, y, sign: F.struct(x.alias("x"), y.alias("y"), F.lit(sign).alias("sign"))
    x0, x1, y0, y1 = (F.col(c) for c in window[1:])
    corners = windows.withColumn("_c", F.explode(F.array(corner(x1, y1, 1), corner(x0 - 1, y1, -1), corner(x1, y0 - 1, -1), corner(x0 - 1, y0 - 1, 1))))
    corners = corners.select(*window, "_c.*").where("x >= 0 AND y >= 0")
    asked = corners.select("level", "y", "x").distinct().select("level", "y", "x", *nothing, F.lit(True).alias("asked"))
    held = _running(rows.unionByName(asked), ["level", "x"], "y", sums).where("asked").drop("asked")
    got = corners.join(held, ["level", "y", "x"]).groupBy(*window).agg(*[F.sum(F.col(n) * F.col("sign")).alias(n) for n in sums]).where("_cells > 0")
    got = got.select(*window, F.col("_cells").alias("cells"), *[F.when(F.col(f"_known_{v}") > 0, F.col(f"_sum_{v}")).alias(v) for v in values])
    return wanted.withColumn("level", F.col("level").cast("int")).join(got, window)


def canopy_blocks(pixels: DataFrame, factor: int = 32, y: str = "r", x: str = "c", value: str = "h") -> DataFrame:
    """``(r, c, h_max, h_mean)`` of factor x factor source pixels, the mean rounded half to even."""
    return pixels.groupBy(F.floor(F.col(y) / factor).cast("long").alias("r"), F.floor(F.col(x) / factor).cast("long").alias("c")).agg(F.max(value).cast("long").alias("h_max"), F.rint(F.avg(value)).cast("long").alias("h_mean"))
