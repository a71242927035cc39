"""The batch jobs: region, relief, pyramid, pilot box, contours and point reports, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from overlook.functions import colour, geo
from overlook.functions.spots import search_url
from overlook.operators import contours, lattice, neighbourhood, pyramid, relief, reports, scoring, tiles, viewshed, water
from overlook.sources import ledger, stores
from overlook.sources.rasters import REGION

EYES = (0.0, 1.7, 5.0)
VEGETATION = ("trees", "bare")
#: Cells of the elevation grid and of the observers, in metres.
CELL, OBSERVER = 25.0, 100.0


def terrain(cells: DataFrame, cell: float = CELL, min_hectares: float = 10.0) -> DataFrame:
    """Elevation cells ``iy, ix, z`` and, if known, ``canopy`` and ``land_class``, with ``obstruction`` and ``is_water``."""
    for name in ("canopy", "land_class"):
        if name not in cells.columns:
            cells = cells.withColumn(name, F.lit(None).cast("double"))
    return water.detect_water(cells.withColumn("obstruction", geo.obstruction(F.col("canopy"), F.col("land_class"))), cell, min_hectares=min_hectares)


def sites(observers: DataFrame, ground: DataFrame, cell: float = CELL) -> DataFrame:
    """Observers with ``valid`` (land of known height), ``elev_m`` and ``canopy_m`` of their own cell."""
    side = ground.select(F.col("iy").alias("_ky"), F.col("ix").alias("_kx"), F.col("z").alias("_z"), "is_water", F.coalesce("canopy", F.lit(0.0)).cast("long").alias("canopy_m"))
    at = observers.withColumns({"_ky": F.rint(F.col("y") / cell).cast("long"), "_kx": F.rint(F.col("x") / cell).cast("long")}).join(side, ["_ky", "_kx"], "left")
    valid = geo.is_land(F.col("is_water"), F.col("_z"))
    return at.withColumns({"valid": valid, "elev_m": F.coalesce(F.rint("_z").cast("long"), F.lit(geo.NODATA).cast("long")), "canopy_m": F.coalesce("canopy_m", F.lit(0).cast("long"))}).drop("_ky", "_kx", "_z", "is_water")


def signatures(observers: DataFrame, ground: DataFrame, tile_cells: int, cell: float = CELL, eyes: Sequence[float] = EYES, vegetation: Sequence[str] = VEGETATION, azimuths: int = 32, reach: float = geo.MAX_DISTANCE, steps: Sequence[float] | None = None) -> DataFrame:
    """``(veg, eye_cm, obs_id, dist, water)`` for every set, all in one pass over the terrain: distances in bytes, water in bits."""
    tops = ground.withColumn("trees", F.col("z") + F.col("obstruction"))
    surfaces = ["z" if v == "bare" else v for v in vegetation]
    seen = viewshed.compute_tiles(observers, tops.select("iy", "ix", "z", "trees", "is_water"), cell, tile_cells, eyes, azimuths, reach, steps, surfaces)
    return seen.select(
        F.when(F.col("surface") == "z", "bare").otherwise(F.col("surface")).alias("veg"), F.rint(F.col("eye") * 100).cast("int").alias("eye_cm"), "obs_id",
        F.transform("max_dist", lambda d: geo.quantise_distance(d, reach).cast("short")).alias("dist"), geo.pack_bits(F.transform("water_far", lambda d: d > 0)).alias("water"),
    )


def region_meta(spark: SparkSession, bounds: tuple[float, float, float, float], rows: int, cols: int, azimuths: int = 32, obs_m: float = OBSERVER, max_dist_km: float = geo.MAX_DISTANCE / 1000, eyes: Sequence[float] = EYES, vegetation: Sequence[str] = VEGETATION) -> DataFrame:
    """A region's metadata, one row; ``bounds`` are south, north, west, east."""
    row = (*map(float, bounds), rows, cols, azimuths, float(obs_m), float(max_dist_km), [(round(e * 100), float(e)) for e in eyes], list(vegetation))
    return spark.createDataFrame([row], REGION)


def build_region(ground: DataFrame, observers: DataFrame, out: str, tile_cells: int = 512, cell: float = CELL, done: DataFrame | None = None, meta: DataFrame | None = None, version: str | None = None, **options) -> None:
    """Write ``terrain`` and ``signature`` tables, partitioned by tile; tiles in ``done`` (ty, tx) are left alone.

    With ``version`` (of the inputs), so are tiles that the region's own ledger names for it, and those built are entered.

    ``meta`` is written before any tile, so that a region can be read while it is built. A tile's partitions are replaced
    as a whole, so a run that failed can be run again.
    """
    if meta is not None:
        stores.write_region(meta, f"{out}/region.json")
    tile = {"ty": F.floor(F.col("y") / cell / tile_cells).cast("int"), "tx": F.floor(F.col("x") / cell / tile_cells).cast("int")}
    todo = observers.withColumns(tile)
    if done is not None:
        todo = todo.join(done.select("ty", "tx").distinct(), ["ty", "tx"], "left_anti")

    def make(chosen: DataFrame) -> DataFrame:
        stores.write_tiles(sites(chosen, ground, cell), f"{out}/terrain", ["ty", "tx"])
        return signatures(chosen, ground, tile_cells, cell, **options).join(chosen.select("obs_id", "ty", "tx"), "obs_id")

    if version is None:
        stores.write_tiles(make(todo), f"{out}/signature", ["veg", "eye_cm", "ty", "tx"])
        return
    key = F.format_string("%d_%d", "ty", "tx")
    by_key = lambda keys: todo.withColumn("key", key).join(keys, "key", "left_semi")
    ledger.build(todo.select(key.alias("key")), lambda keys: make(by_key(keys).drop("key")).withColumn("key", key), f"{out}/signature", f"{out}/ledger", version)


def read_region(spark: SparkSession, out: str, veg: str, eye_cm: int) -> DataFrame:
    """One signature set with its sites; other sets' files are not touched."""
    own = spark.read.parquet(f"{out}/signature").where((F.col("veg") == veg) & (F.col("eye_cm") == eye_cm)).select("obs_id", "dist", "water")
    return spark.read.parquet(f"{out}/terrain").join(own, "obs_id").withColumn("canopy", F.col("canopy_m"))


def build_relief(observers: DataFrame, ground: DataFrame, cell: float = CELL, azimuths: int = 32, tile_cells: int = 512) -> DataFrame:
    """``(obs_id, drop)``: sustained descent in quarter degrees by azimuth."""
    return relief.descents_tiles(observers, ground.select("iy", "ix", "z"), cell, tile_cells, azimuths)


def pack_region(region: DataFrame, rows: int, cols: int, bounds: tuple[float, float, float, float], out: str, step: float = OBSERVER, factor: int = 4, tile: int = 256, overview_only: bool = False) -> list[pyramid.Level]:
    """Write the overview and, unless ``overview_only``, the native level of one signature set by tile, and their ``meta.json``.

    ``bounds`` (south, north, west, east) are the centres of the outer cells; levels carry their own georeference. Both
    levels are cut in tiles of ``tile`` cells. Without the native level no zoom asks for detail (``detail_min_zoom`` 99).
    """
    over_level, native = pyramid.levels(rows, cols, step, *bounds, factor, tile)
    over_level.tile = tile
    chosen = [over_level] if overview_only else [over_level, native]
    spark = region.sparkSession
    kinds = "id int, step_m double, rows int, cols int, tile_rows int, tile_cols int, tiles_y int, tiles_x int, lat0 double, dlat double, lon0 double, dlon double"
    about = [(v.id, float(v.step_m), v.rows, v.cols, tile, tile, *v.tiles, v.lat0, v.dlat, v.lon0, v.dlon) for v in chosen]
    meta = spark.createDataFrame([(99.0 if overview_only else 10.5, about)], f"detail_min_zoom double, levels array<struct<{', '.join(k.replace(' ', ':') for k in kinds.split(', '))}>>")
    stores.write_region(meta, f"{out}/meta.json")
    cells = region.select("gy", "gx", "valid", "canopy_m", "elev_m", "water", "dist")
    azimuths = cells.select(F.size("dist")).limit(1).collect()
    dist = pyramid.overview_distances(cells, factor, rows, cols, azimuths[0][0] if azimuths else 0)
    over = pyramid.overview_terrain(cells, factor, rows, cols).join(pyramid.overview_water(cells, factor, rows, cols), ["by", "bx"]).join(dist, ["by", "bx"])
    over = over.select(F.col("by").alias("gy"), F.col("bx").alias("gx"), "valid", F.col("canopy").alias("canopy_m"), F.col("elev").alias("elev_m"), "water", "dist")
    packed = pyramid.tiled(over, over_level)
    if not overview_only:
        packed = packed.unionByName(pyramid.tiled(cells.withColumn("dist", F.transform("dist", lambda d: d.cast("long"))), native))
    stores.write_pyramid(packed, f"{out}/tiles")
    return chosen


def read_pyramid(spark: SparkSession, out: str) -> tuple[list[pyramid.Level], float]:
    """(levels, coarsest to finest; the zoom from which the native one is asked for) of a packed region's ``meta.json``."""
    kinds = "id int, step_m double, rows int, cols int, tile_rows int, tile_cols int, tiles_y int, tiles_x int, lat0 double, dlat double, lon0 double, dlon double"
    told = spark.read.schema(f"detail_min_zoom double, levels array<struct<{', '.join(k.replace(' ', ':') for k in kinds.split(', '))}>>").json(f"{out}/meta.json").first()
    rows = sorted(told["levels"], key=lambda v: v["id"])
    return [pyramid.Level(v["id"], v["step_m"], v["rows"], v["cols"], v["tile_rows"], v["lat0"], v["dlat"], v["lon0"], v["dlon"]) for v in rows], told["detail_min_zoom"]


def read_viewports(spark: SparkSession, out: str, views: DataFrame, budget: int = 700 * 700) -> DataFrame:
    """The cells that each of ``views`` (``west, east, south, north, zoom`` and what names them) shows of a packed region.

    What the region's metadata says decides levels and tiles; partitions that no view touches are not read.
    """
    levels, zoom = read_pyramid(spark, out)
    return pyramid.scan_viewports(spark.read.parquet(f"{out}/tiles"), pyramid.viewports(views, levels, zoom, budget))


def viewport_totals(spark: SparkSession, out: str, views: DataFrame, values: dict[str, Column], budget: int = 700 * 700) -> DataFrame:
    """Each of ``views`` with its level and window, the ``cells`` it shows of a packed region and their ``values`` added up.

    For many views: the region is read as a whole, once, whatever the views show together.
    """
    levels, zoom = read_pyramid(spark, out)
    return pyramid.view_totals(spark.read.parquet(f"{out}/tiles"), pyramid.viewports(views, levels, zoom, budget), levels, values)


#: What clients call the eye heights. Fixed values.
LABELS = {0.0: "Ground", 1.7: "Standing", 5.0: "Second floor"}
BOX = "centre array<double>, bounds array<double>, n int, azimuths int, states array<string>, ramp array<string>, eyes array<struct<cm:int,m:double,label:string>>, max_dist_km double, obs_step_m double, scale_km array<double>, canopy_m double"


def box_meta(spark: SparkSession, lat0: float, lon0: float, core_km: float = 50.0, step: float = OBSERVER, azimuths: int = 32, max_dist_km: float = geo.MAX_DISTANCE / 1000, eyes: Sequence[float] = EYES, vegetation: Sequence[str] = VEGETATION, canopy_m: float = 2.0) -> DataFrame:
    """What a client must know of a single box around a centre, one row: bounds are west, south, east, north."""
    north, east = geo.metres_per_degree_at(lat0)
    half = core_km * 500
    bounds = [lon0 - half / east, lat0 - half / north, lon0 + half / east, lat0 + half / north]
    ramp = ["#" + "".join(f"{round(c * 255):02X}" for c in rgb) for rgb in colour.SINGLE_HUE]
    return spark.createDataFrame([([float(lat0), float(lon0)], bounds, round(2 * half / step) + 1, azimuths, list(vegetation), ramp, [(round(e * 100), float(e), LABELS.get(e)) for e in eyes], float(max_dist_km), float(step), [0.0, 8.0], float(canopy_m))], BOX)


def read_box(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(byte tiles, metadata) of an exported box."""
    return spark.read.parquet(f"{out}/layers"), spark.read.schema(BOX).json(f"{out}/data.json")


def export_box(region: DataFrame, level: pyramid.Level, out: str, name: str, meta: DataFrame | None = None) -> None:
    """A single box of one signature set as byte tiles: land, water bits and each bearing's distance, one row a tile and layer.

    Layers go below ``out/layers``, each set beside those of others; ``meta`` (of ``box_meta``) to ``out/data.json``, first.
    """
    if meta is not None:
        stores.write_region(meta, f"{out}/data.json")
    placed = pyramid.tiled(region, level)
    layers = [stores.byte_tiles(placed, "valid", 1, "valid"), stores.byte_tiles(placed, "water", 4, f"water_{name}")]
    by_bearing = placed.select("level", "tile_y", "tile_x", "row", "col", F.posexplode("dist").alias("az", "q"))
    # bearings of a cell stand side by side
    layers.append(stores.byte_tiles(by_bearing.withColumn("col", F.col("col") * F.lit(1000) + F.col("az")), "q", 1, f"dist_{name}"))
    every = layers[0].unionByName(layers[1]).unionByName(layers[2])
    # tiles stay where they were grouped: a layer's name alone would bring it to one task
    every.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").parquet(stores.claim(region.sparkSession, f"{out}/layers"))


def write_pilot(seen: DataFrame, meta: DataFrame, out: str) -> None:
    """The pilot's signatures and what they were made with: two tables of one archive."""
    stores.write_region(meta, f"{out}/meta.json")
    stores.claim(seen.sparkSession, out)
    seen.write.mode("overwrite").parquet(f"{out}/signatures")


def read_pilot(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(signatures, metadata) of a pilot's archive; columns that are not asked for are not read."""
    return spark.read.parquet(f"{out}/signatures"), spark.read.json(f"{out}/meta.json")


def spots_over(spots: DataFrame, wide: DataFrame, step: float, lat0: float, lon0: float, score: str = "score") -> DataFrame:
    """Fine ``spots`` (``rank, y, x``, metres from the centre) over a wide map (``y, x`` on a lattice of ``step``): distance, bearing, link and the map's own score.

    The nearest cell of the map is met by its key; a spot beyond the map has none.
    """
    north, east = geo.metres_per_degree_at(lat0)
    key = lambda c: F.rint(F.col(c) / step).cast("long")
    side = wide.select(key("y").alias("_ky"), key("x").alias("_kx"), F.col(score).alias("wide_score"))
    at = spots.withColumns({"_ky": key("y"), "_kx": key("x")}).join(side, ["_ky", "_kx"], "left").drop("_ky", "_kx")
    bearing = F.pmod(F.degrees(F.atan2("x", "y")), F.lit(360.0))
    return at.withColumns({"km": F.hypot("x", "y") / 1000, "name": geo.compass(bearing), "url": search_url(lat0 + F.col("y") / north, lon0 + F.col("x") / east)})


def core(df: DataFrame, half: float, y: str = "y", x: str = "x") -> DataFrame:
    """The rows within ``half`` metres of the centre, edges included."""
    return df.where((F.abs(y) <= half) & (F.abs(x) <= half))


def pilot_spots(region: DataFrame, rows: int, cols: int, core_km: float = 50.0, step: float = OBSERVER, k: int = 10, preset: str = "openness") -> DataFrame:
    """Ranked spots of a box by one of the presets: filter, percentile over a plot, separated picks.

    ``region``: ``obs_id, gy, gx, max_dist, water_far, on_water, ground``.
    """
    scored = scoring.PRESETS[preset].robust(region, rows, cols, step)
    return scoring.top_spots(scored, k, max(3, round(core_km * 1000 / 10 / step)), "score")


def export_contours(cells: DataFrame, rows: int, cols: int, out: str, lat0: float, lon0: float, interval: float = 10.0, major_every: int = 5, step: float = 50.0, smooth: float = 1.0, tolerance: float = 18.0) -> DataFrame:
    """Smooth, trace, simplify and write contours; returns their totals."""
    lines = contours.contours(neighbourhood.gaussian(cells, rows, cols, smooth), interval, major_every, step, tolerance)
    stores.write_contours(lines, out, lat0, lon0)
    return contours.totals(lines)


def inspect_point(spark: SparkSession, ground: DataFrame, y: float, x: float, cell: float = CELL, eyes: Sequence[float] = (1.7, 5.0), azimuths: int = 32, steps: Sequence[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per direction, summary) of one place for several eye heights, with how far below the water in view lies."""
    place = spark.createDataFrame([(0, float(y), float(x))], "obs_id long, y double, x double")
    own = ground.select("iy", "ix", "z")
    seen = viewshed.compute(spark, place, own, cell, eyes, azimuths, steps=steps, water=ground.select("iy", "ix", "is_water"), of=azimuths)
    by_direction = reports.direction_report(seen, azimuths)
    bearing = F.radians("bearing")
    at = by_direction.withColumns({"_y": (y + F.cos(bearing) * F.col("water_far")) / cell, "_x": (x + F.sin(bearing) * F.col("water_far")) / cell})
    corner = lattice.corners(own)
    with_water = lattice.bilinear(at, corner, F.col("_y"), F.col("_x"), "water_z")
    base = lattice.bilinear(place, corner, F.col("y") / cell, F.col("x") / cell, "ground").select("obs_id", "ground")
    told = with_water.join(base, "obs_id").withColumn("water_below", F.when(F.col("water_far") > 0, F.col("ground") - F.col("water_z"))).drop("_y", "_x", "water_z")
    totals = reports.point_report(seen.select(F.col("eye").alias("obs_id"), "az", F.col("max_dist").alias("d")), of=azimuths).withColumnRenamed("obs_id", "eye")
    return told, totals


def plan_tiles(spark: SparkSession, box: tuple[float, float, float, float], done: DataFrame, present: DataFrame, tile_lat: float = 0.45, tile_lon: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(tiles to do, land-cover tiles that they need and that are missing) for a box (south, north, west, east)."""
    todo = tiles.pending(tiles.work_list(spark, *box, tile_lat, tile_lon), done)
    lat = F.explode(F.sequence(F.floor(F.col("south") / 3).cast("int"), F.floor((F.col("north") - 1e-9) / 3).cast("int")))
    need = todo.select("west", "east", lat.alias("a")).withColumn("o", F.explode(F.sequence(F.floor(F.col("west") / 3).cast("int"), F.floor((F.col("east") - 1e-9) / 3).cast("int"))))
    return todo, tiles.missing(need.select(geo.land_cover_name(F.col("a") * 3, F.col("o") * 3).alias("key")), present)
