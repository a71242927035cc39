"""Queries of the sources and stores: rasters written from the given tables and read back by range, viewports, and a ledger of tiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from overlook.functions import geo, sun
from overlook.operators import shapes
from overlook.plans import fixtures as fx
from overlook.plans.catalog import SQL, query
from overlook.plans.fixtures import with_fixtures
from overlook.plans.queries import _DRIFT, D, _sun_ctes
from overlook.plans.shared import fresh_path
from overlook.sources import ledger, ranged, rasters, stores

# raw tiles of 100 x 32 cells: one of them is missing, and so are some cells

_TILE = "59 - iy // 100 AS lat_i, 11 + ix // 32 AS lon_i, iy % 100 AS row, ix % 32 AS col"
_LACKS = "(iy % 17 = 0 AND ix % 5 = 0)"


def _raw(spark, sf_dir) -> str:
    cells = fx.dem_cells(spark, sf_dir)
    at = {"lat_i": (59 - F.expr("iy div 100")).cast("int"), "lon_i": (11 + F.expr("ix div 32")).cast("int"), "row": (F.col("iy") % 100).cast("int"), "col": (F.col("ix") % 32).cast("int"), "z": F.when((F.col("iy") % 17 != 0) | (F.col("ix") % 5 != 0), F.col("z"))}
    path = fresh_path(spark, "raw")
    ranged.write_raw(cells.withColumns(at).where("lat_i <> 58 OR lon_i <> 12"), path, 100, 32)
    return path


@query(with_fixtures(f", c AS (SELECT iy, ix, z, {_TILE} FROM dem_cells WHERE NOT {_LACKS}) SELECT iy, ix, CAST(z AS SMALLINT) AS z FROM c WHERE lat_i <> 58 OR lon_i <> 12", "dem_cells"))
def raw_mosaic(spark, sf_dir):
    """Raw elevation tiles, read by byte range and set side by side; unknown cells and those of a missing tile are left out."""
    return rasters.read_mosaic(spark, _raw(spark, sf_dir), 59, 11, 100).where("z IS NOT NULL")


@query(with_fixtures(f", c AS (SELECT z, {_TILE} FROM dem_cells WHERE NOT {_LACKS}) SELECT CAST(lat_i AS INT) AS lat_i, CAST(lon_i AS INT) AS lon_i, CAST(row AS INT) AS row, CAST(col AS INT) AS col, CAST(z AS SMALLINT) AS z FROM c WHERE (lat_i <> 58 OR lon_i <> 12) AND lat_i BETWEEN 56 AND 58 AND row BETWEEN 20 AND 61 AND col > 3 AND col <= 17", "dem_cells"))
def raw_window(spark, sf_dir):
    """A window of raw tiles: only the files, rows and columns that it meets are read."""
    window = {"lat_i": (56, 58), "row": (20, 61), "col": (4, 17)}
    return ranged.read_raw(spark, _raw(spark, sf_dir), 100, 2048, window).where("z IS NOT NULL").drop("ncols")


# land cover: files of 64 x 64 pixels that stand for three degrees, eight to a column of the map

_CLASS = "CASE WHEN iy % 9 = 0 THEN 20 WHEN ix % 11 = 0 THEN 50 ELSE 10 END"
_FILE = "'N' || lpad(CAST(57 - 3 * (iy // 64 % 8) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(12 + 3 * (iy // 512) AS VARCHAR), 3, '0')"


def _land_cover(spark, sf_dir) -> str:
    b = F.expr("iy div 64")
    name = geo.land_cover_name(57 - 3 * (b % 8), 12 + 3 * F.expr("iy div 512"))
    cells = fx.terrain(spark, sf_dir).select(name.alias("file"), (F.col("iy") % 64).cast("int").alias("row"), F.col("ix").cast("int").alias("col"), F.col("land_class").alias("value"))
    path = fresh_path(spark, "landcover")
    ranged.write_tiffs(cells, path, 64, 64, "u1", (16, 16), nodata=0)
    return path


@query(with_fixtures(f"""SELECT {_FILE} || '.tif' AS file, CAST(iy % 64 AS INT) AS row, CAST(ix AS INT) AS col, CAST({_CLASS} AS DOUBLE) AS value FROM dem_cells WHERE iy % 64 BETWEEN 10 AND 33 AND ix BETWEEN 5 AND 20""".replace("SELECT", " SELECT", 1), "dem_cells"))
def land_cover_window(spark, sf_dir):
    """A window of tiled land-cover rasters: only the tiles that it meets are read and inflated."""
    return ranged.read_tiff(spark, _land_cover(spark, sf_dir), window={"row": (10, 33), "col": (5, 20)}).where("value IS NOT NULL")


@query(with_fixtures(f""", t AS (SELECT c_custkey, 36 + c_custkey % 2100 / CAST(100 AS DOUBLE) AS lat, 12 + c_custkey % 607 / CAST(100 AS DOUBLE) AS lon FROM customer),
  k AS (SELECT *, CAST(floor(lat / 3) * 3 AS INT) AS a, CAST(floor(lon / 3) * 3 AS INT) AS o FROM t),
  i AS (SELECT c_custkey, 'N' || lpad(CAST(a AS VARCHAR), 2, '0') || 'E' || lpad(CAST(o AS VARCHAR), 3, '0') AS tile, CAST(greatest(least(floor((a + 3 - lat) / 3 * 64), 63), 0) AS INT) AS row, CAST(greatest(least(floor((lon - o) / 3 * 64), 63), 0) AS INT) AS col FROM k),
  p AS (SELECT {_FILE} AS tile, iy % 64 AS row, ix AS col, {_CLASS} AS cls FROM dem_cells)
  SELECT c_custkey, tile, CAST(cls AS INT) AS land_class FROM i LEFT JOIN p USING (tile, row, col)""", "dem_cells"))
def land_cover_at_places(spark, sf_dir):
    """The land cover of places: each place meets its pixel by tile, row and column; a missing tile gives none."""
    key = F.col("c_custkey")
    a, o, row, col = geo.land_cover_cell((36 + key % 2100 / F.lit(100.0)), (12 + key % 607 / F.lit(100.0)), 64)
    places = fx.table(spark, sf_dir, "customer").select("c_custkey", geo.land_cover_name(a, o).alias("tile"), row.alias("row"), col.alias("col"))
    pixels = ranged.read_tiff(spark, _land_cover(spark, sf_dir)).select(F.regexp_replace("file", r"\.tif$", "").alias("tile"), "row", "col", F.col("value").cast("int").alias("land_class"))
    return places.join(pixels, ["tile", "row", "col"], "left").select("c_custkey", "tile", "land_class")


@query(with_fixtures(""" SELECT 'canopy' || CAST(iy // 512 AS VARCHAR) || '.tif' AS file, CAST(iy % 512 // 32 AS INT) AS r, CAST(ix // 32 AS INT) AS c, CAST(max(z % 4 * 3) AS BIGINT) AS h_max, CAST(round_even(avg(z % 4 * 3), 0) AS BIGINT) AS h_mean FROM dem_smooth GROUP BY ALL""", "dem_smooth"))
def canopy_strips(spark, sf_dir):
    """Canopy rasters in strips of 40 rows, reduced to blocks of 32 pixels a side where they are read and added up where a block lies in two strips."""
    cells = fx.terrain(spark, sf_dir).select(F.concat(F.lit("canopy"), F.expr("iy div 512")).alias("file"), (F.col("iy") % 512).cast("int").alias("row"), F.col("ix").cast("int").alias("col"), F.col("canopy").alias("value"))
    path = fresh_path(spark, "canopy")
    ranged.write_tiffs(cells, path, 512, 64, "u1", (40, 0), nodata=255, tiled=False)
    return ranged.read_reduced(spark, path, 32, 4096)


# the ledger

@query("SELECT event_type AS key, count(*) AS rows, CASE WHEN event_type < 'm' THEN 'first' ELSE 'second' END AS run, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY event_type")
def ledgered_tiles(spark, sf_dir):
    """Tiles built in two runs, the second of which is asked for all and builds what the ledger lacks; entries beside what was built."""
    events = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "event_id", "user_id")
    out = fresh_path(spark, "ledgered")
    make = lambda keys: events.join(keys, "key")
    ledger.build(events.where("key < 'm'"), make, out, f"{out}-ledger", run="first")
    ledger.build(events, make, out, f"{out}-ledger", run="second")
    built = spark.read.parquet(out).groupBy(F.col("key").cast("string").alias("key")).agg(F.sum("user_id").alias("users"))
    return ledger.entries(spark, f"{out}-ledger").join(built, "key").select("key", "rows", "run", "users")


# the sun over a whole raster: heights unknown here and there, canopy over the eye, a tangent of its own in each cell

_AT, _PLACE = "2026-12-21 11:40:00", (57.0, 0.0002, 12.0, 0.0004)
_SOLAR = SQL["limb_tangents"]
_SOLAR = _SOLAR[_SOLAR.index(", q AS ("):_SOLAR.index(" SELECT event_id, CASE WHEN tangent")].replace("round(CASE", "(CASE").replace("END, 4) AS tangent", "END) AS tangent")

@query(with_fixtures(f""", places AS (SELECT iy * 64 + ix AS event_id, TIMESTAMP '{_AT}' AS ts, {_PLACE[0]} + iy * {D(_PLACE[1])} AS lat, {_PLACE[2]} + ix * {D(_PLACE[3])} AS lon FROM dem_smooth)""" + _sun_ctes("places") + _SOLAR + f""",
  g AS (SELECT iy, ix, CASE WHEN (iy * 7 + ix * 3) % 23 = 0 THEN NULL ELSE CAST(z AS DOUBLE) END AS z, z % 4 * 3 AS canopy, tangent FROM dem_smooth JOIN w ON event_id = iy * 64 + ix),
  r AS MATERIALIZED (SELECT iy, list(coalesce(z + canopy, {D(-1e9)}) ORDER BY ix) AS b, list(CASE WHEN canopy <= {D(1.7)} THEN z END ORDER BY ix) AS own, list(tangent ORDER BY ix) AS t FROM g GROUP BY iy),
  s AS (SELECT iy, b, own, t, list_transform(b, lambda x: {D(-1e9)}) AS sh FROM r WHERE iy = 0
    UNION ALL SELECT r.iy, r.b, r.own, r.t, list_transform(range(1, 65), lambda j: CASE WHEN j = 1 OR k.top[j] + (k.top[j - 1] - k.top[j]) * {D(-_DRIFT)} <= {D(-1e9)} THEN {D(-1e9)} ELSE k.top[j] + (k.top[j - 1] - k.top[j]) * {D(-_DRIFT)} - r.t[j] * {D(25 * math.hypot(1, _DRIFT))} END)
      FROM (SELECT iy, list_transform(range(1, 65), lambda j: greatest(b[j], sh[j])) AS top FROM s) k JOIN r ON r.iy = k.iy + 1)
  SELECT iy, CAST(generate_subscripts(b, 1) - 1 AS BIGINT) AS ix, unnest(list_transform(range(1, 65), lambda j: coalesce(t[j] > {D(math.tan(math.radians(sun.LOWEST)))} AND own[j] + {D(1.7)} >= sh[j], false))) AS lit FROM s""", "dem_smooth", recursive=True))
def sun_view_waves(spark, sf_dir):
    """Cells that see the sun at an instant, swept over the whole raster in tiles that hand their shadows on."""
    from overlook.operators.sunlight import sunlit_waves

    cells = fx.dem_smooth(spark, sf_dir).select("iy", "ix", F.when((F.col("iy") * 7 + F.col("ix") * 3) % 23 != 0, F.col("z").cast("double")).alias("z"), (F.col("z") % 4 * 3).alias("canopy"), F.lit(1.7).alias("eye_m"))
    edges = cells.agg(F.min("iy"), F.max("iy"), F.min("ix"), F.max("ix")).first()
    return sunlit_waves(sun.with_separable_tangent(cells, _AT, *_PLACE, tuple(edges)), 190.0, 25.0, 256, tuple(edges))


# markers and an outline over an image of 256 pixels that shows 10 km

_FONT = "[" + ", ".join(str(d) for d in shapes.DIGITS) + "]"

@query(f"""WITH s AS (SELECT s_suppkey AS rank, CAST(round_even((s_suppkey % 23 * {D(431.0)} - 5000 + 5000) / 10000 * 256, 0) AS BIGINT) AS cx, CAST(round_even(256 - (s_suppkey % 19 * {D(523.0)} - 5000 + 5000) / 10000 * 256, 0) AS BIGINT) AS cy FROM supplier),
  o AS (SELECT a.v AS dy, b.v AS dx FROM range(-7, 8) a(v), range(-7, 8) b(v) WHERE a.v * a.v + b.v * b.v <= 4 OR (a.v * a.v + b.v * b.v <= 49 AND a.v * a.v + b.v * b.v > 25)),
  t AS (SELECT cx, cy, CAST(rank AS VARCHAR) AS w, generate_series(1, len(CAST(rank AS VARCHAR))) AS n FROM s), u AS (SELECT cx, cy, w, unnest(n) AS n FROM t),
  f AS (SELECT cx + 9 + 4 * (n - 1) + c.v AS px, cy - 7 + l.v AS py FROM u, range(5) l(v), range(3) c(v) WHERE ({_FONT}[CAST(substr(w, n, 1) AS INT) + 1][l.v + 1] >> CAST(2 - c.v AS INT)) & 1 = 1),
  b AS (SELECT x.v AS px, y.v AS py FROM range(51, 206) x(v), range(51, 206) y(v) WHERE x.v < 53 OR x.v > 203 OR y.v < 53 OR y.v > 203),
  k AS (SELECT cx + dx AS px, cy + dy AS py FROM s, o UNION SELECT px, py FROM f UNION SELECT px, py FROM b)
  SELECT DISTINCT py, px FROM k WHERE py BETWEEN 0 AND 255 AND px BETWEEN 0 AND 255""")
def marked_map(spark, sf_dir):
    """Numbered markers at places and the outline of a box, as the pixels of PNG tiles of 64 pixels, drawn and read back."""
    key = F.col("s_suppkey")
    spots = fx.table(spark, sf_dir, "supplier").select(key.alias("rank"), (key % 23 * 431.0 - 5000).alias("x"), (key % 19 * 523.0 - 5000).alias("y"))
    drawn = stores.png_tiles(shapes.marked(spots, 3000.0, 10000.0, 256, -5000.0, -5000.0), 64)
    return stores.png_pixels(drawn, 64).where("a > 0").select("py", "px")
