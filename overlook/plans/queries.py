"""One query an operator over the general test tables, each with SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from overlook.functions import colour, geo, sun, tables, wedge
from overlook.functions.spots import decode_share, encode_share, route_url, search_url
from overlook.operators import lattice, neighbourhood, pyramid, relief, reports, scoring, tiles, viewshed, water
from overlook.operators import spots as spot_lists
from overlook.plans import fixtures as fx
from overlook.plans.catalog import QUERIES, SQL, query
from overlook.plans.fixtures import with_fixtures

D = lambda x: f"CAST({x!r} AS DOUBLE)"
R6 = lambda x: F.round(x, 6)
EAST = wedge.bins_between(45, 135)
MASK = sum(1 << b for b in EAST)
UNIT = geo.MAX_DISTANCE / 255

# wedges, reach, filters

REACH = f", reach AS (SELECT obs_id, gx, gy, CAST(sum(dist_u8) AS BIGINT) AS total FROM sig_long WHERE az BETWEEN {EAST[0]} AND {EAST[-1]} GROUP BY ALL)"


@query(with_fixtures(REACH + f" SELECT obs_id, round(total / CAST({len(EAST)} AS DOUBLE) * {D(UNIT)}, 6) AS openness FROM reach", "sig_long"))
def wedge_openness(spark, sf_dir):
    """Mean reach over the eastern wedge."""
    wide = fx.sig_wide(spark, sf_dir)
    return wide.select("obs_id", R6(geo.dequantise_distance(wedge.mean_of(F.col("dist"), EAST))).alias("openness"))


@query(with_fixtures(f" SELECT obs_id, CAST(max(dist_u8) AS BIGINT) AS best, CAST(min(az) FILTER (WHERE dist_u8 = m) AS BIGINT) AS best_az FROM (SELECT *, max(dist_u8) OVER (PARTITION BY obs_id) AS m FROM sig_long WHERE az BETWEEN {EAST[0]} AND {EAST[-1]}) GROUP BY obs_id", "sig_long"))
def best_direction(spark, sf_dir):
    """Farthest direction of the wedge, the first on ties."""
    return scoring.best_direction(fx.sig_wide(spark, sf_dir), EAST).select("obs_id", "best", F.col("best_az").cast("long").alias("best_az"))


@query(with_fixtures(f" SELECT obs_id, water, (water & {MASK}) <> 0 AS seen, (water & 2147483648) <> 0 AS bit31, bit_count(water) AS n FROM sig_water", "sig_water"))
def water_bitmask(spark, sf_dir):
    """Water bits, of which bit 31 needs a long."""
    wide = fx.sig_wide(spark, sf_dir)
    return wide.select("obs_id", "water", wedge.sees_water(F.col("water"), EAST).alias("seen"), geo.has_bit(F.col("water"), 31).alias("bit31"), F.bit_count("water").cast("tinyint").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(floor(greatest(least(CAST(l_extendedprice AS DOUBLE) / {D(geo.MAX_DISTANCE)} * 255, 255), 0)) AS INT) AS q, round(CAST(floor(greatest(least(CAST(l_extendedprice AS DOUBLE) / {D(geo.MAX_DISTANCE)} * 255, 255), 0)) AS INT) * {D(UNIT)}, 6) AS back FROM lineitem")
def quantise_reach(spark, sf_dir):
    """Distances to bytes and back."""
    q = geo.quantise_distance(F.col("l_extendedprice").cast("double"))
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), R6(geo.dequantise_distance(q)).alias("back"))


@query(with_fixtures(" SELECT obs_id, az, (az * CAST(11.25 AS DOUBLE) >= 340 OR az * CAST(11.25 AS DOUBLE) <= 20) AS north, az = 0 AS full_turn, ((CAST(az * 11.25 - 45 AS DOUBLE) + 360) % 360) <= 90 AS wheel FROM sig_long", "sig_long"))
def direction_wedge(spark, sf_dir):
    """Wedges across north, of a full turn, and by the wheel."""
    az = F.col("az") * 11.25
    return fx.sig_long(spark, sf_dir).select("obs_id", "az", wedge.in_wedge(az, 340, 20).alias("north"), wedge.in_wedge(az, 0, 360).alias("full_turn"), wedge.on_wheel(az, 45, 135).alias("wheel"))


@query(with_fixtures(REACH + f""", s AS (SELECT *, total / CAST({len(EAST)} AS DOUBLE) * {D(UNIT)} AS reach FROM reach)
    SELECT s.obs_id, round(reach, 6) AS reach FROM s JOIN sig_site USING (obs_id) JOIN sig_water USING (obs_id)
    WHERE valid AND canopy_m <= 20 AND (water & {MASK}) <> 0 AND reach >= 8000 AND reach <= 11000""", "sig_long", "sig_site", "sig_water"))
def view_filter(spark, sf_dir):
    """Wedge, band, water and canopy filters, without a neighbourhood."""
    q = scoring.ViewQuery(wheel=wedge.Wheel(45, 135), band=wedge.Band(8.0, 11.0), require_water=True, max_canopy_m=20)
    own = fx.sig_wide(spark, sf_dir).withColumn("canopy", F.col("canopy_m"))
    return q.score(own, step=200.0).select("obs_id", R6("reach").alias("reach"))


@query(with_fixtures(f""", m AS (SELECT obs_id, az, dist_u8 * {D(UNIT)} AS d FROM sig_long WHERE az BETWEEN 26 AND 30),
    a AS (SELECT obs_id, avg(CASE WHEN d >= 9000 THEN d ELSE 0 END) AS openness, max(CASE WHEN d >= 9000 THEN d ELSE 0 END) AS best FROM m GROUP BY obs_id)
    SELECT obs_id, round(openness, 6) AS openness, round(best, 6) AS best, best >= 9000 AND valid AND EXISTS (SELECT 1 FROM emb e WHERE e.vec_id = a.obs_id AND e.p BETWEEN 26 + 32 AND 30 + 32 AND e.e * 20000 >= 300) AS keep FROM a JOIN sig_site USING (obs_id)""", "sig_long", "sig_site"))
def filters_apply(spark, sf_dir):
    """The other scorer: least distance a direction, water by distance, keep rule."""
    wide = fx.sig_wide(spark, sf_dir)
    far = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double") * 20000).alias("water_far"))
    sig = wide.join(far, "obs_id").select("obs_id", F.transform("dist", lambda q: geo.dequantise_distance(q)).alias("max_dist"), "water_far", (~F.col("valid")).alias("on_water"), F.col("elev_m").alias("ground"))
    f = scoring.Filters(min_distance=9000.0, directions=(292.5, 337.5), require_water=True, min_water_distance=300.0)
    return f.apply(sig).select("obs_id", R6("openness").alias("openness"), R6("best").alias("best"), "keep")


# neighbourhoods and best spots


def _total(dist):
    return F.aggregate(wedge.picked(dist, EAST), F.lit(0).cast("long"), lambda a, x: a + x)


QUARTILE = REACH + """, land AS (SELECT r.* FROM reach r JOIN sig_site s USING (obs_id) WHERE s.valid),
  nb AS (SELECT a.obs_id, b.total, row_number() OVER (PARTITION BY a.obs_id ORDER BY b.total) AS rn, count(*) OVER (PARTITION BY a.obs_id) AS n
         FROM land a JOIN land b ON b.gy BETWEEN a.gy - 1 AND a.gy + 1 AND b.gx BETWEEN a.gx - 1 AND a.gx + 1),
  plot AS (SELECT obs_id, total FROM nb WHERE rn = CAST(floor(n * CAST(0.25 AS DOUBLE)) AS BIGINT) + 1)"""


@query(with_fixtures(QUARTILE + " SELECT l.gy, l.gx, p.total FROM plot p JOIN land l USING (obs_id)", "sig_long", "sig_site"))
def plot_quartile(spark, sf_dir):
    """The lower quartile of land neighbours; water has no part in it."""
    wide = fx.sig_wide(spark, sf_dir).where("valid")
    return neighbourhood.land_quartile(wide.select("gy", "gx", _total(F.col("dist")).alias("total")), "total", 1)


@query(with_fixtures(REACH + """, n AS (SELECT CAST(max(gy) AS BIGINT) + 1 AS rows FROM sig_long), g AS (SELECT gy, gx, total AS v, rows FROM reach, n WHERE gy < rows),
  o AS (SELECT a.gy, a.gx, a.rows, y.dy + a.gy AS sy, x.dx + a.gx AS sx FROM g a, (SELECT unnest([-1, 0, 1]) AS dy) y, (SELECT unnest([-1, 0, 1]) AS dx) x),
  m AS (SELECT gy, gx, CASE WHEN sy < 0 THEN 0 WHEN sy >= rows THEN rows - 1 ELSE sy END AS sy, CASE WHEN sx < 0 THEN 0 WHEN sx > 24 THEN 24 ELSE sx END AS sx FROM o),
  k AS (SELECT m.gy, m.gx, g.v, row_number() OVER (PARTITION BY m.gy, m.gx ORDER BY g.v) AS rn FROM m JOIN g ON g.gy = m.sy AND g.gx = m.sx)
  SELECT gy, gx, v FROM k WHERE rn = 3""", "sig_long"))
def plot_percentile(spark, sf_dir):
    """The reflecting percentile: all nine cells count."""
    wide = fx.sig_wide(spark, sf_dir).select("gy", "gx", _total(F.col("dist")).alias("v"))
    rows = (wide.agg(F.max("gy")).first()[0] or 0) + 1
    return neighbourhood.plot_percentile(wide, "v", rows, fx.COLS, 100.0)


TOP = """, cand AS (SELECT p.obs_id, l.gy AS y, l.gx AS x, p.total, row_number() OVER (ORDER BY p.total DESC, p.obs_id) AS rn FROM plot p JOIN land l USING (obs_id)
    JOIN sig_site s USING (obs_id) JOIN sig_water w USING (obs_id) WHERE s.canopy_m <= 20 AND (w.water & {mask}) <> 0 AND p.total > 0),
  fold AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, y BIGINT, x BIGINT, v BIGINT)[]) AS acc
    UNION ALL SELECT f.rn + 1, CASE WHEN len(f.acc) < 10 AND len(list_filter(f.acc, lambda q: abs(q.y - c.y) <= 3 AND abs(q.x - c.x) <= 3)) = 0
      THEN list_append(f.acc, {{'id': c.obs_id, 'y': c.y, 'x': c.x, 'v': c.total}}) ELSE f.acc END FROM fold f JOIN cand c ON c.rn = f.rn + 1 WHERE len(f.acc) < 10),
  last AS (SELECT acc FROM fold ORDER BY rn DESC LIMIT 1)
  SELECT CAST(generate_subscripts(acc, 1) AS BIGINT) AS rank, unnest(list_transform(acc, lambda q: q.id)) AS obs_id, unnest(list_transform(acc, lambda q: q.y)) AS gy,
    unnest(list_transform(acc, lambda q: q.x)) AS gx, round(unnest(list_transform(acc, lambda q: q.v)) / CAST({n} AS DOUBLE) * {unit}, 6) AS score FROM last""".format(mask=MASK, n=len(EAST), unit=D(UNIT))


@query(with_fixtures(QUARTILE + TOP, "sig_long", "sig_site", "sig_water", recursive=True))
def best_viewpoints(spark, sf_dir):
    """Ten separated viewpoints to the east: reach over a plot, land, canopy, water in view. The flagship."""
    q = scoring.ViewQuery(wheel=wedge.Wheel(45, 135), require_water=True, max_canopy_m=20)
    own = fx.sig_wide(spark, sf_dir).withColumn("canopy", F.col("canopy_m"))
    return scoring.top_spots(q.score(own, step=50.0), 10, 3).withColumn("score", R6("score"))


QUERIES["top_spots"] = lambda spark, sf_dir: scoring.top_spots(fx.sig_wide(spark, sf_dir).select("obs_id", "gy", "gx", _total(F.col("dist")).alias("v")), 20, scoring.separation(1000.0), "v")
SQL["top_spots"] = with_fixtures(REACH + """, cand AS (SELECT obs_id, gy AS y, gx AS x, total AS v, row_number() OVER (ORDER BY total DESC, obs_id) AS rn FROM reach WHERE total > 0),
  fold AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, y BIGINT, x BIGINT, v BIGINT)[]) AS acc
    UNION ALL SELECT f.rn + 1, CASE WHEN len(f.acc) < 20 AND len(list_filter(f.acc, lambda q: abs(q.y - c.y) <= 3 AND abs(q.x - c.x) <= 3)) = 0
      THEN list_append(f.acc, {'id': c.obs_id, 'y': c.y, 'x': c.x, 'v': c.v}) ELSE f.acc END FROM fold f JOIN cand c ON c.rn = f.rn + 1 WHERE len(f.acc) < 20),
  last AS (SELECT acc FROM fold ORDER BY rn DESC LIMIT 1)
  SELECT CAST(generate_subscripts(acc, 1) AS BIGINT) AS rank, unnest(list_transform(acc, lambda q: q.id)) AS obs_id, unnest(list_transform(acc, lambda q: q.y)) AS gy,
    unnest(list_transform(acc, lambda q: q.x)) AS gx, CAST(unnest(list_transform(acc, lambda q: q.v)) AS DOUBLE) AS score FROM last""", "sig_long", recursive=True)

# reports

MEAN = f", mr AS (SELECT obs_id, gy, avg(dist_u8) * {D(UNIT)} AS mean_reach FROM sig_long GROUP BY obs_id, gy), o AS (SELECT mr.*, valid, canopy_m, water, obs_id % 3 AS eye FROM mr JOIN sig_site USING (obs_id) JOIN sig_water USING (obs_id))"


def _observers(spark, sf_dir):
    total = F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x)
    return fx.sig_wide(spark, sf_dir).withColumns({"mean_reach": geo.dequantise_distance(total / F.lit(32.0)), "eye": F.col("obs_id") % 3})


@query(with_fixtures(MEAN + """ SELECT eye, count(*) AS n, round(avg(CAST(valid AS INT)) * 100, 6) AS land_pct, round(quantile_cont(mean_reach, 0.5) FILTER (WHERE valid), 6) AS reach_p50,
    round(quantile_cont(mean_reach, 0.9) FILTER (WHERE valid), 6) AS reach_p90, round(max(mean_reach) FILTER (WHERE valid), 6) AS reach_max, round(avg(CAST(water <> 0 AS INT)) FILTER (WHERE valid) * 100, 6) AS water_pct,
    quantile_cont(CAST(canopy_m AS DOUBLE), 0.5) FILTER (WHERE valid) AS canopy_p50, round(avg(CAST(canopy_m < 2 AS INT)) FILTER (WHERE valid) * 100, 6) AS open_pct, round(avg(CAST(canopy_m >= 5 AS INT)) FILTER (WHERE valid) * 100, 6) AS forest_pct
    FROM o WHERE gy % 7 = 0 GROUP BY eye""", "sig_long", "sig_site", "sig_water"))
def region_summary(spark, sf_dir):
    """Medians, percentiles and shares by eye height, every seventh row."""
    out = reports.region_summary(_observers(spark, sf_dir), ["eye"])
    rounded = [c for c in out.columns if c not in ("eye", "n", "canopy_p50")]
    return out.withColumns({c: R6(c) for c in rounded})


@query(with_fixtures(MEAN + " SELECT coalesce(CAST(valid AS VARCHAR), 'all') AS valid, coalesce(eye, -1) AS eye, count(*) AS n, round(avg(mean_reach), 6) AS mean_reach, round(max(mean_reach), 6) AS max_reach, count(*) FILTER (WHERE water <> 0) AS n_water FROM o WHERE valid GROUP BY CUBE (valid, eye)", "sig_long", "sig_site", "sig_water"))
def summary_cube(spark, sf_dir):
    """Totals by every combination of two dimensions; beyond the reference."""
    out = reports.summary_cube(_observers(spark, sf_dir), ["valid", "eye"]).withColumns({"mean_reach": R6("mean_reach"), "max_reach": R6("max_reach")})
    return out.withColumns({"valid": F.coalesce(F.col("valid").cast("string"), F.lit("all")), "eye": F.coalesce("eye", F.lit(-1).cast("long"))})


COMPASS_SQL = "[" + ", ".join(f"'{c}'" for c in geo.COMPASS) + "]"


@query(with_fixtures(f""", d AS (SELECT obs_id, az, dist_u8 * {D(UNIT)} AS d, max(dist_u8) OVER (PARTITION BY obs_id) = dist_u8 AS top FROM sig_long),
    a AS (SELECT obs_id, round(avg(d), 6) AS mean_d, round(median(d), 6) AS median_d, round(max(d), 6) AS best_d, min(az) FILTER (WHERE top) AS best_az, count(*) FILTER (WHERE d > 5000) AS n_far FROM d GROUP BY obs_id)
    SELECT *, {COMPASS_SQL}[1 + CAST(round_even(best_az * CAST(11.25 AS DOUBLE) / CAST(22.5 AS DOUBLE), 0) AS BIGINT) % 16] AS best_name FROM a""", "sig_long"))
def point_report(spark, sf_dir):
    """Each observer's mean, median and best direction."""
    out = reports.point_report(fx.sig_long(spark, sf_dir).withColumn("d", geo.dequantise_distance(F.col("dist_u8"))))
    return out.withColumns({c: R6(c) for c in ("mean_d", "median_d", "best_d")})


@query(with_fixtures(" SELECT quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.99) AS p99, max(v) AS most FROM (SELECT max(dist_u8) / CAST(4 AS DOUBLE) AS v FROM sig_long WHERE gy % 11 = 0 AND gx % 11 = 0 GROUP BY obs_id)", "sig_long"))
def descent_percentiles(spark, sf_dir):
    """Percentiles over every eleventh row and column."""
    return reports.descent_percentiles(fx.sig_wide(spark, sf_dir).withColumn("drop_max", F.array_max("dist")))


@query(with_fixtures(""", p AS (SELECT vec_id AS point_id, vec_id AS py, vec_id % 64 AS px FROM embeddings)
    SELECT point_id, CAST(min(z) AS BIGINT) AS lowest, CAST(max(z) AS BIGINT) AS highest, max(z) FILTER (WHERE iy = py AND ix = px) - median(z) AS above_median
    FROM p JOIN dem_cells ON iy BETWEEN py - 40 AND py + 40 AND ix BETWEEN px - 40 AND px + 40 GROUP BY point_id""", "dem_cells"))
def local_relief(spark, sf_dir):
    """Height above the median within a kilometre of each point."""
    points = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("vec_id").alias("py"), (F.col("vec_id") % 64).alias("px"))
    return reports.local_relief(fx.dem_cells(spark, sf_dir), points, 40)


@query(with_fixtures(""", l AS (SELECT s_suppkey, s_suppkey * 7 % 60 AS iy, s_suppkey % 64 AS ix, CAST(200 AS DOUBLE) AS expected_m, CAST(s_suppkey % 40 AS DOUBLE) AS tolerance_m FROM supplier)
    SELECT s_suppkey, CAST(z AS DOUBLE) - expected_m AS difference, coalesce(abs(z - expected_m) <= tolerance_m, false) AS ok FROM l LEFT JOIN dem_cells d ON d.iy = l.iy AND d.ix = l.ix""", "dem_cells"))
def verify_landmarks(spark, sf_dir):
    """Known heights against the raster, within tolerance."""
    key = F.col("s_suppkey")
    marks = fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.struct((key * 7 % 60).cast("long").alias("iy"), (key % 64).cast("long").alias("ix")).alias("key"), F.lit(200.0).alias("expected_m"), (key % 40).cast("double").alias("tolerance_m"))
    heights = fx.dem_cells(spark, sf_dir).select(F.struct("iy", "ix").alias("key"), "z")
    return reports.verify_landmarks(marks, heights).select("s_suppkey", "difference", "ok")


# viewshed: 32 bearings, 257 samples to 20 km

STEPS_SQL = "(SELECT unnest([" + ", ".join(D(d) for d in viewshed.radial_steps()) + "]) AS d)"


BEARINGS_SQL = "(VALUES " + ", ".join(f"({a}, {D(e)}, {D(n)})" for a in range(32) for e, n in [geo.bearing(a, 32)]) + ") v(a, east, north)"


@query("WITH l AS (SELECT unnest([" + ", ".join(D(d) for d in viewshed.radial_steps()) + "]) AS d, generate_subscripts([" + ", ".join("0" for _ in viewshed.radial_steps()) + """], 1) - 1 AS i),
    s AS (SELECT s_suppkey, CAST(1000 + s_suppkey % 20 * 1000 AS DOUBLE) AS reach FROM supplier)
    SELECT s_suppkey, CAST(i AS INT) AS step, d FROM s JOIN l ON d < reach - 1e-6 UNION ALL SELECT s_suppkey, CAST((SELECT count(*) FROM l WHERE d < reach - 1e-6) AS INT), reach FROM s""")
def ray_schedule(spark, sf_dir):
    """The sample distances of rays of many lengths, by a table function of SQL."""
    tables.register(spark)
    return spark.sql("SELECT s_suppkey, r.step, r.d FROM {supplier}, LATERAL rays(CAST(1000 + s_suppkey % 20 * 1000 AS DOUBLE)) AS r", supplier=fx.table(spark, sf_dir, "supplier"))


def _seen_sql(last: str, eyes: list[float], bearings: str = "range(32)", tops: str = "SELECT 'top' AS surface, iy, ix, CAST(z AS DOUBLE) AS z FROM dem_smooth", every: int = 4, wet: bool = False) -> str:
    """Table expressions ``ob`` (observers) and ``w`` (all samples inside the raster, with the largest tangent before each)."""
    water = ", coalesce((SELECT z <= 190 FROM dem_smooth q WHERE q.iy = CAST(round_even(fy, 0) AS BIGINT) AND q.ix = CAST(round_even(fx, 0) AS BIGINT)), false) AS wet" if wet else ""
    return with_fixtures(f""", ray AS MATERIALIZED (SELECT CAST(a AS INT) AS az, d, north * d AS dy, east * d AS dx FROM {BEARINGS_SQL} JOIN {bearings} b(a) USING (a), {STEPS_SQL}),
      tops AS ({tops}), n AS (SELECT max(iy) AS last FROM dem_smooth),
      sq AS MATERIALIZED (SELECT a.surface, a.iy, a.ix, a.z AS z00, b.z AS z01, c.z AS z10, e.z AS z11 FROM tops a JOIN tops b ON b.surface = a.surface AND b.iy = a.iy AND b.ix = a.ix + 1
        JOIN tops c ON c.surface = a.surface AND c.iy = a.iy + 1 AND c.ix = a.ix JOIN tops e ON e.surface = a.surface AND e.iy = a.iy + 1 AND e.ix = a.ix + 1),
      ob AS MATERIALIZED (SELECT iy // {every} * {64 // every} + ix // {every} AS obs_id, iy, ix, z FROM dem_smooth, n WHERE iy % {every} = 0 AND ix % {every} = 0 AND iy < last AND ix < 63),
      p0 AS MATERIALIZED (SELECT obs_id, z, az, d, (iy * 25 + dy) / 25 AS fy, (ix * 25 + dx) / 25 AS fx FROM ob, ray),
      p AS MATERIALIZED (SELECT p0.*, CAST(floor(fy) AS BIGINT) AS ky, CAST(floor(fx) AS BIGINT) AS kx FROM p0, n WHERE fy >= 0 AND fy < last AND fx >= 0 AND fx < 63),
      h AS (SELECT obs_id, surface, z, az, d, (z00 * (1 - (fx - floor(fx))) + z01 * (fx - floor(fx))) * (1 - (fy - floor(fy))) + (z10 * (1 - (fx - floor(fx))) + z11 * (fx - floor(fx))) * (fy - floor(fy)) AS h{water}
        FROM (SELECT * FROM p) p JOIN sq ON sq.iy = ky AND sq.ix = kx),
      s AS (SELECT h.*, eye, (h - d * d / (2 * {D(geo.EFFECTIVE_RADIUS)}) - (z + eye)) / d AS t FROM h, (SELECT unnest([{", ".join(map(D, eyes))}]) AS eye)),
      w AS (SELECT *, max(t) OVER (PARTITION BY obs_id, surface, eye, az ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
      g AS MATERIALIZED (SELECT obs_id AS o, surface AS v, eye AS e, az AS a, max(t) AS horizon, max(d) FILTER (WHERE before IS NULL OR t > before) AS far{", min(d) FILTER (WHERE wet AND (before IS NULL OR t > before)) AS wet_near, max(d) FILTER (WHERE wet AND (before IS NULL OR t > before)) AS wet_far" if wet else ""} FROM w GROUP BY ALL),
      every AS (SELECT obs_id, CAST(a AS INT) AS az, eye, surface FROM ob CROSS JOIN {bearings} b(a) CROSS JOIN (SELECT unnest([{", ".join(map(D, eyes))}]) AS eye) x CROSS JOIN (SELECT DISTINCT surface FROM tops) y),
      found AS (SELECT * FROM every LEFT JOIN g ON o = obs_id AND a = az AND e = eye AND v = surface)
      {last} FROM found""", "dem_smooth")



@query(_seen_sql("SELECT obs_id, round(horizon, 6) AS horizon, coalesce(far, 0) AS max_dist", [1.7], "(SELECT 8)", every=1))
def viewshed_axis(spark, sf_dir):
    """Horizon and reach to the east from every cell: the relational form, against a running maximum in the oracle."""
    cells = fx.dem_smooth(spark, sf_dir)
    seen = cells.select((F.col("iy") * 64 + F.col("ix")).alias("obs_id"), (F.col("iy") * 25.0).alias("y"), (F.col("ix") * 25.0).alias("x"))
    return viewshed.compute(spark, seen, cells, 25.0, (1.7,), [8]).select("obs_id", R6("horizon").alias("horizon"), "max_dist")


def _bulk(spark, sf_dir, eyes, cells=None):
    return viewshed.compute_tiles(fx.observers(spark, sf_dir), fx.dem_smooth(spark, sf_dir) if cells is None else cells, 25.0, 512, eyes)


@query(_seen_sql("SELECT obs_id, az, round(horizon, 6) AS horizon, coalesce(far, 0) AS max_dist", [1.7]))
def viewshed_full(spark, sf_dir):
    """Horizon and reach in all directions, in bulk."""
    out = _bulk(spark, sf_dir, 1.7).select("obs_id", F.posexplode(F.arrays_zip("horizon", "max_dist")).alias("az", "s"))
    return out.select("obs_id", "az", F.round("s.horizon", 6).alias("horizon"), "s.max_dist")


@query(_seen_sql("SELECT obs_id, eye, az, coalesce(far, 0) AS max_dist", [0.0, 1.7, 5.0]))
def viewshed_multi_eye(spark, sf_dir):
    """Three eye heights in one pass."""
    return _bulk(spark, sf_dir, (0.0, 1.7, 5.0)).select("obs_id", "eye", F.posexplode("max_dist").alias("az", "max_dist"))


@query(_seen_sql("SELECT obs_id, az, wet_near AS water_near, coalesce(wet_far, 0) AS water_far", [5.0], wet=True))
def visible_water(spark, sf_dir):
    """Nearest and farthest water in view in all directions."""
    cells = fx.dem_smooth(spark, sf_dir).withColumn("is_water", F.col("z") <= 190)
    out = _bulk(spark, sf_dir, 5.0, cells).select("obs_id", F.posexplode(F.arrays_zip("water_near", "water_far")).alias("az", "s"))
    return out.select("obs_id", "az", "s.water_near", "s.water_far")


TREES = """SELECT 'bare' AS surface, iy, ix, CAST(z AS DOUBLE) AS z FROM dem_smooth UNION ALL SELECT 'trees', iy, ix, z + CASE WHEN iy % 9 = 0 THEN greatest(z % 4 * 3, 2) WHEN ix % 11 = 0 THEN greatest(z % 4 * 3, 6) ELSE z % 4 * 3 END FROM dem_smooth"""


@query(_seen_sql("SELECT surface AS veg, CAST(round(eye * 100) AS INT) AS eye_cm, obs_id, az, CAST(floor(greatest(least(coalesce(far, 0) / 20000 * 255, 255), 0)) AS SMALLINT) AS dist, wet_far IS NOT NULL AS water", [0.0, 1.7, 5.0], tops=TREES, wet=True))
def tile_build(spark, sf_dir):
    """The region build's six signature sets, two surfaces by three eyes, in one pass: bytes and bits."""
    from overlook.plans import builds

    ground = fx.terrain(spark, sf_dir).withColumns({"obstruction": geo.obstruction(F.col("canopy"), F.col("land_class")), "is_water": F.col("z") <= 190})
    sets = builds.signatures(fx.observers(spark, sf_dir), ground, 512)
    out = sets.select("veg", "eye_cm", "obs_id", "water", F.posexplode("dist").alias("az", "dist"))
    return out.withColumn("water", F.call_function("shiftright", F.col("water"), F.col("az")).bitwiseAND(F.lit(1)) == 1)


# relief, neighbourhoods of terrain

@query(with_fixtures(f""", n AS (SELECT max(iy) AS last FROM dem_smooth), o AS MATERIALIZED (SELECT iy // 4 * 16 + ix // 4 AS obs_id, iy, ix, z FROM dem_smooth, n WHERE iy % 4 = 0 AND ix % 4 = 0 AND iy < last AND ix < 63),
    p AS MATERIALIZED (SELECT obs_id, z, CAST(a AS INT) AS az, d, (iy * 25 + cos(2 * pi() * a / 32) * d) / 25 AS fy, (ix * 25 + sin(2 * pi() * a / 32) * d) / 25 AS fx FROM o, range(32) r(a), (SELECT unnest([CAST(250 AS DOUBLE), 500, 1000, 2000]) AS d)),
    k AS (SELECT p.*, (a.z * (1 - (fx - floor(fx))) + b.z * (fx - floor(fx))) * (1 - (fy - floor(fy))) + (c.z * (1 - (fx - floor(fx))) + e.z * (fx - floor(fx))) * (fy - floor(fy)) AS h FROM p
      LEFT JOIN dem_smooth a ON a.iy = floor(fy) AND a.ix = floor(fx) LEFT JOIN dem_smooth b ON b.iy = floor(fy) AND b.ix = floor(fx) + 1 LEFT JOIN dem_smooth c ON c.iy = floor(fy) + 1 AND c.ix = floor(fx) LEFT JOIN dem_smooth e ON e.iy = floor(fy) + 1 AND e.ix = floor(fx) + 1),
    l AS (SELECT obs_id, az, min(coalesce(degrees(atan2(z - h, d)), 0)) AS least FROM k GROUP BY obs_id, az)
    SELECT obs_id, az, CAST(floor(greatest(least(least * 4, 255), 0)) AS SMALLINT) AS drop FROM l""", "dem_smooth"))
def sustained_descent(spark, sf_dir):
    """Least angle down at 250 m to 2 km in all directions, in quarter degrees."""
    from overlook.plans import builds

    return builds.build_relief(fx.observers(spark, sf_dir), fx.dem_smooth(spark, sf_dir)).select("obs_id", F.posexplode("drop").alias("az", "drop"))


NB = """, nb AS (SELECT a.iy, a.ix, min(b.z) AS low, max(b.z) AS high FROM dem_smooth a, (SELECT unnest([-1, 0, 1]) AS dy) y, (SELECT unnest([-1, 0, 1]) AS dx) x, dem_smooth b
    WHERE b.iy = a.iy + dy AND b.ix = a.ix + dx GROUP BY a.iy, a.ix)"""


@query(with_fixtures(NB + " SELECT iy, ix, high - low <= 12 AS flat FROM nb", "dem_smooth"))
def flat_mask(spark, sf_dir):
    """Cells with little relief around them."""
    return neighbourhood.flat_cells(fx.dem_smooth(spark, sf_dir), 12)


@query(with_fixtures(""", c AS (SELECT iy, ix FROM dem_smooth WHERE z <= 190),
    r AS (SELECT iy, ix, iy AS sy, ix AS sx FROM c UNION SELECT c.iy, c.ix, r.sy, r.sx FROM r JOIN c ON abs(c.iy - r.iy) + abs(c.ix - r.ix) = 1),
    l AS (SELECT iy, ix, min(sy * 64 + sx) AS patch FROM r GROUP BY iy, ix)
    SELECT iy, ix, patch, count(*) OVER (PARTITION BY patch) AS n FROM l""", "dem_smooth", recursive=True))
def water_components(spark, sf_dir):
    """4-connected patches of low cells, named by their first cell."""
    low = fx.dem_smooth(spark, sf_dir).where("z <= 190").select("iy", "ix")
    named = water.patches(low)
    sizes = named.groupBy("patch").agg(F.count("*").alias("n"))
    return named.join(sizes, "patch").select("iy", "ix", (F.col("patch.ry") * 64 + F.col("patch.rx")).alias("patch"), "n")


@query(with_fixtures(NB + """, c AS (SELECT nb.iy, nb.ix FROM nb JOIN dem_smooth d ON d.iy = nb.iy AND d.ix = nb.ix WHERE high - low <= 12 OR z <= 185),
    r AS (SELECT iy, ix, iy * 64 + ix AS s FROM c UNION SELECT c.iy, c.ix, r.s FROM r JOIN c ON abs(c.iy - r.iy) + abs(c.ix - r.ix) = 1),
    l AS (SELECT iy, ix, min(s) AS patch FROM r GROUP BY iy, ix), k AS (SELECT iy, ix, count(*) OVER (PARTITION BY patch) AS n FROM l)
    SELECT d.iy, d.ix, coalesce(k.n >= 6, false) AS is_water FROM dem_smooth d LEFT JOIN k ON k.iy = d.iy AND k.ix = d.ix""", "dem_smooth", recursive=True))
def detect_water(spark, sf_dir):
    """Flat or low patches of six cells at least."""
    return water.detect_water(fx.dem_smooth(spark, sf_dir), 100.0, 12, 6.0, 185).select("iy", "ix", "is_water")


@query("SELECT p_partkey, greatest(CASE WHEN c = 50 THEN greatest(h, 6) ELSE h END, CASE WHEN c = 20 THEN 2 ELSE 0 END) AS obstruction FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) / 5 AS h, CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 50 END AS c FROM part)")
def obstruction_height(spark, sf_dir):
    """Canopy, buildings and shrubs as heights on the ground."""
    kind = F.when(F.col("p_partkey") % 3 == 0, 10).when(F.col("p_partkey") % 3 == 1, 20).otherwise(50)
    return fx.table(spark, sf_dir, "part").select("p_partkey", geo.obstruction(F.col("p_size") / F.lit(5.0), kind).alias("obstruction"))


@query(with_fixtures(f""", g AS (SELECT iy, ix, z * 2 AS h, lag(z * 2) OVER r AS w, lead(z * 2) OVER r AS e, lag(z * 2) OVER c AS s, lead(z * 2) OVER c AS n FROM dem_smooth WINDOW r AS (PARTITION BY iy ORDER BY ix), c AS (PARTITION BY ix ORDER BY iy)),
    k AS (SELECT iy, ix, CASE WHEN w IS NULL THEN e - h WHEN e IS NULL THEN h - w ELSE (e - w) / CAST(2 AS DOUBLE) END / CAST(25 AS DOUBLE) AS gx, CASE WHEN s IS NULL THEN n - h WHEN n IS NULL THEN h - s ELSE (n - s) / CAST(2 AS DOUBLE) END / CAST(25 AS DOUBLE) AS gy FROM g),
    t AS (SELECT iy, ix, atan(sqrt(gx * gx + gy * gy)) AS slope, atan2(-gx, -gy) AS falls FROM k)
    SELECT iy, ix, round(greatest(least({D(math.sin(math.radians(45)))} * cos(slope) + {D(math.cos(math.radians(45)))} * sin(slope) * cos({D(math.radians(315))} - falls), 1), 0), 6) AS shade FROM t""", "dem_smooth"))
def hillshade(spark, sf_dir):
    """Light on slopes from the north-west."""
    return neighbourhood.hillshade(fx.dem_smooth(spark, sf_dir), "z", 25.0).select("iy", "ix", R6("shade").alias("shade"))


@query(with_fixtures(""", n AS (SELECT max(iy) + 1 AS rows FROM dem_cells), k AS (SELECT unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) AS k), w AS (SELECT k, exp(-CAST(k * k AS DOUBLE) / 2) / (SELECT sum(exp(-CAST(k * k AS DOUBLE) / 2)) FROM k) AS w FROM k),
    a AS (SELECT c.iy, c.ix, sum(d.z * w.w) AS z FROM dem_cells c, n, w, dem_cells d WHERE d.ix = c.ix AND d.iy = CASE WHEN c.iy + k < 0 THEN -1 - c.iy - k WHEN c.iy + k >= rows THEN 2 * rows - 1 - c.iy - k ELSE c.iy + k END GROUP BY c.iy, c.ix),
    b AS (SELECT c.iy, c.ix, sum(d.z * w.w) AS z FROM a c, w, a d WHERE d.iy = c.iy AND d.ix = CASE WHEN c.ix + k < 0 THEN -1 - c.ix - k WHEN c.ix + k >= 64 THEN 127 - c.ix - k ELSE c.ix + k END GROUP BY c.iy, c.ix)
    SELECT iy, ix, round(z, 6) AS z FROM b""", "dem_cells"))
def gaussian_smooth(spark, sf_dir):
    """Separable Gaussian smoothing with reflecting borders."""
    cells = fx.dem_cells(spark, sf_dir)
    rows = (cells.agg(F.max("iy")).first()[0] or 0) + 1
    return neighbourhood.gaussian(cells, rows, 64).withColumn("z", R6("z"))


@query(with_fixtures(""", p AS (SELECT c_custkey, CAST(c_custkey % 61 AS DOUBLE) + c_custkey % 7 / CAST(7 AS DOUBLE) AS y, CAST(c_custkey % 67 AS DOUBLE) - 2 + c_custkey % 5 / CAST(5 AS DOUBLE) AS x FROM customer)
    SELECT c_custkey, round((a.z * (1 - (x - floor(x))) + b.z * (x - floor(x))) * (1 - (y - floor(y))) + (c.z * (1 - (x - floor(x))) + e.z * (x - floor(x))) * (y - floor(y)), 6) AS z FROM p
    LEFT JOIN dem_cells a ON a.iy = floor(y) AND a.ix = floor(x) LEFT JOIN dem_cells b ON b.iy = floor(y) AND b.ix = floor(x) + 1 LEFT JOIN dem_cells c ON c.iy = floor(y) + 1 AND c.ix = floor(x) LEFT JOIN dem_cells e ON e.iy = floor(y) + 1 AND e.ix = floor(x) + 1""", "dem_cells"))
def bilinear_sample(spark, sf_dir):
    """Heights between cells; null outside, and on the last row and column."""
    key = F.col("c_custkey")
    points = fx.table(spark, sf_dir, "customer").select("c_custkey", ((key % 61).cast("double") + key % 7 / F.lit(7.0)).alias("y"), ((key % 67).cast("double") - 2 + key % 5 / F.lit(5.0)).alias("x"))
    return lattice.bilinear(points, lattice.corners(fx.dem_cells(spark, sf_dir)), F.col("y"), F.col("x")).select("c_custkey", R6("z").alias("z"))


@query(with_fixtures(""", p AS (SELECT c_custkey, c_custkey % 61 + CAST(0.5 AS DOUBLE) AS y, c_custkey % 67 - 2 + CAST(0.5 AS DOUBLE) AS x FROM customer)
    SELECT c_custkey, coalesce(z <= 175, false) AS is_water FROM p LEFT JOIN dem_cells ON iy = CAST(round_even(y, 0) AS BIGINT) AND ix = CAST(round_even(x, 0) AS BIGINT)""", "dem_cells"))
def nearest_mask(spark, sf_dir):
    """The nearest cell of a mask, halves to even, false outside."""
    key = F.col("c_custkey")
    points = fx.table(spark, sf_dir, "customer").select("c_custkey", (key % 61 + 0.5).alias("y"), (key % 67 - 2 + 0.5).alias("x"))
    mask = fx.dem_cells(spark, sf_dir).select("iy", "ix", (F.col("z") <= 175).alias("is_water"))
    return lattice.nearest(points, mask, F.col("y"), F.col("x"), "is_water", False).select("c_custkey", "is_water")


@query(with_fixtures(", o AS (SELECT x AS oy, CAST(floor(x * ((SELECT max(iy) FROM dem_cells) / CAST(49 AS DOUBLE))) AS BIGINT) AS iy FROM range(50) t(x)), p AS (SELECT x AS ox, CAST(floor(x * (63 / CAST(9 AS DOUBLE))) AS BIGINT) AS ix FROM range(10) t(x)) SELECT oy, ox, z FROM dem_cells JOIN o USING (iy) JOIN p USING (ix)", "dem_cells"))
def downsample(spark, sf_dir):
    """Evenly spaced rows and columns."""
    cells = fx.dem_cells(spark, sf_dir)
    rows = (cells.agg(F.max("iy")).first()[0] or 0) + 1
    return lattice.pick_every(cells, rows, 64, 50, 10).select("oy", "ox", "z")


# pyramid

GRID = ", m AS (SELECT CAST(max(gy) AS BIGINT) + 1 AS rows FROM sig_site), cl AS (SELECT s.*, gy // 4 AS by, gx // 4 AS bx FROM sig_site s, m WHERE gy < rows // 4 * 4 AND gx < 24)"


def _rows(wide) -> int:
    return (wide.agg(F.max("gy")).first()[0] or 0) + 1


@query(with_fixtures(GRID + """ SELECT "by", bx, az, CAST(coalesce(round_even(avg(dist_u8) FILTER (WHERE valid), 0), 0) AS BIGINT) AS dist_u8 FROM cl JOIN sig_long USING (obs_id) GROUP BY "by", bx, az""", "sig_site", "sig_long"))
def block_land_mean(spark, sf_dir):
    """Mean reach over each block's land, by azimuth."""
    wide = fx.sig_wide(spark, sf_dir)
    values = wide.select("gy", "gx", "valid", F.posexplode("dist").alias("az", "dist_u8")).withColumn("az", F.col("az").cast("long"))
    return pyramid.overview_mean(values, 4, _rows(wide), fx.COLS)


@query(with_fixtures(GRID + """ SELECT "by", bx, bit_or(CASE WHEN valid THEN water ELSE 0 END) AS water, max(CASE WHEN valid THEN water ELSE 0 END) AS largest FROM cl JOIN sig_water USING (obs_id) GROUP BY "by", bx""", "sig_site", "sig_water"))
def overview_water(spark, sf_dir):
    """Directions in which a block sees water; the largest mask beside it, which loses some."""
    wide = fx.sig_wide(spark, sf_dir)
    rows = _rows(wide)
    own = pyramid.overview_water(wide, 4, rows, fx.COLS)
    return own.join(pyramid.overview_water(wide, 4, rows, fx.COLS, compat=True).withColumnRenamed("water", "largest"), ["by", "bx"])


@query(with_fixtures(GRID + """ SELECT "by", bx, CAST(round_even(avg(elev_m), 0) AS BIGINT) AS elev, bool_or(valid) AS valid, coalesce(min(canopy_m) FILTER (WHERE valid), 0) AS canopy FROM cl GROUP BY "by", bx""", "sig_site"))
def pyramid_l0(spark, sf_dir):
    """Overview terrain: height, land and the quietest cover."""
    wide = fx.sig_wide(spark, sf_dir)
    return pyramid.overview_terrain(wide, 4, _rows(wide), fx.COLS)


@query(with_fixtures(" SELECT obs_id, CAST(gy // 8 AS INT) AS tile_y, CAST(gx // 8 AS INT) AS tile_x, CAST(gy % 8 AS INT) AS row, CAST(gx % 8 AS INT) AS col FROM sig_site WHERE gy BETWEEN 3 AND 12 AND gx BETWEEN 5 AND 17", "sig_site"))
def viewport_scan(spark, sf_dir):
    """The cells on screen, by tile."""
    level = pyramid.Level(1, 100.0, 100, 25, 8, 0.0, 1.0, 0.0, 1.0)
    window = pyramid.Window(level, 5, 17, 3, 12)
    return window.scan(pyramid.tiled(fx.sig_wide(spark, sf_dir), level)).select("obs_id", "tile_y", "tile_x", "row", "col")


@query(with_fixtures(" SELECT iy // 32 AS r, ix // 32 AS c, max(z) AS h_max, CAST(round_even(avg(z), 0) AS BIGINT) AS h_mean FROM dem_cells GROUP BY ALL", "dem_cells"))
def canopy_reduce(spark, sf_dir):
    """Source pixels to blocks of 32 by 32."""
    return pyramid.canopy_blocks(fx.dem_cells(spark, sf_dir), 32, "iy", "ix", "z")


# sun

@query(with_fixtures(f" SELECT event_id, round(360 - degrees(acos(greatest(least(sin(radians(-23.44 * cos(radians({D(360 / 365.25)} * (dayofyear(ts) + 10))))) / cos(radians(lat)), 1), -1))), 6) AS azimuth FROM sun_instants", "sun_instants"))
def sunset_azimuth(spark, sf_dir):
    """Bearing of sunset by day of year."""
    return fx.sun_instants(spark, sf_dir).select("event_id", R6(sun.sunset_azimuth(F.col("lat"), F.dayofyear("ts"))).alias("azimuth"))


def _sun_ctes(source: str) -> str:
    return f""", i AS (SELECT *, (CAST(floor(epoch_us(ts) / CAST(1000 AS DOUBLE)) AS BIGINT) / CAST(86400000 AS DOUBLE) + {D(2440587.5)} - {D(2451545.0)}) / {D(36525.0)} AS t FROM {source}),
    j AS (SELECT *, ({D(280.46646)} + t * ({D(36000.76983)} + t * {D(0.0003032)})) % 360 AS ml, {D(357.52911)} + t * ({D(35999.05029)} - {D(0.0001537)} * t) AS ma, {D(0.016708634)} - t * ({D(0.000042037)} + {D(0.0000001267)} * t) AS ec, {D(125.04)} - {D(1934.136)} * t AS nd FROM i),
    k AS (SELECT *, ml + sin(radians(ma)) * ({D(1.914602)} - t * ({D(0.004817)} + {D(0.000014)} * t)) + sin(radians(2 * ma)) * ({D(0.019993)} - {D(0.000101)} * t) + sin(radians(3 * ma)) * {D(0.000289)} - {D(0.00569)} - {D(0.00478)} * sin(radians(nd)) AS al,
      23 + (26 + ({D(21.448)} - t * ({D(46.815)} + t * ({D(0.00059)} - t * {D(0.001813)}))) / 60) / 60 + {D(0.00256)} * cos(radians(nd)) AS ob FROM j),
    l AS (SELECT *, asin(sin(radians(ob)) * sin(radians(al))) AS de, pow(tan(radians(ob / 2)), 2) AS y FROM k),
    m AS (SELECT *, 4 * degrees(y * sin(2 * radians(ml)) - 2 * ec * sin(radians(ma)) + 4 * ec * y * sin(radians(ma)) * cos(2 * radians(ml)) - {D(0.5)} * y * y * sin(4 * radians(ml)) - {D(1.25)} * ec * ec * sin(2 * radians(ma))) AS eq, floor((CAST(floor(epoch_us(ts) / CAST(1000 AS DOUBLE)) AS BIGINT) % 86400000) / CAST(1000 AS DOUBLE)) / 60 AS mi FROM l),
    n AS (SELECT *, ((mi + eq + 4 * lon) % 1440 + 1440) % 1440 / 4 - 180 AS ha FROM m),
    o AS (SELECT *, acos(greatest(least(sin(radians(lat)) * sin(de) + cos(radians(lat)) * cos(de) * cos(radians(ha)), 1), -1)) AS ze FROM n),
    sp AS (SELECT *, 90 - degrees(ze) AS geometric, degrees(acos(greatest(least((sin(radians(lat)) * cos(ze) - sin(de)) / (cos(radians(lat)) * sin(ze)), 1), -1))) AS fn FROM o)"""


ELEVATION_SQL = f"""geometric + CASE WHEN geometric > 85 THEN 0 WHEN geometric > 5 THEN {D(58.1)} / tg - {D(0.07)} / pow(tg, 3) + {D(0.000086)} / pow(tg, 5)
        WHEN geometric > {D(-0.575)} THEN 1735 + geometric * ({D(-518.2)} + geometric * ({D(103.4)} + geometric * ({D(-12.79)} + geometric * {D(0.711)}))) ELSE {D(-20.772)} / tg END / 3600"""


@query(with_fixtures(_sun_ctes("sun_instants") + f""", q AS (SELECT *, tan(radians(geometric)) AS tg FROM sp)
    SELECT event_id, round(degrees(de), 5) AS declination, round(CASE WHEN ha > 0 THEN (fn + 180) % 360 ELSE (540 - fn) % 360 END, 4) AS azimuth,
      round({ELEVATION_SQL}, 5) AS elevation FROM q""", "sun_instants"))
def sun_position(spark, sf_dir):
    """Declination, azimuth and refracted elevation at each event."""
    out = sun.with_position(fx.sun_instants(spark, sf_dir))
    return out.select("event_id", F.round("declination", 5).alias("declination"), F.round("azimuth", 4).alias("azimuth"), F.round("elevation", 5).alias("elevation"))


@query(with_fixtures(", pl AS (SELECT DISTINCT CAST(5530 + s_suppkey % 5 * 90 AS DOUBLE) / 100 AS lat, CAST(1110 + s_suppkey % 3 * 100 AS DOUBLE) / 100 AS lon, DATE '2026-03-20' + CAST(s_suppkey % 4 * 91 AS INT) AS day FROM supplier), x AS (SELECT *, day + to_minutes(CAST(minute AS BIGINT)) AS ts FROM pl, range(0, 1441) r(minute))" + _sun_ctes("x") + f""", u AS (SELECT day, lat, lon, minute, geometric > {D(-0.833)} AS up, lag(geometric > {D(-0.833)}) OVER (PARTITION BY day, lat, lon ORDER BY minute) AS was FROM sp)
    SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, lat, lon, CAST(min(minute) FILTER (WHERE was AND NOT up) AS INT) AS minute FROM u GROUP BY ALL""", "spots"))
def sunset_minute(spark, sf_dir):
    """The minute of sunset at some places and days."""
    key = F.col("s_suppkey")
    places = fx.table(spark, sf_dir, "supplier").select(((5530 + key % 5 * 90).cast("double") / 100).alias("lat"), ((1110 + key % 3 * 100).cast("double") / 100).alias("lon"), F.date_add(F.lit("2026-03-20").cast("date"), (key % 4 * 91).cast("int")).alias("day")).distinct()
    return sun.horizon_crossing(places).withColumn("day", F.col("day").cast("string"))


@query(with_fixtures(", x AS (SELECT s_suppkey, CAST(5530 + s_suppkey % 390 AS DOUBLE) / 100 AS lat, CAST(1110 + s_suppkey % 350 AS DOUBLE) / 100 AS lon, minute, DATE '2026-01-01' + CAST(s_suppkey * 7 % 365 AS INT) + to_minutes(CAST(minute AS BIGINT)) AS ts FROM supplier, range(0, 1441) r(minute))" + _sun_ctes("x") + f""", q AS (SELECT *, tan(radians(geometric)) AS tg, CASE WHEN ha > 0 THEN (fn + 180) % 360 ELSE (540 - fn) % 360 END AS azimuth FROM sp)
    SELECT s_suppkey, count(*) FILTER (WHERE geometric > {D(-0.833)}) AS minutes_up, round(max({ELEVATION_SQL}), 5) AS highest, round(max_by(azimuth, minute) FILTER (WHERE geometric > {D(-0.833)}), 3) AS last_azimuth FROM q GROUP BY s_suppkey""", "spots"))
def sun_days(spark, sf_dir):
    """How long the sun is up at places on days of their own, how high it gets and where it is seen last, by a table function of SQL."""
    tables.register(spark)
    return spark.sql(
        """WITH p AS (SELECT s_suppkey, CAST(5530 + s_suppkey % 390 AS DOUBLE) / 100 AS lat, CAST(1110 + s_suppkey % 350 AS DOUBLE) / 100 AS lon, date_add(DATE '2026-01-01', CAST(s_suppkey * 7 % 365 AS INT)) AS day FROM {supplier})
        SELECT s_suppkey, count_if(geometric > -0.833D) AS minutes_up, round(max(elevation), 5) AS highest, round(max_by(azimuth, minute) FILTER (WHERE geometric > -0.833D), 3) AS last_azimuth FROM p, LATERAL sun_day(day, lat, lon) GROUP BY s_suppkey""",
        supplier=fx.table(spark, sf_dir, "supplier"),
    )


_DRIFT = math.sin(math.radians(190)) / abs(math.cos(math.radians(190)))


# the light drifts west by less than a cell a row: it crosses the row before between columns j - 1 and j
@query(with_fixtures(f""", r AS MATERIALIZED (SELECT iy, list(CAST(z AS DOUBLE) ORDER BY ix) AS b FROM dem_smooth GROUP BY iy),
    s AS (SELECT iy, b, list_transform(b, lambda x: {D(-1e9)}) AS sh FROM r WHERE iy = 0
      UNION ALL SELECT r.iy, r.b, list_transform(range(1, 65), lambda j: CASE WHEN j = 1 THEN {D(-1e9)} ELSE t.top[j - 1] + (t.top[j] - t.top[j - 1]) * {D(_DRIFT + 1)} - {D(0.2 * 25 * math.hypot(1, _DRIFT))} END)
        FROM (SELECT iy, list_transform(range(1, 65), lambda j: greatest(b[j], sh[j])) AS top FROM s) t JOIN r ON r.iy = t.iy + 1)
    SELECT iy, CAST(generate_subscripts(b, 1) - 1 AS BIGINT) AS ix, unnest(list_transform(range(1, 65), lambda j: b[j] + {D(1.7)} >= sh[j])) AS lit FROM s""", "dem_smooth", recursive=True))
def sunlit_mask(spark, sf_dir):
    """Cells that see a low southern sun, swept in tiles."""
    from overlook.operators.sunlight import sunlit

    cells = fx.dem_smooth(spark, sf_dir).select("iy", "ix", F.col("z").cast("double").alias("z"), F.lit(0.0).alias("canopy"), F.lit(1.7).alias("eye_m"), F.lit(0.2).alias("sun_tangent"))
    return sunlit(cells, 190.0, 25.0, 128, 800.0)


#: Where each level crosses the lines between neighbouring cells.
CROSSINGS = """, g AS (SELECT a.iy, a.ix, a.z AS za, b.z AS zb, b.iy - a.iy AS up FROM dem_smooth a JOIN dem_smooth b ON (b.iy = a.iy AND b.ix = a.ix + 1) OR (b.iy = a.iy + 1 AND b.ix = a.ix)),
    x AS (SELECT CAST(l AS BIGINT) AS e, l % 50 = 0 AS major, (iy + CASE WHEN up = 1 THEN (l - za) / CAST(zb - za AS DOUBLE) ELSE 0 END) * 25 AS y, (ix + CASE WHEN up = 0 THEN (l - za) / CAST(zb - za AS DOUBLE) ELSE 0 END) * 25 AS x
      FROM g, range(0, 1000, 10) r(l) WHERE least(za, zb) <= l AND greatest(za, zb) > l)"""


@query(with_fixtures(CROSSINGS + " SELECT DISTINCT e, major, round(y, 6) AS y, round(x, 6) AS x FROM x", "dem_smooth"))
def contour_lines(spark, sf_dir):
    """All points of the contour lines every 10 m, not simplified: each crossing of a level stands in a line."""
    from overlook.operators.contours import contours

    lines = contours(fx.dem_smooth(spark, sf_dir), 10.0, 5, 25.0, -1.0, 128)
    points = lines.select("e", "major", F.explode(F.arrays_zip("ys", "xs")).alias("p"))
    return points.select("e", "major", R6("p.ys").alias("y"), R6("p.xs").alias("x")).distinct()


_SEGMENTS = """, sq AS (SELECT a.iy, a.ix, a.z AS z00, b.z AS z01, d.z AS z10, e.z AS z11 FROM dem_smooth a JOIN dem_smooth b ON b.iy = a.iy AND b.ix = a.ix + 1 JOIN dem_smooth d ON d.iy = a.iy + 1 AND d.ix = a.ix JOIN dem_smooth e ON e.iy = a.iy + 1 AND e.ix = a.ix + 1),
    k AS (SELECT *, (z00 > l) = ((z00 + z01 + z10 + z11) / CAST(4 AS DOUBLE) > l) AS apart, CASE WHEN (z00 > l) <> (z01 > l) THEN [CAST(iy AS DOUBLE), ix + (l - z00) / CAST(z01 - z00 AS DOUBLE)] END AS s, CASE WHEN (z10 > l) <> (z11 > l) THEN [CAST(iy + 1 AS DOUBLE), ix + (l - z10) / CAST(z11 - z10 AS DOUBLE)] END AS n,
      CASE WHEN (z00 > l) <> (z10 > l) THEN [iy + (l - z00) / CAST(z10 - z00 AS DOUBLE), CAST(ix AS DOUBLE)] END AS w, CASE WHEN (z01 > l) <> (z11 > l) THEN [iy + (l - z01) / CAST(z11 - z01 AS DOUBLE), CAST(ix + 1 AS DOUBLE)] END AS e
      FROM sq, range(0, 1000, 10) r(l) WHERE least(z00, z01, z10, z11) <= l AND greatest(z00, z01, z10, z11) > l),
    m AS (SELECT *, list_filter([s, n, w, e], lambda p: p IS NOT NULL) AS met FROM k),
    t AS (SELECT l, met[1] AS a, met[2] AS b FROM m WHERE len(met) = 2 UNION ALL SELECT l, s, CASE WHEN apart THEN e ELSE w END FROM m WHERE len(met) = 4 UNION ALL SELECT l, n, CASE WHEN apart THEN w ELSE e END FROM m WHERE len(met) = 4),
    u AS (SELECT l, round(a[1] * 25, 6) AS ay, round(a[2] * 25, 6) AS ax, round(b[1] * 25, 6) AS "by", round(b[2] * 25, 6) AS bx FROM t), v AS (SELECT *, ay < "by" OR ay = "by" AND ax <= bx AS onward FROM u)"""


@query(with_fixtures(_SEGMENTS + """ SELECT CAST(l AS BIGINT) AS e, l % 50 = 0 AS major, CASE WHEN onward THEN ay ELSE "by" END AS y1, CASE WHEN onward THEN ax ELSE bx END AS x1, CASE WHEN onward THEN "by" ELSE ay END AS y2, CASE WHEN onward THEN bx ELSE ax END AS x2 FROM v""", "dem_smooth"))
def contour_steps(spark, sf_dir):
    """From each point of a contour line to the next, not simplified: lines go through every square once, in order, and nowhere else."""
    from overlook.operators.contours import contours

    lines = contours(fx.dem_smooth(spark, sf_dir), 10.0, 5, 25.0, -1.0, 128)
    points = F.zip_with("ys", "xs", lambda y, x: F.struct(F.round(y, 6).alias("y"), F.round(x, 6).alias("x")))
    steps = lines.withColumn("p", points).select("e", "major", F.explode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("s"))
    return steps.select("e", "major", F.col("s.a.y").alias("y1"), F.col("s.a.x").alias("x1"), F.col("s.b.y").alias("y2"), F.col("s.b.x").alias("x2"))


@query(with_fixtures(""", c AS (SELECT a.iy, a.ix, least(a.z, b.z, d.z, e.z) AS low, greatest(a.z, b.z, d.z, e.z) AS high FROM dem_smooth a JOIN dem_smooth b ON b.iy = a.iy AND b.ix = a.ix + 1 JOIN dem_smooth d ON d.iy = a.iy + 1 AND d.ix = a.ix JOIN dem_smooth e ON e.iy = a.iy + 1 AND e.ix = a.ix + 1)
    SELECT CAST(l AS DOUBLE) AS level, count(*) AS squares FROM c, range(0, 1000, 10) r(l) WHERE low <= l AND high > l GROUP BY l""", "dem_smooth"))
def contour_squares(spark, sf_dir):
    """How many squares each contour level crosses."""
    from overlook.operators.contours import segments

    return segments(fx.dem_smooth(spark, sf_dir), 10.0).groupBy("level").agg(F.count_distinct("iy", "ix").alias("squares"))


# spots

ID_SQL = "printf('%.5f', lat) || ',' || printf('%.5f', lon)"


@query(with_fixtures(f""", s AS (SELECT *, {ID_SQL} AS id FROM spots), old AS (SELECT * FROM s WHERE pos <= 20), new AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM s WHERE pos > 20 AND id NOT IN (SELECT id FROM old))
    SELECT CAST(0 AS INT) AS part, pos, lat, lon, name, id FROM old UNION ALL SELECT 1, pos, lat, lon, name, id FROM new WHERE rn = 1""", "spots"))
def merge_spots(spark, sf_dir):
    """Saved spots first, then the first of each new one."""
    all_spots = fx.spots(spark, sf_dir)
    return spot_lists.merged(all_spots.where("pos <= 20"), all_spots.where("pos > 20")).select("part", "pos", "lat", "lon", "name", "id")


@query(with_fixtures(f", s AS (SELECT *, {ID_SQL} AS id FROM spots) SELECT pos, id FROM s WHERE pos > 20 AND id NOT IN (SELECT id FROM s WHERE pos <= 20)", "spots"))
def unsaved_spots(spark, sf_dir):
    """Spots that are not saved yet."""
    all_spots = fx.spots(spark, sf_dir)
    return spot_lists.unsaved(all_spots.where("pos > 20"), all_spots.where("pos <= 20")).select("pos", "id")


@query(with_fixtures(f", s AS (SELECT *, {ID_SQL} AS id FROM spots) SELECT pos, id, 'https://www.google.com/maps/search/?api=1&query=' || id AS url FROM s WHERE pos > 20 AND id IN (SELECT id FROM s WHERE pos <= 20)", "spots"))
def saved_spots(spark, sf_dir):
    """Spots that are saved, with a search link."""
    all_spots = fx.spots(spark, sf_dir)
    return spot_lists.is_saved(all_spots.where("pos > 20"), all_spots.where("pos <= 20")).select("pos", "id", search_url(F.col("lat"), F.col("lon")).alias("url"))


@query(with_fixtures(f""", s AS (SELECT pos % 5 AS list, {ID_SQL} AS id, row_number() OVER (PARTITION BY pos % 5 ORDER BY pos) AS rn FROM spots), f AS (SELECT list, list(id ORDER BY rn) AS l FROM s WHERE rn <= 10 GROUP BY list)
    SELECT list, 'https://www.google.com/maps/dir/?api=1&destination=' || replace(l[-1], ',', '%2C') || CASE WHEN len(l) > 1 THEN '&waypoints=' || replace(replace(array_to_string(l[:-2], '|'), ',', '%2C'), '|', '%7C') ELSE '' END AS url FROM f""", "spots"))
def route_links(spark, sf_dir):
    """A drive through the first ten stops of each list."""
    lists = spot_lists.ordered_stops(fx.spots(spark, sf_dir).withColumn("list", F.col("pos") % 5), ["list"])
    return lists.select("list", route_url(F.col("stops")).alias("url"))


@query(with_fixtures(" SELECT pos, lat, lon, name FROM spots", "spots"))
def share_round_trip(spark, sf_dir):
    """Spots into share codes and back."""
    lists = fx.spots(spark, sf_dir).groupBy((F.col("pos") % 7).alias("list")).agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", "name"))).alias("s"))
    back = lists.select(F.col("s.pos").alias("pos"), decode_share(encode_share(F.col("s"))).alias("back"))
    return back.select(F.explode(F.arrays_zip("pos", "back")).alias("z")).select("z.pos", "z.back.lat", "z.back.lon", "z.back.name")


@query(with_fixtures(" SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM spots", "spots"))
def spot_bounds(spark, sf_dir):
    """The box around all spots."""
    return spot_lists.bounding_box(fx.spots(spark, sf_dir))


# tiles

TILE_SQL = """WITH t AS (SELECT CAST(s_suppkey AS VARCHAR) AS tile, CAST(s_suppkey % 11 AS DOUBLE) AS west, CAST(s_suppkey % 11 + 1 AS DOUBLE) AS east, CAST(s_suppkey % 7 AS DOUBLE) + 50 AS south, CAST(s_suppkey % 7 AS DOUBLE) + 51 AS north FROM supplier),
  b AS (SELECT CAST(n_nationkey AS BIGINT) AS box, n_nationkey / CAST(2 AS DOUBLE) AS west, n_nationkey / CAST(2 AS DOUBLE) + 3 AS east, CAST(50 + n_nationkey % 5 AS DOUBLE) AS south, CAST(52 + n_nationkey % 5 AS DOUBLE) AS north FROM nation) """


@query(TILE_SQL + "SELECT tile, box, greatest(t.west, b.west) AS west, least(t.east, b.east) AS east, greatest(t.south, b.south) AS south, least(t.north, b.north) AS north FROM t JOIN b ON t.west < b.east AND t.east > b.west AND t.south < b.north AND t.north > b.south")
def bbox_tiles(spark, sf_dir):
    """Tiles that overlap boxes, and where."""
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    t = fx.table(spark, sf_dir, "supplier").select(s.cast("string").alias("tile"), (s % 11).cast("double").alias("west"), (s % 11 + 1).cast("double").alias("east"), ((s % 7).cast("double") + 50).alias("south"), ((s % 7).cast("double") + 51).alias("north"))
    b = fx.table(spark, sf_dir, "nation").select(n.cast("long").alias("box"), (n / F.lit(2.0)).alias("west"), (n / F.lit(2.0) + 3).alias("east"), (50 + n % 5).cast("double").alias("south"), (52 + n % 5).cast("double").alias("north"))
    return tiles.tiles_in_boxes(t, b)


@query("WITH t AS (SELECT a.x AS r, b.x AS c FROM range(9) a(x), range(5) b(x)), k AS (SELECT printf('%.2f_%.2f', 55.3 + r * CAST(0.45 AS DOUBLE), 11.1 + c * CAST(0.75 AS DOUBLE)) AS key FROM t) SELECT key FROM k WHERE key NOT IN (SELECT printf('%.2f_%.2f', 55.3 + s_suppkey % 9 * CAST(0.45 AS DOUBLE), 11.1 + s_suppkey % 5 * CAST(0.75 AS DOUBLE)) FROM supplier WHERE s_suppkey <= 10)")
def pending_tiles(spark, sf_dir):
    """A region's tiles that are still to be built."""
    s = F.col("s_suppkey")
    done = fx.table(spark, sf_dir, "supplier").where("s_suppkey <= 10").select(F.format_string("%.2f_%.2f", 55.3 + s % 9 * F.lit(0.45), 11.1 + s % 5 * F.lit(0.75)).alias("key"))
    return tiles.pending(tiles.work_list(spark, 55.3, 59.2, 11.1, 14.6), done).select("key")


@query("SELECT DISTINCT CAST(l_partkey AS BIGINT) AS key FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def missing_inputs(spark, sf_dir):
    """What is needed and not there."""
    need = fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("key"), "l_quantity")
    return tiles.missing(need, need.where("l_quantity > 40"))


# projections and colours

@query(with_fixtures(f""" SELECT event_id, round(111132.92 - 559.82 * cos(2 * radians(lat)) + {D(1.175)} * cos(4 * radians(lat)), 4) AS north, round(111412.84 * cos(radians(lat)) - {D(93.5)} * cos(3 * radians(lat)), 4) AS east,
    round(ln(tan({D(math.pi / 4)} + radians(lat) / 2)), 9) AS my, round(lat, 9) AS back FROM sun_instants""", "sun_instants"))
def mercator_project(spark, sf_dir):
    """Metres a degree, and Mercator there and back."""
    north, east = geo.metres_per_degree(F.col("lat"))
    y = geo.mercator_y(F.col("lat"))
    return fx.sun_instants(spark, sf_dir).select("event_id", F.round(north, 4).alias("north"), F.round(east, 4).alias("east"), F.round(y, 9).alias("my"), F.round(geo.inverse_mercator_y(y), 9).alias("back"))


def _ramp_sql() -> str:
    stops = [f"[{', '.join(D(float(s[c])) for s in colour.HEAT)}]" for c in range(3)]
    value = ", ".join(f"CAST(floor(({s}[i + 1] * (1 - f) + {s}[i + 2] * f) * 255) AS INT) AS {name}" for s, name in zip(stops, ("r", "g", "b")))
    return with_fixtures(f", t AS (SELECT obs_id, az, dist_u8 / CAST(255 AS DOUBLE) * 7 AS pos FROM sig_long), u AS (SELECT obs_id, az, CAST(least(floor(pos), 6) AS BIGINT) AS i, pos - least(floor(pos), 6) AS f FROM t) SELECT obs_id, az, {value} FROM u", "sig_long")


@query(_ramp_sql())
def ramp_colour(spark, sf_dir):
    """Reach as a colour."""
    r, g, b = colour.ramp(F.col("dist_u8") / F.lit(255.0))
    return fx.sig_long(spark, sf_dir).select("obs_id", "az", colour.byte(r).alias("r"), colour.byte(g).alias("g"), colour.byte(b).alias("b"))


@query(with_fixtures(" SELECT quantile_cont(CAST(z AS DOUBLE), 0.02) AS low, quantile_cont(CAST(z AS DOUBLE), 0.98) AS high FROM dem_cells WHERE z > 0", "dem_cells"))
def colour_limits(spark, sf_dir):
    """The 2nd and 98th percentile."""
    low, high = colour.colour_limits(fx.dem_cells(spark, sf_dir), "z")
    return spark.range(1).select(F.lit(low).alias("low"), F.lit(high).alias("high"))


@query(with_fixtures(" SELECT obs_id, count(*) AS n FROM sig_long WHERE dist_u8 > 0 GROUP BY obs_id", "sig_long").replace("SELECT obs_id, count(*) AS n FROM sig_long WHERE dist_u8 > 0 GROUP BY obs_id", f"SELECT obs_id, az, CASE WHEN dist_u8 > 0 THEN CAST(floor(({D(0.22)} + {D(0.72)} * sqrt(greatest(least(dist_u8 * {D(UNIT)} / 20000, 1), 0))) * 255 + {D(0.5)}) AS INT) ELSE 0 END AS alpha FROM sig_long"))
def reach_opacity(spark, sf_dir):
    """Opacity of a reach on the square-root ramp."""
    *_, alpha = colour.reach_pixel(geo.dequantise_distance(F.col("dist_u8")), 0.0, 20000.0)
    return fx.sig_long(spark, sf_dir).select("obs_id", "az", alpha.alias("alpha"))


# streams over events, beyond the reference


def _stream(spark, name):
    from overlook.plans.shared import fresh_path

    return fresh_path(spark, f"stream-{name}")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Tumbling windows, run as a stream."""
    from overlook.streaming import jobs

    out = jobs.to_the_end(jobs.tumbling(jobs.read_events(spark, sf_dir)), spark, _stream(spark, "tumbling"), key=["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT b - INTERVAL 3 HOUR * k AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 3 HOUR, ts) AS b, event_type FROM events), range(2) r(k) GROUP BY ALL")
def event_sliding(spark, sf_dir):
    """Sliding windows, run as a stream."""
    from overlook.streaming import jobs

    out = jobs.to_the_end(jobs.sliding(jobs.read_events(spark, sf_dir)), spark, _stream(spark, "sliding"), key=["start", "event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    """Sessions by user, run as a stream."""
    from overlook.streaming import jobs

    out = jobs.to_the_end(jobs.sessions(jobs.read_events(spark, sf_dir)), spark, _stream(spark, "sessions"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def latest_event(spark, sf_dir):
    """The newest row of each key, run as a stream."""
    from overlook.streaming import jobs

    out = jobs.to_the_end(jobs.latest(jobs.read_events(spark, sf_dir).select("user_id", "ts", "event_id"), "user_id", "ts"), spark, _stream(spark, "latest"), key=["user_id"])
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


from overlook.plans import job_queries, source_queries  # noqa: E402  registers the rest

__all__ = ["QUERIES", "SQL", "job_queries", "source_queries"]
