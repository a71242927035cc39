"""Small rasters with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from overlook.functions import geo, wedge
from overlook.operators import contours, lattice, neighbourhood, pyramid, relief, reports, scoring, sunlight, viewshed, water


def raster(spark, z):
    z = np.asarray(z, dtype=float)
    rows = [(int(y), int(x), None if math.isnan(z[y, x]) else float(z[y, x])) for y in range(z.shape[0]) for x in range(z.shape[1])]
    return spark.createDataFrame(rows, "iy long, ix long, z double")


def test_ray_schedule():
    d = viewshed.radial_steps()
    assert len(d) == 257 and d[0] == 25 and d[39] == 1000 and d[40] == 1025 and d[-1] == 20000


def test_curvature(spark):
    assert spark.range(1).select(geo.curvature_drop(F.lit(20000.0))).first()[0] == pytest.approx(27.31, abs=0.01)


@pytest.mark.parametrize("falls, stored", [((5, 5, 5, 5), 0), ((50, 50, 50, 50), 5), ((15, 30, 60, 100), 11)])
def test_descent_goldens(spark, falls, stored):
    heights = [(d, F.lit(100.0 - f)) for d, f in zip(relief.DISTANCES, falls)]
    assert spark.range(1).select(scoring.sustained_descent(F.lit(100.0), heights)).first()[0] == stored


def test_bulk_relief_equals_relational(spark):
    z = np.random.default_rng(7).integers(0, 300, (60, 50)).astype(float)
    z[10:14, 20:24] = np.nan
    cells = raster(spark, z)
    seen = lattice.lattice(spark, 9, 8, 40.0, 30.0, 150.0, 140.0)
    a = relief.descents(spark, seen, cells, 25.0, 8, (100.0, 250.0)).toPandas().sort_values(["obs_id", "az"])
    b = relief.descents_tiles(seen, cells, 25.0, 16, 8, (100.0, 250.0)).select("obs_id", F.posexplode("drop").alias("az", "drop")).toPandas().sort_values(["obs_id", "az"])
    assert len(a) == len(b) > 400 and (a["drop"].to_numpy() == b["drop"].to_numpy()).mean() > 0.999


def test_unknown_height_is_level(spark):
    assert spark.range(1).select(scoring.sustained_descent(F.lit(100.0), [(250.0, F.lit(None).cast("double"))])).first()[0] == 0


def test_wedges():
    assert wedge.bins_between(340, 20) == [0, 1, 31]
    assert wedge.bins_between(0, 360) == [0]
    assert wedge.Wheel(0, 0).bins() == list(range(32))
    snapped = wedge.Wheel(10, 10, snap=True)
    assert snapped.span == pytest.approx(11.25) and len(snapped.bins()) == 1
    band = wedge.Band(5, 5.1)
    assert band.low == pytest.approx(4.9) and not band.open and wedge.Band(0, 20).open


def test_flat_ground_sees_one_step(spark):
    flat = raster(spark, np.full((8, 12), 50.0))
    one = spark.createDataFrame([(1, 75.0, 50.0)], "obs_id long, y double, x double")
    got = viewshed.compute(spark, one, flat, 25.0, (0.0,), [8], steps=[25.0, 50.0, 75.0]).first()
    assert got["max_dist"] == 25.0


def test_relational_equals_bulk(spark):
    z = np.random.default_rng(3).integers(0, 60, (40, 40)).astype(float)
    z[20:24, 20:24] = np.nan
    cells = raster(spark, z)
    wet = cells.select("iy", "ix", (F.coalesce("z", F.lit(99.0)) < 8).alias("is_water"))
    seen = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate((y, x) for y in range(50, 900, 130) for x in range(40, 900, 170))], "obs_id long, y double, x double")
    steps = [25.0, 50.0, 75.0, 110.0, 160.0]
    a = viewshed.compute(spark, seen, cells, 25.0, (1.7,), 8, steps=steps, water=wet, of=8).toPandas()
    b = viewshed.compute_tiles(seen, cells.join(wet, ["iy", "ix"]), 25.0, 16, 1.7, 8, steps=steps)
    b = b.select("obs_id", F.posexplode(F.arrays_zip("horizon", "max_dist", "water_near", "water_far")).alias("az", "s")).select("obs_id", "az", "s.*").toPandas()
    both = a.merge(b, on=["obs_id", "az"])
    assert len(both) == len(a) == len(b)
    for c in ("horizon", "max_dist", "water_near", "water_far"):
        assert np.allclose(both[f"{c}_x"].astype(float), both[f"{c}_y"].astype(float), equal_nan=True), c


def test_taller_eyes_and_bare_ground_see_no_less(spark):
    z = np.random.default_rng(5).integers(0, 40, (20, 20)).astype(float)
    seen = spark.createDataFrame([(i, 25.0 * y, 25.0 * x) for i, (y, x) in enumerate((y, x) for y in range(6, 12) for x in range(6, 12))], "obs_id long, y double, x double")
    cells = raster(spark, z)
    got = viewshed.compute(spark, seen, cells, 25.0, (0.0, 5.0), 4, steps=[25.0, 50.0, 75.0], of=4).groupBy("eye").agg(F.median("max_dist").alias("m")).toPandas().set_index("eye")["m"]
    assert got[5.0] >= got[0.0]
    trees = cells.withColumn("z", F.col("z") + 20)
    hid = viewshed.compute(spark, seen, cells, 25.0, (1.7,), 4, steps=[25.0, 50.0, 75.0], surface=trees, of=4).agg(F.avg("max_dist")).first()[0]
    bare = viewshed.compute(spark, seen, cells, 25.0, (1.7,), 4, steps=[25.0, 50.0, 75.0], of=4).agg(F.avg("max_dist")).first()[0]
    assert bare >= hid


def test_shore_keeps_its_view(spark):
    shore = spark.createDataFrame([(1 + i // 3, 1 + i % 3, float(10 + i)) for i in range(6)], "gy long, gx long, v double")
    got = {(r["gy"], r["gx"]): r["v"] for r in neighbourhood.land_quartile(shore, "v", 1).collect()}
    assert len(got) == 6 and got[(1, 2)] == 11.0
    all_cells = spark.createDataFrame([(i // 3, i % 3, 0.0 if i < 3 else float(7 + i)) for i in range(9)], "gy long, gx long, v double")
    assert {(r["gy"], r["gx"]): r["v"] for r in neighbourhood.plot_percentile(all_cells, "v", 3, 3, 50.0).collect()}[(1, 1)] == 0.0


def test_border_ring_is_not_scored(spark):
    cells = spark.createDataFrame([(y, x, 5.0) for y in range(4) for x in range(4)], "gy long, gx long, v double")
    got = neighbourhood.land_quartile(cells, "v", 1, 4, 4).where("v > 0").count()
    assert got == 4


def test_overview_water_keeps_directions(spark):
    cells = spark.createDataFrame([(0, 0, True, 1), (0, 1, True, 2), (1, 0, True, 4), (1, 1, True, 8)], "gy long, gx long, valid boolean, water long")
    assert pyramid.overview_water(cells, 2, 2, 2).first()["water"] == 15
    assert pyramid.overview_water(cells, 2, 2, 2, compat=True).first()["water"] == 8


def test_overview_height_without_nodata(spark):
    cells = spark.createDataFrame([(0, 0, -32768, False, 3), (0, 1, 10, True, 4), (1, 0, 20, True, 2), (1, 1, 30, True, 9)], "gy long, gx long, elev_m long, valid boolean, canopy_m long")
    got = pyramid.overview_terrain(cells, 2, 2, 2).first()
    assert (got["elev"], got["valid"], got["canopy"]) == (20, True, 2)
    assert pyramid.overview_terrain(cells, 2, 2, 2, compat=True).first()["elev"] < 0


def test_levels_and_window():
    overview, native = pyramid.levels(41, 81, 100.0, 55.0, 59.0, 11.0, 15.0, tile=16)
    assert overview.lat0 == pytest.approx(55.0 + 1.5 * 0.1) and overview.rows == 10 and native.tiles == (3, 6) and native.tile_shape(2, 5) == (9, 1)
    assert pyramid.view_window([overview, native], 12, 13, 56, 57, 11).level.id == 1
    assert pyramid.view_window([overview, native], 12, 13, 56, 57, 11, budget=4).level.id == 0
    assert pyramid.view_window([overview, native], 20, 21, 56, 57, 11) is None


def test_lake_size_and_connectivity(spark):
    z = np.arange(400, dtype=float).reshape(20, 20) * 7
    z[2:8, 2:8] = 100.0
    wet = water.detect_water(raster(spark, z), 100.0, min_hectares=10.0).where("is_water").toPandas()
    assert sorted(zip(wet.iy, wet.ix)) == sorted([(y, x) for y in range(3, 7) for x in range(3, 7)] + [(0, 0)][:0])
    corner = spark.createDataFrame([(0, 0), (1, 1), (1, 2)], "iy long, ix long")
    assert water.patches(corner).select("patch").distinct().count() == 2


def test_patches_by_flood_fill(spark):
    on = np.random.default_rng(9).random((25, 25)) < 0.55
    cells = [(int(y), int(x)) for y, x in zip(*np.nonzero(on))]
    left, sizes = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for k in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if k in left:
                    left.remove(k)
                    todo.append(k)
        sizes.append(n)
    got = [r["count"] for r in water.patches(spark.createDataFrame(cells, "iy long, ix long")).groupBy("patch").count().collect()]
    assert sorted(got) == sorted(sizes)
    assert water.patches(spark.createDataFrame([], "iy long, ix long")).count() == 0


def test_sweep_agrees_with_marching():
    rng = np.random.default_rng(1)
    for azimuth in (10.0, 100.0, 190.0, 280.0, 225.0):
        rough = rng.random((34, 34))
        block = sum(rough[a : a + 30, b : b + 30] for a in range(5) for b in range(5)) * 12
        tangent = np.full((30, 30), 0.12)
        a, b = (f(block, block + 1.7, tangent, azimuth, 100.0) for f in (sunlight.sweep, sunlight.march))
        assert (a != b).mean() < 0.02


def test_sunlit_tiles_equal_one_sweep(spark):
    rng = np.random.default_rng(2)
    z = rng.random((30, 26)) * 80
    rows = [(y, x, float(z[y, x]), 0.0, 1.7, 0.15) for y in range(30) for x in range(26)]
    cells = spark.createDataFrame(rows, "iy long, ix long, z double, canopy double, eye_m double, sun_tangent double")
    got = sunlight.sunlit(cells, 200.0, 100.0, 16, 3000.0).toPandas()
    grid = np.zeros(z.shape, bool)
    grid[got.iy, got.ix] = got.lit
    assert len(got) == z.size and (grid == sunlight.sweep(z, z + 1.7, np.full(z.shape, 0.15), 200.0, 100.0)).all()


def test_contour_of_a_cone(spark):
    y, x = np.mgrid[0:41, 0:41]
    z = 100 - np.hypot(y - 20.3, x - 20.2) * 5
    lines = contours.contours(raster(spark, z), 50.0, 2, 10.0, 2.0, 64).where("e = 50").toPandas()
    assert len(lines) == 1 and not lines.major[0]
    ys, xs = np.array(lines["ys"][0]), np.array(lines["xs"][0])
    assert ys[0] == ys[-1] and xs[0] == xs[-1] and np.allclose(np.hypot(ys - 203, xs - 202), 100, atol=4)
    assert len(ys) < lines.n_raw[0]


def test_lines_do_not_hang_on_tiles(spark):
    y, x = np.mgrid[0:37, 0:37]
    z = 60 + 30 * np.sin(y / 5.0) * np.cos(x / 6.0) + (x * 7 + y * 3) % 5
    cells = raster(spark, z)
    want = None
    for tile in (1024, 16, 5):
        got = {(r["e"], r["line"]): (r["n_raw"], tuple(r["ys"]), tuple(r["xs"])) for r in contours.contours(cells, 10.0, 5, 25.0, 12.0, tile).collect()}
        want = want or got
        assert got == want and len(got) > 5
    # by hand: segments joined at shared points, for each level
    parts = contours.segments(cells, 10.0).toPandas()
    lines = 0
    for _, own in parts.groupby("level"):
        near, left = {}, set()
        for a, b in zip(own["a"], own["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        left = set(near)
        while left:
            todo = [left.pop()]
            lines += 1
            while todo:
                for k in near[todo.pop()] & left:
                    left.remove(k)
                    todo.append(k)
    assert lines == len(want)
    told = contours.totals(contours.contours(cells, 10.0, 5, 25.0, 12.0, 16)).first()
    kept = sum(len(ys) for _, ys, _ in want.values())
    # every line has a point more than it has segments
    assert (told["lines"], told["points_in"], told["points_kept"]) == (lines, len(parts) + lines, kept) and kept < len(parts)
    assert told["major_lines"] == sum(e % 50 == 0 for e, _ in want)


def test_table_functions_of_sql(spark):
    from overlook.functions import tables

    tables.register(spark)
    rows = "VALUES (1, DATE '2026-06-21', 57.0D, 12.0D), (2, NULL, 57.0D, 12.0D), (3, DATE '2026-06-21', 90.0D, 0.0D), (4, DATE '2026-12-21', -90.0D, 0.0D)"
    got = spark.sql(f"WITH p AS (SELECT * FROM ({rows}) AS t(k, day, lat, lon)) SELECT k, count(*) AS n, max(elevation) AS high, count_if(isnan(azimuth)) AS bad FROM p, LATERAL sun_day(day, lat, lon) GROUP BY k").collect()
    assert {r["k"]: (r["n"], r["bad"]) for r in got} == {1: (1441, 0), 3: (1441, 0), 4: (1441, 0)}
    assert {r["k"]: round(r["high"]) for r in got} == {1: 56, 3: 23, 4: 23}
    assert spark.sql("SELECT * FROM (VALUES (CAST(NULL AS DOUBLE)), (-1.0D)) AS t(reach), LATERAL rays(reach)").isEmpty()


def test_simplify_by_the_recursive_rule():
    rng = np.random.default_rng(6)

    def rule(points, tolerance):
        if len(points) < 3:
            return [True] * len(points)
        a, b = points[0], points[-1]
        size = math.dist(a, b)
        off = [abs((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])) / size if size > 1e-9 else math.dist(a, p) for p in points[1:-1]]
        i = 1 + int(np.argmax(off))
        if off[i - 1] <= tolerance:
            return [True, *[False] * (len(points) - 2), True]
        return rule(points[: i + 1], tolerance)[:-1] + rule(points[i:], tolerance)

    for n in (2, 3, 10, 60):
        for closed in (False, True):
            points = rng.random((n, 2)).cumsum(axis=0)
            points = np.vstack([points, points[:1]]) if closed else points
            assert contours.simplify(points, 0.3).tolist() == rule(points.tolist(), 0.3)


def test_simplify_keeps_corners():
    points = np.array([[0, 0], [1, 0.1], [2, 0], [2, 5], [2.1, 7], [2, 9]], dtype=float)
    assert contours.simplify(points, 0.5).tolist() == [True, False, True, False, False, True]


def test_resample_and_corners(spark):
    z = np.arange(36, dtype=float).reshape(6, 6)
    c = lattice.corners(raster(spark, z))
    assert c.count() == 25
    point = spark.createDataFrame([(1, 1.5, 2.25), (2, 5.0, 1.0), (3, -0.5, 1.0)], "id int, y double, x double")
    got = {r["id"]: r["z"] for r in lattice.bilinear(point, c, F.col("y"), F.col("x")).collect()}
    assert got == {1: 11.25, 2: None, 3: None}


def test_top_spots_is_greedy(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 9, (12, 12))
    cells = spark.createDataFrame([(int(y * 12 + x), int(y), int(x), float(v[y, x])) for y in range(12) for x in range(12)], "obs_id long, gy long, gx long, reach double")
    left, want = v.astype(float).ravel().copy(), []
    for _ in range(6):
        i = int(left.argmax())
        if left[i] <= 0:
            break
        want.append(i)
        for j in range(144):
            if abs(j // 12 - i // 12) <= 2 and abs(j % 12 - i % 12) <= 2:
                left[j] = -1
    assert [r["obs_id"] for r in scoring.top_spots(cells, 6, 2).orderBy("rank").collect()] == want
    assert scoring.top_spots(cells.where("reach < 0"), 6, 2).count() == 0


def test_robust_and_presets(spark):
    rows = [(y * 3 + x, y, x, [100.0] * 32, [float(x)] * 32, x == 0, 5.0) for y in range(3) for x in range(3)]
    sig = spark.createDataFrame(rows, "obs_id long, gy long, gx long, max_dist array<double>, water_far array<double>, on_water boolean, ground double")
    got = scoring.PRESETS["openness"].robust(sig, 3, 3, 100.0).toPandas().set_index("obs_id")
    assert got.score[5] == 100.0 and got.score[4] == got.score[1] == 0.0
    assert not scoring.PRESETS["water"].apply(sig).where("keep").count()


def test_quantised_values(spark):
    got = spark.range(1).select(geo.quantise_distance(F.lit(19999.0)), geo.quantise_distance(F.lit(-3.0)), geo.pack_bits(F.array(*[F.lit(i == 31) for i in range(32)])), geo.compass(F.lit(348.76)), geo.half_up(F.lit(-0.5)), geo.land_cover_name(F.lit(57), F.lit(-12))).first()
    assert list(got) == [254, 0, 2**31, "N", 0, "N57W012"]


def test_landmark_and_nan(spark):
    marks = spark.createDataFrame([("a", 1, 5.0, 1.0), ("b", 2, 5.0, 1.0), ("c", 3, 5.0, 1.0)], "name string, key int, expected_m double, tolerance_m double")
    heights = spark.createDataFrame([(1, 5.5), (2, float("nan"))], "key int, z double")
    assert {r["name"]: r["ok"] for r in reports.verify_landmarks(marks, heights).collect()} == {"a": True, "b": False, "c": False}


def test_gaussian_keeps_constants(spark):
    got = neighbourhood.gaussian(raster(spark, np.full((6, 7), 3.0)), 6, 7).toPandas()
    assert len(got) == 42 and np.allclose(got.z, 3.0)


def test_mercator_image(spark):
    cells = spark.createDataFrame([(y, x, float(y * 4 + x)) for y in range(4) for x in range(4)], "iy long, ix long, score double")
    got = lattice.mercator_image(spark, cells, 4, 10.0, 13.0, 50.0, 53.0, 1.0, 1.0, 50.0, 10.0).toPandas()
    assert isinstance(got, pd.DataFrame) and len(got) == 16 and got[(got.py == 0) & (got.px == 0)].score.item() == 12.0
