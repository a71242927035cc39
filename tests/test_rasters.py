"""Stencils, labels, viewports and sources on small rasters, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.operators import neighbourhood, pyramid, reports, scoring, water
from overlook.plans import builds
from overlook.sources import ranged, rasters


def frame(spark, grid, name="z", kind="double"):
    rows = [(int(i), int(j), None if grid[i, j] is None or grid[i, j] != grid[i, j] else float(grid[i, j])) for i in range(grid.shape[0]) for j in range(grid.shape[1])]
    return spark.createDataFrame(rows, f"iy long, ix long, {name} double").withColumn(name, F.col(name).cast(kind))


def flood(mask):
    """Patches by flood fill: the first cell of each cell's patch."""
    name = {}
    for i in range(mask.shape[0]):
        for j in range(mask.shape[1]):
            if mask[i, j] and (i, j) not in name:
                todo = [(i, j)]
                while todo:
                    a, b = todo.pop()
                    if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and (a, b) not in name:
                        name[a, b] = (i, j)
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return name


@pytest.mark.parametrize("side,share", [(3, 0.6), (5, 0.55), (64, 0.6), (4, 0.95)])
def test_patches_equal_flood_fill(spark, side, share):
    mask = np.random.default_rng(side).random((41, 37)) < share
    got = water.patches(frame(spark, mask * 1.0).where("z > 0"), side=side).collect()
    assert {(r["iy"], r["ix"]): tuple(r["patch"]) for r in got} == flood(mask)


def test_a_snake_through_every_tile_is_one_patch(spark):
    mask = np.zeros((33, 33), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    got = water.patches(frame(spark, mask * 1.0).where("z > 0"), side=2).select("patch").distinct().collect()
    assert [tuple(r["patch"]) for r in got] == [(0, 0)]
    assert water.patches(frame(spark, mask * 1.0).where("z > 5"), side=2).count() == 0


def test_water_needs_known_flat_neighbours(spark):
    r = np.random.default_rng(3)
    z = np.round(r.random((24, 26)) * 2) * 5 + 3
    z[5:15, 6:19] = 3.0
    z[9, 9] = np.nan
    for side in (4, 128):
        got = {(x["iy"], x["ix"]): x["is_water"] for x in water.detect_water(frame(spark, z), 100.0, min_hectares=3.0, side=side).collect()}
        cand = np.zeros(z.shape, bool)
        for i in range(24):
            for j in range(26):
                near = z[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
                cand[i, j] = z[i, j] == z[i, j] and not np.isnan(near).any() and near.max() - near.min() <= 0.01
        name = flood(cand)
        size = {n: list(name.values()).count(n) for n in set(name.values())}
        assert got == {(i, j): (i, j) in name and size[name[i, j]] >= 3 for i in range(24) for j in range(26)} and any(got.values())


@pytest.mark.parametrize("radius,side", [(1, 5), (2, 128), (3, 2)])
def test_land_quartile_equals_loops(spark, radius, side, monkeypatch):
    r = np.random.default_rng(radius)
    grid = np.where(r.random((23, 19)) < 0.7, r.integers(0, 9, (23, 19)) * 1.0, np.nan)
    monkeypatch.setattr(neighbourhood.on_tiles, "__defaults__", ("gy", "gx", side))
    cells = frame(spark, grid, "v", "bigint").where("v IS NOT NULL").withColumnsRenamed({"iy": "gy", "ix": "gx"}).withColumn("other", F.concat("gy", F.lit("/"), "gx"))
    got = neighbourhood.land_quartile(cells, "v", radius, 23, 19)
    assert got.schema == cells.schema
    for row in got.collect():
        i, j = row["gy"], row["gx"]
        near = grid[max(0, i - radius) : i + radius + 1, max(0, j - radius) : j + radius + 1]
        near = np.sort(near[~np.isnan(near)])
        inner = radius <= i < 23 - radius and radius <= j < 19 - radius
        assert row["v"] == (near[int(len(near) * 0.25)] if inner else 0) and row["other"] == f"{i}/{j}"
    assert got.count() == (~np.isnan(grid)).sum()


@pytest.mark.parametrize("step,side", [(50.0, 4), (20.0, 128), (25.0, 3)])
def test_plot_percentile_equals_loops(spark, step, side, monkeypatch):
    grid = np.random.default_rng(int(step)).random((13, 11))
    monkeypatch.setattr(neighbourhood.on_tiles, "__defaults__", ("gy", "gx", side))
    cells = frame(spark, grid, "v").withColumnsRenamed({"iy": "gy", "ix": "gx"})
    got = {(x["gy"], x["gx"]): x["v"] for x in neighbourhood.plot_percentile(cells, "v", 13, 11, step).collect()}
    r = max(1, round(50 / step))
    wide = np.pad(grid, r, mode="symmetric")
    want = {(i, j): np.sort(wide[i : i + 2 * r + 1, j : j + 2 * r + 1].ravel())[int((2 * r + 1) ** 2 * 0.25)] for i in range(13) for j in range(11)}
    assert got == want


def test_equal_scores_tie_whatever_their_order(spark):
    """The same distances in another order are the same score, and the smaller id is first."""
    r = np.random.default_rng(4)
    reach = [float(x) for x in r.integers(0, 256, 32) / 255 * 20000]
    rows = [(i, 10 * i, 0, [reach[k] for k in r.permutation(32)], [0.0] * 32, False, 10.0) for i in range(40)]
    sig = spark.createDataFrame(rows, "obs_id long, gy long, gx long, max_dist array<double>, water_far array<double>, on_water boolean, ground double")
    scored = scoring.Filters().apply(sig)
    assert scored.select("openness").distinct().count() == 1
    assert [x["obs_id"] for x in scoring.top_spots(scored, 5, 3, "openness").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_light_comes_from_its_azimuth(spark):
    i, j = np.mgrid[0:5, 0:5]
    for grid, at in ((i * 10.0, 180), (-i * 10.0, 0), (j * 10.0, 270), (-j * 10.0, 90)):
        shade = {a: neighbourhood.hillshade(frame(spark, grid), "z", 25.0, float(a)).where("iy = 2 AND ix = 2").first()["shade"] for a in (0, 90, 180, 270)}
        assert max(shade, key=shade.get) == at and min(shade, key=shade.get) == (at + 180) % 360


def test_relief_equals_loops(spark):
    r = np.random.default_rng(9)
    z = np.where(r.random((30, 20)) < 0.9, r.integers(0, 50, (30, 20)) * 1.0, np.nan)
    points = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate([(0, 0), (15, 10), (29, 19), (3, 18), (-2, 5), (200, 5)])], "point_id long, py long, px long")
    got = {x["point_id"]: x for x in reports.local_relief(frame(spark, z, kind="bigint"), points, 4, tile_cells=8).collect()}
    for p in points.collect():
        a, b = p["py"], p["px"]
        near = z[max(0, a - 4) : max(0, a + 5), max(0, b - 4) : b + 5]
        near = near[~np.isnan(near)]
        if not len(near):
            assert p["point_id"] not in got
            continue
        own = z[a, b] if 0 <= a < 30 else np.nan
        x = got[p["point_id"]]
        assert (x["lowest"], x["highest"]) == (near.min(), near.max()) and (x["above_median"] is None if own != own else x["above_median"] == own - np.median(near))


# sources


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dtype", ["u1", "<i2", ">i2", "<u4", "<f4"])
@pytest.mark.parametrize("tiled,deflate", [(True, True), (False, True), (True, False), (False, False)])
def test_tiff_round_trip(spark, tmp_path, dtype, tiled, deflate):
    r = np.random.default_rng(1)
    grid = r.integers(0, 200, (70, 53)).astype(dtype.replace(">", "<"))
    predictor = "f" not in dtype and deflate
    raw = ranged.tiff_bytes(grid, (32, 16), tiled, deflate, predictor, nodata=7, place=(12.0, 60.0, 0.5))
    (tmp_path / "a.tif").write_bytes(raw)
    info = ranged.open_tiff(str(tmp_path / "a.tif"))
    assert (info.width, info.height, info.west, info.north, info.step_x, info.nodata) == (53, 70, 12.0, 60.0, 0.5, 7.0)
    got = ranged.read_tiff(spark, str(tmp_path), 500).toPandas()
    assert len(got) == 70 * 53 and set(got["file"]) == {"a.tif"}
    back = np.full((70, 53), np.nan)
    back[got["row"], got["col"]] = got["value"]
    assert np.array_equal(back, np.where(grid == 7, np.nan, grid.astype(float)), equal_nan=True)


def test_tiff_window_reads_its_tiles_only(spark, tmp_path):
    grid = np.arange(64 * 64, dtype="u2").reshape(64, 64)
    (tmp_path / "a.tif").write_bytes(ranged.tiff_bytes(grid, (16, 16)))
    window = {"row": (16, 31), "col": (41, None)}
    reader = ranged._TiffReader(str(tmp_path), 1, 1, ranged.Box.of('{"row": [16, 31], "col": [41, null]}'))
    assert sorted(b for p in reader.partitions() for b in p.blocks) == [6, 7]
    some = ranged.read_tiff(spark, str(tmp_path), window=window)
    assert {(x["row"], x["col"]) for x in some.collect()} == {(i, j) for i in range(16, 32) for j in range(41, 64)}
    assert ranged.read_tiff(spark, str(tmp_path), window={"row": (100, None)}).count() == 0


def test_conditions_do_not_leak_between_queries(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(ranged.tiff_bytes(np.arange(400, dtype="u2").reshape(20, 20), (16, 16)))
    (tmp_path / "57_12").write_bytes(np.zeros((4, 6), "<i2").tobytes())
    pixels, cells = ranged.read_tiff(spark, str(tmp_path / "a.tif")), ranged.read_raw(spark, str(tmp_path), 4)
    assert [pixels.where("row = 3").count(), pixels.count(), pixels.where("row = 4").agg(F.min("row")).first()[0]] == [20, 400, 4]
    assert [cells.where("col = 5").count(), cells.count(), cells.where("row = 1").count()] == [4, 24, 6]


def test_other_files_are_no_rasters(spark, tmp_path):
    with pytest.raises(ValueError, match="no TIFF"):
        (tmp_path / "b.tif").write_bytes(b"nothing at all, but long enough")
        ranged.open_tiff(str(tmp_path / "b.tif"))


@pytest.mark.parametrize("strip", [1, 7, 40, 64, 100])
def test_reduction_over_strips(spark, tmp_path, strip):
    r = np.random.default_rng(strip)
    grid = r.integers(0, 30, (100, 75)).astype("u1")
    (tmp_path / "a.tif").write_bytes(ranged.tiff_bytes(grid, (strip, 0), tiled=False, nodata=29))
    got = {(x["r"], x["c"]): (x["h_max"], x["h_mean"]) for x in ranged.read_reduced(spark, str(tmp_path), 32, 300).collect()}
    want = {}
    for a in range(4):
        for b in range(3):
            near = grid[32 * a : 32 * a + 32, 32 * b : 32 * b + 32]
            near = near[near != 29].astype(float)
            want[a, b] = (near.max(), np.rint(near.mean()))
    assert got == want


def test_raw_tiles_by_range(spark, tmp_path):
    r = np.random.default_rng(2)
    tiles = {(57, 12): r.integers(0, 90, (50, 20)), (57, 13): r.integers(0, 90, (50, 20)), (56, 13): r.integers(0, 90, (50, 20))}
    tiles[57, 12][3, 4] = -32768
    for (lat, lon), z in tiles.items():
        (tmp_path / f"{lat}_{lon}").write_bytes(z.astype("<i2").tobytes())
    (tmp_path / "notes.txt").write_text("no tile")
    path = str(tmp_path)
    got = ranged.read_raw(spark, path, 50, 400, {"lat_i": (57, 57), "row": (2, 4), "col": (4, 6)}).where("col <> 5").collect()
    assert {(x["lon_i"], x["row"], x["col"]): x["z"] for x in got} == {(lon, i, j): (None if z[i, j] < 0 else z[i, j]) for (lat, lon), z in tiles.items() if lat == 57 for i in (2, 3, 4) for j in (4, 6)}
    reader = ranged._RawReader(path, 50, 400)
    reader.box.narrow("lat_i", 56, 56)
    reader.box.narrow("row", 45, 60)
    assert [(p.lat_i, p.lon_i, p.first, p.last) for p in reader.partitions()] == [(56, 13, 45, 49)]
    whole = rasters.read_mosaic(spark, path, 57, 12, 50)
    assert whole.count() == 3000 and whole.where("iy >= 50 AND ix < 20").count() == 0 and whole.where("z IS NULL").count() == 1
    with pytest.raises(FileNotFoundError):
        rasters.read_mosaic(spark, path, 56, 12, 50)
    (tmp_path / "55_12").write_bytes(np.zeros((50, 18), "<i2").tobytes())
    with pytest.raises(ValueError, match="bands"):
        rasters.read_mosaic(spark, path, 57, 12, 50)
    (tmp_path / "54_12").write_bytes(b"123")
    with pytest.raises(ValueError, match="whole columns"):
        ranged.tile_list(path, 50)


def test_writers_leave_whole_files_only(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 4, 3, None), ("b", 2, 2, 9.0)], "file string, row int, col int, value double")
    path = str(tmp_path / "out")
    assert ranged.write_tiffs(cells, path, 5, 4, "u1", (16, 16), nodata=0) == 2
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["a.tif", "b.tif"]
    assert [tuple(x) for x in ranged.read_tiff(spark, path).where("value IS NOT NULL").orderBy("file").collect()] == [("a.tif", 0, 0, 1.0), ("b.tif", 2, 2, 9.0)]


# viewports


def test_viewports_equal_the_plain_rule(spark):
    both = pyramid.levels(40, 25, 100.0, 55.3, 59.2, 11.1, 14.6)
    r = np.random.default_rng(5)
    rows = [(i, float(w), float(w + a), float(s), float(s + b), float(z)) for i, (w, a, s, b, z) in enumerate(zip(r.uniform(10, 15, 80), r.uniform(0, 2, 80), r.uniform(54, 60, 80), r.uniform(0, 2, 80), r.choice([9.0, 10.5, 12.0], 80)))]
    views = spark.createDataFrame(rows, "view long, west double, east double, south double, north double, zoom double")
    got = {x["view"]: (x["level"], x["x0"], x["x1"], x["y0"], x["y1"]) for x in pyramid.viewports(views, both, budget=50).collect()}
    want = {i: (v.level.id, v.x0, v.x1, v.y0, v.y1) for i, *w in rows if (v := pyramid.view_window(both, *w, budget=50))}
    assert got == want and 0 < len(want) < 80 and len({v[0] for v in want.values()}) == 2


def test_viewports_prune_the_store(spark, small, tmp_path):
    from overlook.plans import fixtures as fx

    wide = fx.sig_wide(spark, small)
    out = str(tmp_path / "p")
    builds.pack_region(wide, 20, fx.COLS, (55.3, 59.2, 11.1, 14.6), out, tile=8)
    views = spark.createDataFrame([(1, 11.2, 11.5, 55.4, 55.9, 11.0)], "view long, west double, east double, south double, north double, zoom double")
    shown = builds.read_viewports(spark, out, views)
    assert shown.select("level", "tile_y", "tile_x").distinct().count() == 1 and shown.count() == 16
    assert "dynamicpruning" in plan(shown).lower()
    assert builds.read_pyramid(spark, out)[1] == 10.5


def rows_made(df) -> int:
    """The most rows that any step of an executed plan gave out."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_view_totals_equal_the_cells_shown(spark, tmp_path):
    r = np.random.default_rng(7)
    # rows and cells are missing, others come twice, heights are unknown
    cells = [(i, j, None if r.random() < 0.3 else int(r.integers(-50, 50)), int(r.integers(0, 9))) for i in range(41) for j in range(25) for _ in range(int(r.integers(0, 3))) if i not in (3, 17, 18, 40)]
    both = pyramid.levels(41, 25, 100.0, 55.3, 59.2, 11.1, 14.6, tile=8)
    both[0].tile = 8
    given = spark.createDataFrame(cells, "gy long, gx long, z long, v long")
    store = pyramid.tiled(given, both[1]).unionByName(pyramid.tiled(given.where("gy < 10 AND gx < 6"), both[0]))
    rows = [(i, float(w), float(w + a), float(s), float(s + b), float(z)) for i, (w, a, s, b, z) in enumerate(zip(r.uniform(10, 15, 90), r.uniform(0, 4, 90), r.uniform(54, 60, 90), r.uniform(0, 4, 90), r.choice([9.0, 12.0], 90)))]
    wanted = pyramid.viewports(spark.createDataFrame(rows + [(99, *rows[5][1:])], "view long, west double, east double, south double, north double, zoom double"), both, budget=300)
    got = pyramid.view_totals(store, wanted, both, {"z": F.col("z"), "v": F.col("v")}).select("view", "level", "cells", "z", "v")
    want = pyramid.scan_viewports(store, wanted).groupBy("view", "level").agg(F.count("*").alias("cells"), F.sum("z").alias("z"), F.sum("v").alias("v"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 40


def test_running_sums_over_blocks(spark):
    rows = [(k, i, i * i % 7) for k in range(2) for i in range(-9, 30) if i % 4] + [(0, 5, 100)]
    got = pyramid._running(spark.createDataFrame(rows, "k int, i long, v long"), ["k"], "i", ["v"], 5)
    assert {tuple(x) for x in got.select("k", "i", "v").collect()} == {(k, i, sum(v for a, b, v in rows if a == k and b <= i)) for k, i, _ in rows}


def test_many_viewports_make_few_rows(spark, small, same, tmp_path):
    import duckdb

    from overlook.plans import queries

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    con.execute("create table customer as select range as c_custkey from range(8000)")
    for name in ("customer", "embeddings"):
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    df = queries.QUERIES["viewport_cells"](spark, str(tmp_path))
    got = df.toPandas()
    same(got, con.execute(queries.SQL["viewport_cells"]).df())
    # what all views show together is not made as rows
    df.collect()
    assert 8000 <= rows_made(df) < got["cells"].sum() / 3


# the ledger


def test_ledger_builds_what_it_lacks(spark, tmp_path):
    from overlook.sources import ledger

    out, book = str(tmp_path / "data"), str(tmp_path / "book")
    asked = []

    def make(keys):
        asked.append(sorted(r["key"] for r in keys.collect()))
        return keys.where("key <> 'empty'").select("key", F.length("key").alias("n"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))

    jobs = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    ledger.build(jobs("a", "b", "a", "empty", None), make, out, book, run="1")
    ledger.build(jobs("b", "c"), make, out, book, run="2")
    ledger.build(jobs("a", "b", "c", "empty"), make, out, book, run="3")
    assert asked == [["a", "b", "empty"], ["c"]]
    assert {(r["key"], r["rows"], r["run"]) for r in ledger.entries(spark, book).collect()} == {("a", 2, "1"), ("b", 2, "1"), ("empty", 0, "1"), ("c", 2, "2")}
    ledger.build(jobs("a"), make, out, book, version="2", run="4")
    assert asked[-1] == ["a"] and ledger.damaged(spark, out, book).count() == 0
    jobs("b").select(F.lit(9).alias("n"), F.lit(1).alias("i"), "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(out)
    assert [(r["key"], r["rows"], r["found"]) for r in ledger.damaged(spark, out, book).collect()] == [("b", 2, 1)]


def test_a_run_killed_before_its_entry_repeats_its_tile(spark, tmp_path, monkeypatch):
    from overlook.sources import ledger

    out, book = str(tmp_path / "data"), str(tmp_path / "book")
    jobs = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    make = lambda keys: keys.withColumn("n", F.lit(1))
    ledger.build(jobs("a"), make, out, book, run="1")
    monkeypatch.setattr(ledger, "_told", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ledger.build(jobs("a", "b"), make, out, book, run="2")
    monkeypatch.undo()
    assert spark.read.parquet(out).count() == 2 and ledger.done(spark, book).count() == 1
    seen = []
    ledger.build(jobs("a", "b"), lambda keys: (seen.append([r[0] for r in keys.collect()]), make(keys))[1], out, book, run="3")
    assert seen == [["b"]] and spark.read.parquet(out).count() == 2


def test_a_region_is_resumed_from_its_ledger(spark, tmp_path):
    r = np.random.default_rng(6)
    ground = frame(spark, r.integers(0, 40, (24, 24)) * 1.0).withColumns({"canopy": F.lit(None).cast("double"), "obstruction": F.lit(0.0), "is_water": F.lit(False)})
    seen = spark.createDataFrame([(i, i // 6, i % 6, 100.0 * (i // 6), 100.0 * (i % 6)) for i in range(36)], "obs_id long, gy long, gx long, y double, x double")
    options = {"tile_cells": 12, "reach": 300.0, "azimuths": 4, "eyes": (1.7,), "vegetation": ("bare",), "version": "v1"}
    out = str(tmp_path / "region")
    builds.build_region(ground, seen.where("gy < 3"), out, **options)
    builds.build_region(ground, seen, out, **options)
    from overlook.sources import ledger

    book = {x["key"]: (x["rows"], x["run"]) for x in ledger.entries(spark, f"{out}/ledger").collect()}
    assert set(book) == {"0_0", "0_1", "1_0", "1_1"} and len({v[1] for v in book.values()}) == 2 and all(v[0] == 9 for v in book.values())
    assert builds.read_region(spark, out, "bare", 170).count() == 36


# shadows


@pytest.mark.parametrize("azimuth,side", [(190.0, 7), (10.0, 5), (100.0, 6), (260.0, 64), (225.0, 4), (180.0, 9), (330.0, 8)])
def test_waves_equal_one_sweep(spark, azimuth, side):
    from overlook.operators import sunlight

    r = np.random.default_rng(int(azimuth))
    z, canopy = r.integers(0, 60, (23, 19)) * 1.0, r.integers(0, 3, (23, 19)) * 1.0
    tangent = 0.05 + 0.1 * r.random((23, 19))
    gone = r.random((23, 19)) < 0.1
    rows = [(i, j, None if gone[i, j] else float(z[i, j]), float(canopy[i, j]), 1.7, float(tangent[i, j])) for i in range(23) for j in range(19)]
    cells = spark.createDataFrame(rows, "iy long, ix long, z double, canopy double, eye_m double, sun_tangent double")
    block, eye = np.where(gone, sunlight.NONE, z + canopy), np.where(gone, 2 * sunlight.NONE, z + 1.7)
    want = sunlight.sweep(block, eye, tangent, azimuth, 25.0) & ~gone & ~(canopy > 1.7)
    got = {(x["iy"], x["ix"]): x["lit"] for x in sunlight.sunlit_waves(cells, azimuth, 25.0, side).collect()}
    assert got == {(i, j): bool(want[i, j]) for i in range(23) for j in range(19)} and 0 < want.sum() < want.size


def long_raster(spark, azimuth, tangent, wall=0.0, holes=True):
    """Cells and plain light of 900 cells along the light by 9 across: a wall towards the sun, unknown heights, and places without cells (which shadows cross)."""
    from overlook.operators import sunlight

    r = np.random.default_rng(3)
    z, canopy = r.integers(0, 60, (900, 9)) * 1.0, r.integers(0, 3, (900, 9)) * 1.0
    z[0] += wall
    gone, absent = r.random((900, 9)) < 0.1, np.zeros((900, 9), bool)
    absent[300:340, 2:], absent[400:600] = holes, holes
    grid = lambda v: (lambda g: g[::-1] if math.cos(math.radians(azimuth % 90)) * (1 if azimuth in (350.0, 80.0) else -1) > 0 else g)(v)
    flip = lambda v: grid(v).T if azimuth in (80.0, 260.0) else grid(v)
    z, canopy, tangent, gone, absent = (flip(v) for v in (z, canopy, np.broadcast_to(tangent[:, None], (900, 9)), gone, absent))
    rows = [(i, j, None if gone[i, j] else float(z[i, j]), float(canopy[i, j]), 1.7, float(tangent[i, j])) for i, j in np.ndindex(z.shape) if not absent[i, j]]
    cells = spark.createDataFrame(rows, "iy long, ix long, z double, canopy double, eye_m double, sun_tangent double")
    unknown = gone | absent
    want = sunlight.sweep(np.where(unknown, sunlight.NONE, z + canopy), np.where(unknown, 2 * sunlight.NONE, z + 1.7), np.where(absent, -1.0, tangent), azimuth, 25.0) & ~unknown & ~(canopy > 1.7)
    return cells, {(i, j): bool(want[i, j]) for i, j in np.ndindex(z.shape) if not absent[i, j]}


#: Tangents along the light: a sun that stands well, one at the horizon, night in the middle, night at the end.
SUNS = {"high": np.full(900, 0.15), "low": np.full(900, 0.002), "night between": np.where(abs(np.arange(900) - 250) < 100, -0.2, 0.1), "night": np.where(np.arange(900) < 200, 0.1, -0.2)}


@pytest.mark.parametrize("azimuth,kind,most,swept", [(190.0, "high", 5, 2.5), (350.0, "low", 25, 3.5), (80.0, "night between", 25, 3.5), (260.0, "night", 4, 0.7)])
def test_rounds_go_by_how_far_shadows_reach(spark, monkeypatch, tmp_path, azimuth, kind, most, swept):
    from overlook.operators import sunlight

    monkeypatch.setattr(sunlight, "fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(sunlight, "EAGER", 2, raising=False)
    cells, want = long_raster(spark, azimuth, SUNS[kind], 500.0 if kind == "low" else 0.0, kind != "high")
    got = {(x["iy"], x["ix"]): x["lit"] for x in sunlight.sunlit_waves(cells, azimuth, 25.0, 18).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    # 25 tiles of 36 x 9 cells, one behind the other
    assert len(list(tmp_path.glob("sun-state/*=*"))) <= most
    assert spark.read.parquet(f"{tmp_path}/sun-state").count() <= swept * 25


def test_tangents_once_a_row_and_a_column(spark):
    from overlook.functions import sun

    cells = spark.range(6).select((F.col("id") % 3).alias("iy"), F.expr("id div 3").alias("ix"))
    got = sun.with_separable_tangent(cells, "2026-06-21 10:00:00", 57.0, 0.5, 12.0, 0.7, (0, 2, 0, 1))
    placed = cells.select("iy", "ix", F.lit("2026-06-21 10:00:00").cast("timestamp").alias("ts"), (57.0 + F.col("iy") * 0.5).alias("lat"), (12.0 + F.col("ix") * 0.7).alias("lon"))
    want = {(x["iy"], x["ix"]): x["sun_tangent"] for x in sun.with_sun_tangent(placed).collect()}
    assert all(abs(x["sun_tangent"] - want[x["iy"], x["ix"]]) < 1e-12 for x in got.collect()) and len(want) == 6


# where writers may write


def test_writers_ask_for_root_and_room(spark, tmp_path):
    from overlook.sources import stores

    cells = spark.createDataFrame([(1, 2)], "k int, v int")
    root = f"file://{tmp_path}"
    assert 0 < stores.free_space(spark, f"{root}/not/yet/there") < 1e6
    assert stores.free_space(spark, "file:/") > 0
    try:
        spark.conf.set("spark.overlook.roots", f"{root}/ours,{root}/too")
        stores.write_tiles(cells, f"{root}/ours/a", ["k"])
        with pytest.raises(PermissionError):
            stores.write_tiles(cells, f"{root}/theirs", ["k"])
        spark.conf.set("spark.overlook.reserve_gb", "1e9")
        with pytest.raises(OSError, match="needed"):
            stores.write_tiles(cells, f"{root}/ours/b", ["k"])
    finally:
        spark.conf.unset("spark.overlook.roots")
        spark.conf.unset("spark.overlook.reserve_gb")
    assert spark.read.parquet(f"{root}/ours/a").count() == 1
