"""The batch jobs end to end on a small box."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.__main__ import main
from overlook.functions.wedge import Band, Wheel
from overlook.operators import lattice, scoring, viewshed
from overlook.plans import builds
from overlook.sources import rasters

STEPS = [25.0, 50.0, 75.0, 100.0, 150.0, 200.0]


@pytest.fixture(scope="module")
def ground(spark):
    y, x = np.mgrid[0:48, 0:48]
    z = np.round(60 + 25 * np.sin(y / 6.0) + 20 * np.cos(x / 5.0))
    z[30:36, 10:18] = 12.0
    rows = [(int(a), int(b), float(z[a, b]), float((a * b) % 4) * 3, 20 if b % 9 == 0 else 50 if b % 11 == 0 else 10) for a in range(48) for b in range(48)]
    cells = spark.createDataFrame(rows, "iy long, ix long, z double, canopy double, land_class int")
    return builds.terrain(cells, 25.0, min_hectares=1.0).cache()


@pytest.fixture(scope="module")
def observers(spark):
    return lattice.lattice(spark, 10, 10, 100.0, 100.0, 100.0, 100.0).withColumnsRenamed({"iy": "gy", "ix": "gx"})


def test_region_to_best_spots(spark, ground, observers, tmp_path):
    out = str(tmp_path / "region")
    builds.build_region(ground, observers, out, 16, 25.0, eyes=(0.0, 5.0), azimuths=8, reach=200.0, steps=STEPS)
    assert spark.read.parquet(f"{out}/signature").count() == 400
    low, high, bare = (builds.read_region(spark, out, v, e) for v, e in (("trees", 0), ("trees", 500), ("bare", 500)))
    mean = lambda df: df.select(F.avg(F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d))).first()[0]
    assert mean(low) <= mean(high) <= mean(bare)
    best = scoring.top_spots(scoring.ViewQuery(wheel=Wheel(0, 0, azimuths=8), band=Band(0, 20)).score(bare.where("valid"), 100.0, max_distance=200.0), 5, 2)
    assert 1 <= best.count() <= 5
    # tiles that are done stay as they are, others are written anew
    before = spark.read.parquet(f"{out}/terrain").select("ty", "tx").distinct()
    assert before.count() > 1
    builds.build_region(ground, observers, out, 16, 25.0, done=spark.read.parquet(f"{out}/terrain").select("ty", "tx"), eyes=(0.0,), vegetation=("bare",), azimuths=8, reach=200.0, steps=STEPS)
    assert spark.read.parquet(f"{out}/signature").count() == 400


def test_pack(spark, ground, observers, tmp_path):
    out, packed = str(tmp_path / "r"), str(tmp_path / "p")
    builds.build_region(ground, observers, out, 32, 25.0, eyes=(1.7,), vegetation=("bare",), azimuths=8, reach=200.0, steps=STEPS)
    over, native = builds.pack_region(builds.read_region(spark, out, "bare", 170), 10, 10, (55.0, 55.9, 11.0, 11.9), packed, tile=4)
    assert (over.rows, over.lat0, over.dlat) == (2, pytest.approx(55.15), pytest.approx(0.4)) and native.tiles == (3, 3)
    meta = spark.read.json(f"{packed}/meta.json").first()
    assert meta["detail_min_zoom"] == 10.5 and [v["rows"] for v in meta["levels"]] == [2, 10]
    back = spark.read.parquet(f"{packed}/tiles")
    assert back.where("level = 1").count() == 100 and back.where("level = 0").count() == 4
    assert back.select(F.size("dist")).distinct().collect() == [(8,)]


def test_relief_point_and_contours(spark, ground, observers, tmp_path):
    drops = builds.build_relief(observers, ground, 25.0, 4)
    assert drops.count() == 100 and drops.select(F.size("drop")).distinct().collect() == [(4,)]
    directions, summary = builds.inspect_point(spark, ground, 500.0, 500.0, 25.0, azimuths=8, steps=STEPS)
    assert directions.count() == 16 and summary.count() == 2 and {"name", "water_below", "horizon_degrees"} <= set(directions.columns)
    totals = builds.export_contours(ground.select("iy", "ix", "z"), 48, 48, str(tmp_path / "c"), 57.0, 12.0, step=25.0).first()
    assert totals["lines"] > 0 and totals["points_kept"] < totals["points_in"] and spark.read.text(str(tmp_path / "c")).count() == totals["lines"]


def test_pilot_and_plan(spark, ground, observers):
    seen = viewshed.compute_tiles(observers, ground.select("iy", "ix", "z", "is_water"), 25.0, 48, 1.7, 8, steps=STEPS)
    assert builds.core(observers, 300.0).count() == 9
    wide = seen.select("obs_id", F.array_repeat(F.element_at("max_dist", 1), 32).alias("max_dist"), F.array_repeat(F.lit(0.0), 32).alias("water_far"), "ground").join(observers, "obs_id").withColumn("on_water", F.lit(False))
    assert builds.pilot_spots(wide, 10, 10, core_km=1.0, k=3).count() >= 1
    todo, absent = builds.plan_tiles(spark, (55.3, 59.2, 11.1, 14.6), spark.createDataFrame([("55.30_11.10",)], "key string"), spark.createDataFrame([("N54E009",)], "key string"))
    assert todo.count() == 44 and sorted(r["key"] for r in absent.collect()) == ["N54E012", "N57E009", "N57E012"]


def test_jobs_from_the_command_line(spark, ground, tmp_path):
    cells, out = str(tmp_path / "cells"), {k: str(tmp_path / k) for k in ("region", "relief", "pack", "contours")}
    ground.select("iy", "ix", "z", "canopy", "land_class").write.parquet(cells)
    asked = f"region --cells {cells} --out {out['region']} --bbox 55 55.9 11 11.9 --tile-cells 16 --veg bare --eyes 1.7 --azimuths 8 --max-dist 200".split()
    main([*asked, "--only", "2"], spark)
    tiles = lambda: spark.read.parquet(f"{out['region']}/ledger").groupBy("key").count()
    assert tiles().count() == 2
    main(asked, spark)  # goes on with the rest
    assert tiles().count() == 9 and tiles().where("count > 1").isEmpty()
    about = rasters.read_region(spark, f"{out['region']}/region.json").first()
    assert (about["rows"], about["cols"], about["azimuths"], about["veg"]) == (12, 12, 8, ["bare"])
    assert builds.read_region(spark, out["region"], "bare", 170).count() == 144
    main(f"pack --region {out['region']} --out {out['pack']} --tile 4".split(), spark)
    packed = spark.read.parquet(f"{out['pack']}/bare_170/tiles")
    assert packed.where("level = 1").count() == 144 and packed.where("level = 0").count() == 9
    main(f"relief --cells {cells} --out {out['relief']} --azimuths 4".split(), spark)
    assert spark.read.parquet(out["relief"]).count() == 144
    main(f"contours --cells {cells} --out {out['contours']} --origin 57 12 --step 25".split(), spark)
    assert spark.read.text(out["contours"]).count() > 0
    with pytest.raises(SystemExit):
        main(["region", "--cells", cells], spark)


def test_box_pilot_and_canopy_files(spark, ground, observers, tmp_path):
    seen = viewshed.compute_tiles(observers, ground.select("iy", "ix", "z", "is_water"), 25.0, 48, 1.7, 8, steps=STEPS)
    builds.write_pilot(seen, builds.region_meta(spark, (55.0, 55.9, 11.0, 11.9), 10, 10, 8), str(tmp_path / "pilot"))
    back, about = builds.read_pilot(spark, str(tmp_path / "pilot"))
    order = lambda df: sorted(map(repr, df.select("obs_id", "ground", "horizon", "max_dist", "water_near", "water_far").collect()))
    assert order(back) == order(seen) and about.first()["azimuths"] == 8

    builds.build_region(ground, observers, str(tmp_path / "r"), 48, 25.0, eyes=(0.0, 5.0), vegetation=("bare",), azimuths=8, reach=200.0, steps=STEPS)
    level = builds.pyramid.Level(1, 100.0, 10, 10, 4, 55.0, 0.1, 11.0, 0.1)
    meta = builds.box_meta(spark, 57.0, 12.0, 1.0, azimuths=8)
    for cm in (0, 500):  # sets stand beside each other
        builds.export_box(builds.read_region(spark, str(tmp_path / "r"), "bare", cm), level, str(tmp_path / "box"), f"bare_{cm}", meta)
    layers, about = builds.read_box(spark, str(tmp_path / "box"))
    assert {r["name"]: r["n"] for r in layers.groupBy("name").agg(F.count("*").alias("n")).collect()} == {k: 9 for k in ("valid", "water_bare_0", "dist_bare_0", "water_bare_500", "dist_bare_500")}
    assert layers.where("name = 'dist_bare_500'").select(F.sum(F.length("data"))).first()[0] == 800
    told = about.first()
    assert told["n"] == 11 and told["ramp"][0] == "#FEF0D9" and [e["label"] for e in told["eyes"]] == ["Ground", "Standing", "Second floor"]
    assert told["bounds"][0] < 12.0 < told["bounds"][2] and told["bounds"][1] < 57.0 < told["bounds"][3]

    (tmp_path / "canopy.json").write_text('{"cell": 25.0,\n "col0": 3, "row0": 4, "cols": 10, "rows": 20, "half": 1.5, "r_earth": 6378137.0}')
    assert rasters.read_canopy(spark, str(tmp_path / "canopy.json")).first().asDict() == {"cell": 25.0, "col0": 3.0, "row0": 4.0, "cols": 10, "rows": 20, "half": 1.5, "r_earth": 6378137.0}
