"""Sun, spots, readers, writers and streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.functions import sun
from overlook.functions.spots import decode_share, encode_share, route_url, share_code, share_url
from overlook.operators import pyramid, spots, tiles
from overlook.sources import rasters, stores
from overlook.streaming import jobs


@pytest.mark.parametrize("day, lat, lon, minutes", [("2026-06-21", 57.7, 11.97, 18 * 60 + 5), ("2026-12-21", 55.7, 13.19, 7 * 60 + 1), ("2026-03-20", 57.7, 11.97, 12 * 60 + 10)])
def test_day_length(spark, day, lat, lon, minutes):
    place = spark.createDataFrame([(day, lat, lon)], "day string, lat double, lon double").withColumn("day", F.col("day").cast("date"))
    down, up = (sun.horizon_crossing(place, setting=s).first()["minute"] for s in (True, False))
    assert abs(down - up - minutes) <= 3


def test_midnight_sun_has_no_sunset(spark):
    place = spark.createDataFrame([("2026-06-21", 67.86, 20.23)], "day string, lat double, lon double").withColumn("day", F.col("day").cast("date"))
    assert sun.horizon_crossing(place).first()["minute"] is None


def test_limb_is_above_the_centre(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.999,)], "s double").select(sun.tan_upper_limb(F.col("s")).alias("t"), (F.col("s") / F.sqrt(1 - F.col("s") * F.col("s"))).alias("c")).toPandas()
    assert (df.t[:2] > df.c[:2]).all() and df.t[2] == df.c[2]


def test_separable_tangent(spark):
    from datetime import datetime

    df = spark.createDataFrame([(datetime(2026, 6, 21, 12), 57.0, 12.0)], "ts timestamp, lat double, lon double")
    at = sun.with_position(sun.with_sun_tangent(df)).first()
    assert np.degrees(np.arctan(at["sun_tangent"])) == pytest.approx(at["elevation"] + 0.2665, abs=0.05)


def rows(spark, values):
    return spark.createDataFrame(values, "pos long, lat double, lon double, name string")


def test_merge_never_displaces(spark):
    a, b, c = (1, 55.1, 11.1, "A"), (2, 55.2, 11.2, "B"), (3, 55.3, 11.3, "C")
    incoming = rows(spark, [b, c, (4, 55.3, 11.3, "again"), (5, None, 1.0, "x"), (6, float("nan"), 1.0, "y")])
    got = spots.merged(rows(spark, [a, b]), incoming).orderBy("part", "pos").collect()
    assert [r["name"] for r in got] == ["A", "B", "C"] and sum(r["part"] for r in got) == 1
    assert [r["name"] for r in spots.with_spot(rows(spark, [a]), rows(spark, [c])).orderBy("part", "pos").collect()] == ["C", "A"]
    assert spots.without_spot(rows(spark, [a, b]), "55.10000,11.10000").count() == 1
    assert spots.renamed(rows(spark, [a, b]), "55.10000,11.10000", "Z").where("name = 'Z'").count() == 1


def test_share_links(spark):
    s = spark.createDataFrame([([(55.1, 11.25, 'a "b" é')] * n,) for n in (1, 40)] + [([],)], "s array<struct<lat:double,lon:double,name:string>>")
    code = s.select("s", encode_share(F.col("s")).alias("c")).withColumn("c", share_code(share_url(F.lit("https://x.y/#old=1"), F.col("c"))))
    for r in code.select("s", "c", decode_share(F.col("c")).alias("back")).collect():
        assert r["s"] == r["back"] and not set("+/=") & set(r["c"])
    assert spark.range(1).select(decode_share(F.lit("!!!"))).first()[0] in (None, [])
    assert spark.range(1).select(route_url(F.array().cast("array<string>"))).first()[0] is None


def test_elevation_reader(spark, tmp_path):
    z = np.arange(24, dtype="<i2").reshape(4, 6)
    z[0, 0] = -32768
    (tmp_path / "57_12").write_bytes(z.tobytes())
    (tmp_path / "57_13").write_bytes((z + 100).tobytes())
    got = rasters.read_elevation(spark, str(tmp_path), rows=4)
    assert got.count() == 48 and got.where("z IS NULL").count() == 1
    whole = rasters.mosaic(got, 57, 12, rows=4).toPandas()
    assert whole[(whole.iy == 3) & (whole.ix == 11)].z.item() == 123
    (tmp_path / "58_12").write_bytes(z[:, :5].tobytes())
    with pytest.raises(ValueError):
        rasters.mosaic(rasters.read_elevation(spark, str(tmp_path), rows=4), 58, 12, rows=4)


def test_metadata_readers(spark, tmp_path):
    index = {"features": [{"geometry": {"coordinates": [[[1, 2], [3, 2], [3, 5], [1, 5]]]}, "properties": {"tile": "t1"}}]}
    (tmp_path / "index.json").write_text(json.dumps(index, indent=1))
    assert rasters.read_tile_index(spark, str(tmp_path / "index.json")).first().asDict() == {"tile": "t1", "west": 1.0, "east": 3.0, "south": 2.0, "north": 5.0}
    meta = {"lat0": 55.3, "rows": 10, "eyes": [{"cm": 0, "m": 0}, {"cm": 170, "m": 1.7}], "veg": ["trees", "bare"]}
    (tmp_path / "region.json").write_text(json.dumps(meta, indent=1))
    assert rasters.variants(rasters.read_region(spark, str(tmp_path / "region.json"))).count() == 4


def test_pyramid_store(spark, tmp_path):
    level = pyramid.Level(1, 100.0, 5, 5, 4, 0.0, 1.0, 0.0, 1.0)
    cells = spark.createDataFrame([(y, x, y * 5 + x) for y in range(5) for x in range(5)], "gy long, gx long, v long")
    out = str(tmp_path / "p")
    stores.write_pyramid(pyramid.tiled(cells, level), out)
    stores.write_pyramid(pyramid.tiled(cells.where("gy = 4 AND gx = 4").withColumn("v", F.lit(99)), level), out)
    back = spark.read.parquet(out)
    assert back.count() == 25 and back.where("v = 99").count() == 1
    assert pyramid.Window(level, 3, 4, 3, 4).scan(back).count() == 4
    tile = stores.byte_tiles(back, "v", 2).where("tile_y = 0 AND tile_x = 0").first()["data"]
    assert np.frombuffer(tile, "<i2").reshape(4, 4).tolist()[1] == [5, 6, 7, 8]


def test_contour_features(spark, tmp_path):
    lines = spark.createDataFrame([(50, False, [0.0, 100.0], [0.0, 200.0])], "e long, major boolean, ys array<double>, xs array<double>")
    stores.write_contours(lines, str(tmp_path / "c"), 57.0, 12.0)
    f = json.loads(spark.read.text(str(tmp_path / "c")).first()[0])
    assert f["properties"] == {"e": 50, "major": False} and f["geometry"]["coordinates"][0] == [12.0, 57.0]


def test_guard(tmp_path):
    assert stores.guard("/data/a/b", ["/data"]) == "/data/a/b"
    for bad in ("/data/../etc", "/other", "s3://x/data/a"):
        with pytest.raises(PermissionError):
            stores.guard(bad, ["/data"])
    with pytest.raises(OSError):
        stores.check_free_space(str(tmp_path), need_gb=1e9)


def test_work_list(spark):
    work = tiles.work_list(spark, 55.3, 59.2, 11.1, 14.6)
    assert work.count() == 45 and work.agg(F.max("north"), F.max("east")).first() == (59.2, 14.6)
    assert tiles.pending(work, work.limit(3)).count() == 42


def test_tile_jobs_resume(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("jobs", "out", "marks"))
    built = []

    def build(df):
        built.append(df.count())
        return df.withColumn("v", F.lit(1))

    run = lambda: jobs.run_tiles(spark.readStream.schema("key string").json(source), build, out, marks)
    spark.createDataFrame([("a",), ("b",), ("b",)], "key string").write.json(source)
    run()
    run()
    spark.createDataFrame([("c",)], "key string").write.mode("append").json(source)
    run()
    assert built == [2, 1] and spark.read.parquet(out).count() == 3
    assert os.path.isdir(marks)


def test_spot_stream(spark, tmp_path):
    source = str(tmp_path / "spots")
    spark.createDataFrame([("2026-01-01T00:00:00", 55.0, 11.0), ("2026-01-01T00:01:00", 55.0, 11.0), ("2026-01-01T00:02:00", None, 11.0)], "ts string, lat double, lon double").write.json(source)
    stream = spark.readStream.schema("ts timestamp, lat double, lon double").json(source)
    assert jobs.to_the_end(jobs.new_spots(stream), spark, str(tmp_path / "run"), "append").count() == 1


def test_png_tiles(spark):
    import struct
    import zlib

    pixels = spark.createDataFrame([(0, 0, 255, 0, 0, 255), (1, 2, 0, 9, 300, None), (5, 5, 1, 2, 3, 4)], "py long, px long, r int, g int, b int, a int")
    got = {(r["tile_y"], r["tile_x"]): bytes(r["png"]) for r in stores.png_tiles(pixels, 4).collect()}
    assert set(got) == {(0, 0), (1, 1)}
    raw = got[(0, 0)]
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", raw[16:24]) == (4, 4)
    size = struct.unpack(">I", raw[33:37])[0]
    lines = np.frombuffer(zlib.decompress(raw[41 : 41 + size]), np.uint8).reshape(4, 17)[:, 1:].reshape(4, 4, 4)
    assert lines[0, 0].tolist() == [255, 0, 0, 255] and lines[1, 2].tolist() == [0, 9, 255, 0]


def test_sun_view(spark):
    from overlook.operators.sunlight import sun_view

    rows = [(y, x, 150.0 if y == 3 else 10.0, 5.0 if (y, x) == (15, 5) else 0.0, y != 0) for y in range(20) for x in range(12)]
    cells = spark.createDataFrame(rows, "iy long, ix long, z double, canopy double, valid boolean")
    day = {(r["iy"], r["ix"]): r["lit"] for r in sun_view(cells, "2026-12-21 11:10:00", 57.0, 0.001, 12.0, 0.002, 100.0).collect()}
    # low southern sun at midwinter noon: the wall in the south shades what lies north of it
    assert day[(3, 5)] and not day[(5, 5)] and not day[(15, 5)] and day[(19, 6)] and day[(2, 5)]
    night = sun_view(cells, "2026-12-21 23:10:00", 57.0, 0.001, 12.0, 0.002, 100.0)
    assert night.where("lit").count() == 0 and sun_view(cells.limit(0), "2026-12-21 11:10:00", 57.0, 0.001, 12.0, 0.002, 100.0).count() == 0
    assert sun_view(cells, "2026-06-21 10:10:00", 57.0, 0.001, 12.0, 0.002, 100.0, trees=False, compat=True).where("lit").count() > 200
