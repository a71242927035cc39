"""The batch jobs from a command line: ``spark-submit --py-files overlook.zip overlook/__main__.py JOB ...`` or ``python -m overlook JOB ...``.

Tables are Parquet. ``--cells`` holds a metric raster ``iy, ix, z`` and, if known, ``canopy`` and ``land_class``; row 0 is in the south.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlook.operators import lattice, tiles
from overlook.plans import builds
from overlook.plans.shipping import ship
from overlook.sources.rasters import read_region, variants


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="overlook", description=__doc__.split("\n\n")[0])
    jobs = top.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, *needs: str) -> argparse.ArgumentParser:
        p = jobs.add_parser(name, help=text)
        for need in needs:
            p.add_argument(f"--{need}", required=True)
        return p

    box = {"nargs": 4, "type": float, "metavar": ("LAT0", "LAT1", "LON0", "LON1")}
    p = job("region", "signatures of every observer, tile by tile; a run that stopped goes on where it was", "cells", "out")
    p.add_argument("--bbox", required=True, **box, help="centres of the outer observers")
    p.add_argument("--cell", type=float, default=builds.CELL, help="metres")
    p.add_argument("--obs-step", type=float, default=builds.OBSERVER, help="metres")
    p.add_argument("--tile-cells", type=int, default=512)
    p.add_argument("--only", type=int, default=0, help="stop after so many tiles")
    p.add_argument("--veg", nargs="+", choices=builds.VEGETATION, default=list(builds.VEGETATION), help="build these states alone")
    p.add_argument("--eyes", nargs="+", type=float, default=list(builds.EYES), help="metres")
    p.add_argument("--azimuths", type=int, default=32)
    p.add_argument("--max-dist", type=float, default=builds.geo.MAX_DISTANCE, help="metres")
    p.add_argument("--data-version", default="1", help="of the inputs; tiles of another one are built again")

    p = job("relief", "sustained descent of every observer", "cells", "out")
    p.add_argument("--cell", type=float, default=builds.CELL)
    p.add_argument("--obs-step", type=float, default=builds.OBSERVER)
    p.add_argument("--azimuths", type=int, default=32)
    p.add_argument("--tile-cells", type=int, default=512)

    p = job("pack", "overview and native level of every signature set of a region, by tile", "region", "out")
    p.add_argument("--overview-factor", type=int, default=4)
    p.add_argument("--tile", type=int, default=256)
    p.add_argument("--overview-only", action="store_true")

    p = job("contours", "contour lines as GeoJSON features", "cells", "out")
    p.add_argument("--origin", nargs=2, type=float, required=True, metavar=("LAT", "LON"), help="of the cell in row 0 and column 0")
    p.add_argument("--interval", type=float, default=10.0, help="metres of height")
    p.add_argument("--major-every", type=int, default=5)
    p.add_argument("--step", type=float, default=50.0, help="metres from cell to cell")
    p.add_argument("--smooth", type=float, default=1.0, help="of the Gaussian, in cells")
    p.add_argument("--tolerance", type=float, default=18.0, help="of the simplification, in metres")
    return top


def _size(cells: DataFrame) -> tuple[int, int]:
    """Rows and columns of a raster, (0, 0) if it is empty."""
    y, x = cells.agg(F.max("iy"), F.max("ix")).first()
    return (0, 0) if y is None else (int(y) + 1, int(x) + 1)


def _observers(spark: SparkSession, cells: DataFrame, cell: float, step: float) -> tuple[DataFrame, int, int]:
    """Observers every ``step`` metres over the raster, and how many rows and columns of them."""
    rows, cols = (int((n - 1) * cell // step) + 1 if n else 0 for n in _size(cells))
    return lattice.lattice(spark, rows, cols, 0.0, 0.0, step, step).withColumnsRenamed({"iy": "gy", "ix": "gx"}), rows, cols


def region(spark: SparkSession, a: argparse.Namespace) -> None:
    cells = spark.read.parquet(a.cells)
    observers, rows, cols = _observers(spark, cells, a.cell, a.obs_step)
    if a.only:
        side = a.tile_cells * a.cell
        key = F.struct(F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx"))
        first = tiles.chosen(observers.select(key.alias("key")).distinct(), limit=a.only)
        observers = observers.withColumn("key", key).join(first, "key", "left_semi").drop("key")
    meta = builds.region_meta(spark, tuple(a.bbox), rows, cols, a.azimuths, a.obs_step, a.max_dist / 1000, a.eyes, a.veg)
    # a set of other states, heights or distances is other work
    version = " ".join(map(str, [a.data_version, *a.veg, *a.eyes, a.azimuths, a.max_dist, a.tile_cells]))
    builds.build_region(builds.terrain(cells, a.cell), observers, a.out, a.tile_cells, a.cell, meta=meta, version=version, eyes=a.eyes, vegetation=a.veg, azimuths=a.azimuths, reach=a.max_dist)


def relief(spark: SparkSession, a: argparse.Namespace) -> None:
    cells = spark.read.parquet(a.cells)
    observers, *_ = _observers(spark, cells, a.cell, a.obs_step)
    builds.build_relief(observers, cells, a.cell, a.azimuths, a.tile_cells).write.mode("overwrite").parquet(builds.stores.claim(spark, a.out))


def pack(spark: SparkSession, a: argparse.Namespace) -> None:
    meta = read_region(spark, f"{a.region}/region.json")
    about = meta.first()
    for veg, cm in sorted(variants(meta).collect()):
        builds.pack_region(builds.read_region(spark, a.region, veg, cm), about["rows"], about["cols"], (about["lat0"], about["lat1"], about["lon0"], about["lon1"]), f"{a.out}/{veg}_{cm}", about["obs_m"], a.overview_factor, a.tile, a.overview_only)


def contours(spark: SparkSession, a: argparse.Namespace) -> None:
    cells = spark.read.parquet(a.cells).select("iy", "ix", "z")
    builds.export_contours(cells, *_size(cells), a.out, *a.origin, a.interval, a.major_every, a.step, a.smooth, a.tolerance).show()


JOBS = {f.__name__: f for f in (region, relief, pack, contours)}


def main(words: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    asked = parser().parse_args(words)
    own = spark or SparkSession.builder.appName(f"overlook {asked.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(own)
    JOBS[asked.job](own, asked)


if __name__ == "__main__":
    main()
