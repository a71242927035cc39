"""Summaries of regions, points and builds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.functions.geo import compass, dequantise_distance, known
from overlook.operators.viewshed import by_tile


def region_summary(observers: DataFrame, by: list[str] | None = None, every: int = 7, y: str = "gy") -> DataFrame:
    """Reach and water of land observers, over every ``every``-th row: exact median, 90th percentile and maximum.

    ``observers``: ``mean_reach``, ``water``, ``canopy_m``, ``valid`` and the columns in ``by``.
    """
    chosen = observers.where(F.col(y) % every == 0)
    land = F.col("valid")
    at = lambda p: F.percentile(F.when(land, F.col("mean_reach")), F.lit(p))
    share = lambda c: F.avg(F.when(land, F.when(c, 1.0).otherwise(0.0))) * 100
    return chosen.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), (F.avg(F.when(land, 1.0).otherwise(0.0)) * 100).alias("land_pct"), at(0.5).alias("reach_p50"), at(0.9).alias("reach_p90"),
        F.max(F.when(land, F.col("mean_reach"))).alias("reach_max"), share(F.col("water") != 0).alias("water_pct"),
        F.percentile(F.when(land, F.col("canopy_m").cast("double")), F.lit(0.5)).alias("canopy_p50"), share(F.col("canopy_m") < 2).alias("open_pct"), share(F.col("canopy_m") >= 5).alias("forest_pct"),
    )


def summary_cube(observers: DataFrame, dimensions: list[str]) -> DataFrame:
    """Reach and water by every combination of the dimensions and their totals."""
    return observers.where("valid").cube(*dimensions).agg(F.count("*").alias("n"), F.avg("mean_reach").alias("mean_reach"), F.max("mean_reach").alias("max_reach"), F.count_if(F.col("water") != 0).alias("n_water"))


def point_report(directions: DataFrame, far: float = 5000.0, of: int = 32) -> DataFrame:
    """One row an observer: mean, median, best distance with its bearing and name, and how many directions reach ``far``.

    ``directions``: ``obs_id, az, d``. Ties of the best go to the first azimuth.
    """
    best = F.min(F.struct((-F.col("d")).alias("n"), F.col("az")))
    got = directions.groupBy("obs_id").agg(F.avg("d").alias("mean_d"), F.median("d").alias("median_d"), F.max("d").alias("best_d"), best["az"].alias("best_az"), F.count_if(F.col("d") > far).alias("n_far"))
    return got.withColumn("best_name", compass(F.col("best_az") * (360.0 / of)))


def direction_report(signatures: DataFrame, of: int = 32) -> DataFrame:
    """Bearing, name and horizon in degrees for each direction of each observer."""
    bearing = F.col("az") * (360.0 / of)
    return signatures.withColumns({"bearing": bearing, "name": compass(bearing), "horizon_degrees": F.degrees("horizon")})


def descent_percentiles(cells: DataFrame, every: int = 11, y: str = "gy", x: str = "gx", drop: str = "drop_max") -> DataFrame:
    """50th, 75th, 90th and 99th percentile, and the maximum, of the best direction's descent in degrees."""
    chosen = cells.where((F.col(y) % every == 0) & (F.col(x) % every == 0)).select((F.col(drop) / 4.0).alias("v"))
    return chosen.agg(*[F.percentile("v", F.lit(p / 100)).alias(f"p{p}") for p in (50, 75, 90, 99)], F.max("v").alias("most"))


def local_relief(cells: DataFrame, points: DataFrame, half: int, y: str = "iy", x: str = "ix", tile_cells: int = 128) -> DataFrame:
    """Each point's height above the median within ``half`` cells, tile by tile with a halo; a point without a known cell has no row."""
    kind = cells.schema["z"].dataType.simpleString()

    def work(ids, py, px, grids):
        z = grids["z"]
        r, c = np.rint(py).astype(np.int64), np.rint(px).astype(np.int64)
        for i in range(0, len(ids), 512):
            found = []
            for p, a, b in zip(ids[i : i + 512].tolist(), r[i : i + 512].tolist(), c[i : i + 512].tolist()):
                near = z[max(0, a - half) : a + half + 1, max(0, b - half) : b + half + 1]
                near = near[~np.isnan(near)]
                if len(near):
                    own = z[a, b]
                    found.append((p, near.min(), near.max(), None if np.isnan(own) else own - np.median(near)))
            yield pa.table({n: pa.array([f[j] for f in found], pa.int64() if j == 0 else pa.float64()) for j, n in enumerate(("point_id", "lowest", "highest", "above_median"))})

    at = points.select(F.col("point_id").cast("long").alias("obs_id"), F.col("py").alias("y"), F.col("px").alias("x"))
    got = by_tile(at, cells.select(F.col(y).alias("iy"), F.col(x).alias("ix"), "z"), ["z"], 1.0, tile_cells, float(half), work, "point_id long, lowest double, highest double, above_median double")
    return got.select("point_id", F.col("lowest").cast(kind).alias("lowest"), F.col("highest").cast(kind).alias("highest"), "above_median")


def verify_landmarks(landmarks: DataFrame, heights: DataFrame) -> DataFrame:
    """``landmarks`` (name, key, expected_m, tolerance_m) with the height found and whether it is within tolerance."""
    met = landmarks.join(heights, "key", "left").withColumn("difference", known(F.col("z").cast("double")) - F.col("expected_m"))
    return met.withColumn("ok", F.coalesce(F.abs("difference") <= F.col("tolerance_m"), F.lit(False)))


def water_directions(signatures: DataFrame, ground: DataFrame) -> DataFrame:
    """Directions in which water shows, with how far below the observer it lies."""
    return signatures.where(F.col("water_far") > 0).join(ground, ["obs_id", "az"], "left").withColumn("below", F.col("ground") - F.col("water_z"))


def mean_reach(signatures: DataFrame, value: str = "dist_u8") -> DataFrame:
    return signatures.groupBy("obs_id").agg(dequantise_distance(F.avg(value)).alias("mean_reach"))
