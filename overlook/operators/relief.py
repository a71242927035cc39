"""Sustained descent: how steadily the ground falls away from an observer in each direction."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.functions.geo import bearing
from overlook.operators.lattice import bilinear, corners
from overlook.operators.scoring import DROP_SCALE
from overlook.operators.viewshed import Sampler, by_tile, lists

#: Metres at which heights are compared.
DISTANCES = (250.0, 500.0, 1000.0, 2000.0)


def descents(spark, observers: DataFrame, terrain: DataFrame, cell: float, azimuths: int = 32, distances=DISTANCES) -> DataFrame:
    """``(obs_id, az, drop)`` in quarter degrees; one join of all points to the terrain's corners, one grouped minimum.

    ``observers``: ``obs_id, y, x`` in metres; points beyond the terrain count as level ground.
    """
    ground = corners(terrain)
    standing = bilinear(observers, ground, F.col("y") / cell, F.col("x") / cell, "z0").where("z0 IS NOT NULL")
    fan = [(a, float(d), math.cos(2 * math.pi * a / azimuths) * d, math.sin(2 * math.pi * a / azimuths) * d) for a in range(azimuths) for d in distances]
    points = F.explode(F.array(*[F.struct(F.lit(a).alias("az"), F.lit(d).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for a, d, dy, dx in fan]))
    reached = standing.withColumn("p", points).select("obs_id", "z0", "y", "x", "p.*")
    at = bilinear(reached, ground, (F.col("y") + F.col("dy")) / cell, (F.col("x") + F.col("dx")) / cell, "z")
    angle = F.coalesce(F.degrees(F.atan2(F.col("z0") - F.col("z"), F.col("d"))), F.lit(0.0))
    least = at.groupBy("obs_id", "az").agg(F.min(angle).alias("least"))
    return least.select("obs_id", "az", F.floor(F.greatest(F.least(F.col("least") * DROP_SCALE, F.lit(255.0)), F.lit(0.0))).cast("int").alias("drop"))



def descents_tiles(observers: DataFrame, terrain: DataFrame, cell: float, tile_cells: int = 512, azimuths: int = 32, distances=DISTANCES) -> DataFrame:
    """``(obs_id, drop)`` for whole regions: the same values as arrays by azimuth, tile by tile with a halo of the farthest distance."""

    def work(ids, y, x, grids):
        z = grids["z"]
        sampler, flat = Sampler(z.shape, cell), z.ravel()
        z0 = sampler.height(flat, *sampler.place(y, x))
        stands = ~np.isnan(z0)
        least = np.full((int(stands.sum()), azimuths), np.inf)
        for a in range(azimuths):
            east, north = bearing(a, azimuths)
            for d in distances:
                h = sampler.height(flat, *sampler.place(y[stands] + north * d, x[stands] + east * d))
                least[:, a] = np.minimum(least[:, a], np.nan_to_num(np.degrees(np.arctan2(z0[stands] - h, d)), nan=0.0))
        drop = np.floor(np.clip(least * DROP_SCALE, 0, 255)).astype(np.int16)
        yield pa.table([pa.array(ids[stands]), lists(drop)], names=["obs_id", "drop"])

    return by_tile(observers, terrain, ["z"], cell, tile_cells, max(distances), work, "obs_id long, drop array<short>")
