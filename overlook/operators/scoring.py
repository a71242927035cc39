"""Scores of observers over a wedge of directions, filters on them, and separated best spots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlook.functions.geo import MAX_DISTANCE, clip, dequantise_distance
from overlook.functions.wedge import AZIMUTHS, Band, Wheel, bins_between, has_far_water, mean_of, picked, sees_water
from overlook.operators.neighbourhood import land_quartile, plot_percentile

#: Quarter degrees in stored descents.
DROP_SCALE = 4


@dataclass
class ViewQuery:
    """What a user asks of a region: every part becomes a condition or a literal of one plan."""

    wheel: Wheel = field(default_factory=Wheel)
    band: Band = field(default_factory=Band)
    require_water: bool = False
    max_canopy_m: float | None = None
    min_descent: float = 0.0
    plot_radius_m: float = 50.0

    def reach(self, signatures: DataFrame, max_distance: float = MAX_DISTANCE) -> DataFrame:
        """Adds ``reach``: mean distance over the wheel's bins, in metres, of land cells only."""
        return signatures.where("valid").withColumn("reach", dequantise_distance(mean_of(F.col("dist"), self.wheel.bins()), max_distance))

    def filters(self, df: DataFrame) -> Column:
        keep = (F.col("reach") > 0) & self.band.holds(F.col("reach"))
        if self.max_canopy_m is not None:
            keep = keep & (F.col("canopy") <= self.max_canopy_m)
        if self.require_water:
            keep = keep & sees_water(F.col("water"), self.wheel.bins())
        if self.min_descent > 0:
            keep = keep & (mean_of(F.col("drop"), self.wheel.bins()) / DROP_SCALE >= self.min_descent)
        return keep & F.col("lit") if "lit" in df.columns else keep

    def score(self, signatures: DataFrame, step: float, rows: int | None = None, cols: int | None = None, max_distance: float = MAX_DISTANCE) -> DataFrame:
        """Signatures that pass, without ``dist``, with ``reach`` held up over a plot: first the quartile, then the filters.

        ``signatures``: ``gy, gx, valid, dist`` and what the filters name: ``canopy``, ``water`` (bits), ``drop``,
        ``lit``. In that order a failing neighbour cannot take a place down. Where a cell is wider than twice the
        radius, values stay as they are.
        """
        own = self.reach(signatures, max_distance).drop("dist")
        radius = int(self.plot_radius_m / step + 0.5)
        if radius >= 1:
            own = land_quartile(own, "reach", radius, rows, cols)
        return own.where(self.filters(own))


@dataclass
class Filters:
    """The other scorer's query: distances below the least count as 0, water by distance."""

    min_distance: float = 0.0
    directions: tuple[float, float] | None = None
    require_water: bool = False
    min_water_distance: float = 0.0

    def bins(self, azimuths: int = AZIMUTHS) -> list[int]:
        return bins_between(*self.directions, azimuths) if self.directions else list(range(azimuths))

    def apply(self, signatures: DataFrame, azimuths: int = AZIMUTHS) -> DataFrame:
        """Adds ``openness, best, best_direction, water_far_best, keep`` to rows of arrays ``max_dist`` and ``water_far``."""
        bins = self.bins(azimuths)
        near = F.transform(picked(F.col("max_dist"), bins), lambda d: F.when(d >= self.min_distance, d).otherwise(0.0))
        # whole nanometres, so that equal distances in another order add up to the same score and tie
        total = F.aggregate(F.transform("_reach", lambda d: F.round(d * 1e9).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(1e9)
        df = signatures.withColumn("_reach", near).withColumn("_water", picked(F.col("water_far"), bins))
        step = 360.0 / azimuths
        df = df.withColumns({"openness": total / F.lit(float(len(bins))), "best": F.array_max("_reach"), "water_far_best": F.array_max("_water")})
        bearings = F.array(*[F.lit(b * step) for b in bins])
        df = df.withColumn("best_direction", F.get(bearings, (F.array_position("_reach", F.col("best")) - 1).cast("int")))
        keep = (F.col("best") >= self.min_distance) & ~F.col("on_water") & F.col("ground").isNotNull()
        if self.require_water:
            keep = keep & has_far_water(F.col("_water"), self.min_water_distance)
        return df.withColumn("keep", F.coalesce(keep, F.lit(False))).drop("_reach", "_water")

    def robust(self, signatures: DataFrame, rows: int, cols: int, step: float, azimuths: int = AZIMUTHS) -> DataFrame:
        """Filter first, then the percentile over a plot, failing cells counting as 0."""
        scored = self.apply(signatures, azimuths).withColumn("score", F.when(F.col("keep"), F.col("openness")).otherwise(0.0))
        return scored.drop("score").join(plot_percentile(scored, "score", rows, cols, step), ["gy", "gx"])


#: Presets of the first survey: any view; water at 300 m or more; the midsummer sunset, 2 km at least.
PRESETS = {
    "openness": Filters(),
    "water": Filters(require_water=True, min_water_distance=300.0),
    "sunset": Filters(min_distance=2000.0, directions=(295.0, 345.0)),
}


def separation(step: float, metres: float = 2000.0) -> int:
    return max(3, int(metres / step + 0.5))


def top_spots(scored: DataFrame, k: int, sep: int, score: str = "reach", key: str = "obs_id", y: str = "gy", x: str = "gx") -> DataFrame:
    """The ``k`` best cells, each more than ``sep`` cells away from all better picks in y or x, with ``rank`` from 1.

    Scores of 0 and less are no spots; ties go to the smaller key. A pick can hide at most (2 * sep + 1) ** 2 cells, so
    the k picks are among the best k * (2 * sep + 1) ** 2 candidates: that bound is met by a distributed top-n, and the
    greedy choice folds over that array in one row. It is exact, whatever the size of the region.
    """
    most = (k - 1) * (2 * sep + 1) ** 2 + 1
    best = scored.where(F.col(score) > 0).select(F.col(score).alias("score"), F.col(key).alias("id"), F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x"))
    best = best.orderBy(F.desc("score"), "id").limit(most)
    row = F.struct((-F.col("score")).alias("n"), "id", "y", "x", "score")
    line = best.agg(F.array_sort(F.collect_list(row)).alias("c"))
    kind = "array<struct<id:bigint,y:bigint,x:bigint,score:double>>"
    item = lambda c: F.struct(c["id"].cast("long").alias("id"), c["y"].alias("y"), c["x"].alias("x"), c["score"].cast("double").alias("score"))
    close = lambda acc, c: F.exists(acc, lambda p: (F.abs(p["y"] - c["y"]) <= sep) & (F.abs(p["x"] - c["x"]) <= sep))
    picks = F.aggregate("c", F.array().cast(kind), lambda acc, c: F.when((F.size(acc) >= k) | close(acc, c), acc).otherwise(F.concat(acc, F.array(item(c)))))
    out = line.select(F.posexplode(picks).alias("rank", "s"))
    return out.select((F.col("rank") + 1).cast("long").alias("rank"), F.col("s.id").alias(key), F.col("s.y").alias(y), F.col("s.x").alias(x), "s.score")


def best_direction(signatures: DataFrame, bins: list[int], values: str = "dist", azimuths: int = AZIMUTHS) -> DataFrame:
    """Adds ``best`` and ``best_az``: the farthest of the bins, the first on ties."""
    chosen = picked(F.col(values), bins)
    df = signatures.withColumn("best", F.array_max(chosen))
    at = (F.array_position(chosen, F.col("best")) - 1).cast("int")
    return df.withColumn("best_az", F.get(F.array(*[F.lit(b) for b in bins]), at))


def sustained_descent(z0: Column, heights: list[tuple[float, Column]]) -> Column:
    """Least angle down to the heights at several distances, 0 where a height is unknown, in cut quarter degrees, 0 to 255."""
    angles = [F.coalesce(F.degrees(F.atan2(z0 - z, F.lit(float(d)))), F.lit(0.0)) for d, z in heights]
    return F.floor(clip(F.least(*angles) * DROP_SCALE if len(angles) > 1 else angles[0] * DROP_SCALE, 0.0, 255.0)).cast("int")
