"""Lists of saved spots: insert, delete, rename, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from overlook.functions.spots import is_spot, spot_id


def identified(spots: DataFrame) -> DataFrame:
    """Spots with finite coordinates, with ``id``."""
    return spots.where(is_spot(F.col("lat"), F.col("lon"))).withColumn("id", spot_id(F.col("lat"), F.col("lon")))


def unsaved(incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """Incoming spots that are not saved: an anti-join on the id."""
    return identified(incoming).join(identified(saved).select("id"), "id", "left_anti")


def is_saved(spots: DataFrame, saved: DataFrame) -> DataFrame:
    return identified(spots).join(identified(saved).select("id"), "id", "left_semi")


def first_of_each(spots: DataFrame) -> DataFrame:
    """One spot an id, the first by ``pos``: a grouped minimum, combined map-side."""
    rest = [c for c in spots.columns if c not in ("id", "pos")]
    return spots.groupBy("id").agg(F.min(F.struct("pos", *rest)).alias("s")).select("id", "s.*")


def merged(saved: DataFrame, incoming: DataFrame) -> DataFrame:
    """Saved spots as they are, then the first of each new incoming one: ``part`` 0 and 1, each in order of ``pos``.

    Both have ``pos, lat, lon, name``. Nothing saved moves or goes, even if it repeats; missing names become empty.
    """
    new = first_of_each(unsaved(incoming, saved)).select("pos", "lat", "lon", F.coalesce("name", F.lit("")).alias("name"), "id")
    old = saved.select("pos", "lat", "lon", "name", spot_id(F.col("lat"), F.col("lon")).alias("id"))
    return old.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)))


def with_spot(saved: DataFrame, spot: DataFrame) -> DataFrame:
    """Newest first: a new spot comes before all others, unless its place is saved."""
    return merged(saved, spot).withColumn("part", 1 - F.col("part"))


def without_spot(saved: DataFrame, id: str) -> DataFrame:
    return saved.where(~spot_id(F.col("lat"), F.col("lon")).eqNullSafe(F.lit(id)))


def renamed(saved: DataFrame, id: str, name: str) -> DataFrame:
    return saved.withColumn("name", F.when(spot_id(F.col("lat"), F.col("lon")) == id, F.lit(name)).otherwise(F.col("name")))


def ordered_stops(spots: DataFrame, by: list[str] | None = None, most: int = 10) -> DataFrame:
    """The first ``most`` stops of each list, as one array of ``lat,lon`` texts in order."""
    at = W.partitionBy(*(by or [F.lit(1)])).orderBy("pos")
    first = identified(spots).withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= most)
    return first.groupBy(*(by or [])).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda s: s["id"]).alias("stops"))


def bounding_box(spots: DataFrame) -> DataFrame:
    return identified(spots).agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
