"""A ledger of finished tiles: what has been built, from which version of the inputs, how many rows, and their digest.

A tile's entry is written after its data. A run that dies in between leaves data without an entry: the next run builds that
tile again, over the same partition, and no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from overlook.sources.stores import write_tiles

ENTRY = "key string, version string, rows long, digest string, run string"


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """``(key, version, rows, digest, run)`` of every finished tile; of several entries of a key and version, the last run's."""
    try:
        every = spark.read.schema(ENTRY).parquet(ledger)
    except AnalysisException:  # nothing has been finished yet
        return spark.createDataFrame([], ENTRY)
    newest = F.max_by(F.struct("rows", "digest", "run"), "run")
    return every.groupBy("key", "version").agg(newest.alias("s")).select("key", "version", "s.*")


def done(spark: SparkSession, ledger: str, version: str = "1") -> DataFrame:
    """``(key)`` of the tiles that are finished for this version of the inputs."""
    return entries(spark, ledger).where(F.col("version") == version).select("key")


def _told(rows: DataFrame, key: str) -> DataFrame:
    """``(key, rows, digest)``: counts and sums of row hashes, so that order and files do not matter."""
    own = F.xxhash64(*[c for c in rows.columns if c != key]).cast("decimal(38,0)")
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("rows"), F.sum(own).cast("string").alias("digest"))


def build(jobs: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, ledger: str, version: str = "1", key: str = "key", run: str | None = None) -> None:
    """Build the tiles of ``jobs`` that the ledger does not name for this version, and name them.

    ``make`` gets the keys to do, once each, and returns rows with ``key``; a tile without rows is finished too. What is
    entered is read back from what was written, and written in one commit of Spark's, so that it is there whole or not at all.
    """
    spark = jobs.sparkSession
    todo = jobs.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    todo = todo.join(done(spark, ledger, version).withColumnRenamed("key", key), key, "left_anti")
    # a run's list of tiles, as the driver of a job has it
    keys = [r[0] for r in todo.collect()]
    if not keys:
        return
    todo = spark.createDataFrame([(k,) for k in keys], f"{key} string")
    made = make(todo)
    write_tiles(made, out, [key])
    stamp = run or spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]
    back = spark.read.schema(made.schema).parquet(out).where(F.col(key).cast("string").isin(keys))
    told = todo.select(F.col(key).alias("key")).join(_told(back, key), "key", "left")
    finished = told.select("key", F.lit(version).alias("version"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("digest", F.lit("0")).alias("digest"), F.lit(stamp).alias("run"))
    finished.coalesce(1).write.mode("append").parquet(ledger)


def damaged(spark: SparkSession, out: str, ledger: str, version: str = "1", key: str = "key") -> DataFrame:
    """``(key, rows, found)`` of finished tiles whose data are no longer what was entered."""
    named = entries(spark, ledger).where(F.col("version") == version)
    now = _told(spark.read.parquet(out).withColumn(key, F.col(key).cast("string")), key).withColumnsRenamed({"rows": "found", "digest": "now"})
    met = named.join(now, "key", "left")
    same = (F.col("rows") == F.coalesce("found", F.lit(0))) & ((F.col("rows") == 0) | F.coalesce(F.col("digest") == F.col("now"), F.lit(False)))
    return met.where(~same).select("key", "rows", F.coalesce("found", F.lit(0)).alias("found"))
