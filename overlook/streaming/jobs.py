"""Resumable tile jobs, latest-wins updates, spot imports and event windows on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from overlook.functions.spots import is_spot, spot_id
from overlook.sources import ledger


def run_tiles(jobs: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, by: str = "key", version: str = "1"):
    """Run a stream of tile jobs to its end: each micro-batch builds what no earlier one has finished.

    A ledger beside the data names finished tiles, so that a job that comes again, in this stream or another, is skipped;
    a batch that runs again after a failure builds only what has no entry, over the same partitions.
    """

    def batch(df: DataFrame, number: int) -> None:
        ledger.build(df, build, out, f"{out}-ledger", version, by, f"{number:020d}")

    query = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(updates: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key, by ``version``; run in update mode."""
    rest = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("s")).select(key, "s.*")


def new_spots(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Spots as they first arrive; state is kept for ``delay`` of event time."""
    named = stream.where(is_spot(F.col("lat"), F.col("lon"))).withColumn("id", spot_id(F.col("lat"), F.col("lon")))
    return named.withWatermark(time, delay).dropDuplicatesWithinWatermark(["id"])


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # the file source lists folders and patterns, so the name is given as a pattern
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by fixed window and type; later than ``delay`` is late."""
    w = F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", slide: str = "3 hours", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_the_end(stream: DataFrame, spark: SparkSession, folder: str, mode: str = "update", key: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is, into a table in ``folder``, and read that.

    In update mode a batch holds the rows that changed, state behind the watermark is freed, and of the versions of a
    ``key`` the last one counts; a batch that runs again replaces its own part. In append mode rows are final as they
    come. Complete mode, whose state is never freed, is for sessions over a bounded input: the engine has no updates of them.
    """
    out, marks = f"{folder}/out", f"{folder}/marks"

    def batch(df: DataFrame, number: int) -> None:
        part = 0 if mode == "complete" else number
        df.withColumn("_batch", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(out)

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(out)
    if mode != "update":
        return rows.drop("_batch")
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("s")).select(*key, "s.*")
