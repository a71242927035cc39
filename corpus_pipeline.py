"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and mixing, each over what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlook.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from overlook.llm.common import bounded, table
from overlook.plans.shared import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; null and empty texts stay."""
    scorer = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer, "tx_score").where(F.col("tx_score") < toxicity.THRESHOLD).drop("tx_score")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; ``n_chars`` follows the text where lines went."""
    cut = line_dedup.drop_boilerplate(docs, host="source")
    changed = F.when(F.col("lines_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 and more."""
    return near_copies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked weights, with topic, tokens and probability."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL cannot express the first and third stage. The tests hold near-dedup, decontamination and mixing against brute force; the
#: first stage is held against labels by its operator's tests, and line dedup against SQL by its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        rows = stage(spark, docs, sf_dir)
        with bounded(spark):
            rows.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
