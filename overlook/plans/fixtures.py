"""Stand-ins for terrain, signatures and spots, made from the general test tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of the signature lattice.
COLS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "e")).withColumn("e", F.col("e").cast("double"))


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"obs_id": F.col("vec_id"), "gx": F.col("vec_id") % COLS, "gy": F.floor(F.col("vec_id") / float(COLS)).cast("long")})


def _u8(e):
    return F.greatest(F.least(F.floor((e + 0.6) / 1.2 * 255), F.lit(255)), F.lit(0)).cast("long")


def sig_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(obs_id, gx, gy, az, dist_u8)``: 32 azimuths on a 25-wide lattice."""
    return _placed(emb(spark, sf_dir).where("p < 32")).select("obs_id", "gx", "gy", F.col("p").cast("long").alias("az"), _u8(F.col("e")).alias("dist_u8"))


def sig_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an observer, arrays by azimuth, as regions store them: no explode, no shuffle."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    df = _placed(table(spark, sf_dir, "embeddings")).withColumn("v", v)
    bits = F.aggregate(F.transform(F.slice("v", 33, 32), lambda x, i: F.when(x > 0.1, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return df.select(
        "obs_id", "gx", "gy", F.transform(F.slice("v", 1, 32), _u8).alias("dist"), bits.alias("water"), (F.col("label") != 0).alias("valid"), (F.col("label") * 3).cast("long").alias("canopy_m"),
        (40 + F.col("label") * 10 + F.col("vec_id") % 7).cast("long").alias("elev_m"),
    )


def dem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(iy, ix, z)``: integer terrain, rough."""
    return emb(spark, sf_dir).select(F.col("vec_id").alias("iy"), F.col("p").cast("long").alias("ix"), F.floor(200 + 200 * F.col("e")).cast("long").alias("z"))


def dem_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a moving mean along rows."""
    w = W.partitionBy("iy").orderBy("ix").rowsBetween(-4, 4)
    return dem_cells(spark, sf_dir).select("iy", "ix", F.floor(F.sum("z").over(w) / F.count("*").over(w).cast("double")).cast("long").alias("z"))


def raster_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the stand-in raster; it has 64 columns."""
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(obs_id, gy, gx, y, x)``: the observers of the stand-in raster, every 100 m over its cells of 25 m."""
    from overlook.operators.lattice import lattice

    return lattice(spark, -(-raster_rows(spark, sf_dir) // 4), 16, 0.0, 0.0, 100.0, 100.0).withColumnsRenamed({"iy": "gy", "ix": "gx"})


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(iy, ix, z, canopy, land_class)`` of the smooth raster."""
    return dem_smooth(spark, sf_dir).withColumns({"canopy": F.col("z") % 4 * 3, "land_class": F.when(F.col("iy") % 9 == 0, 20).when(F.col("ix") % 11 == 0, 50).otherwise(10)})


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(key.cast("long").alias("pos"), ((5530 + key % 39).cast("double") / 100).alias("lat"), ((1110 + key % 13).cast("double") / 100).alias("lon"), F.col("s_name").alias("name"))


def sun_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), ((5530 + F.col("user_id") % 390).cast("double") / 100).alias("lat"), ((1110 + F.col("user_id") % 350).cast("double") / 100).alias("lon"))


#: The same as common table expressions.
SQL = {
    "emb": "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings",
    "sig_long": """SELECT vec_id AS obs_id, vec_id % 25 AS gx, CAST(floor(vec_id / CAST(25 AS DOUBLE)) AS BIGINT) AS gy, CAST(p AS BIGINT) AS az,
        CAST(greatest(least(floor((e + CAST(0.6 AS DOUBLE)) / CAST(1.2 AS DOUBLE) * 255), 255), 0) AS BIGINT) AS dist_u8 FROM emb WHERE p < 32""",
    "sig_water": """SELECT vec_id AS obs_id, CAST(sum(CASE WHEN e > CAST(0.1 AS DOUBLE) THEN CAST(pow(2, p - 32) AS BIGINT) ELSE 0 END) AS BIGINT) AS water
        FROM emb WHERE p >= 32 GROUP BY vec_id""",
    "sig_site": """SELECT vec_id AS obs_id, vec_id % 25 AS gx, CAST(floor(vec_id / CAST(25 AS DOUBLE)) AS BIGINT) AS gy,
        label <> 0 AS valid, CAST(label * 3 AS BIGINT) AS canopy_m, CAST(40 + label * 10 + vec_id % 7 AS BIGINT) AS elev_m FROM embeddings""",
    "dem_cells": "SELECT vec_id AS iy, CAST(p AS BIGINT) AS ix, CAST(floor(200 + 200 * e) AS BIGINT) AS z FROM emb",
    "dem_smooth": """SELECT iy, ix, CAST(floor(sum(z) OVER w / CAST(count(*) OVER w AS DOUBLE)) AS BIGINT) AS z
        FROM dem_cells WINDOW w AS (PARTITION BY iy ORDER BY ix ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
    "spots": """SELECT CAST(s_suppkey AS BIGINT) AS pos, CAST(5530 + s_suppkey % 39 AS DOUBLE) / 100 AS lat, CAST(1110 + s_suppkey % 13 AS DOUBLE) / 100 AS lon, s_name AS name FROM supplier""",
    "sun_instants": "SELECT event_id, ts, CAST(5530 + user_id % 390 AS DOUBLE) / 100 AS lat, CAST(1110 + user_id % 350 AS DOUBLE) / 100 AS lon FROM events",
}
_NEEDS = {"sig_long": ["emb"], "sig_water": ["emb"], "dem_cells": ["emb"], "dem_smooth": ["emb", "dem_cells"]}


def with_fixtures(body: str, *names: str, recursive: bool = False) -> str:
    """SQL that starts with the fixtures that it names; ``body`` continues the list of table expressions."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order) + body
