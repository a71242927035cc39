"""Site-relative line frequency: drop lines that stand on too large a share of a host's pages.

Only DataFrame operations. Lines are compared after trimming spaces, tabs and carriage returns; blank lines are never
counted or dropped. Counting shuffles two 64-bit hashes a distinct line of a page, combined map-side, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlook.llm.common import free_names, table
from overlook.plans.shared import cut

RATIO = 0.1
MIN_PAGES = 5
#: Rows (about 40 bytes each) up to which the boilerplate table is broadcast; beyond, texts meet it in a salted join.
BROADCAST_ROWS = 200_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without ``www.``; null where there is none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    bare = _trimmed(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("second"), bare).alias("b"))


def boilerplate_lines(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(ld_host, ld_key, ld_pages, ld_total)`` of the lines on more than ``ratio`` of a host's pages and on ``min_pages`` at least."""
    named = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("ld_host"), F.col(text).alias("ld_text"))
    lines = F.filter(F.split("ld_text", "\n", -1), lambda x: _trimmed(x) != "")
    pages = (
        named.select("ld_host", F.explode(F.array_distinct(F.transform(lines, _key))).alias("ld_key"))
        .groupBy("ld_host", "ld_key")
        .agg(F.count("*").alias("ld_pages"))
        .where(F.col("ld_pages") >= min_pages)
    )
    totals = named.groupBy("ld_host").agg(F.count("*").alias("ld_total"))
    return pages.join(totals, "ld_host").where(F.col("ld_pages") > F.col("ld_total") * F.lit(float(ratio)))


def drop_boilerplate(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and ``lines_in`` and ``lines_dropped`` added.

    Every row stays. A null text stays null with 0 lines; a null host counts as the host ``''``; an empty text is one
    blank line; a text whose lines all go becomes empty. Copies of a page count as pages of their own. Existing columns
    called ``lines_in`` or ``lines_dropped`` are replaced; all other columns stay, whatever they are called.

    A host has at most (lines a page) / ratio boilerplate lines, kept as one array a host. If the whole table has no
    more than ``broadcast_rows`` rows it is broadcast, and texts are not shuffled at all; otherwise hosts are salted, so
    that a host with a third of all pages is spread over as many parts as there are partitions. A page's lines meet its
    host's by hash; exact keys are compared only where some hash is shared.
    """
    found = cut(boilerplate_lines(docs, host, text, ratio, min_pages))
    rows = found.count()
    base = docs.drop("lines_in", "lines_dropped")
    own_host, keys, hashes, lines, hit, kept, salt = free_names(base, "ld_host", "ld_keys", "ld_hashes", "ld_lines", "ld_hit", "ld_kept", "ld_salt")
    by_host = found.groupBy(F.col("ld_host").alias(own_host)).agg(F.collect_list("ld_key").alias(keys)).withColumn(hashes, F.transform(keys, lambda k: k["a"]))
    keyed = base.withColumn(own_host, F.coalesce(F.col(host).cast("string"), F.lit("")))
    if rows <= broadcast_rows:
        met = keyed.join(F.broadcast(by_host), own_host, "left")
    else:
        salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        plain = [f.name for f in base.schema if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
        spread = by_host.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = keyed.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int")).join(spread, [own_host, salt], "left").drop(salt)
    met = met.withColumn(lines, F.split(F.col(text), "\n", -1))
    met = met.withColumn(hit, F.array_intersect(F.transform(lines, lambda x: F.xxhash64(_trimmed(x))), F.col(hashes)))
    some = F.coalesce(F.size(hit) > 0, F.lit(False))
    suspects = F.filter(keys, lambda k: F.array_contains(F.col(hit), k["a"]))
    met = met.withColumn(kept, F.when(some, F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(suspects, _key(x)))))
    gone = F.when(some, F.size(lines) - F.size(kept)).otherwise(0)
    return (
        met.withColumns({"lines_in": F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long"), "lines_dropped": gone.cast("long")})
        .withColumn(text, F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text)))
        .drop(own_host, keys, hashes, lines, hit, kept)
    )


def op3_line_dedup(spark, sf_dir):
    """Line dedup of ``documents``, a source being a host."""
    out = drop_boilerplate(table(spark, sf_dir, "documents"), host="source")
    return out.select("doc_id", "text", "lines_in", "lines_dropped")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS host FROM documents),
l AS (SELECT r, host, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
n AS (SELECT host, bare, count(DISTINCT r) AS pages FROM k WHERE bare <> '' GROUP BY host, bare),
t AS (SELECT host, count(*) AS total FROM d GROUP BY host),
b AS (SELECT n.host, n.bare FROM n JOIN t USING (host) WHERE pages >= {MIN_PAGES} AND pages > total * CAST({RATIO} AS DOUBLE)),
m AS (SELECT k.r, k.p, k.line, b.bare IS NOT NULL AS gone FROM k LEFT JOIN b ON k.host = b.host AND k.bare = b.bare),
a AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text, count(*) AS lines_in,
             CAST(sum(CAST(gone AS BIGINT)) AS BIGINT) AS lines_dropped FROM m GROUP BY r)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE a.text END AS text, coalesce(a.lines_in, 0) AS lines_in,
       coalesce(a.lines_dropped, 0) AS lines_dropped
FROM d LEFT JOIN a USING (r)
"""
