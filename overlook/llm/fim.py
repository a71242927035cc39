"""Fill-in-the-middle documents from an index of distinct texts.

Identical texts are grouped by a verified digest, the token boundaries of each are listed once, in Elias-Fano form, and the
list is joined back to the documents that hold the text. A document's cuts are two selections in that list, seeded by its id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, MapType, StructField, StructType

from overlook.llm.common import free_names, table
from overlook.plans.shared import written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text that more documents hold is given out in several parts; as many texts as ``HOT_TEXTS`` may be so, whatever the table.
COPIES, HOT_TEXTS = 256, 100_000


def boundaries(text: bytes) -> tuple[np.ndarray, int]:
    """(ends of the tokens, length) in code points of a UTF-8 text; a token is a word with the white space before it, or the last white space."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), 0
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    after = np.append(blank[1:], True)
    last = ~blank & after
    last[-1] = True
    at = np.flatnonzero(last)
    if b.max() < 128:
        return at + 1, len(b)
    chars = np.cumsum((b & 0xC0) != 0x80)
    return chars[at], int(chars[-1])


def elias_fano(values: np.ndarray, limit: int) -> tuple[int, bytes, bytes]:
    """(low bits a value, low parts, high parts) of ascending ``values`` up to ``limit``: about 2 + log2(limit / n) bits each."""
    n = len(values)
    width = max(0, int(limit // n).bit_length() - 1) if n else 0
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8) if width else np.zeros(0, np.uint8)
    high = np.zeros(n + (limit >> width) + 1, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return width, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(width: int, low: bytes, high: bytes, i: int) -> int:
    """The value of rank ``i`` (from 0) of an Elias-Fano list, from the byte that holds its bit and its own low part."""
    h = np.frombuffer(high, np.uint8)
    upto = np.cumsum(np.bitwise_count(h), dtype=np.int64)
    byte = int(np.searchsorted(upto, i + 1))
    bits = np.flatnonzero(np.unpackbits(h[byte : byte + 1], bitorder="little"))
    place = byte * 8 + int(bits[i - (upto[byte - 1] if byte else 0)])
    first, end = i * width, (i + 1) * width
    part = np.unpackbits(np.frombuffer(low[first // 8 : (end + 7) // 8], np.uint8), bitorder="little")[first % 8 : first % 8 + width]
    return ((place - i) << width) + sum(int(x) << k for k, x in enumerate(part))


LISTS = StructType([StructField("n", LongType()), StructField("width", IntegerType()), StructField("low", BinaryType()), StructField("high", BinaryType())])
CUTS = StructType([StructField("prefix", LongType()), StructField("middle", LongType())])


@F.arrow_udf(LISTS)
def _lists(text: pa.Array) -> pa.Array:
    rows = []
    for t in text.cast(pa.binary()):
        ends, chars = boundaries(t.as_py())
        width, low, high = elias_fano(ends, chars)
        rows.append({"n": len(ends), "width": width, "low": low, "high": high})
    return pa.array(rows, pa.struct([("n", pa.int64()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary())]))


@F.arrow_udf(CUTS)
def _cuts(lists: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    out = []
    for e, a, b in zip(lists, first, second):
        e = e.as_py()
        if e is None:
            out.append(None)
            continue
        a, b = sorted((a.as_py() % (e["n"] + 1), b.as_py() % (e["n"] + 1)))
        ends = [select(e["width"], e["low"], e["high"], k - 1) if k else 0 for k in (a, b)]
        out.append({"prefix": ends[0], "middle": ends[1] - ends[0]})
    return pa.array(out, pa.struct([("prefix", pa.int64()), ("middle", pa.int64())]))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """``(digest, part, text)``: one row a text (and part).

    ``texts``: ``digest, part, text``. Rows of one digest are combined before they move, and two texts of one SHA-256
    digest, told apart by a second hash and their length, are an error.
    """
    own = F.xxhash64("text")
    size = F.length("text")
    kept = texts.groupBy("digest", "part").agg(F.first("text").alias("text"), F.min(own).alias("h0"), F.max(own).alias("h1"), F.min(size).alias("s0"), F.max(size).alias("s1"))
    alike = (F.col("h0") == F.col("h1")) & (F.col("s0") == F.col("s1"))
    return kept.select("digest", "part", F.when(alike, F.col("text")).otherwise(F.raise_error(F.lit("two texts share a digest"))).alias("text"))


def boundary_index(distinct: DataFrame) -> DataFrame:
    """``(digest, part, lists)``: the boundaries of each distinct text, listed once, about a tenth of its size."""
    return distinct.select("digest", "part", _lists("text").alias("lists"))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, copies: int = COPIES) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output`` added last.

    ``rate`` of 100 documents are cut, ``spm`` of 100 of those put their suffix first. A text that is empty or holds a
    marker stays plain. A null text counts as empty and stays null in its own column; a null key is hashed as no
    characters; rows that repeat, or share a key, each get their own output. A new column whose name ``docs`` has already
    gets underscores. Texts move once, each distinct one, and once more for every ``copies`` documents that hold it (more
    copies a part in tables of over 25 million rows), so that no task hands out a common text alone.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    plain_names = [c for c in docs.columns if c != text]
    spread = [F.col(c) for c in plain_names if not isinstance(docs.schema[c].dataType, MapType)]
    most = max(copies, -(-docs.count() // HOT_TEXTS))
    many = docs.select(_digest(body).alias("digest")).groupBy("digest").count().where(F.col("count") > most)
    # at most HOT_TEXTS rows, as each stands for more than a HOT_TEXTS-th part of the table
    hot = F.broadcast(written(many.select("digest", F.ceil(F.col("count") / most).cast("int").alias("parts")), "fim-hot"))
    own = F.struct(*[F.col(c) for c in plain_names], F.col(text).isNull().alias("_null_")) if plain_names else F.struct(F.col(text).isNull().alias("_null_"))
    seeded = F.coalesce(F.col(key).cast("string"), F.lit(""))
    placed = docs.select(_digest(body).alias("digest"), body.alias("text"), own.alias("own"), (F.xxhash64(*spread) if spread else F.lit(0).cast("long")).alias("at"), F.sha2(F.concat(F.lit(f"{seed}:"), seeded).cast("binary"), 256).alias("h"))
    placed = placed.join(hot, "digest", "left").withColumn("part", F.pmod("at", F.coalesce("parts", F.lit(1))).cast("int"))
    distinct = distinct_texts(placed.select("digest", "part", "text"))
    h = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    met = placed.select("digest", "part", "own", *[x.alias(f"h{i + 1}") for i, x in enumerate(h)]).join(distinct, ["digest", "part"])
    # the list alone goes through Python and moves again; the texts stay in the partitions that they were grouped in
    met = met.join(boundary_index(distinct), ["digest", "part"])
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    met = met.withColumn("form", form)
    met = met.withColumn("cut", _cuts(F.when(F.col("form") != "plain", F.col("lists")), F.col("h1"), F.col("h2")))
    a, m = F.col("cut.prefix"), F.col("cut.middle")
    part = lambda at, n: F.substring(F.col("text"), at, n)
    cut = {"p": part(F.lit(1), a.cast("int")), "m": part((a + 1).cast("int"), m.cast("int")), "s": part((a + m + 1).cast("int"), F.length("text"))}
    psm = F.concat(F.lit(PREFIX), cut["p"], F.lit(SUFFIX), cut["s"], F.lit(MIDDLE), cut["m"])
    spm_first = F.concat(F.lit(SUFFIX), cut["s"], F.lit(PREFIX), cut["p"], F.lit(MIDDLE), cut["m"])
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_first)
    names = free_names(docs, "n", "form", "prefix_chars", "middle_chars", "output")
    columns = [F.when(~F.col("own._null_"), F.col("text")).alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns]
    return met.select(*columns, *[v.alias(c) for c, v in zip(names, (F.col("lists.n"), F.col("form"), a, m, output))])


def restore(output: Column, form: Column) -> Column:
    """The text back from an output and its form: no piece holds a marker, so each marker's first place is its own."""
    first = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    opened = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    at, mid = F.instr(opened, first), F.instr(opened, F.lit(MIDDLE))
    one = F.substring(opened, F.lit(1), at - 1)
    two = F.substring(opened, at + len(PREFIX), mid - at - len(PREFIX))
    middle = F.substring(opened, mid + len(MIDDLE), F.length(opened))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13_fim(spark, sf_dir):
    """Every document cut by its seed, with digests of the output and of the text restored from it."""
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS k, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
v AS (SELECT *, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, array_to_string(k[1:a], '') AS p, array_to_string(k[a + 1:b], '') AS m, array_to_string(k[b + 1:], '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM w
"""
