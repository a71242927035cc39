"""Phrases of two to five words that stand together more often than their parts would.

Frequent words get numbers, and pieces break wherever another word stands. Runs of numbers are written once; each length of
phrase is then counted over them: windows are packed into keys of fixed width, cut into ranges, radix-sorted and run-length
counted, in blocks of numpy arrays, so that Spark moves a few large rows. A window of length k is packed only if both its
windows of length k - 1 may be frequent. Everything is exact at any size.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlook.llm.common import bounded, table
from overlook.plans.shared import fresh_path, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Of the dictionary that goes to every worker: words and bytes at most; beyond, words meet their numbers in a join.
SENT_WORDS, SENT_BYTES = 1_000_000, 64 << 20
#: Frequent phrases of one length whose marks go to every worker (8 MB); beyond, the next length is counted without them.
MARKED, BITS = 8_000_000, 26
#: Keys that a task sorts at once, and that a range is made for.
BLOCK, RANGE = 1 << 19, 1 << 20
#: Numbers of a chunk where words meet their numbers in a join.
CHUNK = 4096

BREAK = b"\xff"  # no UTF-8 text holds this byte
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in small letters, with a ``BREAK`` between pieces."""
    return text.translate(_LOWER).replace(BREAK, b" \xff ").split(b" ")


# counting words


def _count_words(batches):
    def rows(counts: dict[str, Counter]):
        langs, words, n = [], [], []
        for lang, c in counts.items():
            total = 0
            for w, k in c.items():
                if w and w != BREAK:
                    langs.append(lang)
                    words.append(w)
                    n.append(k)
                    total += k
            langs.append(lang)
            words.append(None)  # no word: all of the language's
            n.append(total)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "f"])

    counts: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary())):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
        if sum(map(len, counts.values())) > 300_000:
            yield rows(counts)
            counts = {}
    if counts:
        yield rows(counts)


def word_counts(texts: DataFrame) -> DataFrame:
    """``(lang, word, f)`` of ``lang, text``, and a row with a null word for all words of a language. Tasks add up before anything moves."""
    return texts.mapInArrow(_count_words, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def dictionary(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``(id, lang, word, f, n)``: numbers from 1 for the words that occur ``least`` times in their language, which has ``n`` words."""
    kept = written(word_counts(texts).where((F.col("f") >= least) | F.col("word").isNull()), "phrase-words")
    n = kept.where("word IS NULL").select("lang", F.col("f").alias("n"))
    rows = kept.where("word IS NOT NULL").join(n, "lang")
    numbered = rows.select("lang", "word", "f", "n").rdd.zipWithIndex().map(lambda r: (r[1] + 1, *r[0]))
    return written(texts.sparkSession.createDataFrame(numbered, "id bigint, lang string, word binary, f bigint, n bigint"), "phrase-dictionary")


# writing runs of numbers


def _runs(ids: np.ndarray) -> bytes:
    """Numbers with 0 between runs; runs of one number go."""
    if not len(ids):
        return b""
    on = ids > 0
    before, after = np.append(False, on[:-1]), np.append(on[1:], False)
    keep = on & (before | after)
    # one 0 ahead of each run
    first = keep & ~before
    out = np.zeros(int(keep.sum() + first.sum()), np.uint32)
    out[(np.cumsum(keep) + np.cumsum(first) - 1)[keep]] = ids[keep]
    return out.tobytes()


def encode(texts: DataFrame, known: DataFrame, sent_words: int = SENT_WORDS) -> DataFrame:
    """``(m, ids)``: runs of frequent words as 32-bit numbers, many texts a row. A dictionary that is small is sent to the workers."""
    size = known.agg(F.count("*"), F.coalesce(F.sum(F.length("word") + F.length("lang")), F.lit(0))).first()
    if size[0] > sent_words or size[1] > SENT_BYTES:
        return _encode_by_join(texts, known)
    rows = known.select("id", "lang", "word").toArrow()
    sent = texts.sparkSession.sparkContext.broadcast((rows["id"].to_numpy().astype(np.uint32).tobytes(), rows["lang"].to_pylist(), rows["word"].to_pylist()))

    def run(batches):
        ids, langs, words = sent.value
        of: dict[str, dict[bytes, int]] = {}
        for i, lang, w in zip(np.frombuffer(ids, np.uint32).tolist(), langs, words):
            of.setdefault(lang, {})[w] = i
        for b in batches:
            held, blobs = 0, []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary())):
                get = of.get(lang, {}).get
                # a break between pieces has no number either; empty strings stand between double blanks and are no words
                found = [get(w, 0) for w in words_of(text.as_py()) if w]
                blobs.append(_runs(np.array(found, np.uint32)))
                held += len(blobs[-1])
                if held > 2 * BLOCK:
                    yield _packed(blobs)
                    held, blobs = 0, []
            yield _packed(blobs)

    return texts.mapInArrow(run, "m bigint, ids binary")


def _packed(blobs: list[bytes]) -> pa.RecordBatch:
    data = b"".join(blobs)
    return pa.RecordBatch.from_arrays([pa.array([len(data) // 4], pa.int64()), pa.array([data], pa.binary())], ["m", "ids"])


def _encode_by_join(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The same where the dictionary is large: a row a word, joined by language and word, and put together again in chunks.

    A chunk starts with the numbers that end the one before it, so that windows across its border are whole; windows that
    lie within those first numbers are the earlier chunk's (``skip``), which a 0 cannot stand for: chunks are cut at
    breaks where there is one, and overlap where a piece is longer than a chunk.
    """

    def explode(batches):
        from pyspark import TaskContext

        task, text_no = TaskContext.get().partitionId(), 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary())):
                words = [w for w in words_of(text.as_py()) if w]
                for at in range(0, len(words), 1 << 16):
                    part = words[at : at + (1 << 16)]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int64()), pa.array([text_no] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([lang] * n, pa.string()), pa.array(part, pa.binary())], ["task", "t", "pos", "lang", "word"])
                text_no += 1

    # written, so that a task that runs again cannot number texts in another order
    every = written(texts.mapInArrow(explode, "task bigint, t bigint, pos bigint, lang string, word binary"), "phrase-positions")
    met = every.join(known.select("lang", "word", "id"), ["lang", "word"], "left").select("task", "t", "pos", F.coalesce("id", F.lit(0)).alias("id"))
    over = LONGEST - 1
    own = F.expr(f"pos div {CHUNK}")
    # the first numbers of a chunk also end the chunk before
    both = F.when((F.col("pos") % CHUNK < over) & (F.col("pos") >= CHUNK), F.array(own, own - 1)).otherwise(F.array(own))
    chunks = met.withColumn("c", F.explode(both)).groupBy("task", "t", "c").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("a"))

    def pack(batches):
        for b in batches:
            out = []
            for c, a in zip(b.column("c").to_pylist(), b.column("a")):
                s = a.values
                pos, ids = s.field(0).to_numpy(), s.field(1).to_numpy().astype(np.uint32)
                end = (c + 1) * CHUNK
                out.append((ids.tobytes(), int((pos >= end).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([len(i) // 4 for i, _ in out], pa.int64()), pa.array([i for i, _ in out], pa.binary()), pa.array([k for _, k in out], pa.int32())], ["m", "ids", "tail"])

    return chunks.mapInArrow(pack, "m bigint, ids binary, tail int")


# counting windows


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers, so that ranges of them fill evenly."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def _hash(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` numbers."""
    n = len(ids) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = _mix(h + ids[j : j + n].astype(np.uint64) + np.uint64(1))
    return h


def _radix(columns: list[np.ndarray]) -> np.ndarray:
    """The order of keys by ``columns``, the first counting most: 16 bits at a time from the last, each pass a stable radix sort."""
    order = np.arange(len(columns[0]))
    for c in reversed(columns):
        for shift in range(0, 64, 16):
            digit = ((c >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _run_lengths(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and their added counts."""
    if not len(counts):
        return columns, counts
    order = _radix(columns)
    columns, counts = [c[order] for c in columns], counts[order]
    new = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(np.append(True, new))
    return [c[first] for c in columns], np.add.reduceat(counts, first)


def _pack(ids: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Windows of ``k`` numbers at ``at`` as keys of fixed width: 32 bits a number, two to a column, the first column mixed with the rest."""
    half = [ids[at + j].astype(np.uint64) for j in range(k)] + [np.zeros(len(at), np.uint64)] * (k % 2)
    columns = [(half[j] << np.uint64(32)) | half[j + 1] for j in range(0, len(half), 2)]
    rest = np.zeros(len(at), np.uint64)
    for c in columns[1:]:
        rest = _mix(rest + c)
    return [_mix(columns[0] ^ rest), *columns[1:]]


def _unpack(columns: list[np.ndarray], k: int) -> np.ndarray:
    """The numbers of packed keys, big-endian side by side: 4 * k bytes a key."""
    rest = np.zeros(len(columns[0]), np.uint64)
    for c in columns[1:]:
        rest = _mix(rest + c)
    x = columns[0] * np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    x ^= x >> np.uint64(32)
    x = (x * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))) ^ rest
    out = []
    for c in (x, *columns[1:]):
        out += [c >> np.uint64(32), c & np.uint64(0xFFFFFFFF)]
    return np.stack(out[:k], axis=1).astype(">u4")


def _windows(k: int, ranges_log: int, marks, marked: bool):
    """Windows of ``k`` as blocks ``(range, counts, columns)``: a task's equal keys are one before they move."""

    def blocks(columns, counts):
        part = (columns[0] >> np.uint64(64 - ranges_log)) if ranges_log else np.zeros(len(counts), np.uint64)
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(edges[1:], len(counts))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[edges].astype(np.int64)), pa.array([counts[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary()), pa.array([b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges, ends)], pa.binary())],
            ["part", "counts", "cols"],
        )

    def run(batches):
        bits = np.frombuffer(marks.value, np.uint8) if marked else None
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0
        for b in batches:
            tails = b.column("tail").to_pylist() if "tail" in b.schema.names else [0] * b.num_rows
            for raw, tail in zip(b.column("ids"), tails):
                ids = np.frombuffer(raw.as_py(), np.uint32)
                n = len(ids) - k + 1
                if n <= 0:
                    continue
                fine = reduce(np.logical_and, [ids[j : j + n] > 0 for j in range(k)])
                if tail:  # windows that start in the next chunk are its own
                    fine[len(ids) - tail :] = False
                if marked:
                    h = _hash(ids, k - 1) >> np.uint64(64 - BITS)
                    may = (bits[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1
                    fine &= (may[:-1] & may[1:]).astype(bool)
                at = np.flatnonzero(fine)
                for s in range(0, len(at), BLOCK):
                    columns = _pack(ids, at[s : s + BLOCK], k)
                    held.append((columns, np.ones(len(columns[0]), np.int64)))
                    size += len(columns[0])
                    if size >= BLOCK:
                        held = [_run_lengths([np.concatenate(c) for c in zip(*[x[0] for x in held])], np.concatenate([x[1] for x in held]))]
                        size = len(held[0][1])
                        if size > BLOCK // 2:
                            yield blocks(*held[0])
                            held, size = [], 0
        if size:
            yield blocks(*_run_lengths([np.concatenate(c) for c in zip(*[x[0] for x in held])], np.concatenate([x[1] for x in held])))

    return run


def _counted(k: int, least: int):
    """The keys of a task's ranges that occur ``least`` times, from blocks."""

    def run(batches):
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        size = 0
        merge = lambda: _run_lengths([np.concatenate(c) for c in zip(*[x[0] for x in held])], np.concatenate([x[1] for x in held]))
        enough = RANGE
        for b in batches:
            for counts, cols in zip(b.column("counts"), b.column("cols")):
                n = np.frombuffer(counts.as_py(), np.int64)
                held.append((list(np.frombuffer(cols.as_py(), np.uint64).reshape(-1, len(n))), n))
                size += len(n)
                if size > enough:
                    held = [merge()]
                    size = len(held[0][1])
                    enough = max(RANGE, 2 * size)
        if not held:
            return
        columns, counts = merge()
        often = counts >= least
        keys = _unpack([c[often] for c in columns], k)
        counts = counts[often]
        for at in range(0, len(counts), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in part], pa.binary()), pa.array(counts[at : at + (1 << 16)])], ["key", "f"])

    return run


def _marks(frequent: DataFrame, k: int):
    """A broadcast table of bits in which every frequent key of length ``k`` is marked, or None if they are too many."""
    if frequent.count() > MARKED:
        return None

    def run(batches):
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("key").to_pylist()), ">u4").astype(np.uint32).reshape(-1, k)
            h = np.zeros(len(ids), np.uint64)
            for j in range(k):
                h = _mix(h + ids[:, j].astype(np.uint64) + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array([(h >> np.uint64(64 - BITS)).astype(np.uint32).tobytes()], pa.binary())], ["at"])

    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for row in frequent.select("key").mapInArrow(run, "at binary").toLocalIterator():
        at = np.frombuffer(row["at"], np.uint32)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return frequent.sparkSession.sparkContext.broadcast(bits.tobytes())


def phrase_counts(spark: SparkSession, runs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = RANGE) -> DataFrame:
    """``(k, key, f)`` of all windows of 2 to ``longest`` numbers that occur ``least`` times; ``key`` holds four bytes a number."""
    total = runs.agg(F.sum("m")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block))
    ranges_log = min(20, (4 * tasks - 1).bit_length())
    out, marks = None, None
    for k in range(2, longest + 1):
        blocks = runs.mapInArrow(_windows(k, ranges_log, marks, marks is not None), "part bigint, counts binary, cols binary")
        with bounded(spark, 64):  # a row is a megabyte
            found = written(blocks.repartition(tasks, "part").mapInArrow(_counted(k, least), "key binary, f bigint"), f"phrases-{k}")
        marks = _marks(found, k)
        found = found.select(F.lit(k).alias("k"), "key", "f")
        out = found if out is None else out.unionByName(found)
    return out


# scores


def score(counts: DataFrame, known: DataFrame, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """Each language's first ``top`` phrases by score, from the counts of phrases and words.

    A candidate inside a longer one that occurs as often is dropped: it is then also inside one that is longer by a single
    word, a beginning or an end of which it is, so those two parts of each candidate are all that need be asked for.
    """
    single = known.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("part"), F.col("f").alias("pf"), "lang", "n")
    parts = written(counts.where(F.col("k") < longest).select(F.col("key").alias("part"), F.col("f").alias("pf"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("bigint").alias("n")).unionByName(single), "phrase-parts")
    some = lambda at, n: F.expr(f"substring(key, {at}, {n})")
    longer = counts.where("k > 2").select("f", F.explode(F.array(some("1", "4 * k - 4"), some("5", "4 * k - 4"))).alias("key")).groupBy("key").agg(F.max("f").alias("longer"))
    # the aggregates are written before they are joined, so that a join may split what is common
    kept = counts.join(written(longer, "phrases-longer"), "key", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).select("k", "key", F.col("f").alias("a"))
    cuts = written(kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("key", "k", "a", "cut", some("1", "4 * cut").alias("left"), some("4 * cut + 1", "4 * (k - cut)").alias("right")), "phrase-cuts")
    left = parts.select(F.col("part").alias("left"), F.col("pf").alias("l"), "lang", "n")
    right = parts.select(F.col("part").alias("right"), F.col("pf").alias("r"))
    met = written(cuts.join(left, "left").join(right, "right").select("key", "a", "cut", "l", "r", "lang", "n"), "phrase-met")
    # the first cut's beginning is one word, whose row has the language
    one = met.groupBy("key").agg(F.first("a").alias("a"), F.max("lang").alias("lang"), F.max("n").alias("n"), F.collect_list(F.struct("cut", "l", "r")).alias("cuts"))
    big = lambda c: c.cast("decimal(38,0)")
    floor = lambda c: F.call_function("div", big(F.lit(1000)) * F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(17,0)"), c["l"].cast("decimal(19,0)") * c["r"].cast("decimal(19,0)"))
    scored = one.withColumn("best", F.array_min(F.transform("cuts", lambda c: F.struct(floor(c).alias("score"), c["cut"].alias("cut"), c["l"].alias("l"), c["r"].alias("r")))))
    scored = scored.select("lang", "key", "a", "n", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    # ties of the last place are kept until their words are known
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = written(scored.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place"), "phrases-near")
    ids = near.select("key", F.posexplode(F.expr("transform(sequence(1, length(key) div 4), i -> cast(conv(hex(substring(key, 4 * i - 3, 4)), 16, 10) as bigint))")).alias("at", "id"))
    named = ids.join(known.select("id", F.col("word").cast("string").alias("word")), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    final = near.join(named, "key").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")).where(F.col("rank") <= top)
    return final.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, sent_words: int = SENT_WORDS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of a table of texts.

    Null texts are empty, null languages ``und``; rows that repeat count each time; a table without frequent phrases gives
    no rows. Other columns are not looked at. Equal scores rank by count, then by the phrase's bytes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = dictionary(texts, least)
    path = fresh_path(spark, "phrase-runs")
    encode(texts, known, sent_words).write.parquet(path)
    return score(phrase_counts(spark, spark.read.parquet(path), least), known, top)


def op11_collocations(spark, sf_dir):
    """The first phrases of each language of ``documents``."""
    return mine(table(spark, sf_dir, "documents"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
s AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT DISTINCT s.lang, array_to_string(s.w[i:i + j - 1], ' ') AS phrase, s.f FROM s, range(1, 5) a(i), range(2, 5) b(j) WHERE j < s.k AND i + j - 1 <= s.k),
c AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.f >= 100 * s.f)),
x AS (SELECT c.lang, c.phrase, c.f AS a, n.n, cut, l.f AS l, r.f AS r, CAST(1000 AS HUGEINT) * c.f * n.n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM c JOIN n USING (lang), range(1, 5) t(cut), f l, f r
  WHERE cut < c.k AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') AND r.phrase = array_to_string(c.w[cut + 1:], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM y QUALIFY rank <= {TOP}
"""
