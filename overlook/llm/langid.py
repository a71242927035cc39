"""Language identification by language-bitmask n-gram filters.

The filter is one table of ``rows`` positions, each a bitmask of languages: bit-sliced Bloom filters of equal shape, one a
language. An n-gram has ``HASHES`` positions; the AND of their masks holds every language whose filter contains it.
Popcounts by language over a whole text, corrected for each filter's false positives, decide.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlook.llm.common import crc_part, sliced, table
from overlook.plans.shared import cut

N = 3
HASHES = 4
#: An n-gram is in a language's filter if seen MIN_COUNT times there, makes at least MIN_SHARE of the language's n-grams, and
#: has at least SHARE of its highest relative frequency in any language. So a filter holds 1 / MIN_SHARE n-grams at most;
#: ``learn`` takes another share, and 0 keeps all that are seen MIN_COUNT times.
MIN_COUNT, MIN_SHARE = 5, 2e-6
SHARE = 0.3
#: Positions for each n-gram of the largest filter: with four hashes a false positive has a chance of 0.0024 at most. With
#: MIN_SHARE the table has 2 ** 23 positions at most, 64 MB for each word of languages, whatever the corpus.
ROWS_PER_GRAM = 16
#: Code points taken at once, with an overlap of N - 1.
PIECE = 1 << 20
#: Languages in one mask.
BITS = 62


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, a mark (vowel signs and accents belong to words) as it is, or a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0]) if len(low) == 1 else i
        elif unicodedata.category(c)[0] == "M":
            out[i] = i
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(text: str | None):
    """Packed n-grams of a text in arrays: letters and single spaces, no n-gram with a space inside."""
    if not text:
        return
    for at in range(0, len(text), PIECE):
        cp = np.frombuffer((" " * (at == 0) + text[max(0, at - N + 1) : at + PIECE] + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        cp = _letters()[cp]
        keep = np.ones(len(cp), dtype=bool)
        keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
        cp = cp[keep].astype(np.uint64)
        if len(cp) >= N:
            key = (cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:]
            yield key[cp[1:-1] != 32]


def _count_batches(batches):
    """(lang, gram, n): counted over some millions of n-grams at a time."""
    waiting: dict[str, list[np.ndarray]] = {}
    held = 0

    def flush():
        for lang, arrays in waiting.items():
            key, n = np.unique(np.concatenate(arrays), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
        waiting.clear()

    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text")):
            for g in grams(text.as_py()):
                waiting.setdefault(lang.as_py(), []).append(g)
                held += len(g)
            if held > 4_000_000:
                yield from flush()
                held = 0
    yield from flush()


def gram_counts(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all rows with a language."""
    parts = rows.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(sliced(_count_batches), "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(key: np.ndarray, rows: int) -> list[np.ndarray]:
    h = _mixed(key)
    step = _mixed(h) | np.uint64(1)
    return [((h + np.uint64(j) * step) & np.uint64(rows - 1)).astype(np.int64) for j in range(HASHES)]


class Filters:
    """Masks by position, in words of BITS languages; ``false`` is each filter's chance of a false positive."""

    def __init__(self, langs: list[str], table: np.ndarray, coverage: np.ndarray, prior: str):
        self.langs, self.table, self.coverage, self.prior = langs, table, coverage, prior
        set_ = np.array([((table[i // BITS] >> np.uint64(i % BITS)) & np.uint64(1)).mean() for i in range(len(langs))])
        self.false = set_**HASHES

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        total, found = 0, np.zeros(len(self.langs), dtype=np.int64)
        for key in grams(text):
            at = positions(key, self.table.shape[1])
            total += len(key)
            for w in range(len(self.table)):
                mask = self.table[w][at[0]]
                for p in at[1:]:
                    mask &= self.table[w][p]
                for i in range(w * BITS, min(len(self.langs), (w + 1) * BITS)):
                    found[i] += int(((mask >> np.uint64(i % BITS)) & np.uint64(1)).sum())
        return total, found

    def decide(self, text: str | None) -> tuple[str, float]:
        """(language, score): the largest corrected share of the text's n-grams, over the share a language has of its own."""
        if not has_letter(text) or not self.langs:
            return "und", 0.0
        total, found = self.counts(text)
        if not total:
            return self.prior, 0.0
        true = np.maximum(0.0, (found - total * self.false) / np.maximum(1e-9, 1 - self.false)) / total / np.maximum(1e-9, self.coverage)
        best = int(true.argmax())
        return (self.langs[best], float(min(1.0, true[best]))) if true[best] > 0 else (self.prior, 0.0)


def learn(rows: DataFrame, min_share: float = MIN_SHARE) -> Filters:
    """Filters from all ``rows`` (lang, text). Only the filter's positions come to the driver, whose number ``min_share`` bounds.

    At 0 no n-gram goes for being rare in a large corpus, and the table grows with the number of different n-grams instead.
    The table is as large as the largest filter needs. Rows that repeat count each; rows without language or text teach nothing.
    """
    counts = cut(gram_counts(rows))
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r[0]: r[1] for r in by_lang.collect()}  # a row a language
    langs = sorted(totals)
    if not langs:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), "und")
    freq = counts.join(F.broadcast(by_lang), "lang").withColumn("p", F.col("n") / F.col("total"))
    kept = freq.withColumn("top", F.max("p").over(W.partitionBy("gram"))).where((F.col("n") >= MIN_COUNT) & (F.col("p") >= min_share) & (F.col("p") >= F.col("top") * SHARE))
    kept = cut(kept.select("lang", "gram", "p"))
    index = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    coded = kept.select("gram", "p", index.cast("int").alias("i"))
    coverage = {r[0]: r[1] for r in coded.groupBy("i").agg(F.sum("p")).collect()}
    largest = coded.groupBy("i").count().agg(F.max("count")).first()[0] or 0
    size = 1 << max(10, (largest * ROWS_PER_GRAM - 1).bit_length())

    def place(frames):
        for f in frames:
            at = positions(f["gram"].to_numpy().view(np.uint64), size)
            yield pd.DataFrame({"pos": np.concatenate(at), "word": np.tile((f["i"] // BITS).to_numpy(), HASHES), "mask": np.tile(np.left_shift(np.int64(1), (f["i"] % BITS).to_numpy().astype(np.int64)), HASHES)})

    placed = coded.mapInPandas(place, "pos long, word int, mask long").groupBy("word", "pos").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros(((len(langs) + BITS - 1) // BITS, size), dtype=np.uint64)
    masks[placed["word"].to_numpy(dtype=np.int64), placed["pos"].to_numpy(dtype=np.int64)] = placed["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return Filters(langs, masks, np.array([coverage.get(i, 0.0) for i in range(len(langs))]), max(langs, key=lambda x: totals[x]))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` columns other than text, with ``lang_pred`` and ``score`` (replaced, if they are there).

    ``und`` where a text is null or has no letter, or if nothing was learned; of languages that tie the first by name; where
    no n-gram is known, the language of most n-grams. Whole texts are read, in pieces; each row is predicted by itself, so repeated rows
    get equal results and an empty table none.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            got = [shared.value.decide(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*others, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(sliced(run), f"{schema + ', ' if schema else ''}lang_pred string, score double")


def op2_langid(spark, sf_dir):
    """Language of every text of ``documents``; a null doc_id is never learned from and counts as not held out."""
    docs = table(spark, sf_dir, "documents")
    part = crc_part("doc_id", 4)
    filters = learn(docs.where(part != 2).select("lang", "text"))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part == 2, F.lit(False)).alias("held_out"), "text"), filters)
