"""Toxicity: noisy-channel deobfuscation, then a scored text.

Texts are read in compatibility form (full-width and styled letters as plain ones), without stray accents and invisible
characters. Words that look obfuscated (digits, signs, masks or letters of another script among letters, letters set apart,
letters repeated) become a lattice of what each character may stand for. A character trigram model, counted over the corpus, finds the likeliest path by Viterbi.
The restored words, beside the words as they stand, are evidence: whole words, and how many different words with one
beginning stand in a text. Evidence that labels bear out is weighed by logistic regression, and its log-odds add up.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.llm.common import bounded, crc_part, sliced, table
from overlook.plans.shared import cut, written

THRESHOLD = 0.7
#: Labelled rows that the weights are fitted on at most, drawn by hash of the id.
FIT_ROWS = 20_000
#: Evidence counts if it stands in MIN_TOXIC toxic texts at least, in toxic ones in PURITY of its texts, and if its excess
#: over the share of toxic texts would come by chance in fewer than CHANCE of all features as frequent as it.
MIN_TOXIC = 3
PURITY = 0.6
CHANCE = 0.1
#: Pull of the weights towards zero.
RIDGE = 0.05
PREFIXES = (3, 4, 5, 6, 7)
#: Different words with one beginning, counted up to.
COUNTED = 4
#: Characters of a stretch of letters set apart that are read at once, and their overlap.
STRETCH, OVERLAP = 80, 24
#: What a sign may stand for, fixed.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Letters of other scripts by the Latin ones that they look like, fixed.
ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
#: Invisible characters (ignorable by default) and accents that compose with no letter.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0]")
ACCENTS = re.compile("[\u0300-\u036f\u20d0-\u20f0]+")
#: What stands for a letter that is not shown.
MASKS = re.compile("[*•●█]")
GAPS = ".-_*~'·,:;/\\ #"
SIGN_COST, SAME_COST, GAP_COST, DROP_COST, BREAK_COST, ALIKE_COST, MASK_COST = 0.7, 6.0, 0.1, 0.5, 0.4, 0.5, 2.0
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|])(?:[\s.\-_*~·]++(?:[^\W_]|[@$!|])){2,}(?![^\W_])")
SPACE, WIDE = re.compile(r"\s"), re.compile(r"([ .\-_*~·]{2})[ .\-_*~·]+")
TWICE, TRIPLE, SIGN_TWICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1"), re.compile(r"([0-9@$!|+(€£¡])\1+")
#: Share of a word's letters that stand twice from which the word is read with each of them once.
DOUBLED = 0.75
LETTERS, SAME = re.compile(r"([^\W\d_])\1{3,}"), re.compile(r"(.)\1{3,}")
#: Characters of a word up to which its reading is remembered.
LONG = 80
WORD = re.compile(r"[^\W\d_]+")
ENDS = ".,;:!?\"'()[]{}<>*#%&$-_~|/\\"
#: Signs that stand for letters may open or close a word.
BARE, MASKED = ".,;:?\"'()[]{}<>*#%&-_~/", ".,;:?\"'()[]{}<>*#%&-_~/\\"
SYMBOLS = 64
#: Letters of a word that is looked for inside letters set apart, where words have no ends.
SURE = 5


@functools.cache
def _codes() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1 to 26 for a to z, others share the rest."""
    out = np.zeros(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + low % 36
    out[48:58] = 63
    return out


def code(c: str) -> int:
    return int(_codes()[ord(c)])


def _trigram_batches(batches):
    total = np.zeros(SYMBOLS**3, dtype=np.int64)
    for b in batches:
        for t in b.column(0):
            text = t.as_py()
            for at in range(0, len(text or ""), 1 << 20):
                cp = np.frombuffer(("  " * (at == 0) + text[max(0, at - 2) : at + (1 << 20)] + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                s = _codes()[cp]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def character_model(texts: DataFrame) -> np.ndarray:
    """log P(c | a, b), counted over all ``texts``; the driver gets 64 ** 3 counts at most."""
    with bounded(texts.sparkSession):
        got = texts.select("text").mapInArrow(sliced(_trigram_batches), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(SYMBOLS**3)
    for r in got:
        n[r[0]] = r[1]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 0.1) / (one.sum() + 0.1 * SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * p2) / (n.sum(2, keepdims=True) + 5))


def options(word: str, i: int, spaced: bool = False) -> list[tuple[str, float]]:
    """What character ``i`` may stand for, with costs; the empty string drops it. Among spaced letters a gap may end a word."""
    c = word[i]
    run = i and word[i - 1] == c and (word[i + 1 : i + 2] == c or word[i - 2 : i - 1] == c)  # of three at least
    if c.isalpha():
        out = [(c, 0.0)] + [(x, ALIKE_COST) for x in ALIKE.get(c, "")]
        return [*out, ("", DROP_COST)] if run else out
    out = [(x, SIGN_COST) for x in SIGNS.get(c, "")]
    if MASKS.match(c) and not spaced and 0 < i < len(word) - 1:
        out += [(x, MASK_COST) for x in "abcdefghijklmnopqrstuvwxyz"]
    if c in GAPS or c in ENDS:
        out.append(("", GAP_COST))
        if spaced:
            out.append((" ", BREAK_COST))
    elif run:
        out.append(("", DROP_COST))
    return out or [(c, SAME_COST)]


def restore(word: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest reading of an obfuscated word: Viterbi over pairs of last symbols. Spaced letters may be several words."""
    beams = {(0, 0): (0.0, None)}  # paths are chains from the last character back, so that long words take linear time
    for i in range(len(word)):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in beams.items():
            for c, extra in options(word, i, spaced):
                s = code(c) if c else 0
                state, value = ((b, s), cost + extra - model[a, b, s]) if c else ((a, b), cost + extra)
                if state not in step or value < step[state][0]:
                    step[state] = (value, (path, c) if c else path)
        beams = step
    return min((cost - model[a, b, 0], _spelled(path)) for (a, b), (cost, path) in beams.items())[1]


def _spelled(path: tuple | None) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def plain(text: str) -> str:
    """A text in lower case and compatibility form, without accents that compose with no letter."""
    return text.lower() if text.isascii() else ACCENTS.sub("", unicodedata.normalize("NFKC", text).lower())


def alike(word: str) -> bool:
    """Whether a word mixes Latin letters with ones that look like them, or has only such letters."""
    return any(c in ALIKE for c in word) and all(c in ALIKE or c.isascii() for c in word)


def doubled(word: str) -> bool:
    """Whether most letters of a word stand twice, as no word is spelled."""
    return 2 * len(TWICE.findall(word)) >= DOUBLED * len(word)


@functools.lru_cache(maxsize=10_000)
def mask(word: str) -> re.Pattern | None:
    """Pattern of the words that a word with masked letters may stand for; at least half of its letters must be shown."""
    hidden = len(MASKS.findall(word))
    if not hidden or len(word) < 4 or 2 * hidden > len(word):
        return None
    return re.compile("".join(r"[^\W\d_]" if MASKS.match(c) else f"[{re.escape(c + SIGNS.get(c, '') + ALIKE.get(c, ''))}]" for c in word))


def hinted(clues: set[str], known: tuple[str, ...]) -> set[str]:
    """The ``known`` words that clues hold: masked words that they fit, or letters set apart in which those of SURE letters stand."""
    out: set[str] = set()
    for c in clues:
        fits = mask(c)
        out.update(w for w in known if (len(w) == len(c) and fits.fullmatch(w) if fits else len(w) >= SURE and w in c))
    return out


class Restorer:
    """All words of a text: as they stand and, where they look obfuscated, restored. Remembers some words."""

    def __init__(self, model: np.ndarray):
        self.short = functools.lru_cache(maxsize=50_000)(lambda w: restore(w, model))
        self.long = lambda w: restore(w, model)  # not remembered
        self.spaced = lambda w: restore(w, model, True)

    def one(self, word: str) -> str:
        """The reading of a whole word of any length; of more than three equal letters (in long words, characters) three are read."""
        word = (LETTERS if len(word) <= LONG else SAME).sub(r"\1\1\1", word)
        return self.short(word) if len(word) <= LONG else self.long(word)

    def read(self, text: str | None) -> tuple[set[str], set[str]]:
        """The words of a text, and clues to others: masked words and letters set apart (see ``hinted``)."""
        low = plain(text or "")
        out: set[str] = set()
        clues: set[str] = set()
        if INVISIBLE.search(low):  # such characters may part words or stand inside them
            out.update(w for t in low.split() if INVISIBLE.search(t) for w in WORD.findall(t))
            low = INVISIBLE.sub("", low)
        for token in set(low.split()):
            core = token.strip(ENDS)
            if core.isalpha():
                out.add(core)
                if TWICE.search(core):
                    if TRIPLE.search(core):
                        out.add(self.one(core))
                    elif doubled(core):
                        out.add(self.one(TWICE.sub(r"\1\1\1", core)))  # in runs of three each letter may go
                if not core.isascii() and alike(core):
                    out.add(self.one(core))
                if core == token:
                    continue
            elif core:
                out.update(WORD.findall(core))
            bare = token.strip(BARE)
            if bare.isalpha():
                continue
            if len(bare) > 2 and sum(c.isalpha() or c in SIGNS for c in bare) > 2 and any(c.isalpha() for c in bare):
                out.add(self.one(bare))
                if SIGN_TWICE.search(bare):
                    out.add(self.one(SIGN_TWICE.sub(r"\1", bare)))
            if MASKS.search(bare) and mask(bare := token.strip(MASKED)):
                out.add(self.one(bare))
                clues.add(bare)
        for m in SPACED.finditer(low):
            if not any(c.isalpha() for c in m[0]):
                continue
            apart = WIDE.sub(r"\1", SPACE.sub(" ", m[0]))
            for at in range(0, max(1, len(apart) - OVERLAP), STRETCH - OVERLAP):
                joined = self.one(apart[at : at + STRETCH])
                out.update(joined[i:] for i in range(len(joined)))  # read as one word, its beginning unknown
                clues.add(joined)
                out.update(w for w in self.spaced(apart[at : at + STRETCH]).split() if w.isalpha())  # and as a sentence
        return out, clues

    def words(self, text: str | None, known: tuple[str, ...] = ()) -> set[str]:
        """The words of a text, and those of ``known`` that its clues hold."""
        out, clues = self.read(text)
        return out | hinted(clues, known)


def features(words: set[str]) -> set[str]:
    """``word$`` of each word, and ``beginning@n`` where at least n different words begin so."""
    begin = Counter(w[:n] for w in words for n in PREFIXES if len(w) >= n)
    out = {f"{w}$" for w in words}
    out.update(f"{b}@{i}" for b, n in begin.items() for i in range(1, min(n, COUNTED) + 1))
    return out


def log_tail(k: int, n: int, p: float) -> float:
    """Chernoff's bound on the log of the chance that k or more of n come at a rate of p."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def borne_out(counts: list[tuple[str, int, int]], as_frequent: dict[int, int], toxic_share: float) -> list[str]:
    """Features (name, toxic, clean) whose excess of toxic texts is no chance among all features of their number of texts."""
    p = min(0.999, max(1e-6, toxic_share))
    return [f for f, k, c in counts if k >= PURITY * (k + c) and log_tail(k, k + c, p) + math.log(as_frequent[k + c]) < math.log(CHANCE)]


def weigh(found: list[tuple[int, int, list[str]]], names: list[str], ridge: float = RIDGE, rounds: int = 60) -> tuple[dict[str, float], float]:
    """Logistic regression by Newton's steps on the diagonal: (log-odds of each feature, of none), never below zero for a feature.

    ``found`` has (rows, toxic rows, features) for each different set of features.
    """
    at = {f: i for i, f in enumerate(names)}
    n, k = (np.array([f[i] for f in found], dtype=np.float64) for i in (0, 1))
    row = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
    col = np.array([at[f] for _, _, fs in found for f in fs], dtype=np.int64)
    w, b = np.zeros(len(names)), 0.0
    if not len(found):
        return {}, math.log(0.01)
    for _ in range(rounds):
        z = b + np.bincount(row, w[col], len(found))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gap, curve = k - n * p, n * p * (1 - p)
        b = min(max(b + 0.5 * gap.sum() / (curve.sum() + 1e-6), -12.0), math.log(THRESHOLD / (1 - THRESHOLD)) - 0.05)
        step = (np.bincount(col, gap[row], len(names)) - ridge * w) / (np.bincount(col, curve[row], len(names)) * 2 + ridge)
        w = np.maximum(0.0, w + 0.5 * np.clip(step, -2, 2))
    return dict(zip(names, w)), b


def known_words(names) -> tuple[str, ...]:
    """The words among the names of features."""
    return tuple(sorted(f[:-1] for f in names if f.endswith("$")))


class Scorer:
    """Log-odds of features and of a text without any; the words' restorer is made anew in each worker."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], base: float):
        self.model, self.weights, self.base, self.restorer = model.astype(np.float32), {f: w for f, w in weights.items() if w > 0}, base, None
        self.begins = {f.rpartition("@")[0] for f in self.weights if "@" in f}
        self.known = known_words(self.weights)

    def __getstate__(self):
        return {**self.__dict__, "restorer": None}

    def score(self, text: str | None) -> float:
        """The chance that a text is toxic by the sum of its evidence; without any, the chance of such texts."""
        self.restorer = self.restorer or Restorer(self.model)
        words = self.restorer.words(text, self.known)
        total = self.base + sum(self.weights.get(f"{w}$", 0.0) for w in sorted(words))
        begin = Counter(b for w in words for n in PREFIXES if len(w) >= n and (b := w[:n]) in self.begins)
        total += sum(self.weights.get(f"{b}@{i}", 0.0) for b, n in sorted(begin.items()) for i in range(1, min(n, COUNTED) + 1))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))


def _features_of(restorer_model):
    def run(batches):
        restorer = Restorer(restorer_model.value)
        for b in batches:
            read = [restorer.read(t.as_py()) for t in b.column("text")]
            lists = [pa.array([sorted(x) for x in part], pa.list_(pa.string())) for part in ([features(w) for w, _ in read], [w if c else () for w, c in read], [c for _, c in read])]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), *lists], ["toxic", "f", "w", "c"])

    return run


def _held(names: list[str]):
    """Rows (toxic, f) with those of their features that are among ``names``; clues count as they do in a score."""
    known, wanted = known_words(names), set(names)

    def run(batches):
        for b in batches:
            out = []
            for f, w, c in zip(*(b.column(x).to_pylist() for x in ("f", "w", "c"))):
                more = hinted(set(c), known) - set(w) if c else ()
                out.append(sorted(wanted & (features(set(w) | more) if more else set(f))))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(out, pa.list_(pa.string()))], ["toxic", "f"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """A scorer from labels of rows whose crc32(doc_id) mod 3 is not 1, and characters of all texts.

    ``fit_rows`` labelled ids at most are drawn by hash and broadcast, so that texts are not shuffled; their texts are read
    and restored once. Labels that disagree on a doc_id count as toxic. Rows that repeat an id are examples each. Without a
    label there is no evidence and all texts score alike, below the threshold.
    """
    context = docs.sparkSession.sparkContext
    known = labels.where((crc_part("doc_id", 3) != 1) & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("tx_id")).agg(F.max("toxic").cast("int").alias("tx_toxic"))
    drawn = known.orderBy(F.xxhash64("tx_id", F.lit("fit")), "tx_id").limit(fit_rows)
    texts = docs.select(F.col("doc_id").alias("tx_doc"), "text")
    model = character_model(texts)
    rows = texts.join(F.broadcast(drawn), F.col("tx_doc") == F.col("tx_id")).select(F.col("text"), F.when(F.col("tx_toxic") > 0, 1).otherwise(0).alias("toxic"))
    with bounded(docs.sparkSession):
        read = written(rows.mapInArrow(sliced(_features_of(context.broadcast(model)), 200), "toxic int, f array<string>, w array<string>, c array<string>"), "toxicity-features")
    tally = {r[0]: r[1] for r in read.groupBy("toxic").count().collect()}
    share = tally.get(1, 0) / max(1, sum(tally.values()))
    counts = cut(read.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")))
    as_frequent = {r[0]: r[1] for r in counts.groupBy("n").count().collect()}  # a row for each number of texts, of the drawn ones
    # features that stand in MIN_TOXIC toxic texts of the drawn ones, mostly in toxic ones
    strong = counts.where((F.col("k") >= MIN_TOXIC) & (F.col("k") >= PURITY * F.col("n"))).collect()
    names = sorted(borne_out([(r["f"], r["k"], r["n"] - r["k"]) for r in strong], as_frequent, share))
    with bounded(docs.sparkSession):
        held = read.mapInArrow(sliced(_held(names), 200), "toxic int, f array<string>")
        found = held.groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()  # at most a row for each drawn text
    weights, base = weigh([(r["n"], r["k"], r["f"]) for r in found], names)
    return Scorer(model, weights, base)


def score(docs: DataFrame, scorer: Scorer, column: str = "score") -> DataFrame:
    """``docs`` with ``column`` added (replaced, if it is there): the toxicity of each whole text, 0 to 1.

    Null and empty texts get the chance of texts without evidence; rows that repeat get equal scores; an empty table stays empty.
    A text of any length is read in one piece, letters set apart in it in stretches that overlap.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    plain = docs.drop(column)

    def run(batches):
        for b in batches:
            got = [shared.value.score(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(sliced(run), f"{schema}, `{column}` double")


def op8_toxicity(spark, sf_dir):
    """Toxicity of every text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    scorer = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scorer)
    return out.select("doc_id", F.coalesce(crc_part("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
