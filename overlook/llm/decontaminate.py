"""Benchmark decontamination by template: placeholders for names, numbers and units, hashed windows, slot consistency.

Only DataFrame operations. A text is canonicalised (runs of names, numbers, and units after a number become one
placeholder each), split into words, and every window of ``WINDOW`` words is hashed, in one scan. Windows meet
the benchmark's in a hash join; where enough of an item's windows are found in a document, slot values are compared: an
item value must stand for one document value throughout an occurrence. That also catches questions whose numbers or names
were changed. A document may hold an item in several versions, so each occurrence is judged by itself, and one that fits
is enough. What counts as a name hangs on the word alone, so an item reads the same wherever it stands; an item is also
indexed in lower case, for copies that lost their capitals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overlook.llm.common import free_names, table
from overlook.plans.shared import cut

WINDOW = 8
#: An item leaks if at least this share of its windows is found, and MIN_WINDOWS of them (all, if it has fewer).
COVERAGE = 0.3
MIN_WINDOWS = 5
#: Words that an item must have to be looked for at all: shorter ones stand in too many texts.
MIN_WORDS = 3
#: Benchmark windows (16 bytes each) up to which they are broadcast; beyond, windows are shuffled by hash.
BROADCAST_WINDOWS = 1_000_000
#: Documents with hits (16 bytes each) up to which their keys are broadcast; beyond, texts are shuffled by key.
BROADCAST_DOCS = 500_000

NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Words that are no names though a sentence may begin with them. Fixed values.
PLAIN = (
    "The This That These Those There Then Than And But Or Nor So Yet For If In Into On At By To Of From With Without About After Before Between Through "
    "During Under Over Up Down Out As Is Are Was Were Be Been Has Have Had Do Does Did Can Could Will Would Shall Should May Might Must Not No Yes "
    "He She It We You They His Her Its Our Your Their My Me Him Us Them Who Whom Whose Which What When Where Why How All Any Each Every Some Both "
    "Few Many Much More Most Other Another Such Only Own Same Too Very Just Also Now Here One Two Let Find Given Suppose Name Calculate Compute Determine"
)
_EDGE = r"(?![\p{L}\p{N}])"
_ONE = rf"(?!(?:{PLAIN.replace(' ', '|')}){_EDGE})\p{{Lu}}\p{{Ll}}++{_EDGE}"
# possessive: a repeated group that may give back recurses once a repeat, so long runs would overflow the stack of a task
NAMES = rf"(?<![\p{{L}}\p{{N}}]){_ONE}(?: {_ONE})*+"
NUMBERS = r"\p{Nd}++(?:[.,:/]\p{Nd}++)*+"
UNITS = rf"{NUMBER} {{1,2}}(km|kg|cm|mm|ml|mi|ft|m|g|l|lbs?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|met(?:er|re)s?|grams?|lit(?:er|re)s?|dollars?|euros?|percent|%|€|°C|°F){_EDGE}"
BREAKS = rf"[^\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}]+"


def _stages(text: Column) -> tuple[Column, Column, Column]:
    """The text with names, then numbers, then units replaced."""
    named = F.regexp_replace(text, NAMES, NAME)
    numbered = F.regexp_replace(named, NUMBERS, f" {NUMBER} ")
    return named, numbered, F.regexp_replace(numbered, UNITS, f"{NUMBER} {UNIT} ")


def canonical(text: Column) -> Column:
    """The text in lower case with placeholders. Placeholder characters of the text itself count as breaks."""
    return F.lower(_stages(F.translate(text, NAME + NUMBER + UNIT, "   "))[2])


def template_words(text: Column) -> Column:
    return F.filter(F.split(canonical(text), BREAKS, -1), lambda x: x != "")


def slot_rows(rows: DataFrame, keys: list[str], text: str, position: str, value: str) -> DataFrame:
    """``(*keys, position, value)``: what each placeholder of a text stands for, by the position of its word."""
    plain = F.translate(F.col(text), NAME + NUMBER + UNIT, "   ")
    named, numbered, _ = _stages(plain)
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"[\s]", ""))
    found = {NAME: (plain, NAMES, 0), NUMBER: (named, NUMBERS, 0), UNIT: (numbered, UNITS, 1)}
    got = rows.select(*keys, template_words(F.col(text)).alias("sr_words"), *[F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(g)), squeeze).alias(f"sr_{i}") for i, (c, p, g) in enumerate(found.values())])
    at = lambda kind: F.filter(F.transform("sr_words", lambda w, i: F.when(w == kind, i)), lambda i: i.isNotNull())
    valued = lambda i: lambda z: F.struct(z["p"].alias("p"), F.concat(F.lit(f"{i}:"), z["v"]).alias("v"))
    zipped = [F.transform(F.arrays_zip(at(kind).alias("p"), F.col(f"sr_{i}").alias("v")), valued(i)) for i, kind in enumerate(found)]
    return got.select(*keys, F.explode(F.concat(*zipped)).alias("sr")).select(*keys, F.col("sr.p").alias(position), F.col("sr.v").alias(value)).where(F.col(position).isNotNull())


def window_hashes(hashes: str, size: int) -> Column:
    """Hashes of all runs of ``size`` word hashes in a column; none if there are fewer."""
    last = F.size(hashes) - size
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(size)]))


def item_readings(benchmark: DataFrame, item: str = "item_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(bm_item, bm_read, bm_text, bm_words)``: an item as it stands and, if that differs, in lower case."""
    texts = F.array(F.struct(F.lit(0).alias("bm_read"), F.col(text).alias("bm_text")), F.struct(F.lit(1).alias("bm_read"), F.lower(F.col(text)).alias("bm_text")))
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).alias("bm_item"), template_words(F.col(text)).alias("bm_plain"), F.explode(texts).alias("r")).select("bm_item", "bm_plain", "r.*")
    rows = rows.withColumn("bm_words", template_words(F.col("bm_text")))
    return rows.where((F.size("bm_words") >= min_words) & ((F.col("bm_read") == 0) | (F.col("bm_words") != F.col("bm_plain")))).drop("bm_plain").dropDuplicates(["bm_item", "bm_read", "bm_text"])


def benchmark_windows(readings: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(bm_item, bm_read, bm_length, bm_windows, bm_typed, bm_size, bm_pos, bm_hash)`` of each reading; an item shorter than ``window`` is one window of its length.

    ``bm_typed`` says whether the reading has a placeholder at all.
    """
    typed = F.exists("bm_words", lambda w: w.isin(NAME, NUMBER, UNIT))
    length = F.size("bm_words")
    rows = readings.select("bm_item", "bm_read", length.alias("bm_length"), F.greatest(length - window + 1, F.lit(1)).alias("bm_windows"), typed.alias("bm_typed"), F.least(length, F.lit(window)).alias("bm_size"), F.transform("bm_words", lambda w: F.xxhash64(w)).alias("bm_h"))
    every = F.coalesce(*[F.when(F.col("bm_size") == s, window_hashes("bm_h", s)) for s in range(1, window + 1)])
    return rows.select("bm_item", "bm_read", "bm_length", "bm_windows", "bm_typed", "bm_size", F.posexplode(every).alias("bm_pos", "bm_hash"))


def _places(shift: Column, words: Column) -> Column:
    """The places that a hit is judged in; ``shift`` is its position in the document less that in the item.

    An unchanged occurrence has one shift. In one with words added or left out shifts lie close together, while those of
    two whole occurrences are ``words`` apart at least: strips of that width, laid twice with half a width between, hold
    each occurrence whose shifts differ by half its length at most, and never two whole ones. Last, the whole document,
    for an item that is spread over it.
    """
    strip = lambda kind, at: F.struct(F.lit(kind).alias("kind"), F.floor(at).cast("long").alias("at"))
    return F.array(strip(0, shift), strip(1, shift / words), strip(2, shift / words + 0.5), strip(3, F.lit(0)))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, min_windows: int = MIN_WINDOWS, min_words: int = MIN_WORDS,
    broadcast_windows: int = BROADCAST_WINDOWS, broadcast_docs: int = BROADCAST_DOCS,
) -> DataFrame:
    """``(doc_id, doc_hash, item_id, windows, item_windows, slots, kind)``: the items that leak into each document.

    ``doc_hash`` is xxhash64 of the text, so that rows which repeat a doc_id with another text stay apart; equal rows
    give one result. ``windows``, ``slots`` and ``kind`` are those of the occurrence with most
    windows: ``exact`` if all its slot values agree (where that ties, any that does), else ``reparameterised``. Null or empty texts match nothing, as do items of fewer than ``min_words``
    words; a null doc_id is a document like any other. An empty benchmark or table gives no rows. An item counts once for
    each document, however often it is repeated in it; of items that repeat an id each text is looked for. Only
    ``doc_id`` and ``text``, ``item_id`` and ``text`` are read, so other columns may have any name.
    """
    readings = cut(item_readings(benchmark, min_words=min_words))
    bench = cut(benchmark_windows(readings, window=window))
    sizes = sorted(r[0] for r in bench.select("bm_size").distinct().collect())  # at most `window` numbers
    probe = bench.select("bm_hash").distinct()
    small = probe.count() <= broadcast_windows
    held = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    ids = docs.select(F.col("doc_id").alias("dc_id"), F.col("text").alias("dc_text")).where("dc_text IS NOT NULL")
    keys = ["dc_id", "dc_hash"]
    hashed = ids.select("dc_id", F.xxhash64("dc_text").alias("dc_hash"), F.transform(template_words(F.col("dc_text")), lambda w: F.xxhash64(w)).alias("dc_h"))
    if len(sizes) == 1:
        windows = hashed.select(*keys, F.lit(sizes[0]).alias("dc_size"), F.posexplode(window_hashes("dc_h", sizes[0])).alias("dc_pos", "bm_hash"))
    else:  # all sizes in one scan
        sized = lambda s: lambda h, i: F.struct(F.lit(s).alias("dc_size"), i.alias("dc_pos"), h.alias("bm_hash"))
        every = [F.transform(window_hashes("dc_h", s), sized(s)) for s in sizes] or [F.array().cast("array<struct<dc_size:int,dc_pos:int,bm_hash:bigint>>")]
        windows = hashed.select(*keys, F.explode(F.concat(*every)).alias("w")).select(*keys, "w.*")
    hits = cut(windows.join(held(probe), "bm_hash", "left_semi"))
    met = hits.join(held(bench), (hits["bm_hash"] == bench["bm_hash"]) & (F.col("dc_size") == F.col("bm_size"))).drop("bm_hash", "dc_size")
    need = F.greatest(F.least(F.lit(min_windows), F.col("item_windows")), F.ceil(F.col("item_windows") * F.lit(float(coverage))))
    by = [*keys, "bm_item", "bm_read", "bm_length", "bm_windows", "bm_size"]  # readings of one id with two texts differ in length, or share a fate
    found = cut(met.groupBy(*by).agg(F.count_distinct("bm_pos").alias("windows"), F.max("bm_typed").alias("typed")).withColumn("item_windows", F.col("bm_windows")).where(F.col("windows") >= need))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # slot values are read only from documents and items that met
    few = cut(found.where("typed").select(*keys).distinct().toDF("fk_id", "fk_hash"))
    few = F.broadcast(few) if few.count() <= broadcast_docs else few
    texts = ids.withColumn("dc_hash", F.xxhash64("dc_text")).join(few, same("dc_id", "fk_id") & same("dc_hash", "fk_hash"), "left_semi").dropDuplicates(keys)
    doc_slots = cut(slot_rows(texts, keys, "dc_text", "d_pos", "d_value").withColumnsRenamed({"dc_id": "sk_id", "dc_hash": "sk_hash"}))
    item_slots = slot_rows(readings.withColumn("bm_length", F.size("bm_words")), ["bm_item", "bm_read", "bm_length"], "bm_text", "i_pos", "i_value").distinct().toDF("ik_item", "ik_read", "ik_length", "i_pos", "i_value")
    candidates = found.where("typed").select(*[F.col(c).alias(f"pk_{c}") for c in by])
    placed = cut(met.where("bm_typed").join(candidates, [same(c, f"pk_{c}") for c in by], "left_semi").withColumn("shift", F.col("dc_pos") - F.col("bm_pos")))
    of = [*by, "shift"]
    none = lambda kind: F.lit(None).cast(kind)
    covers = placed.select(*of, "bm_pos", none("string").alias("i"), none("string").alias("d")).distinct()
    inside = F.col("i_pos").between(F.col("bm_pos"), F.col("bm_pos") + F.col("bm_size") - 1)
    asked = placed.join(held(item_slots), same("bm_item", "ik_item") & (F.col("bm_read") == F.col("ik_read")) & (F.col("bm_length") == F.col("ik_length")) & inside)
    asked = asked.select(*of, "i_pos", "i_value", (F.col("dc_pos") + F.col("i_pos") - F.col("bm_pos")).alias("at")).distinct()
    valued = asked.join(doc_slots, same("dc_id", "sk_id") & same("dc_hash", "sk_hash") & (F.col("at") == F.col("d_pos")), "left").withColumn("d_value", F.coalesce("d_value", F.lit("")))
    # at an item's ends a run of names may go on into the text around it
    bare = F.substring(F.col("i_value"), 3, 1 << 30)
    spill = (F.col("i_pos") == 0) & F.endswith(F.col("d_value"), bare) | (F.col("i_pos") == F.col("bm_length") - 1) & F.startswith(F.col("d_value"), F.col("i_value"))
    pairs = valued.select(*of, none("int").alias("bm_pos"), F.col("i_value").alias("i"), F.when(spill, F.col("i_value")).otherwise(F.col("d_value")).alias("d")).distinct()
    places = covers.unionByName(pairs).withColumn("place", F.explode(_places(F.col("shift"), F.col("bm_windows") + F.col("bm_size") - 1)))
    judged = places.groupBy(*by, "place").agg(
        F.count_distinct("bm_pos").alias("windows"), F.count_distinct("i", "d").alias("n"), F.count_distinct("i").alias("n_i"), F.count_if(F.col("i") != F.col("d")).alias("changed")
    ).withColumn("item_windows", F.col("bm_windows")).where((F.col("windows") >= need) & (F.col("n") == F.col("n_i")))
    fits = judged.select(*keys, "bm_item", (F.col("changed") == 0).alias("exact"), "windows", "item_windows", "n")
    fits = fits.unionByName(found.where("NOT typed").select(*keys, "bm_item", F.lit(True).alias("exact"), "windows", "item_windows", F.lit(0).cast("long").alias("n")))
    out = fits.groupBy(*keys, "bm_item").agg(F.max(F.struct("windows", "exact", "item_windows", "n")).alias("best"))
    return out.select(
        F.col("dc_id").alias("doc_id"), F.col("dc_hash").alias("doc_hash"), F.col("bm_item").alias("item_id"), F.col("best.windows").cast("long").alias("windows"), F.col("best.item_windows").cast("long").alias("item_windows"),
        F.col("best.n").cast("long").alias("slots"), F.when(F.col("best.exact"), "exact").otherwise("reparameterised").alias("kind"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_docs: int = BROADCAST_DOCS, **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all other rows and all columns stay as they are, null texts too."""
    gone_id, gone_hash = free_names(docs, "gone_id", "gone_hash")
    bad = cut(find_leaks(docs, benchmark, broadcast_docs=broadcast_docs, **options).select(F.col("doc_id").alias(gone_id), F.col("doc_hash").alias(gone_hash)).distinct())
    bad = F.broadcast(bad) if bad.count() <= broadcast_docs else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_hash)) & F.col("text").isNotNull(), "left_anti")


def op5_decontaminate(spark, sf_dir):
    """Benchmark items found in ``documents``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_hash")
