"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut in ``SEGMENTS`` ring segments. If two fingerprints differ in at most ``tau`` bits, some start
has a chain of segments whose differences stay within ``floor(l * tau / SEGMENTS)`` for every length l. The chain's first
segments must then agree exactly, and the next ones in all bits but one, so in one of their halves: both together are the
join key. The rest of the chain prunes candidates before the full Hamming check.

Equal fingerprints collapse before anything is joined. Keys that many different fingerprints share are not joined
pairwise: their fingerprints get finer keys, three of six parts each, since three bits leave three parts as they are. What
still shares a key with many others meets in every point up to two bits away, and each links to the smallest fingerprint
within one bit of that point. Any two that differ in three bits meet in such a point, so no link between components is
lost, and a point has 2081 neighbours at most, whatever the group.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from overlook.llm.common import bounded, sliced, table
from overlook.operators.graph import connected_components
from overlook.plans.shared import written

TAU = 3
SEGMENTS = 8
SEED = 42
#: Different fingerprints with one key up to which they are joined pairwise; larger groups meet in points.
PAIRWISE = 32
#: The same for finer keys: with more, a fingerprint's 20 keys have more pairs than it has points.
PAIRWISE_FINE = 200
#: Shingles hashed at once.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int, seed: int = SEED):
    """XXH64 of each shingle, repeats included, in arrays of at most CHUNK; A-Z are lower-cased, words end at ASCII space.

    Fewer words than ``size``: the whole sequence is one shingle; no word: nothing.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n = max(1, len(words) - size + 1)
    size = min(size, len(words))
    h = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        yield np.array([h(joined[s : e - 1], seed) for s, e in zip(starts[at : min(n, at + CHUNK)], ends[at + size - 1 :])], dtype=np.uint64)


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    """For each of the 64 bits, highest first, how many hashes have it."""
    total = np.zeros(64, dtype=np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 255):  # 255 ones fit in a byte
        total += np.add.reduce(np.unpackbits(raw[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number: a bit is 1 if over half the shingle hashes have it."""
    n, total = 0, np.zeros(64, dtype=np.int64)
    for h in shingle_hashes(text, size, seed):
        n += len(h)
        total += bit_totals(h)
    return int(np.packbits(total * 2 > n).view(">i8")[0]) if n else 0


def _fingerprints(size: int, seed: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), size, seed) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 3, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)`` for each row; null, empty and blank texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced(_fingerprints(size, seed)), "doc_id long, fp long")


def _rotated(x: Column, bits: int) -> Column:
    return x if not bits else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _budgets(tau: int, segments: int) -> list[int]:
    return [length * tau // segments for length in range(segments + 1)]


def ring_keys(fp: Column, tau: int = TAU, segments: int = SEGMENTS) -> Column:
    """The keys of a fingerprint: for each start and each half, the exact segments and that half of the one-off segments."""
    width, budgets = 64 // segments, _budgets(tau, segments)
    exact = max(n for n, b in enumerate(budgets) if b == 0) * width
    rest = (max(n for n, b in enumerate(budgets) if b <= 1) * width - exact) // 2
    keys = []
    for i in range(segments):
        turned = _rotated(fp, i * width)
        head = F.shiftrightunsigned(turned, 64 - exact) if exact else F.lit(0).cast("long")
        for half in (0, 1):
            part = F.shiftrightunsigned(turned, 64 - exact - rest * (half + 1)).bitwiseAND(F.lit((1 << rest) - 1))
            keys.append(F.shiftleft(head, rest + 8).bitwiseOR(F.shiftleft(part, 8)).bitwiseOR(F.lit(2 * i + half)))
    return F.array(*keys)


def chain_within(x: Column, key: Column, tau: int = TAU, segments: int = SEGMENTS) -> Column:
    """Whether the chain that starts where ``key`` says stays within budget at each length; x: the bits that differ."""
    width, budgets = 64 // segments, _budgets(tau, segments)
    start = F.shiftrightunsigned(key.bitwiseAND(F.lit(255)), 1).cast("int") * width
    turned = F.when(start == 0, x).otherwise(F.call_function("shiftleft", x, start).bitwiseOR(F.call_function("shiftrightunsigned", x, F.lit(64) - start)))
    ok = F.lit(True)
    for n in range(1, segments):  # only where the next budget is larger can a shorter chain say more
        if budgets[n + 1] > budgets[n]:
            ok = ok & (F.bit_count(F.shiftrightunsigned(turned, 64 - n * width)) <= budgets[n])
    return ok


def fine_keys(fp: Column, tau: int = TAU) -> Column:
    """The keys of a fingerprint in a crowd: of 2 * tau parts, each choice of tau; within tau bits one choice agrees."""
    parts = 2 * tau
    edges = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(parts), tau)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        keys.append(F.struct(F.lit(n).cast("short").alias("i"), fp.bitwiseAND(F.lit(_signed(mask))).alias("part")))
    return F.array(*keys)


def _shared(keyed: DataFrame, name: str) -> DataFrame:
    """``keyed`` (fp, k) with ``n``, the fingerprints of each key, where it is over 1."""
    # written first, so that adaptive execution may split the join of a key that very many share
    shared = written(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-keys")
    return written(keyed.join(shared, "k"), name)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, tau: int = TAU, segments: int = SEGMENTS, pairwise: int | None = None, pairwise_fine: int | None = None) -> DataFrame:
    """Links ``(u, v)`` among distinct ``fp``: all of them under keys of few, enough to keep components whole elsewhere."""
    pairwise, pairwise_fine = pairwise or PAIRWISE, pairwise_fine or PAIRWISE_FINE
    if tau != 3:
        pairwise = 1 << 62  # the points below are for three bits; other thresholds join pairwise throughout
    shared = _shared(fps.select("fp", F.explode(ring_keys(F.col("fp"), tau, segments)).alias("k")), "simhash-keys")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= tau)
    few = shared.where(F.col("n") <= pairwise)
    pairs = few.alias("a").join(few.alias("b"), near & chain_within(x, F.col("a.k"), tau, segments)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if tau != 3:
        return pairs
    crowd = shared.where(F.col("n") > pairwise).select("fp").distinct()
    fine = _shared(crowd.select("fp", F.explode(fine_keys(F.col("fp"), tau)).alias("k")), "simhash-fine")
    some = fine.where(F.col("n") <= pairwise_fine)
    pairs = pairs.union(some.alias("a").join(some.alias("b"), near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")))
    many = fine.where(F.col("n") > pairwise_fine).select("fp").distinct()
    one = [0, *(1 << i for i in range(64))]
    first = many.select("fp", F.explode(F.lit([_signed(m) for m in one])).alias("m"))
    # a second bit below the first one: each pair of bits comes once; the shuffle deals the fan-out evenly
    second = F.filter(F.lit([_signed(m) for m in one]), lambda y: (y == 0) | ((F.col("m") != 0) & (y > 0) & ((F.col("m") < 0) | (y < F.col("m")))))
    points = first.repartition(F.col("fp"), F.col("m")).select("fp", "m", F.explode(second).alias("m2"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("m")).bitwiseXOR(F.col("m2")).alias("p"), ((F.col("m") == 0) | (F.col("m2") == 0)).alias("close"))
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(W.partitionBy("p"))
    met = points.withColumn("hub", hub).where("hub IS NOT NULL AND hub <> fp").select(F.col("hub").alias("u"), F.col("fp").alias("v")).distinct()
    return pairs.union(met)


def components(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """``prints`` (doc_id, fp) with ``component_id``, the smallest doc_id reachable through links of up to ``tau`` bits.

    Null doc_ids take part in links, but are never a component's name unless it has no other.
    """
    by_fp = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = connected_components(links(by_fp.select("fp"), tau))
    named = by_fp.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "simhash-named")
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    return prints.join(named.join(least, "component").select("fp", "component_id"), "fp")


def op4_simhash(spark, sf_dir):
    """Fingerprints and components of ``documents``, three-word shingles, three bits."""
    with bounded(spark):
        prints = written(fingerprints(table(spark, sf_dir, "documents")), "simhash-prints")
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
