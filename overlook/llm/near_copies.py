"""Near copies by five-word shingles: SimHash, pigeonring filtering, and the exact similarity of what is left.

At a similarity of 0.8, 64-bit fingerprints of distinct shingles differ in ten bits on average, twelve in the shortest
texts, and in up to 28: too many for any segment to agree by force, so no key of segments is selective. Candidates therefore come from MinHash bands, not
from the ring: at 28 bits its chains pass what the full Hamming check passes (README). The Jaccard similarity of whole shingle sets decides.

Texts of equal words collapse first. Texts that share a band are linked to one hub each, and the components of those
links are clusters that hold every candidate pair. A cluster's texts move once, if it is small; a large one is cut in blocks of
a bounded number of shingles, tasks compare two blocks at a time, and each text moves once for each block. A task links a text only to texts that it is not yet
connected to, so it gives a forest, never all pairs; and no pair is skipped that could connect two groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.llm.common import bounded, free_names, sliced
from overlook.llm.simhash import bit_totals, shingle_hashes
from overlook.operators.graph import connected_components
from overlook.plans.shared import written

SIZE = 5
SIMILARITY = 0.8
#: Bands of so many minima each: a pair of similarity 0.8 shares none with a chance of 0.0007.
BANDS, MINIMA = 24, 6
#: Bits that fingerprints of a pair may differ in, on a ring of SEGMENTS. At a similarity of 0.8 a bit differs with a chance
#: of 0.1875 at most (four shingles of five): more than TAU bits differ with a chance of 1e-06.
TAU, SEGMENTS = 28, 8
#: Shingles, and texts, of a block.
BLOCK_SHINGLES, BLOCK_TEXTS = 500_000, 1024

_rng = np.random.default_rng(20)
_TIMES = _rng.integers(1, 1 << 63, BANDS * MINIMA, dtype=np.uint64) | np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def sketch(text: str | None, size: int = SIZE) -> tuple[int, int, np.ndarray, int]:
    """(digest of the words, fingerprint, band keys, distinct shingles) of a whole text; texts without a word are alike.

    Repeated shingles count once, as in the similarity: how often a passage is repeated does not move the fingerprint.
    """
    digest = hashlib.md5(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())).digest()
    minima = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    h = np.unique(np.concatenate([*shingle_hashes(text, size), np.zeros(0, np.uint64)]))
    n, total = len(h), bit_totals(h)
    for at in range(0, n, 1024):
        minima = np.minimum(minima, (h[at : at + 1024] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    keys = np.zeros(BANDS, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for column in minima.reshape(BANDS, MINIMA).T:
        keys = _mixed(keys * np.uint64(31) + column)
    fp = int(np.packbits(total * 2 > n).view(">i8")[0]) if n else 0
    return int.from_bytes(digest[:8], "big", signed=True), fp, keys.view(np.int64), n


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, th, node, fp, bands, n)`` of each row; ``th`` is xxhash64 of the text, ``node`` stands for its words."""
    def run(batches):
        for b in batches:
            got = [sketch(t.as_py(), size) for t in b.column("text")]
            columns = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.int64())), pa.array([g[3] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *columns], ["doc_id", "th", "node", "fp", "bands", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(sliced(run), f"doc_id {kind}, th long, node long, fp long, bands array<long>, n long")


def chain_within(a: int, b: np.ndarray, tau: int = TAU, segments: int = SEGMENTS) -> np.ndarray:
    """Whether some start on the ring keeps every chain's differing bits within its share of ``tau``."""
    bits = np.bitwise_count((np.uint64(a) ^ b).astype(">u8").view(np.uint8).reshape(len(b), 8)).astype(np.int64)
    bits = bits.reshape(len(b), segments, 8 // segments).sum(axis=2) if segments < 8 else bits
    alive = np.ones((len(b), segments), dtype=bool)
    total = np.zeros((len(b), segments), dtype=np.int64)
    for length in range(1, segments + 1):
        total += np.roll(bits, 1 - length, axis=1)
        alive &= total <= length * tau // segments
    return alive.any(axis=1)


def block_links(nodes: np.ndarray, fps: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, tau: int = TAU) -> Iterator[tuple[int, int]]:
    """A forest of the links among some texts: pairs that share a band, pass the ring and are similar enough."""
    n = len(nodes)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    tried: list[np.ndarray | None] = [None] * n
    for band in range(bands.shape[1]):
        order = np.argsort(bands[:, band], kind="stable")
        cuts = np.flatnonzero(np.diff(bands[order, band])) + 1
        for run in np.split(order, cuts):
            if len(run) < 2 or (root[run] == root[run[0]]).all():
                continue
            for at, i in enumerate(run[:-1]):
                others = run[at + 1 :]
                others = others[root[others] != root[i]]
                if not len(others):
                    continue
                if tried[i] is None:
                    tried[i] = np.zeros(n, dtype=bool)
                others = others[~tried[i][others]]
                tried[i][others] = True
                if not len(others):
                    continue
                small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
                others = others[small >= similarity * large]
                others = others[chain_within(int(fps[i]), fps[others], tau)]
                others = others[np.bitwise_count(fps[others] ^ fps[i]) <= tau]
                for j in others:
                    if root[j] == root[i]:
                        continue
                    both = np.intersect1d(sets[i], sets[j], assume_unique=True).size
                    if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                        root[root == root[j]] = root[i]
                        yield int(nodes[i]), int(nodes[j])


def _compare(size: int, similarity: float):
    """Rows come sorted by block pair: each run of equal keys is compared as it ends."""

    def run(batches):
        held, now, out = [], None, []

        def done():
            if len(held) > 1:
                fps = np.array([h[1] for h in held], dtype=np.int64).view(np.uint64)
                sets = [np.unique(np.concatenate([*shingle_hashes(h[3], size), np.zeros(0, np.uint64)])) for h in held]
                out.extend(block_links(np.array([h[0] for h in held]), fps, np.array([h[2] for h in held]), sets, similarity))
            held.clear()

        for b in batches:
            c = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                key = (c[0][i].as_py(), c[1][i].as_py(), c[2][i].as_py())
                if key != now:
                    done()
                    now = key
                held.append((c[3][i].as_py(), c[4][i].as_py(), c[5][i].as_py(), c[6][i].as_py()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])

    return run


def near_groups(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, th, node, component)`` of each row of ``docs``: rows with one component are near copies, by links.

    ``docs`` has ``doc_id`` and ``text``. Null, empty and blank texts are copies of each other. Rows that repeat are
    copies like any other.
    """
    with bounded(docs.sparkSession):
        marks = written(sketches(docs, size), "near-sketches")
    texts = marks.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("lead"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("n").alias("n")).where("n > 0")
    texts = written(texts.select("node", F.col("lead.doc_id").alias("lead_id"), F.col("lead.th").alias("lead_th"), "fp", "bands", "n"), "near-texts")
    keyed = texts.select("node", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("band", "hub")
    # aggregates are written before they are joined: a band or cluster with very many texts can then be split
    spokes = keyed.join(written(hubs, "near-hubs"), "band").where("node <> hub").select("hub", "node").distinct()
    clusters = connected_components(spokes, "hub", "node").withColumnRenamed("component", "cluster")
    inside = written(texts.join(clusters, "node"), "near-clusters")
    sizes = inside.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a block meets itself and each other block once: the pair is named by the smaller and the larger number
    placed = inside.join(written(sizes, "near-sizes"), "cluster").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    whole = docs.select(F.col("doc_id").alias("lead_id"), F.xxhash64("text").alias("lead_th"), "text").join(
        inside.select("lead_id", "lead_th").distinct(), ["lead_id", "lead_th"], "left_semi").dropDuplicates(["lead_id", "lead_th"])
    ready = placed.join(whole, ["lead_id", "lead_th"]).select("cluster", "a", "b", "node", "fp", "bands", "text")
    ready = ready.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "node")
    with bounded(docs.sparkSession):
        links = written(ready.mapInArrow(_compare(size, similarity), "u long, v long"), "near-links")
    found = connected_components(links)
    return marks.select("doc_id", "th", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one of smallest doc_id (not null, if there is one).

    Columns and other rows stay as they are; of rows that repeat a doc_id and a text, one stays. An empty table stays empty.
    """
    marks = written(near_groups(docs, size, similarity), "near-marks")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    groups = marks.groupBy("component").agg(lead.alias("lead"), F.count("*").alias("n")).where("n > 1")
    # written first: a join with the aggregate itself would keep its partitions, and a hot group could not be split
    joined = marks.join(written(groups, "near-leads"), "component")
    is_lead = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th"))
    gone_id, gone_th, once_th = free_names(docs, "gone_id", "gone_th", "once_th")
    named = [F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)]
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & F.xxhash64("text").eqNullSafe(F.col(gone_th))
    left = docs.join(joined.where(~is_lead).select(*named).distinct(), same, "left_anti")
    # rows that repeat the one that stays are rare: only these meet by id and text
    again = joined.where(is_lead).groupBy("doc_id", "th").count().where("count > 1").select(*named)
    if again.isEmpty():
        return left
    once = left.join(again, same, "left_semi").withColumn(once_th, F.xxhash64("text")).dropDuplicates(["doc_id", once_th]).drop(once_th)
    return left.join(again, same, "left_anti").unionByName(once)
