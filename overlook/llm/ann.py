"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample, deeper for larger tables, and holds centroids only; every row is then assigned to a
leaf. A query walks the tree through a priority queue, nearest branch first, and yields leaves in that order. How many leaves are visited is
widened until a calibration set, searched by brute force over all rows, reaches the wanted recall.

Nearness is the inner product. The tree measures distance after the usual reduction: each vector gets one more component
that makes all lengths equal, and a query a zero there; the nearest then is the one of largest inner product.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlook.llm.common import table
from overlook.plans.shared import cut, written

K = 20
#: Rows that a tree is fitted on at most; the sample is by hash of the row, so it does not hang on partitioning.
FIT_ROWS = 100_000
BRANCH = 8
#: A leaf holds about LEAF_ROOTS times the square root of the table's rows, so that leaves and their rows grow alike: the
#: tree deepens with the table. A node of LEAF_SAMPLE sample rows or fewer is not split: FIT_ROWS do for a billion rows.
LEAF_ROOTS, LEAF_SAMPLE = 2.0, 6
#: Leaves that a query visits first; its k-th score there bounds what the others may add.
FIRST = 2
#: Queries that calibrate the visits at most, for each length of vectors.
CALIBRATE = 100
RECALL = 0.95
#: Vectors of a leaf, and queries that visit it, that one task compares at once.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


@dataclass
class Tree:
    """Children of node i are ``first[i] .. first[i] + count[i]``; a node without children is a leaf."""

    centers: np.ndarray
    first: np.ndarray
    count: np.ndarray
    longest: float
    #: Vectors are taken times 2 to the power of ``-scale``, so that squares neither overflow nor vanish.
    scale: int = 0

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = np.ldexp(x, -self.scale)
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, rest[:, None]])

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each lifted vector: the nearest child at every level."""
        at = np.zeros(len(x), dtype=np.int64)
        while (open_ := np.flatnonzero(self.count[at] > 0)).size:
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                kids = self.centers[self.first[node] : self.first[node] + self.count[node]]
                at[rows] = self.first[node] + ((kids * kids).sum(1) - 2 * x[rows] @ kids.T).argmin(1)
        return at

    def best_first(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in order of the distance of the branches that lead to them, ``most`` at most."""
        q, heap, out = np.ldexp(q, -self.scale), [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if not self.count[node]:
                out.append(int(node))
                continue
            a, n = self.first[node], self.count[node]
            for d, kid in zip(((self.centers[a : a + n] - q) ** 2).sum(1), range(a, a + n)):
                heapq.heappush(heap, (float(d), kid))
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 10) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centers * centers).sum(1) - 2 * x @ centers.T).argmin(1)
        for j in range(k):
            if (mine := near == j).any():
                centers[j] = x[mine].mean(0)
    return centers


def fit_tree(sample: np.ndarray, longest: float, branch: int = BRANCH, leaf_rows: int = LEAF_SAMPLE, seed: int = 7, scale: int = 0) -> Tree:
    """Split by k-means until a node has ``leaf_rows`` sample rows at most, or rows that no split parts."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), np.zeros(1, np.int64), np.zeros(1, np.int64), longest, scale)
    x = tree.lift(sample)
    centers, first, count, todo = [np.zeros(x.shape[1])], [0], [0], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop(0)
        if len(rows) <= leaf_rows:
            continue
        own = _kmeans(x[rows], min(branch, -(-len(rows) // leaf_rows)), rng)
        near = ((own * own).sum(1) - 2 * x[rows] @ own.T).argmin(1)
        kinds = np.unique(near)
        if len(kinds) < 2:
            continue
        first[node], count[node] = len(centers), len(kinds)
        for j in kinds:
            centers.append(own[j])
            first.append(0)
            count.append(0)
            todo.append((len(centers) - 1, rows[near == j]))
    return Tree(np.array(centers), np.array(first), np.array(count), longest, scale)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def sound(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(id, v)`` of the rows that take part: an id, and a vector neither null, empty or zero, of finite components."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL").where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


FOUND = "qid long, qh long, id long, score double"
_COLUMNS = ["qid", "qh", "id", "score"]


def _compare(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows for each query (``qid, qh, q`` and, if present, ``least``, a score that they must reach).

    One product of matrices picks candidates; scores are then summed the same way wherever the rows stand, so that equal
    vectors tie. A sum that is too large for a double is infinite, and such rows tie. A row of the query's own id and vector
    is the query itself.
    """
    if not len(queries) or not len(rows):
        return pd.DataFrame({"qid": pd.Series(dtype="int64"), "qh": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    ids, v, q, qids = rows["id"].to_numpy(), _matrix(rows["v"]), _matrix(queries["q"]), queries["qid"].to_numpy()
    # powers of two keep the products in range whatever the components; what overflows or vanishes then does so once, at the end
    eq, ev = (np.clip(np.frexp(np.abs(m).max(axis=1))[1], -1000, 1020) for m in (q, v))
    far = max(abs(eq).max() + abs(ev).max(), 0) > 900
    qs, vs = (np.ldexp(q, -eq[:, None]), np.ldexp(v, -ev[:, None])) if far else (q, v)
    norm = np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(vs, axis=1).max(initial=0.0)
    rough, margin = qs @ vs.T, 1e-12 * norm
    if far:
        with np.errstate(over="ignore", under="ignore"):
            rough, margin = np.ldexp(rough, eq[:, None] + ev[None, :]), np.ldexp(margin, eq[:, None] + ev.max())
    least = np.full(len(q), -np.inf)
    if len(ids) > k + 1:
        least = np.partition(rough, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
    if "least" in queries:
        least = np.maximum(least, queries["least"].to_numpy(dtype=np.float64))
    with np.errstate(invalid="ignore", over="ignore"):
        # where the least is infinite, so may be the sum of a product that is nearly so
        at, pick = np.nonzero(rough >= np.minimum(least, np.finfo(np.float64).max)[:, None] - margin - 1e-300)
    other = (ids[pick] != qids[at]) | (v[pick] != q[at]).any(axis=1)
    at, pick = at[other], pick[other]
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        exact = (v[pick] * q[at]).sum(axis=1)
        lost = np.isnan(exact)  # infinite terms of both signs: the sum of the terms in range says which side is larger
        if lost.any():
            exact[lost] = np.ldexp((vs[pick[lost]] * qs[at[lost]]).sum(axis=1), eq[at[lost]] + ev[pick[lost]])
    order = np.lexsort((ids[pick], -exact, at))
    at, pick, exact = at[order], pick[order], exact[order]
    first = np.r_[0, np.flatnonzero(np.diff(at)) + 1] if len(at) else np.zeros(0, np.int64)
    keep = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)])) < k
    return pd.DataFrame({"qid": qids[at[keep]], "qh": queries["qh"].to_numpy()[at[keep]], "id": ids[pick[keep]], "score": exact[keep]})


def brute_force(rows: DataFrame, queries: pd.DataFrame, k: int = K) -> DataFrame:
    """Exact neighbours of a few queries (``qid, qh, q``) among rows of their length: each block of rows gives its k best, and those meet."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), BLOCK_ROWS):
                yield _compare(queries, frame.iloc[at : at + BLOCK_ROWS], k)

    return best(rows.select("id", "v").mapInPandas(run, FOUND), k)


def best(found: DataFrame, k: int = K) -> DataFrame:
    w = W.partitionBy("qid", "qh").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: A leaf's number: the length of its vectors, then its node in their tree (0 where they are too few for one).
NODES = 1 << 32


def _assigned(trees: dict[int, Tree]):
    def run(frames):
        for frame in frames:
            leaf = np.zeros(len(frame), dtype=np.int64)
            length = frame["v"].map(len).to_numpy()
            for n in np.unique(length):
                own = length == n
                node = trees[n].assign(trees[n].lift(_matrix(frame["v"][own]))) if n in trees else 0
                leaf[own] = n * NODES + node
            frame["leaf"] = leaf
            yield frame

    return run


def _visits(trees: dict[int, Tree], most: dict[int, int]):
    def run(frames):
        for frame in frames:
            ways = [[n * NODES + x for x in trees[n].best_first(np.append(q, 0.0), most[n])] if (n := len(q)) in trees else [n * NODES] for q in frame["q"]]
            sizes = [len(w) for w in ways]
            yield pd.DataFrame({
                "qid": np.repeat(frame["qid"].to_numpy(), sizes), "qh": np.repeat(frame["qh"].to_numpy(), sizes),
                "leaf": np.array([y for w in ways for y in w], dtype="int64"), "turn": np.array([i for w in ways for i in range(len(w))], dtype="int32"),
            })

    return run


def calibrate(tree: Tree, queries: pd.DataFrame, leaves: pd.DataFrame, recall: float = RECALL) -> int:
    """Widen the visits until ``recall`` of the exact neighbours' ``leaves`` (``qid, qh, node``) are reached."""
    ways = {(i, h): {leaf: n for n, leaf in enumerate(tree.best_first(np.append(q, 0.0), len(tree.centers)))} for i, h, q in zip(queries["qid"], queries["qh"], queries["q"])}
    need = np.sort([ways[i, h][node] + 1 for i, h, node in zip(leaves["qid"], leaves["qh"], leaves["node"])])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if len(need) else len(tree.leaves())


def _meet(asks: DataFrame, indexed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Queries (``asks``: ``qid, qh, leaf`` and perhaps ``least``) meet the rows of the leaves they visit, block by block."""
    extra = [c for c in ("least",) if c in asks.columns]
    sizes = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nb"))
    visitors = asks.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("nq"))
    cuts = cut(sizes.join(visitors, "leaf"))
    # a row a leaf: a small share of the table, but it grows with it, so it is broadcast only when counted
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_LEAVES else cuts
    spread = lambda n, *of: F.pmod(F.xxhash64(*of, F.lit("block")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(cuts, "leaf").withColumn("cq", spread("nq", "qid", "qh")).withColumn("cb", each("nb")).join(asked, ["qid", "qh"]).select("leaf", "cq", "cb", "qid", "qh", "q", *extra)
    right = indexed.join(cuts, "leaf").withColumn("cb", spread("nb", "id", "v")).withColumn("cq", each("nq")).select("leaf", "cq", "cb", "id", "v")

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _compare(queries, block, k)

    return left.groupBy("leaf", "cq", "cb").cogroup(right.groupBy("leaf", "cq", "cb")).applyInPandas(meet, FOUND)


#: Leaves (24 bytes each) up to which their block counts are broadcast.
BROADCAST_LEAVES = 500_000
RESULT = "query_id long, rank int, vec_id long, score double, leaves_visited int, leaves int"


def search(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, fit_rows: int = FIT_ROWS, calibrate_rows: int = CALIBRATE, leaf_roots: float = LEAF_ROOTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score, leaves_visited, leaves)``: each query's ``k`` nearest found among all rows but its own.

    ``is_query`` is a condition on ``id``. Rows that cannot take part (see ``sound``) are neither queries nor candidates;
    a query meets vectors of its own length only, so an odd vector changes nothing for the rest. Rows that repeat an id
    and a vector count once; an id with several vectors has a row for each, and each is a query if its id is. Copies of a vector tie
    on every query, so that all but the k + 1 of smallest id can never be among the k nearest: they are left out exactly,
    which bounds any leaf of copies. Large leaves are cut in blocks, and so are the queries that visit them. A query's k-th
    score in its first leaves bounds the others: rows below it are not sent on.
    """
    spark = vectors.sparkSession
    part = written(sound(vectors, id_column, column).distinct().withColumn("n", F.size("v")), "ann-rows")
    norm = lambda by: F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * F.lit(by)) * (x * F.lit(by)))))
    lengths = {}
    for n, total, longest, top in part.groupBy("n").agg(F.count("*"), norm(1.0), F.max(F.array_max(F.transform("v", F.abs)))).where(F.col("count(1)") > BRANCH * LEAF_SAMPLE * 4).collect():
        scale = 0
        if not 1e-140 < longest < 1e140:  # squares would overflow or vanish: the tree is made of vectors scaled by a power of two
            scale = int(np.clip(np.frexp(top)[1], -1000, 1000))
            longest = part.where(F.col("n") == n).agg(norm(2.0**-scale)).first()[0]
        lengths[n] = (total, longest, scale)
    copies = W.partitionBy("v").orderBy("id")
    kept = part.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k + 1).drop("c")
    trees: dict[int, Tree] = {}
    for n, (total, longest, scale) in lengths.items():
        share = min(1.0, fit_rows / total)
        drawn = F.pmod(F.xxhash64("id", "v", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
        sample = kept.where((F.col("n") == n) & drawn).select("v").limit(2 * fit_rows).toPandas()
        trees[n] = fit_tree(_matrix(sample["v"]), float(longest), leaf_rows=max(LEAF_SAMPLE, int(leaf_roots * total**0.5 * share)), scale=scale)
    indexed = written(kept.select("id", "v").mapInPandas(_assigned(trees), "id long, v array<double>, leaf long"), "ann-leaves")
    asked = part.where(is_query).select(F.col("id").alias("qid"), F.xxhash64("v").alias("qh"), F.col("v").alias("q"))
    visits: dict[int, int] = {}
    for n, tree in trees.items():
        probes = asked.where(F.size("q") == n).orderBy(F.xxhash64("qid", "qh", F.lit("calibrate"))).limit(calibrate_rows).toPandas()
        own = indexed.where(F.col("leaf").between(n * NODES, n * NODES + NODES - 1))
        # copies of a neighbour share its leaf, so any row of its id and score stands for it
        exact = brute_force(own, probes, k).join(own.select("id", (F.col("leaf") % NODES).alias("node")).dropDuplicates(["id"]), "id").select("qid", "qh", "node").toPandas()
        visits[n] = calibrate(tree, probes, exact, recall)
    pairs = written(asked.mapInPandas(_visits(trees, visits), "qid long, qh long, leaf long, turn int"), "ann-visits")
    first = written(best(_meet(pairs.where(F.col("turn") < FIRST), indexed, asked, k), k), "ann-first")
    bound = first.where(F.col("rank") == k).select("qid", "qh", F.col("score").alias("least"))
    rest = pairs.where(F.col("turn") >= FIRST).join(bound, ["qid", "qh"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = first.drop("rank").unionByName(_meet(rest.drop("turn"), indexed, asked, k))
    counts = pairs.groupBy("qid", "qh").agg(F.count("*").cast("int").alias("leaves_visited"), (F.max("leaf") / NODES).cast("int").alias("n"))
    whole = F.coalesce(*[F.when(F.col("n") == n, len(t.leaves())) for n, t in trees.items()], F.lit(1))
    out = best(found, k).join(counts, ["qid", "qh"])
    return out.select(F.col("qid").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score", "leaves_visited", whole.alias("leaves"))


def op9_ann(spark, sf_dir):
    """Of ``embeddings``: the rows whose id is divisible by 20 against all rows."""
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
