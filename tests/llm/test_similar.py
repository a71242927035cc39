"""SimHash, near copies and nearest neighbours against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from overlook.llm import ann, near_copies, registry, simhash


def naive_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


@pytest.mark.parametrize("text", [None, "", "  \n\t", "One", "Two Words", "A b C d e f g a b c", "É é x ＡB\x1cc", "w " * 70_000, "ab\x0bcd\x0cef\rgh"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == naive_fingerprint(text)


def components_by_hand(prints, tau=3):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin((prints[i][1] ^ prints[j][1]) & (1 << 64) - 1).count("1") <= tau:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(doc)
    return {doc: min(g) for g in groups.values() for doc in g}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered(rng, groups, members):
    out = []
    for g in range(groups):
        base = rng.getrandbits(64)
        for _ in range(members):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            out.append((len(out), signed(x)))
    return out


@pytest.mark.parametrize("pairwise, fine", [(32, 200), (2, 200), (2, 2)])
def test_components(spark, pairwise, fine, monkeypatch):
    prints = clustered(random.Random(pairwise + fine), 12, 12)
    prints += [(1000, 0), (1001, 0), (1002, 7), (1003, signed(1 << 63)), (1004, -1)]
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    monkeypatch.setattr(simhash, "PAIRWISE_FINE", fine)
    df = spark.createDataFrame(prints, "doc_id long, fp long")
    assert {r["doc_id"]: r["component_id"] for r in simhash.components(df).collect()} == components_by_hand(prints)


def test_query_by_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = components_by_hand([(r["doc_id"], signed(naive_fingerprint(r["text"]))) for r in table])
    got = registry.QUERIES["op4_simhash"](spark, small).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == {r["doc_id"]: naive_fingerprint(r["text"]) for r in table}


def test_simhash_edges(spark):
    d = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (5, None), (6, ""), (6, "")], "doc_id long, text string").withColumn("fp", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.components(simhash.fingerprints(d)).collect()), key=str)
    assert got == sorted([(None, 3), (3, 3), (5, 5), (6, 5), (6, 5)], key=str)
    assert simhash.components(simhash.fingerprints(d.limit(0))).count() == 0


# near copies


def naive_groups(texts, size=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "short text", "Short  TEXT", "one two three four five six"]
    for n in (60, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [edited(rng, base, e) for e in (0, 0, 1, 1, 2, 2, 3, n // 60, n // 40, n // 5)]
    return texts


def same_parting(a, b):
    assert len(a) == len(b)
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def test_near_groups(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in near_copies.near_groups(df).collect()}
    same_parting([got[i] for i in range(len(texts))], naive_groups(texts))


def test_near_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", 4)
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [edited(rng, base, rng.choice([0, 1, 2, 3, 4, 5])) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in near_copies.near_groups(df).collect()}
    same_parting([got[i] for i in range(len(texts))], naive_groups(texts))


def test_chain_never_drops_a_pair_within_tau():
    rng = random.Random(3)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(0, near_copies.TAU + 1)):
            b ^= 1 << k
        assert near_copies.chain_within(a, np.array([b], dtype=np.uint64))[0]


def test_repeats_do_not_part_near_copies(spark):
    rng = random.Random(11)
    some = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    texts = []
    for base, line, times in [(200, 12, 30), (200, 12, 10), (300, 60, 8), (100, 30, 5)]:
        for _ in range(5):
            a, b = some(base), some(line)
            texts += [f"{a} {b}", a + f" {b}" * times]
    for _ in range(40):
        a = some(9)
        texts += [a, a.rpartition(" ")[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in near_copies.near_groups(df).collect()}
    same_parting([got[i] for i in range(len(texts))], naive_groups(texts))


def test_fingerprints_of_short_near_copies_stay_within_tau():
    rng = random.Random(12)
    for _ in range(3000):
        words = [f"w{rng.randrange(9000)}" for _ in range(9)]
        a, b = (near_copies.sketch(" ".join(w))[1] for w in (words, words[:-1]))
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= near_copies.TAU


def test_keep_one(spark):
    texts = corpus(2)
    rows = [(i + 10, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(12, " \n ", "en", "s", 3), (None, "short text", "en", "s", 9), (13, "short text", "en", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = near_copies.keep_one(df).collect()
    groups, best = naive_groups([r[1] for r in rows]), {}
    for r, g in zip(rows, groups):
        if r[0] is not None:
            best[g] = min(best.get(g, 10**9), r[0])
    assert sorted(r["doc_id"] for r in left) == sorted(best.values())
    assert near_copies.keep_one(df.limit(0)).count() == 0
    names = df.withColumns({n: F.lit("mine") for n in ("gone_id", "GONE_TH", "nc_text", "th", "node", "component", "lead")})
    again = near_copies.keep_one(names)
    assert again.columns == names.columns and sorted(r["doc_id"] for r in again.collect()) == sorted(r["doc_id"] for r in left)


def test_near_groups_on_documents(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["component"] for r in near_copies.near_groups(table).collect()}
    same_parting([got[r["doc_id"]] for r in rows], naive_groups([r["text"] for r in rows]))


# nearest neighbours


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [3.0]), (40, [0.0, 0.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0]), (8, [-1.0, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(9)), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 5.0), (0, 2, 20, 5.0), (0, 3, 8, 0.0), (20, 1, 0, 5.0), (20, 2, 1, 5.0), (20, 3, 8, 0.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).count() == 0


def test_odd_and_repeated_rows_change_nothing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(500)]
    rows += [(i, rng.normal(size=6).tolist()) for i in (1, 2, 3, 20, 40)]  # ids with two vectors
    odd = [(900, [float("nan")] * 9), (901, [1.0] * 9), (920, [2.0] * 9), (940, [3.0]), (20, rows[20][1])]
    schema = "vec_id long, embedding array<double>"
    got = ann.search(spark.createDataFrame(rows + odd, schema), F.col("id") % 20 == 0, k=5).toPandas()
    assert got[got.query_id == 920][["rank", "vec_id"]].values.tolist() == [[1, 901]] and not (got.query_id == 940).any()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = total = 0
    for a, (i, x) in enumerate(rows):
        if i % 20 == 0:
            score = (v * np.array(x)).sum(1)
            score[a] = -np.inf
            order = np.lexsort((ids, -score))[:5]
            own = set(zip(got[got.query_id == i].vec_id, got[got.query_id == i].score))
            hits, total = hits + len({(ids[o], score[o]) for o in order} & own), total + 5
    assert hits / total >= 0.9 and len(got[got.query_id == 20]) == 10


def test_the_tree_deepens_with_the_table(spark):
    rng = np.random.default_rng(5)
    sizes = {}
    for n in (2000, 8000):
        rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": rng.normal(size=(n, 4)).tolist()}))
        got = ann.search(rows, F.col("id") % 400 == 0, fit_rows=1500)
        sizes[n] = got.select("leaves", "leaves_visited").first()
    assert sizes[8000]["leaves"] > 1.5 * sizes[2000]["leaves"] and sizes[8000]["leaves_visited"] < sizes[8000]["leaves"] / 2


def test_recall(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    v = np.array(table.embedding.tolist(), dtype=np.float64)
    got = registry.QUERIES["op9_ann"](spark, small).toPandas()
    hits = total = 0
    for i, q in zip(table.vec_id, v):
        if i % 20 == 0:
            score = (v * q).sum(1)
            score[table.vec_id == i] = -np.inf
            best = set(table.vec_id.to_numpy()[np.lexsort((table.vec_id, -score))[:20]])
            own = got[got.query_id == i]
            assert own["rank"].tolist() == list(range(1, 21))
            hits, total = hits + len(best & set(own.vec_id)), total + 20
    assert hits / total >= 0.9


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 1.0, 0.5]) for i in range(400)] + [(400 + i, rng.normal(size=3).tolist()) for i in range(300)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5)
    own = got.where("query_id = 0").orderBy("rank").toPandas()
    v = np.array([r[1] for r in rows])
    score = (v * v[0]).sum(1)
    score[0] = -np.inf
    assert own.vec_id.tolist() == np.lexsort((np.arange(len(v)), -score))[:5].tolist()


@pytest.mark.parametrize("size", [1e200, 1e-200, 1e153, 1.0])
def test_neighbours_of_any_magnitude(spark, size):
    """Products that overflow are infinite and tie, those that vanish are zero and tie: no row is lost."""
    r = np.random.default_rng(11)
    for rows in (60, 400):
        v = np.abs(r.normal(size=(rows, 6))) * size
        got = ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5, recall=1.0).collect()
        with np.errstate(over="ignore", under="ignore"):
            for q in range(0, rows, 20):
                mine = sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == q)
                scores = {i: float((v[i] * v[q]).sum()) for i in range(rows) if i != q}
                want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
                assert len(mine) == 5
                if rows == 60:  # few rows are compared in full
                    assert [(i, s) for _, i, s in mine] == [(i, scores[i]) for i in want]


def test_neighbours_of_infinite_terms_of_both_signs(spark):
    v = [[1e200, -1e200, 1.0], [1e200, 1e200, 2.0], [-1e200, 1e200, 3.0], [1.0, 1.0, 1.0]]
    got = ann.search(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>"), F.col("id") == 1, k=5).collect()
    assert len(got) == 3 and not any(x["score"] != x["score"] for x in got) and sorted(x["rank"] for x in got) == [1, 2, 3]
