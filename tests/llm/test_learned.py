"""Language identification, toxicity and the pipeline: held-out accuracy, edge cases, brute force."""

import zlib

import pytest
from pyspark.sql import functions as F

from overlook.llm import langid, registry, toxicity


def part(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_held_out(spark, small):
    got = registry.QUERIES["op2_langid"](spark, small).toPandas()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(h == (part(i, 4) == 2) for i, h in zip(got.doc_id, got.held_out)) and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.doc_id.map(lang)).mean() > 0.9


def test_language_edges(spark):
    rows = [("en", "the cat and the dog and the house " * 5), ("fr", "le chat et le chien et la maison " * 5), (None, "the"), ("en", None), ("fr", "")]
    filters = langid.learn(spark.createDataFrame(rows, "lang string, text string"))
    d = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat"), (5, "LE CHIEN ET LE CHAT"), (None, "the house " * 20_000), (4, "the dog and the cat")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(d.withColumn("extra", F.lit("zz")), filters).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "fr", None: "en"}
    none = langid.learn(spark.createDataFrame([], "lang string, text string"))
    assert {r["lang_pred"] for r in langid.predict(d, none).collect()} == {"und"}
    assert langid.predict(d.limit(0), filters).count() == 0


def test_filter_masks_hold_all_learned_ngrams(spark):
    filters = langid.learn(spark.createDataFrame([("en", "abcd " * 9), ("fr", "bcde " * 9)], "lang string, text string"))
    total, found = filters.counts("abcd")
    assert filters.langs == ["en", "fr"] and total >= 2 and found[0] > found[1]


def test_filters_against_plain_sets(spark, small):
    """Masks, counts and corrected popcounts against sets of n-grams made by hand."""
    import numpy as np

    def plain_grams(text):
        low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
        return [w[i : i + 3] for w in (f" {x} " for x in low.split()) for i in range(len(w) - 2)]

    def unpack(g):
        return "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0))

    table = spark.read.parquet(f"{small}/documents.parquet").select("lang", "text").where("lang IS NOT NULL")
    counted = {}
    for lang, text in table.collect():
        for g in plain_grams(text):
            counted.setdefault(lang, {}).setdefault(g, 0)
            counted[lang][g] += 1
    got = {}
    for r in langid.gram_counts(table).collect():
        got.setdefault(r["lang"], {})[unpack(r["gram"])] = r["n"]
    assert got == counted
    total = {x: sum(c.values()) for x, c in counted.items()}
    top = {}
    for x, c in counted.items():
        for g, n in c.items():
            top[g] = max(top.get(g, 0), n / total[x])
    kept = {x: {g for g, n in c.items() if n >= langid.MIN_COUNT and n / total[x] >= max(langid.MIN_SHARE, langid.SHARE * top[g] * (1 - 1e-12))} for x, c in counted.items()}
    filters = langid.learn(table)
    assert filters.table.shape[1] >= langid.ROWS_PER_GRAM * max(map(len, kept.values())) and filters.false.max() < 0.0024
    for _, text in table.limit(40).collect():
        n, found = filters.counts(text)
        own = plain_grams(text)
        assert n == len(own)
        for i, x in enumerate(filters.langs):
            true = sum(g in kept[x] for g in own)
            assert true <= found[i] <= true + max(5, 0.02 * n)
            corrected = (found[i] - n * filters.false[i]) / (1 - filters.false[i])
            assert abs(corrected - true) <= max(5, 0.02 * n)


def test_all_letters_count(spark):
    assert langid.has_letter("\U00030000") and langid.has_letter("\U00031350") and not langid.has_letter("1 \U0001f600")
    d = spark.createDataFrame([(1, "the dog", "mine")], "doc_id long, text string, lang_pred string").withColumn("score", F.lit("mine"))
    filters = langid.learn(spark.createDataFrame([("en", "the cat and the dog " * 5)], "lang string, text string"))
    assert [(r["lang_pred"], r["score"] > 0) for r in langid.predict(d, filters).collect()] == [("en", True)]


def test_marks_belong_to_words_and_rare_grams_can_stay(spark):
    hindi, thai = "हिन्दी में लिखा हुआ वाक्य", "ที่นี่มีน้ำอยู่"
    (keys,) = langid.grams("हिन्दी")
    assert len(keys) == 6 and not langid.has_letter("1 \u0301\u093f") and langid.has_letter("न")
    filters = langid.learn(spark.createDataFrame([("hi", hindi + " ") for _ in range(6)] + [("th", thai) for _ in range(6)], "lang string, text string"))
    assert filters.decide("हिन्दी वाक्य")[0] == "hi" and filters.decide("มีน้ำ")[0] == "th"
    rows = spark.createDataFrame([("en", "abcdefg " * 20_000)] + [("en", "qzx")] * 5 + [("fr", "mnopq " * 20)], "lang string, text string")
    rare = [langid.learn(rows, share).counts("qzx")[1][0] for share in (1e-3, 0)]
    assert rare[1] == 3 and rare[0] == 0


# toxicity


def test_restores_obfuscated_words(spark):
    texts = spark.createDataFrame([("the stupid idiot was here and the garden was green " * 20,)], "text string")
    model = toxicity.character_model(texts)
    assert toxicity.restore("1d10t", model) == "idiot"
    words = toxicity.Restorer(model).words("You are a s-t-u-p-i-d i d i o t and stuuuuupid $tupid!")
    assert {"stupid", "idiot"} <= words


def test_long_words_are_restored_whole(spark):
    texts = spark.createDataFrame([("the stupid idiot was here and the garden was green " * 20,)], "text string")
    model = toxicity.character_model(texts)
    for word in ("stu" + "u" * 70 + "pid", "stu" + "u" * 5000 + "pid", "$tu" + "u" * 70 + "p1d", ("." * 30).join("stupid"), "s" + "-" * 90 + "tupid"):
        assert "stupid" in toxicity.Restorer(model).words(f"you are {word} indeed"), word


def test_viterbi_finds_the_cheapest_of_all_readings(spark):
    import itertools
    import random

    texts = spark.createDataFrame([("the stupid idiot was here and all of it is said at last " * 20,)], "text string")
    model = toxicity.character_model(texts)
    rng = random.Random(3)

    def cost(reading, extra):
        s = [0, 0, *(toxicity.code(c) for c in reading if c), 0]
        return extra - sum(model[s[i], s[i + 1], s[i + 2]] for i in range(len(s) - 2))

    for spaced in (False, True):
        for _ in range(150):
            word = "".join(rng.choice("stpidoa1!0$-. aa") for _ in range(rng.randrange(1, 8)))
            ways = itertools.product(*(toxicity.options(word, i, spaced) for i in range(len(word))))
            best = min(cost([c for c, _ in w], sum(e for _, e in w)) for w in ways)
            got = toxicity.restore(word, model, spaced)
            same = [cost([c for c, _ in w], sum(e for _, e in w)) for w in itertools.product(*(toxicity.options(word, i, spaced) for i in range(len(word)))) if "".join(c for c, _ in w) == got]
            assert min(same) == pytest.approx(best), word


def test_a_sentence_of_spaced_letters(spark):
    texts = spark.createDataFrame([("you are stupid now and what the idiot said was here " * 30,)], "text string")
    model = toxicity.character_model(texts)
    words = toxicity.Restorer(model).words("so " + " ".join("youarestupidnow") + ". indeed")
    assert {"you", "are", "stupid", "now"} <= words
    scorer = toxicity.Scorer(model, {"idiot$": 5.0}, -3.0)
    assert scorer.score(" ".join("xqzidiotvvk")) > 0.7 > scorer.score(" ".join("xqzidoitvvk"))


DISGUISES = {
    "three spaces": "s   t   u   p   i   d", "one a line": "s\nt\nu\np\ni\nd", "tabs and lines": "s\t\tt \n u\r\n p\n\n\n\n\n\n\n\n\ni d", "all doubled": "sttuuppiidd", "every one doubled": "ssttuuppiidd",
    "Cyrillic": "ѕtuріd", "Cyrillic throughout": "ѕтцріԁ", "Greek": "sτυριd", "full width": "ｓｔｕｐｉｄ", "mathematical": "𝐬𝐭𝐮𝐩𝐢𝐝", "zero width": "st​up⁠id", "soft hyphen": "stu­pid", "struck through": "s̶t̶u̶p̶i̶d",
    "masked": "st*pid", "masked twice": "$t*p•d",
}


@pytest.mark.parametrize("name", DISGUISES)
def test_disguises(spark, name):
    texts = spark.createDataFrame([("the stupid idiot was here and the garden was green and a fool said so at school " * 20,)], "text string")
    restorer = toxicity.Restorer(toxicity.character_model(texts))
    assert "stupid" in restorer.words(f"you are {DISGUISES[name]} indeed", ("stupid",))
    if "masked" not in name:
        assert "stupid" in restorer.words(f"you are {DISGUISES[name]} indeed")


def test_what_is_no_disguise(spark):
    texts = spark.createDataFrame([("the stupid idiot was here and the committee keeps a bookkeeper in tennessee, а сахар у нас " * 20,)], "text string")
    restorer = toxicity.Restorer(toxicity.character_model(texts))
    plain = "The committee, a bookkeeper: 2*3 **bold** сахар u.s. café"
    assert restorer.words(plain, ("stupid", "idiot", "gold")) == {"the", "committee", "a", "bookkeeper", "bold", "сахар", "u", "s", "café"} | restorer.words("u.s.") | restorer.words("2*3")
    assert {"left", "right"} <= restorer.words("left​right") and "fool" in restorer.words("f00l") and toxicity.mask("s*") is None
    assert toxicity.code("\U00031350") > 26 and toxicity.code("\U0001f600") == 0


def test_weights_learn_from_what_scores_read(spark):
    """Masked and spaced words that only known words explain are evidence while weights are fitted, too."""
    rows = [(i, "you zorgle today") for i in range(0, 60, 2)] + [(i, "you z*rgle today") for i in range(1000, 1040)] + [(i, f"calm words to you about {i} today") for i in range(1, 400, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (~F.col("text").startswith("calm")).cast("int").alias("toxic"))
    scorer = toxicity.fit(docs, labels)
    assert scorer.score("you z*rgle today") > 0.7 and scorer.score("z   o   r   g   l   e") > 0.7 > scorer.score("you z*zzle today, you zirkle")


def test_evidence_adds_up():
    found = [(40, 0, []), (10, 6, ["a$"]), (10, 6, ["b$"]), (5, 5, ["a$", "b$"])]
    weights, base = toxicity.weigh(found, ["a$", "b$"])
    scorer = toxicity.Scorer(toxicity.np.zeros((64, 64, 64)), weights, base)
    none, one, two = (scorer.score(t) for t in ("x", "a x", "a b"))
    assert none < 0.1 < one < two and two > 0.8
    assert toxicity.borne_out([("w$", 3, 0)], {3: 5000}, 0.1) == [] and toxicity.borne_out([("w$", 3, 0)], {3: 20}, 0.1) == ["w$"]


def test_toxicity_where_labels_are_few(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scorer = toxicity.fit(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id", "toxic"), "doc_id"), scorer).toPandas()
    held = got[[part(i, 3) == 1 for i in got.doc_id]]
    assert (held.score[held.toxic == 1] >= 0.7).mean() > 0.75 and (held.score[held.toxic == 0] >= 0.7).mean() < 0.02


def test_toxicity_held_out(spark, small):
    folder = "/root/testdata/sf0.1"
    got = registry.QUERIES["op8_toxicity"](spark, folder).toPandas()
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(h == (part(i, 3) == 1) for i, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    held = got[got.held_out & got.doc_id.isin(label)]
    truth = held.doc_id.map(label)
    caught, wrong = held.predicted[truth == 1].mean(), held.predicted[truth == 0].mean()
    assert caught > 0.85 and wrong < 0.02


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(i, f"plain words number {i}") for i in range(30)] + [(100, None), (101, ""), (None, "x"), (5, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(d, toxicity.fit(d, labels)).collect()
    assert len(got) == 34 and all(0 <= r["score"] < 0.7 for r in got)
    long = d.limit(0).union(spark.createDataFrame([(7, "word " * 200_000)], d.schema)).withColumns({"tx_id": F.lit("mine"), "tx_toxic": F.lit("mine"), "toxic": F.lit("mine"), "score": F.lit("mine")})
    (one,) = toxicity.score(long, toxicity.fit(long, labels)).collect()
    assert one["tx_id"] == one["toxic"] == "mine" and 0 <= one["score"] < 0.7
    empty = labels.limit(0)
    assert all(r["score"] < 0.7 for r in toxicity.score(d, toxicity.fit(d, empty)).collect())
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), empty)).count() == 0


def test_pipeline_stages(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_similar import naive_groups

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stage = dict(pipeline.STAGES)
    one = stage["toxicity"](spark, docs, small)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))).collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, s in scores.items() if s < 0.7}
    two = stage["line_dedup"](spark, one, small)
    assert two.columns == docs.columns and two.count() == one.count() and two.where("n_chars <> length(text)").count() == one.where("n_chars <> length(text)").count()
    three = stage["near_dedup"](spark, two, small)
    rows = two.select("doc_id", "text").collect()
    best = {}
    for r, g in zip(rows, naive_groups([r["text"] for r in rows])):
        best[g] = min(best.get(g, 10**9), r["doc_id"])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(best.values())
    from test_text import naive_leaks

    four = stage["decontamination"](spark, three, small)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = three.collect()
    leaks = {d for d, _ in naive_leaks([(r["doc_id"], r["text"]) for r in rows], items)}
    assert four.columns == docs.columns and leaks and sorted(r["doc_id"] for r in four.collect()) == sorted(r["doc_id"] for r in rows if r["doc_id"] not in leaks)
    five = pipeline.run(spark, small)
    assert set(docs.columns) <= set(five.columns)
    assert {r["doc_id"]: round(r["probability"], 6) for r in five.collect()} == naive_mix([r for r in rows if r["doc_id"] not in leaks])


def test_pipeline_drops_leaks_beside_long_runs(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = max((r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() if r["text"]), key=len)
    rows = [(1, "Von " * 30_000 + "and so on. " + item), (2, "Von " * 30_000 + "1." * 30_000), (3, item + " and 1" + ":2" * 30_000), (4, None)]
    left = pipeline.drop_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), small)
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 4]


def naive_mix(rows):
    """Raking and sampling of few rows, by loops: the probability of each that stays."""
    import hashlib
    import re

    from overlook.llm import mixing

    def topic(t):
        return "none" if t is None else "table" if " | " in t else "licence" if "icense" in t else "contact" if "@" in t else "prose"

    cell = {r["doc_id"]: (r["source"] or "", r["lang"] or "", topic(r["text"])) for r in rows}
    size = {r["doc_id"]: len(re.findall(r"[^\t-\r ]+", r["text"] or "")) for r in rows}
    tokens = {}
    for i, c in cell.items():
        tokens[c] = tokens.get(c, 0) + size[i]
    whole = sum(tokens.values())
    targets = []
    for d, power in enumerate(mixing.TEMPERATURE.values()):
        sums = {}
        for c, n in tokens.items():
            sums[c[d]] = sums.get(c[d], 0) + n
        lifted = {v: n**power for v, n in sums.items() if n}
        targets.append({v: x / sum(lifted.values()) for v, x in lifted.items()})
    w = {c: n / whole for c, n in tokens.items()}
    for _ in range(400):
        for d, want in enumerate(targets):
            sums = {}
            for c, x in w.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            w = {c: x * want.get(c[d], 0) / sums[c[d]] if sums[c[d]] else 0.0 for c, x in w.items()}
    low, high = 0.0, 1e12
    for _ in range(300):  # the scale by halving
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(n, mid * w[c]) for c, n in tokens.items()) < mixing.RATE * whole else (low, mid)
    out = {}
    for i, c in cell.items():
        p = min(1.0, low * w[c] / tokens[c]) if tokens[c] else 0.0
        if int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52 < p:
            out[i] = round(p, 6)
    return out
