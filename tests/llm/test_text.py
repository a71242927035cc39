"""License scans, line dedup, decontamination, mixing: rules, edge cases, brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from overlook.llm import decontaminate, licenses, line_dedup, mixing, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCS)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, small, duck, same, name):
    same(registry.QUERIES[name](spark, small).toPandas(), duck.execute(registry.SQL[name]).df())


# licenses


def test_each_template_is_found_exactly():
    s = licenses.Scanner()
    for name, _, text in licenses.TEMPLATES:
        for around in (text, f"some prose here\n\n{text}\n\nmore prose"):
            assert [(r[1], r[5]) for r in s.scan(around)] == [(name, "exact")], text


def test_changed_and_unknown_wording():
    s = licenses.Scanner()
    mit = licenses.TEMPLATES[1][2]
    (_, name, saved, missing, inserted, verdict), = s.scan(mit.replace("sell", "trade"))
    assert (name, missing, inserted, verdict) == ("MIT", "sell", "trade", "changed") and saved > 100
    assert [r[1::4] for r in s.scan("Licensed under the Apache License, Version 1.1.")] == [(None, "unknown")]
    assert [r[5] for r in s.scan("My driving licence ran out.")] == ["unknown"]
    assert s.scan(None) == s.scan("") == s.scan("no such words") == []


def test_two_licenses_and_long_blocks():
    s = licenses.Scanner()
    both = "Released under the MIT License.\nLicensed under CC BY-NC 4.0."
    assert sorted(r[1] for r in s.scan(both)) == ["CC-BY-NC-4.0", "MIT"]
    long = "word " * 30_000 + "Licensed under the Apache License, Version 2.0." + " word" * 30_000
    assert [r[1] for r in s.scan(long)] == ["Apache-2.0"]


def test_every_license_of_a_block_is_found():
    s = licenses.Scanner()
    short = {}
    for name, _, text in licenses.TEMPLATES:
        short[name] = min(short.get(name, text), text, key=len)
    for names in (["GPL-3.0", "MIT"], ["GPL-3.0", "Apache-2.0"], ["GPL-3.0", "CC0-1.0"], ["LGPL-3.0", "CC-BY-4.0"], ["MIT", "Apache-2.0", "GPL-3.0"], ["MIT", "GPL-2.0", "MIT"], list(short)):
        assert sorted(r[1] for r in s.scan("\n".join(short[n] for n in names))) == sorted(names), names


@pytest.mark.parametrize("width, lead", [(40, ""), (72, "# "), (120, "    "), (60, " * ")])
def test_wrapped_indented_and_commented_texts(width, lead):
    import textwrap

    s = licenses.Scanner()
    for name, _, text in licenses.all_templates():
        if len(text) < 200:
            continue
        body = "\n".join(lead + line for line in textwrap.wrap(" ".join(text.split()), width, break_long_words=False, break_on_hyphens=False))
        got = s.scan(f"int x = 1;\n{body}\nint main() {{ return x; }}")
        assert [r[1] for r in got] == [name], (name, [r[:2] for r in got])


def test_full_texts_changed_repeated_and_side_by_side():
    s = licenses.Scanner()
    full = {name: text for name, _, text in licenses.full_texts()}
    mit = next(t for n, k, t in licenses.TEMPLATES if "noninfringement" in k)
    got = s.scan(mit.replace("sell", "trade") + "\n\n" + mit)
    assert [(r[1], r[3], r[5]) for r in got] == [("MIT", "sell", "changed"), ("MIT", "", "exact")]
    got = s.scan(full["Apache-2.0"] + "\n\n" + full["LGPL-3.0"] + "\n\n" + mit + "\n\n" + full["Apache-2.0"])
    assert [r[1] for r in got] == ["Apache-2.0", "LGPL-3.0", "MIT", "Apache-2.0"]
    words = full["GPL-2.0"].split()
    changed = " ".join(w for i, w in enumerate(words) if i % 100)  # one word of a hundred is gone
    (_, name, _, missing, _, verdict), = s.scan("x " * 5000 + changed)
    assert (name, verdict) == ("GPL-2.0", "changed") and len(missing.split()) >= len(words) // 100 - 5
    assert [r[1] for r in s.scan("\n".join(["MIT License"] * 7))] == ["MIT"] * 7


def test_exact_wording_by_brute_force(spark, small):
    """A document that holds all words of a template in a row is found under its name, or under a longer one that holds it."""
    import re

    plain = lambda t: " " + " ".join(w.lower() for w in re.findall(r"[A-Za-z0-9]+(?:[.\-'][A-Za-z0-9]+)*", t)) + " "
    got = {}
    for r in registry.QUERIES["op6_licenses"](spark, small).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    seen = 0
    for doc, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        held = [(n, plain(t)) for n, _, t in licenses.all_templates() if plain(t) in plain(text or "")]
        for n, t in held:
            seen += 1
            assert n in got[doc] or any(t in u and m in got[doc] for m, u in held), (doc, n)
    assert seen


def test_license_scan_equals_plain_loop(spark, small):
    s = licenses.Scanner()
    table = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted((i, *r[:2]) for i, t in table.select("doc_id", "text").collect() for r in s.scan(t))
    got = sorted((r["doc_id"], r["block_at"], r["license"]) for r in registry.QUERIES["op6_licenses"](spark, small).collect())
    assert got == want and want
    planted = table.where("text LIKE '%Licensed under the Apache License, Version 2.0.%'").count()
    assert planted == len({i for i, _, name in got if name == "Apache-2.0"})


@pytest.mark.parametrize(
    "text, name",
    [
        ("License: MIT", "MIT"), ("This is distributed under the terms of the MIT licence.", "MIT"), ("License: GPL v3 or later", "GPL-3.0"), ("It is Licensed under Apache 2.0", "Apache-2.0"),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("# SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"), ("SPDX-License-Identifier: Zlib", "Zlib"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"), ("Licensed under CC BY 2.5.", "CC-BY-2.5"), ("SPDX-License-Identifier: CC-BY-NC-ND-3.0", "CC-BY-NC-ND-3.0"),
    ],
)
def test_common_license_wordings(text, name):
    s = licenses.Scanner()
    for before, after in (("", ""), ("Some words of prose come first. ", "\nAnd more of them follow here, at length.\n")):
        assert {r[1] for r in s.scan(before + text + after)} == {name}


def test_versions_and_names_are_not_mixed_up():
    s = licenses.Scanner()
    for text in ("SPDX-License-Identifier: GPL-3.0-or-never", "Licensed under CC BY-SA 1.7.", "License: MID", "License: GPL v9 or later"):
        assert {r[5] for r in s.scan(text)} <= {"unknown"}, text


@pytest.mark.parametrize(
    "text,verdict",
    [
        ("This code is not released under the MIT License.", "denied"), ("It was never\n# released under the MIT License.", "denied"), ("This isn't licensed under CC BY 4.0.", "denied"),
        ("No warranty. Released under the MIT License.", "exact"), ("It is not sold but released under the MIT License.", "exact"), ("Not free of bugs, released under the MIT License.", "exact"), ("Released under the MIT License.", "exact"),
    ],
)
def test_denied_licenses(text, verdict):
    assert [r[5] for r in licenses.Scanner().scan(text)] == [verdict]


def test_spdx_expressions():
    text = "int a;\n// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\nint b; # SPDX-License-Identifier: ISC\nMIT License"
    got = licenses.Scanner().scan(text)
    assert [(r[1], r[5]) for r in got] == [("MIT", "exact"), ("Apache-2.0", "exact"), ("GPL-2.0", "exact"), ("ISC", "exact"), ("MIT", "exact")]
    assert [text[r[0] :].split()[0].strip("()") for r in got] == ["SPDX-License-Identifier:", "Apache-2.0", "GPL-2.0-only", "SPDX-License-Identifier:", "MIT"]
    assert licenses.spread(text)[0].count("SPDX-License-Identifier:") == 4
    for one in ("SPDX-License-Identifier: MIT", "SPDX-License-Identifier: MIT\nOR not", "x SPDX-License-Identifier: "):
        moved, back = licenses.spread(one)
        assert moved == one and all(back(i) == i for i in range(len(one)))


def test_license_edges(spark):
    d = docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (None, "Released under the MIT License.", "en", None), (3, "Released under the MIT License.", "en", "a"), (3, "Released under the MIT License.", "en", "a")])
    got = licenses.scan(d.withColumn("license", F.lit("mine"))).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "None"]
    assert licenses.scan(d.limit(0)).count() == 0
    assert {r["verdict"] for r in licenses.scan(d, templates=()).collect()} == {"unknown"}


# line dedup


def test_boilerplate_by_host(spark):
    rows = [(i, f"menu\nown {i}\n\n  menu ", "en", "a" if i < 20 else "b") for i in range(24)]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs(spark, rows), "source", min_pages=5).collect()}
    assert got[0]["text"] == "own 0\n" and got[0]["lines_dropped"] == 2 and got[0]["lines_in"] == 4
    assert got[23]["text"] == rows[23][1]  # four pages are too few


def test_broadcast_and_salted_join_agree(spark):
    rows = [(i, f"top\n{'x' if i % 3 else 'y'}\nline {i}", "en", f"h{i % 2}") for i in range(40)]
    a, b = (sorted(map(tuple, line_dedup.drop_boilerplate(docs(spark, rows), "source", broadcast_rows=n).select("doc_id", "text").collect())) for n in (10**6, 0))
    assert a == b


def test_clashing_names_and_hosts(spark):
    rows = [(i, f"menu\nown {i}", "en", "http://www.A.org/x") for i in range(9)]
    names = ("ld_host", "ld_keys", "ld_kept", "ld_salt", "ld_hit", "LD_LINES", "ld_hashes")
    d = docs(spark, rows).withColumn("site", line_dedup.host_of(F.col("source"))).withColumns({n: F.lit("mine") for n in names})
    for limit in (10**6, 0):
        got = line_dedup.drop_boilerplate(d, "site", broadcast_rows=limit)
        assert got.columns == [*d.columns, "lines_in", "lines_dropped"]
        assert {(r["site"], r["text"], *(r[n] for n in names)) for r in got.collect()} == {("a.org", f"own {i}", *["mine"] * 7) for i in range(9)}


def test_line_edges(spark):
    d = docs(spark, [(1, None, "en", None), (2, "", "en", None), (None, "z", None, "s"), (4, "z", "en", "s"), (4, "z", "en", "s")]).withColumn("lines_in", F.lit("old"))
    got = line_dedup.drop_boilerplate(d, "source", min_pages=2).orderBy(F.col("doc_id")).collect()
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[1]["lines_in"] == 0 and by[2]["text"] == "" and by[2]["lines_in"] == 1 and by[4]["text"] == ""
    assert line_dedup.drop_boilerplate(d.limit(0), "source").count() == 0


# decontamination

QUESTION = "A train leaves Paris at 9 o'clock and covers 120 km each hour until it reaches Lyon after 4 hours of travel without a stop"
ITEMS = "item_id long, text string"


def leaks(spark, rows, items=((1, QUESTION),), **options):
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(docs(spark, [(i, t, "en", "s") for i, t in rows]), spark.createDataFrame(list(items), ITEMS), **options).collect()}


def test_copies_and_changed_slots(spark):
    other = QUESTION.replace("Paris", "Rome").replace("120", "95").replace("4 hours", "7 hours")
    clean = "The river runs past the old mill and on to the sea, and nobody in the village knows how old the mill is today"
    rows = [(1, f"Before. {QUESTION}. After."), (2, f"Some words, then: {other}"), (3, clean), (4, None), (5, "")]
    assert leaks(spark, rows) == {(1, 1): "exact", (2, 1): "reparameterised"}
    assert leaks(spark, rows, broadcast_windows=0) == {(1, 1): "exact", (2, 1): "reparameterised"}


def test_inconsistent_slots_are_no_leak(spark):
    item = "Anna gives 5 apples to Bert and then Anna takes 5 apples back from Bert before Anna eats 5 apples with Bert in the park"
    bad = item.replace("Anna takes 5", "Carl takes 6")
    assert leaks(spark, [(1, item), (2, bad)], [(7, item)]) == {(1, 7): "exact"}


def test_each_occurrence_is_judged_by_itself(spark):
    other = QUESTION.replace("Paris", "Rome").replace("9", "8").replace("120", "95").replace("Lyon", "Bern").replace("4 hours", "7 hours")
    longer = other.replace("each hour until", "in each single hour until")
    merged = QUESTION.replace("Lyon", "Paris")  # two values of the item become one
    rows = [(1, f"{QUESTION}. {other}."), (2, f"{other}. {QUESTION}. {other}."), (3, f"{longer}. {QUESTION.replace('each hour', 'each full hour')}. {longer}."), (4, merged)]
    assert leaks(spark, rows) == {(1, 1): "exact", (2, 1): "exact", (3, 1): "exact", (4, 1): "reparameterised"}
    both = leaks(spark, rows[:1], [(1, QUESTION), (2, other)])
    assert both == {(1, 1): "exact", (1, 2): "exact"}


def test_short_items_after_a_plain_word(spark):
    items = [(1, "What is the capital of France?"), (2, "Which river runs through the old town of the kings?"), (3, "Tom Smith has how many apples in the two old baskets?"), (4, "Name the largest sea")]
    rows = [(i, f"and he then asked the class {t} They did not know.") for i, t in items]
    rows += [(i + 10, f"and he then asked the class: {t} They did not know.") for i, t in items] + [(21, "and so he asked What is the capital of Spain? They knew."), (22, "and then Ann Smith has how many apples in the two old baskets?")]
    want = {(i + more, i): "exact" for i, _ in items for more in (0, 10)}
    assert leaks(spark, rows, items) == want | {(21, 1): "reparameterised", (22, 3): "reparameterised"}


def test_leak_edges(spark):
    short = [(1, "too short"), (2, None), (3, "just four plain words")]
    assert leaks(spark, [(1, "x just four plain words y"), (2, "too short")], short) == {(1, 3): "exact"}
    assert leaks(spark, [(1, QUESTION)], []) == {} and leaks(spark, []) == {}
    d = docs(spark, [(None, QUESTION, "en", "s"), (2, None, "en", "s"), (3, "fine text", "en", "s"), (3, QUESTION, "en", "s"), (4, QUESTION, "en", "s"), (4, QUESTION, "en", "s")])
    left = decontaminate.drop_leaks(d, spark.createDataFrame([(1, QUESTION)], ITEMS))
    assert left.columns == d.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    names = d.withColumns({n: F.lit("mine") for n in ("lk_id", "gone_id", "GONE_HASH", "dc_id", "bm_item", "item_id", "kind")})
    kept = decontaminate.drop_leaks(names, spark.createDataFrame([(1, QUESTION)], ITEMS).withColumn("bm_words", F.lit("mine")))
    assert kept.columns == names.columns and kept.count() == 2
    long = docs(spark, [(1, "word " * 200_000 + QUESTION, "en", "s"), (2, "word " * 200_000, "en", "s")])
    assert [r["doc_id"] for r in decontaminate.drop_leaks(long, spark.createDataFrame([(1, QUESTION)], ITEMS)).collect()] == [2]


def test_long_runs_of_names_and_numbers(spark):
    runs = ["Von " * 30_000, "7." * 30_000, "1:2,3/" * 10_000]
    rows = [(i, f"{a} and so on. {QUESTION} Then {b}") for i, (a, b) in enumerate(zip(runs, runs[1:] + runs[:1]))] + [(9, " ".join(runs))]
    assert leaks(spark, rows) == {(i, 1): "exact" for i in range(3)}


def test_benchmark_passages_in_documents_are_found(spark, small):
    """Every document that holds a whole item word for word is found."""
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    found = {(r["doc_id"], r["item_id"]) for r in registry.QUERIES["op5_decontaminate"](spark, small).collect()}
    whole = {(d["doc_id"], i["item_id"]) for d in spark.read.parquet(f"{small}/documents.parquet").collect() for i in items if i["text"] and len(i["text"].split()) > 8 and i["text"] in (d["text"] or "")}
    assert whole and whole <= found


# mixing


def test_raking_meets_the_marginals(spark):
    cells = spark.createDataFrame([("a", "x", 60), ("a", "y", 20), ("b", "x", 5), ("b", "y", 15)], "source string, lang string, tokens long")
    targets = {d: spark.createDataFrame(rows, f"{d} string, target double") for d, rows in (("source", [("a", 0.5), ("b", 0.5)]), ("lang", [("x", 0.4), ("y", 0.6)]))}
    got = mixing.rake(cells, targets).toPandas()
    assert got.groupby("source").weight.sum().tolist() == pytest.approx([0.5, 0.5]) and got.groupby("lang").weight.sum().tolist() == pytest.approx([0.4, 0.6])


def test_sample_by_hash(spark):
    d = docs(spark, [(i, "some plain words here " * (1 + i % 3), "en" if i % 4 else "fr", "s" if i % 5 else None) for i in range(300)])
    got = mixing.mix(d).collect()
    for r in got:
        u = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert u < r["probability"]
    assert 0 < len(got) < 300
    salted = mixing.mix(d, small_cells=0, tolerance=1e-6)
    assert sorted(r["doc_id"] for r in salted.collect()) == sorted(r["doc_id"] for r in got)


def test_random_tables_are_fitted_to_the_marginals(spark):
    import random

    rng = random.Random(8)
    rows = [(f"s{i}", f"l{j}", f"t{k}", rng.choice([0, 1, 20, 5000])) for i in range(6) for j in range(4) for k in range(3)] + [("tiny", "l0", "t0", 1)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    got = mixing.calibrated(cells, rate=0.4).toPandas()
    for d, target in mixing.tempered_targets(cells).items():
        want = target.toPandas().set_index(d).target
        assert (got.groupby(d).weight.sum() - want).abs().max() < 1e-6
    assert got.residual.max() < 1e-6
    assert (got.tokens * got.probability).sum() == pytest.approx(0.4 * got.tokens.sum(), rel=1e-6) and got.probability.between(0, 1).all()
    kept = got.tokens * got.probability * got.factor  # with factors the sample meets the targets
    assert (kept.groupby(got.source).sum() / kept.sum() - got.groupby("source").weight.sum()).abs().max() < 1e-6
    # the grouped form agrees
    big = mixing.calibrated(cells, rate=0.4, small_cells=0, tolerance=1e-5).toPandas()
    keys = ["source", "lang", "topic"]
    both = got.merge(big, on=keys)
    assert len(both) == len(rows) and (both.probability_x - both.probability_y).abs().max() < 1e-2
    # two targets that no table with these zeros can meet
    odd = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "source string, lang string, tokens long")
    goals = {d: spark.createDataFrame(r, f"{d} string, target double") for d, r in (("source", [("a", 0.9), ("b", 0.1)]), ("lang", [("x", 0.1), ("y", 0.9)]))}
    assert mixing.rake(odd, goals, max_rounds=20).first()["residual"] > 0.5


def test_targets_and_tiny_cells(spark):
    rows = [(i, "word " * 1000, "en" if i % 3 else "de", f"s{i % 4}") for i in range(400)] + [(1000, "one", "en", "lone")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert 130 < len(got) < 270 and any(r["doc_id"] == 1000 for r in got)
    even = mixing.mix(docs(spark, rows), targets={"lang": {"en": 0.5, "de": 0.5}}, topic=F.col("source")).collect()
    share = sum(r["factor"] for r in even if r["lang"] == "de") / sum(r["factor"] for r in even)
    assert 0.4 < share < 0.6 and {f"s{i}" for i in range(4)} <= {r["topic"] for r in even}
    only = mixing.mix(docs(spark, rows), targets={"lang": {"de": 1.0}}, rate=0.1).collect()
    assert only and {r["lang"] for r in only} == {"de"}


def test_mix_edges(spark):
    d = docs(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "word", None, "s"), (3, "word", None, "s"), (None, "word", "en", None)]).withColumn("topic", F.lit("mine"))
    got = mixing.mix(d).collect()
    assert {r["doc_id"] for r in got} <= {3, None} and all(r["topic"] == "prose" for r in got)
    long = mixing.mix(d.limit(0).union(docs(spark, [(i, "word " * 300_000, "en", "s") for i in range(3)]).withColumn("topic", F.lit("mine"))), rate=1.0)
    assert [r["tokens"] for r in long.collect()] == [300_000] * 3
    names = docs(spark, [(i, "word", "en", "s") for i in range(9)]).withColumns({"mx_source": F.lit("mine"), "mx_lang": F.lit("mine"), "mx_salt": F.lit("mine"), "weight": F.lit("mine")})
    got = mixing.mix(names, rate=1.0)
    assert {tuple(r[c] for c in ("mx_source", "mx_lang", "mx_salt", "weight")) for r in got.collect()} == {("mine",) * 4} and got.count() == 9
    assert mixing.mix(d.limit(0)).count() == 0


UNITS = "km kg cm mm ml mi ft m g l lb lbs hour hours minute minutes second seconds day days week weeks month months year years mile miles meter meters metre metres gram grams liter liters litre litres dollar dollars euro euros percent % € °C °F".split()


def read(text):
    """(words, slots) by a scanner of its own: placeholders are <n>, <#> and <u>."""
    import unicodedata

    kind = [unicodedata.category(c) for c in text] + ["Zs"]
    wordy = lambda i: kind[i][0] in "LN"
    words, slots, i, name_end = [], [], 0, None
    while i < len(text):
        j = i
        if kind[i] == "Nd":
            while True:
                while kind[j] == "Nd":
                    j += 1
                if j + 1 < len(text) and text[j] in ".,:/" and kind[j + 1] == "Nd":
                    j += 1
                else:
                    break
            words.append("<#>")
            slots.append("#" + text[i:j])
            k = j + (text[j : j + 1] == " ")
            for u in UNITS:
                if text.startswith(u, k) and not wordy(k + len(u)):
                    words.append("<u>")
                    slots.append("u" + u.lower())
                    j = k + len(u)
        elif wordy(i):
            while wordy(j) and kind[j] != "Nd":
                j += 1
            word = text[i:j]
            if (i == 0 or not wordy(i - 1)) and not wordy(j) and len(word) > 1 and kind[i] == "Lu" and set(kind[i + 1 : j]) == {"Ll"} and word not in decontaminate.PLAIN.split():
                if name_end == i - 1 and text[i - 1] == " ":
                    slots[-1] += word.lower()
                else:
                    words.append("<n>")
                    slots.append("n" + word.lower())
                name_end = j
            else:
                words.append(word.lower())
                slots.append(None)
        else:
            j += 1
        i = j
    return words, slots


def naive_leaks(docs_rows, items, window=8, coverage=0.3, least=5):
    """The whole operator by its definition, window by window and place by place."""
    import math

    out = {}
    readings = [(i, *read(t)) for i, text in items if text for t in dict.fromkeys([text, text.lower()])]
    for doc, text in docs_rows:
        if text is None:
            continue
        words, slots = read(text)
        at = {}
        for s in {min(window, len(w)) for _, w, _ in readings if len(w) >= decontaminate.MIN_WORDS}:
            for p in range(len(words) - s + 1):
                at.setdefault(tuple(words[p : p + s]), []).append(p)
        for item, iw, islots in readings:
            if len(iw) < decontaminate.MIN_WORDS:
                continue
            s = min(window, len(iw))
            n = len(iw) - s + 1
            need = max(min(least, n), math.ceil(n * coverage))
            hits = [(p, q) for p in range(n) for q in at.get(tuple(iw[p : p + s]), ())]
            if len({p for p, _ in hits}) < need:
                continue
            places = {}
            for p, q in hits:
                shift = q - p
                for place in ((0, shift), (1, shift // len(iw)), (2, math.floor(shift / len(iw) + 0.5)), (3, 0)):
                    places.setdefault(place, []).append((p, q))
            for own in places.values():
                pairs = set()
                for p, q in own:
                    for k in range(s):
                        i, d = islots[p + k], slots[q + k]
                        if i is not None:
                            ends = p + k == 0 and d.endswith(i[1:]) or p + k == len(iw) - 1 and d.startswith(i)
                            pairs.add((i, i if ends else d))
                if len({p for p, _ in own}) >= need and len(pairs) == len({a for a, _ in pairs}):
                    best = len({p for p, _ in own}), all(a == b for a, b in pairs)
                    out[doc, item] = max(best, out.get((doc, item), best))
    return {k: "exact" if exact else "reparameterised" for k, (_, exact) in out.items()}


def test_leaks_equal_plain_python(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in registry.QUERIES["op5_decontaminate"](spark, small).collect()}
    assert got and got == naive_leaks(rows, items)


def test_hard_leaks_equal_plain_python(spark):
    import random

    rng = random.Random(5)
    items = [(1, QUESTION), (2, "Alice has 3 apples and 5 pears?"), (3, "What is the capital of France?"), (4, "Tom Smith runs 5km, then 2.5 km and 10 miles with Ann before Tom Smith rests for 30 minutes, so how far did Tom Smith run that day?"), (5, None), (6, "too short")]
    swap = ["Paris", "Rome", "Bob", "Ann", "Tom Smith", "120", "7", "3", "apples", "km", "hours", "The"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = (items[rng.randrange(4)][1]).split(" ")
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(swap)
            text = " ".join(words)
            parts.append(rng.choice([text, text, text.lower(), text.upper(), "said Carl " + text]))
        rows.append((i, rng.choice([" ", ". ", "\n"]).join(parts)))
    want = naive_leaks(rows, items)
    assert leaks(spark, rows, items) == want and len(set(want.values())) == 2
    assert leaks(spark, rows, items, broadcast_windows=0, broadcast_docs=0) == want


def test_leaks_by_definition(spark):
    item = "The farm sells 12 eggs to Mary, 30 eggs to John and 7 eggs to the shop, so how many eggs does the farm sell in one day?"
    other = item.replace("12", "9").replace("30", "41").replace("Mary", "Rose")
    rows = [
        (1, f"{item} {other}"), (2, f"{item} Then 99 eggs to Mary, 31 eggs to Fred and 7 eggs to no one."), (3, item.replace("12", "5").replace("30", "5")), (4, item.lower()), (5, item.upper()),
        (6, "Bob has 4 apples and 7 pears?"), (7, "alice has 3 apples and 5 pears?"), (8, item.replace("eggs", "nuts").replace("farm", "shop")), (9, "He covers 5 miles at 9 o'clock, and 120 kg each hour."), (10, "one yes"),
    ]
    items = [(1, item), (2, "Alice has 3 apples and 5 pears?"), (3, "He covers 5 km at 9 o'clock, and 120 kg each hour."), (4, "yes")]
    want = {(1, 1): "exact", (2, 1): "exact", (3, 1): "reparameterised", (4, 1): "exact", (5, 1): "exact", (6, 2): "reparameterised", (7, 2): "exact", (9, 3): "reparameterised"}
    assert leaks(spark, rows, items) == want
    assert leaks(spark, rows, items, min_words=1) == want | {(10, 4): "exact"}


def test_contradictory_targets_say_so(spark):
    rows = [(i, "some words here", "de" if i < 150 else "en", "t" if i < 150 else "s") for i in range(300)]
    got = mixing.mix(docs(spark, rows), targets={"source": {"s": 0.9, "t": 0.1}, "lang": {"de": 0.9, "en": 0.1}}, rate=0.5).select("residual").distinct().collect()
    assert len(got) == 1 and got[0][0] > 0.5
    assert mixing.mix(docs(spark, rows), rate=0.5).agg(F.max("residual")).first()[0] <= mixing.TOLERANCE
