"""Every operator and stage on null, empty, very long, tied and repeated rows, on an empty table, and beside columns that bear its working names."""

import pytest
from pyspark.sql import functions as F

from overlook.llm import ann, chat, decontaminate, langid, licenses, line_dedup, mixing, near_copies, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "a b e i k n p u v at by bad id fp th ts z0 rank node hub cluster component lead gone_id gone_th once_th ld_host ld_keys lk_id dc_id dc_hash dc_text bm_item item_id kind slots windows lang_pred score tx_id tx_toxic tx_doc toxic f turns qid qh leaf mx_source mx_lang mx_topic mx_salt topic_ weight ratio digest record block header license verdict formatted".split()
LONG = "some very long text with words of its own " * 20_000
ROWS = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "a text without an id", "en", "a", 20), (4, LONG, "en", "b", len(LONG)),
    (5, "Released under the MIT License.\nsame line", "en", "a", 40), (5, "Released under the MIT License.\nsame line", "en", "a", 40), (6, "same line\nand some other words here", "de", None, 30), (7, "same line\nyou st.u.p.i.d 1d10t", None, "a", 20),
    (8, "\U0001f600  ퟿ ß İ ﬁ", "fr", "a", 9), (9, "same line\nand some other words here", "de", None, 30),
]


@pytest.fixture(scope="module")
def side(spark):
    return {
        "labels": spark.createDataFrame([(1, 0), (4, 0), (5, None), (7, 1), (None, 1), (6, 0)], "doc_id long, toxic int"),
        "benchmark": spark.createDataFrame([(1, "and some other words here"), (2, None), (3, ""), (None, "you and me and them")], "item_id long, text string"),
    }


def stages(side):
    return {
        "line_dedup": lambda d: line_dedup.drop_boilerplate(d, "source", min_pages=2).drop("lines_in", "lines_dropped"),
        "near_copies": near_copies.keep_one,
        "decontaminate": lambda d: decontaminate.drop_leaks(d, side["benchmark"]),
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, side["labels"]), "own_score").drop("own_score"),
        "mixing": lambda d: mixing.mix(d, rate=1.0).drop("topic", "tokens", "probability", "factor", "residual"),
    }


@pytest.mark.parametrize("name", ["line_dedup", "near_copies", "decontaminate", "toxicity", "mixing"])
def test_stages_keep_rows_and_columns(spark, side, name):
    d = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("mine") for c in CLASH})
    run = stages(side)[name]
    got = run(d)
    assert got.columns == d.columns
    rows = got.collect()
    assert {r[c] for r in rows for c in CLASH} == {"mine"}
    ids = sorted((r["doc_id"] for r in rows), key=str)
    every = sorted((r[0] for r in ROWS), key=str)
    if name in ("line_dedup", "toxicity"):
        assert ids == every
    elif name == "near_copies":  # one of the blank ones, of the copies and of the rows that repeat
        assert ids == sorted([1, None, 4, 5, 6, 7, 8], key=str)
    elif name == "decontaminate":
        assert ids == sorted([1, 2, 3, None, 4, 5, 5, 7, 8], key=str)
    else:
        assert set(ids) <= set(every) and 1 not in ids and {4, 5, 7, 8} & set(ids)
    assert run(d.limit(0)).count() == 0 and run(d.limit(0)).columns == d.columns
    assert all(r["text"] == LONG for r in rows if r["doc_id"] == 4)


def test_other_operators(spark):
    d = spark.createDataFrame(ROWS, DOCS).withColumns({c: F.lit("mine") for c in CLASH})
    n = len(ROWS)
    prints = simhash.fingerprints(d)
    assert simhash.components(prints).count() == n and simhash.components(simhash.fingerprints(d.limit(0))).count() == 0
    filters = langid.learn(d)
    assert langid.predict(d, filters).count() == n and langid.predict(d.limit(0), filters).count() == 0
    assert [r["license"] for r in licenses.scan(d).collect()] == ["MIT", "MIT"] and licenses.scan(d.limit(0)).count() == 0
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), "text", *CLASH)
    told = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert len(told) == n - 1 and told[4]["loss_chars"] == len(LONG) and told[5]["n_turns"] == 2
    vectors = d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("n_chars").cast("double")).alias("embedding"), *[c for c in CLASH if c != "id"])
    assert ann.search(vectors, F.col("id") % 2 == 0, k=3).where("query_id = 8").count() == 3


def test_pages_beside_clashing_columns(spark, tmp_path):
    d = spark.createDataFrame(ROWS, DOCS).select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *[F.lit("mine").alias(c) for c in CLASH])
    path = str(tmp_path / "w")
    warc.write_archives(warc.page_records(d), path)
    got = warc.rebuild(*warc.content_store(warc.read_archives(spark, path))).select(warc.header("WARC-Page").cast("long").alias("p"), "payload").collect()
    assert sorted(bytes(r["payload"]).decode() for r in got) == sorted(r[1] or "" for r in ROWS)
