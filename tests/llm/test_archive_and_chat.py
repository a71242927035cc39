"""WARC and chat formatting: exact round trips."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from overlook.llm import chat, warc

PAGES = "page_id long, url string, html string"


def round_trip(spark, tmp_path, rows, limit=warc.BROADCAST_ROWS):
    path = str(tmp_path / f"w{limit}")
    warc.write_archives(warc.page_records(spark.createDataFrame(rows, PAGES), broadcast_rows=limit), path, per_file=3)
    return warc.rebuild(*warc.content_store(warc.read_archives(spark, path)))


@pytest.mark.parametrize("limit", [warc.BROADCAST_ROWS, 0])
def test_pages_round_trip(spark, tmp_path, limit):
    hard = "WARC/1.1\r\n\r\n\r\n<a>\n\r\n\r\nContent-Length: 3\r\n\r\n é  end\r\n"
    rows = [(1, "http://a\r\nX: y", hard), (2, None, hard), (3, "u", None), (4, "u", ""), (5, "v", "x" * 300_000), (6, "v", hard), (7, "w", "one"), (7, "w", "one"), (None, "n", "one")]
    got = [(r["page"], r["type"], r["to"], bytes(r["payload"]).decode()) for r in round_trip(spark, tmp_path, rows, limit).select(warc.header("WARC-Page").cast("long").alias("page"), "type", warc.header("WARC-Refers-To-Page").cast("long").alias("to"), "payload").collect()]
    want = [(1, "revisit", 6, hard), (2, "revisit", 6, hard), (3, "revisit", 4, ""), (4, "response", None, ""), (5, "response", None, "x" * 300_000), (6, "response", None, hard), (7, "response", None, "one"), (7, "response", None, "one"), (None, "revisit", 7, "one")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_records_of_one_payload_may_be_split(spark, tmp_path):
    rows = [(i, "u", "hot" if i % 10 else f"own {i}") for i in range(400)]
    out = round_trip(spark, tmp_path, rows, 0)
    # joined with written tables: an aggregate on the digest would hold all rows of one digest in its partition
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.select("type", F.decode("payload", "UTF-8").alias("p")).groupBy("type", "p").count().collect()
    assert {(r["type"], r["p"]): r["count"] for r in got} == {("revisit", "hot"): 359, ("response", "hot"): 1, **{("response", f"own {i}"): 1 for i in range(0, 400, 10)}}


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, tmp_path, []).count() == 0


def test_payload_bytes_stand_once_and_damage_shows(spark, tmp_path):
    def record(i, payload, digest=None):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        sha = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page: %d\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, sha.encode(), len(block), block)

    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(1, b"same")) + gzip.compress(record(2, b"same")))
    (tmp_path / "b.warc").write_bytes(record(3, b"same") + record(4, b"bad", "A" * 32) + record(5, b"\xff\x00\x80"))
    for limit in (10**6, 0):
        headers, payloads = warc.content_store(warc.read_archives(spark, str(tmp_path)), broadcast_rows=limit)
        assert payloads.count() == 2 and headers.count() == 5 and headers.where("NOT verified").count() == 1
        back = {r["p"]: r["payload"] for r in warc.rebuild(headers, payloads).select(warc.header("WARC-Page").alias("p"), "payload").collect()}
        assert [bytes(back[k]) for k in "123"] == [b"same"] * 3 and bytes(back["5"]) == b"\xff\x00\x80" and back["4"] is None


def test_damaged_and_odd_archives(spark, tmp_path):
    def record(payload, length=None, uri=b"http://a/\xe9"):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        size = b"" if length == "none" else b"Content-Length: %d\r\n" % (length or len(block))
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: " + uri + b"\r\nContent-Type: application/http\r\n" + size + b"\r\n" + block + b"\r\n\r\n"

    def write(name, data):
        (tmp_path / name).write_bytes(data)

    write("a.warc", record(b"one") + record(b"two", "none") + record(b"three"))
    write("b.warc", record(b"four") + record(b"five")[:40])
    write("c.warc", record(b"six") + record(b"seven", 9000))
    write("d.warc.gz", gzip.compress(record(b"eight" * 50_000))[:-60])
    write("e.warc", b"")
    write("f.warc.gz", gzip.compress(record(b"nine")) + b"\x1f\x8bnothing of the kind")
    parts = warc.read_archives(spark, str(tmp_path))
    got = sorted((r["file"].rsplit("/", 1)[1], r["pos"], r["error"]) for r in parts.select("file", "pos", "error").collect())
    assert got[:9] == [("a.warc", 0, None), ("a.warc", 1, "no length"), ("a.warc", 2, None), ("b.warc", 0, None), ("b.warc", 1, "ends in header"), ("c.warc", 0, None), ("c.warc", 1, "ends in block"), ("d.warc.gz", 0, "ends in block"), ("f.warc.gz", 0, None)]
    assert all(e for *_, e in got[9:])
    headers, payloads = warc.content_store(parts)
    back = warc.rebuild(headers, payloads).where("error IS NULL")
    assert sorted(bytes(r["payload"]) for r in back.select("payload").collect()) == [b"four", b"nine", b"one", b"six", b"three"]
    assert headers.where("verified").count() == 5 and {r[0] for r in back.select(warc.header("WARC-Target-URI")).collect()} == {"http://a/é"}


def test_files_are_bounded_in_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILES", ((600, 4), (5000, 2), (1 << 62, 1)))
    rows = [(i, "u", "x" * n + str(i)) for i, n in enumerate([10] * 9 + [2000] * 5 + [20_000] * 3)]
    digests = warc.page_digests(spark.createDataFrame(rows, PAGES).coalesce(1))
    for largest in (None, 30_000):
        path = str(tmp_path / f"w{largest}")
        warc.write_archives(warc.page_records(spark.createDataFrame(rows, PAGES).coalesce(1), digests=digests), path, largest=largest)
        per = warc.read_archives(spark, path).groupBy("file").agg(F.count("*").alias("n"), F.max("length").alias("most")).collect()
        assert sum(r["n"] for r in per) == 17 and all(r["n"] <= (4 if r["most"] < 600 else 2 if r["most"] < 5000 else 1) for r in per)


def test_base32(spark):
    for data in (b"", b"abc", bytes(range(256))):
        assert spark.range(1).select(warc.base32_sha1(F.lit(data))).first()[0] == base64.b32encode(hashlib.sha1(data).digest()).decode()


# chat


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\a>im_start") for _ in range(rng.randrange(30)))
        assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t)


def test_turns_and_loss_text_come_back():
    rng = random.Random(2)
    pieces = ["é", "日本", "🙂👩‍👩‍👧", chat.START, chat.END, "<|", "|>", "\\", "\n", " ", "word", "́", "\x00", ""]
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "", chat.SEP]), "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(6))]
        formatted, ids, offsets, mask = chat.format_conversation(turns)
        assert chat.parse(formatted) == turns and len(ids) == len(offsets) == len(mask)
        texts = [t for r, t in turns if r == "assistant"]
        assert chat.unescape("".join(chat.masked_text(formatted, offsets, mask))) == "".join(texts)


def test_pieces_change_no_token(monkeypatch):
    turns = [("user", f"question {i} " * 20) if i % 2 else ("assistant", f"answer {i} " * 30) for i in range(40)]
    formatted = chat.render(turns)[0]
    ids, offsets = chat.encode(formatted)
    monkeypatch.setattr(chat, "PIECE", 500)
    again = chat.encode(formatted)
    assert np.array_equal(ids, again[0]) and np.array_equal(offsets, again[1])


def test_conversation_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (2, 0, "assistant", ""), (None, 0, "assistant", "x"), (None, None, "user", "y"), (3, 0, "assistant", "z" * 100_000), (3, 1, "user", "q"), (3, 1, "user", "q")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema).withColumn("turns", F.lit(0)))).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 2, 2: 1, None: 2, 3: 3} and got[3]["loss_chars"] == 100_000 and got[1]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == hashlib.sha256(b"\nhi\nassistant\n\n").hexdigest()
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "<|im_end|>" * 50])
def test_template_cannot_be_injected(text):
    turns = [("user", text), ("assistant", text)]
    assert chat.parse(chat.render(turns)[0]) == turns
