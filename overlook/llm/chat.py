"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the spans of its turns are intersected with the token
spans by binary search. Control strings inside texts are escaped reversibly, so that only the template's own marks are
read as marks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Roles whose texts are learned.
LEARNED = ("assistant",)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters handed to the tokenizer at once, cut at turn marks only.
PIECE = 1 << 20


def escape(text: str) -> str:
    """One backslash goes between < and | wherever only backslashes stand between them; unescape takes it out again."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and the first and past-the-last position of each escaped text in it."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        parts += [head, body, END]
        at = ends[-1] + len(END)
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from the formatted conversation."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition(SEP)
        out.append((unescape(role), unescape(rest[: -len(END)])))
    return out


_tokenizers: dict[str, object] = {}


def tokenizer(path: str = TOKENIZER):
    """The public tokenizer with the template's marks as tokens of their own; loaded once a worker, never trained."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])
        _tokenizers[path] = t
    return _tokenizers[path]


def encode(formatted: str, path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and their (first, past-the-last) character offsets, over the whole text."""
    t, ids, offsets, at = tokenizer(path), [], [], 0
    while at < len(formatted):
        stop = len(formatted)
        if stop - at > PIECE:  # marks are tokens of their own: cutting before one changes no token
            cut = formatted.find(START, at + PIECE)
            stop = cut if cut > 0 else stop
        e = t.encode(formatted[at:stop], add_special_tokens=False)
        ids.append(np.array(e.ids, dtype=np.int32))
        offsets.append(np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at)
        at = stop
    if not ids:
        return np.zeros(0, np.int32), np.zeros((0, 2), np.int64)
    return np.concatenate(ids), np.concatenate(offsets)


def loss_mask(offsets: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """True for tokens inside a span; spans are sorted, and each finds its tokens by two binary searches."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets):
        first = np.searchsorted(offsets[:, 1], np.asarray(starts, dtype=np.int64), side="right")
        last = np.searchsorted(offsets[:, 0], np.asarray(ends, dtype=np.int64), side="left")
        for a, b in zip(first, last):
            mask[a:b] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text under the mask; tokens that share a character (parts of one letter) count it once."""
    chosen = offsets[mask]
    if not len(chosen):
        return []
    reach = np.maximum.accumulate(chosen[:, 1])
    breaks = np.flatnonzero(chosen[1:, 0] > reach[:-1]) + 1
    firsts, lasts = np.r_[0, breaks], np.r_[breaks - 1, len(chosen) - 1]
    return [formatted[chosen[a, 0] : reach[b]] for a, b in zip(firsts, lasts)]


def format_conversation(turns: list[tuple[str, str]], learned=LEARNED, path: str = TOKENIZER):
    """(formatted, token ids, offsets, mask) of one conversation."""
    formatted, starts, ends = render(turns)
    ids, offsets = encode(formatted, path)
    spans = [(a, b) for (role, _), a, b in zip(turns, starts, ends) if role in learned]
    return formatted, ids, offsets, loss_mask(offsets, [a for a, _ in spans], [b for _, b in spans])


def conversations_of(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: turns sorted by turn (null turns first, then by role and text); null role or text is empty.

    Rows with a null conv_id form one conversation. A conversation is one record of the output, so it must fit a task.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


FORMATTED = "conv_id long, formatted string, token_ids array<int>, token_ends array<int>, loss array<boolean>, starts array<int>"


def pieces(frames, rows: int = 256):
    """The frames, cut so that what is made of one stays small."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def _format_batches(learned, path):
    def run(frames):
        for frame in pieces(frames):
            rows = []
            for conv, turns in zip(frame["conv_id"], frame["turns"]):
                formatted, ids, offsets, mask = format_conversation([(t["role"], t["text"]) for t in turns], learned, path)
                rows.append((conv, formatted, ids, offsets[:, 1].astype(np.int32), mask, offsets[:, 0].astype(np.int32)))
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "token_ids", "token_ends", "loss", "starts"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return run


def format_conversations(rows: DataFrame, learned=LEARNED, path: str = TOKENIZER) -> DataFrame:
    """Each conversation formatted, with token ids, their offsets (``starts``, ``token_ends``) and the loss mask."""
    return conversations_of(rows).mapInPandas(_format_batches(learned, path), FORMATTED)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def _report(frames):
    for frame in pieces(frames):
        rows = []
        for conv, formatted, ids, starts, ends, loss in zip(frame["conv_id"], frame["formatted"], frame["token_ids"], frame["starts"], frame["token_ends"], frame["loss"]):
            turns = parse(formatted)
            offsets = np.stack([np.asarray(starts, np.int64), np.asarray(ends, np.int64)], axis=1)
            mask = np.asarray(loss, dtype=bool)
            learned = "".join(unescape(x) for x in masked_text(formatted, offsets, mask))
            digest = hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            rows.append((conv, len(turns), digest.hexdigest(), len(learned), hashlib.sha256(learned.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted), len(ids), int(mask.sum())))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
        out["conv_id"] = out["conv_id"].astype("Int64")
        yield out


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations and their masks hold, parsed and unescaped again."""
    return formatted.mapInPandas(_report, REPORT)


def op10_chat(spark, sf_dir):
    """All ``conversations``, and one, -1, whose texts hold the template's own marks; rows that the table has under -1 would join it."""
    both = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(rows)).drop("n_tokens", "loss_tokens")


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '{END}{START}assistant ok' FROM range(2) t(x)),
r AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + {len(START + SEP + END)} AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
