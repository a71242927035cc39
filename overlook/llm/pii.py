"""Personal data: fixed patterns, and what a linear-chain conditional random field finds beside them.

The field labels tokens by the shapes of the words around them. It learns from a small table: sentences labelled by hand, and
stretches of the corpus around what the patterns find, some of them rewritten in the ways in which people write such data to
be read by people alone. Sequences are decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from overlook.llm.common import free_names, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# patterns

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match always takes the digits up to their end, so only the beginning of a run of digits can start one
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Whether the check digit of a card number is right."""
    every = [int(c) for c in reversed(number)]
    return (sum(every[::2]) + sum(sum(divmod(2 * d, 10)) for d in every[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each @ that a domain follows, as far to the left as the local part goes, but not into the last address."""
    free = 0
    for m in _DOMAIN.finditer(text):
        low = max(free, text.rfind("@", free, m.start()) + 1)
        before = text[low : m.start()]
        n = len(before) - len(before.rstrip(_LOCAL))
        if n:
            yield m.start() - n, m.end()
            free = m.end()


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` in code points, by kind, then place: linear in the text's length."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 38 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


# tokens and their features

LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
#: What follows what: an inner token needs its own kind before it.
ALLOWED = np.array([[b[0] != "I" or a[2:] == b[2:] for b in LABELS] for a in LABELS])
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9]+|@|[\[({<] ?(?:at|dot) ?[\])}>]|\bdot\b", re.IGNORECASE)
_BLANK = re.compile(r"\s")
#: Characters around a digit, an @ or a word for it within which anything can be personal data.
AROUND = 48
#: Words whose own form is a feature; others count by shape.
CUES = frozenset("at dot phone tel telephone call fax mobile cell telefon teléfono téléphone ruf card visa mastercard amex kreditkarte carte tarjeta ip host server address mail email e contact write page isbn year order invoice version no nr".split())
_PAD = "\x00"


def regions(text: str, around: int = AROUND) -> list[tuple[int, int]]:
    """Stretches near anything that could be personal data, widened to whole words; elsewhere every label but O is ruled out."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.end() + around <= out[-1][1]:
            continue
        least = out[-1][1] if out else 0
        a = m.start() - around
        while a > least and not text[a - 1].isspace():
            a -= 1
        gap = _BLANK.search(text, m.end() + around)
        b = gap.start() if gap else len(text)
        if out and a <= least:
            out[-1][1] = b
        else:
            out.append([max(a, 0), b])
    return [(a, b) for a, b in out]


def shape(token: str) -> str:
    """Digits by how many, letters by their case, anything else as it is."""
    if token == _PAD:
        return token
    if "0" <= token[0] <= "9":
        return f"d{min(len(token), 20)}"
    if token.isalpha():
        low = token.lower()
        return f"w:{low}" if low in CUES else "x" if token == low else "X" if token == token.upper() and len(token) > 1 else "Xx"
    return token


def detail(token: str) -> str:
    """A finer look at single tokens: first digits, size of numbers, endings of domains."""
    if "0" <= token[0] <= "9":
        return ("00" if token.startswith("00") else token[0]) + (f"<{len(token)}" if len(token) < 3 or int(token[:4]) > 255 or len(token) > 3 else "byte")
    return token.lower() if len(token) <= 3 else f"len{min(len(token), 12)}"


def templates(shapes: list[str], details: list[str], glued: list[bool]) -> list[list[tuple]]:
    """The features of every token, one list a template; sequences stand side by side with two blanks between."""
    n = len(shapes)
    at = lambda k: [_PAD] * max(0, -k) + shapes[max(0, k) : n + min(0, k)] + [_PAD] * max(0, k)
    p2, p1, s0, n1, n2, n3 = at(-2), at(-1), shapes, at(1), at(2), at(3)
    g0, g1 = glued, glued[1:] + [False]
    p3 = at(-3)
    return [list(zip(*t)) for t in ((s0,), (details,), (p1, g0), (n1, g1), (p2,), (n2,), (p1, g0, s0), (s0, g1, n1), (p2, p1, s0), (s0, n1, n2), (p1, s0, n1), (p3, p2, p1), (n1, n2, n3), (s0, n1, n2, n3), (p3, p2, p1, s0))]


@dataclass
class Sequences:
    """Tokens of many stretches, one after another: features by token, and where each stretch begins and ends."""

    features: list[list[tuple]]
    starts: np.ndarray
    lengths: np.ndarray
    spans: list[tuple[int, int]]


def sequences(stretches: list[tuple[str, int]]) -> Sequences:
    """``stretches``: texts and where in their document they begin."""
    tokens, glued, spans, starts, lengths = [], [], [], [], []
    for text, begin in stretches:
        starts.append(len(tokens))
        end = -1
        for m in _TOKEN.finditer(text):
            tokens.append(m[0])
            glued.append(m.start() == end)
            end = m.end()
            spans.append((begin + m.start(), begin + m.end()))
        lengths.append(len(tokens) - starts[-1])
        for _ in range(2):
            tokens.append(_PAD)
            glued.append(False)
            spans.append((begin, begin))
    return Sequences(templates([shape(t) for t in tokens], [detail(t) for t in tokens], glued), np.array(starts, np.int64), np.array(lengths, np.int64), spans)


# the field


@dataclass
class Field:
    """Weights of features (row 0 is for unknown ones) and of steps from label to label."""

    known: list[dict[tuple, int]]
    weights: np.ndarray
    steps: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def index(self, s: Sequences) -> np.ndarray:
        return np.array([[of.get(f, 0) for f in column] for of, column in zip(self.known, s.features)], np.int32).T

    def emissions(self, index: np.ndarray) -> np.ndarray:
        out = np.zeros((len(index), len(LABELS)))
        for column in index.T:
            out += self.weights[column]
        return out


def _batches(starts: np.ndarray, lengths: np.ndarray, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, int]]:
    """Sequences of like length together, as many as make ``cells`` tokens; none is cut, however long."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * lengths[order[at + n]] <= cells:
            n += 1
        yield order[at : at + n], int(lengths[order[at + n - 1]])
        at += n


def viterbi(emissions: np.ndarray, steps: np.ndarray, starts: np.ndarray, lengths: np.ndarray, allowed: np.ndarray = ALLOWED) -> np.ndarray:
    """The best label of every token; ties go to the label listed first. Tokens of no sequence get 0."""
    out = np.zeros(len(emissions), np.int8)
    move = np.where(allowed, steps, -np.inf)
    for rows, longest in _batches(starts, lengths):
        begin, size = starts[rows], lengths[rows]
        best = emissions[begin] + np.where(allowed[0], 0.0, -np.inf)
        back = np.zeros((longest, len(rows), emissions.shape[1]), np.int8)
        for t in range(1, longest):
            on = t < size
            score = best[:, :, None] + move
            back[t] = score.argmax(1)
            best = np.where(on[:, None], score.max(1) + emissions[np.where(on, begin + t, 0)], best)
        label = best.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            on = t < size
            out[begin[on] + t] = label[on]
            step = back[t][np.arange(len(rows)), label] if t else label
            label = np.where(on, step, label)
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def _expected(emissions: np.ndarray, move: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each label's chance at each token, and the expected count of each step, by forward and backward sums."""
    chance, pairs = np.zeros_like(emissions), np.zeros_like(move)
    for rows, longest in _batches(starts, lengths):
        begin, size = starts[rows], lengths[rows]
        n, k = len(rows), emissions.shape[1]
        e = np.zeros((longest, n, k))
        for t in range(longest):
            e[t] = emissions[np.where(t < size, begin + t, begin)]
        fore = np.zeros((longest, n, k))
        fore[0] = e[0] + first
        for t in range(1, longest):
            fore[t] = np.where((t < size)[:, None], _log_sum(fore[t - 1][:, :, None] + move, 1) + e[t], fore[t - 1])
        total = _log_sum(fore[-1], 1)
        after = np.zeros((n, k))
        for t in range(longest - 1, -1, -1):
            on = t < size
            chance[begin[on] + t] = np.exp(fore[t] + after - total[:, None])[on]
            if t:
                ahead = np.where(on[:, None], e[t] + after, 0.0)
                joint = np.exp(fore[t - 1][:, :, None] + move + ahead[:, None, :] - total[:, None, None])
                pairs += joint[on].sum(0)
                after = np.where(on[:, None], _log_sum(move + ahead[:, None, :], 2), after)
    return chance, pairs


def train(examples: list[tuple[str, list[Span]]], rounds: int = 120, decay: float = 0.02, rate: float = 0.15, seen: int = 2) -> Field:
    """The field of greatest penalised likelihood over labelled texts, by Adam over all of them at once, ``rounds`` steps."""
    s = sequences([(text, 0) for text, _ in examples])
    n_tokens, k = len(s.spans), len(LABELS)
    gold = np.zeros(n_tokens, np.int64)
    for (_, spans), start, length in zip(examples, s.starts, s.lengths):
        for kind, a, b in spans:
            inside = [i for i in range(start, start + length) if a <= s.spans[i][0] and s.spans[i][1] <= b]
            for i in inside:
                gold[i] = LABELS.index(f"{'B' if i == inside[0] else 'I'}-{kind}")
    known, size = [], 1
    for column in s.features:
        counts: dict[tuple, int] = {}
        for f in column:
            counts[f] = counts.get(f, 0) + 1
        of = {f: size + i for i, f in enumerate(sorted((f for f, c in counts.items() if c >= seen), key=repr))}
        size += len(of)
        known.append(of)
    model = Field(known, np.zeros((size, k)))
    index = model.index(s)
    real = np.concatenate([np.arange(a, a + n) for a, n in zip(s.starts, s.lengths)]) if len(s.starts) else np.zeros(0, np.int64)
    want = np.zeros((n_tokens, k))
    want[real, gold[real]] = 1
    follow = np.zeros((k, k))
    for a, n in zip(s.starts, s.lengths):
        np.add.at(follow, (gold[a : a + n - 1], gold[a + 1 : a + n]), 1)
    flat = index.ravel()
    order = np.argsort(flat, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(flat[order]) > 0))
    owner, which = order // index.shape[1], flat[order][edges]
    first = np.where(ALLOWED[0], 0.0, -np.inf)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (model.weights, model.steps)]
    for t in range(1, rounds + 1):
        chance, pairs = _expected(model.emissions(index), np.where(ALLOWED, model.steps, -np.inf), s.starts, s.lengths, first)
        gap = want - chance
        slope = np.zeros_like(model.weights)
        slope[which] = np.add.reduceat(gap[owner], edges, axis=0)
        slope[0] = 0
        for w, g, (m, v) in zip((model.weights, model.steps), (slope - decay * model.weights, np.where(ALLOWED, follow - pairs, 0.0) - decay * model.steps), state):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


# what the field finds


def plausible(kind: str, text: str) -> bool:
    """Whether a stretch that the field labels has what its kind cannot do without."""
    d = digits(text)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text, re.I) and re.search(r"\.|\bdot\b", text, re.I) and re.search(r"[^\W\d_]", text)) and len(text) <= 320
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 7 <= len(d) <= 15


def added_spans(texts: list[str], model: Field, base: list[list[Span]]) -> list[list[Span]]:
    """For each text, what the field finds and no base span touches."""
    stretches, owner = [], []
    for i, text in enumerate(texts):
        for a, b in regions(text):
            stretches.append((text[a:b], a))
            owner.append(i)
    out: list[list[Span]] = [[] for _ in texts]
    if not stretches:
        return out
    s = sequences(stretches)
    label = viterbi(model.emissions(model.index(s)), model.steps, s.starts, s.lengths)
    for i, start, length in zip(owner, s.starts.tolist(), s.lengths.tolist()):
        own = label[start : start + length]
        begins = np.flatnonzero(own % 2 == 1)
        taken = base[i]
        for at in begins.tolist():
            end = at + 1
            while end < length and own[end] == own[at] + 1:
                end += 1
            kind, a, b = KINDS[own[at] // 2], s.spans[start + at][0], s.spans[start + end - 1][1]
            if plausible(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in taken):
                out[i].append((kind, a, b))
    for spans in out:
        spans.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return out


# the labelled table

#: Sentences labelled by hand; ``[kind|...]`` marks a span.
EXAMPLES = """Please call me on [phone|0171 555 0199] after six.
Ruf mich unter [phone|030/1234567] an oder schreib mir.
My number is [phone|(020) 7946-0958] and I am home at 8.
Tel. [phone|01 42 68 53 00] ou par courriel.
Phone [phone|555-0134-221] or fax [phone|0049 30 901820].
Telefon [phone|0221.4710.123] von 9 bis 17 Uhr.
The office ([phone|001 212 555 0147]) opens at 9.
Contact [email|jane.doe at example dot com] for the keys.
Write to [email|info (at) example (dot) org] today.
Mail: [email|max [at] beispiel [dot] de] or visit us in 2021.
You can reach [email|peter @ example . net] any time.
Send it to [email|anna_b at mail dot example dot org], please.
[email|k.lee(at)example.com] wrote 12 pages.
The server at [ip|10[.]0[.]3[.]77] did not answer.
Traffic from [ip|192[.]168[.]1[.]20] was blocked on 3 May.
Host [ip|172(.)16(.)254(.)1] is down.
It came from [ip|8 . 8 . 4 . 4] at noon.
Charge [card|4111.1111.1111.1111] for the room.
Card [card|5500/0000/0000/0004] expires 12/27.
Amex [card|3782 822463 10005] was refused.
Visa [card|4012 - 8888 - 8888 - 1881] is fine.
The meeting is on 2024-05-17 at 10:30 in room 12.
We sold 1,234 units for 56.78 each in 2019.
Version 2.10.3 fixes 14 bugs of release 2.9.
See pages 100-120 and chapter 7.
Order no. 20240518 has 3 items.
ISBN 978-3-16-148410-0 is out of print.
It was 20.5 degrees at 14:00 and 18.25 at night.
In 1999 and 2004 there were 1200 and 1450 of them.
The key is a1b2c3d4e5f60718293a4b5c6d7e8f90 in hex.
He lives at 12 Mill Lane, 2nd floor.
We connect the dots, dot by dot, at each corner.
Invoice 000123456 is due on 01.02.2023.
Coordinates 57.9776, 12.8976 are right at the lake.
The ratio is 3/4 or 0.75 of 100 000.
Players 10, 11 and 12 scored 3 goals."""


def marked(line: str) -> tuple[str, list[Span]]:
    """A text and its spans from ``[kind|...]`` marks; brackets inside a span stay."""
    out, spans, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone)\|((?:[^\[\]]|\[(?:at|dot|\.)\])*)\]", line):
        out += line[at : m.start()]
        spans.append((m[1], len(out), len(out) + len(m[2])))
        out += m[2]
        at = m.end()
    return out + line[at:], spans


def rewritten(kind: str, text: str, way: int) -> str:
    """A span as people write it for people: one of several ways, the first of which leaves it alone."""
    d = digits(text)
    if kind == "email":
        name, _, host = text.partition("@")
        at, dot = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), (" @ ", " . "), ("(at)", "."))[(way - 1) % 5]
        ways = [text, f"{name}{at}{host.replace('.', dot)}"]
    elif kind == "ip":
        ways = [text, text.replace(".", ("[.]", "(.)", " . ")[(way - 1) % 3])]
    elif kind == "card":
        ways = [text, (".", "/", " - ")[(way - 1) % 3].join(d[i : i + 4] for i in range(0, len(d), 4))]
    else:
        rest = d[1:] if len(d) > 8 else d
        ways = [text, (f"00{d[:2]} {d[2:5]} {d[5:]}", f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{rest[:3]}.{rest[3:6]}.{rest[6:]}", f"0{rest[:3]}/{rest[3:]}", f"0{rest[:3]} {rest[3:6]} {rest[6:]}")[(way - 1) % 5]]
    return ways[min(way, 1)]


def examples_of(text: str, seed: int, around: int = 60) -> list[tuple[str, list[Span]]]:
    """Labelled stretches of a text: one around each base span, as it is or rewritten, and one around a number that is none."""
    base = sorted(base_spans(text), key=lambda s: s[1])
    out = []
    for i, (kind, a, b) in enumerate(base):
        near = [s for s in base if s[1] < b + around and s[2] > a - around]
        if len(near) > 1:
            continue
        made = rewritten(kind, text[a:b], (seed + i) % 6)
        before, after = text[max(0, a - around) : a], text[b : b + around]
        out.append((before + made + after, [(kind, len(before), len(before) + len(made))]))
    for m in re.finditer(r"[0-9]+", text):
        if not any(a < m.end() + around and m.start() - around < b for _, a, b in base):
            out.append((text[max(0, m.start() - around) : m.end() + around][: 4 * around], []))
            break
    return out


#: Stretches of the corpus that the field learns from at most, of each kind and of none.
MINED = 120


def labelled(docs: DataFrame, text: str = "text", mined: int = MINED) -> list[tuple[str, list[Span]]]:
    """The labelled table: the sentences above, and ``mined`` stretches of each kind and of none, the first by a hash of their text."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                if t:
                    for i, (stretch, spans) in enumerate(examples_of(t, len(t))):
                        kind, a, e = spans[0] if spans else ("none", 0, 0)
                        rows.append((kind, stretch, a, e))
            names = ["kind", "stretch", "a", "e"]
            types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    found = docs.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(run, "kind string, stretch string, a bigint, e bigint")
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.xxhash64("stretch"), "stretch", "a"))
    few = found.withColumn("place", place).where(F.col("place") <= mined).orderBy("kind", "place").collect()
    return [marked(line) for line in EXAMPLES.split("\n")] + [(r["stretch"], [(r["kind"], r["a"], r["e"])] if r["kind"] != "none" else []) for r in few]


def fit(docs: DataFrame, text: str = "text", mined: int = MINED) -> Field:
    """A field learned from the labelled table, which a bounded sample of ``docs`` makes larger; a table without texts still gives one."""
    return train(labelled(docs, text, mined))


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_FOUND = StructType([StructField("base", SPANS), StructField("added", SPANS)])


def find(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``: spans by the patterns and by the field, in code points, ends exclusive, by kind, then place.

    A null text counts as empty; texts are read whole, whatever their length; rows that repeat each get their own. A span of
    the field that touches one of the patterns, or lacks what its kind needs, is left out. A column ``base`` or ``added`` that
    ``docs`` has makes the new one's name longer by an underscore.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(_FOUND)
    def found(column: pa.Array) -> pa.Array:
        every, new = [], []
        texts, size, own = [], 0, sent.value
        values = [t or "" for t in column.to_pylist()]
        for i, t in enumerate(values):
            texts.append(t)
            size += len(t)
            if size > 4 << 20 or i + 1 == len(values):
                base = [base_spans(t) for t in texts]
                every += base
                new += added_spans(texts, own, base)
                texts, size = [], 0
        rows = lambda spans: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], kind)
        return pa.StructArray.from_arrays([rows(every), rows(new)], ["base", "added"])

    base, added, both = free_names(docs, "base", "added", "both")
    return docs.withColumn(both, found(F.col(text))).select(*docs.columns, F.col(both)["base"].alias(base), F.col(both)["added"].alias(added))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_kind(a: Column, b: Column) -> Column:
    """Two lists of spans as one, by kind, then place."""
    order = lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.array_sort(F.transform(F.concat(a, b), order))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of what the patterns find, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = find(docs, fit(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    digest = F.sha2(joined(F.col("base")).cast("binary"), 256)
    return told.select("doc_id", *[count(k) for k in KINDS], digest.alias("base_sha256"), joined(by_kind(F.col("base"), F.col("added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
