"""License scans by conditional compression.

Around wording that looks like a license, as far as a template may reach, the text is a candidate block: short templates
have short blocks, full license texts long ones. Each block is compressed with zstandard once plain and once with each
template whose naming words stand in it as a raw dictionary; templates are ranked by how many bytes they save. Those that
save any are confirmed by the exact differences in wording between the template and the words of the block that it matches
best: all words that name the license must stand there, and few others may differ. Confirmed wording is taken out of the
block, and what is left is ranked again, until nothing fits.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import product
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overlook.llm.common import sliced, table

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NEITHER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: License templates: id, words that name it, wording. Fixed values; ``templates`` takes others.
TEMPLATES = (
    ("MIT", ("mit",), "Released under the MIT License."),
    ("MIT", ("permission", "charge"), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", ("apache", "2.0"), "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", ("apache", "2.0"), "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", ("gnu", "general", "public", "3"), "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", ("gnu", "general", "public", "2"), "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", ("gnu", "lesser", "general", "public", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", ("gnu", "affero", "general", "public", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", ("gnu", "general", "public", "3"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", ("redistribution", "neither"), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", ("bsd", "3-clause"), "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", ("mozilla", "2.0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", ("cc", "by", "4.0"), "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", ("cc", "by-sa", "4.0"), "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", ("cc", "by-nc", "4.0"), "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", ("cc", "by-nc-sa", "4.0"), "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", ("cc0", "1.0"), "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", ("unencumbered", "public", "domain"), "This is free and unencumbered software released into the public domain."),
    ("MIT", ("permission", "noninfringement"), f"{_MIT} {_WARRANTY}"),
    ("MIT", ("mit",), "MIT License"),
    ("BSD-2-Clause", ("redistribution", "disclaimer"), f"{_BSD} {_DISCLAIMER}"),
    ("BSD-3-Clause", ("redistribution", "neither", "endorse"), f"{_BSD} {_NEITHER} {_DISCLAIMER}"),
    ("BSD-2-Clause", ("bsd", "2-clause"), "Licensed under the BSD 2-Clause License."),
    ("ISC", ("permission", "fee", "purpose"), "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", ("gnu", "lesser", "general", "public", "2.1"), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-2.0", ("gnu", "general", "public", "2"), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", ("gnu", "affero", "general", "public", "3"), "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", ("apache", "2.0"), "Apache License, Version 2.0"),
    ("MPL-2.0", ("mozilla", "2.0"), "Mozilla Public License 2.0"),
    ("Apache-2.0", ("apache", "2.0"), "Licensed under Apache 2.0."),
    ("GPL-3.0", ("gpl", "v3"), "License: GPL v3 or later."),
    ("GPL-2.0", ("gpl", "v2"), "License: GPL v2 or later."),
    ("MIT", ("mit",), "License: MIT"),
    ("MIT", ("mit",), "Distributed under the terms of the MIT licence."),
    ("BSL-1.0", ("boost", "1.0"), "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", ("eclipse", "2.0"), "Made available under the terms of the Eclipse Public License 2.0."),
)
#: Names of the four-point-nought Creative Commons licenses, by their elements. Fixed values.
_ELEMENTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}


def _by_rule():
    """Creative Commons references and SPDX lines, made from the names of licenses."""
    for nc, end in product(("", "nc"), ("", "sa", "nd")):
        parts = [p for p in ("by", nc, end) if p]
        title = "-".join(_ELEMENTS[p] for p in parts)
        name = f"CC-{'-'.join(parts).upper()}-4.0"
        yield name, ("creative", "commons", title.lower(), "4.0"), f"This work is licensed under a Creative Commons {title} 4.0 International License."
        if end == "nd":
            yield name, ("cc", "-".join(parts), "4.0"), f"Licensed under CC {'-'.join(parts).upper()} 4.0."
        yield name, ("spdx-license-identifier", name.lower()), f"SPDX-License-Identifier: {name}"
        for version in ("2.0", "2.5", "3.0"):
            older = name.replace("4.0", version)
            yield older, ("cc", "-".join(parts), version), f"Licensed under CC {'-'.join(parts).upper()} {version}."
            yield older, ("creative", "commons", title.lower(), version), f"This work is licensed under a Creative Commons {title} {version} Unported License."
            yield older, ("spdx-license-identifier", older.lower()), f"SPDX-License-Identifier: {older}"
    for name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "ISC", "Unlicense", "BSL-1.0", "Zlib", "EPL-2.0", "0BSD", "MIT-0"):
        yield name, ("spdx-license-identifier", name.lower()), f"SPDX-License-Identifier: {name}"
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        for end in ("-only", "-or-later"):
            yield name, ("spdx-license-identifier", f"{name}{end}".lower()), f"SPDX-License-Identifier: {name}{end}"


#: Words that a full license text is named by; the texts stand in ``wording``. Fixed values.
FULL = {
    "Apache-2.0": ("apache", "2.0", "contributor"), "GPL-2.0": ("gnu", "general", "public", "derivative"), "GPL-3.0": ("gnu", "general", "public", "affero"), "LGPL-2.1": ("gnu", "lesser", "library"),
    "LGPL-3.0": ("gnu", "lesser", "linked"), "MPL-2.0": ("mozilla", "contributor", "covered"), "CC0-1.0": ("cc0", "1.0", "affirmer"),
}


def full_texts(folder: str | Path = Path(__file__).with_name("wording")):
    """(id, naming words, wording) of the license texts in a folder, read where the job is started."""
    return tuple((name, keys, (Path(folder) / f"{name}.txt").read_text(encoding="utf-8")) for name, keys in FULL.items())


def all_templates():
    return (*TEMPLATES, *_by_rule(), *full_texts())


#: What makes wording a candidate.
HINT = r"licen[sc]e|\bcc[ -](?:by|zero)|\bcc0\b|copyleft|public domain|redistribut|hereby granted|free software|permission to use"
_HINT = re.compile(HINT, re.I)
#: Lines between two candidate lines of one stretch of unknown wording at most.
GAP = 2
#: Characters of a template up to which it belongs to a class; each class has blocks of its own reach.
CLASSES = (320, 4096)
#: A wrapped and commented copy is at most this many times as long as the template.
STRETCH = 1.6
#: Stands in place of a word that a confirmed license has taken.
TAKEN = ""
#: Share of a template's words that may be missing or inserted in a confirmed match.
DIFFERENT = 0.15
LEVEL = 9
WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-'][A-Za-z0-9]+)*")
#: What denies a license, within NEAR words in front of it, and what ends a denial. Fixed words.
DENIED = frozenset("not never no nor neither isn't aren't wasn't weren't don't doesn't cannot can't".split())
TURN = frozenset("but only rather instead just merely".split())
NEAR = 5
STOP = re.compile(r"[.,;:!?]|\n[ \t]*\n")
#: The beginning and the further parts of an SPDX expression.
SPDX = re.compile(r"(SPDX-License-Identifier:)[ \t(]*[A-Za-z0-9][A-Za-z0-9.\-]*\+?", re.I)
NEXT = re.compile(r"[ \t()]+(OR|AND|WITH)[ \t(]+([A-Za-z0-9][A-Za-z0-9.\-]*\+?)", re.I)
#: Words of a template beyond which its place is found by runs of SHINGLE words before words are compared.
SHORT, SHINGLE = 40, 4


@dataclass(frozen=True)
class Template:
    name: str
    keys: tuple[str, ...]
    text: str

    @functools.cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text.lower())

    @functools.cached_property
    def places(self) -> dict[tuple[str, ...], int]:
        """Where each run of SHINGLE words stands that the template holds once."""
        runs = [tuple(self.words[i : i + SHINGLE]) for i in range(len(self.words) - SHINGLE + 1)]
        once = Counter(runs)
        return {r: i for i, r in enumerate(runs) if once[r] == 1}


def unknown_runs(text: str, gap: int = GAP) -> list[tuple[int, int]]:
    """(first, past the last character) of each run of candidate lines."""
    runs, at, since = [], 0, 0
    for line in text.split("\n"):
        if _HINT.search(line):
            if runs and since <= gap:
                runs[-1][1] = at + len(line)
            else:
                runs.append([at, at + len(line)])
            since = 0
        else:
            since += 1
        at += len(line) + 1
    return [(a, b) for a, b in runs]


def blocks(hints: list[tuple[int, int]], reach: int, end: int):
    """(first, past the last character) of the stretches within ``reach`` of a hint; long ones in pieces that overlap by twice the reach."""
    merged: list[list[int]] = []
    for a, b in hints:
        c, d = max(0, a - reach), min(end, b + reach)
        if merged and c <= merged[-1][1]:
            merged[-1][1] = d
        else:
            merged.append([c, d])
    for c, d in merged:
        while d - c > 8 * reach:
            yield c, c + 4 * reach
            c += 2 * reach
        yield c, d


def matching(a: list[str], b: list[str], small: int = 60_000) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of equal runs in order: between runs that both hold once, pairwise comparison."""
    if not a or not b:
        return []
    if len(a) * len(b) <= small:
        return [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    for n in (SHINGLE, 2, 1):
        ra, rb = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (a, b))
        ca, cb = Counter(ra), Counter(rb)
        at = {r: j for j, r in enumerate(rb) if cb[r] == 1}
        pairs = [(i, at[r]) for i, r in enumerate(ra) if ca[r] == 1 and r in at]
        if not pairs:
            continue
        # the longest chain that rises in both
        ends, chain, back = [], [], []
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(ends, j)
            back.append(chain[p - 1] if p else -1)
            ends[p : p + 1], chain[p : p + 1] = [j], [k]
        k, rising = chain[-1], []
        while k >= 0:
            rising.append(pairs[k])
            k = back[k]
        runs: list[list[int]] = []
        for i, j in reversed(rising):
            if runs and i - runs[-1][0] == j - runs[-1][1] and i <= runs[-1][0] + runs[-1][2]:
                runs[-1][2] = i + n - runs[-1][0]
            elif not runs or (i >= runs[-1][0] + runs[-1][2] and j >= runs[-1][1] + runs[-1][2]):
                runs.append([i, j, n])
        out, x, y = [], 0, 0
        for i, j, size in [*runs, [len(a), len(b), 0]]:
            out += [(x + p, y + q, m) for p, q, m in matching(a[x:i], b[y:j], small)]
            if size:
                out.append((i, j, size))
            x, y = i + size, j + size
        joined: list[tuple[int, int, int]] = []
        for i, j, size in out:
            if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
                joined[-1] = (*joined[-1][:2], joined[-1][2] + size)
            else:
                joined.append((i, j, size))
        return joined
    return []


def spread(text: str):
    """A text with an SPDX line of its own for each license of an expression, and a function from its places to those of ``text``."""
    out, new, old, last = [], [0], [(0, True)], 0
    for m in SPDX.finditer(text):
        at = m.end()
        while n := NEXT.match(text, at):
            at = n.end()
            if n[1].upper() != "WITH":
                for piece, place, moves in ((text[last : n.start()], last, True), (f"\n{m[1]} {n[2]}", n.start(2), False)):
                    old[-1] = (place, moves)
                    out.append(piece)
                    new.append(new[-1] + len(piece))
                    old.append((at, True))
                last = at
    out.append(text[last:])

    def back(place: int) -> int:
        i = bisect_right(new, place) - 1
        return old[i][0] + (place - new[i]) * old[i][1]

    return "".join(out), back


def denied(text: str, places: list[tuple[int, int]], words: list[str], first: int) -> bool:
    """Whether a negation stands closely in front of a word, with no stop and no turn between."""
    for j in range(first - 1, max(-1, first - 1 - NEAR), -1):
        if words[j] in TURN or STOP.search(text, places[j][1], places[j + 1][0]):
            return False
        if words[j] in DENIED:
            return True
    return False


class Scanner:
    """Compressors for each template; made anew in each worker."""

    def __init__(self, templates=None, different: float = DIFFERENT, level: int = LEVEL):
        self.templates = [Template(*t) for t in (all_templates() if templates is None else templates)]
        self.different, self.level, self.made = different, level, None
        kinds: dict[int, list[int]] = {}
        for i, t in enumerate(self.templates):
            kinds.setdefault(sum(len(t.text) > c for c in CLASSES), []).append(i)
        #: (reach, templates) of each class, the longest first
        self.classes = [(int(STRETCH * max(len(self.templates[i].text) for i in own)) + 64, own) for _, own in sorted(kinds.items(), reverse=True)]

    def __getstate__(self):
        return {**self.__dict__, "made": None}

    def compressors(self):
        if self.made is None:
            import zstandard as z

            plain = z.ZstdCompressor(level=self.level, write_content_size=False)
            own = []
            for t in self.templates:
                d = z.ZstdCompressionDict(t.text.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                own.append(z.ZstdCompressor(level=self.level, write_content_size=False, dict_data=d))
            self.made = plain, own
        return self.made

    def savings(self, block: str, templates: list[int]) -> dict[int, int]:
        """Bytes that each template saves as a dictionary of the block."""
        plain, own = self.compressors()
        raw = block.encode("utf-8", "surrogatepass")
        base = len(plain.compress(raw))
        return {i: base - len(own[i].compress(raw)) for i in templates}

    def locate(self, template: Template, words: list[str]) -> tuple[int, int] | None:
        """The stretch of words in which most runs of a long template stand in their order."""
        n, slack = len(template.words), max(2, int(len(template.words) * self.different))
        shifts = sorted(j - i for j in range(len(words) - SHINGLE + 1) if (i := template.places.get(tuple(words[j : j + SHINGLE]))) is not None)
        if not shifts:
            return None
        best = max(range(len(shifts)), key=lambda k: (bisect_right(shifts, shifts[k] + slack) - k, -k))
        first, last = shifts[best], shifts[bisect_right(shifts, shifts[best] + slack) - 1]
        return max(0, first - slack), min(len(words), last + n + slack)

    def confirm(self, template: Template, words: list[str]) -> tuple[list[str], list[str], float, int, int] | None:
        """(missing words, inserted words, share of differences, first word, past the last) where the template fits best; None if a naming word is missing."""
        lo, hi = 0, len(words)
        if len(template.words) > SHORT:
            if not (place := self.locate(template, words)):
                return None
            lo, hi = place
        words = words[lo:hi]
        runs = matching(template.words, words)
        if not runs:
            return None
        # the longest run is in the best place; it is widened while the gaps stay small
        i = max(range(len(runs)), key=lambda j: runs[j][2])
        slack = max(2, int(len(template.words) * self.different))
        first = last = i
        past = lambda r: r[1] + r[2]
        free = lambda x, y: TAKEN not in words[x:y]
        while first and runs[first][1] - past(runs[first - 1]) <= slack and free(past(runs[first - 1]), runs[first][1]):
            first -= 1
        while last + 1 < len(runs) and runs[last + 1][1] - past(runs[last]) <= slack and free(past(runs[last]), runs[last + 1][1]):
            last += 1
        # where a template's first or last words are changed, the words in their place belong to the comparison
        begin, stop = runs[first][1], past(runs[last])
        before = min(runs[first][0], slack, begin)
        after = min(len(template.words) - runs[last][0] - runs[last][2], slack, len(words) - stop)
        while not free(begin - before, begin):
            before -= 1
        while not free(stop, stop + after):
            after -= 1
        found = words[begin - before : stop + after]
        if not set(template.keys) <= set(found):
            return None
        missing, inserted, x, y = [], [], 0, 0
        for a, b, size in [*matching(template.words, found), (len(template.words), len(found), 0)]:
            missing += template.words[x:a]
            inserted += found[y:b]
            x, y = a + size, b + size
        start = lo + begin - before
        return missing, inserted, max(len(missing), len(inserted) - before - after) / len(template.words), start, start + len(found)

    def confirm_any(self, template: Template, words: list[str]):
        """``confirm`` in the first place that fits: where the best one does not, the next best is tried."""
        words = list(words)
        while set(template.keys) <= set(words):
            got = self.confirm(template, words)
            if got and got[2] <= self.different:
                return got
            if len(template.words) > SHORT:
                if not (place := self.locate(template, words)):
                    return None
                for j in range(place[0], min(place[1], len(words) - SHINGLE + 1)):  # these runs have been tried
                    if tuple(words[j : j + SHINGLE]) in template.places:
                        words[j] = TAKEN
                continue
            run = SequenceMatcher(None, template.words, words, autojunk=False).find_longest_match()
            if not run.size:
                return None
            words[run.b : run.b + run.size] = [TAKEN] * run.size
        return None

    def scan(self, text: str | None) -> list[tuple[int, str | None, int, str | None, str | None, str]]:
        """(first character, license, bytes saved, missing words, inserted words, verdict) of each license found.

        Every occurrence is a row. ``verdict`` is ``exact``, ``changed`` (small differences), ``denied`` (a short wording
        behind a negation: not released under ...) or ``unknown``: a run of lines with license wording in which nothing is
        found; its license is null. Each license of an SPDX expression is a row, where it stands; exceptions (``WITH``) are
        passed over. Of templates that save equally, the one listed first is tried first.
        """
        if text and SPDX.search(text):
            text, back = spread(text)
            return sorted({(back(at), name, *rest) for at, name, *rest in self.found(text)}, key=lambda r: (r[0], r[1] or ""))
        return self.found(text)

    def found(self, text: str | None) -> list[tuple[int, str | None, int, str | None, str | None, str]]:
        """``scan`` of a text in which an SPDX line names one license."""
        hints = [m.span() for m in _HINT.finditer(text or "")]
        if not hints:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        starts = [a for a, _ in places]
        words = [text[a:b].lower() for a, b in places]
        out, best = [], []
        for reach, own in self.classes:
            for c, d in blocks(hints, reach, len(text)):
                lo, hi = bisect_left(starts, c), bisect_left(starts, d)
                while True:  # confirmed wording is taken out and the rest is ranked again, until nothing fits
                    here = words[lo:hi]
                    named = set(here)
                    tried = [i for i in own if named.issuperset(self.templates[i].keys)]
                    if not tried:
                        break
                    saved = self.savings(self.rest(text, c, d, places, words, lo, hi), tried)
                    best.append((c, d, max(saved.values())))
                    fits = []
                    for i in sorted(tried, key=lambda i: (-saved[i], i)):
                        if saved[i] > 0 and (got := self.confirm_any(self.templates[i], here)):
                            fits.append((len(got[0]) - len(self.templates[i].words), got[2], -saved[i], self.templates[i].name, got))
                    taken: list[tuple[int, int]] = []
                    for _, _, gain, name, (missing, inserted, _, start, end) in sorted(fits, key=lambda f: f[:4]):
                        if any(start < y and end > x for x, y in taken):
                            continue  # words that another template explains more of
                        taken.append((start, end))
                        verdict = "changed" if missing or inserted else "exact"
                        if end - start <= SHORT and denied(text, places, words, lo + start):
                            verdict = "denied"
                        out.append((places[lo + start][0], name, -gain, " ".join(missing), " ".join(inserted), verdict, places[lo + end - 1][1]))
                        words[lo + start : lo + end] = [TAKEN] * (end - start)
                    if not taken:
                        break
        for a, b in unknown_runs(text):
            if not any(r[0] < b and r[6] > a for r in out):
                out.append((a, None, max([0, *(s for c, d, s in best if c < b and d > a)]), None, None, "unknown", b))
        return [r[:6] for r in sorted(out, key=lambda r: (r[0], r[6]))]

    @staticmethod
    def rest(text: str, c: int, d: int, places: list[tuple[int, int]], words: list[str], lo: int, hi: int) -> str:
        """A block without the words that are taken."""
        keep, last = [], c
        for (a, b), w in zip(places[lo:hi], words[lo:hi]):
            if w == TAKEN:
                keep.append(text[last:a])
                last = b
        return "".join([*keep, text[last:d]])


FOUND = "doc_id long, block_at long, license string, saved_bytes long, missing string, inserted string, verdict string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("block_at", pa.int64()), ("license", pa.string()), ("saved_bytes", pa.int64()), ("missing", pa.string()), ("inserted", pa.string()), ("verdict", pa.string())])


def scan(docs: DataFrame, templates=None, different: float = DIFFERENT) -> DataFrame:
    """One row a license found, see ``Scanner.scan``; texts without license wording give none.

    Whole texts are read, nothing is shuffled: ids and texts go through Arrow in bounded batches. Null and empty texts
    give no rows; repeated rows give repeated results; a null doc_id stays null; other columns are not read. Without
    templates all license wording is ``unknown``; None takes all that are built in.
    """
    scanner = Scanner(templates, different)
    # a built-in filter first, so that only texts with license wording reach Python
    hinted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(f"(?i){HINT}"))

    def run(batches):
        for b in batches:
            rows = [(i.as_py(), *row) for i, t in zip(b.column(0), b.column(1)) for row in scanner.scan(t.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    return hinted.mapInArrow(sliced(run), FOUND)


def op6_licenses(spark, sf_dir):
    """License wording in ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
