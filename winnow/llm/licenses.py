"""License notices in texts by patience alignment with templates.

Words that come once in both the template and a stretch of text are anchors. The longest run of
anchors in the same order on both sides is kept, and the gaps between them are aligned the same
way, after equal words at the ends of a gap have been paired. Coverage is the share of the
template's words that found a partner; `least` of it makes a notice. Licenses differ in a word or a
number, so the words that name a license and its version (`DECIDING`) must be aligned, too, each
group with nothing between its words but "license" or "version".

A text is looked at in windows of twice the template's length, half a template apart, so every
occurrence lies in one and other occurrences in the same text do not take its anchors away; behind
each find another window begins. Windows that lack too many of the template's words are passed over: each missing word costs coverage, so
none of them could reach `least`. Overlapping finds yield to the one with more aligned words.

Everything happens in a document's own row, nothing is shuffled.

Defined results: null, empty and wordless texts have no notice; templates without words are refused;
of finds with equally many aligned words that overlap, the first template's goes first, then the one
that begins first; repeated rows have their notices each; a long text is scanned whole, in time in
proportion to its words and notices; positions count characters, as which every byte counts that does
not go on in one; an empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.common import chunks, col_name
from winnow.llm.words import plain_words, words

LEAST = 0.8

# Public license notices, without the lines that name the holder.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the
{} as published by the Free Software Foundation; either version {} of the License,
or (at your option) any later version."""
TEMPLATES = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. {_AS_IS} IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies.""",
    "BSD-2-Clause": _BSD,
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
or (at your option) any later version.""",
    "BSD-3-Clause": f"""{_BSD} Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-2.0": _GNU.format("GNU General Public License", "2"),
    "LGPL-2.1": _GNU.format("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _GNU.format("GNU Lesser General Public License", "3"),
    "AGPL-3.0": _GNU.format("GNU Affero General Public License", "3"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or
neighboring rights to this work.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to
copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "BSD notice": "Released under the BSD License.",
    "ISC notice": "Released under the ISC License.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC0-1.0 notice": "Licensed under CC0 1.0.",
    **{
        f"CC-{kind}-{version} notice": f"Licensed under CC {kind} {version}."
        for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for version in ("4.0", "3.0")
        if (kind, version) != ("BY-NC", "4.0")
    },
}
#: Groups of words of a template that must be aligned.
DECIDING = {
    "Apache-2.0": ("apache", "2 0"),
    "BSD-3-Clause": ("neither the name",),
    "MPL-2.0": ("mozilla public", "2 0"),
    "CC0-1.0": ("waived all copyright",),
    "Unlicense": ("unencumbered", "public domain"),
    "MIT notice": ("mit",), "BSD notice": ("bsd",), "ISC notice": ("isc",),
    "Apache-2.0 notice": ("apache", "2 0"),
    "MPL-2.0 notice": ("mozilla public", "2 0"),
    "CC0-1.0 notice": ("cc0 1 0",),
    **{f"{n}{end}": (f"gnu{kind} general public", v if end else f"version {v}") for n, kind, v in (
        ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", " lesser", "2 1"), ("LGPL-3.0", " lesser", "3"),
        ("AGPL-3.0", " affero", "3"),
    ) for end in ("", " notice")},
    **{n: (" ".join(plain_words(TEMPLATES[n])[2:]),) for n in TEMPLATES if n.startswith("CC-")},
}
#: Words that may stand between deciding ones.
FILLERS = ("license", "version", "v")


def increasing(values: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out: list[int] = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of places of equal items, increasing on both sides."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
        shared = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in place]
        anchors = [shared[k] for k in increasing([j for _, j in shared])]
        if not anchors:
            continue
        pairs += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(pairs)


class Find(NamedTuple):
    aligned: int
    template: int
    start: int  # words of the text
    end: int


class Templates:
    """Templates as numbers of their words."""

    def __init__(self, texts: dict[str, str], least: float = LEAST):
        self.names, self.texts = list(texts), texts
        found = words([texts[n].encode() for n in self.names])
        if not len(found.hash) or (np.diff(found.first) == 0).any():
            raise ValueError("a template has no words")
        self.vocabulary, numbers = np.unique(found.hash, return_inverse=True)
        self.words = [numbers[a:b].tolist() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        self.has = np.zeros((len(self.vocabulary), len(self.names)), dtype=np.int32)
        for k, own in enumerate(self.words):
            self.has[own, k] = 1
        # Aligned words that make a notice, and distinct words that must be there for that.
        self.enough = np.array([int(np.ceil(least * len(own) - 1e-9)) for own in self.words])
        self.needed = np.array([len(set(own)) - (len(own) - e) for own, e in zip(self.words, self.enough, strict=True)])

        fillers = words([" ".join(FILLERS).encode()]).hash
        self.fillers = set(self.numbered(fillers).tolist()) - {-1}
        self.deciding = [self.groups(k) for k in range(len(self.names))]

    def groups(self, k: int) -> list[range]:
        """Places of the deciding words in a template of this module."""
        name, out = self.names[k], []
        for group in DECIDING.get(name, ()) if self.texts[name] == TEMPLATES.get(name) else ():
            own, n = group.split(), plain_words(self.texts[name])
            at = next(i for i in range(len(n)) if n[i : i + len(own)] == own)
            out.append(range(at, at + len(own)))
        return out

    def decided(self, k: int, pairs: list[tuple[int, int]], window: list[int]) -> bool:
        """Whether the deciding words are aligned, and together."""
        place = dict(pairs)
        for group in self.deciding[k]:
            at = [place.get(i) for i in group]
            if None in at or any(window[j] not in self.fillers for j in set(range(at[0], at[-1])).difference(at)):
                return False
        return True

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def candidates(self, numbers: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(text, template) where the text has enough of the template's words."""
        known = np.flatnonzero(numbers >= 0)
        text = np.searchsorted(first, known, side="right") - 1
        there = np.zeros((len(first) - 1, len(self.vocabulary)), dtype=np.int32)
        there[text, numbers[known]] = 1
        return list(zip(*(x.tolist() for x in np.nonzero(there @ self.has >= self.needed)), strict=True))

    def finds(self, numbers: list[int], k: int) -> list[Find]:
        """Occurrences of a template in one text; they may overlap."""
        own, n = self.words[k], len(self.words[k])
        vocabulary = set(own)
        out = []
        starts = list(range(0, max(1, len(numbers) - n // 2), max(1, n // 2)))
        seen = set(starts)
        for start in starts:
            window = numbers[start : start + 2 * n]
            if len(vocabulary.intersection(window)) < self.needed[k]:
                continue
            pairs = _together(patience(own, window))
            if len(pairs) >= self.enough[k] and self.decided(k, pairs, window):
                end = start + pairs[-1][1] + 1
                out.append(Find(len(pairs), k, start + pairs[0][1], end))
                if end not in seen and end < len(numbers):
                    seen.add(end)
                    starts.append(end)  # one may follow at once
        return out

    def notices(self, numbers: list[int], templates: Iterable[int]) -> list[Find]:
        """The finds of one text, without those that overlap a larger one."""
        kept: list[Find] = []  # by start, and as none overlaps, by end
        for f in sorted((f for k in templates for f in self.finds(numbers, k)), key=lambda f: (-f.aligned, f[1:])):
            at = bisect_left(kept, f.end, key=lambda g: g.start)  # the first that begins behind it
            if at == 0 or kept[at - 1].end <= f.start:
                kept.insert(at, f)
        return kept


def _together(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs without those at the ends that lie far off: stray words that agree by chance."""
    runs: list[list[tuple[int, int]]] = []
    for p in pairs:
        if runs and p[1] - runs[-1][-1][1] <= 2 * (p[0] - runs[-1][-1][0]) + 3:
            runs[-1].append(p)
        else:
            runs.append([p])
    return max(runs, key=len, default=[])


def _scan(templates, schema: pa.Schema) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = templates.value
        for batch, texts in chunks(batches, "text"):
            w = words(texts)
            numbers = t.numbered(w.hash)
            by: dict[int, list[int]] = {}
            for d, k in t.candidates(numbers, w.first):
                by.setdefault(d, []).append(k)
            rows: list[int] = []
            made: dict[str, list] = {n: [] for n in ("license", "coverage", "n_aligned", "start", "end")}
            begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
            # Characters before each byte: all bytes but those that go on in a character.
            characters = np.cumsum((w.buffer & 0xC0) != 0x80, dtype=np.int64)
            characters = np.concatenate([[0], characters])
            for d, ks in by.items():
                a, b = int(w.first[d]), int(w.first[d + 1])
                for f in t.notices(numbers[a:b].tolist(), ks):
                    places = characters[[w.start[a + f.start], w.end[a + f.end - 1]]] - characters[begin[d]]
                    start, end = places.tolist()
                    rows.append(d)
                    values = t.names[f.template], f.aligned / len(t.words[f.template]), f.aligned, start, end
                    for column, x in zip(made.values(), values, strict=True):
                        column.append(x)
            own = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(rows, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [own.cast(f.type) if f.name == "doc_id" else pa.array(made[f.name], type=f.type) for f in schema],
                schema=schema,
            )

    return run


def notices(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    least: float = LEAST,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per notice: doc_id, license, coverage, n_aligned (words) and its characters [start, end)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = docs.select(F.col(col_name(doc_id)).alias("doc_id"), F.col(col_name(text)).alias("text"))
    # The templates are the caller's few texts, in driver memory already.
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES, least))
    schema = T.StructType(
        [
            T.StructField("doc_id", own.schema["doc_id"].dataType),
            T.StructField("license", T.StringType()),
            T.StructField("coverage", T.DoubleType()),
            *(T.StructField(n, T.LongType()) for n in ("n_aligned", "start", "end")),
        ]
    )
    return own.mapInArrow(_scan(known, to_arrow_schema(schema)), schema)


def plain_notices(text: str | None, templates: dict[str, str], least: float = LEAST) -> list[tuple[str, float]]:
    """Names and coverages for one text without any filter, for comparison."""
    t = Templates(templates, least)
    own = plain_words(text)
    ids = {w: i for i, w in enumerate(dict.fromkeys(x for n in t.names for x in plain_words(templates[n])))}
    t.words = [[ids[w] for w in plain_words(templates[n])] for n in t.names]
    t.needed = np.zeros_like(t.needed)
    t.fillers = {ids[w] for w in FILLERS if w in ids}
    found = t.notices([ids.get(w, -1) for w in own], range(len(t.names))) if own else []
    return [(t.names[f.template], f.aligned / len(t.words[f.template])) for f in found]
