"""License scans by patience alignment.

Texts and templates are word sequences (letters and digits, lower case).  Runs
of ``SEED_WORDS`` words (two for templates of under ``SHORT`` words) that a text
shares with a template mark the windows of the text that are worth aligning; a window reaches a template's length to either
side of its seeds.  In a window the alignment anchors on the words that occur
once in both window and template, takes the longest increasing subsequence of
these anchors, and does the same in each gap between them; a gap without such
anchors adds the equal words at its two ends.  Coverage is the share of the
template's words that are aligned; a window of at least ``PERCENT`` per cent is a
finding.

Phrases that tell a license from its siblings (``IDENTITY``: name, version, NC
or SA) pin a template where the first of them stands, and it is aligned to the
left and to the right of it; a version number that goes on (2.1 for 2) is
another version.  Templates with phrases and at least ``LONG`` words are also
found by their seeds, where a window has at least ``SEED_PERCENT`` of them: there
fewer than half of a phrase's words may have been replaced, each by one word
that is in no phrase and no number, as a name or version of a sibling would be
(a foreign word just where siblings differ gives the sibling that aligns best).
Short grants are names (also with "Licence", and SPDX lines) that stand as they
are.  Of the findings that claim the same words, the one with the most aligned
words stays.

The templates are a fixed small table (a parameter); each text is handled alone
in a narrow stage.  Defined results: null text has no words; several windows of
one template are several rows, overlapping ones are one; of findings with
equally many aligned words the shorter template stays; offsets are code points,
end exclusive; a text without license has no row; a null id stays null; repeated
rows are scanned each; an empty table gives no rows; long texts are hashed whole
and only windows around seeds and phrases are aligned; other columns, whatever
their names, are left out.  Own templates can be read from a table
(:func:`templates_of`).
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import product
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shingles import PUNCTUATION, combine, text_word_spans, text_words

SEED_WORDS = 3
SHORT = 10
#: Words from which a template with phrases is also found by seeds, and the share of them that a window needs.
LONG, SEED_PERCENT = 20, 15
PERCENT = 80
SCHEMA = "doc_id long, license string, start long, end long, n_aligned long, n_template_words long"

#: Statements by which well-known licenses are granted (public texts).
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "mit-0-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "epl-text": (
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE '
        "PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0"
    ),
    "agpl-3.0-opening": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
}
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES |= {
    "bsd-2-clause-text": _BSD,
    "bsd-3-clause-text": _BSD + _BSD_NAME,
    "bsd-4-clause-text": _BSD + "All advertising materials mentioning features or use of this software must display the following acknowledgement: " + _BSD_NAME,
}
_GNU_HEADER = (
    "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by "
    "the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_GNU = [("gpl", "", "1 2 3"), ("lgpl", "Lesser ", "2.1 3"), ("lgpl", "Library ", "2"), ("agpl", "Affero ", "1 3")]
#: Phrases by template that must be aligned without a gap; the first pins the template.
IDENTITY: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License Version 2.0",),
    "apache-2.0-header": ("Apache License Version 2.0",),
    "mit": ("MIT License",),
    "mit-text": ("this permission notice",),
    "gpl-3.0": ("GNU General Public License version 3",),
    "gpl-header": ("GNU General Public License", "version 3 of the License"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0",),
    "cc-by-4.0": ("Creative Commons Attribution 4.0",),
    "cc-by-sa-4.0": ("Creative Commons Attribution-ShareAlike 4.0",),
    "mpl-2.0": ("Mozilla Public License v. 2.0",),
    "isc-text": ("this permission notice appear",),
    "unlicense-text": ("free and unencumbered software",),
    "epl-text": ("Eclipse Public License",),
    "epl-2.0-header": ("Eclipse Public License 2.0",),
    "agpl-3.0-opening": ("GNU Affero General Public License version 3",),
    "bsd-2-clause-text": ("Redistributions in binary form",),
    "bsd-3-clause-text": ("Redistributions in binary form", "Neither the name", "specific prior written permission"),
    "bsd-4-clause-text": ("Redistributions in binary form", "All advertising materials mentioning", "specific prior written permission"),
}
for _name, _kind, _versions in _GNU:
    for _v in _versions.split():
        _label = f"{_name}-{_v if '.' in _v else _v + '.0'}-header"
        if _label != "gpl-3.0-header":
            TEMPLATES[_label] = _GNU_HEADER.format(thing="library" if _name == "lgpl" else "program", kind=_kind, version=_v)
            IDENTITY[_label] = (f"GNU {_kind}General Public License", f"version {_v} of the License")
#: Titles of the whole texts in the folder license_texts.
_TITLES = {
    "apache-2.0-text": "Apache License Version 2.0, January 2004",
    "gpl-1.0-text": "GNU General Public License Version 1, February 1989",
    "gpl-2.0-text": "GNU General Public License Version 2, June 1991",
    "gpl-3.0-text": "GNU General Public License Version 3, 29 June 2007",
    "lgpl-2.0-text": "GNU Library General Public License Version 2, June 1991",
    "lgpl-2.1-text": "GNU Lesser General Public License Version 2.1, February 1999",
    "lgpl-3.0-text": "GNU Lesser General Public License Version 3, 29 June 2007",
    "mpl-1.1-text": "Mozilla Public License Version 1.1",
    "mpl-2.0-text": "Mozilla Public License Version 2.0",
    "cc0-1.0-text": "CC0 1.0 Universal",
}
for _name, _title in _TITLES.items():
    TEMPLATES[_name] = (Path(__file__).parent / "license_texts" / f"{_name}.txt").read_text(encoding="utf-8")
    IDENTITY[_name] = (_title,)


def _versions(name: str, versions: str) -> dict[str, list[str]]:
    """By version, the ways in which the name is given with it; two-part versions are written out."""
    out = {}
    for v in versions.split():
        forms = [v] if "." in v else [v, f"{v}.0"]
        out[v if "." in v else f"{v}.0"] = [x for f in forms for x in (f"{name} version {f}", f"{name} v{f}", f"{name} v. {f}", f"{name} {f}", f"version {f} of the {name}")]
    return out


def _names() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {
        "mit": ["MIT License", "MIT Licence"],
        "mit-0": ["MIT No Attribution License", "MIT-0 License"],
        "isc": ["ISC License", "ISC Licence"],
        "bsd": ["BSD License", "BSD Licence", "BSD-style License"],
        "0bsd": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License"],
        "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
        "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"],
        "bsd-4-clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License", "BSD-4-Clause"],
        "unlicense": ["the Unlicense", "Unlicense License"],
        "cc0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0", "Creative Commons CC0 1.0", "CC0 License"],
        "zlib": ["zlib License"],
        "bsl-1.0": ["Boost Software License"],
    }
    families = [
        ("apache", ("Apache License", "Apache Software License", "Apache"), "1.0 1.1 2"),
        ("gpl", ("GNU General Public License", "GNU GPL", "GPL"), "1 2 3"),
        ("lgpl", ("GNU Lesser General Public License", "GNU LGPL", "LGPL"), "2.1 3"),
        ("lgpl", ("GNU Library General Public License", "GNU LGPL", "LGPL"), "2"),
        ("agpl", ("GNU Affero General Public License", "GNU AGPL", "AGPL"), "1 3"),
        ("mpl", ("Mozilla Public License", "MPL"), "1.0 1.1 2"),
        ("epl", ("Eclipse Public License", "EPL"), "1 2"),
    ]
    for family, names, versions in families:
        for name in names:
            for v, forms in _versions(name, versions).items():
                out.setdefault(f"{family}-{v}", []).extend(forms)
            if " " in name:
                out.setdefault(family, []).append(name)
    for n in range(1, 4):
        out[f"gpl-{n}.0"] += [f"GPLv{n} License", f"GPLv{n} or later"]
    for n in ("2", "2.0"):
        out["apache-2.0"] += [f"Apache {n} License"]
    parts = {"by": ["Attribution"], "sa": ["ShareAlike", "Share Alike"], "nc": ["NonCommercial", "Non Commercial"], "nd": ["NoDerivatives", "NoDerivs", "No Derivatives"]}
    for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
        long = [" ".join(x) for x in product(*(parts[p] for p in kind.split("-")))]
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            out[f"cc-{kind}-{v}"] = [f"CC {kind} {v}", *[f"Creative Commons {x} {v}" for x in long]]
        out[f"cc-{kind}"] = [f"Creative Commons {x} License" for x in long]
    return out


#: Short grants by license: names that a text may give after "released under the" or "licensed under".
NAMES: dict[str, list[str]] = _names()


def _entries(templates: Mapping[str, str], identity: Mapping[str, Sequence[str]], names: Mapping[str, Sequence[str]]) -> list[tuple[str, str, tuple[str, ...]]]:
    """(license, template, phrases) of the templates and of the short grants."""
    out = [(name, text, tuple(identity.get(name, ()))) for name, text in templates.items()]
    for name, given in names.items():
        for x in dict.fromkeys([*given, *(x.replace("License", "Licence") for x in given)]):
            out += [(name, f"{form} {x}", (x,)) for form in ("Released under the", "Licensed under")]
        line = f"SPDX License Identifier {name}"
        out.append((name, line, (line,)))
    return out


def _increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (patience piles with back links)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[p], at[p] = v, k
    out = []
    k = at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two word sequences by patience alignment, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and in_b[w] == 1}
        pairs = [(where[w], j) for j, w in enumerate(b[b0:b1], b0) if w in where]
        anchors = [pairs[k] for k in _increasing([i for i, _ in pairs])]
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


def _hashed(texts: Sequence[str]) -> list[np.ndarray]:
    return [w for _, w in text_words(pa.array(list(texts), pa.large_string()), gap=PUNCTUATION)]


def _places(words: np.ndarray, phrase: np.ndarray) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if words[i] == phrase[0] and (words[i : i + n] == phrase).all()]


class Scanner:
    def __init__(self, entries: Sequence[tuple[str, str, tuple[str, ...]]], percent: int):
        self.percent = percent
        self.names = [e[0] for e in entries]
        self.words = _hashed([e[1] for e in entries])
        if any(len(w) < SEED_WORDS for w in self.words):
            raise ValueError(f"a template needs at least {SEED_WORDS} words")
        flat = [x for e in entries for x in e[2]]
        hashed = dict(zip(flat, _hashed(flat), strict=True))
        digits = _hashed([str(i) for i in range(100)])
        self.numbers, self.zero = {int(w[0]) for w in digits}, int(digits[0][0])
        self.phrases = []
        #: First two words of the pinning phrases; by length and words, the templates of the phrase.
        self.pins: dict[bytes, dict[int, dict[bytes, list[int]]]] = {}
        plain = []
        for t, (name, _, phrases) in enumerate(entries):
            at = []
            for x in phrases:
                where = _places(self.words[t], hashed[x])
                if not where or len(hashed[x]) < 2:
                    raise ValueError(f"the template {name} needs the phrase {x!r} of two words or more")
                at.append((where[0], len(hashed[x])))
            self.phrases.append(at)
            if at:
                p, n = at[0]
                w = self.words[t][p : p + n]
                self.pins.setdefault(w[:2].tobytes(), {}).setdefault(n, {}).setdefault(w.tobytes(), []).append(t)
            else:
                plain.append(t)
        starts = [np.frombuffer(k, dtype=self.words[0].dtype) for k in self.pins]
        self.pinned = np.zeros(1 << 16, dtype=bool)
        for w in starts:
            self.pinned[int(combine(w, 2)[0] & np.uint64(0xFFFF))] = True
        self.sets = [np.unique(w) for w in self.words]
        #: Words that tell siblings apart: those of all phrases, and numbers.
        self.telling = {int(w) for x in hashed.values() for w in x} | self.numbers
        plain += [t for t in range(len(entries)) if self.phrases[t] and len(self.words[t]) >= LONG]
        self.seeds = []
        for k in (SEED_WORDS - 1, SEED_WORDS):
            owners = [t for t in plain if (len(self.words[t]) < SHORT) == (k < SEED_WORDS)]
            grams = [np.unique(combine(self.words[t], k)) for t in owners]
            h = np.concatenate([*grams, np.zeros(0, np.uint64)])
            order = np.argsort(h, kind="stable")
            owner = np.repeat(np.array(owners, dtype=np.int64), [len(g) for g in grams])[order]
            seen = np.zeros(1 << 16, dtype=bool)
            seen[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.seeds.append((k, h[order], owner, seen))

    def find(self, words: np.ndarray, joined: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, words aligned) of each finding; joined tells whether one character parts a word from the next."""
        found = [*self._seeded(words, joined), *self._pinned(words, joined)]
        found.sort(key=lambda x: (-len(x[1]), len(self.words[x[0]]), x[0]))
        taken: set[int] = set()
        out = []
        for t, pairs, core in found:
            if 2 * sum(i in taken for i in core) < len(core):
                taken.update(i for i, _ in pairs)
                out.append((t, pairs[0][0], pairs[-1][0] + 1, len(pairs)))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _pinned(self, words: np.ndarray, joined: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], Iterable[int]]]:
        if len(words) < 2 or not self.pins:
            return
        done: dict[int, int] = {}
        for s in np.flatnonzero(self.pinned[(combine(words, 2) & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
            for n, by_words in self.pins.get(words[s : s + 2].tobytes(), {}).items():
                owners = by_words.get(words[s : s + n].tobytes(), ())
                if not owners or self._goes_on(words, joined, s + n):
                    continue
                for t in owners:
                    if s >= done.get(t, 0) and (pairs := self._around(words, joined, t, s, done.get(t, 0))):
                        done[t] = pairs[-1][0] + 1
                        yield t, pairs, range(s, s + n)

    def _goes_on(self, words: np.ndarray, joined: np.ndarray, end: int) -> bool:
        """Whether the number before end is only the first part of a version other than x.0."""
        return end < len(words) and bool(joined[end - 1]) and int(words[end - 1]) in self.numbers and int(words[end]) in self.numbers and int(words[end]) != self.zero

    def _around(self, words: np.ndarray, joined: np.ndarray, t: int, s: int, done: int) -> list[tuple[int, int]]:
        """The alignment of a template whose first phrase stands at s, empty where it falls short."""
        template = self.words[t]
        n, (p, size) = len(template), self.phrases[t][0]
        a, b = max(done, s - n), min(len(words), s + size + n)
        if 100 * np.isin(words[a:b], self.sets[t]).sum() < self.percent * n:
            return []
        left = align(words[a:s].tolist(), template[:p].tolist())
        right = align(words[s + size : b].tolist(), template[p + size :].tolist())
        pairs = [*[(i + a, j) for i, j in left], *[(s + k, p + k) for k in range(size)], *[(i + s + size, j + p + size) for i, j in right]]
        if 100 * len(pairs) < self.percent * n:
            return []
        where = {j: i for i, j in pairs}
        for q, m in self.phrases[t][1:]:
            at = [where.get(j) for j in range(q, q + m)]
            if at[0] is None or at != list(range(at[0], at[0] + m)) or self._goes_on(words, joined, at[0] + m):
                return []
        return pairs

    def _told(self, words: np.ndarray, joined: np.ndarray, t: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether each phrase is aligned, or but for fewer than half of its words, that foreign words replace one by one."""
        where = {j: i for i, j in pairs}
        for q, m in self.phrases[t]:
            known = [(where[j], j) for j in range(q, q + m) if j in where]
            if 2 * len(known) <= m or len({i - j for i, j in known}) > 1:
                return False
            shift = known[0][0] - known[0][1]
            if q + shift < 0 or q + m + shift > len(words):
                return False
            if any(int(words[j + shift]) in self.telling for j in range(q, q + m) if j not in where):
                return False
            if self._goes_on(words, joined, q + m + shift):
                return False
        return True

    def _seeded(self, words: np.ndarray, joined: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], Iterable[int]]]:
        for k, h, owners, seen in self.seeds:
            if len(words) < k:
                continue
            g = combine(words, k)
            at = np.flatnonzero(seen[(g & np.uint64(0xFFFF)).astype(np.int64)])
            lo = np.searchsorted(h, g[at], side="left")
            hi = np.searchsorted(h, g[at], side="right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(at):
                continue
            pos = np.repeat(at, hi - lo)
            owner = np.concatenate([owners[a:b] for a, b in zip(lo, hi, strict=True)])
            for t in np.unique(owner).tolist():
                seeds, n = pos[owner == t], len(self.words[t])
                if not self.phrases[t]:
                    yield from self._windows(words, t, n, seeds)
                    continue
                many = np.searchsorted(seeds, seeds + n) - np.arange(len(seeds)) >= SEED_PERCENT * n / 100
                for found in self._windows(words, t, n, seeds[many]):
                    if self._told(words, joined, t, found[1]):
                        yield found

    def _windows(self, words: np.ndarray, t: int, n: int, seeds: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], Iterable[int]]]:
        """Windows of about two template lengths over the seeds, left to right, none overlapping a finding."""
        done, template = 0, self.words[t].tolist()
        for s in seeds.tolist():
            if s < done:
                continue
            a, b = max(done, s - n), min(len(words), s + n + SEED_WORDS)
            if not len(template) * self.percent <= 100 * (b - a):
                continue
            pairs = align(words[a:b].tolist(), template)
            if pairs and 100 * len(pairs) >= self.percent * n:
                pairs = [(i + a, j) for i, j in pairs]
                done = pairs[-1][0] + 1
                yield t, pairs, [i for i, _ in pairs]


@lru_cache(maxsize=1)
def _scanner(entries: tuple[tuple[str, str, tuple[str, ...]], ...], percent: int) -> Scanner:
    return Scanner(entries, percent)


def _scan(templates: Mapping[str, str], percent: int, identity: Mapping[str, Sequence[str]], names: Mapping[str, Sequence[str]]):
    entries = tuple(_entries(templates, identity, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(entries, percent)
        for batch in batches:
            rows = []
            texts, ids = batch.column("text"), batch.column("doc_id")
            for at, words, start, end in text_word_spans(texts, gap=PUNCTUATION):
                for t, a, b, n in scanner.find(words, start[1:] - end[:-1] == 1):
                    raw = texts[at].as_py().encode()
                    first = len(raw[: start[a]].decode())
                    rows.append((ids[at].as_py(), scanner.names[t], first, first + len(raw[start[a] : end[b - 1]].decode()), n, len(scanner.words[t])))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), *[pa.array(x, pa.int64()) for x in c[2:]]], [f.split()[0] for f in SCHEMA.split(", ")]
                )

    return run


TEMPLATE_BYTES = 64 << 20


def templates_of(table: DataFrame, name_col: str = "license", text_col: str = "text", most: int = TEMPLATE_BYTES) -> dict[str, str]:
    """Templates by name from a table of license texts, of at most so many bytes as counted; null and blank texts are left out."""
    rows = table.select(F.col(f"`{name_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").alias("text")).where("name is not null and trim(text) <> ''")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    if size > most:
        raise ValueError(f"the license texts have {size} bytes; at most {most} are sent to the executors")
    return {r.name: r.text for r in rows.orderBy("name", "text").collect()}


def license_spans(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    identity: Mapping[str, Sequence[str]] = IDENTITY,
    names: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """doc_id, license, start, end, n_aligned, n_template_words of every license text found.

    For templates of the caller's own, only those are scanned for unless names are given, and
    identity has the phrases by template that must be aligned without a gap.
    """
    own = templates is not TEMPLATES
    known = {k: v for k, v in identity.items() if k in templates and not (own and identity is IDENTITY)}
    names = ({} if own else NAMES) if names is None else names
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(dict(templates), percent, known, dict(names)), SCHEMA)
