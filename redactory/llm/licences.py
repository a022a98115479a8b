"""Licence scans: which licence texts and notices a document holds, and where.

A generalised suffix automaton over the words of all templates and phrases is built once and sent to the tasks; its size is
that of the templates, a parameter of at most `MOST_WORDS` words. A file streams through it word by word: the state and the
length of the longest match that ends there (matching statistics) tell all maximal matches with each template, by the ends
that the state and its suffix links stand for. Pairs of neighbouring words that no template has end every match, so only the
stretches between them are streamed, which leaves little of ordinary text.

- A phrase is found wherever its words stand consecutively.
- Matches of at least `match` words with a template are chained: both places rise from one to the next, no more than `gap`
  words are skipped on either side, and what two matches share counts once. Chains that cover at least `share` of the
  template count; of those that overlap in the text, of whatever templates, the one that covers most words is a span (then
  that with the larger share, then the first).

Score: the largest share of a template that any chain covers, 1 if a phrase is found.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with ASCII letters in lower case, told apart by 64 bits of hash. Null and empty
texts have no words, empty labels and score 0. Rows without an id are dropped; repeated rows keep a row each. Extra columns
are ignored. An empty table gives an empty table. Texts are taken in parts of some megabytes, there is no shuffle.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm._common import lean, lower_ascii, parts, spans, text_buffer, word_hashes

#: Templates beyond this are refused: the automaton goes to every task.
MOST_WORDS = 1_000_000

PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NOTICES = [
    ("agpl", "GNU Affero General Public License"),
    ("apache-2.0", "Apache License, Version 2.0"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("bsl-1.0", "Boost Software License, Version 1.0"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("epl-2.0", "Eclipse Public License 2.0"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("isc", "the ISC License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "the MIT License"),
    ("mpl-2.0", "Mozilla Public License, version 2.0"),
]
TEMPLATES = [
    *((label, f"{opening} {notice}") for label, notice in _NOTICES for opening in ("released under", "licensed under", "licensed under the") if not (opening.endswith("the") and notice.startswith(("the ", "CC ")))),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", _GPL.format(2)),
    ("gpl-3.0", _GPL.format(3)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
]

_GAPS = np.zeros(256, dtype=bool)
_GAPS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column and each row's offsets in them."""
    buf, offs = text_buffer(col)
    buf = lower_ascii(buf)
    starts, ends, rows = spans(buf, offs, _GAPS)
    return word_hashes(buf, starts, ends), rows


class Automaton:
    """A generalised suffix automaton: a state stands for the strings that end at the same places of the given ones."""

    def __init__(self, strings: list[list[int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for s, tokens in enumerate(strings):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                ends.extend([] for _ in range(len(self.go) - len(ends)))
                ends[last].append((s, at))
        below: list[list[int]] = [[] for _ in self.go]
        for state in range(1, len(self.go)):
            below[self.link[state]].append(state)
        #: Ends (string, place) of the strings, so ordered that those of a state and all below it are self.ends[first:last].
        self.ends: list[tuple[int, int]] = []
        self.first, self.last = [0] * len(self.go), [0] * len(self.go)
        todo = [(0, False)]
        while todo:
            state, done = todo.pop()
            if done:
                self.last[state] = len(self.ends)
                continue
            self.first[state] = len(self.ends)
            self.ends += ends[state]
            todo.append((state, True))
            todo += [(x, False) for x in below[state]]

    def _new(self, go: dict[int, int], link: int, size: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        return len(self.go) - 1

    def _split(self, state: int, token: int) -> int:
        """The state of the string of `state` with the token behind it, where a state that stands for longer ones holds it."""
        to = self.go[state][token]
        if self.size[to] == self.size[state] + 1:
            return to
        own = self._new(dict(self.go[to]), self.link[to], self.size[state] + 1)
        self.link[to] = own
        while state >= 0 and self.go[state].get(token) == to:
            self.go[state][token] = own
            state = self.link[state]
        return own

    def _extend(self, last: int, token: int) -> int:
        if token in self.go[last]:
            return self._split(last, token)
        own = self._new({}, 0, self.size[last] + 1)
        while last >= 0 and token not in self.go[last]:
            self.go[last][token] = own
            last = self.link[last]
        if last >= 0:
            self.link[own] = self._split(last, token)
        return own

    def stream(self, tokens: list[int]):
        """Of each token the state and the length of the longest match that ends there."""
        go, link, size, state, n = self.go, self.link, self.size, 0, 0
        for token in tokens:
            while state and token not in go[state]:
                state = link[state]
                n = size[state]
            state = go[state].get(token, 0)
            n = n + 1 if state else 0
            yield state, n

    def suffixes(self, state: int, least: int) -> list[tuple[int, int, int]]:
        """(string, place, length) of all ends that matches of at least `least` words have, with the longest there (what the state stands for, at most)."""
        out, seen = [], (self.first[state], self.first[state])
        while state > 0 and self.size[state] >= least:
            a, b = self.first[state], self.last[state]
            out += [(*self.ends[i], self.size[state]) for r in (range(a, seen[0]), range(seen[1], b)) for i in r]
            seen, state = (a, b), self.link[state]
        return out


class Scanner:
    """Phrases, templates and the automaton over both."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], match: int, gap: int, share: float):
        self.labels, self.phrases, self.match, self.gap, self.share = [x for x, _ in templates], [x for x, _ in phrases], match, gap, share
        hashes, rows = _words(pa.array([t for _, t in [*phrases, *templates]], pa.string()))
        if len(hashes) > MOST_WORDS:
            raise ValueError(f"templates have {len(hashes)} words, more than {MOST_WORDS}")
        self.known, ids = np.unique(hashes, return_inverse=True)
        ids = ids.reshape(-1)
        strings = [ids[a:b].tolist() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
        if any(not s for s in strings):
            raise ValueError("a phrase or template has no words")
        self.strings = strings
        self.automaton = Automaton(strings)
        self.pairs = np.unique(np.array([a * len(self.known) + b for s in strings for a, b in zip(s, s[1:])], np.int64))
        self.single = match < 2 or any(len(s) < 2 for s in strings[: len(phrases)])
        self.seen: dict[int, tuple[list, list]] = {}

    def _at(self, state: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """The phrases that may end with a state, with their lengths, and the template places."""
        if state not in self.seen:
            k = len(self.phrases)
            ends = [(s, at + 1) for s, at, size in self.automaton.suffixes(state, 1) if s < k and at + 1 == len(self.strings[s]) <= size]
            self.seen[state] = ends, [x for x in self.automaton.suffixes(state, self.match) if x[0] >= k]
        return self.seen[state]

    def scan(self, words: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(phrase, start) of all places of phrases, and (template, start, template's start, length) of all maximal matches."""
        if not len(words):
            return [], []
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        at[self.known[at] != words] = -1
        if self.single:
            joined = (at[1:] >= 0) & (at[:-1] >= 0)
        else:
            pair = np.where((at[1:] >= 0) & (at[:-1] >= 0), at[:-1] * len(self.known) + at[1:], -1)
            near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = (self.pairs[near] == pair) & (pair >= 0)
        inside = np.concatenate(([False], joined, [False]))
        begins, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        if self.single:
            alone = np.flatnonzero((at >= 0) & ~inside[1:] & ~inside[:-1])
            begins, stops = np.concatenate((begins, alone)), np.concatenate((stops, alone + 1))
        found, matches, strings = [], [], self.strings
        for a, b in sorted(zip(begins.tolist(), stops.tolist())):
            tokens = at[a:b].tolist()
            for i, (state, n) in enumerate(self.automaton.stream(tokens)):
                if not n:
                    continue
                phrases, ends = self._at(state)
                found += [(p, a + i + 1 - size) for p, size in phrases if size <= n]
                if n >= self.match and ends:
                    then = tokens[i + 1] if i + 1 < len(tokens) else -1
                    for s, e, size in ends:
                        if e + 1 == len(strings[s]) or strings[s][e + 1] != then:
                            size = min(size, n)
                            matches.append((s - len(self.phrases), a + i + 1 - size, e + 1 - size, size))
        return found, matches

    def chains(self, matches: list[tuple[int, int, int, int]]) -> tuple[list[tuple[str, int, int, float]], float]:
        """(label, start, end, share) of the spans, and the largest share that a chain covers."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for t, *m in matches:
            by.setdefault(t, []).append(tuple(m))
        full, most = [], 0.0
        for t, own in by.items():
            whole = len(self.strings[len(self.phrases) + t])
            own.sort()
            sums, starts, open_ = [], [], []
            for j, (x, y, n) in enumerate(own):
                best, start = n, x
                open_ = [k for k in open_ if own[k][0] + own[k][2] + self.gap >= x]
                for k in open_:
                    u, v, m = own[k]
                    shared = max(0, u + m - x, v + m - y)
                    if u < x and v < y and y - v - m <= self.gap and shared < n and (sums[k] + n - shared, -starts[k]) > (best, -start):
                        best, start = sums[k] + n - shared, starts[k]
                sums.append(best)
                starts.append(start)
                open_.append(j)
            most = max(most, max(sums) / whole)
            full += [(-n, -n / whole, a, x + m, self.labels[t]) for n, a, (x, _, m) in zip(sums, starts, own) if n >= self.share * whole]
        out, at = [], []  # by start
        for _, share, a, b, label in sorted(full):
            i = bisect.bisect(at, a)
            if (not i or out[i - 1][2] <= a) and (i == len(at) or b <= at[i]):
                at.insert(i, a)
                out.insert(i, (label, a, b, -share))
        return out, most


_SPANS = "array<struct<label: string, start: long, end: long, share: double>>"
_SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {_SPANS}"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])))])


def _described(batch: pa.RecordBatch, scanner: Scanner) -> pa.RecordBatch:
    words, rows = _words(batch.column(1))
    out = []
    for key, a, b in zip(batch.column(0).to_pylist(), rows[:-1].tolist(), rows[1:].tolist()):
        found, matches = scanner.scan(words[a:b])
        spanned, most = scanner.chains(matches)
        base = sorted({scanner.phrases[p] for p, _ in found})
        places = [at for _, at in found]
        labels = sorted({*base, *(x[0] for x in spanned)})
        told = [dict(zip(("label", "start", "end", "share"), x)) for x in spanned]
        out.append((key, b - a, len(found), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), 1.0 if found else most, told))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def licence_scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, match: int = 3, gap: int = 8, share: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: places of the phrases, labels of phrases and templates, score and spans.

    templates, phrases: (label, text); by default the ones above. Places are word numbers from 0."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    Scanner(templates, phrases, match, gap, share)  # refuses what it can't take here rather than in the tasks

    def run(batches):
        scanner = Scanner(templates, phrases, match, gap, share)
        for batch in batches:
            for part in parts(batch, size=2 << 20):
                yield _described(part, scanner)

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return docs.mapInArrow(lean(run), _SCHEMA)
