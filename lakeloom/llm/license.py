"""License scans with a generalised suffix automaton of licence tokens.

All licence templates, and the base phrases, are inserted into one automaton over words.  A text is
streamed through it: each word's matching statistic is the longest run of words up to it that some
template holds.  Runs that cannot be extended pair words of the text with words of each template at
every place where it holds them; the best chains of pairs, in order on both sides, are the covered
spans.  Base phrases are read off the suffix links of the same states.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_rows

#: Base phrases and their labels (fixed values).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and template; every label may have several.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("cc0", "CC0 1.0 Universal"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("proprietary", "This file is proprietary and confidential"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)

#: Shortest run of words that counts as a match, share of a template that its chain must cover, and what
#: each word of the text that a chain leaves out takes from its weight (a word covered adds 1).
MIN_RUN, COVER, GAP = 2, 0.8, 0.25

# Word bytes: digits, a-z and everything from 0x80; A-Z lower-cased, the rest blank.
_table = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_table).split()


class SuffixAutomaton:
    """Generalised suffix automaton over integer tokens; ``ends`` gives per state all its ends, by template."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        self.template_length: list[int] = []

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, token)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return new

    def _clone(self, p: int, q: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def insert(self, tokens: list[int]) -> None:
        """Add a template."""
        last = 0
        for t in tokens:
            last = self._extend(last, t)
        self.template_length.append(len(tokens))

    def finish(self, templates: list[list[int]]) -> None:
        """Note for each state all ends of its strings in each template."""
        for number, tokens in enumerate(templates):
            state = 0
            for end, t in enumerate(tokens, 1):
                state = self.next[state][t]
                p = state
                while p > 0:
                    self.ends[p].setdefault(number, []).append(end)
                    p = self.link[p]

    def step(self, state: int, length: int, token: int | None) -> tuple[int, int]:
        """State and length of the longest match after one more token."""
        if token is None:
            return 0, 0
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if token in self.next[state]:
            return self.next[state][token], length + 1
        return 0, 0


class Scanner:
    def __init__(self, templates=TEMPLATES, base=BASE, min_run: int = MIN_RUN, cover: float = COVER, gap: float = GAP):
        self.gap = gap
        self.vocabulary: dict[bytes, int] = {}
        known = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text.encode())]
        lists = [known(t) for _, t in templates] + [known(t) for t, _ in base]
        self.labels = [label for label, _ in templates]
        self.base_labels = [label for _, label in base]
        self.min_run, self.cover = min_run, cover
        self.automaton = SuffixAutomaton()
        for x in lists:
            self.automaton.insert(x)
        self.automaton.finish(lists[: len(templates)])
        own: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(lists[len(templates) :]):
            state = 0
            for t in x:
                state = self.automaton.next[state][t]
            own.setdefault(state, []).append((len(x), i))
        #: per state: length and number of the base phrases that end its strings
        self.phrases: list[list[tuple[int, int]]] = []
        for state in range(len(self.automaton.next)):
            found, p = [], state
            while p > 0:
                found += own.get(p, [])
                p = self.automaton.link[p]
            self.phrases.append(found)

    def scan(self, tokens: list[bytes]) -> dict:
        """Base places, covered template spans and labels of one text."""
        get, automaton = self.vocabulary.get, self.automaton
        ids = list(map(get, tokens))
        base: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []  # first word, end, state
        state = length = 0
        previous = -1
        for at in [i for i, t in enumerate(ids) if t is not None]:
            if at != previous + 1:
                if length >= self.min_run:
                    runs.append((previous + 1 - length, previous + 1, state))
                state = length = 0
            new_state, new_length = automaton.step(state, length, ids[at])
            if new_length != length + 1 and length >= self.min_run:
                runs.append((at - length, at, state))
            state, length, previous = new_state, new_length, at
            for size, number in self.phrases[state]:
                if size <= length:
                    base.append((at + 1 - size, number))
        if length >= self.min_run:
            runs.append((previous + 1 - length, previous + 1, state))
        spans = self.chain(runs)
        return {"n_words": len(tokens), "base": base, "spans": spans}

    def chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered share) of every span of a template that chained runs cover well enough."""
        pairs: dict[int, set[tuple[int, int]]] = {}
        for start, end, state in runs:
            for number, stops in self.automaton.ends[state].items():
                own = pairs.setdefault(number, set())
                for stop in stops:
                    own.update(zip(range(start, end), range(stop - (end - start), stop)))
        out = []
        for number, found in pairs.items():
            size = self.automaton.template_length[number]
            for chain in chains(found, size, self.gap, self.cover * size):
                out.append((self.labels[number], chain[0], chain[-1] + 1, len(chain) / size))
        return sorted(out)


def chains(pairs: Iterable[tuple[int, int]], size: int, gap: float, need: float) -> list[list[int]]:
    """Text words of the best chains of (text word, template word) pairs that cover ``need`` words, heaviest first.

    Both words rise along a chain; its weight is its pairs less ``gap`` for each text word between them.
    Chains share no span of the text.  One pass finds the best chain that ends in each pair, with a tree
    of prefix maxima over the template; the chains are then taken heaviest first.
    """
    ordered = sorted(pairs)
    if len(ordered) < need:
        return []
    tree: list[tuple[float, int]] = [(0.0, -1)] * (size + 1)  # weight made comparable across text words, pair
    weight, before = [0.0] * len(ordered), [-1] * len(ordered)
    lo = 0
    while lo < len(ordered):
        word, hi = ordered[lo][0], lo
        while hi < len(ordered) and ordered[hi][0] == word:
            at, best, last = ordered[hi][1], float("-inf"), -1
            while at > 0:
                if tree[at][1] >= 0 and tree[at][0] > best:
                    best, last = tree[at]
                at -= at & -at
            best -= gap * word
            weight[hi], before[hi] = (1 + best, last) if best > 0 else (1.0, -1)
            hi += 1
        for i in range(lo, hi):
            at, value = ordered[i][1] + 1, weight[i] + gap * (word + 1)
            while at <= size:
                if tree[at][1] < 0 or value > tree[at][0]:
                    tree[at] = value, i
                at += at & -at
        lo = hi
    taken: list[tuple[int, int]] = []
    used = [False] * len(ordered)
    out = []
    for i in sorted(range(len(ordered)), key=lambda i: (-weight[i], i)):
        chain, p = [], i
        while p >= 0 and not used[p]:
            used[p] = True
            chain.append(ordered[p][0])
            p = before[p]
        chain.reverse()
        if len(chain) >= need and not any(a <= chain[-1] and chain[0] <= b for a, b in taken):
            taken.append((chain[0], chain[-1]))
            out.append(chain)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,end:int,cover:double>>"


def license_scan(docs: DataFrame, templates=TEMPLATES, base=BASE, min_run: int = MIN_RUN, cover: float = COVER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: base phrase places, labels and covered spans.

    ``score`` is the largest covered share of a template (1 for a base phrase), 0 without a label.
    Null and empty texts have no words; label lists are then empty texts and word places null;
    repeated rows stay; other columns are ignored.
    """
    built: list[Scanner] = []

    def rows(keys, texts):
        if not built:
            built.append(Scanner(templates, base, min_run, cover))
        scanner = built[0]
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for key, text in zip(keys, texts):
            got = scanner.scan(words(text))
            places = [p for p, _ in got["base"]]
            own = {scanner.base_labels[i] for _, i in got["base"]}
            more = own | {s[0] for s in got["spans"]}
            score = 1.0 if own else max((s[3] for s in got["spans"]), default=0.0)
            spans = [{"label": a, "first": b, "end": c, "cover": d} for a, b, c, d in got["spans"]]
            for name, value in zip(out, (key, got["n_words"], len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(more)), min(score, 1.0), spans)):
                out[name].append(value)
        yield out

    return arrow_rows(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")), rows, SCHEMA)
