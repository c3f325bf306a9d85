"""Licence scans with a generalised suffix automaton.

The automaton is built over the words of all templates. A text streams through it once and yields matching statistics:
for each word, the longest run of words ending there that some template holds. Right-maximal runs of at least MIN_RUN
words are chained, template by template, in the order of the template's own words; what a chain covers of its template
is the score, and a template covered by at least MIN_COVER gives its label; a short one must be covered whole, and one whose
span lies inside that of a longer template with another label gives none. Short phrases are templates of their own
that must stand whole: one ends wherever the matched run has the phrase as a suffix.

Defined results: a null or empty text has no words, no labels, nulls for first and last word and score 0; a null doc_id is
carried; repeated rows are scanned alike; other columns are not read. Of equally long chains the earlier one counts.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from breakweave.llm.common import per_document, text_bytes

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIN_RUN, MIN_COVER = 4, 0.6
#: A template of fewer words than this must stand whole and unbroken: one word more or less makes it another licence.
SHORT = 12
#: Words that may stand between two runs of a chain.
MAX_GAP = 40

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Terms and notices of common public licences, with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Licensed under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-notice", "licensed under the GNU General Public License, version 3"),
    ("lgpl-notice", "licensed under the GNU Lesser General Public License, version 3"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc-by-notice", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("no-reuse", "No part of this publication may be reproduced or transmitted in any form without permission"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
]


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.translate(UPPER))


class Automaton:
    """Generalised suffix automaton over the words of several templates."""

    def __init__(self, texts: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: (template, end) pairs of the occurrences that first reached the state
        self.ends: list[list[tuple[int, int]]] = [[]]
        for t, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._extend(last, word)
                self.ends[last].append((t, at + 1))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in order:
            if self.link[s] > 0:
                self.ends[self.link[s]] = sorted({*self.ends[self.link[s]], *self.ends[s]})

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        clone = self._state(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: str) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        cur, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return cur

    def locate(self, words: list[str]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(label, words_of(phrase)) for phrase, label in phrases.items()]
        self.labels = [label for label, _ in templates]
        self.texts = [words_of(x) for _, x in templates]
        self.auto = Automaton(self.texts + [p for _, p in self.phrases])
        ending: dict[int, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.phrases):
            ending[self.auto.locate(words)].append(k)
        #: the phrases that a state's own string, or a suffix of it, ends with
        self.ending: list[list[int]] = [[] for _ in self.auto.next]
        for s in sorted(range(len(self.auto.next)), key=self.auto.length.__getitem__):
            self.ending[s] = ending.get(s, []) + (self.ending[self.auto.link[s]] if s else [])
        self.known = {w for words in [*self.texts, *(p for _, p in self.phrases)] for w in words}

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """((phrase, first word) of every place, (state, run length, end) of every right-maximal run)."""
        step, link, size, ending, known = self.auto.next, self.auto.link, self.auto.length, self.ending, self.known
        places, runs = [], []
        state = run = last = 0
        for at in [i for i, w in enumerate(words) if w in known]:
            if run and at != last + 1:
                if run >= MIN_RUN:
                    runs.append((state, run, last + 1))
                state = run = 0
            last, word = at, words[at]
            if word not in step[state]:
                if run >= MIN_RUN:
                    runs.append((state, run, at))
                while state and word not in step[state]:
                    state = link[state]
                run = size[state]
            state, run = step[state][word], run + 1
            for k in ending[state]:
                if len(self.phrases[k][1]) <= run:
                    places.append((k, at + 1 - len(self.phrases[k][1])))
        if run >= MIN_RUN:
            runs.append((state, run, last + 1))
        return places, runs

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template covered) of each template's best chain."""
        by_template: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for state, run, end in runs:
            for t, stop in self.auto.ends[state]:
                if t < len(self.texts) and stop >= run:
                    by_template[t].append((end, run, stop))
        found = []
        for t, own in by_template.items():
            best: tuple[int, int, int] = (0, 0, 0)
            alive: list[tuple[int, int, int, int]] = []  # (end in text, end in template, words covered, first word)
            for end, run, stop in sorted(set(own)):
                alive = [a for a in alive if end - run - a[0] <= MAX_GAP]
                covered, first = run, end - run
                for text_end, template_end, before, start in alive:
                    fresh = min(run, end - text_end, stop - template_end)
                    if fresh > 0 and text_end <= end and (before + fresh, -start) > (covered, -first):
                        covered, first = before + fresh, start
                # a chain that ends no further and covers no more than another is never the better one
                alive = [a for a in alive if not (a[1] >= stop and a[2] <= covered)] + [(end, stop, covered, first)]
                if covered > best[0]:
                    best = (covered, first, end)
            size = len(self.texts[t])
            if size >= SHORT or (best[0] == size and best[2] - best[1] == size):
                found.append((self.labels[t], best[1], best[2], best[0] / size))
        return found

    def covered(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Of chains() those that cover enough, without any that lies inside a longer one of another label."""
        chains = [c for c in self.chains(runs) if c[3] >= MIN_COVER]
        inside = lambda c, d: d[1] <= c[1] and c[2] <= d[2] and d[2] - d[1] > c[2] - c[1] and d[0] != c[0]
        return [c for c in chains if not any(inside(c, d) for d in chains)]


def scan(df: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def work():
        scanner = Scanner(phrases, templates)

        def each(doc_id, text):
            words = words_of(text)
            places, runs = scanner.scan(words)
            base = sorted({scanner.phrases[k][0] for k, _ in places})
            chains = scanner.covered(runs)
            starts = [at for _, at in places]
            score = max([1.0 * bool(places), *(c[3] for c in chains)], default=0.0)
            labels = sorted({*base, *(c[0] for c in chains)})
            spans = [{"label": a, "first_word": b, "end_word": c, "covered": d} for a, b, c, d in sorted(chains, key=lambda c: (c[1], c[0]))]
            return (doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), min(1.0, score), spans), 160

        return each

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,covered:double>>"
    return text_bytes(df, id_col, text_col).mapInArrow(per_document(schema, work), ddl)
