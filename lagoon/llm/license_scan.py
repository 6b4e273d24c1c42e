"""Licence scans by matching statistics over a generalised suffix automaton of licence tokens.

The automaton is built over the token sequences of all templates. A text is streamed through it once:
after each word, the length of the longest suffix of what was read that occurs in some template (its
matching statistic) and the state reached. Maximal matches of at least ``MIN_MATCH`` words are anchors;
anchors that continue a template in order, with gaps of at most ``MAX_GAP`` words on either side, are
chained, and a chain's covered share of its template is that template's score. A template whose
best chain covers at least ``MIN_COVER`` adds its label. Base phrases are templates that need full
cover; their places are read from the same stream: a phrase stands where the match reaches its length
in a state that holds it. Places of base phrases are confirmed word by word; anchors rest on the 64-bit
hashes by which words are recognised.

Only runs of words that the templates use are streamed: a word outside their vocabulary resets the
match, so it needs no step. Words are recognised by hash, vectorised over a batch.

Defined cases: null and empty texts have no words, empty labels, null places and score 0. Repeated
rows give repeated answers. Other columns are ignored. Memory grows with one text at a time.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm import textkernel as K
from lagoon.llm.common import lean

MIN_MATCH = 4
MAX_GAP = 24
MIN_COVER = 0.75

# Base phrases and labels, which the contract of the query names.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Passages and notices of public licences, each with the label that it adds. The passages of
# MIT, ISC, zlib and the BSD licences are their whole texts, without names and numbers.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "licensed under the bsd license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("gpl", "licensed under the gnu general public license version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version"),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
]


class SuffixAutomaton:
    """A generalised suffix automaton over integer tokens of several sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, end) of occurrences
        for k, seq in enumerate(sequences):
            state = 0
            for i, token in enumerate(seq):
                state = self._extend(state, token)
                self.ends[state].add((k, i + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, at: int, token: int, to: int) -> int:
        twin = self._new(self.length[at] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = twin
        while at != -1 and self.next[at].get(token) == to:
            self.next[at][token] = twin
            at = self.link[at]
        return twin

    def _extend(self, last: int, token: int) -> int:
        to = self.next[last].get(token)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, token, to)
        state = self._new(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and token not in self.next[at]:
            self.next[at][token] = state
            at = self.link[at]
        if at != -1:
            to = self.next[at][token]
            self.link[state] = to if self.length[to] == self.length[at] + 1 else self._split(at, token, to)
        return state

    def step(self, state: int, matched: int, token: int) -> tuple[int, int]:
        """State and matching statistic after one more token."""
        while token not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return self.next[state][token], matched + 1


class Scanner:
    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None):
        phrases = PHRASES if phrases is None else phrases
        templates = TEMPLATES if templates is None else templates
        texts = [*phrases, *(t for _, t in templates)]
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.base = len(phrases)
        tokens = [t.split() for t in texts]
        self.size = [len(t) for t in tokens]
        self.vocab = {w: i for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.automaton = SuffixAutomaton([[self.vocab[w] for w in t] for t in tokens])
        # states that end a whole phrase: state -> [(sequence, size)]
        self.finals: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for s, ends in enumerate(self.automaton.ends):
            for k, end in ends:
                if k < self.base and end == self.size[k]:
                    self.finals[s].append((k, end))
        words = list(self.vocab)
        data, off = K.from_strings(words)
        h = K.word_hashes(data, off[:-1], off[1:]) if words else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes, self.tokens = h[order], np.arange(len(words))[order]
        self.words = [w.encode() for w in words]
        self.shortest = min([MIN_MATCH, *self.size[: self.base]])

    def tokenise(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Token of each word, -1 outside the vocabulary."""
        h = K.word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        return np.where(self.hashes[at] == h, self.tokens[at], -1) if len(self.hashes) else np.full(len(h), -1)

    def scan(self, tokens: np.ndarray):
        """(places of phrases [(phrase, start)], anchors [(start, length, state)]) of one text."""
        places: list[tuple[int, int]] = []
        anchors: list[tuple[int, int, int]] = []
        known = tokens >= 0
        if not known.any():
            return places, anchors
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        step = self.automaton.step
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for i, token in enumerate(tokens[a:b].tolist(), a):
                before, was = state, matched
                state, matched = step(state, matched, token)
                if matched <= was and was >= MIN_MATCH:
                    anchors.append((i - was, was, before))
                # phrases that end here: the state's own and those of its suffixes
                s = state
                while s > 0:
                    if s in self.finals:
                        n_here = matched if s == state else self.automaton.length[s]
                        for k, size in self.finals[s]:
                            if n_here >= size and self.automaton.length[self.automaton.link[s]] < size:
                                places.append((k, i + 1 - size))
                    s = self.automaton.link[s]
            if matched >= MIN_MATCH:
                anchors.append((b - matched, matched, state))
        return places, anchors

    def chains(self, anchors) -> dict[int, list[tuple[float, int, int]]]:
        """Template -> (covered share, first word, word after the last) of its best chain, then of all
        that cover MIN_COVER and overlap no better one."""
        per: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start, length, state in anchors:
            for k, end in self.automaton.ends[state]:
                if k >= self.base:
                    per[k].append((start, end - length, length))
        best: dict[int, list[tuple[float, int, int]]] = {}
        for k, found in per.items():
            ends: list[tuple[float, int, int]] = []
            open_: list[list[int]] = []  # [text end, template end, covered, first]
            for start, at, length in sorted(found):
                top, first = 0, start
                for e, q, covered, f in open_:
                    cut = max(0, q - at, e - start)  # overlap with what is covered
                    if cut < length and start + cut - e <= MAX_GAP and 0 <= at + cut - q <= MAX_GAP and covered - cut > top - cut:
                        top, first = covered - cut, f
                open_ = [x for x in open_ if start - x[0] <= MAX_GAP]
                now = [start + length, at + length, max(top, 0) + length, first]
                open_.append(now)
                ends.append((min(1.0, now[2] / self.size[k]), now[3], now[0]))
            ends.sort(key=lambda c: -c[0])
            best[k] = ends[:1]
            taken = [ends[0][1:]]  # ascending and apart
            for share, f, e in ends[1:]:
                if share < MIN_COVER:
                    break
                at = bisect(taken, (f, e))
                if (at == 0 or taken[at - 1][1] <= f) and (at == len(taken) or e <= taken[at][0]):
                    taken.insert(at, (f, e))
                    best[k].append((share, f, e))
        return best

    def report(self, data: np.ndarray, offsets: np.ndarray):
        """(n_words, n_base, first, last, base_labels, labels, score, spans) of each row."""
        for a, b in K.slices(offsets):
            part, off = K.lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            starts, ends, first = K.spans(part, off, K.ALNUM)
            tokens = self.tokenise(part, starts, ends)
            for r in range(b - a):
                lo, hi = int(first[r]), int(first[r + 1])
                places, anchors = self.scan(tokens[lo:hi])
                places = [
                    (k, p) for k, p in places
                    if all(bytes(part[starts[lo + p + j] : ends[lo + p + j]]) == self.words[tokens[lo + p + j]] for j in range(self.size[k]))
                ]
                chains = self.chains(anchors)
                base = {self.labels[k] for k, _ in places}
                spans = sorted({(self.labels[k], f, e, round(c, 6)) for k, found in chains.items() for c, f, e in found if c >= MIN_COVER})
                at = [p for _, p in places]
                score = max([1.0 if places else 0.0, *(found[0][0] for found in chains.values())])
                yield (
                    hi - lo, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {s[0] for s in spans})), float(score), spans,
                )


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=None, templates=None) -> DataFrame:
    """id_col, the counts, places, labels and score of each row, and the covered template spans."""
    scanner = Scanner(phrases, templates)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = list(scanner.report(*K.buffers(batch.column(1))))
            cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(TYPES)]
            spans = pa.array([[dict(zip(("label", "first_word", "end_word", "cover"), s, strict=True)) for s in r[7]] for r in rows], SPAN)
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, spans], names=[id_col, *NAMES, "spans"])

    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,cover:double>>"
    return docs.select(id_col, F.col(text_col).cast("string").alias("_t")).mapInArrow(lean(run), schema)
