"""Licence scans with a generalised suffix automaton over the words of licence templates.

A text's words are streamed through the automaton; the matching statistics
give maximal matches, and long ones that follow each other in one template are
chained into a covered span of it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.llm.shared import without

#: Words of a match that counts; words that may stand between two matches of a chain.
LONG, GAP = 3, 40
#: Covered part of a text that gives its label; of a name, all words must be there.
COVER = 0.6

# Phrases of the base with their labels, and licence texts (label, words): names first, then notices and passages that stand alone.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
NAMES = (
    ("apache-2.0", "apache license version 2 0"),
    ("apache-2.0", "apache license 2 0"),
    ("apache-2.0", "apache license v2 0"),
    ("mit", "the mit license"),
    ("mit", "mit license copyright"),
    ("mit", "under mit license"),
    ("gpl-3.0", "general public license version 3"),
    ("gpl-3.0", "general public license v3"),
    ("gpl-2.0", "general public license version 2"),
    ("gpl-2.0", "general public license v2"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "the bsd license"),
    ("isc", "the isc license"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("mpl-2.0", "mozilla public license 2 0"),
    ("mpl-2.0", "mozilla public license v 2 0"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0"),
    ("cc0-1.0", "cc0 1 0 universal"),
)
TEXTS = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work where such license applies only to those patent claims licensable by such contributor that are necessarily infringed by their contribution s alone or by combination of their contribution s with the work to which such contribution s was submitted"),
    ("apache-2.0", "redistribution you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions you must give any other recipients of the work or derivative works a copy of this license and you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "disclaimer of warranty unless required by applicable law or agreed to in writing licensor provides the work and each contributor provides its contributions on an as is basis without warranties or conditions of any kind either express or implied including without limitation any warranties or conditions of title non infringement merchantability or fitness for a particular purpose"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program to make sure it remains free software for all its users"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)
TEMPLATES = NAMES + TEXTS

#: Bytes to bytes: A-Z to a-z, what stands between words to blanks; UTF-8 above ASCII is all of words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: template -> place after the last word of an occurrence
    ends: dict[int, int] = field(default_factory=dict)


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, templates: list[list[str]], names: int = 0):
        """The first `names` templates are names: they count wherever all their words stand, be it inside a longer match."""
        self.templates = templates
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in templates for w in t))}
        self.states = [State(0)]
        for t, words in enumerate(templates):
            last = 0
            for end, w in enumerate(words, 1):
                last = self._extend(last, self.ids[w])
                self.states[last].ends.setdefault(t, end)
        # an occurrence of a state is one of all its suffixes
        for s in sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length):
            up = self.states[self.states[s].link]
            for t, end in self.states[s].ends.items():
                up.ends.setdefault(t, end)
        self.next = [s.next for s in self.states]
        self.link = [s.link for s in self.states]
        self.length = [s.length for s in self.states]
        #: per state, the names that its strings end in
        self.whole: list[list[int]] = [[] for _ in self.states]
        for t, words in enumerate(templates[:names]):
            state = 0
            for w in words:
                state = self.next[state][self.ids[w]]
            self.whole[state].append(t)
        for s in sorted(range(1, len(self.states)), key=lambda s: self.length[s]):
            self.whole[s] = self.whole[s] + self.whole[self.link[s]]

    def _split(self, p: int, q: int, word: int) -> int:
        """A copy of q for the shorter strings that reach it from p."""
        self.states.append(State(self.states[p].length + 1, self.states[q].link, dict(self.states[q].next)))
        copy = len(self.states) - 1
        self.states[q].link = copy
        while p >= 0 and self.states[p].next.get(word) == q:
            self.states[p].next[word] = copy
            p = self.states[p].link
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.states[last].next.get(word)
        if known is not None:  # another template went this way
            return known if self.states[known].length == self.states[last].length + 1 else self._split(last, known, word)
        self.states.append(State(self.states[last].length + 1))
        new, p = len(self.states) - 1, last
        while p >= 0 and word not in self.states[p].next:
            self.states[p].next[word] = new
            p = self.states[p].link
        if p < 0:
            self.states[new].link = 0
        else:
            q = self.states[p].next[word]
            self.states[new].link = q if self.states[q].length == self.states[p].length + 1 else self._split(p, q, word)
        return new

    def matches(self, ids: list[int], at: int, least: int, names: list[tuple[int, int, int]] | None = None) -> Iterator[tuple[int, int, int]]:
        """Maximal matches (start, end, state) of at least `least` words in ids, which stand from `at` on in the text. names takes (template, start, end) of each name met."""
        state = size = 0
        for i, w in enumerate(ids, at + 1):
            grown = w in self.next[state]
            if not grown:
                if size >= least:
                    yield i - 1 - size, i - 1, state
                while state >= 0 and w not in self.next[state]:
                    state = self.link[state]
                size = self.length[state] if state >= 0 else 0
                state = max(state, 0)
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
                if names is not None and self.whole[state]:
                    names += [(t, i - n, i) for t in self.whole[state] if (n := len(self.templates[t])) <= size]
        if size >= least:
            yield at + len(ids) - size, at + len(ids), state


class Scanner:
    def __init__(self, names: tuple[tuple[str, str], ...] = NAMES, texts: tuple[tuple[str, str], ...] = TEXTS, base: tuple[tuple[str, str], ...] = BASE):
        templates = (*names, *texts)
        self.labels, self.names = [label for label, _ in templates], len(names)
        self.automaton = Automaton([words.split() for _, words in templates], len(names))
        self.known = {w.encode(): i for w, i in self.automaton.ids.items()}
        self.base = [([w.encode() for w in phrase.split()], label) for phrase, label in base]

    def base_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        out = []
        for phrase, label in self.base:
            at = -1
            try:
                while True:
                    at = words.index(phrase[0], at + 1)
                    if words[at : at + len(phrase)] == phrase:
                        out.append((at, label))
            except ValueError:
                pass
        return sorted(out)

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, covered part) of every chain of long matches, and of every name."""
        get = self.known.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        names: list[tuple[int, int, int]] = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= LONG:
                for start, end, state in self.automaton.matches(ids[a:b].tolist(), a, LONG, names):
                    for t, place in self.automaton.states[state].ends.items():
                        if t >= self.names:
                            found[t].append((start, end, place - (end - start), place))
        out = [(t, start, end, 1.0) for t, start, end in names]
        for t, parts in found.items():
            total = len(self.automaton.templates[t])
            chain: list | None = None  # start, end, place after, words covered
            for start, end, first, after in parts:
                fresh = min(end - start, after - chain[2]) if chain else 0
                if chain and fresh > 0 and start - chain[1] <= GAP and first >= chain[2] - (end - start) + 1:
                    chain[1:] = [end, after, chain[3] + fresh]
                else:
                    if chain:
                        out.append((t, chain[0], chain[1], chain[3] / total))
                    chain = [start, end, after, end - start]
            out.append((t, chain[0], chain[1], chain[3] / total))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def scan(self, text: bytes | None) -> dict:
        words = (text or b"").translate(WORD_BYTES).split()
        places = self.base_places(words)
        spans = [(self.labels[t], a, b, min(1.0, part)) for t, a, b, part in self.spans(words)]
        kept = [x for x in spans if x[3] >= COVER]
        base = {label for _, label in places}
        return {
            "n_words": len(words), "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[0] for x in kept})),
            "score": max((x[3] for x in spans), default=0.0), "spans": ",".join(f"{label}:{a}:{b}" for label, a, b, _ in kept),
        }


@cache
def scanner() -> Scanner:
    return Scanner()


COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string()}


def licenses(docs: DataFrame) -> DataFrame:
    """Adds COLUMNS to each row of docs; the text is not returned.

    n_base counts places of base phrases; spans are label:first word:word after
    the last, of templates that are covered enough; score is the largest
    covered part of any template. Null and empty texts have no words. Repeated
    rows are all returned, an empty table gives none, and columns of these names are replaced.
    """
    rest = without(docs, *COLUMNS, "text")
    packed = docs.select(F.struct(*[rest[c] for c in rest.columns]).alias("row"), F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for b in batches:
            found = [scan(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[c] for x in found], t) for c, t in COLUMNS.items())], ["row", *COLUMNS])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    schema = f"row {packed.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[t]}" for c, t in COLUMNS.items())
    return packed.mapInArrow(run, schema).select("row.*", *COLUMNS)
