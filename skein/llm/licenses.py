"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template. A text's words are streamed through it, which gives at each word the
length of the longest run ending there that some template contains (its matching statistics). Runs that cannot be extended and
are long, or make up a whole short template, are chained per template: hits in order and not far apart form a span, of all such chains
those that cover most, and the share of the template's words that a span covers decides on the label. Separately, the base phrases are
counted at all their places.

Words: A-Z lower-cased, then runs of letters and digits of ASCII and of anything beyond ASCII. Null texts count as empty, an empty
text has no words, no labels and score 0. Repeated rows come back one each; other columns are ignored.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, word_table

#: What separates words, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licence texts and the short notices by which works name their licence, as words.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation version 2"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
]

#: A run counts as a hit from so many words on (a whole template may be shorter), hits chain over gaps of so many words at most,
#: and a chain names its template when it covers so large a share of it.
LEAST_RUN, LARGEST_GAP, LEAST_COVER = 5, 12, 0.6


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers: one state per set of runs with the same ends, with suffix links."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # template -> all ends of the state's runs in it, in order
        last_states = []
        for which, seq in enumerate(sequences):
            last = 0
            for at, w in enumerate(seq):
                last = self._extend(last, w)
                self.ends[last].setdefault(which, []).append(at + 1)
            last_states.append(last)
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.longest[s]):
            if (up := self.link[s]) > 0:
                for which, at in self.ends[s].items():
                    self.ends[up][which] = sorted({*self.ends[up].get(which, []), *at})
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.next]  # (template, size) that a run of the state ends with
        for which, last in enumerate(last_states):
            self.whole[last].append((which, len(sequences[which])))
        for s in sorted(range(1, len(self.next)), key=lambda s: self.longest[s]):
            self.whole[s] += self.whole[self.link[s]]

    def _state(self, longest: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.longest[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier template holds this run already
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, q, w)
        new = self._state(self.longest[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, q, w)
        return new

    def runs(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, state) of the runs of words that templates contain and that the next word does not extend. Linear time."""
        out, s, n = [], 0, 0
        for at, w in enumerate(words):
            if w not in self.next[s]:
                if n:
                    out.append((at - n, at, s))
                while s and w not in self.next[s]:
                    s = self.link[s]
                    n = self.longest[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
        if n:
            out.append((len(words) - n, len(words), s))
        return out


    def completed(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, template) wherever a whole template stands in words, whatever follows. Linear time and a step for each find."""
        out, s, n = [], 0, 0
        for at, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.longest[s]
            if w in self.next[s]:
                s, n = self.next[s][w], n + 1
                out += [(at + 1 - size, at + 1, which) for which, size in self.whole[s] if size <= n]
        return out


def chains(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, covered words) of chains of hits (end, start, end inside the template), which come sorted; no two overlap in the text.

    A hit goes on from the chain that covers most, among those that end at most LARGEST_GAP words before it, begin before it and
    stand no further in the template (runs of repeated words may share one). Best chains are taken first.
    """
    best: list[tuple[int, int]] = []  # (covered words, start of the chain) up to and with each hit
    for i, (z, a, end) in enumerate(hits):
        top = (z - a, a)
        for j in range(bisect.bisect_left(hits, (a - LARGEST_GAP,), hi=i), i):
            y, x, before = hits[j]
            if x < a and before - 1 <= end - (z - a):
                top = max(top, (best[j][0] + z - max(a, y), best[j][1]), key=lambda t: (t[0], -t[1]))
        best.append(top)
    out: list[tuple[int, int, int]] = []
    for n, a, z in sorted(((n, a, hits[i][0]) for i, (n, a) in enumerate(best)), key=lambda t: (-t[0], t[1], t[2])):
        at = bisect.bisect_left(out, (a, z, n))
        if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or out[at][0] >= z):
            out.insert(at, (a, z, n))
    return out


class Scanner:
    def __init__(self):
        numbers: dict[str, int] = {}
        number = lambda text: [numbers.setdefault(w, len(numbers)) for w in text.split()]
        self.templates = [(label, number(text)) for label, text in TEMPLATES]
        self.base = [(label, number(text)) for text, label in BASE.items()]
        self.words = pa.array(list(numbers))
        self.automaton = SuffixAutomaton([t for _, t in self.templates])

    def spans(self, words: list[int], offset: int = 0) -> list[tuple[int, int, str, float]]:
        """(start, end, label, covered share) of the template spans in a stretch of known words."""
        hits: dict[int, set[tuple[int, int, int]]] = {}  # template -> (end, start, end inside the template)
        for a, z, s in self.automaton.runs(words):
            for which, ends in self.automaton.ends[s].items():
                if z - a >= min(LEAST_RUN, len(self.templates[which][1])):
                    hits.setdefault(which, set()).update((z, a, end) for end in ends)
        for a, z, which in self.automaton.completed(words):
            hits.setdefault(which, set()).add((z, a, z - a))
        out = []
        for which, mine in hits.items():
            label, size = self.templates[which][0], len(self.templates[which][1])
            for a, z, n in chains(sorted(mine)):
                if (share := min(1.0, n / size)) >= LEAST_COVER:
                    out.append((a + offset, z + offset, label, share))
        return sorted(out)

    def scan(self, words: np.ndarray) -> tuple[int, int | None, int | None, str, str, float, str]:
        """n_base, first, last, base labels, labels, score and spans of one text, whose words are numbers, -1 for those in no template."""
        known = np.flatnonzero(words >= 0)
        if not len(known):
            return 0, None, None, "", "", 0.0, ""
        base, labels, spans = [], set(), []
        cuts = np.flatnonzero(np.diff(known) > LARGEST_GAP) + 1
        for part in np.split(known, cuts):
            if len(part) < 2:
                continue
            a, line = int(part[0]), words[part[0] : part[-1] + 1].tolist()
            for label, phrase in self.base:
                k = len(phrase)
                base += [(a + i, label) for i in range(len(line) - k + 1) if line[i] == phrase[0] and line[i : i + k] == phrase]
            spans += self.spans(line, a)
        mine = {label for _, label in base}
        labels = mine | {x[2] for x in spans}
        score = max([0.0, *(x[3] for x in spans), *(0.5 for _ in base[:1])])
        starts = [x for x, _ in base]
        told = ",".join(f"{label}:{a}:{z}" for a, z, label, _ in sorted(set(spans)))
        return len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(mine)), ",".join(sorted(labels)), score, told


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first word:end). No shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scanner()
        offsets, codes, distinct = word_table(b.column(1), GAPS)
        number = pa.compute.index_in(distinct, s.words)
        number = pa.compute.fill_null(number, -1).to_numpy(zero_copy_only=False)
        words = number[codes] if len(codes) else codes
        out = [s.scan(words[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        n, first, last, base, labels, score, spans = zip(*out, strict=True)
        cols = [b.column(0), pa.array(np.diff(offsets)), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())]
        return pa.record_batch(cols, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
