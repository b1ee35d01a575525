"""Licence scans with a generalised suffix automaton of template tokens.

The automaton holds every token substring of every template. A text is streamed through it word by word; the length of the longest template
substring that ends at a word is its matching statistic. Maximal matches are chained along text and template, across small gaps, into
spans, and a span that covers enough of a template gives the template's label. Work and memory grow with the text in proportion: a chain
is kept only while a match can still follow it within the gap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose places are counted, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# The wording of well-known licences and of their notices.
_AS_IS_MIT = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_AS_IS_BSD = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-2-clause", f"{_BSD_2} {_AS_IS_BSD}"),
    ("bsd-3-clause", f"{_BSD_2} {_BSD_3} {_AS_IS_BSD}"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS_MIT}"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)

#: A-Z to lower case; other ASCII but digits and lower-case letters to blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of all sequences added. ends[s]: for each sequence, where the substrings of state s end in it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        self.n = 0

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # another sequence has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return new

    def add(self, tokens: list[int]) -> None:
        last = 0
        for i, token in enumerate(tokens):
            last = self._extend(last, token)
            self.ends[last].setdefault(self.n, []).append(i + 1)
        self.n += 1

    def finish(self) -> None:
        """Hands ends up the suffix links, longest states first."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                up = self.ends[self.link[s]]
                for k, e in self.ends[s].items():
                    up[k] = sorted({*up.get(k, ()), *e})

    def statistics(self, tokens) -> Iterator[tuple[int, int]]:
        """State and length of the longest substring that ends at each token."""
        s = size = 0
        for token in tokens:
            while s and token not in self.next[s]:
                s = self.link[s]
                size = self.length[s]
            if token in self.next[s]:
                s, size = self.next[s][token], size + 1
            yield s, size


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 3, max_gap: int = 4, min_cover: float = 0.8) -> None:
        self.templates = [(label, words_of(text.encode())) for label, text in templates]
        self.ids = {w: i for i, w in enumerate(sorted({w for _, t in self.templates for w in t}))}
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases]
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.automaton = SuffixAutomaton()
        for _, t in self.templates:
            self.automaton.add([self.ids[w] for w in t])
        self.automaton.finish()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(template, text start, template start, length) of the maximal matches of min_match words or more, by their end in the text.

        Only runs of words that some template has are streamed; no match crosses another word.
        """
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].astype(np.int8)))
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.min_match:
                continue
            state = size = 0
            for i, (s, n) in enumerate(self.automaton.statistics(ids[a:b].tolist()), a):
                if size >= self.min_match and n <= size:  # the match that ended before this word is not part of a longer one
                    yield from self._places(state, i, size)
                state, size = s, n
            if size >= self.min_match:
                yield from self._places(state, b, size)

    def _places(self, state: int, end: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        for k, ends in self.automaton.ends[state].items():
            for e in ends:
                yield k, end - size, e - size, size

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, share of the template covered) of the best chain at each place where the share is min_cover or more.

        A match follows a chain if it ends later, and begins at most max_gap words after the chain's end, in the text and in the template.
        Of the chains it can follow it takes the one that covers most, of these the one that begins last.
        """
        chains: dict[int, list[tuple[int, int, int, int]]] = {}  # by template: end, begin, template end, words covered
        best: dict[tuple[int, int], tuple[int, int]] = {}  # by template and begin: words covered, end
        for k, at, t, size in self.matches(words):
            open_ = chains.setdefault(k, [])
            if open_ and open_[0][0] < at - self.max_gap:  # later matches begin no earlier, so nothing can follow these chains any more
                chains[k] = open_ = [c for c in open_ if c[0] >= at - self.max_gap]
            cover, begin = size, at
            for c_end, c_begin, c_t, c_size in open_:
                step, hop = at - c_end, t - c_t
                if -size < step <= self.max_gap and -size < hop <= self.max_gap:
                    cover, begin = max((cover, begin), (c_size + size + min(step, hop, 0), c_begin))
            open_.append((at + size, begin, t + size, cover))
            best[k, begin] = max(best.get((k, begin), (0, 0)), (cover, at + size))
        sizes = [len(t) for _, t in self.templates]
        return [(k, begin, end, min(1.0, cover / sizes[k])) for (k, begin), (cover, end) in sorted(best.items()) if cover >= self.min_cover * sizes[k]]

    def places(self, words: list[bytes]) -> Iterator[tuple[int, str]]:
        """The words at which phrases stand, with their labels; the words between two places are counted once."""
        joined = b" " + b" ".join(words) + b" "
        for phrase, label in self.phrases:
            word = last = 0
            for m in re.finditer(b"(?=" + re.escape(phrase) + b")", joined):
                word += joined.count(b" ", last, m.start())
                last = m.start()
                yield word, label

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text or b"")
        n, first, last, base = 0, None, None, set()
        for at, label in self.places(words):
            n, first, last = n + 1, at if first is None else min(first, at), at if last is None else max(last, at)
            base.add(label)
        spans = self.spans(words)
        return {
            "n_words": len(words), "n_base": n, "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {self.templates[k][0] for k, *_ in spans})),
            "score": max((s for *_, s in spans), default=0.0),
            "spans": [{"label": self.templates[k][0], "first_word": a, "end_word": e, "cover": s} for k, a, e, s in spans],
        }


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,cover:double>>"


def scan_licenses(docs: DataFrame, **kwargs) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the largest share of a template that a span covers, 0 without one. Null texts count as empty: no words, no labels (empty
    strings), null places. Very long texts are scanned whole, in time in proportion to their words. Null doc_ids are carried. Repeated rows
    are scanned each. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(**kwargs)
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), *(pa.array([x[n] for x in found], t) for n, t in zip(names[1:], kinds[1:]))], names=names)

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, _SCHEMA)
