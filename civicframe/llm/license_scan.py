"""License scans: matching statistics over a suffix automaton of license tokens.

All template texts (notices and key clauses of well-known licenses, and the
base phrases) go into one generalised suffix automaton over word tokens. A
text is streamed through it once; the state and the length after each word
are the longest run of words ending there that occurs in any template.
Long maximal matches are then chained per template (rising place in the text
and in the template, small gaps) into covered spans; every chain that covers
``MIN_COVER`` or more of a template's words is a span and adds its label. Base phrases are states of
the same automaton: a phrase ends where its state lies on the suffix-link
path of the current state within the current length.

Only stretches where consecutive words form a pair that some template has can
hold a match of two or more words; the automaton runs over these. This skips
nothing: every other match is a single word, below any phrase or chain.

Defined cases: null and empty texts have no words, null places, empty labels
and score 0; repeated rows repeat their results; texts of any length are scanned whole; extra columns are
kept, those that have the names of the result's are replaced.
"""

from __future__ import annotations

from bisect import bisect
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words_of

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices, key clauses and whole texts of licenses, as published.
_BSD_TOP = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: ")
_BSD_1_2 = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
            "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
            "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
            "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
            "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
            "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
            "POSSIBILITY OF SUCH DAMAGE.")
_GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) {1}. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.")
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
            "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
            "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-2-clause", _BSD_TOP + _BSD_1_2 + _BSD_END),
    ("bsd-3-clause", _BSD_TOP + _BSD_1_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
            "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
            "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
               "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
               "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
               "permissions and limitations under the License."),
    ("gpl", _GPL.format("GNU General Public License", "any later version")),
    ("lgpl", _GPL.format("GNU Lesser General Public License", "any later version")),
    ("agpl", _GPL.format("GNU Affero General Public License", "any later version")),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
             "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software. 3. This notice may not be removed or altered from any source distribution."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "licensed under the BSD License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution License"),
    ("proprietary", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
MIN_COVER = 0.8   # share of a template's words that a chain must cover
MIN_MATCH = 2     # words of a match that takes part in a chain
MAX_GAP = 3       # words between two matches of a chain, in text and template


class Automaton:
    """Generalised suffix automaton over token numbers."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.labels = [lab for lab, _ in templates]
        texts = [words_of(t.encode()) for _, t in templates]
        phrases = [(words_of(p.encode()), lab) for p, lab in base]
        self.sizes = [len(t) for t in texts]
        vocab: dict[bytes, int] = {}
        for t in [*texts, *(p for p, _ in phrases)]:
            for w in t:
                vocab.setdefault(w, len(vocab))
        self.vocab = vocab
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]  # (template, end) of each state's own ends
        v = len(vocab)
        self.pairs = np.zeros((v + 1) * (v + 1), bool)
        for n, t in enumerate([*texts, *(p for p, _ in phrases)]):
            last, ids = 0, [vocab[w] for w in t]
            for i, c in enumerate(ids):
                last = self._extend(last, c, ends)
                if n < len(texts):
                    ends[last].add((n, i + 1))
            for a, b in zip(ids, ids[1:]):
                self.pairs[(a + 1) * (v + 1) + b + 1] = True
        # an end of a state is an end of all states on its suffix-link path
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]
        # phrases by state: those on the path above, and the state's own
        own: dict[int, list] = {}
        for p, lab in phrases:
            s = 0
            for w in p:
                s = self.next[s][vocab[w]]
            own.setdefault(s, []).append((len(p), lab))
        self.above: list[list] = [[] for _ in self.link]
        self.own = [own.get(s, []) for s in range(len(self.link))]
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            p = self.link[s]
            self.above[s] = self.above[p] + self.own[p]

    def _clone(self, p: int, q: int, c: int, ends) -> int:
        k = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        ends.append(set())
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def _extend(self, last: int, c: int, ends) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the run is there already, from another template
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c, ends)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append(set())
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c, ends)
        return cur

    def scan(self, words: list[bytes]):
        """(base places [(start, label)], chains [(template, covered words, start, end)])."""
        v = len(self.vocab) + 1
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words)) + 1
        hit = np.flatnonzero(self.pairs[ids[:-1] * v + ids[1:]]) if len(ids) > 1 else ids[:0]
        base, matches = [], []
        if not len(hit):
            return base, []
        cuts = np.flatnonzero(np.diff(hit) > 1) + 1
        for run in np.split(hit, cuts):
            start, stop = int(run[0]), int(run[-1]) + 2
            s = n = 0
            for i in range(start, stop):
                c = int(ids[i]) - 1
                before = (s, n)
                while s and c not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
                if c in self.next[s]:
                    s, n = self.next[s][c], n + 1
                else:
                    s = n = 0
                if before[1] >= n and before[1] >= MIN_MATCH:
                    matches.append((i, *before))
                for size, lab in self.above[s]:
                    base.append((i + 1 - size, lab))
                for size, lab in self.own[s]:
                    if n >= size:
                        base.append((i + 1 - size, lab))
            if n >= MIN_MATCH:
                matches.append((stop, s, n))
        return sorted(base), self._chain(matches)

    def _chain(self, matches):
        """Chains (template, covered words, start, end) through maximal matches
        (end, state, length): of each template those that cover most, as
        many as do not overlap in the text."""
        open_: dict[int, list] = {}  # template -> chains [end, template end, covered, start, went on]
        done: dict[int, list] = {}
        for end, state, n in matches:
            for t, te in self.ends[state]:
                best, source = [end, te, n, end - n, False], None
                kept = []
                for c in open_.get(t, ()):
                    if end - n - c[0] > MAX_GAP:
                        if not c[4]:
                            done.setdefault(t, []).append(c)
                        continue
                    kept.append(c)
                    # words of the text and of the template that are already covered
                    over = max(0, c[0] - (end - n), c[1] - (te - n))
                    gap = max(0, (te - n) - c[1])
                    if over < n and te > c[1] and gap <= MAX_GAP and c[2] + n - over > best[2]:
                        best, source = [end, te, c[2] + n - over, c[3], False], c
                if source is not None:
                    source[4] = True
                kept.append(best)
                open_[t] = kept
        for t, some in open_.items():
            done.setdefault(t, []).extend(c for c in some if not c[4])
        out = []
        for t, some in done.items():
            taken: list[tuple[int, int]] = []
            for end, _, covered, start, _ in sorted(some, key=lambda c: (-c[2], c[3], c[0])):
                # places taken so far, in order: the neighbours decide
                i = bisect(taken, (start, end))
                if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
                    continue
                taken.insert(i, (start, end))
                out.append((t, covered, start, end))
        return sorted(out)


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "license_spans array<struct<label:string,start:int,end:int,cover:double>>")


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, min_cover: float = MIN_COVER, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``RESULT`` added; spans are word places.
    The score is the best cover of a template, 1 where a base phrase stands."""
    names = [f.name for f in T.StructType.fromDDL(RESULT)]
    kept = [c for c in docs.columns if c not in names]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cover", pa.float64())]))

    def run(batches):
        auto = Automaton(templates, base)
        for b in batches:
            rows = []
            for t in b.column(text).cast(pa.binary()).to_pylist():
                words = words_of(t) if t else []
                places, chains = auto.scan(words)
                spans = [{"label": auto.labels[t], "start": s, "end": e, "cover": c / auto.sizes[t]} for t, c, s, e in chains
                         if c / auto.sizes[t] >= min_cover]
                base_labels = sorted({lab for _, lab in places})
                labels = sorted({*base_labels, *(x["label"] for x in spans)})
                best = max([1.0] * bool(places) + [min(1.0, c / auto.sizes[t]) for t, c, _, _ in chains], default=0.0)
                rows.append((len(words), len(places), places[0][0] if places else None, max(p for p, _ in places) if places else None,
                             ",".join(base_labels), ",".join(labels), best, spans))
            cols = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=[*kept, *names])
    schema = T.StructType([*docs.select(*kept).schema, *T.StructType.fromDDL(RESULT)])
    return docs.select(*kept).mapInArrow(run, schema)
