"""Operator 3: licence scans with a generalised suffix automaton of templates.

The words of all licence templates and of the base phrases form one automaton. Files
stream through it; the matching statistics tell where base phrases stand and give maximal
matches of at least MIN_MATCH words. Per template, matches are chained by dynamic programming to covered spans: a match
follows another if it comes later in the text and in the template, with gaps of at most MAX_GAP words on either side; what
the two share counts once; the chain that covers most words wins. A template of which
a chain covers MIN_COVERAGE gets its label. The score is the largest share of a template that a
chain covers, 1 where a base phrase stands.

The built-in templates are short licences whole, and the notices and first paragraphs by which longer ones are
applied. `templates_from` reads further ones (whole texts of long licences) from a folder; all together may have
MOST_WORDS words, so the automaton's size is bounded. Files stay where they are and nothing is shuffled.

Defined cases: a null or empty text has no words, no labels and score 0; texts of any length are taken whole; of
equally good chains the one that ends first wins; every row of `docs` gives one row, repeats included; an empty table
gives none. Columns passed on may have any names.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Matcher
from .common import long_field, map_texts, plain_words, read_table

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The texts of public licences and notices, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "bsd-2-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-3-clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "bsd": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "boost-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "cc-by-nd": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ],
}
#: Words of all templates together; the automaton has at most twice as many states.
MOST_WORDS = 400_000
MIN_MATCH = 4
MAX_GAP = 8
MIN_COVERAGE = 0.6


class LicenseScanner:
    """The automaton of the templates and phrases, and what it finds in a sequence of words."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        texts = [(label, words) for label, own in templates.items() for t in own if (words := plain_words(t.encode()))]
        if sum(len(words) for _, words in texts) > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} words")
        base = [(label, plain_words(p.encode())) for p, label in phrases.items()]
        self.labels = [label for label, _ in texts]
        self.templates = [words for _, words in texts]
        sequences = self.templates + [words for _, words in base]
        self.matcher = Matcher(sequences, min(MIN_MATCH, *(len(w) for _, w in base)))
        sam, vocabulary = self.matcher.automaton, self.matcher.vocabulary
        self.phrases: dict[tuple[int, int], str] = {}
        for label, words in base:
            state = 0
            for w in words:
                state = sam.next[state][vocabulary[w]]
            self.phrases[sam.suffix_state(state, len(words)), len(words)] = label
        self.phrase_sizes = sorted({n for _, n in self.phrases})
        self.starts = [_starts(words) for words in self.templates]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[int, list[tuple[int, int, int]]]]:
        """Base places (start, label), and by template its chains (start, end, words covered)."""
        statistics = self.matcher.statistics(self.matcher.ids(words))
        sam = self.matcher.automaton
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        for k, (at, matched, state) in enumerate(statistics):
            for n in self.phrase_sizes:
                if n <= matched and (label := self.phrases.get((sam.suffix_state(state, n), n))):
                    places.append((at + 1 - n, label))
            grows = k + 1 < len(statistics) and statistics[k + 1][:2] == (at + 1, matched + 1)
            if matched >= MIN_MATCH and not grows:
                matches.append((at + 1 - matched, at + 1, state))
        return places, self._chains(words, matches)

    def _chains(self, words: list[bytes], matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """By template: chains (start, end, words covered), the best first; chains share no match."""
        placed: dict[int, list[tuple[int, int, int]]] = {}  # text start, text end, template start
        for start, end, state in matches:
            for t in self.matcher.automaton.owners[state]:
                if t < len(self.templates):
                    part = words[start:end]
                    placed.setdefault(t, []).extend((start, end, at) for at in self.starts[t][part[0]] if self.templates[t][at : at + end - start] == part)
        return {t: _best_chains(own) for t, own in placed.items()}

    def spans(self, words: list[bytes]) -> list[tuple[int, int, str, float]]:
        """Covered template spans: start and end in words, label, share of the template covered."""
        _, chains = self.scan(words)
        return sorted((a, b, self.labels[t], n / len(self.templates[t])) for t, own in chains.items() for a, b, n in own)


def _starts(words: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(w, []).append(i)
    return out


def _best_chains(own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chains of matches (text start, text end, template start), by dynamic programming in order of their ends."""
    own = sorted(own, key=lambda m: (m[1], m[2] - m[0], m[0]))
    covered, before = [end - start for start, end, _ in own], [-1] * len(own)
    ends = [end for _, end, _ in own]
    for j, (start, end, at) in enumerate(own):
        for i in range(bisect_left(ends, start - MAX_GAP), j):
            low, high = own[i][1], own[i][2] + own[i][1] - own[i][0]  # where the match before ends in text and template
            shared = max(0, low - start, high - at)
            if shared < end - start and start + shared - low <= MAX_GAP and at + shared - high <= MAX_GAP and covered[i] + end - start - shared > covered[j]:
                covered[j], before[j] = covered[i] + end - start - shared, i
    out, used = [], [False] * len(own)
    for j in sorted(range(len(own)), key=lambda k: (-covered[k], k)):
        chain, k = [], j
        while k >= 0 and not used[k]:
            chain.append(k)
            k = before[k]
        if k < 0 and chain:  # a chain whose beginning is another's is not one of its own
            out.append((own[chain[-1]][0], own[j][1], covered[j]))
        for k in chain:
            used[k] = True
    return out


def _score(scanner: LicenseScanner):
    def work(texts: list, rows: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans")}
        for text in texts:
            words = plain_words(text)
            places, chains = scanner.scan(words)
            base = sorted({label for _, label in places})
            best = {t: max(n for *_, n in own) / len(scanner.templates[t]) for t, own in chains.items() if own}
            covered = {t for t, share in best.items() if share >= MIN_COVERAGE}
            out["n_words"].append(len(words))
            out["n_base"].append(len(places))
            out["first_word"].append(min((a for a, _ in places), default=None))
            out["last_word"].append(max((a for a, _ in places), default=None))
            out["base_labels"].append(",".join(base))
            out["labels"].append(",".join(sorted({*base, *(scanner.labels[t] for t in covered)})))
            out["score"].append(1.0 if places else max(best.values(), default=0.0))
            out["n_spans"].append(sum(1 for t in covered for *_, n in chains[t] if n >= MIN_COVERAGE * len(scanner.templates[t])))
        return out

    return work


def templates_from(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The texts of a folder of licences, by file name; MOST_WORDS words together at most."""
    names = F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1))
    sized = spark.read.text(folder, wholetext=True).select(names.alias("label"), "value")
    if (sized.agg(F.sum(F.size(F.split("value", r"\s+")))).first()[0] or 0) > MOST_WORDS:
        raise ValueError(f"{folder} has more than {MOST_WORDS} words")
    return {r["label"]: [r["value"]] for r in sized.collect()}


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """The columns of `keep` with n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    text = [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(long_field(c) for c in ("n_words", "n_base", "first_word", "last_word")), *text, T.StructField("score", T.DoubleType()), long_field("n_spans")])
    return map_texts(docs, lambda: _score(LicenseScanner(templates)), schema, keep)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
