"""License scan: MinHash bands over overlapping text windows retrieve templates; containment verifies.

A template is a set of word shingles. Texts are read in overlapping windows, one ladder of windows
for each template length: ``WIDER`` times the template's shingles long, a step of an eighth of them.
A passage that holds a template lies within one of these windows, whose Jaccard similarity with it is
then at least 1 / (WIDER + 1/8), about 0.73; at containment 0.8 it is at least 0.5, and 40 bands of two
minima retrieve it with a probability of 1 - (1 - 0.25)**40, over 0.99998. A retrieved window is
verified exactly: at least ``CONTAINED`` of the template's shingles stand in it. Templates that share many shingles (versions of a license,
two and three clauses) are siblings: a window holds a template only if it holds some of what sets it
apart from each sibling (the version, the third clause), and no smaller share than of what sets the sibling apart. Templates of one
shingle are windows of one shingle, where a band is the shingle itself.

A band of a window equals a template's only if both of its minima are shingles of templates, so
windows without any such shingle are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import id_and_text, table
from tidebar.llm.shingles import mix, shingle_sets, word_hashes, _PLACE

QUERY = "op7_license_scan"
ORACLE_SQL = None  # windows and bands are beyond SQL; tests compare with brute-force containment

WORDS = 5
CONTAINED = 0.8
WIDER = 1.25
BANDS, ROWS = 40, 2

#: Usual license notices, as their licenses ask to print them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

#: Notices that share most of their shingles with one of those, and others that are as usual.
SIBLINGS = {
    "GPL-2.0-line": 'This work is licensed under the GNU General Public License, version 2.',
    "GPL-2.0": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "LGPL-2.1": 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "LGPL-3.0": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "AGPL-3.0": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "MPL-2.0": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
}


def plain(text: str) -> bytes:
    """Punctuation is no part of words here: letters, digits, dots within numbers and hyphens are kept."""
    return _table(text).encode()


@cache
def _punctuation() -> dict[int, str]:
    return {c: " " for c in map(ord, "\"'();:,[]{}<>*#=|/")}


def _table(text: str) -> str:
    out = text.translate(_punctuation())
    return out.replace(". ", " ").replace(".\n", " ").removesuffix(".")


class Index:
    """Templates by the bands of their shingles' minima, for each length of window."""

    def __init__(self, templates: dict[str, str], words: int) -> None:
        self.words = words
        self.names = sorted(templates)
        self.sets = dict(zip(self.names, shingle_sets([plain(templates[n]) for n in self.names], words), strict=True))
        #: for each template, what sets it apart from each sibling and the sibling from it
        self.apart: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in self.names}
        for n, own in self.sets.items():
            for m, other in self.sets.items():
                if m != n and 2 * len(np.intersect1d(own, other, assume_unique=True)) >= min(len(own), len(other)) > 0:
                    self.apart[n].append((np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)))
        self.known = np.unique(np.concatenate([*self.sets.values(), np.zeros(0, np.uint64)]))
        self.seeds = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
        self.by_length: dict[int, dict[tuple[int, int], set[str]]] = {}
        for name, s in self.sets.items():
            if len(s):
                bands = self.by_length.setdefault(len(s), {})
                for b, key in enumerate(self.bands(s)):
                    bands.setdefault((b, key), set()).add(name)

    def bands(self, shingles: np.ndarray) -> list[int]:
        low = mix(shingles[:, None] * self.seeds).min(axis=0).reshape(BANDS, ROWS)
        return (low[:, 0] * self.seeds[0] + low[:, 1] * self.seeds[1]).tolist()

    def told(self, name: str, window: np.ndarray) -> bool:
        """Whether the window holds what sets the template apart from its siblings."""
        for own, other in self.apart[name]:
            mine = float(np.isin(own, window).mean()) if len(own) else 1.0
            theirs = float(np.isin(other, window).mean()) if len(other) else 0.0
            if mine == 0 or mine < theirs:
                return False
        return True

    def scan(self, shingles: np.ndarray) -> list[tuple[str, float, int]]:
        """(template, best containment, first shingle of that window) of a text's shingles in order."""
        at = np.flatnonzero(np.isin(shingles, self.known))
        best: dict[str, tuple[float, int]] = {}
        for length, bands in self.by_length.items() if len(at) else ():
            size = length if length == 1 else int(np.ceil(length * WIDER))
            step = max(1, length // 8)
            # windows that hold one of the known shingles
            firsts = np.unique(np.concatenate([np.clip((at - k * step) // step * step, 0, None) for k in range(-(-size // step) + 1)]))
            for first in firsts.tolist():
                window = np.unique(shingles[first : first + size])
                if not np.isin(window, self.known).any():
                    continue
                asked = {n for b, key in enumerate(self.bands(window)) for n in bands.get((b, key), ())}
                for n in asked:
                    share = len(np.intersect1d(window, self.sets[n], assume_unique=True)) / length
                    if share >= CONTAINED and share > best.get(n, (0.0, 0))[0] and self.told(n, window):
                        best[n] = (share, first)
        return [(n, *best[n]) for n in sorted(best)]


_indexes: dict[tuple, Index] = {}


def _scan(templates: dict[str, str], words: int):
    key = (tuple(sorted(templates.items())), words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _indexes.setdefault(key, Index(dict(key[0]), words))
        for batch in batches:
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for start in range(0, batch.num_rows, 256):
                texts = [plain(t) for t in batch.column("text").slice(start, 256).to_pylist()]
                h, counts = word_hashes(texts)
                rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
                for j in range(words):
                    rolled += h[j : len(h) - words + 1 + j] * _PLACE[j]
                rolled = mix(rolled)
                at = 0
                for i, n in enumerate(counts.tolist()):
                    if n >= words:
                        rows += [(ids[start + i], *found) for found in index.scan(rolled[at : at + n - words + 1])]
                    at += n
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], names=["doc_id", "license", "containment", "first_word"])

    return run


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, words: int = WORDS) -> DataFrame:
    """A row per row of ``df`` and license found: doc_id, license, containment, first_word.

    Null and empty texts, and texts of fewer than ``words`` words, hold no license. Repeated rows are
    reported each; a null identifier stays null. An empty table gives no rows. Of several windows that
    hold a template the fullest is told, the first of equals.
    """
    docs = id_and_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_scan(templates or TEMPLATES | SIBLINGS, words), "doc_id long, license string, containment double, first_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
