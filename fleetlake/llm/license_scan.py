"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A template of n five-word shingles belongs to the windows of w shingles, w the least power of
two of at least 2n; windows start every w/2 shingles, so each occurrence lies whole in one.
A window that holds a share ``least`` of a template has a Jaccard similarity with it of at
least J = ceil(least * n) / (w + n - ceil(least * n)). Bands of one MinHash value each meet
with probability J, and their number is chosen so that all of them miss with probability
``miss`` at most. Windows that share a band with a template are then checked exactly: the
share of the template's shingles that the window holds.

Templates are a short fixed list (a parameter), so their bands may be sent to every task.
Windows of all lengths come from block minima that are combined in pairs, over many
documents at a time.

A match that another license of the text explains better is marked: ``part_of`` names the one
of which more shingles stand at the same place (GPL-2.0 resembles GPL-3.0, the body of
BSD-3-Clause holds that of BSD-2-Clause).

Defined results: null and empty texts, and texts of fewer than five words, match nothing
unless a template is as short; of several windows and templates of one license the one with
the most shingles, then the first, gives the words, and the largest share the containment; repeated rows each give their rows; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHINGLE = 5
LEAST = 0.8
MISS = 1e-4
#: Public license texts by their usual identifiers, first short notices, then whole notices and bodies.
#: A short notice of one sentence matches nearly as it stands; a body of 100 words or more also with edits in it.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either
version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
_TOKEN = re.compile(r"[^\W_]+")
_MEMO = 400_000
_U = np.uint64


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _TOKEN.findall((text or "").lower())


class Hasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self._memo: dict[str, int] = {}

    def words(self, found: list[str]) -> np.ndarray:
        memo = self._memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.fromiter(map(memo.__getitem__, found), _U, len(found))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words (fewer words: one run of all)."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, _U)
    for j in range(k):
        out = (out ^ words[j : j + len(out)]) * _U(0x9E3779B97F4A7C15)
        out ^= out >> _U(29)
    return out


class Index:
    """Templates by window length, with their MinHash values band by band."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float = LEAST, miss: float = MISS):
        hasher = Hasher()
        self.least, self.names = least, [name for name, _ in templates]
        self.sets = [np.unique(shingles(hasher.words(tokens(text)))) for _, text in templates]
        self.by_width: dict[int, list[int]] = {}
        for t, own in enumerate(self.sets):
            if len(own):
                self.by_width.setdefault(1 << max(1, (2 * len(own) - 1).bit_length()), []).append(t)
        self.bands: dict[int, int] = {}
        for width, own in self.by_width.items():
            j = min((c := ceil(least * len(self.sets[t]))) / (width + len(self.sets[t]) - c) for t in own)
            self.bands[width] = ceil(log(miss) / log(1 - j)) if j < 1 else 1
        n = max(self.bands.values(), default=0)
        rng = np.random.default_rng(4)
        self.factors = rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        self.values = {w: [(np.array([self.minhash(self.sets[t], k) for t in own], np.uint32), own) for k in range(self.bands[w])] for w, own in self.by_width.items()}

    def hashed(self, s: np.ndarray, k: int) -> np.ndarray:
        """The k-th 32-bit hash of shingles (already mixed to 32 bits)."""
        x = s * self.factors[k] + self.shifts[k]
        return x ^ (x >> np.uint32(15))

    def minhash(self, own: np.ndarray, k: int) -> np.uint32:
        return self.hashed((own >> _U(32)).astype(np.uint32), k).min()

    def candidates(self, s: np.ndarray) -> set[tuple[int, int, int]]:
        """(width, window start, template) that share a band; ``s`` are 64-bit shingles in order."""
        found: set[tuple[int, int, int]] = set()
        small = (s >> _U(32)).astype(np.uint32)
        widest = max(self.by_width, default=0)
        for k in range(len(self.factors)):
            low, half = self.hashed(small, k), 1
            while half <= widest // 2:
                width = 2 * half
                if width in self.by_width and k < self.bands[width] and len(low):
                    window = np.minimum(low, np.append(low[1:], np.uint32(0xFFFFFFFF)))
                    values, own = self.values[width][k]
                    for at in self._hits(window, values):
                        for t in np.flatnonzero(values == window[at]):
                            found.add((width, int(at) * half, own[int(t)]))
                if all(w <= width or k >= self.bands[w] for w in self.by_width):
                    break
                if len(low) % 2:
                    low = np.append(low, np.uint32(0xFFFFFFFF))
                low, half = np.minimum(low[::2], low[1::2]), width
        return found

    @staticmethod
    def _hits(window: np.ndarray, values: np.ndarray) -> np.ndarray:
        flags = np.zeros(1 << 16, bool)
        flags[values >> np.uint32(16)] = True
        near = np.flatnonzero(flags[window >> np.uint32(16)])
        return near[np.isin(window[near], values)]


def scan_texts(index: Index, hasher: Hasher, texts: list[str | None]) -> list[tuple[int, str, float, int, int, int]]:
    """(text, license, largest containment, first word, last word, shingles held), each license of a text once.

    The words and the number of shingles are those of its template of which the text holds the most.
    """
    words = [tokens(t) for t in texts]
    sizes = np.array([max(0, len(w) - SHINGLE + 1) if len(w) >= SHINGLE else min(1, len(w)) for w in words])
    parts = [shingles(hasher.words(w)) for w in words]
    s = np.concatenate(parts) if parts else np.zeros(0, _U)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    shares: dict[tuple[int, str], float] = {}
    best: dict[tuple[int, str], tuple[int, int, int]] = {}
    for width, at, t in index.candidates(s):
        own = index.sets[t]
        held = np.flatnonzero(np.isin(s[at : at + width], own)) + at
        for text in np.unique(text_of[held]):  # a window may reach over the end of a text
            here = held[text_of[held] == text]
            n = len(np.unique(s[here]))
            if n / len(own) >= index.least:
                first = int(here[0] - starts[text])
                last = min(len(words[text]), int(here[-1] - starts[text]) + SHINGLE) - 1
                key = (int(text), index.names[t])
                shares[key] = max(shares.get(key, 0.0), n / len(own))
                best[key] = max(best.get(key, (0, 0, 0)), (n, -first, last))
    return [(text, name, shares[text, name], -first, last, n) for (text, name), (n, first, last) in sorted(best.items())]


def covering(rows: list[tuple[int, str, float, int, int, int]]) -> list[str | None]:
    """For each row of a text the other license that overlaps half of its words or more and of which the text holds the most shingles, if more than of its own."""
    out: list[str | None] = []
    for text, name, _, first, last, n in rows:
        over = [(r[5], r[1]) for r in rows if r[0] == text and r[5] > n and 2 * (min(last, r[4]) - max(first, r[3]) + 1) >= last - first + 1]
        out.append(max(over)[1] if over else None)
    return out


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``(doc_id, license, containment, first_word, last_word, part_of)`` for each license that a document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = Index(templates, least), Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = scan_texts(index, hasher, part.column(1).to_pylist())
                own = part.column(0).cast(pa.int64()).take(pa.array([r[0] for r in rows], pa.int32()))
                yield pa.record_batch(
                    [own, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32()), pa.array(covering(rows), pa.string())],
                    names=["doc_id", "license", "containment", "first_word", "last_word", "part_of"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, containment double, first_word int, last_word int, part_of string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: licenses found in every whole document."""
    return scan(table(spark, sf_dir, "documents"))
