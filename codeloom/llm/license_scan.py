"""License scan: parts of a text held against licence templates by the Dice coefficient of their word bigrams.

Texts are normalised to lower-case words. Parts are lines, paragraphs (lines without an
empty one between) and the whole text. With bigram sets A and B, Dice is 2 |A & B| / (|A| + |B|); for a value
of t or more the sizes must satisfy |A| >= |B| t / (2 - t) and the reverse, which prunes templates by
their size alone. Only parts that hold some bigram of a template at all are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textkit as K
from codeloom.llm.shared import small_arrow_batches

# Customary notices and paragraphs of well-known licences, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _bigrams(words: np.ndarray) -> np.ndarray:
    return K.mix(words[:-1] * K.BASE + words[1:])


class Matcher:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        self.names, self.least = [n for n, _ in templates], least
        raw, bounds = K.buffer_of(pa.array([t for _, t in templates], pa.large_string()))
        _, _, h, at = K.words_of(raw, bounds, K.ALNUM)
        self.sets = [np.unique(_bigrams(h[a:b])) for a, b in zip(at, at[1:], strict=False)]
        self.sizes = np.array([len(s) for s in self.sets])
        self.known = np.unique(np.concatenate(self.sets))

    def candidates(self, size: int) -> np.ndarray:
        """Templates whose size allows the least Dice with a set of ``size`` bigrams."""
        bound = self.least / (2 - self.least)
        return np.flatnonzero((self.sizes >= size * bound) & (size >= self.sizes * bound))

    def best(self, bigrams: np.ndarray) -> tuple[float, int]:
        """(Dice, template) of the best template that reaches the least Dice; (0, -1) without. Ties go to the first listed."""
        found = (0.0, -1)
        a = np.unique(bigrams)
        for k in self.candidates(len(a)):
            dice = 2 * len(np.intersect1d(a, self.sets[k], assume_unique=True)) / (len(a) + self.sizes[k])
            if dice >= self.least and dice > found[0]:
                found = (dice, int(k))
        return found

    def scan(self, column: pa.Array) -> list[list[dict]]:
        """For each text the parts that match, as (license, dice, start, end) in UTF-8 bytes, ordered by place."""
        raw, bounds = K.buffer_of(column)
        start, end, h, at = K.words_of(raw, bounds, K.ALNUM)
        out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
        if len(h) < 2:
            return out
        pairs = _bigrams(h)
        spot = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        text = np.searchsorted(at, np.arange(len(pairs)), "right") - 1
        hits = np.flatnonzero((self.known[spot] == pairs) & (np.arange(len(pairs)) + 1 < at[text + 1]))
        owner = text[hits]
        for t in np.unique(owner):
            lo, hi = int(at[t]), int(at[t + 1])
            places = raw[bounds[t] : bounds[t + 1]]
            breaks = np.flatnonzero(places == 10) + bounds[t]
            line = np.searchsorted(breaks, start[lo:hi])
            # A line without a word ends a paragraph: the next word's line is over one further.
            gap = np.concatenate([[0], np.cumsum(np.diff(line) > 1)])
            parts = set()
            for kind in (line, gap, np.zeros(hi - lo, np.int64)):
                at_hit = np.unique(kind[hits[np.searchsorted(owner, t, 'left') : np.searchsorted(owner, t, 'right')] - lo])
                parts.update(zip((np.searchsorted(kind, at_hit, "left") + lo).tolist(), (np.searchsorted(kind, at_hit, "right") + lo).tolist(), strict=True))
            for a, b in sorted(parts):
                if b - a >= 2:
                    dice, k = self.best(pairs[a : b - 1])
                    if k >= 0:
                        out[t].append({"license": self.names[k], "dice": dice, "start": int(start[a] - bounds[t]), "end": int(end[b - 1] - bounds[t])})
        return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """(id, license, dice, n_parts, parts): the best match of each row, of equal ones the first in the text, and all parts that match.

    Null, empty texts and those of fewer than two words match nothing and have a null license; of parts that match equally well the
    first counts. Texts of any length are scanned whole. Rows that repeat are scanned each. An empty table gives an empty
    result; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    matcher = spark.sparkContext.broadcast(Matcher(templates or TEMPLATES, least))
    part = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(matcher.value.scan(batch.column(1)), part)], names=["id", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, parts array<struct<license:string,dice:double,start:bigint,end:bigint>>")
    top = F.reduce("parts", F.get("parts", 0), lambda best, x: F.when(x["dice"] > best["dice"], x).otherwise(best))
    return found.withColumn("top", top).select(F.col("id").alias(id_col), F.col("top.license").alias("license"), F.coalesce("top.dice", F.lit(0.0)).alias("dice"), F.size("parts").cast("long").alias("n_parts"), "parts")
