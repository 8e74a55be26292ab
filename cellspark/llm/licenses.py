"""License scans: winnowed fingerprints pick candidates without loss, banded alignment settles them."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces
from .decontam import words

#: Notices and grants of public licenses, each with the words, if any, that tell its version and clauses
#: from those of other licenses.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("affero", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', ("apache", "2")),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ()),
    ("BSD-family", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ()),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("neither", "endorse")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("attribution", "4")),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("noncommercial", "4")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("by", "nc", "4")),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", ("noncommercial", "noderivatives", "4")),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ("noncommercial", "sharealike", "4")),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ("noderivatives", "4")),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("sharealike", "4")),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ()),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("general", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("general", "3")),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("general", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ()),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ("lesser", "2", "1")),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("lesser", "3")),
    ("MIT", "Released under the MIT License.", ("mit",)),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions', ()),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2")),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ()),
)
#: Words that a span of a license may not hold, as they tell a sibling of it.
FORBIDDEN = {
    "CC-BY-4.0": ("noncommercial", "noderivatives", "sharealike", "nc", "nd", "sa"),
    "CC-BY-NC-4.0": ("noderivatives", "sharealike", "nd", "sa"),
    "CC-BY-NC-ND-4.0": ("sharealike", "sa"),
    "CC-BY-NC-SA-4.0": ("noderivatives", "nd"),
    "CC-BY-ND-4.0": ("noncommercial", "sharealike", "nc", "sa"),
    "CC-BY-SA-4.0": ("noncommercial", "noderivatives", "nc", "nd"),
    "GPL-2.0": ("affero", "lesser", "library"),
    "GPL-3.0": ("affero", "lesser", "library"),
}
#: Bytes of a table of templates that goes to every task; a larger one raises.
TEMPLATE_BYTES = 8 << 20
#: Words that an alignment may drift from its diagonal (of short templates a quarter of their words), and the least
#: share of the template that it covers.
BAND, COVERAGE = 8, 0.8
MATCH_SCORE, ODD_SCORE = 2, -1
#: Diagonals whose bands are compared with the template at once.
CHUNK = 256
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """Places of the fingerprints: the last least hash of every window, or of all if there are fewer."""
    n = max(1, len(grams) - window + 1) if len(grams) else 0
    return sorted({i + (w := grams[i : i + window]).size - 1 - int(np.argmin(w[::-1])) for i in range(n)})


def fingerprints(own: list[bytes], misses: int) -> list[int]:
    """Places of the words kept by the widest window that keeps more than ``misses``; long words come first.

    A span that lacks at most ``misses`` of the words has one of them, wherever its changes are. Grams of more words
    could all be broken by so many changes.
    """
    order = np.array([(255 - min(len(w), 255) << 56) | xxhash.xxh3_64_intdigest(w) >> 8 for w in own], np.uint64)
    return next(kept for window in range(len(own), 0, -1) if len(kept := winnow(order, window)) > misses)


class Index:
    """The inverted index of the templates' fingerprints, for spans of at least ``coverage``."""

    def __init__(self, templates, coverage: float = COVERAGE) -> None:
        kept = [(name, own, {w for x in more for one in x for w in words(one)}) for name, text, *more in templates if (own := words(text))]
        self.names = [name for name, _, _ in kept]
        self.words = [own for _, own, _ in kept]
        self.needed = [needed for _, _, needed in kept]
        self.forbidden = [{w for x in FORBIDDEN.get(name, ()) for w in words(x)} for name in self.names]
        self.bands = [max(1, min(BAND, len(own) // 4)) for own in self.words]
        self.least = [max(1, math.ceil(coverage * len(own))) for own in self.words]
        self.numbers = {w: i for i, w in enumerate(sorted({w for own in self.words for w in own}), 1)}
        self.ids = [np.array([self.numbers[w] for w in own], np.int32) for own in self.words]
        self.members = np.zeros((len(kept), len(self.numbers) + 1), bool)
        self.places = defaultdict(list)
        for t, own in enumerate(self.words):
            self.members[t, self.ids[t]] = True
            if self.least[t] <= len(own):
                for i in fingerprints(own, len(own) - self.least[t]):
                    self.places[int(self.ids[t][i])].append((t, i))
        self.marks = np.isin(np.arange(len(self.numbers) + 1), list(self.places))

    def candidates(self, own: list[bytes]) -> Iterator[tuple[int, int, int | None]]:
        """(template, diagonal, start of a verbatim copy in its band or None) of the alignments that can cover enough.

        The band of a diagonal must hold a fingerprint in its place, enough words of the template, and enough of them in their places.
        """
        ids = np.fromiter(map(self.numbers.get, own, repeat(0)), np.int32, len(own))
        found = defaultdict(list)
        for x in np.flatnonzero(self.marks[ids]).tolist():
            for t, i in self.places[int(ids[x])]:
                found[t].append(x - i)
        for t, shifts in found.items():
            n, band, least = len(self.words[t]), self.bands[t], self.least[t]
            drift = np.arange(-band, band + 1)
            diagonals = np.unique(np.array(shifts)[:, None] + drift)
            total = np.concatenate(([0], np.cumsum(self.members[t][ids], dtype=np.int64)))
            held = total[np.clip(diagonals + n + band, 0, len(own))] - total[np.clip(diagonals - band, 0, len(own))]
            diagonals = diagonals[held >= least]
            pad = np.zeros(n + 2 * band if len(diagonals) else 0, np.int32)
            padded = np.concatenate((pad, ids, pad))
            at = np.arange(n)[:, None] + drift + len(pad)
            for some in (diagonals[i : i + CHUNK] for i in range(0, len(diagonals), CHUNK)):
                equal = padded[some[:, None, None] + at] == self.ids[t][:, None]
                whole = equal.all(1)
                for k in np.flatnonzero(equal.any(2).sum(1) >= least).tolist():
                    d = int(some[k])
                    yield t, d, d - band + int(whole[k].argmax()) if whole[k].any() else None


def align(template: list[bytes], own: list[bytes], diagonal: int, band: int) -> tuple[int, int, int]:
    """The best local alignment within the band: matched words, first word and end in the text.

    Row i of the table is the template's word i; column j stands for the text's word i + diagonal + j - band.
    A cell holds score, matches and the text's first word, so no way back need be kept.
    """
    width = 2 * band + 1
    none = (0, 0, -1)
    best, end, row = none, 0, [none] * width
    for i, word in enumerate(template):
        new = []
        for j in range(width):
            x = i + diagonal + j - band
            cell = none
            if 0 <= x < len(own):
                s, m, f = row[j]
                if own[x] == word:
                    cell = (s + MATCH_SCORE, m + 1, f if f >= 0 else x)
                elif s + ODD_SCORE > 0:
                    cell = (s + ODD_SCORE, m, f)
                if j + 1 < width and row[j + 1][0] + ODD_SCORE > cell[0]:
                    cell = (row[j + 1][0] + ODD_SCORE, *row[j + 1][1:])
                if new and new[-1][0] + ODD_SCORE > cell[0]:
                    cell = (new[-1][0] + ODD_SCORE, *new[-1][1:])
                if cell[0] > best[0]:
                    best, end = cell, x + 1
            new.append(cell)
        row = new
    return best[1], best[2], end


def settled(found) -> list[tuple[int, int, str, int, float]]:
    """Of spans (license, matched words, first, end, coverage) that overlap, the best: by matched words, then coverage,
    then the earlier, then the license's name. As (first, end, license, matched words, coverage)."""
    out: list[tuple[int, int, str, int, float]] = []
    for name, m, first, end, share in sorted(found, key=lambda x: (-x[1], -x[4], x[2], x[3], x[0])):
        if all(end <= a or b <= first for a, b, *_ in out):
            out.append((first, end, name, m, share))
    return sorted(out)


def scan_text(text: str, index: Index) -> list[dict]:
    """The spans of a text that cover enough of a template and hold the words it needs, in order; no two overlap."""
    own = words(text)
    found = set()
    for t, d, start in index.candidates(own):
        n = len(index.words[t])
        # Nothing scores as much as a verbatim copy, so its alignment is known.
        matched, first, end = align(index.words[t], own, d, index.bands[t]) if start is None else (n, start, start + n)
        if matched >= index.least[t] and index.needed[t] <= (held := set(own[first:end])) and not index.forbidden[t] & held:
            found.add((index.names[t], matched, first, end, matched / n))
    out = settled(found)
    if not out:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [
        {"license": name, "start_word": a, "end_word": b, "start_char": places[a][0], "end_char": places[b - 1][1], "matched_words": m, "coverage": share}
        for a, b, name, m, share in out
    ]


SPAN = [
    T.StructField("license", T.StringType()),
    *(T.StructField(n, T.LongType()) for n in ("start_word", "end_word", "start_char", "end_char", "matched_words")),
    T.StructField("coverage", T.DoubleType()),
]


def load_templates(table: DataFrame) -> list[tuple[str, str, tuple[str, ...]]]:
    """Templates from a table with ``license``, ``text`` and, if there, ``needed`` (an array of words), such as whole license texts.

    They go to every task, so more than TEMPLATE_BYTES of text raise. Rows without a license or text are left out.
    """
    needed = F.col("needed") if "needed" in table.columns else F.array().cast("array<string>")
    rows = table.select("license", "text", F.coalesce(needed, F.array().cast("array<string>")).alias("needed")).where("license IS NOT NULL AND text IS NOT NULL")
    if (size := rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError(f"templates hold {size} bytes; {TEMPLATE_BYTES} are allowed")
    return sorted((r.license, r.text, tuple(r.needed)) for r in rows.collect())


def scan_licenses(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each span: key, ``license``, its words and characters (ends excluded), matched words and
    the share of the template they cover.

    ``templates`` holds (license, text) or (license, text, needed words), or is a DataFrame for :func:`load_templates`.
    Whole texts are scanned; the spans are those that an alignment of every template on every diagonal finds, if they hold the
    template's needed words and none that tell a sibling of its license (FORBIDDEN). A preamble that several licenses share is a
    license of its own, BSD-family. Of spans that overlap, of one license or several, the best stays: by matched words, then coverage, then
    the earlier, then the name. Words are compared in lower case without punctuation. Documents without a span,
    among them null and empty texts, have no row; repeated rows have a row each; a null key stays null; an empty table gives an empty
    result; further columns are not read, so their names may be any.
    The index of the templates is a parameter of bounded size and goes to every task; no row is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(load_templates(templates) if isinstance(templates, DataFrame) else templates, coverage))
    narrow = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["k"], *SPAN])
    kinds = pa.schema([("license", pa.string()), *((f.name, pa.int64()) for f in SPAN[1:6]), ("coverage", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            spans = [scan_text(x or "", shared.value) for x in batch.column("text").to_pylist()]
            at = pa.array([i for i, s in enumerate(spans) for _ in s], pa.int64())
            made = pa.RecordBatch.from_pylist([x for s in spans for x in s], kinds)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(at), *made.columns], names=schema.names)

    return narrow.mapInArrow(work, schema).withColumnRenamed("k", key)
