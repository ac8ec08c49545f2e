"""License scans: MinHash bands retrieve templates for text windows, exact containment confirms them.

Words are ASCII letters and digits (lower-cased) and other characters than ASCII. A template's size class is the next power
of two of ``STRETCH`` times its number of five-word shingles; each document is cut into blocks of that many shingles, and every two blocks
in a row are a window, so that a run a quarter longer than the template lies in one. Of each window minima are taken, one row
a band, and looked up in the band's index of the templates' minima, so a large list of licenses costs what a small one does. A window
of at most 2 s shingles that contains 0.8 of a template's t has a Jaccard similarity J of at least 0.8 t / (2 s + 0.2 t) with it; a class has as
many bands b as make (1 - J) ** b at most ``MISSED`` for the worst of its templates. The minima of a class's blocks are made of those of the class before.

What is retrieved is confirmed exactly, at every offset of the windows: an occurrence is a run as long as the template that has 0.8 of its distinct shingles, or a run
of up to the class's size where none as long as the template has. The fullest runs are taken first, the first of equal ones, and what they hold
serves no other one: copies in a row are reported each. Where runs of several licenses lie on each other (by half of the shorter one), the one that explains most of the text
is reported and the others are its ``alternatives``.

Templates are a parameter (a dict, or a DataFrame of ``name`` and ``text`` of at most ``MOST_BYTES``, which travels with the tasks);
``TEMPLATES`` are the notices that files of public licenses carry.

Cases: a null or empty text has no words; a text or template of fewer than five words is one shingle, its whole sequence.
Rows are scanned one by one, so repeated rows are reported each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .terms import words_of

SHINGLE, SIMILARITY, STRETCH = 5, 0.8, 1.25
#: Chance that the bands miss a window that holds a license.
MISSED = 1e-6
#: Bytes of a table of templates.
MOST_BYTES = 32 << 20
FOUND = ["doc_id", "license", "containment", "first_word", "last_word", "alternatives"]
#: Notices of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"",
    "BSD-3-Clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the text's shingles, in order."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    rows = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if n > SHINGLE else [words]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, rows)), np.uint64, max(1, n - SHINGLE + 1))


def _mix(h: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = h * odd
    h ^= h >> np.uint64(32)
    return h * odd


def runs(at: np.ndarray, ids: np.ndarray, width: int, least: int) -> list[tuple[int, int, int]]:
    """(first, last, distinct) of disjoint runs of ``width`` places that have at least ``least`` distinct ids, the fullest first.

    ``at`` are the places of the ids, in order. A run begins with an id and ends with the last one that it has not had before.
    """
    if len(at) < least:
        return []
    order = np.argsort(ids, kind="stable")
    again = order[1:][ids[order[1:]] == ids[order[:-1]]]
    before = np.full(len(at), -1, np.int64)
    before[again] = at[order[:-1][ids[order[1:]] == ids[order[:-1]]]]
    # an id counts for the runs that begin after the one before it, and not too early to reach it
    steps = np.zeros(int(at[-1]) + 2, np.int64)
    np.add.at(steps, np.maximum(np.maximum(before, at - width) + 1, 0), 1)
    np.add.at(steps, at + 1, -1)
    distinct = np.cumsum(steps)[at]
    out, closed = [], np.zeros(len(steps) + width, bool)
    full = np.flatnonzero(distinct >= least)
    for k in full[np.lexsort((full, -distinct[full]))].tolist():
        first = int(at[k])
        if not closed[first]:
            closed[max(0, first - width + 1) : first + width] = True
            inside = slice(k, int(np.searchsorted(at, first + width)))
            out.append((first, int(at[inside][before[inside] < first][-1]), int(distinct[k])))
    return out


def occurrences(h: np.ndarray, template: np.ndarray, length: int, size: int) -> list[tuple[int, int, int]]:
    """(first, last, distinct) of the template's occurrences among the shingles ``h``; ``template`` are its distinct shingles, sorted."""
    ids = np.minimum(np.searchsorted(template, h), len(template) - 1)
    at = np.flatnonzero(template[ids] == h)
    ids, least, out = ids[at], _least(len(template)), []
    while True:
        known = len(out)
        for width in (length, size + 1):
            for run in runs(at, ids, width, least):
                out.append(run)
                free = np.ones(len(at), bool)
                free[np.searchsorted(at, run[0]) : np.searchsorted(at, run[1] + 1)] = False
                at, ids = at[free], ids[free]
        if len(out) == known:
            return out


def _least(n: int) -> int:
    """Shingles that an occurrence of a template of ``n`` has at least."""
    return math.ceil(SIMILARITY * n - 1e-9)


class Templates:
    """Templates by size class; for each class and band the templates' minima, sorted, and whose they are."""

    def __init__(self, texts: dict[str, str]):
        self.classes: dict[int, list[tuple[str, np.ndarray, int]]] = {}
        for name, text in sorted(texts.items()):
            found = shingles(words_of(text))
            if len(found):
                self.classes.setdefault(1 << (math.ceil(STRETCH * len(found)) - 1).bit_length(), []).append((name, np.unique(found), len(found)))
        self.bands = {s: max(_bands(len(t), s) for _, t, _ in of) for s, of in sorted(self.classes.items())}
        self.odd = np.random.default_rng(5).integers(1, 1 << 63, max(self.bands.values(), default=0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.index = {}
        for size, templates in self.classes.items():
            low = np.array([[_mix(f, o).min() for o in self.odd[: self.bands[size]]] for _, f, _ in templates])
            order = np.argsort(low, axis=0, kind="stable")
            self.index[size] = [(low[order[:, k], k], order[:, k]) for k in range(self.bands[size])]

    def retrieve(self, h: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(class, template, first, end) of the shingles in which the bands find the template: retrieved windows, joined where they follow each other."""
        sizes, halves, classes = np.diff(starts), [], {}
        count, first, size = sizes, starts[:-1], 1
        while size < max(self.bands, default=1):  # from the blocks of one size to those of twice that: two each, or a last one alone
            per = -(-count // 2)
            end = np.repeat(first + count, per)
            new = np.cumsum(per) - per
            text = np.repeat(np.arange(len(sizes)), per)
            left = first[text] + 2 * (np.arange(len(text)) - new[text])
            halves.append((left, np.minimum(left + 1, end - 1)))
            count, first, size = per, new, 2 * size
            if size in self.bands:
                classes[size] = text, starts[text] + (np.arange(len(text)) - first[text]) * size, np.flatnonzero(np.append(text[1:] != text[:-1], True)), []
        for k, odd in enumerate(self.odd):
            low, size = _mix(h, odd), 1
            for left, right in halves:
                low, size = np.minimum(low[left], low[right]), 2 * size
                if size not in classes or k >= self.bands[size]:
                    continue
                _, head, ends, found = classes[size]
                window = low.copy()
                np.minimum(low[:-1], low[1:], out=window[:-1])
                window[ends] = low[ends]  # a text's last block is a window of its own
                values, owner = self.index[size][k]
                at = np.searchsorted(values, window)
                hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == window)
                while len(hit):  # several templates may share a minimum
                    found.append(owner[at[hit]] * len(head) + hit)
                    at[hit] += 1
                    hit = hit[(at[hit] < len(values)) & (values[np.minimum(at[hit], len(values) - 1)] == window[hit])]
        for size, (text, head, _, found) in classes.items():
            codes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            t, w = codes // len(head), codes % len(head)
            new = np.ones(len(codes), bool)
            new[1:] = (np.diff(codes) != 1) | (t[1:] != t[:-1]) | (text[w[1:]] != text[w[:-1]])
            begin = np.flatnonzero(new)
            for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(codes)], strict=True) if len(codes) else ():
                yield size, int(t[i]), int(head[w[i]]), int(min(head[w[j - 1]] + 2 * size, starts[text[w[i]] + 1]))

    def scan(self, h: np.ndarray, starts: np.ndarray) -> list[tuple[int, str, float, int, int, list[str]]]:
        """(text, template, share, first and last shingle, alternatives) of each occurrence.

        ``h`` are the shingles of all texts one after another; ``starts`` where each begins, and the end.
        """
        found: dict[int, list[tuple[int, float, int, str, int]]] = {}
        for size, t, a, b in self.retrieve(h, starts) if len(h) else ():
            name, template, length = self.classes[size][t]
            d = int(np.searchsorted(starts, a, "right")) - 1
            for first, last, n in occurrences(h[a:b], template, length, size):
                k = a - int(starts[d])
                found.setdefault(d, []).append((-n, -n / len(template), k + first, name, k + last))
        return [row for d in sorted(found) for row in _one_each(d, found[d])]


def _bands(t: int, size: int) -> int:
    least = _least(t)
    return math.ceil(math.log(MISSED) / math.log1p(-least / (2 * size + t - least)))


def _one_each(d: int, found: list[tuple[int, float, int, str, int]]) -> list[tuple[int, str, float, int, int, list[str]]]:
    """The occurrences of one text, one license a place: the one that explains most, then the fullest, the first, by name."""
    kept: list[tuple[int, str, float, int, int, list[str]]] = []
    owner = np.full(max(last for *_, last in found) + 1, -1, np.int64)
    for _, share, first, name, last in sorted(found):
        there = owner[first : last + 1]
        taken = there[there >= 0]
        if 2 * len(taken) >= len(there):
            others = kept[Counter(taken.tolist()).most_common(1)[0][0]][-1]
            if name not in others:
                others.append(name)
        else:
            there[there < 0] = len(kept)
            kept.append((d, name, -share, first, last, []))
    return sorted((*row[:-1], sorted(row[-1])) for row in kept)


def _texts(templates: dict[str, str] | DataFrame | None) -> dict[str, str]:
    if not isinstance(templates, DataFrame):
        return TEMPLATES if templates is None else templates
    size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {MOST_BYTES} travel with the tasks")
    return {r.name: r.text for r in templates.select("name", "text").collect() if r.text}


def scan_licenses(documents: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(``doc_id``, ``license``, ``containment``, ``first_word``, ``last_word``, ``alternatives``) of each occurrence of a license in each row."""
    texts = _texts(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                terms = [words_of(x) for x in part.column(1).to_pylist()]
                words, each = [len(x) for x in terms], [shingles(x) for x in terms]
                starts = np.concatenate(([0], np.cumsum([len(x) for x in each])))
                rows = known.scan(np.concatenate([*each, np.zeros(0, np.uint64)]), starts)
                if rows:
                    d, name, share, first, last, others = zip(*rows, strict=True)
                    last = [min(x + SHINGLE, n) - 1 for x, n in zip(last, (words[i] for i in d), strict=True)]
                    columns = [part.column(0).take(pa.array(d)), pa.array(name), pa.array(share), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(others, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, FOUND)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, license string, containment double, first_word bigint, last_word bigint, alternatives array<string>")
