"""License scans by patience alignment with template texts.

Words that occur once in the template and once in a stretch of text are
anchors; their longest increasing subsequence is kept, and the gaps between
anchors are aligned in the same way, common words at a gap's ends first. The
coverage of a template is the share of its words that are aligned.

A template is aligned with stretches of the text: around every place, a little
and half as long again as the template; then, since any number of words may
be inserted, ever larger ones up to the whole text. What holds too few of the
template's words to reach the least share, or more than the best so far, is
passed over, which loses nothing. Words of short templates would be found
scattered over any long text: in stretches much longer than such a template
only runs of two and more of its words count.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A license is found where so much of its template's words are aligned.
LEAST_COVERAGE = 0.8
#: Templates of fewer words are short.
SHORT = 32

# Headers and notices that stand for public licenses. Their full texts are the files in templates/.
NOTICES = {
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-2.0-or-later-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "GPL-3.0-or-later-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


@lru_cache(1)
def templates() -> dict[str, str]:
    """By license: the full texts of templates/ and NOTICES."""
    files = [f for f in resources.files(__package__).joinpath("templates").iterdir() if f.name.endswith(".txt")]
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(files, key=lambda f: f.name)} | NOTICES


WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _rising(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence (patience sorting, with links back)."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) with equal words, ascending in both."""
    pairs, waiting = [], [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and in_a[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = [anchors[k] for k in _rising([j for _, j in anchors])]
        if not anchors:
            continue
        pairs += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        waiting += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(pairs)


def _in_runs(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of pairs next to another one in both texts."""
    found = set(pairs)
    return [(i, j) for i, j in pairs if (i - 1, j - 1) in found or (i + 1, j + 1) in found]


def stretches(n: int, size: int) -> Iterator[list[tuple[int, int]]]:
    """The stretches of a text of n words that a template of so many words is aligned with, in three steps."""
    step, slack = max(1, size // 16), size // 4 + 2
    yield [(s, min(n, s + size + step)) for s in range(0, n, step)]
    yield [(max(0, s - slack), min(n, s + size + slack)) for s in range(0, n, step)]
    wide, length = [], 2 * size
    while length < n:
        # Any part of up to half a stretch's length lies in one of them.
        wide += [(s, min(n, s + length)) for s in range(0, n, length // 2)]
        length *= 2
    yield [*wide, (0, n)]


class Scanner:
    def __init__(self, texts: dict[str, str] | None = None, least: float = LEAST_COVERAGE):
        split = {k: words(t) for k, t in (templates() if texts is None else texts).items()}
        split = {k: t for k, t in split.items() if t}
        self.names, self.numbers = list(split), {}
        for t in split.values():
            for w in t:
                self.numbers.setdefault(w, len(self.numbers))
        self.texts = [[self.numbers[w] for w in t] for t in split.values()]
        #: Words that have to be aligned, and how often each word is in each template.
        self.need = np.array([int(np.ceil(len(t) * least - 1e-9)) for t in self.texts], np.int64)
        self.counts = np.array([np.bincount(t, minlength=len(self.numbers)) for t in self.texts], np.int32).reshape(len(self.texts), -1)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each template covered enough, the best stretch of each: best coverage, then longest template, first."""
        get = self.numbers.get
        own = [get(w, -1) for w in words(text)]
        ids = np.array(own, np.int64)
        held = np.unique(ids)
        held = held[held >= 0]
        if not len(held):
            return []
        found = []
        for k in np.flatnonzero(self.counts[:, held].sum(1) >= self.need):
            best = self._best(int(k), own, ids)
            if best:
                found.append((self.names[k], best[0] / len(self.texts[k]), *best[1:]))
        sizes = dict(zip(self.names, map(len, self.texts), strict=True))
        return sorted(found, key=lambda x: (-x[1], -sizes[x[0]], x[0]))

    def _best(self, k: int, own: list[int], ids: np.ndarray) -> tuple[int, int, int] | None:
        """Most words aligned, and the places of the first and last: of the first stretch, those with the most words of the template first in each step."""
        t, need = self.texts[k], int(self.need[k])
        if len(own) < need:
            return None
        counts = np.append(self.counts[k], 0)
        seen = np.concatenate([[0], np.cumsum(counts[ids] > 0)])
        best, most = None, need - 1
        for at, step in enumerate(stretches(len(own), len(t))):
            spans = np.array(step)
            hits = seen[spans[:, 1]] - seen[spans[:, 0]]
            order = np.argsort(-hits, kind="stable")
            for i in order[hits[order] >= need].tolist():
                a, b = step[i]
                if hits[i] <= most or int(counts[np.unique(ids[a:b])].sum()) <= most:
                    continue
                pairs = aligned(t, own[a:b])
                if at == 2 and len(t) < SHORT:
                    pairs = _in_runs(pairs)
                if len(pairs) > most:
                    best, most = (len(pairs), a + pairs[0][1], a + pairs[-1][1]), len(pairs)
        return best


#: The columns of a scan.
FOUND = ("license", "coverage", "first_word", "last_word", "licenses")


def _scanned(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = shared.value
        for batch in batches:
            rest, text = batch.drop_columns(["__text"]), batch.column("__text")
            for at in range(0, len(batch), 256):
                found = [scanner.scan(t or "") for t in text.slice(at, 256).to_pylist()]
                first = [f[0] if f else (None, 0.0, None, None) for f in found]
                columns = [pa.array([f[0] for f in first], pa.string()), pa.array([f[1] for f in first], pa.float64()), pa.array([f[2] for f in first], pa.int64()), pa.array([f[3] for f in first], pa.int64()), pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*rest.slice(at, 256).columns, *columns], [*rest.schema.names, *FOUND])

    return scan


def scanned(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scanner: Scanner | None = None) -> DataFrame:
    """The columns `keep` of docs with the best license (null if none), its coverage, the places of its first and last aligned word, and all licenses found.

    Words are runs of ASCII letters and digits in lower case. A null or empty
    text has no license; all rows stay, repeated ones alike; an empty table
    gives no rows. A text of any length is scanned whole. Of equal coverages
    the longer template comes first, then the smaller name. Columns of docs
    by the new names can't be kept: that fails.
    """
    if clash := sorted(set(keep) & set(FOUND)):
        raise ValueError(f"columns of the scan can't be kept too: {clash}")
    common.modest_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    more = "license string, coverage double, first_word long, last_word long, licenses array<string>"
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_scanned(docs.sparkSession.sparkContext.broadcast(scanner or Scanner())), f"{kept}, {more}" if kept else more)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of every document."""
    return scanned(common.table(spark, sf_dir, "documents"))
