"""License scans: winnowed fingerprints pick candidates, banded alignment tells how much of a template a text has.

Templates are a small fixed table (its size is checked), indexed once: word shingles are hashed, and of every few
neighbouring ones the smallest is kept; of templates of SHORT words or fewer all are. All shingles of a text are looked
up, so any common run of SHINGLE + SPAN - 1 words (of SHINGLE words, with a short template) is a hit. Each hit proposes
a template and a diagonal; hits whose places in the text are close make one segment, and segments of a template that
follow each other in it and in the text make one candidate, whatever stands between them. A segment reaches back to the
first word that matches behind the one before. Local alignments within BAND words of the segments' diagonals, all of a
text at once, then give the words matched, their share of the template and the place in the text. What can't have
enough of a template's words is not aligned. A place must have the words that tell a license from its neighbours (version,
NC, SA, Lesser); of templates that match the same words the best covered stays.

Each text is scanned alone, whole, with memory in proportion to it: no shuffle.

Cases: null and empty texts match nothing; case and punctuation don't matter; texts that repeat a notice get a row for
each place; rows with equal or null ids are scanned each; a candidate yields one alignment, its best; ties between alignments go to the one that ends first; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, SPAN, BAND = 3, 2, 4
#: Words of a template, at most, of which every shingle is a fingerprint.
SHORT = 30
#: Cells of alignments that are computed at once.
_CELLS = 100_000
LEAST = 0.8
MOST_TEMPLATE_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")

#: License notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-line": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-first-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "All-rights-reserved": "All rights reserved.",
}
#: Names of licenses as they stand in lines, with what leads to them or not.
_NAMES = {
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2"), "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3"), "Apache-2.0": ("Apache License, Version 2.0",), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License v2.0"),
    **{f"CC-{k.upper()}-4.0": (f"CC {k.upper()} 4.0", f"Creative Commons {v} 4.0 International License") for k, v in {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}.items()},
    "CC0-1.0": ("CC0 1.0 Universal",),
}
for _k, _v in _NAMES.items():
    for _i, _x in enumerate(_v):
        TEMPLATES |= {f"{_k}-name{_i or ''}": _x, f"{_k}-licensed{_i or ''}": f"Licensed under the {_x}"}
for _k, _v in {"MIT": "MIT", "ISC": "ISC", "BSD-2-Clause": "BSD 2-Clause", "BSD-3-Clause": "BSD 3-Clause"}.items():
    TEMPLATES[f"{_k}-licensed"] = f"Licensed under the {_v} License."
#: Whole texts, from the first word that isn't the copyright holder's.
TEMPLATES |= {x.stem: x.read_text("utf-8") for x in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
for _k, _v in {"MIT-full": "Permission is hereby", "ISC": "Permission to use", "BSD-2-Clause": "Redistribution and", "BSD-3-Clause": "Redistribution and"}.items():
    TEMPLATES[_k] = TEMPLATES[_k][TEMPLATES[_k].index(_v) :]

# Words, in lower case with one space between, that a place must have, or must not have, to be of a license. Between words
# that it must have may stand one more.
_NC, _SA, _ND = "(?:noncommercial|nc)", "(?:sharealike|sa)", "(?:noderivatives|noderivs|nd)"
_MUST = {"MIT-line": ("mit",), "MIT-licensed": ("mit",), "ISC-licensed": ("isc",), "Apache-2.0": ("apache", "version 2|license 2"), "BSD-2-Clause-licensed": ("bsd 2",), "BSD-3-Clause-licensed": ("bsd 3",), "BSD-3-Clause": ("neither the name|names? of .* endorse|bsd 3",), "MPL-2.0": ("mozilla public license|mpl", "2 0"), "CC0": ("cc0|creative commons",),
         "GPL-2.0": ("general public license", "version 2(?! 1)|v2(?! 1)"), "GPL-3.0": ("general public license", "version 3|v3"), "LGPL-2.1": ("lesser", "version 2 1|v2 1"), "LGPL-3.0": ("lesser", "version 3|v3"), "AGPL-3.0": ("affero", "version 3|v3"),
         "CC-BY": ("4 0",), "CC-BY-SA": (_SA,), "CC-BY-NC": (_NC,), "CC-BY-ND": (_ND,), "CC-BY-NC-SA": (_SA,), "CC-BY-NC-ND": (_ND,)}
_SHORT = 100  # words; whole texts may name other licenses
_NOT = {"GPL-": ("lesser", "affero", "library general"), "CC-BY-4": (_NC, _SA, _ND), "CC-BY-SA": (_NC, _ND), "CC-BY-NC-4": (_SA, _ND), "CC-BY-ND": (_NC, _SA), "CC-BY-NC-SA": (_ND,), "CC-BY-NC-ND": (_SA,)}
_NOT_LONG = {"GPL-3.0": ("remote network interaction",), "CC-BY-SA": (_NC,)}


_GAP = re.compile(r"(?<!!) ")


def allowed(name: str, length: int, words: str) -> bool:
    """Whether a place has the words that tell a license from its neighbours."""
    has = lambda p: re.search(rf"\b(?:{p})\b", words)
    no = _NOT if length < _SHORT else _NOT_LONG
    return all(has(_GAP.sub(r" (?:\\w+ )?", p)) for k, own in _MUST.items() if name.startswith(k) for p in own) and not any(has(p) for k, own in no.items() if name.startswith(k) for p in own)


class _Words(dict):
    """Run between white space to the hashes of its words, remembered up to a bound."""

    def __missing__(self, run: str) -> list[int]:
        if len(self) > 500_000:
            self.clear()
        own = self[run] = [xxhash.xxh64_intdigest(w) for w in _WORD.findall(run.lower())]
        return own


def _shingles(h: np.ndarray) -> np.ndarray:
    out = np.full(max(0, len(h) - SHINGLE + 1), 7, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed (hash, place) of a template's word hashes."""
    s = _shingles(h)
    if len(h) <= SHORT or len(s) <= SPAN:
        return s, np.arange(len(s))
    views = np.lib.stride_tricks.sliding_window_view(s, SPAN)
    at = np.unique(np.arange(len(views)) + views.argmin(1))
    return s[at], at


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """align_many() of one."""
    return align_many([(template, text, low, high)])[0]


def align_many(jobs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[tuple[int, int, int]]:
    """For each (template, text, low, high) the best local alignment with text place - template place in [low, high].

    It is (words matched, first place, end place). A match counts 2, a gap or mismatch -1.
    """
    out: list = [(0, 0, 0)] * len(jobs)
    rest = []
    for k, (template, text, low, high) in enumerate(jobs):
        # Most notices are whole: then nothing can score higher than the first of the exact places.
        for at in range(max(0, low), min(high, len(text) - len(template)) + 1):
            if text[at] == template[0] and (text[at : at + len(template)] == template).all():
                out[k] = (len(template), at, at + len(template))
                break
        else:
            if len(template) and len(text):
                rest.append(k)
    rest.sort(key=lambda k: -len(jobs[k][0]))
    while rest:
        n, width = 0, 1
        while n < len(rest) and (n + 1) * max(width, jobs[rest[n]][3] - jobs[rest[n]][2] + 1) <= max(_CELLS, width):
            width = max(width, jobs[rest[n]][3] - jobs[rest[n]][2] + 1)
            n += 1
        n = max(n, 1)
        for k, found in zip(rest[:n], _banded([jobs[k] for k in rest[:n]]), strict=True):
            out[k] = found
        rest = rest[n:]
    return out


def _banded(jobs: list) -> list[tuple[int, int, int]]:
    """The alignments of jobs, longest template first: row by row of the templates, all jobs' bands as one array."""
    n, width = len(jobs), max(high - low + 1 for _, _, low, high in jobs)
    texts, templates = np.concatenate([j[1] for j in jobs]), np.concatenate([j[0] for j in jobs])
    size, length = np.array([len(j[1]) for j in jobs]), np.array([len(j[0]) for j in jobs])
    base, own = np.cumsum(size) - size, np.cumsum(length) - length
    low, wide = np.array([j[2] for j in jobs]), np.array([j[3] - j[2] + 1 for j in jobs])
    d = np.arange(width)
    score, start, hits = (np.zeros((n, width + 1), np.int64) for _ in range(3))
    best, found = np.zeros(n, np.int64), np.zeros((n, 3), np.int64)
    for i in range(int(length[0])):
        m = int(np.searchsorted(-length, -i, "left"))  # those that have a row i
        j = i + low[:m, None] + d
        inside = (j >= 0) & (j < size[:m, None]) & (d < wide[:m, None])
        same = inside & (texts[base[:m, None] + np.clip(j, 0, size[:m, None] - 1)] == templates[own[:m] + i][:, None])
        before = score[:m, :width]
        step = before + np.where(same, 2, -1)
        fresh = step <= 0
        now = np.where(fresh, 0, step)
        first = np.where(fresh | (before == 0), j, start[:m, :width])
        count = np.where(fresh, 0, np.where(before > 0, hits[:m, :width], 0) + same)
        # A word of the template that the text lacks.
        up = score[:m, 1:] - 1
        take = up > now
        now, first, count = np.where(take, up, now), np.where(take, start[:m, 1:], first), np.where(take, hits[:m, 1:], count)
        # Words of the text that the template lacks: the best of all cells to the left, less their distance.
        now[~inside] = 0
        source = np.maximum.accumulate((now + d) * width + d, axis=1) % width
        now = np.take_along_axis(now, source, 1) - (d - source)
        now[~inside] = 0
        first, count = np.take_along_axis(first, source, 1), np.take_along_axis(count, source, 1)
        score[:m, :width], start[:m, :width], hits[:m, :width] = now, first, count
        column = now.argmax(1)
        most = now[np.arange(m), column]
        better = np.flatnonzero(most > best[:m])
        best[better] = most[better]
        at = column[better]
        found[better] = np.stack([count[better, at], first[better, at], j[better, at] + 1], 1)
    return [tuple(x) for x in found.tolist()]


class Scanner:
    """Templates by fingerprint."""

    def __init__(self, templates: dict[str, str]):
        self.words = _Words()
        self.names = list(templates)
        self.hashes = [self._hashed(t) for t in templates.values()]
        if sum(map(len, self.hashes)) > MOST_TEMPLATE_WORDS:
            raise ValueError("the templates are too large for one task")
        found = [(int(f), t, int(p)) for t, h in enumerate(self.hashes) for f, p in zip(*fingerprints(h), strict=True)]
        found.sort()
        self.own = [np.unique(h, return_counts=True) for h in self.hashes]
        self.key = np.array([f for f, _, _ in found], np.uint64)
        self.template, self.place = np.array([t for _, t, _ in found]), np.array([p for _, _, p in found])

    def _hashed(self, text: str) -> np.ndarray:
        return np.array([h for run in text.split() for h in self.words[run]], np.uint64)

    def _possible(self, hits: list, h: np.ndarray, least: float) -> set[int]:
        """Those templates of hits of which the text has enough words at all."""
        seen, out = np.unique(h), set()
        for t in {x[0] for x in hits}:
            words, times = self.own[t]
            if times[np.isin(words, seen, assume_unique=True)].sum() >= least * len(self.hashes[t]):
                out.add(t)
        return out

    def scan(self, text: str | None, least: float = LEAST) -> list[tuple[str, int, int, float, int, int]]:
        """(template, words matched, words of the template, coverage, first character, end) of each match."""
        h = self._hashed(text or "")
        keys = _shingles(h)
        lo, hi = np.searchsorted(self.key, keys, "left"), np.searchsorted(self.key, keys, "right")
        out: list = []
        met = np.flatnonzero(hi > lo)
        if len(met):
            hits = sorted((int(self.template[k]), p, p - int(self.place[k])) for p in met.tolist() for k in range(lo[p], hi[p]))
            spans = [m.span() for m in _WORD.finditer(text)]
            chains, jobs = [], []
            for t, chain in _chains(hits, self._possible(hits, h, least), self.hashes):
                own = self.hashes[t]
                # No alignment has more words than the text has of the template's, within the band.
                near = h[max(0, min(g[4] for g in chain) - BAND) : max(g[5] for g in chain) + BAND + len(own) + 1]
                if np.isin(own, near).sum() < least * len(own):
                    continue
                starts = [(0, 0), *(_back(h, own, a, b) for a, b in zip(chain, chain[1:], strict=False)), (len(h), len(own))]
                chains.append((t, [x for x, _ in starts[:-1]]))
                for (x, y), (u, v), g in zip(starts, starts[1:], chain, strict=False):
                    jobs.append((own[y:v], h[x:u], g[4] - BAND - x + y, g[5] + BAND - x + y))
            aligned = iter(align_many(jobs))
            for t, starts in chains:
                size, found = len(self.hashes[t]), [(x, *next(aligned)) for x in starts]
                n, pieces = sum(f[1] for f in found), [(x + first, x + end) for x, k, first, end in found if k]
                if pieces and n >= least * size:
                    start, stop = spans[pieces[0][0]][0], spans[pieces[-1][1] - 1][1]
                    if allowed(self.names[t], size, " ".join(_WORD.findall(text[start:stop].lower()))):
                        out.append((2 * n - size, pieces, (self.names[t], n, size, n / size, start, stop)))
        # Of matches over the same words the one with most words matched less those missing stays.
        kept: list = []
        for _, pieces, row in sorted(out, key=lambda x: (-x[0], -x[2][3], x[2][0], x[2][4])):
            size = sum(e - f for f, e in pieces)
            if not any(2 * sum(max(0, min(e, y) - max(f, x)) for f, e in pieces for x, y in other) > size for other, _ in kept):
                kept.append((pieces, row))
        return sorted({row for _, row in kept}, key=lambda x: (x[4], x[0]))


def _back(h: np.ndarray, own: np.ndarray, before: list, segment: list) -> tuple[int, int]:
    """Where the words that match up to a segment begin, in text and template, behind the one before."""
    p, q = segment[0], segment[2]
    while p > before[1] + SHINGLE and q > before[3] + SHINGLE and h[p - 1] == own[q - 1]:
        p, q = p - 1, q - 1
    return p, q


def _chains(hits: list, possible: set[int], hashes: list):
    """(template, segments in order of text and template) of hits; a segment is (places, template places, diagonals, hits)."""
    by: dict[int, list] = {}
    # The latest segment of a template that has a hit on a diagonal.
    on: dict[tuple[int, int], list] = {}
    for t, p, d in hits:
        if t not in possible:
            continue
        segments = by.setdefault(t, [])
        near = [g for k in range(d - BAND, d + BAND + 1) if (g := on.get((t, k))) and p - g[1] <= len(hashes[t]) and p - d >= g[3] - BAND]
        if near:
            g = max(near, key=lambda x: x[0])
            g[1], g[3], g[4], g[5], g[6] = p, max(g[3], p - d), min(g[4], d), max(g[5], d), g[6] + 1
        else:
            g = [p, p, p - d, p - d, d, d, 1]
            segments.append(g)
        on[t, d] = g
    for t, segments in by.items():
        size = len(hashes[t])
        start, end, first, last, low, high, count = np.array(segments).T
        best, back = count.astype(float), np.full(len(segments), -1)
        near = np.searchsorted(start, start - 2 * size)
        for i in range(1, len(segments)):
            j = np.arange(i - 1, near[i] - 1, -1)
            j = j[(end[j] < start[i]) & (start[i] <= end[j] + size) & (last[j] < first[i])]
            if len(j):
                # A gap costs little, so that the nearer of two copies is followed.
                most = best[j] - 1e-4 * np.abs(low[i] - high[j])
                k = int(most.argmax())
                if most[k] > 0:
                    best[i], back[i] = most[k] + count[i], j[k]
        used: set[int] = set()
        for i in np.argsort(-best, kind="stable").tolist():
            chain = []
            while i >= 0 and i not in used:
                used.add(i)
                chain.append(segments[i])
                i = int(back[i])
            if chain:
                yield t, chain[::-1]


_FOUND = "doc_id bigint, license string, words_matched int, template_words int, coverage double, start int, end int"


def _scan(templates: dict[str, str], least: float):
    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows = [(i, *m) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in scanner.scan(text, least)]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])
    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each place where at least the share least of a template's words is found in order."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates or TEMPLATES, least), _FOUND)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
