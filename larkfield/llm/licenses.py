"""License scan: MinHash bands over overlapping windows find templates, exact containment confirms them.

Words are lower case without punctuation, shingles are runs of five words. A
template of up to 2^c shingles is looked for in windows of 2 * 2^c shingles
that start every 2^c, so each place of the template lies whole inside one
window. A window and a template are compared if they agree in a band of their
MinHash values. The numbers of bands and rows are set for each width so that a
template of which ``containment`` is there is missed with a probability of at
most ``miss``; every such pair is then checked exactly: the share of the
template's shingles that the window has must be at least ``containment``.

Versions and variants of a license share most of their words. Where hits
overlap, only the one with the highest containment stays, of equal ones the
longest, so a version is told by the words that only it has; hits that are
equal in both stay together. Full license bodies are templates like any
other: ``read_templates`` takes them from a folder of texts.

MinHash values are computed once for short blocks; a window's value is the
least of its blocks', so all widths cost little more than one. The job is one
pass without a shuffle, and the templates' index is a bounded closure.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil, log, log2
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, text_or_empty
from .toxicity import SPACED

SHINGLE, BLOCK = 5, 4
#: Words that are hashed together, which bounds a task's memory.
GROUP = 100_000

# Short license notices and first sentences of well-known licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def license_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(SPACED).split()


def shingle_hashes(words: list[bytes], cache: dict[bytes, int] | None = None) -> np.ndarray:
    """A 64-bit hash of each run of five words; fewer words make one run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words] if cache is None else map(cache.__getitem__, words)), "<u8")
    size = min(SHINGLE, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size))
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


@dataclass(frozen=True)
class Width:
    """A power of two of shingles and its bands."""

    stride: int
    rows: int
    bands: int


def plan_width(stride: int, least: int, containment: float, miss: float, most: int) -> Width:
    """Bands for windows of 2 * ``stride`` and templates of at least ``least`` shingles: as many rows as ``most`` values allow."""
    share = containment * least / (2 * stride + (1 - containment) * least)
    for rows in (3, 2, 1):
        bands = ceil(log(miss) / log(1 - share**rows))
        if bands * rows <= most:
            return Width(stride, rows, bands)
    raise ValueError("the values do not allow so low a probability of missing a template")


class TemplateIndex:
    """Templates by width and band key."""

    def __init__(self, templates: dict[str, str], containment: float, miss: float, values: int):
        rng = np.random.default_rng(7)
        self.containment = containment
        self.a = rng.integers(0, 1 << 32, values, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, values, dtype=np.uint32)
        self.names = sorted(templates)
        self.sets = [frozenset(shingle_hashes(license_words(templates[n])).tolist()) for n in self.names]
        self.sizes = [len(shingle_hashes(license_words(templates[n]))) for n in self.names]
        strides = [max(BLOCK, 1 << ceil(log2(max(n, 1)))) for n in self.sizes]
        self.widths: dict[int, Width] = {}
        self.keys: dict[int, dict[tuple[int, bytes], list[int]]] = {}
        for stride in sorted(set(strides)):
            own = [k for k, s in enumerate(strides) if s == stride and self.sizes[k]]
            if not own:
                continue
            width = plan_width(stride, min(len(self.sets[k]) for k in own), containment, miss, values)
            table: dict[tuple[int, bytes], list[int]] = {}
            for k in own:
                least = self.minima(np.array(sorted(self.sets[k]), np.uint64))
                for band in range(width.bands):
                    table.setdefault((band, least[band * width.rows : (band + 1) * width.rows].tobytes()), []).append(k)
            self.widths[stride], self.keys[stride] = width, table
        #: For each band which low 16 bits its keys' first values have, to pass over other windows by one lookup.
        self.known = {}
        for stride, table in self.keys.items():
            marks = np.zeros((self.widths[stride].bands, 1 << 16), bool)
            for band, key in table:
                marks[band, int(np.frombuffer(key, np.uint32)[0]) & 0xFFFF] = True
            self.known[stride] = marks

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The MinHash values of one set of shingle hashes."""
        return np.array([self.hashed((hashes >> np.uint64(32)).astype(np.uint32), k).min() for k in range(len(self.a))], np.uint32)

    def hashed(self, high: np.ndarray, k: int, out: np.ndarray | None = None) -> np.ndarray:
        """The k-th value of each shingle, from the upper half of its hash."""
        out = np.multiply(high, self.a[k], out=out)
        return np.add(out, self.b[k], out=out)

    def scan(self, docs: list[np.ndarray]) -> list[set[tuple[int, float, int, int]]]:
        """For each document (template, containment, first shingle, last shingle) of all places where windows hold enough of a template; places of one template may overlap."""
        found: list[set[tuple[int, float, int, int]]] = [set() for _ in docs]
        some = [k for k, h in enumerate(docs) if len(h)]
        if not some or not self.widths:
            return found
        high = np.concatenate([(docs[k] >> np.uint64(32)).astype(np.uint32) for k in some])
        ends = np.cumsum([len(docs[k]) for k in some])
        starts = np.concatenate([np.arange(e - len(docs[k]), e, BLOCK) for k, e in zip(some, ends, strict=True)])
        n_blocks = np.array([-(-len(docs[k]) // BLOCK) for k in some])
        firsts = np.concatenate([[0], np.cumsum(n_blocks)])
        blocks = np.empty((max(w.rows * w.bands for w in self.widths.values()), len(starts)), np.uint32)
        room = np.empty_like(high)
        for k in range(len(blocks)):
            np.minimum.reduceat(self.hashed(high, k, room), starts, out=blocks[k])
        for stride, width in self.widths.items():
            span = stride // BLOCK
            heads = np.concatenate([np.arange(f, f + n, span) for f, n in zip(firsts, n_blocks, strict=False)])
            of = np.repeat(np.arange(len(some)), -(-n_blocks // span))
            own = of[1:] == of[:-1]
            least = np.minimum.reduceat(blocks[: width.rows * width.bands], heads, axis=1)
            least[:, :-1] = np.where(own, np.minimum(least[:, :-1], least[:, 1:]), least[:, :-1])
            table, tried = self.keys[stride], set()
            for band in range(width.bands):
                for at in np.flatnonzero(self.known[stride][band][least[band * width.rows] & 0xFFFF]):
                    for t in table.get((band, least[band * width.rows : (band + 1) * width.rows, at].tobytes()), ()):
                        if (t, at) not in tried:
                            tried.add((t, at))
                            k = of[at]
                            self._check(docs[some[k]], t, int(heads[at] - firsts[k]) * BLOCK, 2 * stride, found[some[k]])
        return found

    def _check(self, hashes: np.ndarray, t: int, start: int, size: int, found: set) -> None:
        own, n = self.sets[t], len(self.sets[t])
        window = hashes[start : start + size].tolist()
        if len(own.intersection(window)) < self.containment * n:
            return
        spots = [(start + k, x) for k, x in enumerate(window) if x in own]
        todo, places = [spots], set()
        while todo:  # the densest place, then what lies before and behind it
            part = todo.pop()
            count, low, high = self._densest(part, n)
            if count >= self.containment * n:
                places.add((t, count / n, part[low][0], part[high][0]))
                todo += [x for x in (part[:low], part[high + 1 :]) if len(x) >= self.containment * n]
        if not places:  # wider apart than a template is long
            places.add((t, len({x for _, x in spots}) / n, spots[0][0], spots[-1][0]))
        found |= places

    @staticmethod
    def _densest(spots: list[tuple[int, int]], n: int) -> tuple[int, int, int]:
        """(distinct shingles, first spot, last spot) of the stretch of at most 1.5 * ``n`` places that holds most, cut to what it needs."""
        inside: Counter = Counter()
        best, low = (0, 0, 0), 0
        for high, (at, x) in enumerate(spots):
            inside[x] += 1
            while spots[low][0] < at - 1.5 * n or inside[spots[low][1]] > 1:
                inside[spots[low][1]] -= 1
                if not inside[spots[low][1]]:
                    del inside[spots[low][1]]
                low += 1
            if len(inside) > best[0]:
                best = len(inside), low, high
        return best


def read_templates(folder: str) -> dict[str, str]:
    """The license texts of a folder, each named by its file; links to another file of the folder are left out."""
    return {p.name: p.read_text("utf-8", "replace") for p in sorted(Path(folder).iterdir()) if p.is_file() and not p.is_symlink()}


def told_apart(found: set[tuple[int, float, int, int]], sizes: list[int]) -> list[tuple[int, float, int, int]]:
    """The places without those that overlap a better one that stays (higher containment, then more shingles), or one of the same template; by template and place."""
    kept: list[tuple[int, float, int, int]] = []
    for t, share, a, b in sorted(found, key=lambda x: (-x[1], -sizes[x[0]], x[2], x[0])):
        if not any(x <= b and a <= y and (o == t or (other, sizes[o]) > (share, sizes[t])) for o, other, x, y in kept):
            kept.append((t, share, a, b))
    return sorted(kept, key=lambda x: (x[0], x[2]))


class WordCache(dict):
    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh64_digest(word)
        if len(self) >= 250_000:
            self.clear()
        if len(word) <= 48:
            self[word] = value
        return value


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = 1e-5, values: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_licenses, licenses (names in order, joined by commas), best (containment) and hits (array of name, containment, first_word, last_word: every place of every template).

    Edge cases: null and empty texts have no hits; a template of fewer than
    five words is one shingle that only a text of just these words has;
    repeated rows are scanned each; other columns are not read.
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates, containment, miss, values)

    def make():
        cache = WordCache()

        def scanned(texts: list[str]):
            """(words, hits) of each text, in groups of about GROUP words."""
            group: list[tuple[int, np.ndarray]] = []
            size = 0
            for k, text in enumerate(texts):
                words = license_words(text)
                group.append((len(words), shingle_hashes(words, cache)))
                size += len(words)
                if k == len(texts) - 1 or size >= GROUP:
                    yield from zip([n for n, _ in group], index.scan([h for _, h in group]), strict=True)
                    group, size = [], 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hits = [], []
            for n, found in scanned(batch.column(1).to_pylist()):
                counts.append(n)
                hits.append([{"license": index.names[t], "containment": share, "first_word": a, "last_word": min(b + SHINGLE, n) - 1} for t, share, a, b in told_apart(found, index.sizes)])
            kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
            return batch_of(batch.column(0), counts, pa.array(hits, kind))

        return step

    out = map_batches(docs.select(F.col(id_col), text_or_empty(text_col)), make, f"{id_col} {dict(docs.dtypes)[id_col]}, n_words long, hits array<struct<license:string,containment:double,first_word:long,last_word:long>>")
    names = F.array_distinct("hits.license")
    return out.select(id_col, "n_words", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_max("hits.containment").alias("best"), "hits")
