"""License scans: MinHash bands over overlapping text windows, verified by containment.

Texts and templates are sequences of 5-word shingles (64-bit hashes; the whole
sequence if there are fewer words).  Templates of m shingles are looked for in
windows of 2 C shingles that begin every C shingles, C being the least power of
two not below m: any m consecutive shingles lie inside one such window.  A
window and a template that it contains to ``percent`` have a Jaccard similarity
of at least ``J = percent * m / (2 C + (1 - percent) * m)``, so with
``bands_for(J)`` bands of one MinHash value they share a band with probability
``1 - miss``.  Windows that share a band with a template are candidates; a
candidate is a match if the window holds ``percent`` of the template's distinct
shingles, counted exactly.  A window without any shingle of a template cannot
share a band with one and is never hashed.

Notices of kindred licenses differ in a word or two.  A match gives way to one
of another license in an overlapping window that holds a larger share of its
own template, if ``percent`` of the shingles that the match rests on are the
other template's too; equal shares leave both.

Words: A-Z lower-cased, maximal runs of ASCII digits, letters and non-ASCII
characters.  Defined results: null and empty texts match nothing; templates
without words match nothing, templates that share a name are one license;
repeated rows are judged alike; an empty table gives an empty result.  Columns
beside the named ones are never read.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revmine.llm.words import ALNUM_LOWER, chunks, released, words

SHINGLE = 5
PERCENT = 75
MISS = 1e-6
SLICE = 4 << 20  # bytes of text looked at together

# Public license notices.
TEMPLATES = {
    "AGPL": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
             "option) any later version.",
             "Licensed under the GNU Affero General Public License", "Released under the GNU Affero General Public License"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Licensed under the Apache License 2.0.", "Released under the Apache License 2.0.",
                   "Released under the Apache License, Version 2.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", "Licensed under the BSD License.", "Released under the BSD License.",
            "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission.",
                     "Licensed under the BSD 3-Clause License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "licensed under the Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                     "licensed under the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                     "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
                "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
                "Licensed under the Eclipse Public License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version.",
                "Licensed under the GNU General Public License v2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version.",
                "Licensed under the GNU General Public License v3.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
             "option) any later version.",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
             "option) any later version.",
             "Licensed under the GNU Lesser General Public License", "Released under the GNU Lesser General Public License"],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",
            "Licensed under the MIT License.", "Distributed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Licensed under the Mozilla Public License, version 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_ODD = np.random.default_rng(23).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of all texts in order, where each text's begin and the end)."""
    w = words(texts, ALNUM_LOWER)
    known = np.array([xxhash.xxh3_64_intdigest(v) for v in w.vocabulary], np.uint64)
    seq = known[w.codes] if len(w) else np.zeros(0, np.uint64)
    n = np.diff(w.first)
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(size)])
    start = np.repeat(w.first[:-1] - first[:-1], size) + np.arange(first[-1])  # word where each shingle begins
    h = np.zeros(len(start), np.uint64)
    room = np.repeat(w.first[1:], size) - start
    padded = np.append(seq, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        h = _mix((h + np.where(k < room, padded[start + k], np.uint64(k))) * _ODD[k])
    return h, first


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one value that two sets of ``similarity`` all miss with a probability of ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(similarity, 1 - 1e-9))))


class Templates:
    """Shingle sets of the templates, grouped by the window size that suits them."""

    def __init__(self, templates: Mapping[str, Sequence[str]], percent: int):
        names = [n for n, texts in templates.items() for _ in texts]
        flat, first = shingles(pa.array([t for texts in templates.values() for t in texts], pa.string()))
        self.names = sorted(templates)
        self.percent = percent
        self.groups: list[tuple[int, np.ndarray, list[tuple[int, np.ndarray]]]] = []
        by_step: dict[int, list[tuple[int, np.ndarray]]] = {}
        for name, a, b in zip(names, first[:-1], first[1:], strict=True):
            s = np.unique(flat[a:b])
            if len(s):
                by_step.setdefault(1 << (int(b - a) - 1).bit_length(), []).append((self.names.index(name), s))
        for step, members in sorted(by_step.items()):
            share = percent / 100
            least = min(share * len(s) / (2 * step + (1 - share) * len(s)) for _, s in members)
            factors = _ODD[64:64 + bands_for(least)]
            self.groups.append((step, factors, members))

    def find(self, h: np.ndarray, first: np.ndarray) -> list[Match]:
        """All matches, and which of them give way to others left out."""
        out: list[Match] = []
        if not len(h):
            return out
        size = np.diff(first)
        text = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(h)) - first[text]
        for step, factors, members in self.groups:
            every = np.unique(np.concatenate([s for _, s in members]))
            near = np.flatnonzero(_among(h, every))
            if not len(near):
                continue
            blocks = -(-size // step)  # of each text
            block_first = np.concatenate([[0], np.cumsum(blocks)])
            here = block_first[text[near]] + place[near] // step
            # a shingle lies in the window of its block and in that of the block before
            window = np.unique(np.concatenate([here, (here - 1)[place[near] >= step]]))
            owner = np.searchsorted(block_first, window, side="right") - 1
            begin = first[owner] + (window - block_first[owner]) * step
            end = np.minimum(begin + 2 * step, first[owner + 1])
            length = end - begin
            start = np.cumsum(length) - length
            inside = h[np.arange(length.sum()) + np.repeat(begin - start, length)]
            candidates = set()
            for factor in factors:
                least = np.minimum.reduceat(inside * factor, start)
                wanted = np.array([(s * factor).min() for _, s in members], np.uint64)
                order = np.argsort(wanted)
                at = np.minimum(np.searchsorted(wanted[order], least), len(wanted) - 1)
                for k in np.flatnonzero(wanted[order][at] == least).tolist():
                    for t in np.flatnonzero(wanted == least[k]).tolist():
                        candidates.add((k, t))
            for k, t in sorted(candidates):
                a, b = int(begin[k]), int(end[k])
                name, s = members[t]
                found = s[np.isin(s, h[a:b])]
                if 100 * len(found) >= self.percent * len(s):
                    lo = a - int(first[owner[k]])
                    out.append(Match(int(owner[k]), name, lo, lo + 2 * step, found, s))
        return self._kept(out)

    def _kept(self, matches: list[Match]) -> list[Match]:
        """Matches that no better one of another license rests on the same words as."""
        of_text: dict[int, list[Match]] = {}
        for m in matches:
            of_text.setdefault(m.text, []).append(m)
        out = []
        for mine in of_text.values():
            mine.sort(key=lambda m: m.begin)
            reach = max(m.end - m.begin for m in mine)
            begins = [m.begin for m in mine]
            for m in mine:
                others = mine[bisect.bisect_right(begins, m.begin - reach):bisect.bisect_left(begins, m.end)]
                if not any(o.license != m.license and o.end > m.begin and len(o.found) * len(m.template) > len(m.found) * len(o.template)
                           and 100 * int(np.isin(m.found, o.template).sum()) >= self.percent * len(m.found) for o in others):
                    out.append(m)
        return out


@dataclass(frozen=True, eq=False)
class Match:
    """A window [begin, end) of a text's shingles that holds ``found`` of a license's template."""

    text: int
    license: int
    begin: int
    end: int
    found: np.ndarray
    template: np.ndarray


def _among(h: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``h`` are among a few sorted values; most are told by 20 bits of theirs."""
    bits = np.zeros(1 << 20, bool)
    bits[(values & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = bits[(h & np.uint64(0xFFFFF)).astype(np.int64)]
    at = np.flatnonzero(maybe)
    maybe[at] = np.isin(h[at], values)
    return maybe


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text",
         percent: int = PERCENT) -> DataFrame:
    """(id, licenses, windows) of every row.

    ``licenses``: the names found, ascending; ``windows``: for each name the
    first shingle of the first window that holds it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, percent)
        for batch in batches:
            for lo, texts in chunks(batch.column("text"), SLICE):
                found: list[dict[int, int]] = [{} for _ in range(len(texts))]
                for m in known.find(*shingles(texts)):
                    found[m.text][m.license] = min(m.begin, found[m.text].get(m.license, m.begin))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, len(texts)), pa.array([[known.names[k] for k in sorted(f)] for f in found], pa.list_(pa.string())),
                     pa.array([[f[k] for k in sorted(f)] for f in found], pa.list_(pa.int64()))], names=["id", "licenses", "windows"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(released(run), f"id {kind}, licenses array<string>, windows array<long>"))
