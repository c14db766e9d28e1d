"""License scans: MinHash bands over text windows, confirmed by shingle containment (operator 6).

A template and a text are sequences of five-word shingles. A template of m shingles is looked for in windows of the
next class size M >= m: windows of M + stride - 1 shingles, a stride of M / 2 apart, so that any stretch of M shingles
lies inside one of them. A window that holds four fifths of the template's shingles has a known least Jaccard
similarity to it; the number of bands of one MinHash value each is what makes a collision at that similarity as good
as certain. Templates that collide are confirmed by exact containment in the window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitlane.llm import words

SHINGLE, CONTAINED, MISS = 5, 0.8, 1e-5
_ONE = np.uint64(1)
_PLACE = words.mix(np.arange(501, 501 + SHINGLE, dtype=np.uint64)) | _ONE
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

# Wordings by which texts commonly state their licence, with the licence's identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("LGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
             "Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL", "SPDX-License-Identifier: LGPL-3.0"),
    ("AGPL", "SPDX-License-Identifier: AGPL-3.0"),
    ("BSD", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
)


def class_size(m: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, 16, 24, ... that is not below ``m``."""
    if m <= 2:
        return m
    power = 1 << (m - 1).bit_length()
    return power // 4 * 3 if m <= power // 4 * 3 else power


def bands_needed(m: int, size: int, stride: int) -> int:
    """Bands of one value that miss a window holding the least share of ``m`` shingles with probability MISS."""
    shared = math.ceil(CONTAINED * m - 1e-9)
    least = shared / (size + stride - 1 + m - shared)
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


@dataclass(frozen=True)
class Group:
    """The templates of one class: their window, stride and bands, and the MinHash values of each."""

    window: int
    stride: int
    bands: int
    members: tuple[int, ...]


class Index:
    """Templates ready for lookup. Templates must have five words or more."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        self.sets = []
        for piece in words.pieces(pa.array([t for _, t in templates], pa.string()), words.ALNUM, lower=True):
            hashes, begin, count = positions(piece)
            self.sets += [np.unique(hashes[b:b + c]) for b, c in zip(begin, count, strict=True)]
        if any(len(s) == 0 for s in self.sets):
            raise ValueError(f"a template needs {SHINGLE} words")
        by: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            by.setdefault(class_size(len(s)), []).append(i)
        self.groups = []
        for size, members in sorted(by.items()):
            stride = max(1, size // 2)
            bands = max(bands_needed(len(self.sets[i]), size, stride) for i in members)
            self.groups.append(Group(size + stride - 1, stride, bands, tuple(members)))
        bands = max((g.bands for g in self.groups), default=0)
        self.multiply = words.mix(np.arange(1, bands + 1, dtype=np.uint64)) | _ONE
        self.add = words.mix(np.arange(3001, 3001 + bands, dtype=np.uint64))

    def value(self, hashes: np.ndarray, band: int) -> np.ndarray:
        return words.mix(hashes * self.multiply[band] + self.add[band])


def positions(piece: words.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle at every word that begins one, and by row where its shingles begin and how many there are."""
    n = len(piece.hashes)
    total = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, n)):
        total[:n - j] += piece.hashes[j:] * _PLACE[j]
    count = np.diff(np.concatenate([[0], piece.stop]))
    begin = piece.stop - count
    return words.mix(total), begin, np.maximum(count - SHINGLE + 1, 0)


def find(piece: words.Piece, index: Index) -> dict[int, list[tuple[int, int, str]]]:
    """By row: first word, end word and name of every confirmed match; matches of a name that overlap are one."""
    hashes, begin, count = positions(piece)
    gap = max((g.window for g in index.groups), default=0)
    # Shingles of different rows are kept apart, so that no window reaches into the next row.
    place = np.concatenate([[0], np.cumsum(count + gap)])
    row = np.repeat(np.arange(piece.rows), count)
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    flat = hashes[begin[row] + inside]
    at = place[row] + inside
    found: set[tuple[int, int, int]] = set()
    values: dict[int, np.ndarray] = {}
    for group in index.groups:
        windows = np.where(count > 0, np.maximum(-(-(count - group.window) // group.stride), 0) + 1, 0)
        owner = np.repeat(np.arange(piece.rows), windows)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)) * group.stride
        spot = place[owner] + start
        for band in range(group.bands):
            if band not in values:
                values[band] = np.full(place[-1] + gap, _NONE)
                values[band][at] = index.value(flat, band)
            low = _window_min(values[band], spot, group.window)
            for member in group.members:
                hit = np.flatnonzero(low == index.value(index.sets[member], band).min())
                found.update((int(owner[h]), int(start[h]), member) for h in hit)
    out: dict[int, list[tuple[int, int, str, frozenset[int]]]] = {}
    width = {i: g.window for g in index.groups for i in g.members}
    for r, s, member in sorted(found):
        part = hashes[begin[r] + s:begin[r] + min(s + width[member], int(count[r]))]
        known = np.isin(part, index.sets[member])
        if len(np.unique(part[known])) >= CONTAINED * len(index.sets[member]) - 1e-9:
            where = np.flatnonzero(known)
            out.setdefault(r, []).append((s + int(where[0]), s + int(where[-1]) + SHINGLE, index.names[member],
                                          frozenset((s + where).tolist())))
    return {r: _joined(_best(spans)) for r, spans in out.items()}


def _best(spans: list[tuple[int, int, str, frozenset[int]]]) -> list[tuple[int, int, str]]:
    """Matches but for those with more than half of their shingles in a match of another name with more; ties all stay."""
    return [(a, b, name) for a, b, name, at in spans
            if not any(other != name and len(held) > len(at) and 2 * len(held & at) > len(at) for _, _, other, held in spans)]


def _window_min(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each start."""
    step, low = 1, values
    while 2 * step <= width:
        low = np.minimum(low[:len(low) - step], low[step:])
        step *= 2
    return np.minimum(low[starts], low[starts + width - step])


def _joined(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: dict[str, list[tuple[int, int, str]]] = {}
    for a, b, name in sorted(spans):
        own = out.setdefault(name, [])
        if own and a < own[-1][1]:
            own[-1] = (own[-1][0], max(b, own[-1][1]), name)
        else:
            own.append((a, b, name))
    return sorted(s for own in out.values() for s in own)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_matches, licenses, spans.

    A match with more than half of its shingles in a longer match of another name does not count; on ties all do.
    ``licenses`` has the different names, sorted and comma-joined; ``spans`` has name:start:end of every match by
    start (words, end exclusive). A null or empty text has no words and no matches; repeated rows give a row each, an
    empty table none; other columns are ignored, whatever their names. One pass, no shuffle.
    """
    held: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Index(templates))
        for batch in batches:
            for piece in words.pieces(batch.column(1), words.ALNUM, lower=True):
                found = find(piece, held[0])
                spans = [found.get(r, []) for r in range(piece.rows)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(piece.first, piece.rows),
                    pa.array(np.diff(np.concatenate([[0], piece.stop])), pa.int64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array([",".join(sorted({n for _, _, n in s})) for s in spans], pa.string()),
                    pa.array([",".join(f"{n}:{a}:{b}" for a, b, n in s) for s in spans], pa.string())],
                    names=["doc_id", "n_words", "n_matches", "licenses", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_matches long, licenses string, spans string")
