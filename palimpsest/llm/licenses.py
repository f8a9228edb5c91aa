"""Operator 5, license scans: winnowed fingerprints pick candidate templates, banded alignment reports what they cover.

Words of a text become the numbers of template words, so most words of most texts fall away at once. Hashes of short runs of
known words are looked up in an inverted index of the templates' fingerprints. Long templates are winnowed; of short ones, where
edits leave few runs, every run of two words is kept, and as many must be hit along one diagonal as the edits that the coverage
allows must leave. Where a template is hit often enough, the text is aligned with it, word by word, within a band round the
diagonal of the hits; the alignments of a batch of texts are one computation a template.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import modest, table
from .tokens import slices

#: Words of a fingerprint and hashes that compete in a winnow, for templates of more than ``SHORT`` words; hits that such a template needs.
GRAM, WINNOW, SHORT, HITS = 3, 4, 24, 2
#: Half the width of the band at most, and the least coverage that is reported.
BAND, COVERAGE = 12, 0.8

# Short public license notices and references that pages and sources carry.
TEMPLATES = {
    "MIT-reference": "Released under the MIT License.",
    "Apache-2.0-reference": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-reference": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-reference": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-reference": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-reference": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

WORD = re.compile(r"[^\W_]+")
#: Packed cells of an alignment: score, matched words, and how early it starts.
ONE, WORDS = 1 << 40, 1 << 20


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.int64)
    for k in range(size):
        h = (h * 1_000_003 + ids[k : k + n] * 7_919 + 1) % ((1 << 31) - 1)
    return h


class Index:
    """Templates as rows of word numbers, and an inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names, self.coverage = sorted(n for n in templates if words(templates[n])), coverage
        self.vocabulary: dict[str, int] = {}
        self.ids = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(templates[n])], np.int64) for n in self.names]
        self.band = [max(2, min(BAND, len(ids) // 4)) for ids in self.ids]
        self.least, found = [], {}
        for t, ids in enumerate(self.ids):
            short = len(ids) <= SHORT
            size, winnow = (min(2, len(ids)), 1) if short else (GRAM, WINNOW)
            h = hashes(ids, size)
            picked = {min(range(i, min(i + winnow, len(h))), key=lambda j: (int(h[j]), -j)) for i in range(max(1, len(h) - winnow + 1))}
            edits = int((1 - coverage) * len(ids) + 1e-9)
            self.least.append(max(1, len(h) - size * edits) if short else HITS)
            found.setdefault(size, []).extend((int(h[j]), t, j) for j in picked)
        self.places = {size: tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) for size, rows in found.items()}  # hash, template, place

    def numbers(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) of every place of a text with enough hits; a diagonal is the place where the template would start."""
        hit_t, hit_d = [], []
        for size, (known, template, place) in self.places.items():
            h = hashes(ids, size)
            lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            at = np.flatnonzero(hi > lo)
            if len(at):
                n = (hi - lo)[at]
                which = np.repeat(lo[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                hit_t.append(template[which])
                hit_d.append(np.repeat(at, n) - place[which])
        out: list[tuple[int, int]] = []
        if hit_t:
            t, d = np.concatenate(hit_t), np.concatenate(hit_d)
            for k in np.unique(t).tolist():
                mine = np.sort(d[t == k])
                upto, i = np.searchsorted(mine, mine + self.band[k], "right"), 0
                while i < len(mine):
                    if upto[i] - i >= self.least[k]:
                        out.append((k, int(mine[(i + upto[i] - 1) // 2])))
                        i = int(upto[i])
                    else:
                        i += 1
        return out


def align(template: np.ndarray, texts: list[np.ndarray], diagonals: list[int], band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Local alignments of a template with places of several texts, where a text's place minus the template's is within ``band`` of a diagonal.

    A match earns 1, a mismatch or gap costs 1; of equal scores more matched words win, then the earlier start. Returns for every
    pair the matched words and the first and last + 1 place in the text."""
    wide = 2 * band + 1
    piece = np.full((len(texts), len(template) + 2 * band), -1, np.int64)
    for row, (ids, diagonal) in enumerate(zip(texts, diagonals)):
        lo = diagonal - band
        part = ids[max(0, lo) : max(0, lo + piece.shape[1])]
        piece[row, max(0, -lo) : max(0, -lo) + len(part)] = part
    place, step = np.arange(piece.shape[1]), np.arange(wide) * ONE
    cells, best, end = np.zeros((len(texts), wide + 1), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, word in enumerate(template):
        before, fresh = cells[:, :wide], WORDS - 1 - place[i : i + wide]
        new = np.where(piece[:, i : i + wide] == word, np.where(before > 0, before, fresh) + ONE + WORDS, before - ONE)
        new = np.maximum(new, cells[:, 1:] - ONE)  # a template word that the text lacks
        new = np.maximum.accumulate(new + step, 1) - step  # text words that the template lacks
        new[new < ONE] = 0
        cells[:, :wide] = new
        at = new.argmax(1)
        top = new[np.arange(len(new)), at]
        end = np.where(top > best, place[i] + at + 1, end)
        best = np.maximum(best, top)
    first = np.array(diagonals, np.int64) - band
    return best // WORDS % WORDS, first + WORDS - 1 - best % WORDS, first + end


def scan_texts(index: Index, texts: list[str | None]) -> list[list[tuple[str, float, int, int, bool]]]:
    """For every whole text (template, share of its words that match, start, end, best) of every place; code points, end exclusive.

    Places of one template that overlap count once, with the most words. ``best`` is true unless an overlapping place of another
    template matches more words, or as many and a larger share of its own, or all that and has a smaller name."""
    asked: dict[int, list[tuple[int, int]]] = {}
    ids: dict[int, np.ndarray] = {}
    for i, text in enumerate(texts):
        if text:
            numbers = index.numbers(WORD.findall(text.lower()))
            for t, diagonal in index.candidates(numbers):
                asked.setdefault(t, []).append((i, diagonal))
                ids[i] = numbers
    hits: dict[int, list[tuple[int, float, str, int, int]]] = {}
    for t, pairs in asked.items():
        n = len(index.ids[t])
        matched, start, end = align(index.ids[t], [ids[i] for i, _ in pairs], [d for _, d in pairs], index.band[t])
        rows = sorted((i, -m, s, e) for (i, _), m, s, e in zip(pairs, matched.tolist(), start.tolist(), end.tolist()) if m >= index.coverage * n - 1e-9)
        taken: dict[int, list[tuple[int, int]]] = {}
        for i, m, s, e in rows:
            if all(e <= a or s >= b for a, b in taken.setdefault(i, [])):
                taken[i].append((s, e))
                hits.setdefault(i, []).append((m, m / n, index.names[t], s, e))  # counts are negative, so that the best sorts first
    out: list[list[tuple[str, float, int, int, bool]]] = [[] for _ in texts]
    for i, found in hits.items():
        text, lowered = texts[i], texts[i].lower()
        spans = [m.span() for m in WORD.finditer(lowered if len(lowered) == len(text) else text)]
        found.sort()
        for k, (m, share, name, s, e) in enumerate(found):
            best = all(e <= a or s >= b for *_, a, b in found[:k])
            out[i].append((name, -share, spans[s][0], spans[e - 1][1], best))
        out[i].sort(key=lambda x: (x[2], x[0], x[3]))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per found notice in ``docs(doc_id, text)``: doc_id, license, coverage, span_start, span_end, best.

    A notice counts if the best alignment matches at least ``coverage`` of its words. Notices of several templates may overlap and
    are all reported; ``best`` marks the one with the most matched words, ties by coverage, then by name. Null and empty texts have
    none; long texts are read whole; a null doc_id stays null; repeated rows are reported each; an empty table gives no rows; other
    columns are ignored. ``templates`` is a small table: its index travels to every task."""
    box = docs.sparkSession.sparkContext.broadcast(Index(templates, coverage))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("best", T.BooleanType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                found = scan_texts(box.value, batch.column(1).to_pylist())
                at = [i for i, rows in enumerate(found) for _ in rows]
                cols = list(zip(*(row for rows in found for row in rows))) if at else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())))], names=schema.names)

    return modest(docs.select("doc_id", "text")).mapInArrow(run, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, coverage, span_start, span_end and best of every license notice in ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))
