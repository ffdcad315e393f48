"""License scans: MinHash bands over overlapping text windows retrieve
templates, and exact containment of five-word shingles verifies them.

For a template of ``n`` words the text's windows have ``n + n // 2`` words and
start every ``n // 2``, so any ``n`` consecutive words lie in one window.  From
the containment asked for follows the least Jaccard similarity of such a window
and its template; the number of bands is set so that they collide with
probability ``RECALL`` or more at that similarity.

A window and a template can only share a minimum if they share a shingle, so
signatures are made for windows that hold a shingle of some template; this
changes no result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_document, plain_words, table, word_offsets

SHINGLE = 5
CONTAINMENT = 0.8
RECALL = 0.999
ROWS = 2
#: Templates are broadcast; this bounds their text.
TEMPLATE_BYTES = 8 << 20

#: Public license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()),
                                     T.StructField("end", T.LongType()), T.StructField("containment", T.DoubleType())]))
_MATCHES_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def window_shape(n: int) -> tuple[int, int]:
    """Words of a window and words from one window to the next, for a template of n words."""
    step = max(1, n // 2)
    return n + step, step


def least_jaccard(n: int, containment: float) -> float:
    """Of a template of n words and the window that holds an occurrence of it."""
    m, w = max(1, n - SHINGLE + 1), window_shape(n)[0] - SHINGLE + 1
    shared = math.ceil(containment * m)
    return shared / (m + w - shared)


def bands_needed(jaccard: float, rows: int = ROWS, recall: float = RECALL) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(jaccard ** rows, 1 - 1e-9))))


def shingles(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of every run of five words (of all words, if fewer)."""
    if not words:
        return np.empty(0, np.uint64)
    for w in set(words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i:len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Band keys of all templates."""

    def __init__(self, templates: list[tuple[str, str]], containment: float = CONTAINMENT, rows: int = ROWS):
        self.containment, self.rows = containment, rows
        self.templates = []  # name, words, set of shingles
        for name, text in templates:
            w = plain_words(text.encode())
            if w:
                self.templates.append((name, len(w), np.unique(shingles(w, {}))))
        lengths = sorted({t[1] for t in self.templates})
        self.bands = max((bands_needed(least_jaccard(n, containment), rows) for n in lengths), default=1)
        rng = np.random.default_rng(20240229)
        self.mul = rng.integers(0, 1 << 63, self.bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, self.bands * rows, np.uint64)
        self.at: dict[int, dict[tuple[int, bytes], list[int]]] = {n: {} for n in lengths}
        for k, (_, n, s) in enumerate(self.templates):
            for key in self.keys(s):
                self.at[n].setdefault(key, []).append(k)
        self.known = np.unique(np.concatenate([t[2] for t in self.templates])) if self.templates else np.empty(0, np.uint64)

    def keys(self, s: np.ndarray) -> list[tuple[int, bytes]]:
        low = ((s[None, :] * self.mul[:, None] + self.add[:, None]) >> np.uint64(20)).min(axis=1)
        return [(b, low[b * self.rows:(b + 1) * self.rows].tobytes()) for b in range(self.bands)]

    def find(self, s: np.ndarray, n_words: int) -> list[tuple[int, int, int, float]]:
        """(template, first word, past last word, containment) of verified matches; of
        overlapping windows of one template the best counts."""
        if not len(self.known) or not len(s):
            return []
        place = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        hits = np.flatnonzero(self.known[place] == s)
        out = []
        for n, keyed in self.at.items() if len(hits) else ():
            width, step = window_shape(n)
            starts = set()
            for p in hits.tolist():
                starts.update(range(max(0, -(-(p + SHINGLE - width) // step)), p // step + 1))
            best: dict[int, list] = {}
            for first in sorted(x * step for x in starts):
                own = s[first:first + width - SHINGLE + 1]
                if not len(own):
                    continue
                for k in {k for key in self.keys(own) for k in keyed.get(key, ())}:
                    _, m, t = self.templates[k]
                    inside = np.flatnonzero(np.isin(own, t))
                    share = len(np.unique(own[inside])) / len(t)
                    if share >= self.containment:
                        a, b = first + int(inside[0]), min(n_words, first + int(inside[-1]) + min(SHINGLE, m))
                        held = best.setdefault(k, [])
                        if held and held[-1][1] < b and a < held[-1][2]:
                            if share > held[-1][3]:
                                held[-1] = (k, a, b, share)
                        elif not held or a >= held[-1][2]:
                            held.append((k, a, b, share))
            out += [x for v in best.values() for x in v]
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT,
                  text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``matches``: license, start and end (code points, end exclusive) and
    the share of the template's five-word shingles that the window holds.

    A template of fewer than five words is one shingle.  Null and empty texts
    and templates without words match nothing.
    """
    templates = TEMPLATES if templates is None else [(n, t) for n, t in templates if t]
    if sum(len(t.encode()) for _, t in templates) > TEMPLATE_BYTES:
        raise ValueError(f"templates hold more than {TEMPLATE_BYTES} bytes; scan in parts")
    shared = docs.sparkSession.sparkContext.broadcast(templates)

    def start():
        index, known = Index(shared.value, containment), {}
        short = any(n < SHINGLE for n in index.at)

        def compute(texts):
            out = []
            for raw in texts:
                if len(known) > 500_000:
                    known.clear()
                words = plain_words(raw)
                found = index.find(shingles(words, known), len(words))
                if short:
                    found += _short(index, words)
                first, past = word_offsets(raw) if found else ((), ())
                out.append([{"license": index.templates[k][0], "start": int(first[a]), "end": int(past[b - 1]), "containment": share}
                            for k, a, b, share in found])
            return [out]

        return compute

    return per_document(docs, [("matches", _MATCHES, _MATCHES_ARROW)], start, text_col, keep)


def _short(index: Index, words: list[bytes]) -> list[tuple[int, int, int, float]]:
    """Occurrences of templates of fewer than five words: their one shingle is the whole template."""
    out, h = [], {}
    for k, (_, n, s) in enumerate(index.templates):
        if n < SHINGLE and len(words) >= SHINGLE:
            for i in range(len(words) - n + 1):
                if shingles(words[i:i + n], h)[0] == s[0]:
                    out.append((k, i, i + n, 1.0))
    return out


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, keep=["doc_id"])
    return found.select("doc_id", F.inline("matches"))
