"""License scans: MinHash bands over overlapping windows of a text retrieve templates, and exact
shingle containment verifies them.

Shingles are pairs of neighbouring words. Templates are sorted into size classes by powers of two.
A window of a class is a quarter longer than its largest template and begins every quarter, so
every occurrence of a template lies whole in some window, and at a containment of 0.8 the Jaccard
similarity of the two is at least 0.8 * t / (1.25 m + 0.2 t), 0.29 for the shortest template
(t just over m / 2) of a class m. With ``BANDS`` bands of ``BAND_ROWS`` rows such a pair meets in
some band with probability 1 - (1 - 0.29 ** 2) ** 64 = 0.996, a whole copy with more than 0.9999.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import id_and_text, texts

BANDS, BAND_ROWS = 64, 2
CONTAINMENT = 0.8
SMALLEST_CLASS = 8
#: Shingles worked on at once, or four times the largest window if that is more; pieces overlap by that window.
PIECE = 1 << 13
WORDS_KEPT = 500_000

# Short notices as they stand in documents, and opening passages of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

#: Every ASCII character but letters and digits parts words.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MIXED = np.uint64(0x9E3779B97F4A7C15)
NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(PARTS).split()


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """One hash for each pair of neighbours; a lone word pairs with nothing."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < 2:
        return h
    mixed = (h[:-1] * MIXED) ^ (h[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(31))


class Index:
    """Band keys of the templates by size class."""

    def __init__(self, templates: dict[str, str]):
        self.hashes = WordHashes()
        random = np.random.default_rng(20)
        self.factors = random.integers(1 << 62, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
        self.names = sorted(templates)
        self.sets = [np.unique(shingles(words_of(templates[n]), self.hashes)) for n in self.names]
        self.classes: dict[int, list[int]] = {}
        for n, own in enumerate(self.sets):
            size = SMALLEST_CLASS
            while size < len(own):
                size *= 2
            if len(own):
                self.classes.setdefault(size, []).append(n)
        self.keys = {m: np.stack([self.bands(self.signature(self.sets[n][None])) for n in own])[:, :, 0] for m, own in self.classes.items()}
        self.widest = max(self.classes, default=SMALLEST_CLASS) * 5 // 4
        self.piece = max(PIECE, 4 * self.widest)  # a piece holds any window several times

    def signature(self, blocks: np.ndarray) -> np.ndarray:
        """Least permuted hash of each row of ``blocks``: [permutation, row]."""
        return (blocks.reshape(-1)[None] * self.factors[:, None]).reshape(len(self.factors), *blocks.shape).min(2)

    @staticmethod
    def bands(least: np.ndarray) -> np.ndarray:
        """[band, row] from [permutation, row]."""
        pairs = least.reshape(BANDS, BAND_ROWS, -1)
        return pairs[:, 0] * MIXED ^ pairs[:, 1]

    def candidates(self, own: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first shingle, end) of the windows that meet a template in a band."""
        quarter = SMALLEST_CLASS // 4
        padded = np.full(-(-len(own) // quarter) * quarter, NOTHING)
        padded[: len(own)] = own
        least = np.full((len(self.factors), len(padded) // quarter), NOTHING)
        for at in range(quarter):
            permuted = padded[at::quarter] * self.factors[:, None]
            if len(padded) - quarter + at >= len(own):  # padding is no minimum
                permuted[:, -1] = NOTHING
            np.minimum(least, permuted, out=least)
        largest = max(self.classes, default=0)
        while quarter * 4 <= largest:
            size = quarter * 4
            if size in self.classes:
                blocks = least.shape[1]
                window = least.copy()
                for shift in range(1, min(5, blocks)):
                    np.minimum(window[:, :-shift], least[:, shift:], out=window[:, :-shift])
                found = self.bands(window)
                for n, key in zip(self.classes[size], self.keys[size]):
                    for block in np.flatnonzero((found == key[:, None]).any(0)):
                        yield n, int(block) * quarter, min(len(own), (int(block) + 5) * quarter)
            if least.shape[1] % 2:
                least = np.concatenate([least, np.full((len(least), 1), NOTHING)], axis=1)
            least = np.minimum(least[:, ::2], least[:, 1::2])
            quarter *= 2

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """Verified occurrences in each text; those of one template that overlap are one."""
        each = [shingles(words_of(t), self.hashes) for t in texts]
        ends = np.cumsum([0, *map(len, each)])
        flat = np.concatenate([*each, np.zeros(0, np.uint64)])
        found: list[dict[str, list[list]]] = [{} for _ in texts]
        step = self.piece - self.widest
        for start in range(0, max(len(flat), 1), step):
            piece = flat[start : start + self.piece]
            # A window may reach over a border of texts; each text then answers for its own part.
            for n, first, end in sorted(self.candidates(piece)):
                first, end = start + first, start + end
                doc = int(np.searchsorted(ends, first, "right")) - 1
                while doc < len(texts) and ends[doc] < end:
                    low, high = max(first, ends[doc]), min(end, ends[doc + 1])
                    self.verify(n, flat[low:high], int(low - ends[doc]), found[doc])
                    doc += 1
        return [[span for name in sorted(own) for span in sorted(own[name], key=lambda s: s["first_word"])] for own in found]

    def verify(self, n: int, window: np.ndarray, offset: int, found: dict[str, list[dict]]) -> None:
        template = self.sets[n]
        held = np.isin(window, template)
        share = len(np.unique(window[held])) / len(template)
        if share < CONTAINMENT:
            return
        at = np.flatnonzero(held) + offset
        span = {"name": self.names[n], "first_word": int(at[0]), "last_word": int(at[-1]) + (1 if len(template) > 1 or len(window) > 1 else 0), "containment": share}
        for other in found.setdefault(self.names[n], []):
            if other["first_word"] <= span["last_word"] and span["first_word"] <= other["last_word"]:
                other["first_word"], other["last_word"] = min(other["first_word"], span["first_word"]), max(other["last_word"], span["last_word"])
                other["containment"] = max(other["containment"], share)
                return
        found[self.names[n]].append(span)


@lru_cache(maxsize=2)
def index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id`` and ``licenses`` (array of name, first and last word, containment) of every row.

    Words are counted from 0. Whole texts are scanned; a null or empty text matches nothing;
    repeated rows are scanned each for itself; other columns are not read. A template without
    words matches nothing.
    """
    given = tuple(sorted(templates.items()))
    span = pa.struct([("name", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index(given)
        for batch, values in texts(batches):
            found = own.matches(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], ["doc_id", "licenses"])

    schema = "doc_id long, licenses array<struct<name:string,first_word:long,last_word:long,containment:double>>"
    return id_and_text(docs, id_column, text_column).mapInArrow(run, schema)
