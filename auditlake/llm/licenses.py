"""Operator 2, license scans: winnowed fingerprints, then banded alignment.

Method: the templates' runs of GRAM words are hashed and winnowed (the least hash of every few
neighbouring ones), and the winnowed ones form an inverted index from hash to (template, place).
However the words that COVERAGE lets a template miss are spread, a run of its words stays whole; runs
and windows (at most GRAM and WINDOW) are no longer than lets one fingerprint fall inside it, so
substituted or missing words never hide a passage. Words inserted between matched ones are not bounded
by COVERAGE: a passage with one inside every run of the index is not found. A template shorter than
GRAM is looked up as a whole; one without a word is refused. Every run of a whole document is looked up. Hits of one template on neighbouring
diagonals are one candidate; a local alignment of the template's words with the document's, in
a band around the candidate's diagonal, gives the matched words and the spans on both sides.
Candidates of a template are aligned together, row by row of the template. Once a span is found, its
candidate is aligned again in the words before and after it, until nothing that reaches the coverage
is left in the band. Where reported spans of a document overlap, the one with the higher score stays.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` in lower case. Templates are a parameter; they are
checked against MOST_TEMPLATE_WORDS before they are broadcast.

Defined results: null and empty texts match nothing and give no rows; repeated rows are scanned
one by one; ties of score go to the earlier span, then to the template's name; an empty table or
no templates give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tune
from .textops import ALNUM, LOWER, Words, buffers, prefix, window_hashes

GRAM = 3
WINDOW = 4
BAND = 8
COVERAGE = 0.8
MATCH, MISS, GAP = 2, 1, 1
MOST_TEMPLATE_WORDS = 2_000_000

#: Short public notices, by SPDX identifier where there is one.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash (the rightmost on a tie) of every window of neighbours."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(hashes[::-1].argmin())], np.int64) if len(hashes) else np.zeros(0, np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(wide)) + window - 1 - wide[:, ::-1].argmin(axis=1))


def intact(size: int, coverage: float) -> int:
    """Length of the run of words that is whole in every copy of a template of `size` words with that coverage."""
    missed = next(m for m in range(size, -1, -1) if m == 0 or size - m >= coverage * size)
    return -(-(size - missed) // (missed + 1))


class Index:
    """Inverted index of the templates' winnowed fingerprints, by the words of a fingerprint."""

    def __init__(self, templates, coverage: float = COVERAGE, gram: int = GRAM, window: int = WINDOW):
        self.names = [name for name, _ in templates]
        data, offsets = buffers(pa.array([text for _, text in templates], pa.string()))
        data = LOWER[data]
        words = Words(data, offsets, ALNUM)
        if len(words.starts) > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {MOST_TEMPLATE_WORDS} words")
        flat = words.hashes(data)
        self.words = [flat[a:b] for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
        entries: dict[int, list] = {}
        for k, own in enumerate(self.words):
            if not len(own):
                raise ValueError(f"template {self.names[k]} holds no word")
            run = intact(len(own), coverage)
            width = max(1, min(gram, run))
            _, hashes = window_hashes(own, np.array([0, len(own)]), width)
            at = winnow(hashes, max(1, min(window, run - width + 1)))
            entries.setdefault(width, []).append((hashes[at], np.full(len(at), k), at))
        self.tables = {}
        for width, parts in entries.items():
            keys, template, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys, kind="stable")
            self.tables[width] = keys[order], template[order], place[order]

    def found(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word's index, template, diagonal) of all fingerprints in the texts' words."""
        out = [(np.zeros(0, np.int64),) * 3]
        for width, (keys, template, place) in self.tables.items():
            at, grams = window_hashes(words, offsets, width)
            hit, entry = self.hits(keys, grams)
            out.append((at[hit], template[entry], at[hit] - place[entry]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @staticmethod
    def hits(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's place, entry of the index) of all equal hashes."""
        low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
        found = np.flatnonzero(high > low)
        sizes = high[found] - low[found]
        entry = np.arange(sizes.sum()) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(found) else np.zeros(0, np.int64)
        return np.repeat(found, sizes), np.repeat(low[found], sizes) + entry


def align(template: np.ndarray, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, diagonals: np.ndarray, band: int = BAND) -> dict[str, np.ndarray]:
    """Best local alignment of each candidate within the band around its diagonal.

    Candidate c lines template word q up with the document's words q + diagonals[c] - band to
    q + diagonals[c] + band, inside [begins[c], ends[c]). Returns score, matched, and the spans
    (template_start, template_end), (word_start, word_end).
    """
    n, width = len(diagonals), 2 * band + 1
    lane = np.arange(width)
    score = np.zeros((n, width), np.int64)
    state = np.zeros((3, n, width), np.int64)  # matched, template start, word start
    best = np.zeros(n, np.int64)
    out = np.zeros((5, n), np.int64)  # matched, template start, template end, word start, word end
    for q, word in enumerate(template):
        at = diagonals[:, None] + q - band + lane
        inside = (at >= begins[:, None]) & (at < ends[:, None])
        same = inside & (words[np.clip(at, 0, len(words) - 1)] == word)
        # a pair continues the same lane; where nothing stands before it, it starts here
        fresh = score <= 0
        base = np.where(fresh, 0, score)
        paired = base + np.where(same, MATCH, -MISS)
        kept = np.stack([np.where(fresh, 0, state[0]) + same, np.where(fresh, q, state[1]), np.where(fresh, at, state[2])])
        # a template word without a partner: from the next lane of the row before
        skipped = np.full_like(score, -1)
        skipped[:, :-1] = score[:, 1:] - GAP
        from_skip = np.zeros_like(state)
        from_skip[:, :, :-1] = state[:, :, 1:]
        take = skipped > paired
        row = np.where(take, skipped, paired)
        state = np.where(take, from_skip, kept)
        row = np.where(inside, row, 0)
        # document words without a partner: from the lanes before, in the same row
        keys = (row + GAP * lane) * 64 + (63 - lane)
        top = np.maximum.accumulate(keys, axis=1)
        source = 63 - top % 64
        score = np.where(inside, np.maximum(top // 64 - GAP * lane, 0), 0)
        state = np.take_along_axis(state, np.broadcast_to(source, (3, n, width)), axis=2)
        high = score.argmax(axis=1)
        value = score[np.arange(n), high]
        better = np.flatnonzero(value > best)
        best[better] = value[better]
        cell = (slice(None), better, high[better])
        matched, first, word_first = state[cell]
        out[:, better] = [matched, first, np.full(len(better), q + 1), word_first, at[better, high[better]] + 1]
    return {"score": best, "matched": out[0], "template_start": out[1], "template_end": out[2], "word_start": out[3], "word_end": out[4]}


def _candidates(doc: np.ndarray, template: np.ndarray, diagonal: np.ndarray, band: int):
    """One candidate for each run of hits whose diagonals are at most `band` apart."""
    order = np.lexsort((diagonal, doc, template))
    doc, template, diagonal = doc[order], template[order], diagonal[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (np.diff(diagonal) > band)
    group = np.cumsum(new) - 1
    # hits of a run may spread beyond the band: then every `band` diagonals there is a candidate
    first = diagonal[new][group] if len(doc) else diagonal
    step = (diagonal - first) // band
    keep = np.ones(len(doc), bool)
    keep[1:] = new[1:] | (step[1:] != step[:-1])
    return doc[keep], template[keep], diagonal[keep]


def occurrences(template: np.ndarray, words: np.ndarray, begins: np.ndarray, ends: np.ndarray, diagonals: np.ndarray, least: float, most: int = 1 << 14):
    """(candidate, score, matched, word start, word end, template start, template end) of all good spans.

    A candidate's band may hold several occurrences of a short template: what lies before and after
    a span that was found is aligned again.
    """
    for cut in range(0, len(diagonals), most):
        which = np.arange(cut, min(cut + most, len(diagonals)))
        # the words that the band can reach
        low = np.maximum(begins[which], diagonals[which] - BAND)
        high = np.minimum(ends[which], diagonals[which] + len(template) + BAND)
        while len(which):
            result = align(template, words, low, high, diagonals[which])
            good = np.flatnonzero(result["matched"] >= least)
            first, last = result["word_start"][good], result["word_end"][good]
            yield from zip(*(x.tolist() for x in (which[good], result["score"][good], result["matched"][good], first, last, result["template_start"][good], result["template_end"][good])), strict=True)
            which, low, high = np.tile(which[good], 2), np.concatenate([low[good], last]), np.concatenate([first, high[good]])
            room = high - low >= least
            which, low, high = which[room], low[room], high[room]


def _scan(batches: Iterator[pa.RecordBatch], shared, coverage: float) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    for batch in text_chunks(batches):
        raw, offsets = buffers(batch.column("text"))
        data = LOWER[raw]
        words = Words(data, offsets, ALNUM)
        hashes = words.hashes(data)
        place, of, diagonal = index.found(hashes, words.offsets)
        row = np.searchsorted(words.offsets, place, "right") - 1
        doc, template, diagonal = _candidates(row, of, diagonal, BAND)
        found: list[tuple] = []
        for k in np.unique(template).tolist():
            mine = template == k
            rows = doc[mine]
            size = len(index.words[k])
            for i, score, matched, begin, end, first, last in occurrences(index.words[k], hashes, words.offsets[rows], words.offsets[rows + 1], diagonal[mine], coverage * size):
                found.append((int(rows[i]), -score, begin, index.names[k], end, matched, size, first, last))
        chars = prefix(((raw & 0xC0) != 0x80).astype(np.int64))
        taken: dict[int, list[tuple[int, int]]] = {}
        rows_out = []
        for r, score, begin, name, end, matched, size, first, last in sorted(set(found)):
            spans = taken.setdefault(r, [])
            if any(begin < b and a < end for a, b in spans):
                continue
            spans.append((begin, end))
            base = chars[offsets[r]]
            rows_out.append((r, name, matched, size, matched / size, int(chars[words.starts[begin]] - base), int(chars[words.ends[end - 1]] - base), first, last, -score))
        columns = list(zip(*rows_out, strict=True)) or [()] * 10
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
            "license_id": pa.array(columns[1], pa.string()),
            "matched_words": pa.array(columns[2], pa.int64()),
            "template_words": pa.array(columns[3], pa.int64()),
            "coverage": pa.array(columns[4], pa.float64()),
            "start_char": pa.array(columns[5], pa.int64()),
            "end_char": pa.array(columns[6], pa.int64()),
            "template_start": pa.array(columns[7], pa.int64()),
            "template_end": pa.array(columns[8], pa.int64()),
            "align_score": pa.array(columns[9], pa.int64()),
        })


_SCHEMA = "doc_id long, license_id string, matched_words long, template_words long, coverage double, start_char long, end_char long, template_start long, template_end long, align_score long"


def scan(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """License passages of all documents whose matched share of the template reaches coverage."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Index(templates, coverage))

    def step(batches):
        return _scan(batches, shared, coverage)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(step, _SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
