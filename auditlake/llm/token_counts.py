"""Operator 4, token counts by section: offset-mapped attribution.

Method: each whole document is encoded once. The tokens' byte spans follow from the ids (a
byte-level vocabulary is lossless, so a token's span is as long as its bytes), and an interval
join by binary search gives each token the sections that it touches. A token inside one section
belongs to it. A token across a boundary goes, by the rule `largest`, to the section that holds
most of its bytes, the earlier one on a tie; by the rule `first`, to the section of its first
byte. The counts of a document's sections therefore add up to its token count.

Sections are lines with their line break, the fields of `field_counts`, or spans given in a column
of structs (start, end) in characters; what no span covers is section -1.

Defined results: a null or empty text is one section 0 with no tokens (with spans: each of them
with none); repeated rows are counted one by one; an empty table gives no rows; extra columns are
ignored. A span's section is its place in the array. Spans may stand in any order: they are cut to
the text, and one that overlaps an earlier one (by start, then end, then place) begins where that
one ends; a null span, or one with a null bound or nothing left, holds no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tune
from .textops import buffers, prefix, rows_of
from .tokenizing import load

_SIZES: dict[str, np.ndarray] = {}


def token_sizes(tokenizer: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary: one character of a token stands for one byte."""
    if tokenizer not in _SIZES:
        library = load(tokenizer).library
        if load(tokenizer).words:
            raise ValueError("the vocabulary drops characters; offsets cannot be derived from ids")
        sizes = np.zeros(library.get_vocab_size(), np.int64)
        for token, i in library.get_vocab().items():
            sizes[i] = len(token)
        _SIZES[tokenizer] = sizes
    return _SIZES[tokenizer]


def allocate(token_ends: np.ndarray, token_starts: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether it crosses a boundary). Sections are sorted and apart."""
    first = np.searchsorted(ends, token_starts, "right")
    last = np.searchsorted(starts, token_ends - 1, "right") - 1
    touches = first <= last
    at = np.minimum(first, max(len(starts) - 1, 0))
    within = touches & (first == last)
    if len(starts):
        within &= (starts[at] <= token_starts) & (token_ends <= ends[at])
    out = np.where(touches, first, -1)
    crossing = np.flatnonzero(touches & ~within)
    for t in crossing.tolist():
        a, b = int(token_starts[t]), int(token_ends[t])
        held = [(min(b, int(ends[s])) - max(a, int(starts[s])), -s) for s in range(int(first[t]), int(last[t]) + 1)]
        if rule == "largest":
            most, place = max(held)
            outside = (b - a) - sum(h for h, _ in held)
            out[t] = -place if most >= outside else -1
        else:
            s = int(first[t])
            out[t] = s if starts[s] <= a else -1
    crosses = np.zeros(len(token_starts), bool)
    crosses[crossing] = True
    return out, crosses


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text's index) of the lines of each text; an empty text has none."""
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[offsets[:-1]] = True
    opens[1:] |= np.concatenate([data == 0x0A]) if n else opens[1:]
    opens = opens[:n]
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], n)[: len(starts)]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _count(batches: Iterator[pa.RecordBatch], tokenizer: str, rule: str, spans: bool) -> Iterator[pa.RecordBatch]:
    coder, sizes = load(tokenizer), token_sizes(tokenizer)
    for batch in text_chunks(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        data, offsets = buffers(batch.column("text"))
        ids, id_offsets = coder.encode(texts)
        edges = prefix(sizes[ids])
        if (edges[id_offsets] != offsets).any():
            raise ValueError("token bytes do not add up to the text's")
        chars = prefix(((data & 0xC0) != 0x80).astype(np.int64))
        if spans:
            starts, ends, row, number, empty = _given(batch.column("spans").to_pylist(), chars, offsets)
        else:
            starts, ends, row = _lines(data, offsets)
            number, empty = np.arange(len(row)) - np.searchsorted(row, row, "left"), np.zeros((0, 2), np.int64)
        section, crosses = allocate(edges[1:], edges[:-1], starts, ends, rule)
        n = len(starts)
        inside = section >= 0
        tokens, crossing = np.bincount(section[inside], minlength=n), np.bincount(section[inside & crosses], minlength=n)
        lost = np.bincount(rows_of(np.diff(id_offsets))[~inside], minlength=len(texts))
        known = np.bincount(row, minlength=len(texts)) + np.bincount(empty[:, 0], minlength=len(texts))
        bare = np.concatenate([np.flatnonzero((known == 0) & (lost == 0)), empty[:, 0]])
        bare_number = np.concatenate([np.zeros(len(bare) - len(empty), np.int64), empty[:, 1]])
        rest = np.flatnonzero(lost)
        doc = np.concatenate([row, bare, rest])
        zero, none = np.zeros(len(bare), np.int64), np.zeros(len(rest), np.int64)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())),
            "section": pa.array(np.concatenate([number, bare_number, none - 1]), pa.int64()),
            "start_char": pa.array(np.concatenate([chars[starts] - chars[offsets[row]], zero, none]), pa.int64()),
            "n_chars": pa.array(np.concatenate([chars[ends] - chars[starts], zero, none]), pa.int64()),
            "n_tokens": pa.array(np.concatenate([tokens, zero, lost[rest]]), pa.int64()),
            "n_crossing": pa.array(np.concatenate([crossing, zero, none]), pa.int64()),
        })


def _given(spans: list, chars: np.ndarray, offsets: np.ndarray):
    """Character spans as byte spans of the batch, sorted and apart: (starts, ends, text, section, (text, section) of empty ones)."""
    kept, empty = [], []
    for i, own in enumerate(spans):
        base, at = int(chars[offsets[i]]), 0
        length = int(chars[offsets[i + 1]]) - base
        found = []
        for k, x in enumerate(own or []):
            if x is None or x["start"] is None or x["end"] is None:
                empty.append((i, k))
            else:
                found.append((max(x["start"], 0), min(x["end"], length), k))
        for start, end, k in sorted(found):
            start = max(start, at)
            if start < end:
                kept.append((base + start, base + end, i, k))
                at = end
            else:
                empty.append((i, k))
    table = np.array(kept, np.int64).reshape(-1, 4)
    return np.searchsorted(chars, table[:, 0]), np.searchsorted(chars, table[:, 1]), table[:, 2], table[:, 3], np.array(empty, np.int64).reshape(-1, 2)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", rule: str = "largest", spans: str | None = None) -> DataFrame:
    """doc_id, section, start_char, n_chars, n_tokens, n_crossing. No shuffle."""
    tune(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.col(spans).alias("spans")] if spans else [])]

    def count(batches):
        return _count(batches, tokenizer, rule, spans is not None)

    return docs.select(*columns).mapInArrow(count, "doc_id long, section long, start_char long, n_chars long, n_tokens long, n_crossing long")


def field_counts(docs: DataFrame, fields: list[str], separator: str = "\n", tokenizer: str = "byte_bpe_50k.json", rule: str = "largest") -> DataFrame:
    """doc_id, field, n_tokens, n_crossing: tokens of the fields' texts, encoded as one document.

    The document is the fields in the given order with the separator between them; a null field is
    empty. Tokens of the separators alone have a null field.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0).cast("long")
    for text in texts:
        end = at + F.length(text)
        spans.append(F.struct(at.alias("start"), end.alias("end")))
        at = end + len(separator)
    whole = docs.select("doc_id", F.concat_ws(separator, *texts).alias("text"), F.array(*spans).alias("spans"))
    counted = token_counts(whole, tokenizer, rule, "spans")
    name = F.get(F.array(*map(F.lit, fields)), F.col("section").cast("int"))
    return counted.select("doc_id", F.when(F.col("section") >= 0, name).alias("field"), "n_tokens", "n_crossing")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
