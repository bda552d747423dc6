"""Operator 12, fill-in-the-middle: texts cut at two unit boundaries and put in another order.

Method: a batch of texts is decoded to one UTF-32 numpy array. Neighbouring code points of unlike
class (inside and outside a line break, a word, or always for single characters) are compared, and
flatnonzero gives the unit boundaries. A hash of the seed and the id chooses two ranks among a
text's boundaries; the pieces between them are slices of the array, which are joined with the
sentinels in the order of the form and encoded again.

Units: `line` (a line with its break, `[^\\n]*\\n|[^\\n]+`), `word` (a run of non-space with the
space after it) or `char`. Forms: `psm` is prefix, suffix, middle; `spm` is suffix, prefix, middle;
`plain` is the text itself, which an empty text, a text that holds a sentinel, and the share of
texts that `fim_percent` leaves out get. Since only texts without sentinels are transformed and no
sentinel can begin inside another, the output names its own pieces: `restored` needs nothing else.

Defined results: a null text is empty; a null id counts as an id without digits; repeated rows are
transformed alike, one by one; an empty table gives no rows; extra columns are kept, and the
columns added get a prefix that no column of the input has. Memory: a task holds the texts of one
chunk (0.5 MB, or one longer text) about sixteen times, and eight bytes a unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, text_chunks, tune
from .textops import buffers, prefix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
FIM_PERCENT = 100
SPM_PERCENT = 50
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint32)


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets of each text)."""
    data, offsets = buffers(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # a code point begins at every byte but 10xxxxxx
    return points, heads[offsets]


def encode(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[offsets]
    data = points.tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())


def boundaries(points: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(all boundaries of units, the start of each text's own among them); both ends of a text are boundaries.

    A text of n units has n + 1 boundaries, an empty one has one.
    """
    n = len(points)
    if unit == "line":
        kind = points == 0x0A
        marks = kind[:-1]  # a line ends after each break, and two breaks are two lines
    elif unit == "word":
        kind = np.isin(points, _SPACES)
        marks = kind[:-1] & ~kind[1:]
    elif unit == "char":
        marks = np.ones(max(n - 1, 0), bool)
    else:
        raise ValueError(f"unit {unit!r}: line, word or char")
    cut = np.flatnonzero(marks) + 1
    inner = cut[~np.isin(cut, offsets)]
    rows = np.searchsorted(offsets, inner, "right") - 1
    # starts of texts, inner boundaries and ends of texts that hold anything, in the order of the texts
    filled = np.flatnonzero(np.diff(offsets))
    at = np.concatenate([offsets[:-1], inner, offsets[filled + 1]])
    of = np.concatenate([np.arange(len(offsets) - 1), rows, filled])
    order = np.lexsort((at, of))
    return at[order], np.searchsorted(of[order], np.arange(len(offsets)))


def _ranks(ids: list, counts: np.ndarray, seed: int) -> np.ndarray:
    """Of each id: first and last rank among counts + 1 boundaries, and the two numbers that choose the form."""
    out = np.zeros((len(ids), 4), np.int64)
    for k, (i, n) in enumerate(zip(ids, counts.tolist(), strict=True)):
        digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * g : 8 * g + 8], 16) for g in range(4)]
        out[k] = (*sorted((h[0] % (n + 1), h[1] % (n + 1))), h[2] % 100, h[3] % 100)
    return out


def fill_in_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "line", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), seed: int = SEED, added: str | None = None,
) -> DataFrame:
    """docs with the columns n (units), form, output, prefix_chars and middle_chars (null if plain), named with `added` before them.

    One narrow pass. `added` is by default a prefix that no column has; `restored` turns output and form back into the text.
    """
    for a in sentinels:
        if any(b != a and a in b for b in sentinels) or any(a[k:] and b.startswith(a[k:]) for b in sentinels for k in range(1, len(a))):
            raise ValueError("a sentinel must not begin inside a sentinel")
    tune(docs.sparkSession)
    added = free_prefix("_fim_", docs.columns) if added is None else added
    marks = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in sentinels]
    names = [f"{added}{c}" for c in ("n", "form", "output", "prefix_chars", "middle_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, column="_fim_text_"):
            points, offsets = decode(batch.column("_fim_text_"))
            found, first = boundaries(points, offsets, unit)
            counts = np.diff(first) - 1
            drawn = _ranks(batch.column("_fim_key_").to_pylist(), counts, seed)
            low, high = found[first[:-1] + drawn[:, 0]], found[first[:-1] + drawn[:, 1]]
            plain = (np.diff(offsets) == 0) | (drawn[:, 2] >= fim_percent)
            for mark in marks:
                plain[np.searchsorted(offsets, _occurrences(points, mark, offsets), "right") - 1] = True
            swapped = drawn[:, 3] < spm_percent
            parts, sizes = [], np.diff(offsets) + np.where(plain, 0, sum(map(len, marks)))
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if plain[k]:
                    parts.append(points[a:b])
                else:
                    head, middle, tail = points[a : low[k]], points[low[k] : high[k]], points[high[k] : b]
                    parts += [marks[1], tail, marks[0], head, marks[2], middle] if swapped[k] else [marks[0], head, marks[1], tail, marks[2], middle]
            output = encode(np.concatenate(parts) if parts else points, prefix(sizes))
            form = np.where(plain, "plain", np.where(swapped, "spm", "psm"))
            own = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(counts), pa.array(form, pa.string()), output, pa.array(low - offsets[:-1], mask=plain), pa.array(high - low, mask=plain)],
                [*batch.schema.names[2:], *names],
            )

    held = docs.select(F.col(f"`{text}`").alias("_fim_text_"), F.col(f"`{key}`").cast("string").alias("_fim_key_"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)))
    kinds = (T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.LongType())
    schema = T.StructType([*(T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema.fields)), *map(T.StructField, names, kinds)])
    return held.mapInArrow(run, schema).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)), *names)


def _occurrences(points: np.ndarray, mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the mark stands whole inside a text."""
    n = len(points) - len(mark) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(points[:n] == mark[0])
    for k in range(1, len(mark)):
        at = at[points[at + k] == mark[k]]
    return at[np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(mark) - 1, "right")]


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that was transformed, from its output and form alone."""
    pieces = F.split(output, "|".join(f"\\Q{s}\\E" for s in sentinels), -1)  # what stands before the first sentinel is empty
    first, second, third = pieces[1], pieces[2], pieces[3]
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut at lines; digests of the output and of the text rebuilt from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = fill_in_middle(docs, added="")
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
