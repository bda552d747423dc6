"""Operator 6, quality rules as a short-circuit cascade.

Method: each rule's cost (seconds a megabyte) and selectivity (share rejected) are estimated on
a bounded sample; rules then run in descending order of rejection per cost, each only on the
texts that all earlier rules have passed. A text is kept if no rule rejects it, so the order
decides the cost and never the verdict.

The base figures (words, symbols, repeated lines, repeated 8-word windows) are computed for
every whole text in one vectorised pass over the bytes of an Arrow batch.

Defined results: a null or empty text has no words and fails the base; repeated rows get equal
results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tune
from .textops import NON_SPACE, Words, buffers, by_row, covered, mix, rows_of, span_hashes, window_hashes

#: Texts of the estimate, and bytes of one of them at most.
SAMPLE_ROWS = 500
SAMPLE_TEXT = 1 << 16
REPEAT_WIDTH = 8

_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ASCII_LETTER = _UPPER.copy()
_ASCII_LETTER[0x61:0x7B] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[0x80:] = True


class Texts:
    """A batch of texts, its words and base figures; `take` gives some of them for later rules."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    @property
    def words(self) -> Words:
        if not hasattr(self, "_words"):
            self._words = Words(self.data, self.offsets, NON_SPACE)
        return self._words

    def take(self, rows: np.ndarray) -> Texts:
        if len(rows) == len(self.offsets) - 1:
            return self
        spans = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in rows.tolist()]
        sizes = np.array([len(s) for s in spans], np.int64)
        return Texts(np.concatenate(spans) if spans else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text's index) of the lines."""
        n = len(self.data)
        breaks = np.flatnonzero(self.data == 0x0A)
        first = self.offsets[:-1]
        starts = np.concatenate([first, breaks + 1])
        row = np.concatenate([np.arange(len(first)), np.searchsorted(self.offsets, breaks, "right") - 1])
        order = np.lexsort((starts, row))
        starts, row = starts[order], row[order]
        ends = np.full(len(starts), n)
        ends[:-1] = starts[1:] - 1
        last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
        ends[last] = self.offsets[1:][row[last]]
        return starts, ends, row

    def base(self) -> dict[str, np.ndarray]:
        data, words = self.data, self.words
        inside = NON_SPACE[data]
        hashes = words.hashes(data)
        at, windows = window_hashes(hashes, words.offsets, REPEAT_WIDTH)
        row = rows_of(words.counts)
        twice = at[_repeated(windows, row[at])]
        starts, ends, line_row = self.lines()
        has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        starts, ends, line_row = starts[has_word], ends[has_word], line_row[has_word]
        again = _repeated(span_hashes(data, starts, ends), line_row, after_first=True)
        n = len(self.offsets) - 1
        return {
            "n_words": words.counts.astype(np.int64),
            "word_chars": by_row(inside & ~_CONTINUES[data], self.offsets),
            "n_symbols": by_row(_SYMBOL[data], self.offsets),
            "n_dup_lines": np.bincount(line_row[again], minlength=n).astype(np.int64),
            "n_repeat_words": by_row(covered(twice, REPEAT_WIDTH, len(hashes)), words.offsets),
            "n_lines": np.bincount(line_row, minlength=n).astype(np.int64),
        }


def _repeated(hashes: np.ndarray, rows: np.ndarray, after_first: bool = False) -> np.ndarray:
    """Which values occur twice or more in their row; after_first leaves out the first of each."""
    keys = mix(hashes + rows.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if not after_first:
        out[order[:-1][same]] = True
    return out


@dataclass(frozen=True)
class Rule:
    """Rejects where its test holds. The test gets the texts left and their base figures."""

    name: str
    test: Callable[[Texts, dict[str, np.ndarray]], np.ndarray]


def _symbols(texts: Texts, base: dict) -> np.ndarray:
    return 10 * base["n_symbols"] > 3 * base["n_words"]


def _word_length(texts: Texts, base: dict) -> np.ndarray:
    return (base["word_chars"] < 2 * base["n_words"]) | (base["word_chars"] > 14 * base["n_words"])


def _repeated_lines(texts: Texts, base: dict) -> np.ndarray:
    return 10 * base["n_dup_lines"] > 3 * base["n_lines"]


def _shouting(texts: Texts, base: dict) -> np.ndarray:
    """Over three tenths of the ASCII letters are capitals."""
    upper, letters = by_row(_UPPER[texts.data], texts.offsets), by_row(_ASCII_LETTER[texts.data], texts.offsets)
    return 10 * upper > 3 * letters


def _wordless(texts: Texts, base: dict) -> np.ndarray:
    """Under seven tenths of the words have a letter."""
    words = texts.words
    letters = np.concatenate([[0], np.cumsum(_LETTER[texts.data], dtype=np.int64)])
    spelled = by_row(letters[words.ends] > letters[words.starts], words.offsets)
    return 10 * spelled < 7 * words.counts


def _exclaimed(texts: Texts, base: dict) -> np.ndarray:
    """Over three tenths of the words end in an exclamation mark."""
    words = texts.words
    return 10 * by_row(texts.data[words.ends - 1] == 0x21, words.offsets) > 3 * words.counts


RULES = (
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("repeated_lines", _repeated_lines),
    Rule("shouting", _shouting),
    Rule("wordless", _wordless),
    Rule("exclaimed", _exclaimed),
)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])


def estimate(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a megabyte, share rejected) on sample texts, all rules on all of them."""
    data, offsets = buffers(pa.array(texts, pa.string()))
    if not len(texts):
        return [(r.name, 1.0, 0.0) for r in rules]
    base, out = Texts(data, offsets).base(), []
    for rule in rules:
        fresh = Texts(data, offsets)
        began = time.perf_counter()
        share = float(rule.test(fresh, base).mean())
        out.append((rule.name, (time.perf_counter() - began) / max(len(data) / 1e6, 1e-6), share))
    return out


def order_rules(figures: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in figures}
    return tuple(sorted(rules, key=lambda r: (-worth[r.name], r.name)))


def cascade(texts: Texts, base: dict[str, np.ndarray], rules: tuple[Rule, ...]) -> np.ndarray:
    """Name of the first rule that rejects each text, or None; each rule sees what is left."""
    verdict = np.full(len(texts.offsets) - 1, None, object)
    left = np.flatnonzero(~base_failed(base))
    verdict[base_failed(base)] = "base"
    for rule in rules:
        if not len(left):
            break
        out = rule.test(texts.take(left), {k: v[left] for k, v in base.items()})
        verdict[left[out]] = rule.name
        left = left[~out]
    return verdict


def _judge(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], keep: list[str], prefix: str) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, f"{prefix}text"):
        texts = Texts(*buffers(batch.column(f"{prefix}text")))
        base = texts.base()
        verdict = cascade(texts, base, rules)
        out = {n: batch.column(n) for n in keep}
        out |= {f"{prefix}{k}": pa.array(base[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        out |= {f"{prefix}base_failed": pa.array(base_failed(base)), f"{prefix}rule": pa.array(verdict.tolist(), pa.string())}
        yield pa.RecordBatch.from_pydict(out)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_TEXT) -> list[str]:
    """At most `rows` texts of at most `longest` bytes for the estimate alone; no verdict depends on them.

    Every eighth row or so is taken, and partitions are read only until there are enough.
    """
    fit = docs.select("text").filter(F.octet_length("text") <= longest)
    return [r.text for r in fit.filter(F.rand(7) < 0.125).take(rows)]


def judge(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] | None = None, prefix: str = "_q_") -> DataFrame:
    """Columns `keep` of docs with base figures, and `rule`: what rejects the text, or null; names get the prefix."""
    spark = tune(docs.sparkSession)
    rules = rules or order_rules(estimate(sample(docs)))
    schema = docs.select(*keep).schema
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(f"{prefix}{name}", "long")
    schema = schema.add(f"{prefix}base_failed", "boolean").add(f"{prefix}rule", "string")

    def step(batches):
        return _judge(batches, rules, keep, prefix)

    return docs.select(*keep, F.col("text").alias(f"{prefix}text")).mapInArrow(step, schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *(F.col(f"_q_{n}").alias(n) for n in names), F.col("_q_rule").isNull().alias("kept"))
