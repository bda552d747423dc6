"""Operator 5, language identification by prediction by partial matching (PPM).

Method: for each language a context tree over bytes, with contexts of 0 to ORDER bytes and the
escape probabilities of method C with exclusion. The counts are frozen after training, so that
a text's exact code length under each language is a sum of table entries; the shortest code
names the language. All trees share one node table: a node is a context, and holds, for every
language and next symbol, the code length with all escapes already resolved.

Training takes whole labelled texts, about SAMPLE_BYTES of them per language (of all languages
together at most ALL_BYTES), drawn by a hash of language and text: repeated texts count once, and
each language has at least the text with its smallest hash, however long its texts are. The bounds
are parameters. Contexts of the highest order seen fewer than LEAST_CONTEXT times are not kept.
Prediction reads the text alone.

Text form: lower case; ASCII bytes that are not letters become a space, runs of spaces one.

Defined results: a null text, or one without a letter, gets `und` and score 0; a null lang is
not learned from; a null doc_id counts as the empty string in the fold, and such rows are drawn by their texts like any others; repeated rows get the
same result; without any labelled row every text is `und`; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_chunks, tune
from .textops import buffers, by_row, prefix, ragged

ORDER = 3
SAMPLE_BYTES = 1 << 20
#: Contexts of the highest order seen fewer times than this in all languages are left out.
LEAST_CONTEXT = 3
#: Bytes of texts, and of the code table, that the driver may hold.
ALL_BYTES = 128 << 20
TABLE_BYTES = 1 << 30
#: A text with a longer code than this, in bits a byte, is in no learned language.
MOST_BITS = 6.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of lower-case texts in the form that is scored, ORDER spaces before each."""
    data, offsets = buffers(column)
    data = np.where(_LETTER[data], data, np.uint8(0x20))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    blank = data == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    if len(keep):
        keep |= first[:-1]
    own = prefix(keep.astype(np.int64))[offsets]
    data = data[keep]
    sizes = np.diff(own)
    wide = np.concatenate([[0], np.cumsum(sizes + ORDER)])
    out = np.full(wide[-1], 0x20, np.uint8)
    out[ragged(wide[:-1] + ORDER, sizes)] = data
    return out, wide


class ContextTrees:
    """The languages' trees as tables: symbols, nodes by context, code lengths in bits."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        parts = {k: folded(pa.array([t.lower() for t in texts[k]], pa.string())) for k in self.languages}
        seen = np.unique(np.concatenate([p[0] for p in parts.values()] or [np.zeros(0, np.uint8)]))
        self.symbol = np.zeros(256, np.int64)  # 0: any byte not seen in training
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.size = size = len(seen) + 1
        grams: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for k in self.languages:
            data, offsets = parts[k]
            grams.append(self._count(self.symbol[data], offsets))
        n_languages = len(self.languages)
        # nodes: all contexts up to the highest order, shorter ones first
        contexts = [np.zeros(1, np.int64)]
        for order in range(1, ORDER + 1):
            keys = np.concatenate([g[order][0] // size for g in grams] or [np.zeros(0, np.int64)])
            weights = np.concatenate([g[order][1] for g in grams] or [np.zeros(0, np.int64)])
            distinct, inverse = np.unique(keys, return_inverse=True)
            total = np.bincount(inverse, weights, len(distinct))
            contexts.append(distinct[total >= LEAST_CONTEXT] if order == ORDER else distinct)
        bases = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
        if 8 * int(bases[-1]) * n_languages * size > TABLE_BYTES:
            raise ValueError(f"the code table of {n_languages} languages and {size} symbols is over TABLE_BYTES: train with fewer sample_bytes")
        chance = np.full((bases[-1], n_languages, size), 1.0 / size, np.float64)
        for order in range(ORDER + 1):
            at = slice(bases[order], bases[order + 1])
            if order == 0:
                low = np.full((1, n_languages, size), 1.0 / size)
            else:
                parent = contexts[order] % size ** (order - 1)
                low = chance[bases[order - 1] + np.searchsorted(contexts[order - 1], parent)]
            counts = np.zeros_like(low)
            for j, g in enumerate(grams):
                keys, number = g[order]
                context = keys // size
                place = np.minimum(np.searchsorted(contexts[order], context), len(contexts[order]) - 1) if len(contexts[order]) else np.zeros(0, np.int64)
                known = contexts[order][place] == context if len(contexts[order]) else np.zeros(len(keys), bool)
                if len(contexts[order]):
                    counts[place[known], j, keys[known] % size] = number[known]
            chance[at] = self._mixed(counts, low)
        bits = -np.log2(chance).transpose(0, 2, 1).astype(np.float32)
        self.bits = np.ascontiguousarray(bits).reshape(bits.shape[0] * bits.shape[1], n_languages)
        # each full context leads to its longest suffix that is a node
        self.node = np.zeros(size**ORDER, np.int32)
        grid = np.arange(size**ORDER)
        for order in range(1, ORDER + 1):
            tail = grid % size**order
            if len(contexts[order]):
                place = np.minimum(np.searchsorted(contexts[order], tail), len(contexts[order]) - 1)
                known = contexts[order][place] == tail
                self.node[known] = bases[order] + place[known]

    def _count(self, symbols: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        real = np.ones(len(symbols), bool)
        real[ragged(offsets[:-1], np.full(len(offsets) - 1, ORDER))] = False
        at = np.flatnonzero(real)
        keys = symbols[at].copy()
        out = {0: np.unique(keys, return_counts=True)}
        for order in range(1, ORDER + 1):
            keys = keys + symbols[at - order] * self.size**order
            out[order] = np.unique(keys, return_counts=True)
        return out

    @staticmethod
    def _mixed(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Method C: a seen symbol gets n/(t+d); the escape d/(t+d) goes to the unseen ones."""
        total, distinct = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        unseen = np.where(counts > 0, 0.0, low)
        rest = unseen.sum(-1, keepdims=True)
        whole = np.maximum(total + np.where(rest > 0, distinct, 0), 1)
        mixed = np.where(counts > 0, counts / whole, unseen * (distinct / whole) / np.maximum(rest, 1e-300))
        return np.where(total > 0, mixed, low)

    def code_lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits per language, bytes scored) of each lower-case text."""
        data, offsets = folded(column)
        symbols = self.symbol[data].astype(np.int32)
        n = len(symbols)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if n > ORDER and len(self.languages):
            context = np.zeros(n - ORDER, np.int32)
            for k in range(ORDER):
                context = context * self.size + symbols[k : n - ORDER + k]
            rows = self.node[context].astype(np.int64) * self.size + symbols[ORDER:]
            sums = np.zeros(n + 1)
            for j in range(len(self.languages)):
                np.cumsum(self.bits[rows, j], dtype=np.float64, out=sums[ORDER + 1 :])
                out[:, j] = sums[offsets[1:]] - sums[np.minimum(offsets[:-1] + ORDER, offsets[1:])]
        return out, np.diff(offsets) - ORDER


def fold(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def draw(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES, all_bytes: int = ALL_BYTES) -> DataFrame:
    """(lang, text): the distinct labelled texts that are learned from, as a table.

    A text is drawn if its hash is among the first sample_bytes / bytes of its language; of the drawn ones, those
    in the order of their hashes stay that begin within sample_bytes.
    """
    known = docs.filter("lang is not null and text is not null").select("lang", "text", F.shiftrightunsigned(F.xxhash64("lang", "text"), 1).alias("h"))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min("h").alias("least"))
    sizes = materialise(sizes.coalesce(1), "languages")
    languages = sizes.count()
    each = min(sample_bytes, all_bytes // max(languages, 1))
    share = sizes.select("lang", F.greatest(F.lit(2.0) * each / F.greatest("n", F.lit(1)) * float(1 << 63), F.col("least").cast("double")).alias("most"))
    share = F.broadcast(share) if languages <= 10_000 else share
    # twice the share, since what repeats counts once; copies of a drawn text meet by their hash, before the shuffle too
    drawn = known.join(share, "lang").filter(F.col("h").cast("double") <= F.col("most"))
    drawn = drawn.groupBy("lang", "h").agg(F.min("text").alias("text"))
    drawn = materialise(drawn, "drawn")
    order = Window.partitionBy("lang").orderBy("h")
    begins = drawn.select("lang", "h", F.octet_length("text").alias("size")).withColumn("begin", F.sum("size").over(order) - F.col("size"))
    return drawn.join(begins.filter(F.col("begin") < each).select("lang", "h"), ["lang", "h"]).select("lang", "text")


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> ContextTrees:
    """Trees from about sample_bytes of whole texts per language of docs (text, lang)."""
    texts: dict[str, list[str]] = {}
    for row in draw(docs, sample_bytes).collect():
        texts.setdefault(row.lang, []).append(row.text)
    return ContextTrees({k: sorted(v) for k, v in texts.items()})


def _predict(batches: Iterator[pa.RecordBatch], shared, prefix: str) -> Iterator[pa.RecordBatch]:
    trees = shared.value
    for batch in text_chunks(batches, f"{prefix}text"):
        bits, size = trees.code_lengths(batch.column(f"{prefix}text"))
        letters = np.array(pc.fill_null(batch.column(f"{prefix}letters"), False).to_pylist(), bool)
        out = {n: batch.column(n) for n in batch.schema.names if n not in (f"{prefix}text", f"{prefix}letters")}
        if trees.languages:
            best = bits.argmin(1)
            least = bits[np.arange(len(best)), best]
            score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
            names = np.array(trees.languages, object)[best]
            names[~letters] = "und"
            rate = np.where(letters, least / np.maximum(size, 1), 0.0)
        else:
            names, score, rate = np.full(len(size), "und", object), np.zeros(len(size)), np.zeros(len(size))
        out |= {
            f"{prefix}pred": pa.array(names.tolist(), pa.string()),
            f"{prefix}score": pa.array(np.where(letters, score, 0.0), pa.float64()),
            f"{prefix}bits": pa.array(rate, pa.float64()),
        }
        yield pa.RecordBatch.from_pydict(out)


def predict(docs: DataFrame, trees: ContextTrees, keep: list[str], prefix: str = "_lg_") -> DataFrame:
    """Columns `keep` of docs, with prefix + pred, score and bits (a byte). No shuffle."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast(trees)
    source = docs.select(*keep, F.lower("text").alias(f"{prefix}text"), F.col("text").rlike(r"\p{L}").alias(f"{prefix}letters"))
    schema = docs.select(*keep).schema.add(f"{prefix}pred", "string").add(f"{prefix}score", "double").add(f"{prefix}bits", "double")

    def step(batches):
        return _predict(batches, shared, prefix)

    return source.mapInArrow(step, schema)


def accepted(pred: DataFrame, prefix: str = "_lg_"):
    """A text passes unless it is `und`, undecided, or like none of the learned languages."""
    return (pred[f"{prefix}pred"] != "und") & (pred[f"{prefix}score"] >= 0.5) & (pred[f"{prefix}bits"] <= MOST_BITS)


def identify(docs: DataFrame, folds: int = 3, held: int = 1, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    remainder = fold(F.col("doc_id"), folds)
    trees = train(docs.filter(remainder != held), sample_bytes)
    pred = predict(docs, trees, ["doc_id"])
    names = {"_lg_pred": "lang_pred", "_lg_score": "score", "_lg_bits": "bits_per_byte"}
    return pred.select("doc_id", (remainder == held).alias("held_out"), *(F.col(a).alias(b) for a, b in names.items()))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
