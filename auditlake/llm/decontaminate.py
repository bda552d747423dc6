"""Operator 3, benchmark decontamination with suffix arrays of the training text.

Method: each shard (a bounded run of whole documents of a partition) gets a suffix array over
its words. Words are numbered by the benchmark's own vocabulary, in hash order; a word outside
it is 0 and ends every match. Suffixes that begin with such a word cannot match and are left
out. Every suffix of every benchmark item is binary-searched in the array, and its neighbours
there give its longest verbatim match, of any length. A window occurs if the longest match of a
suffix that begins with it has the window's length; the interval of suffixes that share it gives
the occurrences. Words inside an occurrence are hit; a document with `20 * n_hit >= n_words` is
contaminated and is removed by `decontaminate`.

The longest match of a document is the longest one that begins with a whole window; of equally
long ones the first in the document, then the least item id (as a string), then the first in
the item.

The benchmark is held in blocks of at most BLOCK_BYTES of text; each block is one pass over
the documents without a shuffle. At most CHAINED passes run in one task; what they found is then
written and read again, so that no task holds the indexes of more blocks.

Defined results: null and empty texts have no words and are clean; items without words match
nothing; repeated rows are judged one by one; an empty benchmark marks nothing; item ids are
compared as strings; extra columns are kept by `decontaminate`, and names may clash freely
since working columns get a prefix that no column has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, materialise, text_chunks, tune
from .textops import ALNUM, LOWER, Words, buffers, covered, prefix, ragged, rows_of

WINDOW = 13
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 1 << 20
#: Blocks that one task holds at once.
CHAINED = 2
_NO_LIMIT = np.iinfo(np.int64).max


class SuffixArray:
    """Suffix array over word numbers; 0 ends a match. Ranks are refined by prefix doubling."""

    def __init__(self, ids: np.ndarray, bits: int):
        n = len(ids)
        self.ids, self.bits, self.per = ids, bits, max(1, 63 // bits)
        padded = np.concatenate([ids, np.zeros(self.per, np.int64)])
        # the first `per` words as one number, cut after the first 0
        self.keys, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.per):
            word = np.where(alive, padded[k : k + n], 0)
            self.keys = (self.keys << bits) | word
            alive &= word != 0
        at = np.flatnonzero(ids)
        order = at[np.argsort(self.keys[at], kind="stable")]
        rank = np.zeros(n + 1, np.int64)  # 0 for a suffix that begins with 0
        ordered = self.keys[order]
        heads = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
        rank[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1] + 1
        step = self.per
        # a tied suffix that ended within the step has rank 0 after it: ties of ended ones stay
        while len(order):
            sizes = np.diff(np.append(np.flatnonzero(heads), len(order)))
            open_slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
            if not len(open_slots):
                break
            tied = order[open_slots]
            ended = padded_zero(ids, tied, step)
            second = np.where(ended, 0, rank[np.minimum(tied + step, n)])
            if not second.any():
                break
            first = rank[tied]
            again = np.lexsort((second, first))
            tied, first, second = tied[again], first[again], second[again]
            order[open_slots] = tied
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            if (new == heads[open_slots]).all():
                break
            heads[open_slots] = new
            rank[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1] + 1
            step *= 2
        self.order = order

    def words(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th packed key of the suffixes at the places."""
        place = at + k * self.per
        inside = place < len(self.ids)
        return np.where(inside, self.keys[np.minimum(place, len(self.ids) - 1)], 0)

    def against(self, at: np.ndarray, other: SuffixArray, places: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sign of the suffixes at `at` less other's at `places`, words in common), both within `limit` words.

        A suffix ends at its first 0 and is then less than a longer one.
        """
        sign, common = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, k = np.arange(len(at)), 0
        while len(live):
            a, b = self.words(at[live], k), other.words(places[live], k)
            left = np.clip(limit[live] - k * self.per, 0, self.per)
            drop = (self.per - left) * self.bits
            a, b = a >> drop, b >> drop
            sign[live] = np.sign(a - b)
            a, b = a << drop, b << drop
            same, shared = np.ones(len(live), bool), np.zeros(len(live), np.int64)
            for j in range(self.per):
                shift = (self.per - 1 - j) * self.bits
                same &= ((a >> shift) == (b >> shift)) & ((a >> shift) & ((1 << self.bits) - 1) != 0)
                shared += same
            common[live] += shared
            live = live[same & (sign[live] == 0) & (left == self.per)]
            k += 1
        return sign, common

    def search(self, other: SuffixArray, places: np.ndarray, limit: np.ndarray | None = None, upper: bool = False) -> np.ndarray:
        """First place in the order whose suffix, within `limit` words, is not less (upper: is greater) than other's."""
        limit = np.full(len(places), _NO_LIMIT) if limit is None else limit
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.order), np.int64)
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live]) // 2
            sign, _ = self.against(self.order[middle], other, places[live], limit[live])
            right = sign <= 0 if upper else sign < 0
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]

    def longest(self, other: SuffixArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place) of the longest match of other's suffixes at `places` with any suffix here."""
        best, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        if len(self.order):
            low, limit = self.search(other, places), np.full(len(places), _NO_LIMIT)
            for near in (low, low - 1):
                inside = np.flatnonzero((near >= 0) & (near < len(self.order)))
                at = self.order[near[inside]]
                _, common = self.against(at, other, places[inside], limit[inside])
                better = common > best[inside]
                best[inside[better]], where[inside[better]] = common[better], at[better]
        return best, where


def padded_zero(ids: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Whether a suffix has a 0 within its first `step` words (or the text ends there)."""
    zeros = np.flatnonzero(ids == 0)
    following = np.append(zeros, len(ids))[np.searchsorted(zeros, at)]
    return following < at + step


class Benchmark:
    """The index of one block of items: vocabulary, distinct windows and their items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        column = pa.array([text for _, text in items], pa.string())
        data, offsets = buffers(column)
        data = LOWER[data]
        words = Words(data, offsets, ALNUM)
        hashes = words.hashes(data)
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(hashes)
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per = max(1, 63 // self.bits)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        # a small filter of the vocabulary's hashes answers most lookups
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.vocabulary >> np.uint64(44)] = True
        counts = self.counts = words.counts
        short = np.minimum(counts, window)
        starts = ragged(words.offsets[:-1], np.where(counts > 0, counts - short + 1, 0))
        owner = rows_of(np.where(counts > 0, counts - short + 1, 0))
        length = short[owner]
        wide = np.zeros((len(starts), window), np.int64)
        for k in range(window):
            inside = k < length
            wide[inside, k] = ids[starts[inside] + k]
        rows, first, inverse = np.unique(wide, axis=0, return_index=True, return_inverse=True) if len(wide) else (wide, owner, owner)
        inverse = np.asarray(inverse).reshape(-1)
        self.lengths = (rows != 0).sum(axis=1)
        pairs = np.unique(np.stack([inverse, owner], axis=1), axis=0) if len(wide) else np.zeros((0, 2), np.int64)
        self.item_offsets = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.items = pairs[:, 1]
        # the items one after the other, a 0 after each, and all their suffixes
        self.begins = words.offsets[:-1] + np.arange(len(counts))
        apart = np.zeros(len(ids) + len(counts), np.int64)
        apart[ragged(self.begins, counts)] = ids
        self.array = SuffixArray(apart, self.bits)
        self.item = np.repeat(np.arange(len(counts)), counts + 1)
        self.windows = (starts + owner)[first]  # a place of each distinct window
        self.rank = np.argsort(np.argsort(np.array(self.names, object), kind="stable"), kind="stable") if self.names else np.zeros(0, np.int64)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, hashes[maybe])
        at = np.minimum(at, max(len(self.vocabulary) - 1, 0))
        same = self.vocabulary[at] == hashes[maybe] if len(self.vocabulary) else np.zeros(len(maybe), bool)
        ids[maybe[same]] = at[same] + 1
        return ids


class Shard:
    """Documents of one shard, numbered by a block's vocabulary, with their suffix array."""

    def __init__(self, column: pa.Array, block: Benchmark):
        data, offsets = buffers(column)
        data = LOWER[data]
        self.words = Words(data, offsets, ALNUM)
        flat = block.number(self.words.hashes(data))
        # a 0 after each document keeps matches inside it
        self.counts = self.words.counts
        self.begins = self.words.offsets[:-1] + np.arange(len(self.counts))
        ids = np.zeros(len(flat) + len(self.counts), np.int64)
        ids[ragged(self.begins, self.counts)] = flat
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts + 1)
        self.array = SuffixArray(ids, block.bits)

    def longest(self, block: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """(words, place) of the longest match of every item suffix, by its place in the block."""
        length, place = np.zeros(len(block.array.ids), np.int64), np.zeros(len(block.array.ids), np.int64)
        length[block.array.order], place[block.array.order] = self.array.longest(block.array, block.array.order)
        return length, place

    def occurrences(self, block: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of a window of the block."""
        length, _ = self.longest(block)
        found = np.flatnonzero(length[block.windows] >= block.lengths)
        queries, limit = block.windows[found], block.lengths[found]
        low = self.array.search(block.array, queries, limit)
        high = self.array.search(block.array, queries, limit, upper=True)
        sizes = high - low
        return self.array.order[ragged(low, sizes)], found[rows_of(sizes)]

    def longest_of_documents(self, block: Benchmark, place: np.ndarray, window: np.ndarray, width: int) -> list[tuple[int, int, int, str, int]]:
        """(document, words, its word, item, the item's word) of each document's longest match that begins with a window."""
        at, inverse = np.unique(place, return_inverse=True)
        if not len(at):
            return []
        words = np.zeros(len(at), np.int64)
        np.maximum.at(words, inverse, block.lengths[window])
        whole, _ = block.array.longest(self.array, at)
        words = np.where(words == width, whole, words)  # an item shorter than the width is matched whole
        doc = self.doc[at]
        order = np.lexsort((at, -words, doc))
        order = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        at, words, doc = at[order], words[order], doc[order]
        low = block.array.search(self.array, at, words)
        high = block.array.search(self.array, at, words, upper=True)
        out = []
        for k in range(len(at)):
            there = block.array.order[low[k] : high[k]]
            if words[k] < width:  # of the suffixes that begin so, the whole items
                own = block.item[there]
                there = there[(there == block.begins[own]) & (block.counts[own] == words[k])]
            item = block.item[there]
            first = there[np.lexsort((there - block.begins[item], block.rank[item]))[0]]
            own = block.item[first]
            out.append((int(doc[k]), int(words[k]), int(at[k] - self.begins[doc[k]]), block.names[own], int(first - block.begins[own])))
        return out


def read_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items as (id, text), in blocks of at most `most` bytes of text; a small benchmark is read at once."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length(F.coalesce("i", F.lit(""))))).first()[0] or 0
    rows = items.collect() if size <= most else materialise(items, "benchmark").toLocalIterator(prefetchPartitions=True)
    block, size, any_left = [], 0, True
    for row in rows:
        if block and size + len(row.t) > most:
            yield block
            block, size = [], 0
        block.append((row.i or "", row.t))
        size, any_left = size + len(row.t), False
    if block or any_left:
        yield block  # an empty benchmark is one empty block


def _mark(batches: Iterator[pa.RecordBatch], shared, window: int, column: str, prefix: str, last: bool) -> Iterator[pa.RecordBatch]:
    block = shared.value
    for batch in text_chunks(batches, column, SHARD_BYTES):
        shard = Shard(batch.column(column), block)
        place, which = shard.occurrences(block)
        hit = covered(place, block.lengths[which], len(shard.array.ids))
        earlier = batch.column(f"{prefix}hits").to_pylist()
        names = batch.column(f"{prefix}items").to_pylist()
        best = batch.column(f"{prefix}best").to_pylist()
        for doc, words, at, item, item_at in shard.longest_of_documents(block, place, which, window):
            new = {"words": words, "at": at, "item": item, "item_at": item_at}
            best[doc] = min((x for x in (best[doc], new) if x), key=lambda x: (-x["words"], x["at"], x["item"], x["item_at"]))
        pairs = np.unique(np.stack([shard.doc[place], which], axis=1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
        sizes = block.item_offsets[pairs[:, 1] + 1] - block.item_offsets[pairs[:, 1]] if len(pairs) else np.zeros(0, np.int64)
        found = np.stack([np.repeat(pairs[:, 0], sizes), block.items[ragged(block.item_offsets[pairs[:, 1]], sizes)]], axis=1) if len(pairs) else np.zeros((0, 2), np.int64)
        for doc, item in np.unique(found, axis=0).tolist():
            names[doc] = (names[doc] or []) + [block.names[item]]
        bits = []
        any_hit = np.zeros(len(batch), bool)
        any_hit[np.unique(shard.doc[hit])] = True
        for doc, (begin, n, old) in enumerate(zip(shard.begins.tolist(), shard.counts.tolist(), earlier, strict=True)):
            if not any_hit[doc]:
                bits.append(old)
                continue
            own = np.packbits(hit[begin : begin + n])
            bits.append((own | np.frombuffer(old, np.uint8)).tobytes() if old else own.tobytes())
        columns = {n: batch.column(n) for n in batch.schema.names} | {
            f"{prefix}hits": pa.array(bits, pa.binary()),
            f"{prefix}items": pa.array(names, pa.list_(pa.string())),
            f"{prefix}best": pa.array(best, batch.schema.field(f"{prefix}best").type),
            f"{prefix}words": pa.array(shard.counts, pa.int64()),
        }
        out = pa.RecordBatch.from_arrays([columns[n] for n in batch.schema.names], names=batch.schema.names)
        yield _digest(out, prefix) if last else out


def _digest(batch: pa.RecordBatch, prefix: str) -> pa.RecordBatch:
    items = [sorted(x or []) for x in batch.column(f"{prefix}items").to_pylist()]
    hits = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) if b else 0 for b in batch.column(f"{prefix}hits").to_pylist()]
    out = {n: batch.column(n) for n in batch.schema.names if n != f"{prefix}hits"}
    out |= {
        f"{prefix}hit": pa.array(hits, pa.int64()),
        f"{prefix}n_items": pa.array([len(x) for x in items], pa.int64()),
        f"{prefix}sha": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
    }
    return pa.RecordBatch.from_pydict(out)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, column: str = "text", prefix: str = "_dc_") -> DataFrame:
    """docs with words, hit, n_items, sha, items and best (the longest match), each name after the prefix.

    No shuffle, one pass a block.
    """
    spark = tune(docs.sparkSession)
    state = [(f"{prefix}hits", "binary"), (f"{prefix}items", "array<string>"), (f"{prefix}words", "long"), (f"{prefix}best", "struct<words:long,at:long,item:string,item_at:long>")]
    marked = docs.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in state))
    schema = marked.schema
    final = T.StructType([f for f in schema.fields if f.name != f"{prefix}hits"])
    final = final.add(f"{prefix}hit", "long").add(f"{prefix}n_items", "long").add(f"{prefix}sha", "string")
    blocks = read_blocks(benchmark)
    items, chained = next(blocks), 0
    while items is not None:
        following = next(blocks, None)
        if chained == CHAINED:
            marked, chained = materialise(marked, "marked"), 0
        chained += 1
        shared = spark.sparkContext.broadcast(Benchmark(items, window))

        def step(batches, shared=shared, last=following is None):
            return _mark(batches, shared, window, column, prefix, last)

        marked = marked.mapInArrow(step, final if following is None else schema)
        items = following
    return marked


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the longest match.

    longest_match: its words, 0 without one; longest_at: its first word in the document; longest_item and
    longest_item_at: the item and the first word there.
    """
    prefix = "_dc_"
    marked = mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, prefix=prefix)
    return marked.select(
        "doc_id",
        F.col(f"{prefix}words").alias("n_words"),
        F.col(f"{prefix}hit").alias("n_hit"),
        F.col(f"{prefix}n_items").alias("n_items"),
        F.col(f"{prefix}sha").alias("items_sha256"),
        _contaminated(prefix).alias("contaminated"),
        F.coalesce(F.col(f"{prefix}best.words"), F.lit(0)).cast("long").alias("longest_match"),
        F.col(f"{prefix}best.at").alias("longest_at"),
        F.col(f"{prefix}best.item").alias("longest_item"),
        F.col(f"{prefix}best.item_at").alias("longest_item_at"),
    )


def _contaminated(prefix: str):
    return (F.col(f"{prefix}hit") > 0) & (20 * F.col(f"{prefix}hit") >= F.col(f"{prefix}words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, whose text is not contaminated."""
    prefix = free_prefix("_dc_", docs.columns)
    return mark(docs, benchmark, window, prefix=prefix).filter(~_contaminated(prefix)).select(*docs.columns)


def _matches(batches: Iterator[pa.RecordBatch], shared, least: int) -> Iterator[pa.RecordBatch]:
    block = shared.value
    for batch in text_chunks(batches, "text", SHARD_BYTES):
        shard = Shard(batch.column("text"), block)
        length, place = shard.longest(block)
        at = np.flatnonzero(length >= least)
        doc = shard.doc[place[at]] if len(at) else np.zeros(0, np.int64)
        item = block.item[at] if len(at) else doc
        yield pa.RecordBatch.from_pydict({
            "item_id": pa.array([block.names[i] for i in item.tolist()], pa.string()),
            "item_word": pa.array(at - block.begins[item], pa.int64()),
            "length": pa.array(length[at], pa.int64()),
            "doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())),
            "doc_word": pa.array(place[at] - shard.begins[doc], pa.int64()),
        })


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW) -> DataFrame:
    """For every item suffix: the longest verbatim match over all shards and one place of it.

    Returns item_id, item_word, length, doc_id, doc_word; suffixes whose longest match is
    shorter than `least` words are left out.
    """
    spark = tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in read_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Benchmark(items, WINDOW))

        def step(batches, shared=shared):
            return _matches(batches, shared, least)

        part = source.mapInArrow(step, "item_id string, item_word long, length long, doc_id long, doc_word long")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("length", F.negative("doc_id").alias("d"), F.negative("doc_word").alias("w"))).alias("b")
    return found.groupBy("item_id", "item_word").agg(best).select(
        "item_id", "item_word", "b.length", F.negative("b.d").alias("doc_id"), F.negative("b.w").alias("doc_word")
    )


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
