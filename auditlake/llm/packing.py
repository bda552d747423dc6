"""Operator 1, best-fit packing of tokenised documents into sequences of fixed capacity.

Method: hierarchical residual packing. Each partition tokenises its documents and packs the
pieces by best fit, longest first. Bins that are nearly full are emitted. The others become the
items of the next round, in which fewer partitions, each fed by several earlier ones, pack bins
into bins by the same best fit. The root of the tree, reached when what is left would fit one task
or a round combines almost none, compares all open bins at once, however many there are: a bin
matters to best fit only by its fill, so the bins are a histogram of at most `capacity` numbers,
which is packed with multiplicities, and each bin finds its place by its rank among those of its
fill. Only the rows of open bins (a few numbers per piece) are shuffled; text and ids are not.

Defined results: a null or empty text is one piece with the end id alone; repeated rows and
repeated or null doc_ids are packed as rows of their own; an empty table gives no rows; extra
columns of the input are ignored. A document over the capacity is cut into pieces of exactly
the capacity, but for the first, which takes the remainder, so that only one piece of a
document ever has to be fitted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_chunks, tune
from .textops import prefix, ragged
from .tokenizing import load

COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: A bin with at most this share of its capacity free counts as nearly full.
NEARLY_FULL = 1 / 64
#: Pieces that a partition packs at once, and open bins and their pieces that a merging task may get.
LOCAL_ITEMS = 1 << 17
MERGE_ITEMS = 1 << 16
MERGE_ROWS = 1 << 21
FAN_IN = 8
#: Ranks of bins of one fill are taken in at least so many parts.
RANK_PARTS = 64


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit in the given order: (bin of each item, offset in it).

    Bins are kept by free space, and a bit mask of the free spaces in use finds the tightest fit
    in constant time.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for i, length in enumerate(lengths.tolist()):
        fitting = mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = by_space[free]
            b = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            b, free, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - free
        free -= length
        if free:
            if not by_space[free]:
                mask |= 1 << free
            by_space[free].append(b)
    return bins, offsets


def best_fit_counts(fills: list[int], counts: list[int], capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Best fit of counts[i] items of size fills[i], largest first: (slots, number of bins).

    A slot says that the items of one fill with ranks from `low` go to the bins from `first`, one each, at `base`.
    Items of a size are placed together in as many bins as are alike, so the work and the number of slots grow with
    the number of different fills, not with that of the items.
    """
    by_space: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    slots: list[tuple[int, int, int, int]] = []
    mask = made = 0
    for fill, left in sorted(zip(fills, counts, strict=True), reverse=True):
        rank = 0
        while left:
            fitting = mask >> fill
            if fitting:
                free = fill + (fitting & -fitting).bit_length() - 1
                first, n = by_space[free].pop()
                take = min(left, n)
                if n > take:
                    by_space[free].append((first + take, n - take))
                elif not by_space[free]:
                    mask ^= 1 << free
            else:
                free, first, take = capacity, made, max(1, left // (capacity // fill))
                made += take
            slots.append((fill, rank, first, capacity - free))
            if free > fill:
                by_space[free - fill].append((first, take))
                mask |= 1 << (free - fill)
            rank, left = rank + take, left - take
    return dict(zip(("fill", "low", "first", "base"), np.array(slots, np.int64).reshape(-1, 4).T, strict=True)), made


def cut(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's index, piece, start, length) of the pieces of documents with so many ids."""
    pieces = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), pieces)
    piece = ragged(np.zeros(len(counts), np.int64), pieces)
    head = counts - (pieces - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    length = np.where(piece == 0, head[doc], capacity)
    return doc, piece, start, length


class _Emitter:
    def __init__(self, level: int, capacity: int):
        context = TaskContext.get()
        self.base = (level << 56) | ((context.partitionId() if context else 0) << 28)
        self.capacity, self.made = capacity, 0

    def emit(self, columns: dict[str, np.ndarray], group: np.ndarray, within: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        """columns: of the pieces; group: a piece's item; within: its place in the item; sizes: of the items."""
        order = np.lexsort((np.arange(len(sizes)), -sizes))
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bins[order], offsets[order] = best_fit(sizes[order], self.capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)
        closed = self.capacity - fill <= self.capacity * NEARLY_FULL
        names = self.base + self.made + np.arange(len(fill))
        self.made += len(fill)
        of = bins[group]
        return pa.RecordBatch.from_pydict(
            columns | {"sequence_id": names[of], "offset": offsets[group] + within, "closed": closed[of]}
        )


def _tokenise(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[dict]:
    coder = load(tokenizer)
    for batch in text_chunks(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids, offsets = coder.encode(texts)
        counts = np.diff(offsets) + 1
        full = np.full(len(ids) + len(texts), end_id, "<u4")
        full[ragged(prefix(counts)[:-1], counts - 1)] = ids
        doc, piece, start, length = cut(counts, capacity)
        at = prefix(counts)[:-1][doc] + start
        raw = full.view(np.uint8).data
        spans = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
        out = {
            "doc_id": batch.column("doc_id").take(pa.array(doc)),
            "piece": piece.astype(np.int32),
            "start": start,
            "length": length,
            "ids_crc32": np.array([zlib.crc32(x) for x in spans], np.int64),
        }
        yield out | ({"ids": pa.array([bytes(x) for x in spans], pa.binary())} if with_ids else {})


def _first_round(batches, tokenizer, capacity, end_id, with_ids):
    emitter, held, rows = _Emitter(1, capacity), [], 0

    def flush():
        columns = {k: pa.concat_arrays([pa.array(h[k]) if isinstance(h[k], np.ndarray) else _flat(h[k]) for h in held]) for k in held[0]}
        n = len(columns["length"])
        return emitter.emit(columns, np.arange(n), np.zeros(n, np.int64), columns["length"].to_numpy())

    for part in _tokenise(batches, tokenizer, capacity, end_id, with_ids):
        held.append(part)
        rows += len(part["length"])
        if rows >= LOCAL_ITEMS:
            yield flush()
            held, rows = [], 0
    if rows:
        yield flush()


def _flat(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _merge_round(batches, level, capacity):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
    names = table["sequence_id"].to_numpy()
    first = np.concatenate([[True], names[1:] != names[:-1]])
    group = np.cumsum(first) - 1
    sizes = np.bincount(group, table["length"].to_numpy()).astype(np.int64)
    columns = {k: _flat(table[k]) for k in table.column_names if k not in ("sequence_id", "offset", "closed")}
    yield _Emitter(level, capacity).emit(columns, group, table["offset"].to_numpy(), sizes)


def _place(batches: Iterator[pa.RecordBatch], shared, level: int) -> Iterator[pa.RecordBatch]:
    slots = shared.value
    order = np.lexsort((slots["low"], slots["fill"]))
    fill, low, first, base = (slots[k][order] for k in ("fill", "low", "first", "base"))
    keys = (fill << 44) | low
    for batch in batches:
        rank = batch.column("rank").to_numpy()
        at = np.searchsorted(keys, (batch.column("fill").to_numpy() << 44) | rank, "right") - 1
        names = (level << 56) | (first[at] + rank - low[at])
        yield pa.RecordBatch.from_pydict({"sequence_id": batch.column("sequence_id"), "name": names, "base": base[at]})


def _root(opened: DataFrame, capacity: int, n_bins: int, level: int) -> DataFrame:
    """opened with the sequences that best fit over all its bins gives; at most `capacity` rows reach the driver."""
    bins = materialise(opened.groupBy("sequence_id").agg(F.sum("length").alias("fill")), "bins")
    histogram = bins.groupBy("fill").count().collect()
    slots, _ = best_fit_counts([r.fill for r in histogram], [r["count"] for r in histogram], capacity)
    shared = opened.sparkSession.sparkContext.broadcast(slots)
    # the rank of a bin among those of its fill: bins in earlier parts of the fill, then its place in its own part
    part = F.pmod(F.xxhash64("sequence_id"), F.lit(max(RANK_PARTS, -(-n_bins // MERGE_ITEMS)))).alias("part")
    parted = bins.select("sequence_id", "fill", part)
    cells = parted.groupBy("fill", "part").agg(F.count("*").alias("n"))
    before = cells.select("fill", "part", (F.sum("n").over(Window.partitionBy("fill").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("fill", "part").orderBy("sequence_id")) - 1
    ranked = parted.withColumn("own", own).join(before, ["fill", "part"]).select("sequence_id", "fill", (F.col("before") + F.col("own")).cast("long").alias("rank"))

    def place(batches):
        return _place(batches, shared, level)

    placed = ranked.mapInArrow(place, "sequence_id long, name long, base long")
    moved = opened.join(placed, "sequence_id").withColumn("offset", F.col("offset") + F.col("base")).withColumn("sequence_id", F.col("name"))
    return moved.select(opened.columns)


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and place; with_ids adds their ids (binary, <u4)."""
    spark = tune(docs.sparkSession)
    schema = COLUMNS + (", ids binary" if with_ids else "") + ", closed boolean"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset", "closed"]
    schema = ", ".join(dict(zip([x.split()[0] for x in schema.split(", ")], schema.split(", "), strict=True))[n] for n in names)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def first(batches):
        return _first_round(batches, tokenizer, capacity, end_id, with_ids)

    table = materialise(source.mapInArrow(first, schema), "packed")
    results = [table.filter("closed")]
    parts, before, level = None, None, 1
    while True:
        opened = table.filter("not closed")
        bins, rows, sources = opened.agg(F.count_if(F.col("offset") == 0), F.count("*"), F.countDistinct(F.shiftright("sequence_id", 28))).first()
        if not bins:
            break
        level += 1
        parts = max(-(-(parts or sources) // FAN_IN), -(-bins // MERGE_ITEMS), -(-rows // MERGE_ROWS), 1)
        if parts == 1 or before is not None and bins > 0.99 * before:
            results.append(materialise(_root(opened, capacity, bins, level), "packed"))
            break

        def merge(batches, level=level):
            return _merge_round(batches, level, capacity)

        table = materialise(opened.repartition(parts, "sequence_id").mapInArrow(merge, schema), "packed")
        results.append(table.filter("closed"))
        before = bins
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
