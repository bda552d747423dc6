"""Operator 10, language-model scores of a hidden Markov model.

Method: Baum-Welch. The expected counts of starts, transitions and emissions are summed over
all training documents, partition by partition; the driver only normalises them. Scores come
from the scaled forward recursion, which gives the exact likelihood of the whole sequence.

Words are counted over all training documents. Every word seen LEAST_NAMED times or more is emitted
by name, so the emission statistics grow with the corpus; any other word is emitted through its class
(a hash of its last two bytes), and its probability inside the class comes from its own count. Counts
of the named words and of the most frequent LOOKUP words are broadcast; the counts of all rarer words
reach their documents by a join, so that no count is left out. The model (STATES numbers a named
word) is broadcast and normalised on the driver: both hold it whole. Training begins at a fixed model (Model.seeded); every round covers
all training documents, and rounds go on until one raises the likelihood by less than TOLERANCE of
itself. Training sequences are cut every CUT tokens; scored ones never are.

Defined results: a null text counts as empty and has the end token alone; a null doc_id counts
as the empty string in the fold; repeated rows are scored one by one; an empty table gives no
rows; without training text all probability is the smoothing's; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, table_partitions, text_chunks, tune
from .language import fold
from .textops import LOWER, NON_SPACE, Words, buffers, by_row, mix, prefix, ragged, rows_of

STATES = 8
LEAST_NAMED = 4
LOOKUP = 500_000
CLASSES = 256
TOLERANCE = 1e-4
CUT = 512
END = int(mix(np.array([0x5EED], np.uint64)).view(np.int64)[0])
SMOOTH = 0.1
#: Share of the unigram distribution in every state's emissions.
UNIGRAM = 0.05
_BLOCK = 1024
#: Tasks whose sums meet first; then the sums of these groups meet.
_GROUP = 64
#: Bytes of ids that advance in lockstep.
EXPECT_BYTES = 1 << 22
SCORE_BYTES = 1 << 20


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, classes, offsets) of the tokens of each text, with its end."""
    data, offsets = buffers(column)
    data = LOWER[data]
    words = Words(data, offsets, NON_SPACE)
    last = data[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - 2 >= words.starts, data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    counts = words.counts
    own = prefix(counts + 1)
    at = ragged(own[:-1], counts)
    hashes, classes = np.full(own[-1], END, np.int64), np.zeros(own[-1], np.int64)
    hashes[at] = words.hashes(data).view(np.int64)
    classes[at] = (mix((before << np.uint64(8)) | last) % np.uint64(CLASSES)).astype(np.int64)
    return hashes, classes, own


class _Tally:
    """Counts of distinct words: (hashes, classes, counts), sorted by hash."""

    def __init__(self):
        self.held, self.size, self.least = [], 0, 1 << 18

    def add(self, hashes: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((hashes, classes, counts))
        self.size += len(hashes)
        if self.size > self.least:
            self.held = [self.merged()]
            self.size = len(self.held[0][0])
            self.least = max(1 << 18, 2 * self.size)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, classes, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts[order], first) if len(first) else counts
        return hashes[first], classes[order[first]], counts


def _count(batches: Iterator[pa.RecordBatch], bits: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Words of a partition in blocks by the leading bits of their hashes; blocks, not words, are shuffled."""
    tally = _Tally()

    def blocks():
        hashes, classes, counts = tally.merged()
        raw = np.rec.fromarrays([hashes, classes.astype(np.int32), counts], dtype=_COUNTED)
        edges = np.searchsorted(hashes >> (64 - bits), np.arange(-(1 << bits - 1), (1 << bits - 1) + 1))
        some = np.flatnonzero(np.diff(edges))
        return pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int32()), "words": pa.array([raw[edges[k] : edges[k + 1]].tobytes() for k in some.tolist()], pa.binary())})

    for batch in text_chunks(batches, limit=1 << 20):
        hashes, classes, _ = token_hashes(batch.column("text"))
        distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        tally.add(distinct, classes[first], counts)
        if tally.size > most and len(tally.held) == 1:
            yield blocks()
            tally = _Tally()
    if tally.held:
        yield blocks()


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: the totals of each block's words."""
    name, tally = None, _Tally()

    def rows():
        hashes, classes, counts = tally.merged()
        return pa.RecordBatch.from_pydict({"h": pa.array(hashes), "s": pa.array(classes, pa.int32()), "c": pa.array(counts)})

    for batch in batches:
        for block, words in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
            if block != name and tally.held:
                yield rows()
                tally = _Tally()
            name, found = block, np.frombuffer(words.as_buffer(), _COUNTED)
            tally.add(found["h"], found["s"], found["c"])
    if tally.held:
        yield rows()


_COUNTED = np.dtype([("h", "<i8"), ("s", "<i4"), ("c", "<i8")])


class Counts:
    """What every worker needs: counts of frequent words, totals by class."""

    def __init__(self, hashes, counts, classes, total: int, distinct: int, class_total, class_distinct, least: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        rank = np.lexsort((hashes, -counts))
        rank = rank[counts[rank] >= least]
        number = np.full(len(hashes), -1, np.int64)
        number[rank] = np.arange(len(rank))
        self.number = number[order].astype(np.int32)
        self.place = None
        self.total, self.distinct = total, distinct
        self.words = len(rank)
        # what is left for the classes once the named words are taken out
        self.class_total = class_total - np.bincount(classes[rank], counts[rank], CLASSES)
        self.class_distinct = class_distinct - np.bincount(classes[rank], minlength=CLASSES)
        self.inner = np.log10(self.class_total + SMOOTH * (self.class_distinct + 1))
        self.whole = np.log10(total + SMOOTH * (distinct + 1))
        mass = np.concatenate([counts[rank], self.class_total]) + SMOOTH
        self.unigram = (mass / mass.sum()).astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the known hashes, whether it is there): by the leading bits, then step by step."""
        if self.place is None:  # made by each worker
            self.logs = np.log10(self.counts + SMOOTH)
            bits = max(1, len(self.hashes).bit_length())
            self.shift = 64 - bits
            self.place = np.searchsorted(self.hashes >> self.shift, np.arange(-(1 << bits - 1), (1 << bits - 1) + 1)).astype(np.int32)
            self.least = 1 << bits - 1
        slot = (hashes >> self.shift) + self.least
        at, end = self.place[slot], self.place[slot + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            live = live[self.hashes[at[live]] < hashes[live]]
            at[live] += 1
            live = live[at[live] < end[live]]
        at = np.minimum(at, len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def encode(self, hashes: np.ndarray, classes: np.ndarray):
        """(ids, log10(count+smooth) or 0, known, whether the count has to be joined)."""
        ids = self.words + classes
        if not len(self.hashes):
            return ids, np.zeros(len(ids)), np.zeros(len(ids), bool), np.ones(len(ids), bool)
        at, found = self.find(hashes)
        named = found & (self.number[at] >= 0)
        ids = np.where(named, self.number[at], ids)
        logs = np.where(found, self.logs[at], 0.0)
        return ids, logs, found, ~found


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    counts: Counts = shared.value
    part, made = TaskContext.get().partitionId(), 0
    for batch in text_chunks(batches):
        hashes, classes, offsets = token_hashes(batch.column("text"))
        ids, logs, known, rare = counts.encode(hashes, classes)
        n = len(batch)
        sizes = np.diff(offsets)
        inside = np.where(ids >= counts.words, logs - counts.inner[classes], 0.0)
        raw = ids.astype("<u4").view(np.uint8).data
        rare_counts = by_row(rare, offsets)
        yield pa.RecordBatch.from_pydict({
            "uid": pa.array((part << 33) + made + np.arange(n), pa.int64()),
            "doc_id": batch.column("doc_id"),
            "held_out": batch.column("held_out"),
            "n_tokens": pa.array(sizes, pa.int64()),
            "ids": pa.array([raw[4 * a : 4 * b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()),
            "known": pa.array(by_row(known, offsets), pa.int64()),
            "base": pa.array(np.diff(prefix(logs)[offsets]) - sizes * counts.whole, pa.float64()),
            "inner": pa.array(np.diff(prefix(inside)[offsets]), pa.float64()),
            "rare": pa.ListArray.from_arrays(pa.array(prefix(rare_counts), pa.int32()), pa.array(hashes[rare], pa.int64())),
        })
        made += n


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)  # emit: (ids, states)

    @staticmethod
    def seeded(unigram: np.ndarray, states: int) -> Model:
        emit = np.random.default_rng(7).standard_gamma(2.0, (len(unigram), states), np.float32)
        emit *= unigram[:, None]
        emit /= emit.sum(0, dtype=np.float64)
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit.astype(np.float32))

    @staticmethod
    def normalised(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Model:
        """The model of the expected counts; takes emit over."""
        start = start + 1e-2
        move = move + 1e-2
        emit += unigram[:, None]
        emit *= ((1 - UNIGRAM) / emit.sum(0, dtype=np.float64)).astype(emit.dtype)
        emit += UNIGRAM * unigram[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit.astype(np.float32, copy=False))


class Lockstep:
    """Places of the tokens when all sequences advance together, the longest first.

    Step t holds live[t] tokens at places edges[t] to edges[t + 1]; a step's sequences are the first
    ones of the step before, so that every step is a contiguous run. `at` is a place's token.
    """

    def __init__(self, offsets: np.ndarray):
        sizes = np.diff(offsets)
        self.order = np.argsort(-sizes, kind="stable")
        sizes = sizes[self.order]
        live = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        edges = prefix(live)
        place = np.arange(edges[-1])
        place -= np.repeat(edges[:-1], live)  # now the rank of the place's sequence
        self.at = offsets[:-1][self.order][place]
        self.at += rows_of(live)
        self.live, self.edges = live.tolist(), edges.tolist()

    def runs(self):
        """(step, its first place, the place after it)."""
        return zip(range(len(self.live)), self.edges[:-1], self.edges[1:], strict=True)


def emissions(model: Model, ids: np.ndarray, out: np.ndarray) -> np.ndarray:
    """out, states by places, with each place's emission probabilities: one gather a state, which costs less than rows of all states."""
    ids = ids.astype(np.intp, copy=False)
    for row, of_state in zip(out, np.ascontiguousarray(model.emit.T, out.dtype), strict=True):
        np.take(of_state, ids, out=row, mode="clip")  # with a mode, nothing is buffered
    return out


def log_likelihood(model: Model, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural logarithm of each sequence's likelihood by the scaled forward recursion."""
    steps = Lockstep(offsets)
    emitted = emissions(model, ids[steps.at], np.empty((len(model.start), len(ids))))
    scales, one = np.ones(len(ids)), np.ones(len(model.start))
    alpha, move = emitted, np.ascontiguousarray(model.move.T)
    for t, a, b in steps.runs():
        alpha = emitted[:, a:b] * (move @ alpha[:, : b - a] if t else model.start[:, None])
        scale = one @ alpha
        alpha /= scale
        scales[a:b] = scale
    logs = np.empty(len(ids))
    logs[steps.at] = np.log(scales)
    return np.diff(prefix(logs)[offsets])


def expected_counts(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, transitions and emissions of the sequences."""
    emitted = Emitted(*model.emit.shape)
    start, moves, _ = expectations(model, ids, offsets, emitted)
    return start, moves, emitted.rows(np.arange(len(model.emit)))


class Emitted:
    """Sums by id of posteriors, places by states.

    Single numbers are added in place, two states as one complex number, which halves the accesses. The
    first ids, the most frequent words, are carried over to doubles every PIECE places, so that no long
    sum of singles loses digits.
    """

    HEAD, PIECE = 4096, 1 << 16

    def __init__(self, n: int, states: int):
        self.single, double = (np.complex64, np.complex128) if states % 2 == 0 else (np.float32, np.float64)
        self.sums = np.zeros((states // 2 if states % 2 == 0 else states, n), self.single)
        self.head, self.touched = np.zeros((len(self.sums), min(n, self.HEAD)), double), np.zeros(n, bool)

    def add(self, ids: np.ndarray, gamma: np.ndarray) -> None:
        self.touched[ids] = True
        gamma, first = gamma.view(self.single), self.sums[:, : self.head.shape[1]]
        for a in range(0, len(ids), self.PIECE):
            own = ids[a : a + self.PIECE]
            for sums, values in zip(self.sums, gamma[a : a + self.PIECE].T, strict=True):
                np.add.at(sums, own, values)
            self.head += first
            first[:] = 0

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The sums of the ids at (ascending), ids by states."""
        out = np.stack([sums[at] for sums in self.sums], axis=1)
        known = at[: np.searchsorted(at, self.head.shape[1])]
        out[: len(known)] = self.head[:, known].T
        return out.view(np.float32)


class Room:
    """Two arrays of places by states that calls of expectations share: fresh memory costs as much as the sums."""

    def __init__(self, states: int):
        self.states, self.whole = states, np.empty((2, 0), np.float32)

    def arrays(self, n: int) -> np.ndarray:
        if n * self.states > self.whole.shape[1]:
            self.whole = np.empty((2, n * self.states * 9 // 8), np.float32)
        return self.whole[:, : n * self.states].reshape(2, n, self.states)


def expectations(model: Model, ids: np.ndarray, offsets: np.ndarray, sums: Emitted, room: Room | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The expected starts and transitions, and the natural logarithm of the sequences' likelihood under model; emissions are added to sums.

    A place's states stand side by side: a word's emissions are read, and its posteriors added, as one run of memory.
    """
    steps, states = Lockstep(offsets), len(model.start)
    ids = ids.astype(np.intp, copy=False)[steps.at]
    emitted, alphas = (room or Room(states)).arrays(len(ids))
    np.take(model.emit.astype(np.float32, copy=False), ids, axis=0, out=emitted, mode="clip")  # with a mode, nothing is buffered
    scales, ones = np.empty(len(ids), np.float32), np.ones((states, states), np.float32)
    move, first = model.move.astype(np.float32), model.start.astype(np.float32)
    alpha, back = emitted, np.ascontiguousarray(move.T)
    for t, a, b in steps.runs():
        now, own = alphas[a:b], emitted[a:b]
        np.multiply(own, alpha[: b - a] @ move if t else first, out=now)
        scale = now @ ones  # the sum of a place, beside each of its states
        now /= scale
        own /= scale
        scales[a:b], alpha = scale[:, 0], now
    moves = np.zeros((states, states))
    beta = following = emitted[:0]
    for _, a, b in reversed(list(steps.runs())):
        now, n = alphas[a:b], len(following)
        following[: len(beta)] *= beta
        moves += now[:n].T @ following
        beta = following @ back
        now[:n] *= beta  # from here on the posterior of the states
        following = emitted[a:b]
    start = alphas[: steps.live[0]].sum(0, dtype=np.float64) if steps.live else np.zeros(states)
    sums.add(ids, alphas)
    return start, moves * model.move, float(np.log(scales, dtype=np.float64).sum())


class _Numbers:
    """Numbers the ids that occur from 0, in their order."""

    def __init__(self, n: int):
        self.number, self.n = np.zeros(n, np.int32), n

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.zeros(self.n, bool)
        seen[ids] = True
        own = np.flatnonzero(seen)
        self.number[own] = np.arange(len(own))
        return own, self.number[ids]


def _cut(offsets: np.ndarray, most: int) -> np.ndarray:
    """Offsets with each sequence cut into pieces of at most `most` tokens."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // most)
    starts = np.repeat(offsets[:-1], pieces) + most * ragged(np.zeros(len(sizes), np.int64), pieces)
    return np.append(starts, offsets[-1])


def _read_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = buffers(column)
    return np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), offsets // 4


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches of sequences put together until they hold `limit` bytes of ids, so that many advance together."""
    held, size = [], 0
    for batch in text_chunks(batches, "ids", limit):
        held.append(batch)
        size += batch.column("ids").nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _expect(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    start, moves, reached = np.zeros(len(model.start)), np.zeros_like(model.move), 0.0
    sums, room = Emitted(*model.emit.shape), Room(len(model.start))
    for table in _gathered(batches, EXPECT_BYTES):
        ids, offsets = _read_ids(table["ids"].chunk(0))
        one, two, three = expectations(model, ids, _cut(offsets, CUT), sums, room)
        start, moves, reached = start + one, moves + two, reached + three
    # block 0 holds the small sums; a block of words only those that occur here
    at = np.flatnonzero(sums.touched)
    edges = np.searchsorted(at, np.arange(0, len(sums.touched) + _BLOCK, _BLOCK))
    blocks = [(0, b"", np.concatenate([start, moves.ravel(), [reached]]).astype("<f8").tobytes())]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        own = at[edges[k] : edges[k + 1]]
        blocks.append((k + 1, (own - k * _BLOCK).astype("<u2").tobytes(), sums.rows(own).astype("<f4", copy=False).tobytes()))
        if len(blocks) == 256:
            yield _block_rows(blocks)
            blocks = []
    if blocks:
        yield _block_rows(blocks)


_BLOCK_SCHEMA = "block int, at binary, sums binary"


def _block_rows(blocks: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    block, at, sums = zip(*blocks, strict=True)
    return pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int32()), "at": pa.array(at, pa.binary()), "sums": pa.array(sums, pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, at, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "sums")), strict=True):
            if not block:
                part = np.frombuffer(raw, "<f8")
                sums[0] = sums[0] + part if 0 in sums else part
                continue
            if block not in sums:
                sums[block] = np.zeros((_BLOCK, STATES))
            own = np.frombuffer(at, "<u2")
            sums[block][own] += np.frombuffer(raw, "<f4").reshape(len(own), -1)
    blocks = []
    for block, total in sums.items():
        own = np.flatnonzero(total.any(axis=1)) if block else np.zeros(0, np.int64)
        blocks.append((block, own.astype("<u2").tobytes(), (total[own].astype("<f4") if block else total).tobytes()))
    if blocks:
        yield _block_rows(blocks)


def baum_welch(encoded: DataFrame, model: Model, unigram: np.ndarray) -> tuple[Model, float]:
    """One round over all rows of encoded (ids binary): the next model, and the log likelihood under `model`.

    Sums of blocks, not of whole models, meet.
    """
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def expect(batches):
        return _expect(batches, shared)

    parts = table_partitions(spark)
    sums = encoded.select("ids").mapInArrow(expect, _BLOCK_SCHEMA)
    if encoded.rdd.getNumPartitions() > _GROUP:  # else there is one group, whose sums are all
        sums = sums.select("*", F.floor(F.spark_partition_id() / _GROUP).alias("tasks"))
        sums = sums.repartition(parts, "block", "tasks").drop("tasks").mapInArrow(_add, _BLOCK_SCHEMA)
    sums = sums.repartition(parts, "block").mapInArrow(_add, _BLOCK_SCHEMA)
    k, small = len(model.start), None
    emitted = np.zeros(model.emit.shape, np.float32)
    for batch in sums.toArrow().to_batches():
        for block, at, raw in zip(*(batch.column(c) for c in ("block", "at", "sums")), strict=True):
            if block.as_py():
                place = np.frombuffer(at.as_buffer(), "<u2").astype(np.int64) + (block.as_py() - 1) * _BLOCK
                emitted[place] = np.frombuffer(raw.as_buffer(), "<f4").reshape(-1, k)
            else:
                small = np.frombuffer(raw.as_py(), "<f8")
    shared.destroy()
    if small is None:
        return model, 0.0
    return Model.normalised(small[:k], small[k:-1].reshape(k, k), emitted, unigram), float(small[-1])


def settled(before: float, now: float) -> bool:
    """Whether the last round raised the log likelihood by less than TOLERANCE of itself."""
    return now - before <= TOLERANCE * abs(now)


def train(encoded: DataFrame, unigram: np.ndarray) -> Model:
    """Baum-Welch over all rows of encoded, from the fixed start until the likelihood settles."""
    model, before = Model.seeded(unigram, STATES), -np.inf
    while True:
        model, now = baum_welch(encoded, model, unigram)
        release(encoded.sparkSession)
        if settled(before, now):
            return model
        before = now


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    numbers = _Numbers(len(model.emit))
    for table in _gathered(batches, SCORE_BYTES):
        ids, offsets = _read_ids(table["ids"].chunk(0))
        own, number = numbers.of(ids)
        logs = log_likelihood(Model(model.start, model.move, model.emit[own]), number, offsets) / np.log(10)
        out = {c: table[c].chunk(0) for c in ("uid", "doc_id", "held_out", "n_tokens", "known", "base", "rare_n")}
        yield pa.RecordBatch.from_pydict(out | {"score": pa.array(logs + table["inner"].to_numpy(), pa.float64())})


def count_words(docs: DataFrame) -> DataFrame:
    """(h, s, c): every distinct token of docs, its class and its count."""
    spark = tune(docs.sparkSession)
    parts = table_partitions(spark)
    bits = (4 * parts).bit_length()  # several blocks a task; a block's words, not its rows, are held

    def count(batches):
        return _count(batches, bits)

    found = docs.select("text").mapInArrow(count, "block int, words binary").repartition(parts, "block").sortWithinPartitions("block")
    return materialise(found.mapInArrow(_total, "h long, s int, c long"), "counts")


def gather(counts: DataFrame, named: int = LEAST_NAMED, lookup: int = LOOKUP) -> Counts:
    """What is broadcast of the counts: all words seen `named` times, the `lookup` most frequent ones, class totals."""
    least = 1
    histogram = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    taken = 0
    for c, n in histogram:
        if taken + n > lookup:
            least = c + 1
            break
        taken += n
    rows = counts.filter(F.col("c") >= min(least, named)).select("h", "c", "s").toArrow()
    by_class = {r.s: (r.c, r.n) for r in counts.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    class_total = np.array([by_class.get(s, (0, 0))[0] for s in range(CLASSES)], np.float64)
    class_distinct = np.array([by_class.get(s, (0, 0))[1] for s in range(CLASSES)], np.float64)
    return Counts(
        *(rows[x].to_numpy().astype(np.int64) for x in ("h", "c", "s")),
        int(class_total.sum()), int(class_distinct.sum()), class_total, class_distinct, named,
    )


def score(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = tune(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held).alias("held_out"), "text")
    counts = count_words(source.filter("not held_out"))
    known = gather(counts)
    unigram, known.unigram = known.unigram, None  # of no use to the workers
    shared = spark.sparkContext.broadcast(known)

    def encode(batches):
        return _encode(batches, shared)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, ids binary, known long, base double, inner double, rare array<long>"
    encoded = materialise(source.mapInArrow(encode, schema.replace("inner", "`inner`")), "encoded")
    shared.destroy()
    total = known.total
    del known, shared
    final = spark.sparkContext.broadcast(train(encoded.filter("not held_out"), unigram))

    def forward(batches):
        return _score(batches, final)

    rows = encoded.select("uid", "doc_id", "held_out", "n_tokens", "ids", "known", "base", "inner", F.size("rare").cast("long").alias("rare_n"))
    scored = rows.mapInArrow(forward, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare_n long, score double")
    # words beyond the broadcast ones: their counts come by a join
    tail = encoded.filter(F.size("rare") > 0).select("uid", F.explode("rare").alias("h"))
    found = tail.join(counts.select("h", "c").hint("shuffle_hash"), "h", "left")
    logs = found.groupBy("uid").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("tail_logs"), F.count("c").alias("tail_known")
    )
    joined = scored.join(logs, "uid", "left")
    extra = F.coalesce("tail_logs", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
