"""Operator 11, phrase collocations: suffix automata per shard, counts reduced over all shards.

Method: a shard is a run of whole texts of one language (about SHARD_BYTES). Its words are numbered
exactly (a dictionary of their bytes), and a generalised suffix automaton of bounded depth is built
over its pieces: states are classes of word sequences with the same end positions, each with its
endpos count, longest and shortest length and suffix link. Enumerating the states gives every
sequence up to the depth with its count in the shard. Counts are then added over all shards.

A sequence reaches the least count only if all its words and all its neighbouring pairs do. So one
pass counts words, a second adds up hashed pairs of frequent words, and the third names the
sequences whose pairs may all be frequent. Both filters are bit maps over hashes, which let too
much pass and never too little; the counts that decide are those of the third pass, whose keys are
the phrases themselves. Subsumption follows the links: a phrase lies inside a longer candidate as
frequent as asked only if one that is longer by one word (its suffix link, or the same at the other
end) is, since counts fall with the length.

Scores are exact: the product is a decimal of 38 digits, divided with the fraction cut off.

Defined results: a null or empty text has no words; a null language is `und`; repeated rows count
as often as they stand; an empty table gives no rows; ties go by count, then by the phrase's bytes;
extra columns are not read. Memory: a task holds one shard, or one longer text, about 60 times its
bytes; the bit maps have 16 bits a frequent key, MOST_BITS at most (beyond that they let more pass).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialise, text_chunks, tune
from .textops import LOWER, Words, buffers, mix, prefix, rows_of, span_hashes

LEAST = 30
MOST_WORDS = 4
KEEP_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
SHARD_BYTES = 6 << 20
MOST_BITS = 1 << 28

#: Bytes of `[.,;:!?\x0A-\x0D]`, which end a piece, and of words, `[^\x20\x09]+` within pieces.
BREAK = np.zeros(256, bool)
BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
IN_WORD = ~BREAK
IN_WORD[[0x20, 0x09]] = False


class Automaton:
    """The states of the generalised suffix automaton of id sequences, up to a depth.

    reach[i] is the number of ids of one sequence that end at place i, itself included (0: place i
    takes no part). The suffix links form the tree of the reversed contexts, which is built level by
    level: a node of level k is a node of level k - 1 and the id before it. Nodes on an unbranched
    path, whose counts are equal, are one state.
    """

    def __init__(self, ids: np.ndarray, reach: np.ndarray, depth: int):
        width = int(ids.max(initial=0)) + 1
        node, above = ids.astype(np.int64), None
        self.count, self.end, self.length, self.shortest, self.link = [], [], [], [], []
        base = 0  # number of the first node of the level above
        for k in range(1, depth + 1):
            places = np.flatnonzero(reach >= k)
            if not len(places):
                break
            keys = node[places] if k == 1 else node[places] * width + ids[places - k + 1]
            order = np.argsort(keys)
            ordered = keys[order]
            heads = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            first = np.flatnonzero(heads)
            count, end = np.diff(np.append(first, len(order))), places[order[first]]
            if k == 1:
                parent, same = np.full(len(first), -1), np.zeros(len(first), bool)
                shortest = np.ones(len(first), np.int64)
            else:
                parent = node[end]
                same = count == above[0][parent]
                shortest = np.where(same, above[1][parent], k)
                self.count[-1][parent[same]] *= -1  # not the longest of its state
                parent = parent + base
                base += len(above[0])
            self.count.append(count.copy())
            self.end.append(end)
            self.length.append(np.full(len(first), k))
            self.shortest.append(shortest)
            self.link.append(parent)
            above = (count, shortest)
            new = np.empty(len(order), np.int64)
            new[order] = np.cumsum(heads) - 1
            node = np.full(len(ids), -1)
            node[places] = new
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        count, self.end, self.length, self.shortest, self.link = map(joined, (self.count, self.end, self.length, self.shortest, self.link))
        self.longest = np.flatnonzero(count > 0)  # one node for each state
        self.count = np.abs(count)

    def sequences(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(end place, count) of every distinct sequence of the length: the states that hold one."""
        of = self.longest[(self.length[self.longest] >= length) & (self.shortest[self.longest] <= length)]
        return self.end[of], self.count[of]


class Shard:
    """Words of texts of one language: their ids, distinct words, and whether each continues the piece of the one before."""

    def __init__(self, lang: str, texts: pa.Array):
        data, offsets = buffers(texts)
        data = LOWER[data]
        words = Words(data, offsets, IN_WORD)
        letters = data[IN_WORD[data]]
        spans = prefix(words.ends - words.starts)
        encoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(spans), pa.py_buffer(letters)]).dictionary_encode()
        self.lang, self.ids, self.words = lang, encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        piece = np.cumsum(BREAK[data], dtype=np.int64)[words.starts] + rows_of(words.counts)  # grows where a break or a text's end stands between
        self.joined = np.zeros(len(self.ids), bool)
        self.joined[1:] = piece[1:] == piece[:-1]
        letters, spans = buffers(self.words)
        seed = mix(span_hashes(name := np.frombuffer(lang.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(name)])))
        self.hashes = mix(span_hashes(letters, spans[:-1], spans[1:]) + seed) if len(self.words) else np.zeros(0, np.uint64)

    def pair_hashes(self, ends: np.ndarray) -> np.ndarray:
        """Hashes of the words before and at each place."""
        return mix(self.hashes[self.ids[ends - 1]] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.ids[ends]])

    def phrases(self, ends: np.ndarray, length: int) -> pa.Array:
        columns = [self.words.take(pa.array(self.ids[ends - k])).cast(pa.string()) for k in range(length - 1, -1, -1)]
        return pc.binary_join_element_wise(*columns, " ") if length > 1 else columns[0]


def shards(batches: Iterator[pa.RecordBatch], limit: int = SHARD_BYTES) -> Iterator[Shard]:
    """The shards of a partition of (text, lang)."""
    held, size = [], 0
    for batch in text_chunks(batches):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= limit:
            yield from _by_language(held)
            held, size = [], 0
    if held:
        yield from _by_language(held)
    give_back()


def _by_language(batches: list[pa.RecordBatch]) -> Iterator[Shard]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    langs = pc.fill_null(rows.column("lang"), "und").combine_chunks().dictionary_encode()
    codes = langs.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(langs.dictionary) + 1))
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        texts = rows.column("text").take(pa.array(order[bounds[k] : bounds[k + 1]])).combine_chunks()
        for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
            yield Shard(lang, part)


def _bits(keys: DataFrame) -> tuple[Broadcast, int]:
    """A bit map over the column key of a stored table, built on the executors; its size follows their number up to MOST_BITS."""
    spark, bits = keys.sparkSession, 1 << 15
    wanted = 16 * keys.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.pmod("key", F.lit(bits))
    parts = keys.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("map"))
    table = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        table[row.part * 4096 : (row.part + 1) * 4096] = np.frombuffer(bytes(row.map), np.uint8)
    return spark.sparkContext.broadcast(table), bits


def _test(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(bits - 1)  # as pmod of the signed value, bits being a power of two
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, word, key, n): counts of each word; the row of word null counts all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            n = np.bincount(shard.ids, minlength=len(shard.words))
            words = pa.concat_arrays([shard.words.cast(pa.string()), pa.nulls(1, pa.string())])
            keys = np.append(shard.hashes.view(np.int64), 0)
            yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(keys)), words, pa.array(keys), pa.array(np.append(n, len(shard.ids)))], ["lang", "word", "key", "n"])

    return texts.mapInArrow(run, "lang string, word string, key long, n long").groupBy("lang", "word").agg(F.max("key").alias("key"), F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, frequent: tuple[Broadcast, int]) -> DataFrame:
    """(key, n): counts of the pairs of words that may be frequent, by hash."""
    shared, bits = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            known = _test(shared.value, bits, shard.hashes)[shard.ids]
            reach = known.astype(np.int64)
            reach[1:] += known[1:] & known[:-1] & shard.joined[1:]
            ends, n = Automaton(shard.ids, reach, 2).sequences(2)
            yield pa.RecordBatch.from_arrays([pa.array(shard.pair_hashes(ends).view(np.int64)), pa.array(n)], ["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def count_phrases(texts: DataFrame, frequent: tuple[Broadcast, int], most_words: int) -> DataFrame:
    """(lang, phrase, words, n): counts of the phrases of 2 words or more whose pairs may all be frequent."""
    shared, bits = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            ends = np.flatnonzero(shard.joined)
            ends = ends[_test(shared.value, bits, shard.pair_hashes(ends))]
            reach = np.zeros(len(shard.ids), np.int64)
            reach[ends] = reach[ends - 1] = 1
            reach[ends] = 2
            for k in range(3, most_words + 1):
                ends = ends[reach[ends - 1] == k - 1]
                reach[ends] = k
            automaton = Automaton(shard.ids, reach, most_words)
            for k in range(2, most_words + 1):
                ends, n = automaton.sequences(k)
                if len(ends):
                    yield pa.RecordBatch.from_arrays([pa.array([shard.lang] * len(ends)), shard.phrases(ends, k), pa.array(np.full(len(ends), k, np.int32)), pa.array(n)], ["lang", "phrase", "words", "n"])

    return texts.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, keep_percent: int = KEEP_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    words = materialise(count_words(texts).filter(F.col("word").isNull() | (F.col("n") >= least)), "words")
    named = words.filter("word is not null")
    pairs = materialise(count_pairs(texts, _bits(named)).filter(F.col("n") >= least).select("key"), "pairs")
    found = materialise(count_phrases(texts, _bits(pairs), most_words).filter(F.col("n") >= least), "phrases")
    # every cut of a candidate: both parts are frequent too, and so are named
    counts = named.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    cut = lambda begin, size: F.array_join(F.slice(F.split("phrase", " "), begin, size), " ")
    sides = (
        found.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .select("*", F.explode(F.array(F.struct(F.lit(True).alias("left"), cut(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), cut(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("side"))
        .select("lang", "phrase", "a", "k", "side.left", "side.part")
    )
    cuts = sides.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr(f"(cast(a as decimal(20, 0)) * cast({SCALE} as decimal(8, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # links: a candidate without its first or its last word
    inner = found.filter("words > 2").select("lang", "n", F.explode(F.array(cut(F.lit(2), F.col("words") - 1), cut(F.lit(1), F.col("words") - 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    rest = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < keep_percent * F.col("a").cast("decimal(20,0)")))
    ranked = rest.select("*", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")).alias("rank")).filter(F.col("rank") <= top)
    totals = words.filter("word is null").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
