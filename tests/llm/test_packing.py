from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from auditlake.llm.packing import best_fit, best_fit_counts, cut, pack
from auditlake.llm.tokenizing import PieceTokenizer
from helpers import crc_ids


@cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def check(rows, texts, capacity=2048):
    """rows against plain tokenisation: pieces whole, in place, gapless sequences."""
    coder = library("byte_bpe_50k.json")
    wanted = defaultdict(int)
    for doc_id, text in texts:
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity or capacity
        starts = [0, *range(head, len(ids), capacity)]
        for k, start in enumerate(starts):
            part = ids[start : starts[k + 1] if k + 1 < len(starts) else None]
            wanted[doc_id, k, start, len(part), crc_ids(part)] += 1
    found = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        found[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert found == wanted
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(documents, texts):
    n = check(pack(documents).collect(), texts.items())
    total = sum(r.length for r in pack(documents).collect())
    assert n <= -(-total // 2048) * 1.02 + 1


def test_edges(edge_docs, no_docs):
    check(pack(edge_docs).collect(), [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert pack(no_docs).collect() == []


def test_rounds_over_many_partitions(documents, texts, monkeypatch):
    from auditlake.llm import packing

    monkeypatch.setattr(packing, "FAN_IN", 2)
    check(pack(documents.repartition(9)).collect(), texts.items())


def test_ids_of_pieces(edge_docs):
    for r in pack(edge_docs, with_ids=True).collect():
        assert crc_ids(np.frombuffer(r.ids, "<u4")) == r.ids_crc32


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=50, deadline=None)
def test_best_fit_takes_the_tightest_bin(lengths):
    bins, offsets = best_fit(np.array(lengths, np.int64), 64)
    free: dict[int, int] = {}
    for length, b, offset in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        fitting = [f for f in free.values() if f >= length]
        assert (b in free) == bool(fitting)
        if fitting:
            assert free[b] == min(fitting)
        assert offset == 64 - free.get(b, 64)
        free[b] = free.get(b, 64) - length


def test_cut_puts_the_remainder_first():
    doc, piece, start, length = cut(np.array([5, 2048, 2049, 5000]), 2048)
    assert length.tolist() == [5, 2048, 1, 2048, 904, 2048, 2048]
    assert start.tolist() == [0, 0, 0, 1, 0, 904, 2952]


_ALPHABET = " \n\t'sstmdreveLl 12é!ñ. %ÉAa'' \r中¿́"


_PARTS = st.one_of(st.text(_ALPHABET, max_size=40), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "|>"]))


@given(st.lists(st.lists(_PARTS, max_size=4).map("".join), max_size=20))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = _CODERS.setdefault(name, PieceTokenizer(name))
        ids, offsets = own.encode(texts)
        plain = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == plain


_CODERS: dict = {}


def test_added_tokens_are_the_librarys(spark):
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|startoftext|> x", "plain text"]
    check(pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), enumerate(texts))
    assert PieceTokenizer("byte_bpe_50k.json").encode(texts[:1])[0].tolist() == [64, 50256, 65]


def test_pieces_that_share_a_hash(monkeypatch):
    """Hashes of two values only: every piece is compared with the known one, and the library decides."""
    from auditlake.llm import tokenizing

    monkeypatch.setattr(tokenizing, "mix", lambda x: x & np.uint64(1))
    own = PieceTokenizer("byte_bpe_50k.json")
    texts = ["some words that share a hash", "a b c d e f", "other words"]
    for _ in range(2):
        ids, offsets = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bins_that_fill_one_another_meet(spark, monkeypatch):
    """Bins of two pieces, of which each has one mate: every pair fills a sequence, and no bin is divided."""
    from auditlake.llm import packing

    monkeypatch.setattr(packing, "RANK_PARTS", 3)
    fills = [100 + 7 * k for k in range(120)]
    bins = list(enumerate([*fills, *(2048 - f for f in fills), *fills, *(2048 - f for f in fills)]))
    rows = [(b, at, n, b) for b, f in bins for at, n in ((0, f // 2), (f // 2, f - f // 2))]
    opened = spark.createDataFrame(rows, "sequence_id long, offset long, length long, was long").repartition(9)
    found = defaultdict(list)
    for r in packing._root(opened, 2048, len(bins), 2).collect():
        found[r.sequence_id].append((r.offset, r.length, r.was))
    assert len(found) == 240
    for places in found.values():
        places.sort()
        assert [p[0] for p in places] == [0, *np.cumsum([p[1] for p in places])[:-1].tolist()] and sum(p[1] for p in places) == 2048
        assert places[0][2] == places[1][2] != places[2][2] == places[3][2]


@given(st.lists(st.integers(1, 64), max_size=300))
@settings(max_examples=100, deadline=None)
def test_best_fit_of_counts_is_that_of_the_items(sizes):
    """As many bins as best fit of the items one by one, and every item in a place of its own."""
    fills = sorted(set(sizes))
    slots, made = best_fit_counts(fills, [sizes.count(f) for f in fills], 64)
    used = defaultdict(list)
    for fill in fills:
        own = sorted(zip(*(slots[k][slots["fill"] == fill].tolist() for k in ("low", "first", "base")), strict=True))
        for rank in range(sizes.count(fill)):
            low, first, base = max(s for s in own if s[0] <= rank)
            used[first + rank - low].append((base, fill))
    bins, _ = best_fit(np.array(sorted(sizes, reverse=True), np.int64), 64)
    assert len(used) == made == len(set(bins.tolist()))
    for places in used.values():
        at = 0
        for base, fill in sorted(places):
            assert base == at
            at += fill
        assert at <= 64


def test_rows_of_a_merging_task_are_bounded(documents, texts, monkeypatch):
    from auditlake.llm import packing

    monkeypatch.setattr(packing, "MERGE_ROWS", 40)
    check(pack(documents.repartition(12)).collect(), texts.items())


def test_many_open_bins_end(documents, texts, monkeypatch):
    from auditlake.llm import packing

    monkeypatch.setattr(packing, "MERGE_ITEMS", 4)
    check(pack(documents.repartition(12)).collect(), texts.items())
