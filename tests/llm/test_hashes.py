"""Words that a polynomial hash modulo 2^64 cannot tell apart, and capitals that lower-case out of the tables."""

from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import jaccard, quality, scoring, textops
from auditlake.llm.tokenizing import LIMIT, PieceTokenizer
from helpers import jaccard_components, quality_base
from test_decontaminate import check as check_contamination
from test_packing import library
from test_scoring import check as check_scores


def twins(size=1024):
    """The Thue-Morse word over a and b, and the word with both letters exchanged."""
    a = "a"
    while len(a) < size:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


ONE, TWO = twins()
REST = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees"


def test_spans_are_told_apart():
    for size in (1, 2, 63, 64, 65, 300, 1024, 4096):
        a, b = twins(size)
        data = np.frombuffer(f"{a[:size]} {b[:size]} {a[:size]}".encode(), np.uint8)
        starts = np.array([0, size + 1, 2 * size + 2])
        h = textops.span_hashes(data, starts, starts + size)
        assert h[0] == h[2] and h[0] != h[1]
    assert textops.span_hashes(np.zeros(0, np.uint8), np.zeros(2, np.int64), np.zeros(2, np.int64)).tolist() == [textops.mix(np.zeros(1, np.uint64))[0]] * 2


@given(st.lists(st.binary(max_size=90), max_size=12), st.sampled_from([1, 100, 1 << 20]))
@settings(max_examples=100, deadline=None)
def test_hashes_depend_on_the_bytes_alone(words, at_once):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    kept, textops._AT_ONCE = textops._AT_ONCE, at_once
    try:
        h = textops.span_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends)
    finally:
        textops._AT_ONCE = kept
    assert len(set(h.tolist())) == len(set(words))
    for w, x in zip(words, h.tolist(), strict=True):
        assert textops.span_hashes(np.frombuffer(b"x" + w, np.uint8), np.array([1]), np.array([1 + len(w)]))[0] == x


def test_quality_lines_and_windows(spark):
    texts = [f"{ONE} {REST}\n{TWO} {REST}\n", "\n".join(f"{w} one two three four five six seven" for w in (ONE, TWO, ONE))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge(docs, ["doc_id"]).collect():
        want = quality_base(texts[r.doc_id])
        assert {k: r[f"_q_{k}"] for k in ("n_words", "n_dup_lines", "n_repeat_words")} == {k: want[k] for k in ("n_words", "n_dup_lines", "n_repeat_words")}


def test_contamination_and_scores(spark):
    words = REST.split()
    rows = [(k, " ".join(words[:6] + [w] + words[6:])) for k, w in enumerate((ONE, TWO, "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_contamination(spark, docs, [(1, rows[0][1]), (2, TWO)])
    many = spark.createDataFrame([(k, f"{(ONE, TWO)[k % 3 == 0]} {words[k % 9]}") for k in range(40)], "doc_id long, text string")
    check_scores(many)


def test_links(spark):
    words = REST.split()
    rows = [(k, " ".join(words[:3] + [w] + words[3:])) for k, w in enumerate((ONE, TWO, ONE))] + [(7, ONE), (8, TWO)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_components(rows, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs).collect()} == want
    assert want[1][1] == 1 and want[2][1] == 0


@cache
def own(name):
    return PieceTokenizer(name)


CHARACTERS = [chr(c) for c in range(1, 0x250)]


def test_every_letter_below_the_limit_is_encoded_as_the_library_does():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        coder = library(name)
        texts = [t for c in CHARACTERS for t in (c, f"BA{c}I", f"x {c}{c} y", f"hello {c}ala 1{c}2")] + ["ƏLİ MƏMMƏDOV", "hello Ɓala", "BAƊI", "<|ENDOFTEXT|> <|endoftext|>"]
        ids, offsets = own(name).encode(texts)
        for k, t in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == coder.encode(t, add_special_tokens=False).ids, t
    assert max(map(ord, CHARACTERS)) == LIMIT - 1


@given(st.lists(st.text(alphabet=st.sampled_from([*CHARACTERS, *" '\n'SsTtRrEeVvLlMmDd019"]), max_size=20), max_size=8))
@settings(max_examples=400, deadline=None)
def test_texts_below_the_limit_equal_the_library(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        coder = library(name)
        got, offsets = own(name).encode(texts)
        assert [got[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))] == [coder.encode(t, add_special_tokens=False).ids for t in texts]
