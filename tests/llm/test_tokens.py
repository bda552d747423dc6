from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm.common import fresh_path
from auditlake.llm.token_binary import TokenFile, encode_file, read_documents, write
from auditlake.llm.token_counts import allocate, field_counts, token_counts
from helpers import crc_ids
from test_packing import library


def check(rows, docs):
    coder = library("word_bpe_49k.json")
    at, wanted = 0, []
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        wanted.append((doc_id, at, len(ids), crc_ids(ids)))
        at += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda x: x[1]) == wanted


def through_files(spark, docs):
    path = fresh_path(spark, "tokens")
    write(docs, path)
    return read_documents(spark, path).collect()


def test_documents(spark, documents, texts):
    check(through_files(spark, documents), texts.items())


def test_edges(spark, edge_docs, no_docs):
    check(through_files(spark, edge_docs), [(r.doc_id, r.text) for r in edge_docs.collect()])
    assert through_files(spark, no_docs) == []


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=60), min_size=1, max_size=6), st.booleans(), st.sampled_from([1, 7, 64]))
@settings(max_examples=60, deadline=None)
def test_file_round_trip(docs, bits, chunk):
    ids = np.array([i for d in docs for i in d], np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    file = TokenFile(encode_file([*range(len(docs))], ids, offsets, bits, chunk))
    for k, doc in enumerate(docs):
        start, n = int(file.documents["start"][k]), int(file.documents["n"][k])
        assert file.ids(start, start + n).tolist() == doc


def test_counts_add_up(edge_docs, no_docs):
    coder = library("byte_bpe_50k.json")
    wanted = {}
    for r in edge_docs.collect():
        wanted.setdefault(r.doc_id, 0)
        wanted[r.doc_id] += len(coder.encode(r.text or "", add_special_tokens=False).ids)
    found = {}
    for r in token_counts(edge_docs).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_tokens
    assert found == wanted
    assert token_counts(no_docs).collect() == []


def allotted(coder, text, spans, rule):
    """Token counts by section from the library's own offsets and byte lengths; spans: sorted, apart, in characters."""
    counts, crossing = [0] * len(spans), [0] * len(spans)
    lost = 0
    size = [0]
    for c in text:
        size.append(size[-1] + len(c.encode()))
    ids = coder.encode(text, add_special_tokens=False).ids
    at = 0
    lengths = sizes_of(coder)
    for i in ids:
        begin, at = at, at + lengths[i]
        held = [max(0, min(at, size[e]) - max(begin, size[s])) for s, e in spans]
        outside = at - begin - sum(held)
        if rule == "largest":
            k = held.index(max(held)) if held and max(held) and max(held) >= outside else -1
        else:
            k = next((k for k, (s, e) in enumerate(spans) if size[s] <= begin < size[e]), -1)
        if k < 0:
            lost += 1
            continue
        counts[k] += 1
        crossing[k] += sum(h > 0 for h in held) > 1 or outside > 0
    return counts, crossing, lost


@cache
def sizes_of(coder):
    """Bytes of each id: one character of a byte-level token stands for one byte."""
    return {i: len(t) for t, i in coder.get_vocab().items()}


def lines(text):
    bounds, at = [], 0
    for line in text.split("\n"):
        bounds.append((at, min(at + len(line) + 1, len(text))))
        at = bounds[-1][1]
    return [b for b in bounds if b[0] < b[1]]


@pytest.mark.parametrize("rule", ["first", "largest"])
def test_lines(documents, edge_docs, rule):
    """Each line's tokens of the whole text, by brute force; the query's own rule is `largest`."""
    coder = library("byte_bpe_50k.json")
    for docs in (documents.filter("doc_id < 30"), edge_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {(r.doc_id, r.section): r for r in token_counts(docs, rule=rule).collect()}
        for d in docs.collect():
            text = d.text or ""
            spans = lines(text)
            counts, crossing, lost = allotted(coder, text[:20_000], spans, rule) if len(text) <= 20_000 else (None, None, None)
            if counts is None:
                continue
            assert not lost and len([k for k in rows if k[0] == d.doc_id]) == max(len(spans), 1)
            for k, (a, b) in enumerate(spans):
                r = rows[d.doc_id, k]
                assert (r.n_tokens, r.n_crossing, r.start_char, r.n_chars) == (counts[k], crossing[k], a, b - a)


def test_spans_that_overlap_or_leave_the_text(spark):
    kind = "doc_id long, text string, spans array<struct<start:long,end:long>>"
    text = "é hello world of words"
    given_spans = [[(5, 60), (-4, 7), (None, 3), None, (30, 40), (9, 9)], None, [], [(0, 400)]]
    rows = [(i, text, s) for i, s in enumerate(given_spans)] + [(9, None, [(0, 5)])]
    coder = library("byte_bpe_50k.json")
    for rule in ("largest", "first"):
        found = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in token_counts(spark.createDataFrame(rows, kind).coalesce(1), rule=rule, spans="spans").collect()}
        counts, crossing, lost = allotted(coder, text, [(0, 7), (7, len(text))], rule)
        assert lost == 0
        assert {k: v for (d, k), v in found.items() if d == 0} == {1: (counts[0], crossing[0]), 0: (counts[1], crossing[1]), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
        n = len(coder.encode(text, add_special_tokens=False).ids)
        assert found[1, -1] == found[2, -1] == (n, 0) and found[3, 0] == (n, 0) and found[9, 0] == (0, 0)


def test_fields(spark):
    docs = spark.createDataFrame([(1, "A title", None, "some body text"), (2, None, None, None)], "doc_id long, title string, note string, body string")
    found = {(r.doc_id, r.field): r.n_tokens for r in field_counts(docs, ["title", "note", "body"]).collect()}
    counts, _, lost = allotted(library("byte_bpe_50k.json"), "A title\n\nsome body text", [(0, 7), (8, 8), (9, 23)], "largest")
    assert (found[1, "title"], found[1, "note"], found[1, "body"], found.get((1, None), 0)) == (*counts, lost)
    assert found[2, "title"] == 0


@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(1, 9), min_size=1, max_size=12), st.sampled_from(["largest", "first"]))
@settings(max_examples=80, deadline=None)
def test_rule_for_crossing_tokens(tokens, sections, rule):
    edges = np.concatenate([[0], np.cumsum(tokens)])
    cuts = np.concatenate([[0], np.cumsum(sections)])
    got, crossing = allocate(edges[1:], edges[:-1], cuts[:-1], cuts[1:], rule)
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        held = [max(0, min(b, e) - max(a, s)) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
        outside = (b - a) - sum(held)
        if rule == "first":
            want = next((i for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if s <= a < e), -1)
        else:
            want = held.index(max(held)) if max(held) and max(held) >= outside else -1
        assert got[k] == want
        assert crossing[k] == (sum(h > 0 for h in held) > 1 or (outside > 0 and max(held) > 0))
