import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import decontaminate
from auditlake.llm.decontaminate import SuffixArray, contamination, longest_matches
from helpers import ALNUM, lower
from helpers import contamination as plain
from helpers import longest_match


def check(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = lambda r: (r.longest_match, r.longest_at, r.longest_item, r.longest_item_at)
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, str(own(r))) for r in contamination(docs, bench).collect())
    wanted = []
    for r in docs.collect():
        n, hit, own = plain(r.text, items)
        wanted.append((r.doc_id is not None, r.doc_id or 0, n, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0 and 20 * hit >= n, str(longest_match(r.text, items) if hit else (0, None, None, None))))
    assert found == sorted(wanted)


def test_documents(spark, sf_dir, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    check(spark, documents, items)


ITEMS = [(1, "jumps over the lazy dog"), (2, None), (3, "!!"), (10, "The quick brown fox jumps over the lazy dog near the old river bank while"), (11, "one"), (12, "one"), (2, "lorem ipsum dolor sit amet consectetur lorem ipsum dolor sit amet consectetur lorem ipsum")]


def test_edges(spark, edge_docs, no_docs):
    check(spark, edge_docs, ITEMS)
    check(spark, no_docs, ITEMS)
    check(spark, edge_docs, [])


def test_blocks_of_the_benchmark(spark, edge_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    monkeypatch.setattr(decontaminate.read_blocks, "__defaults__", (30,))
    check(spark, edge_docs, ITEMS)


def test_many_blocks(spark, edge_docs):
    """40 items in 40 blocks: indexes of two of them at most live in a task."""
    words = "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing".split()
    items = [(i, " ".join(words[i % 3 : 4 + i % 3])) for i in range(38)] + [(38, " ".join(words)), (39, " ".join(words[2:]))]
    some = edge_docs.filter("doc_id between 5 and 8").coalesce(1)
    default = decontaminate.read_blocks.__defaults__
    decontaminate.read_blocks.__defaults__ = (1,)
    try:
        check(spark, some, items)
    finally:
        decontaminate.read_blocks.__defaults__ = default


def test_all_columns_stay(spark, edge_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert 0 < kept.count() < edge_docs.count()


def test_longest_matches(spark, edge_docs):
    bench = spark.createDataFrame([(7, "xx brown fox jumps over the lazy dog yy")], "item_id long, text string")
    found = {r.item_word: (r.length, r.doc_id) for r in longest_matches(edge_docs, bench, 3).collect()}
    assert found[1][0] == 7
    assert found[2][0] == 6


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=80, deadline=None)
def test_suffix_array_order(words):
    ids = np.array([*words, 0], np.int64)
    array = SuffixArray(ids, 2)

    def suffix(at):
        rest = ids[at:].tolist()
        return rest[: rest.index(0)]

    ordered = [suffix(a) for a in array.order.tolist()]
    assert ordered == sorted(suffix(a) for a in range(len(ids)) if ids[a])


def test_words():
    assert ALNUM.findall(lower("A-b é1")) == ["a", "b", "é1"]
