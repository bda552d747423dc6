import random

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import common, jaccard
from auditlake.llm.common import _contract, connected_components
from auditlake.llm.jaccard import MAP_BITS, Levels, components, in_map, keep_one, part_keys
from helpers import jaccard_components


def check(docs, width=4, percent=85):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = jaccard_components(rows, width, percent)
    found = components(docs, width, percent).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted


def test_documents(documents):
    check(documents)


def test_pipeline_widths(documents):
    check(documents, 5, 80)


def near_copies(seed=3, groups=12, copies=9):
    """Groups of copies with few edits each, around the threshold."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(4, 160))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text[: rng.randint(max(1, len(text) - 4), len(text))])))
    return rows


@pytest.fixture(scope="module")
def copies(spark):
    return spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(5)


def test_near_copies(copies):
    check(copies)
    check(copies, 3, 70)


def test_blocks_of_large_cells(copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 200)
    check(copies)


def test_edges(edge_docs, no_docs):
    rows = [r for r in components(edge_docs).collect()]
    assert len(rows) == edge_docs.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by_id[6] + by_id[7]} == {6}
    assert by_id[0][0].component_id == 0 and by_id[0][0].n_shingles == 0
    assert {r.component_id for r in by_id[None] if r.n_shingles} == {6}
    assert components(no_docs).collect() == []


def test_one_document_stays(edge_docs, no_docs):
    kept = keep_one(edge_docs, 5, 80)
    assert kept.columns == edge_docs.columns
    texts = [r.text for r in kept.filter("text like 'The quick brown%'").collect()]
    assert len(texts) == len(set(texts)) == 2  # the original and the edited one, which is not linked
    assert keep_one(no_docs).collect() == []


def test_a_used_part_is_shared_by_all_linked_sets():
    """Any two sets within the threshold share a key, for sets that differ as much as is allowed."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(6, 400))
        percent = int(rng.choice([70, 80, 85, 95]))
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        drop = int(rng.integers(0, size))
        b = np.unique(np.concatenate([a[drop // 2 :], rng.integers(0, 2**63, drop - drop // 2, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared) or len(np.setxor1d(a, b)) == 0:
            continue
        keys = [set(part_keys(x, np.array([0, len(x)]), percent)[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_levels_allow_every_linked_difference():
    for percent in (70, 80, 85, 95):
        levels = Levels(percent, 3000)
        for b in range(7, 3000, 13):
            smallest = -(-percent * b // 100)
            level = levels.level(np.array([b]))[0]
            for a in (smallest, b):
                overlap = -(-percent * (a + b) // (100 + percent))
                if overlap <= a and a + b - 2 * overlap > 0:
                    assert a + b - 2 * overlap <= levels.differ[level]
                    assert level in (levels.level(np.array([a]))[0], levels.level(np.array([a * 100 // percent]))[0])


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id + 1 as a", "id as b").unionByName(spark.createDataFrame([(1001, 1000)], "a long, b long"))
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert len(roots) == 303
    assert {roots[n] for n in range(301)} == {0} and roots[1001] == 1000


def test_sets_that_share_a_name(documents, edge_docs):
    """Sets whose names are said to be shared are named by both hashes, and the result is the same."""
    for docs in (documents, edge_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        values, offsets = jaccard.shingle_sets(pa.array([r.text or "" for r in docs.collect()]), 4)
        names, checks = jaccard.class_ids(values, offsets)
        assert len(set(names.tolist())) == len(set(checks.tolist())) == len(set(zip(names.tolist(), checks.tolist(), strict=True)))
        shared = np.unique(names)[::2]
        again, _ = jaccard.class_ids(values, offsets, shared)
        assert ((again == names) == ~np.isin(names, shared)).all()
        rows = lambda found: sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
        assert rows(components(docs, shared=shared)) == rows(components(docs))


def test_a_hub_is_not_dealt_to_one_task(spark, monkeypatch):
    from auditlake.llm import common

    monkeypatch.setattr(common, "HUB", 3)
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 300)] + [(7, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_contracting_tasks_keep_components_whatever_they_hold():
    edges = [(3 * i, 3 * i + 3) for i in range(200)] + [(1, 700), (700, 1), (5, 5)]
    table = pa.RecordBatch.from_pydict({"a": [a for a, _ in edges], "b": [b for _, b in edges]})
    for held in (4, 64, 1 << 17):
        out = [e for batch in _contract(iter([table]), held) for e in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        assert all(a > b for a, b in out)
        assert components_of(out) == components_of([e for e in edges if e[0] != e[1]])
    assert len(out) == 201  # whole: one edge a node


def components_of(edges):
    groups = {}
    for a, b in edges:
        joined = groups.get(a, {a}) | groups.get(b, {b})
        for x in joined:
            groups[x] = joined
    return {frozenset(g) for g in groups.values()}


def test_a_graph_that_few_tasks_read_takes_a_round_at_most(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "stored", lambda df, name, real=common.stored: written.append(name) or real(df, name))
    path = [(i, i + 1) for i in range(3_000)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(path, "a long, b long").repartition(8)).collect()}
    assert found == dict.fromkeys(range(3_001), 0)
    assert written == ["edges"]


def test_parts_of_common_tokens_alone_do_not_chain_documents():
    rng = np.random.default_rng(5)
    passage = np.unique(rng.integers(0, 1 << 64, 60, np.uint64))
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 140, np.uint64)])) for _ in range(60)]
    common_map = np.zeros(MAP_BITS // 8, np.uint8)
    at = ((passage >> np.uint64(7)) & np.uint64(MAP_BITS - 1)).astype(np.int64)
    np.bitwise_or.at(common_map, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    assert in_map(common_map, passage).all()

    def meeting(bits):
        keys = [set(part_keys(x, np.array([0, len(x)]), 80, bits)[0].tolist()) for x in sets]
        return sum(bool(a & b) for i, a in enumerate(keys) for b in keys[:i])

    assert meeting(common_map) < meeting(None) / 3
    # linked sets still share a used part, whatever the map holds
    for n in (20, 90, 300):
        for _ in range(40):
            base = rng.integers(0, 1 << 64, n, np.uint64)
            cut = n // 10
            a, b = np.unique(base), np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 64, cut, np.uint64)]))
            bits = rng.integers(0, 256, MAP_BITS // 8, np.uint8)
            x, y = (set(part_keys(v, np.array([0, len(v)]), 80, bits)[0].tolist()) for v in (a, b))
            assert x & y
