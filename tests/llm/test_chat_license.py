import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import chat, licenses
from auditlake.llm.chat import DEFAULT, format_chats, read_back, unescape, unescape_role
from helpers import ALNUM, chat_digest, grouped, lower


def check(rows):
    turns = grouped((r.conv_id, (r.turn, r.role, r.text)) for r in rows.collect())
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(format_chats(rows)).collect()}
    assert found == {c: chat_digest([(r, t) for _, r, t in sorted(ts, key=key)]) for c, ts in turns.items()}


def test_conversations(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows = chat.op9_chat_formatting(spark, sf_dir).filter("conv_id = -7").collect()
    assert [(r.n_turns, r.loss_chars, r.valid) for r in rows] == [(2, 21, True)]


def test_edges(spark):
    rows = [
        (1, 0, "user", "<|turn|>user\nhi<|end|>\n"), (1, 1, "assistant", "</s>\\[INST] \\\\ [/INST]"), (2, 0, "assistant", "x"), (3, None, None, None),
        (3, 0, "us\ner\\n", ""), (None, 0, "user", "a"), (None, 1, "assistant", "<\\|end|>"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "system", "s"), (5, 1, "user", "u" * 100_000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "turn").selectExpr("*", "1 as place", "'x' as segment")
    check(frame)
    valid = {r.conv_id: r.valid for r in read_back(format_chats(frame)).collect()}
    assert valid == {1: True, 2: False, 3: False, None: True, 4: False, 5: False}
    assert read_back(format_chats(frame.filter("false"))).collect() == []


_TEXT = st.text(st.sampled_from("<|turnend>/s[INST]\\n \n"), max_size=60) | st.text(max_size=20)


@given(_TEXT)
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible(text):
    safe = DEFAULT.escape(text)
    assert unescape(safe) == text
    assert not any(c in safe for c in DEFAULT.controls)
    assert unescape_role(DEFAULT.escape_role(text)) == text
    assert "\n" not in DEFAULT.escape_role(text)


def test_licenses_in_documents(spark, documents):
    rows = licenses.scan(documents).collect()
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    exact = {name: t.rstrip(".") for name, t in licenses.TEMPLATES}
    wanted = sum(texts[d].count(exact[n]) for d in texts for n in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0", "all-rights-reserved"))
    assert sum(r.coverage == 1.0 for r in rows) == wanted
    for r in rows:
        assert ALNUM.findall(lower(texts[r.doc_id][r.start_char : r.end_char]))[: r.matched_words]


def test_edited_license_and_edges(spark, edge_docs, no_docs):
    name, full = licenses.TEMPLATES[3]
    words = full.split()
    edited = " ".join(["Intro text."] + words[:20] + ["hereby"] + words[21:30] + words[32:] + ["tail"])
    docs = spark.createDataFrame([(1, edited), (2, None), (3, "")], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    assert [(r.doc_id, r.license_id) for r in rows] == [(1, name)]
    n = len(ALNUM.findall(lower(full)))
    assert rows[0].matched_words == n - 3
    assert edited[rows[0].start_char : rows[0].end_char].startswith("Permission")
    assert licenses.scan(no_docs).collect() == []
    assert licenses.scan(edge_docs, ()).collect() == []
    assert licenses.scan(edge_docs).collect() == []


@given(st.lists(st.integers(0, 4), min_size=3, max_size=14), st.lists(st.integers(0, 4), min_size=3, max_size=20))
@settings(max_examples=150, deadline=None)
def test_alignment_score_equals_the_full_table(template, doc):
    band = 40  # wide enough for the whole table
    found = licenses.align(np.array(template), np.array(doc), np.array([0]), np.array([len(doc)]), np.array([0]), band=20)
    table = np.zeros((len(template) + 1, len(doc) + 1), int)
    for i in range(1, len(template) + 1):
        for j in range(1, len(doc) + 1):
            pair = licenses.MATCH if template[i - 1] == doc[j - 1] else -licenses.MISS
            table[i, j] = max(0, table[i - 1, j - 1] + pair, table[i - 1, j] - licenses.GAP, table[i, j - 1] - licenses.GAP)
    assert band and found["score"][0] == table.max()


def test_winnowing_keeps_a_hash_of_every_window():
    hashes = np.random.default_rng(0).integers(0, 1000, 60).astype(np.uint64)
    kept = set(licenses.winnow(hashes, 4).tolist())
    for i in range(57):
        assert kept & set(range(i, i + 4))


def test_repeats_of_short_notices_are_all_found(spark):
    short = {n: t for n, t in licenses.TEMPLATES if len(ALNUM.findall(lower(t))) <= 2 * licenses.BAND}
    cases = [(n, "\n".join([t] * k), k) for n, t in short.items() for k in (2, 3, 40)]
    cases.append(("all-rights-reserved", "(c) 2020 X. All rights reserved. (c) 2021 Y. All rights reserved.", 2))
    docs = spark.createDataFrame([(i, "Intro " + text) for i, (_, text, _) in enumerate(cases)], "doc_id long, text string")
    rows = licenses.scan(docs).collect()
    for i, (name, text, k) in enumerate(cases):
        own = sorted((r.start_char, r.end_char) for r in rows if r.doc_id == i and r.license_id == name and r.coverage == 1.0)
        assert len(own) == k, (name, k, len(own))
        assert all(a <= b for (_, a), (b, _) in zip(own, own[1:], strict=False))


def test_edited_copies_that_reach_the_coverage_are_found(spark):
    rng = np.random.default_rng(3)
    cases = []
    for name, full in licenses.TEMPLATES:
        words = ALNUM.findall(lower(full))
        n = len(words)
        missed = max(m for m in range(n) if n - m >= licenses.COVERAGE * n)
        spread = [list(range(k, n, 5))[:missed] for k in range(5)] + [[i] for i in range(n) if missed and n < 20]
        spread += [rng.choice(n, missed, replace=False).tolist() for _ in range(5)]
        for places in spread:
            if 0 in places or n - 1 in places:
                continue  # an alignment may leave the ends out; the middle has to be bridged
            cases.append((name, n - len(places), "Intro: " + " ".join("changed" if i in places else w for i, w in enumerate(words)) + " tail"))
        for i in range(n) if missed and n < 20 else ():
            cases.append((name, n - 1, "Intro: " + " ".join("changed" if i == j else w for j, w in enumerate(words)) + " tail"))
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(cases)], "doc_id long, text string")
    found = {(r.doc_id, r.license_id): r.matched_words for r in licenses.scan(docs).collect()}
    assert [c for i, c in enumerate(cases) if found.get((i, c[0])) != c[1]] == []


def test_templates_shorter_than_a_run(spark):
    docs = spark.createDataFrame([(1, "This is in the Public Domain; WTFPL too."), (2, "public, not a domain")], "doc_id long, text string")
    rows = licenses.scan(docs, (("pd", "public domain"), ("wtfpl", "WTFPL"))).collect()
    assert sorted((r.doc_id, r.license_id, r.coverage) for r in rows) == [(1, "pd", 1.0), (1, "wtfpl", 1.0)]
    with pytest.raises(ValueError, match="no word"):
        licenses.scan(docs, (("empty", " ... "),))
