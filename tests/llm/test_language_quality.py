import zlib

import numpy as np
import pyarrow as pa

from auditlake.llm import language, quality
from helpers import quality_base


def test_held_out_accuracy(documents):
    truth = {r.doc_id: r for r in documents.collect()}
    rows = language.identify(documents).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    judged = [r for r in held if r.lang_pred != "und" and truth[r.doc_id].lang]
    assert np.mean([truth[r.doc_id].lang == r.lang_pred for r in judged]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(edge_docs, no_docs, documents):
    trees = language.train(documents)
    pred = language.predict(edge_docs, trees, edge_docs.columns)
    for r in pred.collect():
        bare = not any(c.isalpha() for c in r.text or "")
        assert (r._lg_pred == "und") == bare
        assert r.score == 0.5 or r.score is None  # the documents' own column stays
    assert language.identify(no_docs).collect() == []
    untaught = language.train(no_docs)
    assert {r._lg_pred for r in language.predict(edge_docs, untaught, ["doc_id"]).collect()} == {"und"}


def test_every_language_is_taught(spark, documents):
    """A language of one very long text, null ids, 10,000 copies of a text and 200 partitions."""
    long = "zwölf boxkämpfer jagen viktor quer über den großen sylter deich " * 40_000
    rows = [(None, long, "de")] + [(None, "the same words again and again", "en")] * 10_000 + [(i, f"words of a text with a number {i} in it", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(200)
    drawn = [(r.lang, r.text) for r in language.draw(docs, 2_000).collect()]
    assert ("de", long) in drawn and len(set(drawn)) == len(drawn)
    english = sum(len(t) for k, t in drawn if k == "en")
    assert 0 < english <= 2_000 + 50
    assert language.train(docs, 2_000).languages == ["de", "en"]
    assert {r.lang for r in language.draw(documents, 1).collect()} == {r.lang for r in documents.filter("lang is not null").select("lang").distinct().collect()}


def plain_code_bits(trees, text):
    """Bits of a text under each language, by the code table symbol by symbol and context by context."""
    data = bytes(language.folded(pa.array([text.lower()]))[0])
    out = np.zeros(len(trees.languages))
    for i in range(language.ORDER, len(data)):
        context = 0
        for k in range(i - language.ORDER, i):
            context = context * trees.size + int(trees.symbol[data[k]])
        out += trees.bits[int(trees.node[context]) * trees.size + int(trees.symbol[data[i]])]
    return out, len(data) - language.ORDER


def test_predictions_equal_a_plain_version(documents, edge_docs):
    trees = language.train(documents)
    for docs in (documents.filter("doc_id % 17 = 0"), edge_docs.filter("length(text) < 2000 or text is null")):
        for r in language.predict(docs, trees, ["doc_id", "text"]).collect():
            if not any(c.isalpha() for c in r.text or ""):
                assert (r._lg_pred, r._lg_score) == ("und", 0.0)
                continue
            bits, size = plain_code_bits(trees, r.text)
            assert r._lg_pred == trees.languages[int(bits.argmin())]
            assert abs(r._lg_score - 1 / np.exp2(bits.min() - bits).sum()) < 1e-3
            assert abs(r._lg_bits - bits.min() / max(size, 1)) < 1e-3


def test_code_lengths_equal_the_definition():
    """Escape method C with exclusion, symbol by symbol."""
    text = "abracadabra abra"
    trees = language.ContextTrees({"x": [text], "y": ["zzz"]})
    padded = "   " + text

    def chance(context, symbol, alphabet):
        """context: longest first."""
        if context is None:
            return 1 / alphabet
        follow = [padded[i + len(context)] for i in range(3 - len(context), len(padded) - len(context)) if padded[i : i + len(context)] == context and i + len(context) >= 3]
        shorter = context[1:] if context else None
        if not follow:
            return chance(shorter, symbol, alphabet)
        seen, total = set(follow), len(follow)
        symbols = [chr(s) for s in np.flatnonzero(trees.symbol)] + ["\0"]
        rest = sum(chance(shorter, s, alphabet) for s in symbols if s not in seen)
        whole = total + (len(seen) if rest > 0 else 0)
        if symbol in seen:
            return follow.count(symbol) / whole
        return len(seen) / whole * chance(shorter, symbol, alphabet) / rest

    old, language.LEAST_CONTEXT = language.LEAST_CONTEXT, 1
    try:
        trees = language.ContextTrees({"x": [text], "y": ["zzz"]})
    finally:
        language.LEAST_CONTEXT = old
    probe = "abra cad"
    want = 0.0
    line = "   " + probe
    for i in range(3, len(line)):
        context = line[i - 3 : i]
        while context and not any(padded[k : k + len(context)] == context and k + len(context) >= 3 for k in range(len(padded) - len(context))):
            context = context[1:]
        want -= np.log2(chance(context, line[i], trees.size))
    bits, size = trees.code_lengths(pa.array([probe]))
    assert size.tolist() == [len(probe)]
    assert abs(bits[0, 0] - want) < 1e-3


def test_base_figures(documents, edge_docs):
    for docs in (documents, edge_docs):
        wanted = {(r.doc_id, r.text): quality_base(r.text) for r in docs.collect()}
        rows = quality.judge(docs, ["doc_id", "text"]).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert {k: r[f"_q_{k}"] for k in wanted[r.doc_id, r.text]} == wanted[r.doc_id, r.text]


def test_order_does_not_change_the_verdict(edge_docs, documents):
    for docs in (edge_docs, documents):
        kept = [sorted(map(str, quality.judge(docs, ["doc_id", "text"], rules).filter("_q_rule is null").select("doc_id", "text").collect())) for rules in (quality.RULES, quality.RULES[::-1])]
        assert kept[0] == kept[1]


def test_rules_go_by_rejection_per_cost():
    figures = [("symbols", 2.0, 0.2), ("word_length", 1.0, 0.5), ("shouting", 1.0, 0.3)]
    rules = [r for r in quality.RULES if r.name in {f[0] for f in figures}]
    assert [r.name for r in quality.order_rules(figures, tuple(rules))] == ["word_length", "shouting", "symbols"]


def test_against_labels(spark, sf_dir, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.judge(documents, ["doc_id"]).collect()
    same = [(r._q_rule is None) == bool(labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean(same) > 0.9


def test_empty(no_docs):
    assert quality.judge(no_docs, ["doc_id"]).collect() == []
