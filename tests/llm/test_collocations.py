import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from auditlake.llm import collocations as co
from helpers import lower


def plain(rows, least, most_words, keep_percent, top):
    """rows: (text, lang)."""
    f, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, most_words + 1):
                f.update((lang or "und", *words[i : i + k]) for i in range(len(words) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for g, a in found.items():
        lang, words = g[0], g[1:]
        longer = [b for h, b in found.items() if len(h) > len(g) and h[0] == lang and any(h[i : i + len(words)] == words for i in range(1, len(h) - len(words) + 1))]
        if any(100 * b >= keep_percent * a for b in longer):
            continue
        cuts = [(co.SCALE * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right, total[lang]))
    ranked, seen = set(), Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.add((lang, seen[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def spoken(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "été", "B", "d'x", "é"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", ":", "\r", "\x0b", " \x00 "]
    return ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_against_plain_counts(spark):
    texts = spoken(1, 160)
    rows = [(t, ["en", "fr", None, "und"][k % 4]) for k, t in enumerate(texts)] + [(None, "en"), ("", None), (" \t\n", "xx"), (texts[0], "en"), (texts[0], "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for least, most_words, keep, top in ((3, 4, 80, 2000), (5, 3, 50, 7), (2, 5, 100, 30), (4, 2, 80, 3)):
        got = [tuple(r) for r in co.collocations(docs, least=least, most_words=most_words, keep_percent=keep, top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, least, most_words, keep, top)


def test_automaton_counts_every_sequence_and_links_to_its_suffix():
    rng = np.random.default_rng(3)
    ids, reach = rng.integers(0, 4, 500), np.ones(500, np.int64)
    for i in range(1, 500):
        reach[i] = 1 if i % 23 == 0 else min(reach[i - 1] + 1, 5)
    machine = co.Automaton(ids, reach, 5)
    for k in range(1, 6):
        ends, n = machine.sequences(k)
        got = {tuple(ids[e - k + 1 : e + 1].tolist()): c for e, c in zip(ends.tolist(), n.tolist(), strict=True)}
        want = Counter(tuple(ids[i - k + 1 : i + 1].tolist()) for i in range(500) if reach[i] >= k)
        assert got == want and len(ends) == len(got)
    sequence = lambda v: tuple(ids[machine.end[v] - machine.length[v] + 1 : machine.end[v] + 1].tolist())
    for v in np.flatnonzero(machine.link >= 0).tolist():
        assert sequence(v)[1:] == sequence(machine.link[v])
    assert (machine.shortest[machine.longest] <= machine.length[machine.longest]).all()
    assert len(co.Automaton(np.zeros(0, np.int64), np.zeros(0, np.int64), 4).sequences(1)[0]) == 0


def test_shards_do_not_change_counts(spark, edge_docs, no_docs, monkeypatch):
    whole = {tuple(r) for r in co.collocations(edge_docs, least=2).collect()}
    assert whole == plain([(r.text, r.lang) for r in edge_docs.collect()], 2, 4, 80, 2000)
    assert co.collocations(no_docs).count() == 0


def test_large_counts_are_exact(spark):
    # 2,000,000 * a passes 64 bits here
    got = spark.sql(f"select (cast(9000000000000000 as decimal(20, 0)) * cast({co.SCALE} as decimal(8, 0))) div (cast(9000000000000001 as decimal(20, 0)) + cast(9000000000000000 as decimal(20, 0))) as s").first().s
    assert got == co.SCALE * 9 * 10**15 // (18 * 10**15 + 1)


def test_words_are_told_apart_by_their_bytes():
    a = "ab"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    shard = co.Shard("en", pa.array([f"{a} x {b} x {a}"]))
    assert len(shard.words) == 3 and shard.ids.tolist() == [0, 1, 2, 1, 0]
