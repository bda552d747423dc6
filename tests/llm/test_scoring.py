import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from auditlake.llm import scoring
from helpers import SPACED, lower


def base(docs):
    tokens = lambda t: [*SPACED.findall(lower(t)), None]
    counts = Counter()
    for d, t in docs:
        if zlib.crc32(str(d if d is not None else "").encode()) % 10:
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs:
        own = tokens(t)
        logs = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        out[d, t] = (len(own), sum(counts[w] > 0 for w in own), total, logs)
    return out


def check(docs):
    wanted = base([(r.doc_id, r.text) for r in docs.collect()])
    ids = {}
    for (d, t), v in wanted.items():
        ids.setdefault(d, []).append(v)
    rows = scoring.score(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert any(
            (r.n_tokens, r.n_known, r.train_tokens) == v[:3] and abs(r.base_score - v[3]) < 1e-6 * max(1, abs(v[3])) for v in ids[r.doc_id]
        )
        assert r.score < 0
    return rows


def test_documents(documents):
    rows = check(documents)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_beyond_the_broadcast(documents, monkeypatch):
    monkeypatch.setattr(scoring.gather, "__defaults__", (200, 500))
    check(documents)


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert scoring.score(no_docs).collect() == []


def small():
    rng = np.random.default_rng(1)
    emit = rng.random((6, 3))
    move = rng.random((3, 3))
    model = scoring.Model(np.array([0.5, 0.3, 0.2]), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    sequences = [rng.integers(0, 6, n) for n in (1, 5, 2, 4)]
    return model, np.concatenate(sequences), np.concatenate([[0], np.cumsum([len(s) for s in sequences])])


def paths(model, ids):
    """Every state path with its probability."""
    out = [((s,), model.start[s] * model.emit[ids[0], s]) for s in range(3)]
    for w in ids[1:]:
        out = [((*p, s), v * model.move[p[-1], s] * model.emit[w, s]) for p, v in out for s in range(3)]
    return out


def test_forward_equals_the_sum_over_paths():
    model, ids, offsets = small()
    found = scoring.log_likelihood(model, ids, offsets)
    for k in range(len(offsets) - 1):
        assert abs(found[k] - math.log(sum(v for _, v in paths(model, ids[offsets[k] : offsets[k + 1]])))) < 1e-9


def test_expected_counts_equal_the_sum_over_paths():
    model, ids, offsets = small()
    start, move, emit = scoring.expected_counts(model, ids, offsets)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))]
    for k in range(len(offsets) - 1):
        own = ids[offsets[k] : offsets[k + 1]]
        every = paths(model, own)
        total = sum(v for _, v in every)
        for path, v in every:
            want[0][path[0]] += v / total
            for a, b in zip(path, path[1:], strict=False):
                want[1][a, b] += v / total
            for s, w in zip(path, own, strict=True):
                want[2][w, s] += v / total
    for a, b in zip((start, move, emit), want, strict=True):
        assert np.abs(a - b).max() < 1e-4


def test_rounds_raise_the_likelihood():
    model, ids, offsets = small()
    ids, offsets = np.tile(ids, 30), np.concatenate([[0], np.cumsum(np.tile(np.diff(offsets), 30))])
    unigram = np.bincount(ids, minlength=6) / len(ids)
    last = -np.inf
    for _ in range(5):
        now = scoring.log_likelihood(model, ids, offsets).sum()
        assert now >= last - 1e-3
        last = now
        start, move, emit = scoring.expected_counts(model, ids, offsets)
        model = scoring.Model(start / start.sum(), move / move.sum(1, keepdims=True), (emit + 1e-9) / (emit + 1e-9).sum(0))


def test_scores_equal_a_plain_forward_recursion(documents, monkeypatch):
    """Every score, held out or not, from the text, the word counts and the trained model, state by state."""
    held = {}
    train = scoring.train
    monkeypatch.setattr(scoring, "train", lambda encoded, unigram: held.setdefault("model", train(encoded, unigram)))
    gather = scoring.gather
    monkeypatch.setattr(scoring, "gather", lambda counts: held.setdefault("known", gather(counts)))
    docs = documents.filter("doc_id < 60")
    rows = {r.doc_id: r for r in scoring.score(docs).collect()}
    model, known = held["model"], held["known"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(w for d, t in texts.items() if not rows[d].held_out for w in [*SPACED.findall(lower(t)), None])
    rare = [w for w, n in counts.items() if n < scoring.LEAST_NAMED]
    class_of = lambda w: int(scoring.token_hashes(pa.array([w]))[1][0])
    total, distinct = Counter(), Counter()
    for w in rare:
        total[class_of(w)] += counts[w]
        distinct[class_of(w)] += 1
    for d, t in texts.items():
        alpha, log = None, 0.0
        for w in [*SPACED.findall(lower(t)), None]:
            hashes, classes, _ = scoring.token_hashes(pa.array(["" if w is None else w]))
            place = int(known.encode(hashes[:1], classes[:1])[0][0])
            chance = [float(x) for x in model.emit[place]]
            if counts[w] < scoring.LEAST_NAMED:
                c = class_of(w)
                assert place == known.words + c
                chance = [x * (counts[w] + 0.1) / (total[c] + 0.1 * (distinct[c] + 1)) for x in chance]
            before = model.start if alpha is None else [sum(a * model.move[i][j] for i, a in enumerate(alpha)) for j in range(len(chance))]
            alpha = [b * e for b, e in zip(before, chance, strict=True)]
            log += math.log10(sum(alpha))
            alpha = [a / sum(alpha) for a in alpha]
        assert abs(rows[d].score - log) < 1e-6 * max(1, abs(log))


def test_sums_of_groups_of_tasks_equal_one_task(documents, monkeypatch):
    """A round over 200 partitions, whose sums meet in groups, against the same round in one process."""
    monkeypatch.setattr(scoring, "TOLERANCE", 1.0)
    rounds_of(documents.repartition(200), monkeypatch)


def rounds_of(docs, monkeypatch):
    """The rows of scores, and (tokens, log likelihood, ids, model) of each round, held to one process with all rows."""
    seen = []
    round_of = scoring.baum_welch

    def spy(encoded, model, unigram):
        rows = [np.frombuffer(bytes(r.ids), "<u4").astype(np.int64) for r in encoded.collect()]
        ids, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        after, reached = round_of(encoded, model, unigram)
        own = scoring.Model.normalised(*scoring.expected_counts(model, ids, scoring._cut(offsets, scoring.CUT)), unigram)
        assert np.allclose(after.emit, own.emit, rtol=1e-3) and np.allclose(after.move, own.move, rtol=1e-3)
        assert abs(reached - scoring.log_likelihood(model, ids, scoring._cut(offsets, scoring.CUT)).sum()) < 1e-4 * abs(reached)
        seen.append((len(ids), reached, ids, after))
        return after, reached

    monkeypatch.setattr(scoring, "baum_welch", spy)
    return scoring.score(docs).collect(), seen


def test_every_round_covers_all_training_rows(documents, monkeypatch):
    rows, seen = rounds_of(documents, monkeypatch)
    assert len(seen) > 2 and {n for n, *_ in seen} == {sum(r.n_tokens for r in rows if not r.held_out)}
    logs = [v for _, v, *_ in seen]
    assert all(b - a > scoring.TOLERANCE * abs(b) for a, b in zip(logs[:-2], logs[1:-1], strict=True))
    assert logs[-1] - logs[-2] <= scoring.TOLERANCE * abs(logs[-1])


def test_every_word_seen_often_enough_is_named(spark, monkeypatch):
    """40,000 words that all end alike: each has emission statistics of its own."""
    words = [f"w{i}xx" for i in range(40_000)]
    rows = [(i, " ".join(words[k : k + 400])) for i, k in enumerate(k for k in range(0, 40_000, 400) for _ in range(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 10 for w in [*t.split(), None])
    often = sum(n >= scoring.LEAST_NAMED for n in counts.values())
    assert often > 1 << 15
    monkeypatch.setattr(scoring, "TOLERANCE", 1.0)  # two rounds
    _, seen = rounds_of(docs, monkeypatch)
    _, _, ids, model = seen[-1]
    assert len(model.emit) == often + scoring.CLASSES
    assert len(np.unique(ids[ids < often])) == often
    check(docs)


def test_emissions_are_gathered_at_less_cost_than_by_rows():
    rng = np.random.default_rng(3)
    model = scoring.Model.seeded(np.full(50_000, 1 / 50_000, np.float32), scoring.STATES)
    ids = rng.zipf(1.3, 1 << 20) % 50_000
    assert scoring.emissions(model, ids[:0], np.empty((scoring.STATES, 0), np.float32)).shape == (scoring.STATES, 0)
    out = np.empty((scoring.STATES, len(ids)), np.float32)
    one, rows = [], []
    for _ in range(5):
        began = time.process_time()
        scoring.emissions(model, ids, out)
        one.append(time.process_time() - began)
        began = time.process_time()
        expected = np.ascontiguousarray(model.emit[ids].T)
        rows.append(time.process_time() - began)
    assert (out == expected).all()
    assert min(one) < min(rows)


def test_an_expectation_step_costs_little_more_than_its_sums_by_state():
    """The whole step against its reads and sums alone, one state after the other; words as frequent as in texts."""
    rng = np.random.default_rng(5)
    n = 500_000
    model = scoring.Model.seeded(np.full(n, 1 / n, np.float32), scoring.STATES)
    offsets = np.arange(0, (1 << 20) + 1, scoring.CUT)
    ids = (n ** rng.random(offsets[-1])).astype(np.int64) - 1
    gamma = np.full((scoring.STATES, len(ids)), 1 / scoring.STATES, np.float32)
    step, sums = [], []
    for _ in range(5):
        began = time.process_time()
        scoring.expected_counts(model, ids, offsets)
        step.append(time.process_time() - began)
        began = time.process_time()
        for of_state, state in zip(model.emit.T, gamma, strict=True):
            np.take(of_state, ids), np.bincount(ids, state, n)
        sums.append(time.process_time() - began)
    assert min(step) < 2.1 * min(sums)


def test_long_sums_of_emissions_keep_their_digits():
    rng = np.random.default_rng(6)
    sums, ids = scoring.Emitted(6000, scoring.STATES), np.where(rng.random(1 << 20) < 0.6, 0, rng.integers(0, 5000, 1 << 20))
    gamma = rng.dirichlet(np.ones(scoring.STATES), len(ids)).astype(np.float32)
    for _ in range(4):
        sums.add(ids, gamma)
    expected = 4 * np.stack([np.bincount(ids, g, 6000) for g in gamma.T], axis=1)
    found = sums.rows(np.arange(6000))
    assert (sums.touched == (expected > 0).any(1)).all()
    assert np.allclose(found, expected, rtol=3e-6, atol=0)
    odd = scoring.Emitted(6000, 3)
    odd.add(ids, np.ascontiguousarray(gamma[:, :3]))
    assert np.allclose(odd.rows(np.array([0, 4095, 4096, 5999])), expected[[0, 4095, 4096, 5999], :3] / 4, rtol=3e-6, atol=0)


def test_sums_of_one_group_of_tasks_meet_once(documents, monkeypatch):
    """Few tasks take one shuffle a round, many take two; either gives the round of one process."""
    passes = []
    apply = type(documents).mapInArrow
    for tasks, each in ((64, 1), (1, 2)):
        passes.clear()
        with monkeypatch.context() as patch:
            patch.setattr(scoring, "TOLERANCE", 1.0)  # two rounds
            patch.setattr(scoring, "_GROUP", tasks)
            patch.setattr(type(documents), "mapInArrow", lambda self, func, *a, **b: passes.append(func) or apply(self, func, *a, **b))
            _, seen = rounds_of(documents.filter("doc_id < 200").repartition(8), patch)
        assert passes.count(scoring._add) == each * len(seen)
