import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulse.llm import gru, lm
from pulse.llm.gru import GatedModel

DDL = "doc_id long, text string"


def corpus(n=260, seed=3):
    rnd = random.Random(seed)
    tongues = [["a%d" % i for i in range(60)], ["b%dé" % i for i in range(60)]]
    docs = []
    for i in range(n):
        words = tongues[i % 2]
        docs.append((i, "  ".join(rnd.choice(words) if rnd.random() < 0.9 else "r%d" % rnd.randrange(10 ** 6)
                                  for _ in range(rnd.randrange(0, 90)))))
    return docs + [(n, None), (n + 1, ""), (None, "A1 a2"), (5, "A1 a2\ta3"), (5, "A1 a2\ta3"), (n + 2, "a1 " * 20_000)]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [""]


def teaches_brute(doc):
    return __import__("zlib").crc32(("" if doc is None else str(doc)).encode()) % 7 != 2


@pytest.mark.parametrize("known", [20, 65536])
def test_base_scores_equal_brute_force_and_the_model_beats_them(spark, known):
    docs = corpus()
    scores, stats = lm.score_documents(spark.createDataFrame(docs, DDL), lm.not_held_out, words=40, known=known)
    counts = Counter(w for d, t in docs if teaches_brute(d) for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    assert (stats.tokens, stats.distinct) == (total, distinct)
    want, got = [], []
    for d, t in docs:
        w = split(t)
        base = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        want.append((str(d), len(w), sum(counts[x] > 0 for x in w), round(base, 6)))
    rows = scores.collect()
    got = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows]
    assert sorted(got) == sorted(want)
    held = [r for r in rows if not teaches_brute(r["doc_id"]) and r["n_tokens"] > 20]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    rnd = np.random.default_rng(0)
    model = GatedModel(rnd.integers(1, 50, 100).astype(float), rnd.integers(1, 50, 5).astype(float))
    model.train([rnd.integers(0, 105, 50) for _ in range(20)])
    state = rnd.standard_normal((1, model.hidden)).astype(np.float32)
    every = model.log_probs(np.repeat(state, 105, axis=0), np.arange(105))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)


def test_state_is_carried_over_windows_and_lanes_do_not_mix():
    rnd = np.random.default_rng(1)
    model = GatedModel(np.ones(70), np.ones(3))
    model.train([rnd.integers(0, 73, 60) for _ in range(40)])
    docs = [rnd.integers(0, 73, n) for n in (0, 1, 200, 24, 25, 7)]
    together, alone = model.score(docs), [model.score([d])[0] for d in docs]
    assert together == pytest.approx(alone, rel=1e-4)
    state, last, total = np.zeros((1, model.hidden), np.float32), np.array([model.start]), 0.0
    for slot in docs[2]:
        state, _ = model.step(state, last)
        last = np.array([slot])
        total += model.log_probs(state, last)[0]
    assert together[2] == pytest.approx(total, rel=1e-4)


def test_gradients_equal_differences():
    rnd = np.random.default_rng(2)
    model = GatedModel(rnd.integers(1, 9, 70).astype(float), np.ones(3), hidden=5)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    tokens = rnd.integers(0, 73, (3, 6))
    tokens[0, 0] = tokens[1, 3] = -1
    state, last = rnd.standard_normal((3, 5)), np.array([1, 2, 3])

    def loss():
        total, n = 0.0, 0
        for lane in range(3):
            h, x = state[lane:lane + 1], last[lane:lane + 1]
            for slot in tokens[lane]:
                if slot < 0:
                    h, x = np.zeros((1, 5)), np.array([model.start])
                    continue
                h, _ = model.step(h, x)
                x = np.array([slot])
                total, n = total - model.log_probs(h, x)[0], n + 1
        return total / n
    grads, _, _ = model._window(tokens, state, last)
    for name, g in grads.items():
        rows, g = g if isinstance(g, tuple) else (None, g)
        flat = model.p[name]
        for _ in range(12):
            at = tuple(rnd.integers(0, s) for s in g.shape)
            real = at if rows is None else (rows[at[0]], *at[1:])
            keep = flat[real]
            flat[real] = keep + 1e-5
            up = loss()
            flat[real] = keep - 1e-5
            down = loss()
            flat[real] = keep
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert lm.score_documents(empty, lm.not_held_out)[0].collect() == []
    one = spark.createDataFrame([(5, "x")], DDL)
    row = lm.score_documents(one, lambda c: c < 0)[0].first()
    assert (row["n_tokens"], row["n_known"], row["base_score"]) == (2, 0, 0.0)


@pytest.mark.parametrize("sizes", [(400, 1), (400, 0)])
def test_lanes_are_trained_to_their_own_end(monkeypatch, sizes):
    rnd = np.random.default_rng(4)
    docs = [rnd.integers(0, 73, n) for n in sizes]
    seen, window = [], GatedModel._window
    monkeypatch.setattr(GatedModel, "_window", lambda self, tokens, *rest: (
        seen.extend(tokens[tokens >= 0].tolist()), window(self, tokens, *rest))[1])
    GatedModel(np.ones(70), np.ones(3)).train(docs)
    assert sorted(seen) == sorted(np.concatenate(docs).tolist())


def test_every_training_token_teaches_the_network_and_rounds_repeat(spark, monkeypatch):
    docs = [(i, f"a{i % 40} b{i % 7} a{i % 40}") for i in range(9000)]
    df = spark.createDataFrame(docs, DDL).repartition(3, "doc_id")
    taught, one_round = [], lm.train_round
    monkeypatch.setattr(lm, "train_round", lambda *args: taught.append(one_round(*args)))
    _, stats, model = lm.fit(df, lm.not_held_out)
    assert sum(taught) == stats.tokens == 4 * sum(teaches_brute(d) for d, _ in docs) and min(taught) > 0
    again = lm.fit(df, lm.not_held_out)[2]
    assert all((model.p[k] == again.p[k]).all() and np.isfinite(model.p[k]).all() for k in model.p)


def test_weights_do_not_depend_on_how_the_table_is_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 300)
    rnd = random.Random(9)
    docs = [(i, " ".join(rnd.choice("ab cd ef gh ij kl".split()) for _ in range(rnd.randrange(1, 60)))) for i in range(80)] + [(None, "x y")] * 3
    own = spark.createDataFrame(docs, "doc_id long, text string")
    models = []
    for df in (own.coalesce(1), own.repartition(7), own.orderBy(F.desc("doc_id")).repartition(3)):
        _, stats, model = lm.fit(df, lambda c: F.lit(True), rounds=2, words=8, rare=2, known=16)
        models.append(model.p)
    assert lm.trainers_of(stats.tokens) > 3
    for other in models[1:]:
        assert all(np.array_equal(models[0][k], other[k]) for k in models[0])


def test_row_sums_are_those_of_add_at():
    rnd = np.random.default_rng(4)
    rows, values = rnd.integers(0, 9, 50), rnd.standard_normal((50, 3)).astype(np.float32)
    seen, sums = gru._row_sums(rows, values)
    table = np.zeros((9, 3), np.float32)
    np.add.at(table, rows, values)
    assert seen.tolist() == sorted(set(rows.tolist())) and np.allclose(table[seen], sums, atol=1e-5)


def test_words_are_counted_and_coded_the_same_whatever_the_chunks(spark, monkeypatch):
    docs = corpus(60)
    df = spark.createDataFrame(docs, DDL)
    want = Counter(w.encode() for _, t in docs for w in split(t))
    counts = lm.token_counts(df)
    assert {bytes(r["word"]): r["count"] for r in counts.collect()} == want
    stats = lm.statistics(counts, words=40, rare=8, known=100)
    scorer = lm.Scorer(stats, GatedModel(np.array([c for _, c in stats.top[:40]], float), stats.rare_tokens))
    texts = pa.array([t for _, t in docs]).cast(pa.binary())
    top, found = [w for w, _ in stats.top], []
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(lm, "CHUNK_BYTES", size)
        found.append(scorer.encode(texts))
    for slots, base, score, known, others in found:
        for (_, t), own, n in zip(docs, slots, known):
            words = [w.encode() for w in split(t)]
            at = [top.index(w) if w in top else -1 for w in words]
            assert own.tolist() == [i if 0 <= i < 40 else 40 + lm.rare_class(w, 8) for i, w in zip(at, words)]
            assert n == sum(i >= 0 for i in at)
        assert base == pytest.approx(found[0][1]) and score == pytest.approx(found[0][2])
        seen = Counter()
        for row, pairs in enumerate(lm._listed(others, len(docs)).to_pylist()):
            for p in pairs:
                seen[row, p["word"]] += p["times"]
        assert seen == Counter((row, w.encode()) for row, (_, t) in enumerate(docs) for w in split(t) if w.encode() not in top)


def test_rare_classes_are_those_of_each_word():
    rnd = random.Random(6)
    words = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(7))) for _ in range(500)]
    assert lm.rare_classes(pa.array(words, pa.binary())[3:], 7).tolist() == [lm.rare_class(w, 7) for w in words[3:]]


def test_windows_reuse_their_memory_and_large_logits_are_kept_in_range():
    rnd = np.random.default_rng(5)
    model = GatedModel(rnd.integers(1, 50, 100).astype(float), np.ones(3))
    docs = [rnd.integers(0, 103, 60) for _ in range(30)]
    model.train(docs)
    held = dict(model.spaces)
    model.train(docs)
    assert held and all(model.spaces[k] is v for k, v in held.items())
    states = rnd.standard_normal((40, model.hidden)).astype(np.float32)
    slots = rnd.integers(0, 103, 40)
    plain = model.log_probs(states, slots)
    for name in ("bias_class", "bias_word"):
        model.p[name] += 300            # a softmax is the same with any number added to a row
    assert model.log_probs(states, slots) == pytest.approx(plain, abs=1e-3)
    every = model.log_probs(np.repeat(states[:1], 103, axis=0), np.arange(103))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
