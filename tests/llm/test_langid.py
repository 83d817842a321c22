import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from pulse.llm import langid as L
from pulse.llm.queries import op12_language_id

SF = "/root/testdata/sf0.01"


def _net():
    net = L.new_net(["aa", "bb", "cc"], np.random.default_rng(3))
    net.bias += 0.1
    return net


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    net = _net()
    codes = rng.integers(97, 123, (20, 6))
    codes[12:, 0] = L.PAD
    wanted = np.array([0, 1, 2, 0, 1, 2])
    _, grads = L.gradients(net, codes, wanted)
    for x, g in zip(net.params(), grads):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in x.shape)
            was, h = x[at], 1e-6
            x[at] = was + h
            up = L.gradients(net, codes, wanted)[0]
            x[at] = was - h
            down = L.gradients(net, codes, wanted)[0]
            x[at] = was
            assert abs((up - down) / (2 * h) - g[at]) < 1e-5


def _by_hand(net, window, steps=L.WINDOW):
    """Probabilities of one window by plain loops; filters start at the first ``steps`` bytes."""
    h = []
    for filters in net.filters:
        width = len(filters)
        values = [sum(net.embed[window[t + j]] @ filters[j] for j in range(width)) for t in range(min(steps, len(window) - width + 1))]
        h.append(np.max(values, 0) if values else np.full(L.FILTERS, -1e9))
    z = np.maximum(np.concatenate(h) + net.bias, 0) @ net.out + net.out_bias
    e = np.exp(z - z.max())
    return e / e.sum()


def test_fixed_point_tables_agree_with_the_network():
    net, rng = _net(), np.random.default_rng(6)
    scorer = L.Scorer(net)
    texts = ["ab", "a", "Hello, wörld! " * 3, "".join(map(chr, rng.integers(97, 123, 255))), "x" * 256]
    got = scorer.texts([t.encode() for t in texts])
    for text, p in zip(texts, got):
        assert np.abs(_by_hand(net, list(text.lower().encode())) - p).max() < 0.02


def test_windows_of_long_texts_are_weighted_by_letters(monkeypatch):
    net = _net()
    scorer = L.Scorer(net)
    one, two = b"abcdefgh" * 32, b"1234 xy " * 32
    reach = max(L.WIDTHS) - 1
    first = _by_hand(net, list(one + two[:reach]))      # a window sees the start of the next
    second = _by_hand(net, list(two))
    mean = (first * 256 + second * 64) / 320
    assert np.abs(scorer.texts([one + two])[0] - mean).max() < 0.02
    long = (one + two) * 40
    whole = scorer.texts([long])[0]
    monkeypatch.setattr(L, "SCORED_AT_ONCE", 8)         # the same in pieces
    assert np.abs(scorer.texts([long])[0] - whole).max() < 1e-9


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score string, key string, at int"
    rows = [(1, "hello there", "en", "x", "k", 1), (2, None, "en", "x", "k", 1), (3, "", "de", "x", "k", 1), (4, "123 - !", None, "x", "k", 1),
            (None, "ünd das", "de", "x", "k", 1), (5, "hello there", "en", "x", "k", 1), (5, "hello there", "en", "x", "k", 1),
            (6, "w" * 300_000, "en", "x", "k", 1), (7, "日本", None, "x", "k", 1)]
    df = spark.createDataFrame(rows, schema)
    net = L.fit(df, epochs=1)
    assert net.langs == ["en"]
    got = [tuple(r) for r in L.predict(df, net).collect()]
    assert [(i, lang) for i, lang, _ in got] == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "en"), (5, "en"), (5, "en"),
                                                (6, "en"), (7, "en")]
    assert all(0 <= s <= 1 for *_, s in got) and got[5] == got[6] and got[1][2] == 0
    none = L.fit(df.where("lang is null"))
    assert none is None and {r["lang_pred"] for r in L.predict(df, none).collect()} == {"und"}
    assert L.predict(df.limit(0), net).collect() == []


def test_sample_is_bounded_and_whole_texts_are_seen(spark):
    df = spark.range(200).select("id", F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
                                 F.concat(F.repeat(F.lit("ab "), 4000), F.lit("zz end")).alias("text"))
    windows, langs = L.teaching_windows(df, per_lang=7)
    assert len(windows) == 7 * L.DOC_WINDOWS and set(langs) == {"en"}
    assert sum(b"zz end" in w for w in windows) == 7 and max(map(len, windows)) == L.WINDOW


def test_held_out_accuracy(spark):
    rows = duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet'").fetchall()
    truth = {i: lang for i, _, lang in rows}
    got = {r["doc_id"]: r for r in op12_language_id(spark, SF).collect()}
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"] and truth[i]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.98 * len(held)
