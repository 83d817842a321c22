import random
import re

import pytest
from pyspark.sql import functions as F

from pulse.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    grams = {}
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add(key)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                keys = grams.get(tuple(w[i:i + n]))
                if keys:
                    hit |= set(range(i, i + n))
                    found |= keys
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def tables(window):
    rnd = random.Random(window)
    vocab = ["a", "b", "c", "É", "ñ1", "zz"]

    def some(n):
        return " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, some(rnd.choice([1, 2, window - 1, window, window + 9]))) for i in range(25)]
    items += [(40, None), (41, "?! "), (42, items[3][1]), (43, "A " * 30)]
    docs = [(i, some(rnd.randrange(0, 60))) for i in range(60)]
    docs += [(i, some(30) + "-" + (items[i % 25][1]).upper() + "..." + some(300)) for i in range(60, 90)]
    return docs + [(None, None), (1, ""), (1, ""), (2, "a " * 3000)], items


@pytest.mark.parametrize("window,shard", [(13, 200_000), (4, 200_000), (4, 30)])
def test_hits_equal_brute_force(spark, window, shard):
    docs, items = tables(window)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = D.contamination(df, spark.createDataFrame(items, "item_id long, text string"), window=window, shard_words=shard)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got.collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, window), key=str)


def test_pieces_carry_the_state(monkeypatch):
    docs, items = tables(5)
    found = D.BenchmarkAutomaton([(k, t.encode().translate(D.PLAIN_TABLE).split()) for k, t in items if t], 5)
    whole = [found.scan((t or "").encode()) for _, t in docs]
    monkeypatch.setattr(D, "PIECE", 3)
    assert [found.scan((t or "").encode()) for _, t in docs] == whole


def test_contaminated_documents_go_and_spans_are_cut(spark):
    item = " ".join(f"q{i}" for i in range(20))
    clean, filler = "One clean text.", " ".join(f"f{i}" for i in range(900))
    docs = [(1, clean, 15, "x"), (2, f"Short {item}!", 9, None), (3, f"{filler}, {item.upper()}; end.", 0, "x"), (4, None, None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, spans string")
    kept = D.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == df.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert set(rows) == {1, 3, 4} and rows[1]["text"] == clean and rows[4]["text"] is None
    assert rows[3]["text"] == f"{filler}, ; end." and rows[3]["n_chars"] == len(rows[3]["text"])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(df, empty).count() == 4 and D.decontaminate(df.where(F.lit(False)), empty).count() == 0


def test_pieces_without_words_keep_the_state(monkeypatch):
    found = D.BenchmarkAutomaton([(1, b"a b c d e".split())], 5)
    monkeypatch.setattr(D, "PIECE", 3)
    assert found.scan(b"x a b c" + b" ,." * 20 + b" d e y") == (7, [(1, 5)], {0})
    assert found.scan(b" " * 40) == (0, [], set())
