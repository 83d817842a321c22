import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulse.llm import simhash
from pulse.llm.components import components


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(ids, prints, bits=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def texts():
    rnd = random.Random(3)
    words = ["w%d" % i for i in range(60)] + ["É", "ß", " x", "Ab"]
    out = [None, "", "  \t ", "one", "ONE two", "one  two", "a b c", "a\nb\x0bc d"]
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 20, 200]))]
        out.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 3])):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append("  ".join(copy))
    return out + [out[10]] * 5


def test_fingerprints_and_classes_equal_brute_force(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts())] + [(None, "one"), (3, "one"), (3, "one")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [brute_print(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], prints, brute_classes([d for d, _ in rows], prints)), key=str)
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=str) == want


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join("w%d" % (i * i % 977) for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    pieces = simhash.word_pieces
    monkeypatch.setattr(simhash, "word_pieces", lambda data, size: pieces(data, 7))
    assert simhash.fingerprint(text.encode()) == whole == simhash._signed(brute_print(text))


@pytest.mark.parametrize("bits,block", [(3, 4), (3, 1024), (0, 8), (5, 16)])
def test_links_span_all_pairs_in_reach_also_when_lists_are_cut(spark, bits, block):
    rnd = random.Random(bits)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) & (1 << 64) - 1
              for b in base for _ in range(30)} | {0, (1 << 64) - 1}
    prints = sorted(simhash._signed(p & (1 << 64) - 1) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    roots = {r[0]: r[1] for r in components(simhash.links(df, bits, block)).collect()}
    want = brute_classes(prints, prints, bits)
    assert [roots.get(p, p) for p in prints] == want


def test_one_row_of_each_class_stays(spark):
    rows = [(5, "x y z"), (2, "X y  z"), (2, "X y  z"), (None, "x y z"), (9, None), (8, ""), (7, "other words stand here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("clash"))
    kept = simhash.keep_one_per_class(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    order = list(range(40))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {(r[0], r[1]) for r in components(df).collect()} == {(i, 0) for i in range(1, 40)}
