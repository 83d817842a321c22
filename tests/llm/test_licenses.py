import random
import re

from pulse.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places})


def texts():
    rnd = random.Random(6)
    vocab = "under the mit license apache version 2 cc by nc Licensed word É".split()
    out = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 40))) for _ in range(150)]
    return out + [None, "", "cc", "CC-BY/NC cc by nc by nc", "Under the MIT License. " * 500, "x " * 5000 + "apache license, version 2.0"]


def test_base_places_equal_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "cc by nc"), (1, "cc by nc"), (1, "cc by nc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as label", "1 as grams", "2 as first")
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
           for r in L.license_labels(df).collect()]
    assert sorted(got, key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    assert all(set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1 for r in L.license_labels(df).collect())
    assert L.license_labels(df.limit(0)).collect() == []


def test_notices_are_found_with_words_put_in_or_left_out(spark):
    gpl = next(t.words for t in L.NOTICES if "free software" in t.words)
    words = gpl.split()
    rows = [(1, gpl), (2, " ".join(words[:10] + ["really"] + words[10:])), (3, " ".join(words[:4] + words[5:])),
            (4, " ".join(words[:12])), (5, gpl.replace("version 3", "version 2")),
            (6, "Released under the GNU General Public License, version 2, licensed under the"), (7, " ".join(reversed(words)))]
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in L.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["gpl-3"], 0), 2: (["gpl-3"], 0), 3: (["gpl-3"], 0), 4: ([], 0), 5: ([], 0), 6: ([], 0), 7: ([], 0)}


def test_texts_are_read_once(spark, scratch):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{scratch}/documents")
    found = L.license_labels(spark.read.parquet(f"{scratch}/documents"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(scratch in f for f in found.inputFiles()) and "regexp" not in plan and "MapInArrow" not in plan
    assert sorted((r["doc_id"], r["n_base"]) for r in found.collect()) == [(d, brute(t)[1]) for d, t in rows]


def test_grams_are_found_across_pieces_of_a_text():
    rnd = random.Random(3)
    for k in (1, 2, 3):
        grams = [tuple(rnd.choice("abcd") for _ in range(k)) for _ in range(8)]
        numbers = L.GramNumbers(grams, k)
        assert len(set(zip(grams, numbers.of.tolist()))) == len(set(grams)) == len(set(numbers.of.tolist()))
        for size in (0, 1, 2, 3, 40):
            words = [rnd.choice("abcdx") for _ in range(size)]
            want = [(i, dict(zip(grams, numbers.of.tolist()))[g]) for i in range(size - k + 1) if (g := tuple(words[i:i + k])) in grams]
            for piece in (1, 7, 4 << 20):
                n, at, number = numbers.find(" ".join(words).encode(), piece)
                assert (n, list(zip(at.tolist(), number.tolist()))) == (size, want)
    assert L.GramNumbers([], 3).find(b"a b c d")[0] == 4
