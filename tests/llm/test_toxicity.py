import random

import pytest

from pulse.llm import toxicity as X

RUDE = ["idiot", "scumbag", "vequlo", "vequra", "vequmi"]


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.3
        sentences = [[rnd.choice(words) for _ in range(rnd.randrange(2, 12))] for _ in range(rnd.randrange(1, 8))]
        if bad:
            rnd.choice(sentences).insert(0, rnd.choice(RUDE).upper())
        docs.append((i, ". ".join(map(" ".join, sentences))))
        labels.append((i, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return X.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), teaches=X.not_held_out)


def test_held_out_documents_are_told_apart(spark, fitted):
    docs, labels = corpus(seed=9)
    got = X.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"), fitted).collect()
    truth = dict(labels)
    hits = [(r["score"] >= X.THRESHOLD) == bool(truth[r["doc_id"]]) for r in got]
    assert sum(hits) / len(hits) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_score_is_the_noisy_or_of_the_sentences(fitted):
    values, text = fitted.values(), b"w1 w2. Idiot w3 w3!\n\n vequnew w5 ... w9"
    stay = 1.0
    for _, _, z in fitted.sentences(text, values):
        stay *= 1 - 1 / (1 + 2.718281828459045 ** -z)
    assert fitted.score(text, values) == pytest.approx(1 - stay)
    assert fitted.score(b"", values) == fitted.score(None, values) == fitted.score(b"?!. \n", values) == 0.0
    assert fitted.score(text + b" w4" * 200_000, values) > 0.7


def test_offending_sentences_are_located(spark, fitted):
    docs = [(1, "w1 w2. You idiot w7. w3"), (2, "w1 w5."), (3, None), (1, "w1 w2. You idiot w7. w3")]
    found = X.offending_sentences(spark.createDataFrame(docs, "doc_id long, text string"), fitted).collect()
    assert [(r["doc_id"], r["sentence"], r["text"]) for r in found] == [(1, 1, "You idiot w7")] * 2


def test_rejected_documents_go_and_columns_stay(spark, fitted):
    df = spark.createDataFrame([(1, "an idiot here", "x", 3), (2, "w1 w2", None, 1), (None, None, "y", 2)],
                               "doc_id long, text string, score string, label int")
    kept = X.drop_toxic(df, fitted)
    assert kept.columns == df.columns and sorted(kept.collect(), key=str) == sorted(df.where("text is null or text like 'w%'").collect(), key=str)
    assert X.drop_toxic(df.limit(0), fitted).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    for labels in ([], [(1, None), (None, 1)], [(1, 1), (1, 0)]):
        model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert X.toxicity_scores(docs, model).first()["score"] == 0.0


def test_a_capped_label_counts_by_its_share_of_all_documents(spark):
    docs = [(i, f"text {i}", int(i % 10 == 0)) for i in range(100)]
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(i, 0) for i in range(1000, 1200)], "doc_id long, toxic int")
    sample = X.labelled_sample(
        spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), labels, id_col="doc_id", text_col="text",
        label_id_col="doc_id", label_col="toxic", teaches=lambda c: c >= 0, per_label=20)
    assert sorted(zip(*sample[1:])) == [(0, 4.5)] * 20 + [(1, 1.0)] * 10      # label rows without a document take no place
    texts, labels = [b"bad word here", b"bad day", b"bad luck", b"good word", b"fine day"], [1, 1, 1, 0, 0]
    twice = X.train(texts + texts[3:] * 3, labels + [0] * 6)
    assert X.train(texts, labels, [1, 1, 1, 4, 4]).bias == pytest.approx(twice.bias, abs=0.01)
