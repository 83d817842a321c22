import random

import pytest
import test_decontam
import test_line_dedup
import test_simhash

import corpus_pipeline
from pulse.llm import decontam, mixing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(12)
    words = ["w%d" % i for i in range(500)]
    items = [" ".join(rnd.choice(words) for _ in range(20)) for _ in range(5)]
    boiler = " ".join(rnd.choice(words) for _ in range(60))
    docs, labels = [], []
    for i in range(160):
        lines = [" ".join(rnd.choice(words) for _ in range(rnd.choice([3, 12, 40]))) for _ in range(rnd.randrange(1, 5))]
        kind, toxic = i % 8, 0
        if kind == 1:
            lines.append(boiler)
        elif kind == 2 and docs:
            lines = docs[rnd.randrange(len(docs))][1].split("\n")
        elif kind == 3:
            lines = [f"{rnd.choice(['idiot', 'clown', 'scum'])} {lines[0]}"] + lines[1:]
            toxic = 1
        elif kind == 4:
            lines.append(rnd.choice(items).upper())
        elif kind == 5:
            lines += [" ".join(rnd.choice(words) for _ in range(500)), "see: " + rnd.choice(items) + "."]
        text = "\n".join(lines)
        docs.append((i, text, "en", rnd.choice(["a", "a", "b", None]), len(text)))
        labels.append((i, 1, toxic))
    docs += [(900, None, None, "b", None), (901, "", "en", "a", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    for name, rows, ddl in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                            ("labels", labels, "doc_id long, quality int, toxic int"),
                            ("benchmark", list(enumerate(items)), "item_id long, text string")):
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")
    return path


def read(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "mix"]
    stage = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), teaches=toxicity.not_held_out)
    values, before = model.values(), read(docs)
    out = stage["toxicity"](spark, docs, sf_dir).checkpoint()
    assert out.columns == COLUMNS
    got = read(out)
    assert got == {d: r for d, r in before.items() if model.score((r["text"] or "").encode(), values) < 0.7}

    before = got
    out = stage["line_dedup"](spark, out, sf_dir).checkpoint()
    got, gone = read(out), test_line_dedup.brute([(d, r["text"]) for d, r in before.items()])
    for d, r in before.items():
        lines = (r["text"] or "").split("\n")
        want = None if r["text"] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone[(d, r["text"])][0])
        assert got[d]["text"] == want and got[d]["n_chars"] == (None if want is None else len(want))
    assert out.columns == COLUMNS and set(got) == set(before)

    before = got
    out = stage["simhash_dedup"](spark, out, sf_dir).checkpoint()
    ids = sorted(before)
    classes = test_simhash.brute_classes(ids, [test_simhash.brute_print(before[d]["text"]) for d in ids])
    got = read(out)
    assert got == {d: before[d] for d, c in zip(ids, classes) if c == d} and out.columns == COLUMNS

    before = got
    out = stage["decontamination"](spark, out, sf_dir).checkpoint()
    got = read(out)
    found = test_decontam.brute([(d, r["text"]) for d, r in before.items()], items, decontam.WINDOW)
    assert set(got) == {d for d, *_, bad in found if not bad} and out.columns == COLUMNS
    assert any(n for _, _, n, *_ in found)
    for d, _, hit, *_ in found:
        if d in got:
            assert (got[d]["text"] == before[d]["text"]) == (hit == 0)
            assert test_decontam.brute([(d, got[d]["text"])], items, decontam.WINDOW)[0][2] == 0

    plan = {r["doc_id"]: r["repeats"] for r in mixing.mix_plan(out).collect()}
    mixed = stage["mix"](spark, out, sf_dir).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in mixed) == sorted((d, c + 1) for d, n in plan.items() for c in range(n))


def test_run_applies_all_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == COLUMNS + ["copy"] and rows.count() > 50
