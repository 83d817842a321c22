import random
import re

import pytest
from pyspark.sql import functions as F

from pulse.llm import mixing

DDL = "doc_id long, text string, source string"


def corpus(n=300):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.choice([0, 1, 3, 10, 40]), rnd.choice(["a", "a", "a", "b", "c", "Z", None])) for i in range(n)]
    return rows + [(7, None, "a"), (None, "x y", "b"), (5, "p q r", "d"), (5, "p q r", "d")]


def water_fill(sizes, weights, goal, cap):
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        left = goal - sum(target[s] for s in sizes if s not in free)
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        for s in over or free:
            target[s] = cap * sizes[s] if over else share[s]
        free -= over
        if not over:
            break
    return target


def test_targets_equal_round_by_round_water_filling(spark):
    rows = corpus()
    plan = [r.asDict() for r in mixing.mix_plan(spark.createDataFrame(rows, DDL)).collect()]
    assert len(plan) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    ordered = sorted(sizes, key=lambda s: (s is None, s))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}, 1.5 * sum(sizes.values()), 2)
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["repeats"] * r["size"]
    for s, goal in want.items():
        taken = sum(r["taken"] for r in plan if r["source"] == s)
        longest = max(r["size"] for r in plan if r["source"] == s)
        assert abs(taken - goal) <= max(longest, 6)     # two equal rows share one decision


def test_reruns_agree_and_clashing_columns_do_not_matter(spark):
    df = spark.createDataFrame(corpus(60), DDL)
    extra = df.repartition(3).withColumns({c: F.lit("x") for c in ("size", "hash", "goal", "target", "cut", "copy")})
    a, b = (sorted(mixing.mix_plan(d).collect(), key=str) for d in (df, extra))
    assert a == b
    mixed = mixing.mix_documents(extra)
    assert mixed.columns == [*extra.columns, "copy_"]
    assert mixed.count() == sum(r["repeats"] for r in a)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], DDL)
    assert mixing.mix_plan(df.limit(0)).collect() == []
    assert {(r["target"], r["taken"]) for r in mixing.mix_plan(df).collect()} == {(0.0, 0)}


def test_a_column_called_like_the_copy_number_stays(spark):
    df = spark.createDataFrame([(1, "a b c", "s", 99), (2, "d e", "s", 98)], "doc_id long, text string, source string, copy int")
    mixed = mixing.mix_documents(df)
    assert mixed.columns == ["doc_id", "text", "source", "copy", "copy_"]
    rows = mixed.collect()
    assert rows and all(r["copy"] == 100 - r["doc_id"] and r["copy_"] >= 1 for r in rows)
