"""K1: answers are committed batch by batch, and a run that failed goes on where it stopped."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulse.operators.enrich import prompt_hash
from pulse.streaming.enrichment import EnrichmentStore, ModelUnavailable, enrich_resumable


def _model(folder, fails_at=None):
    """Answers a prompt by its upper case; logs every prompt; the call ``fails_at`` (once) or on 'bad' prompts."""
    log, mark = f"{folder}/asked.txt", f"{folder}/failed-once"

    def call(prompts):
        seen = sum(1 for _ in open(log)) if os.path.exists(log) else 0
        if fails_at is not None and seen >= fails_at and not os.path.exists(mark):
            open(mark, "w").close()
            raise ModelUnavailable("down")
        with open(log, "a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return [p.upper() for p in prompts]
    return call, log


def _asked(log):
    return Counter(open(log).read().split("\n")[:-1])


def test_a_run_that_fails_in_its_third_batch_asks_nothing_twice(spark, scratch):
    df = spark.range(40).select("id", F.when(F.col("id") < 38, F.concat(F.lit("p"), (F.col("id") % 20).cast("string"))).alias("p"))
    call, log = _model(scratch, fails_at=8)
    options = {"batch_size": 4, "prompts_per_file": 4, "files_per_batch": 1}
    df = df.repartition(1)
    with pytest.raises(Exception):
        enrich_resumable(df, F.col("p"), call, f"{scratch}/s", **options)
    work = EnrichmentStore(spark, f"{scratch}/s")
    kept = work.answers().count()
    assert 8 <= kept < 20 and kept == sum(_asked(log).values())     # the first batches are committed
    got = {r["id"]: r["answer"] for r in enrich_resumable(df, F.col("p"), call, f"{scratch}/s", **options).collect()}
    assert got == {i: f"P{i % 20}" if i < 38 else None for i in range(40)}
    assert set(_asked(log).values()) == {1} and len(_asked(log)) == 20
    # a third run asks only what is new
    more = df.union(spark.createDataFrame([(99, "new")], df.schema))
    assert enrich_resumable(more, F.col("p"), call, f"{scratch}/s", **options).where("answer is null").count() == 2
    assert _asked(log) == Counter({f"p{i}": 1 for i in range(20)} | {"new": 1})


def test_failed_prompts_are_listed_and_asked_again_a_bounded_number_of_times(spark, scratch):
    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, None)], "id int, p string")
    call, log = _model(scratch)
    for run in range(1, 4):
        got = {r["id"]: r["answer"] for r in enrich_resumable(df, F.col("p"), call, f"{scratch}/s", batch_size=1,
                                                              max_attempts=2).collect()}
        assert got == {1: "GOOD", 2: None, 3: None}
        failed = EnrichmentStore(spark, f"{scratch}/s").failures().collect()
        assert [(r["prompt"], r["attempts"]) for r in failed] == [("bad one", min(run, 2))] and "refused" in failed[0]["error"]
    assert _asked(log) == Counter({"good": 1, "bad one": 2})


def test_empty_input(spark, scratch):
    call, _ = _model(scratch)
    df = spark.createDataFrame([], "id int, p string")
    assert enrich_resumable(df, F.col("p"), call, f"{scratch}/s").collect() == []


def test_listings_of_the_calls_do_not_grow_with_the_batches(spark, scratch, monkeypatch):
    listed, calls = [], EnrichmentStore.calls
    monkeypatch.setattr(EnrichmentStore, "calls", lambda self: listed.append(1) or calls(self))
    call, _ = _model(scratch)
    seen = []
    for n in (4, 24):
        df = spark.range(n).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("p")).repartition(1)
        listed.clear()
        got = enrich_resumable(df, F.col("p"), call, f"{scratch}/s{n}", batch_size=1, prompts_per_file=2, files_per_batch=1)
        assert {r["id"]: r["answer"] for r in got.collect()} == {i: f"P{i}" for i in range(n)}
        seen.append(len(listed))
    assert seen[0] == seen[1]


def test_a_prompt_queued_by_two_runs_is_asked_once(spark, scratch):
    call, log = _model(scratch)
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").withColumn("prompt_hash", prompt_hash(F.col("prompt")))
    work = EnrichmentStore(spark, f"{scratch}/s")
    for _ in range(2):
        work.queue(df.repartition(1), 1, 3)
    work.drain(call, 1, 1)
    assert _asked(log) == Counter({"a": 1, "b": 1})
