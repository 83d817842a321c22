"""K1: model enrichment that commits its answers in small steps and resumes.

The distinct prompts still without an answer are written once, ``prompts_per_file`` to a file: that table is a work list.
A triggered file stream drains it; each micro-batch takes ``files_per_batch`` files, calls the model in its
tasks and commits answers and failures before the next one starts.  A run that stops after any batch loses
only that batch: the checkpoint knows which files are done, and a batch that runs again asks nothing that is
answered already.  What a run costs is therefore paid once, whatever fails later.

Layout under ``store``::

    prompts/                       work lists: prompt_hash, prompt
    calls/status=answered/batch=N  prompt_hash, answer
    calls/status=failed/batch=N    prompt_hash, prompt, error
    _checkpoint/                   which files are done

A call that raises fails the prompts it was given (they are asked again by later runs, ``max_attempts`` times in
all); ``ModelUnavailable`` stops the run instead, and nothing of the batch counts.  Prompts are told apart by
their SHA-256; null prompts are not asked and get a null answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.operators.enrich import PromptFn, Responder, prompt_hash

PROMPTS = "prompt_hash STRING, prompt STRING"
CALLS = "prompt_hash STRING, prompt STRING, answer STRING, error STRING, status STRING, batch LONG"
ANSWERED, FAILED = "answered", "failed"


class ModelUnavailable(RuntimeError):
    """Raised by a model call to end the run instead of counting its prompts as failed."""


def _caller(call: PromptFn, batch_size: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        for pdf in batches:
            prompts, answers, errors = pdf["prompt"].tolist(), [], []
            for i in range(0, len(prompts), batch_size):
                some = prompts[i:i + batch_size]
                try:
                    got = list(call(some))
                    if len(got) != len(some):
                        raise ValueError(f"{len(got)} answers to {len(some)} prompts")
                    answers += got
                    errors += [None if a is not None else "no answer" for a in got]
                except ModelUnavailable:
                    raise
                except Exception as e:  # noqa: BLE001  recorded, asked again by a later run
                    answers += [None] * len(some)
                    errors += [f"{type(e).__name__}: {e}"[:500]] * len(some)
            yield pd.DataFrame({"prompt_hash": pdf["prompt_hash"], "prompt": prompts, "answer": answers, "error": errors})
    return run


class EnrichmentStore:
    """The folder that holds work lists, answers and failures of one model step."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.root = spark, store.rstrip("/")

    def _found(self, name: str, ddl: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise  # an unreachable store must not look like an empty one: every prompt would be paid for again

    def _table(self, name: str, ddl: str) -> DataFrame:
        found = self._found(name, ddl)
        return self.spark.createDataFrame([], ddl).limit(0) if found is None else found

    def calls(self) -> DataFrame:
        """Every call so far.  Its files are listed here, once: what later batches store is not in it."""
        return self._table("calls", CALLS)

    def _answered_by(self, number: int) -> DataFrame:
        """The prompts that batch ``number`` has answered, from its own folder."""
        return self._table(f"calls/status={ANSWERED}/batch={number}", "prompt_hash STRING")

    def _waits_twice(self) -> bool:
        """Whether a prompt waits in the work list more than once, as runs that queue at the same time leave it."""
        queued = self._table("prompts", PROMPTS).groupBy("prompt_hash").agg(F.count(F.lit(1)).alias("queued")).where("queued > 1")
        asked = self.calls().groupBy("prompt_hash").agg(F.count(F.lit(1)).alias("asked"),
                                                        F.max(F.col("status") == ANSWERED).alias("ok"))
        left = queued.join(asked, "prompt_hash", "left").where(~F.coalesce("ok", F.lit(False)))
        return not left.where(F.col("queued") - F.coalesce("asked", F.lit(0)) > 1).isEmpty()

    def answers(self) -> DataFrame:
        """prompt_hash, answer; one row a prompt, the first batch's if runs at the same time asked twice."""
        return (self.calls().where(F.col("status") == ANSWERED).groupBy("prompt_hash")
                .agg(F.min_by("answer", "batch").alias("answer")))

    def failures(self) -> DataFrame:
        """Prompts without an answer so far: prompt_hash, prompt, attempts, error (of the last attempt)."""
        failed = (self.calls().where(F.col("status") == FAILED).groupBy("prompt_hash")
                  .agg(F.max_by("prompt", "batch").alias("prompt"), F.count(F.lit(1)).alias("attempts"),
                       F.max_by("error", "batch").alias("error")))
        return failed.join(self.calls().where(F.col("status") == ANSWERED).select("prompt_hash"), "prompt_hash", "left_anti")

    def queue(self, prompts: DataFrame, prompts_per_file: int, max_attempts: int) -> None:
        """Add the prompts that no call has answered, nor failed ``max_attempts`` times, to the work list."""
        calls = self.calls()
        done = calls.groupBy("prompt_hash").agg(
            F.max(F.when(F.col("status") == ANSWERED, 1).otherwise(0)).alias("ok"), F.count(F.lit(1)).alias("n")).where(
            (F.col("ok") == 1) | (F.col("n") >= max_attempts)).select("prompt_hash")
        (prompts.where(F.col("prompt").isNotNull()).join(done, "prompt_hash", "left_anti")
         .groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
         .write.mode("append").option("maxRecordsPerFile", prompts_per_file).parquet(f"{self.root}/prompts"))

    def drain(self, call: PromptFn, batch_size: int = 16, files_per_batch: int | None = None) -> int:
        """Ask every queued prompt; the number of micro-batches that ran.  Raises if one of them failed."""
        spark, many = self.spark, files_per_batch or self.spark.sparkContext.defaultParallelism
        if self._found("prompts", PROMPTS) is None:
            spark.createDataFrame([], PROMPTS).write.mode("append").parquet(f"{self.root}/prompts")
        ran: list[int] = []
        # the calls are listed once a drain: each batch would list the files of all before it
        before = self.calls().where(F.col("status") == ANSWERED).select("prompt_hash")
        twice = self._waits_twice()

        def commit(batch: DataFrame, number: int) -> None:
            own = EnrichmentStore(batch.sparkSession, self.root)
            # a batch that runs again after its answers were stored finds them here; so does the second of two equal prompts
            answered = (own.calls().where(F.col("status") == ANSWERED).select("prompt_hash") if twice
                        else own._answered_by(number))
            rows = (batch.join(answered, "prompt_hash", "left_anti")
                    .mapInPandas(_caller(call, batch_size), "prompt_hash STRING, prompt STRING, answer STRING, error STRING"))
            (rows.withColumn("status", F.when(F.col("error").isNull(), ANSWERED).otherwise(FAILED))
             .withColumn("prompt", F.when(F.col("error").isNotNull(), F.col("prompt"))).withColumn("batch", F.lit(number))
             .write.mode("append").partitionBy("status", "batch").parquet(f"{self.root}/calls"))
            ran.append(number)

        query = (spark.readStream.schema(PROMPTS).option("maxFilesPerTrigger", many).parquet(f"{self.root}/prompts")
                 .join(before, "prompt_hash", "left_anti").writeStream.foreachBatch(commit).option("checkpointLocation", f"{self.root}/_checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return len(ran)


def enrich_resumable(df: DataFrame, prompt: Column, call: PromptFn, store: str, out: str = "answer", *, batch_size: int = 16,
                     prompts_per_file: int = 1000, files_per_batch: int | None = None, max_attempts: int = 3) -> DataFrame:
    """``df`` with the model's answers to ``prompt`` in ``out``; committed batch by batch under ``store``.

    A work list left by a run that failed is drained first.  Prompts whose calls failed have a null answer
    (``EnrichmentStore.failures`` names them)."""
    work = EnrichmentStore(df.sparkSession, store)
    work.drain(call, batch_size, files_per_batch)
    hashed = df.withColumn("_prompt", prompt).withColumn("_prompt_hash", prompt_hash(F.col("_prompt")))
    work.queue(hashed.select(F.col("_prompt_hash").alias("prompt_hash"), F.col("_prompt").alias("prompt")),
               prompts_per_file, max_attempts)
    work.drain(call, batch_size, files_per_batch)
    answers = work.answers().select(F.col("prompt_hash").alias("_prompt_hash"), F.col("answer").alias(out))
    return hashed.drop("_prompt").join(answers, "_prompt_hash", "left").drop("_prompt_hash")


class ResumableResponder(Responder):
    """A remote model whose answers are committed in small steps under ``store``."""

    def __init__(self, call: PromptFn, store: str, **options):
        self.call, self.store, self.options = call, store, options

    def answer(self, df, prompt, out):
        return enrich_resumable(df, prompt, self.call, self.store, out, **self.options)
