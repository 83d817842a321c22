"""The observed counts of every micro-batch, stored in a table.

``recentProgress`` is gone with the session; ``MetricsTable`` is a listener that appends one row per batch and observed
name: query, run, batch, the batch's own time, input rows, and the counts as a map.  Appends are keyed by (run, batch, name),
so a reader can tell a repeated report; ``read_metrics`` does.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = ("query STRING, query_id STRING, run_id STRING, batch LONG, at STRING, input_rows LONG, name STRING, "
           "counts MAP<STRING, LONG>")


def progress_rows(progress) -> list[tuple]:
    """The rows of one progress report; a batch without observations has one with an empty name."""
    seen = {name: {k: int(v) for k, v in row.asDict().items() if v is not None}
            for name, row in (progress.observedMetrics or {}).items()} or {"": {}}
    return [(progress.name, str(progress.id), str(progress.runId), progress.batchId, progress.timestamp,
             progress.numInputRows, name, counts) for name, counts in seen.items()]


class MetricsTable(StreamingQueryListener):
    """Appends every batch's observed counts to ``path``; use as a context manager around triggered runs."""

    def __init__(self, spark: SparkSession, path: str, wait_s: float = 60):
        self.spark, self.path, self.wait_s = spark, path, wait_s
        self._open: set[str] = set()
        self._seen = threading.Condition()
        self.errors: list[str] = []

    def onQueryStarted(self, event):
        with self._seen:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event):
        try:
            rows = progress_rows(event.progress)
            (self.spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(self.path))
        except Exception as e:  # noqa: BLE001  a listener's exception would be lost in the listener bus
            self.errors.append(f"{type(e).__name__}: {e}")

    def onQueryTerminated(self, event):
        with self._seen:
            self._open.discard(str(event.runId))
            self._seen.notify_all()

    def __enter__(self):
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, kind, value, trace):
        with self._seen:
            done = self._seen.wait_for(lambda: not self._open, self.wait_s)
        self.spark.streams.removeListener(self)
        if kind is None and self.errors:
            raise RuntimeError(f"metrics were not stored: {self.errors[0]}")
        if kind is None and not done:
            raise TimeoutError(f"queries have not ended within {self.wait_s} s")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per run, batch and observed name."""
    return spark.read.schema(METRICS).parquet(path).dropDuplicates(["run_id", "batch", "name"])


def totals(metrics: DataFrame) -> DataFrame:
    """The counts of all batches added up: query, name, metric, value."""
    return (metrics.select("query", "name", F.explode("counts").alias("metric", "n"))
            .groupBy("query", "name", "metric").agg(F.sum("n").alias("value")))
