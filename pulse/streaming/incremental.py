"""Incremental bronze and silver tables with Structured Streaming.

Both are triggered runs (``availableNow``): drain what has landed, then stop.
The checkpoint records which files were processed, so a rerun adds only new
files (exactly-once per file into a Parquet sink) and an executor loss
replays the micro-batch from the checkpoint.  The steps are stateless maps,
so there is no state store and no watermark (the reference has no event-time
logic; late articles are covered because gold tables are recomputed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pulse.operators.clean import all_rules, apply_expectations, observe_expectations, silver_articles, to_bronze
from pulse.schemas import ARTICLE_LANDING
from pulse.sources.tables import read_landing_stream, stream_table


def _run(df: DataFrame, sink: str, checkpoint: str, name: str, timeout_s: float | None):
    q = (df.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).queryName(name).start())
    q.awaitTermination(timeout_s)  # raises if the query failed
    if q.isActive:
        # Not drained in time: stop it and fail, so no caller reads a partial table
        # as complete.  A rerun resumes from the checkpoint.
        q.stop()
        raise TimeoutError(f"stream {name} did not drain within {timeout_s} s")
    return q


def bronze_stream(spark: SparkSession, landing_path: str) -> DataFrame:
    """Landing files → typed bronze rows with source-file metadata."""
    return to_bronze(read_landing_stream(spark, landing_path), with_metadata=True)


def run_bronze_stream(spark: SparkSession, landing_path: str, bronze_path: str,
                      checkpoint: str, timeout_s: float | None = 600):
    """One triggered bronze run; returns the finished StreamingQuery."""
    return _run(bronze_stream(spark, landing_path), bronze_path, checkpoint,
                "bronze_articles", timeout_s)


def bronze_schema(spark: SparkSession):
    """The fixed schema of the bronze table, so that an empty table can be streamed too."""
    empty = to_bronze(spark.createDataFrame([], ARTICLE_LANDING)).schema
    return T.StructType([*empty.fields, T.StructField("_source_file", T.StringType()),
                         T.StructField("_file_modified_at", T.TimestampType())])


def silver_stream(spark: SparkSession, bronze_path: str) -> DataFrame:
    """Bronze files → cleaned silver rows, violations of every rule observed per batch, before the
    drop rules remove rows."""
    bronze = stream_table(spark, bronze_path, bronze_schema(spark))
    counted = observe_expectations(silver_articles(bronze, expectations=False), rules=all_rules())
    return apply_expectations(counted)


def run_silver_stream(spark: SparkSession, bronze_path: str, silver_path: str,
                      checkpoint: str, timeout_s: float | None = 600):
    return _run(silver_stream(spark, bronze_path), silver_path, checkpoint,
                "silver_articles", timeout_s)


def observed_metrics(query) -> list[dict]:
    """Per-batch expectation metrics from the query's progress reports."""
    out = []
    for p in query.recentProgress:
        m = getattr(p, "observedMetrics", None) or {}
        for name, row in m.items():
            out.append({"batch": p.batchId, "name": name, **row.asDict()})
    return out
