"""Small helpers the operators share: stored tables, ASCII lower case, hash keys, word tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# The two word classes of the contracts.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Byte tables for ``bytes.translate``: A-Z lower-cased, everything that is no
# word byte turned into a blank (all bytes of non-ASCII characters are word bytes).
PLAIN_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else (b if b >= 128 else 32)
                    for b in range(256))
SPACED_TABLE = bytes(32 if b == 32 or 9 <= b <= 13 else (b + 32 if 65 <= b <= 90 else b)
                     for b in range(256))


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_ROWS = 1_000_000  # of a few longs each


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage (a lost executor never recomputes what is stored), fixes
    generated row numbers, and gives the optimizer the table's true size.  The
    shuffle files of the write are dropped with it: nobody reads them again.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, label), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` has returned.  For tables that no plan still to run reads: an operator frees what the
    tables it goes on with have replaced."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sized(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored narrow table, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(stored) if stored.count() <= most else stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(col: Column) -> Column:
    """An id as text; null as the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``: a fold that no model may choose."""
    return F.crc32(id_text(col)) % n


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its position (from 0) in a total order, without a one-task sort.

    Rows are range-partitioned and numbered inside their partition; only one
    count per partition meets in one task.
    """
    s = saved(df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__part", F.spark_partition_id())
              .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    from pyspark.sql import Window
    per = s.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    off = per.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__off"))
    out = s.join(off, "__part").withColumn(name, F.col("__off") + F.col("__pos")).drop("__part", "__pos", "__off")
    out.saved_at = s.saved_at       # for ``free``, once the result is stored
    return out


def text_slices(batch: pa.RecordBatch, at: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices that end where the texts of column ``at`` reach ``most`` bytes, so that what a task returns is never
    held as a second batch of full size."""
    lo = held = 0
    for hi, size in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), 1):
        held += size
        if held >= most:
            yield batch.slice(lo, hi - lo)
            lo, held = hi, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def word_pieces(data: bytes, size: int = 4 << 20):
    """Lists of the blank-separated words of ``data``, cut at blanks after ``size`` bytes each."""
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + size) if lo + size < len(data) else -1
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi
