"""Keep the first record per URL across runs, with a stored Bloom filter per run.

A run keeps the records whose URL no earlier run has kept.  An anti-join against all known URLs would shuffle every
incoming record and every known URL.  Each run therefore also stores a Bloom filter of its URLs, cut into blocks of
``BLOCK_BITS`` bits (a URL's probes all lie in one block, so a filter is a table of small bitmaps built by one
aggregate).  The filters of all runs are or'ed by block; incoming URLs that miss are surely new and go straight through.
Only probable repeats are looked up, by a semi-join that their URLs enter alone, and dropped by an exact anti-join; repeats are
gone before the shuffle that finds the first record per URL.

The or'ed filter is broadcast while it has at most ``BROADCAST_BLOCKS`` blocks; beyond that it is joined by block number, which
shuffles keys and bitmaps only where needed, or left out, which shuffles every record: the result is the same.

Layout under ``store``: ``urls/run=…`` (url) and ``filters/run=…`` (block, bits); both are overwritten by a rerun of the
same run, which neither doubles nor loses records.  Run ids sort in the order of the runs: a run looks at smaller ids
only, so rerunning an old one gives its old result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.operators.filters import first_per_key
from pulse.sources.store import stored

BLOCK_BITS = 32_768      # of one block: what one bitmap of ``bitmap_construct_agg`` holds, 4096 bytes
BITS_PER_URL = 12
PROBES = 4               # bits a URL sets
BROADCAST_BLOCKS = 16_384   # 64 MB of bitmaps


def _probes(key: Column) -> list[Column]:
    """A URL's bit numbers inside its block: double hashing."""
    one, two = (F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in (1, 2))
    return [F.pmod(one + (two.bitwiseOR(F.lit(1))) * i, F.lit(BLOCK_BITS)) for i in range(PROBES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(blocks)).cast("int")


def bloom_blocks(urls: DataFrame, blocks: int, key: str = "url") -> DataFrame:
    """The filter of ``urls``: block, bits (4096 bytes); one partial aggregate."""
    return (urls.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_probes(F.col(key)))).alias("bit"))
            .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")))


def _is_set(bits: Column, bit: Column) -> Column:
    """Whether a bitmap has a bit; null (no such block) is false."""
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1, F.lit(False))


def probably_in(df: DataFrame, filters: DataFrame, blocks: int, key: str = "url") -> DataFrame:
    """``df`` with ``_probable``: false only if no filter holds the URL."""
    hit = F.lit(True)
    for bit in _probes(F.col(key)):
        hit = hit & _is_set(F.col("_bits"), bit)
    named = filters.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    return (df.withColumn("_block", _block(F.col(key), blocks)).join(named, "_block", "left")
            .withColumn("_probable", hit).drop("_block", "_bits"))


class KnownUrls:
    """The URLs that earlier runs have kept, with their filters."""

    def __init__(self, spark, store: str, blocks: int = 1024):
        """``blocks``: of every run's filter; ``BITS_PER_URL`` bits a URL of all runs together keep misses rare
        (1024 blocks: 2.8 million URLs)."""
        self.spark, self.root, self.blocks = spark, store.rstrip("/"), blocks

    def _read(self, name: str, ddl: str, run: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{ddl}, run STRING").parquet(f"{self.root}/{name}").where(F.col("run") < run)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], f"{ddl}, run STRING")
            raise

    def urls(self, before: str) -> DataFrame:
        return self._read("urls", "url STRING", before).select("url")

    def filter(self, before: str) -> DataFrame:
        """The or'ed blocks of the runs before ``before``."""
        return self._read("filters", "block INT, bits BINARY", before).groupBy("block").agg(
            F.bitmap_or_agg("bits").alias("bits"))

    def new_records(self, records: DataFrame, order: Sequence[Column], run: str) -> DataFrame:
        """The first record per non-empty URL, of URLs that no run before ``run`` has kept."""
        filters = self.filter(run)
        if self.blocks <= BROADCAST_BLOCKS:
            filters = F.broadcast(filters)      # at most one row of 4 KB a block
        marked = probably_in(records.where(F.col("url").isNotNull() & (F.col("url") != "")), filters, self.blocks)
        probable = marked.where("_probable")
        # the known URLs among the probable repeats: narrow, and few unless most of the batch is repeated
        repeated = self.urls(run).join(probable.select("url").distinct(), "url", "left_semi")
        fresh = marked.where(~F.col("_probable")).unionByName(probable.join(repeated, "url", "left_anti"))
        return first_per_key(fresh.drop("_probable"), ["url"], list(order))

    def commit(self, kept: DataFrame, run: str) -> None:
        """Store the URLs of a run and their filter; ``kept`` should be a stored table."""
        for name, rows in (("urls", kept.select("url")), ("filters", bloom_blocks(kept, self.blocks))):
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")


def keep_new(records: DataFrame, order: Sequence[Column], store: str, run: str, blocks: int = 1024) -> DataFrame:
    """One run: its new records, stored, with their URLs committed."""
    known = KnownUrls(records.sparkSession, store, blocks)
    kept = stored(known.new_records(records, order, run), "new-records")
    known.commit(kept, run)
    return kept
