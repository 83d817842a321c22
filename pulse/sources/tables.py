"""Sources and sinks: landing JSON lines, gold tables, run log, feeds, responses.

Paths are plain URIs (local, HDFS, object store): nothing here touches the
driver's file system except through Spark's readers and writers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.schemas import ARTICLE_LANDING, FEED_ITEM, LANDING_FIELDS, RESPONSE


# ---------------------------------------------------------------------------
# A1–A5 landing JSON lines
# ---------------------------------------------------------------------------
def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """A2/A3/A4: batch read with the explicit landing schema (no inference);
    malformed lines become all-NULL rows, which the bronze gate then drops."""
    return (spark.read.schema(ARTICLE_LANDING).option("mode", "PERMISSIVE")
            .option("recursiveFileLookup", "true").json(path))


def read_landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A1: incremental file source (each file processed once per checkpoint)."""
    r = (spark.readStream.schema(ARTICLE_LANDING).option("mode", "PERMISSIVE")
         .option("recursiveFileLookup", "true"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def write_landing(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Add records as JSON lines.  Under a tag they are the folder ``batch=<tag>/``, which a retried run
    replaces instead of doubling its batch; without one they are appended.

    One job; an empty input adds no record.  Absent envelope fields are written as NULL."""
    have = set(df.columns)
    out = df.select(*[(F.col(f) if f in have else F.lit(None)).cast("string").alias(f) for f in LANDING_FIELDS])
    if batch:
        out.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")
    else:
        out.write.mode("append").json(path)


# ---------------------------------------------------------------------------
# A6/A7/A11/A14 tables
# ---------------------------------------------------------------------------
def materialize(df: DataFrame, path: str, partition_by: Iterable[str] = (),
                sort_by: Iterable[str] = (), mode: str = "overwrite") -> None:
    """Full recompute of a dataset as Parquet.

    ``partition_by`` gives directory pruning; ``sort_by`` clusters rows inside
    each file so Parquet min/max statistics prune row groups (the stand-in for
    liquid clustering)."""
    part, sort = list(partition_by), list(sort_by)
    out = df
    if part or sort:
        out = out.sortWithinPartitions(*(part + sort))
    w = out.write.mode(mode)
    if part:
        w = w.partitionBy(*part)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan of an upstream dataset."""
    return spark.read.parquet(path)


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream from an upstream table's files (new files only)."""
    return spark.readStream.schema(schema).parquet(path)


# ---------------------------------------------------------------------------
# A12 run log with schema evolution
# ---------------------------------------------------------------------------
def append_run_log(df: DataFrame, path: str, run: str | None = None) -> None:
    """Add rows to the run log; those of a named run replace what the same run has written before."""
    if run:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run-{run}")
    else:
        df.write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Reads every batch; columns added later appear (NULL in old rows)."""
    return spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(path)


def run_log_view(raw: DataFrame) -> DataFrame:
    """L2: per-scraper rows only (``total`` rows are removed, as in the reference view)."""
    return raw.where(F.col("source_type").isNotNull() & (F.col("source_type") != "total")).select(
        "source_type", F.col("count").cast("int").alias("record_count"), "run_ts",
        F.current_timestamp().alias("_ingested_at"))



# ---------------------------------------------------------------------------
# A16/A17 re-aimed scraper inputs: landed feed XML and search responses
# ---------------------------------------------------------------------------
def read_feed_items(spark: SparkSession, path: str, feed_name_from_path: bool = True) -> DataFrame:
    """The items of landed feeds, RSS ``<item>`` and Atom ``<entry>`` (Spark's XML source).

    Atom's link attribute, content and published map to the RSS fields.  ``item_no`` follows the
    order in a file; feeds are files, so a file never mixes both kinds."""
    def rows(tag, schema):
        df = (spark.read.format("xml").option("rowTag", tag).schema(schema)
              .option("recursiveFileLookup", "true").load(path))
        if feed_name_from_path:
            df = df.withColumn("feed_name", F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1))
        return df.withColumn("item_no", F.monotonically_increasing_id())
    entry = rows("entry", "title STRING, link STRUCT<_href: STRING, _VALUE: STRING>, summary STRING, content STRING, "
                          "author STRUCT<name: STRING>, published STRING, updated STRING")
    shared = {"title": F.col("title"), "link": F.coalesce("link._href", "link._VALUE"), "summary": F.col("summary"),
              "description": F.col("content"), "author": F.col("author.name"), "pubDate": F.col("published"),
              "updated": F.col("updated")}
    items = rows("item", FEED_ITEM)
    entry = entry.select(*[shared.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FEED_ITEM.fields],
                         *[c for c in items.columns if c not in FEED_ITEM.fieldNames()])
    return items.unionByName(entry)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed search responses as JSON lines {topic, source_type, query, text}.

    ``position`` (file and its split, row) is the place in the collection: files in the order of their names, lines in the order
    of the file.  Ids of one split ascend with its lines."""
    split = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    return spark.read.schema(RESPONSE).json(path).withColumn(
        "position", F.struct(split.alias("file"), F.monotonically_increasing_id().alias("row")))


# ---------------------------------------------------------------------------
# A19 ad-hoc read-only SELECT over published views
# ---------------------------------------------------------------------------
# Functions that reach outside the query: they run code, or read what the views don't publish.
OUTSIDE = {"reflect", "java_method", "try_reflect", "input_file_name"}
_RELATION = ("UnresolvedRelation", "UnresolvedTableValuedFunction")


def _nodes(node, found: list) -> list:
    """A logical plan's nodes, those of subqueries in expressions and of common table expressions included."""
    found.append(node)
    for i in range(node.children().size()):
        _nodes(node.children().apply(i), found)
    inner = node.innerChildren()
    for i in range(inner.size()):
        _nodes(inner.apply(i), found)
    sub = node.subqueries() if hasattr(node, "subqueries") else None
    for i in range(sub.size() if sub is not None else 0):
        _nodes(sub.apply(i), found)
    return found


def _checked(spark: SparkSession, views: Iterable[str], sql: str) -> None:
    """Refuse a query whose parsed plan names a relation that is no view, or a function of ``OUTSIDE``.

    Names are read from the plan, so a column, alias or text that looks like a table's name is no reason, and a
    qualified name (``otherdb.t``) is not overlooked."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    nodes = _nodes(plan, [])
    own, known = set(), {v.lower() for v in views}
    for node in nodes:
        if node.getClass().getSimpleName() == "UnresolvedWith":
            ctes = node.cteRelations()
            own |= {ctes.apply(i)._1().lower() for i in range(ctes.size())}
            for i in range(ctes.size()):
                nodes += [n for n in _nodes(ctes.apply(i)._2(), []) if n is not node]
    for node in nodes:
        if "UnresolvedIdentifier" in node.getClass().getSimpleName():
            raise ValueError("relations must be named plainly")
        if node.getClass().getSimpleName() in _RELATION:
            text = node.toString()
            name = re.search(r"\[([^\]]*)\]", text)
            parts = [p.strip().lower() for p in (name.group(1) if name else text).split(",")]
            if "Function" in node.getClass().getSimpleName() or len(parts) != 1 or parts[0] not in known | own:
                raise ValueError("only the published views may be read")
    called = {f.lower() for f in re.findall(r"'([\w.]+)\s*\(", "\n".join(n.toString() for n in nodes))}
    called |= {w.lower() for w in re.findall(r"(\w+)\s*\(", re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql))}
    if {f.split(".")[-1] for f in called} & OUTSIDE:
        raise ValueError("functions that run code are not allowed")


def adhoc_select(spark: SparkSession, views: Mapping[str, DataFrame], sql: str,
                 max_rows: int = 50) -> DataFrame:
    """Register ``views`` as temp views and run one read-only SELECT/WITH (≤ max_rows rows).

    The text runs as a subquery, where the grammar allows nothing but a query: a write
    (``WITH … INSERT``, multi-insert, DDL) is a parse error before anything runs.  Its parsed plan may name no relation but
    the views and its own ``WITH`` tables, and no function that runs code; reading files by a quoted path is
    switched off."""
    text = sql.strip().rstrip(";").strip()
    if not text or text.split(None, 1)[0].upper() not in ("SELECT", "WITH"):
        raise ValueError("only SELECT/WITH queries are allowed")
    _checked(spark, views, f"SELECT * FROM (\n{text}\n)")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    before = spark.conf.get("spark.sql.runSQLOnFiles", "true")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        return spark.sql(f"SELECT * FROM (\n{text}\n)").limit(max_rows)
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", before)


SCAN_PARTITIONS = "spark.pulse.scanPartitions"


def spread_scan(df: DataFrame) -> DataFrame:
    """``df`` dealt into the partitions that the session asks for in ``spark.pulse.scanPartitions``.

    Unset (the default, and the right choice for tables of many row groups) nothing is moved.
    It is for CPU-heavy text work over a single-row-group file, as in the benchmark."""
    want = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(want)) if want else df
