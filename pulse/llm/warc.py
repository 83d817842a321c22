"""Operator 5: WARC archives with an index, written once and read by coalesced byte ranges.

Writing: every row becomes one gzip member with a WARC/1.1 record in an archive of its task; the index has the
archive, offset, length, URL and digest of each record.  Of equal payloads the largest id is the response, the others
are revisit records without payload.  Which rows are revisits is decided on digests alone, so HTML is never shuffled
for it.  Archives go to the shared folder under names of their own for every attempt; only the index, which Spark
commits, says which archives count, so lost executors leave nothing wrong behind.

Reading: index rows are dealt by (archive, offset), and a task merges neighbouring ranges (gaps up to ``GAP_BYTES``,
reads up to ``READ_BYTES``) into one read.  Payloads are checked against their digest.

Edge cases: null HTML is an empty payload; null URLs have no target header; control and non-ASCII characters of a URL are
percent-encoded in its header (the index has it as it was); null ids are written as an empty id and are smallest; rows that
share the largest id of their payload are all responses; an empty table gives an empty index.  Only id, URL and HTML
are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import saved, shared_path

MIN_BYTES = 0               # equal payloads of fewer bytes are all responses
ARCHIVE_BYTES = 256 << 20   # an archive is closed once it is this long
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
TASK_BYTES = 16 << 20       # compressed bytes a task reads
CAPTURED = "1970-01-01T00:00:00Z"   # the tables have no capture time

_INDEX = "archive string, offset long, length long, page_id string, url string, digest string, record_type string"
_PAGE = re.compile(r"<urn:page:(.*)>")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(url: str) -> str:
    return re.sub(rb"[^\x21-\x7E]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode()


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> tuple[bytes, str]:
    """(gzip member, digest) of one WARC record."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {CAPTURED}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, compresslevel=1, mtime=0), digest


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:]), rest


def parse(member: bytes) -> dict:
    """A record's page_id, record_type, refers_to, payload_digest, payload_bytes and payload (revisits: None)."""
    head, rest = _headers(gzip.decompress(member))
    http, payload = _headers(rest[:int(head["Content-Length"])])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    refers = head.get("WARC-Refers-To")
    return {"page_id": _PAGE.fullmatch(head["WARC-Record-ID"])[1], "record_type": kind,
            "refers_to": refers and _PAGE.fullmatch(refers)[1], "payload_digest": digest,
            "payload_bytes": int(http["Content-Length"]), "payload": payload if kind == "response" else None}


def revisits(pages: DataFrame, *, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, payload_key, refers_to) of the rows whose payload a row of a larger id has."""
    keys = saved(pages.select("page_id", F.sha2("payload", 256).alias("payload_key"),
                              F.octet_length("payload").alias("bytes")), "payload-keys")
    same = (keys.where(F.col("bytes") >= min_bytes).groupBy(F.col("payload_key").alias("__key"))
            .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    found = (keys.join(same, F.col("payload_key") == F.col("__key"))
             .where(~F.col("page_id").eqNullSafe(F.col("refers_to"))))
    return saved(found.select("page_id", "payload_key", "refers_to").distinct(), "revisits")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        store.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member, digest = record(page_id, url, payload, refers_to, revisit)
                    out.write(member)
                    rows.append((name, at, len(member), page_id, url, digest, "revisit" if revisit else "response"))
                    at += len(member)
                columns = list(zip(*rows)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                 ["archive", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col="page_id", url_col="url", html_col="html",
                   min_bytes: int = MIN_BYTES) -> tuple[str, DataFrame]:
    """(folder of the archives, their stored index) of all rows of ``pages``."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    again = revisits(own, min_bytes=min_bytes).select(F.col("page_id").alias("__id"), F.col("payload_key").alias("__key"),
                                                      "refers_to", F.lit(True).alias("__again"))
    rows = own.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha2("payload", 256) == F.col("__key")), "left")
    text = rows.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", F.col("payload").cast("binary"),
                       F.col("refers_to").cast("string"), F.coalesce("__again", F.lit(False)))
    return folder, saved(text.mapInArrow(_write(folder), _INDEX), "warc-index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[int, int, int]]:
    """Sorted (offset, length) rows -> (first row, last row + 1, bytes) of each coalesced read."""
    start = 0
    for i in range(1, len(rows) + 1):
        end = rows[i - 1][0] + rows[i - 1][1]
        if i == len(rows) or rows[i][0] - end > gap or rows[i][0] + rows[i][1] - rows[start][0] > most:
            yield start, i, end - rows[start][0]
            start = i


def _read(folder: str, keep_payload: bool):
    names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * keep_payload
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.binary()] * keep_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        open_name, source = None, None
        for batch in batches:
            archive, offset, length = (c.to_pylist() for c in batch.columns)
            lo = 0
            while lo < len(archive):
                hi = lo + 1
                while hi < len(archive) and archive[hi] == archive[lo]:
                    hi += 1
                if archive[lo] != open_name:
                    open_name, source = archive[lo], store.open_input_file(f"{root}/{archive[lo]}")
                rows = list(zip(offset[lo:hi], length[lo:hi]))
                for a, b, size in ranges(rows):
                    data = source.read_at(size, rows[a][0])
                    found = [parse(data[o - rows[a][0]:o - rows[a][0] + n]) for o, n in rows[a:b]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, kinds)], names)
                lo = hi

    return run


def read_records(index: DataFrame, folder: str, *, id_type: T.DataType | str = "long", keep_payload: bool = True) -> DataFrame:
    """The records of the index rows: page_id, record_type, refers_to, payload_digest, payload_bytes, payload."""
    near = index.select("archive", "offset", "length")
    held = near.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # dealt by the bytes that the rows stand for, which the size of the index doesn't show
    parts = max(1, -(-held // TASK_BYTES))
    near = near.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes long"
    read = near.mapInArrow(_read(folder, keep_payload), schema + ", payload binary" * keep_payload)
    own = {c: F.nullif(F.col(c), F.lit("")).cast(id_type) for c in ("page_id", "refers_to")}
    return read.withColumns(own)
