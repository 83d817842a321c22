"""Operator 10: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits; bit b is set if over half of the text's shingle hashes
(XXH64, seed 42) have it.  Two fingerprints within ``max_bits`` differing bits differ in at most ``max_bits`` bytes, so
they share at least 8 - max_bits positional bytes, and then at least half of these in the first or in the last four
positions.  The index posts every distinct fingerprint under the values of all that many positions of either half.
Within a posting list the shared positional bytes of each pair are tallied, pairs below the guaranteed minimum are
dropped, and the bit distance of the rest is verified.

Only distinct fingerprints are posted, so exact copies cost nothing.  A posting list of more than ``block``
fingerprints is cut into blocks by hash and every pair of blocks becomes a group of its own: no task holds a long
list, and no pair is lost.  A group emits the links of a spanning forest, never all pairs.

Edge cases: a null, empty or blank text has no words and the fingerprint zero, which links like any other; a text of
fewer words than a shingle is one shingle; repeated rows share a fingerprint; ids may be null (they are never the
smallest); an empty table gives an empty result.
Columns that pass through must not be called __row, __print and __stays: these are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import SPACED_TABLE, free, saved, text_slices, word_pieces
from pulse.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 1024            # fingerprints of a posting list that are compared in one group


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text as a signed 64-bit integer."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for words in word_pieces((text or b"").translate(SPACED_TABLE), 1 << 20):
        words = held + words
        if len(words) >= shingle:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes).tolist()
            line = b" ".join(words)
            grams = [line[a:b] for a, b in zip(starts, ends[shingle - 1:].tolist())]
            digests = b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED)))
            bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(grams)
            words = words[-(shingle - 1):] if shingle > 1 else []
        held = words
    if not total:
        if not held:
            return 0
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(held), SEED), "big", signed=True)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, name: str, *, text_col="text", shingle: int = SHINGLE,
                     keep_text: bool = True) -> DataFrame:
    """``docs`` with each text's fingerprint in a new column ``name`` (the text dropped if asked for)."""
    at = docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, at)):
            texts = batch.column(at).cast(pa.binary())
            prints = pa.array([fingerprint(t.as_py(), shingle) for t in texts], pa.int64())
            kept = [(n, c) for i, (n, c) in enumerate(zip(batch.schema.names, batch.columns)) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [prints], [n for n, _ in kept] + [name])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.LongType())]))


def _position_masks(max_bits: int) -> list[int]:
    """Masks of the positions an index slot reads: a pair in reach agrees on at least one of them."""
    shared = -(-(8 - max_bits) // 2)
    return [sum(0xFF << (8 * p) for p in positions)
            for half in (range(4), range(4, 8)) for positions in combinations(half, shared)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(prints: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each component that the pairs of left x right make within a group."""
    linked = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), 256):
        differ = prints[left[lo:lo + 256], None] ^ prints[None, right]
        same_bytes = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)   # the tally
        linked[lo:lo + 256] = (same_bytes >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
    root = np.arange(len(prints))
    while True:
        before = root.copy()
        none = len(prints)
        root[left] = np.minimum(root[left], np.where(linked, root[right][None, :], none).min(axis=1, initial=none))
        root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], none).min(axis=0, initial=none))
        root = root[root]
        if (root == before).all():
            return [(i, r) for i, r in enumerate(root.tolist()) if i != r]


def _compare(max_bits: int):
    def group_links(prints, part, lo, hi):
        order = np.argsort(prints)
        prints, part = prints[order], part[order]
        bits = prints.view(np.uint64)
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        return [(int(prints[a]), int(prints[b])) for a, b in _forest(bits, left, right, max_bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in ("slot", "bytes", "lo", "hi", "part", "print")], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            groups = np.split(rows, cut)
            held = groups.pop()
            yield _edges([e for g in groups if len(g) > 1 for e in group_links(g[:, 5], g[:, 4], g[0, 2], g[0, 3])])
        if held is not None and len(held) > 1:
            yield _edges(group_links(held[:, 5], held[:, 4], held[0, 2], held[0, 3]))

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (column ``print``) -> links (a, b) that join all that are within ``max_bits``.

    The links span each component; not every linked pair is listed.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7")
    posts = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("bytes"))
                      for k, m in enumerate(_position_masks(max_bits))])
    posted = prints.select("print", F.explode(posts).alias("p")).select("p.slot", "p.bytes", "print")
    lists = (posted.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("slot").alias("__slot"), F.col("bytes").alias("__bytes"),
                     F.ceil(F.col("n") / block).cast("int").alias("parts")))
    dealt = (posted.join(lists, (F.col("slot") == F.col("__slot")) & (F.col("bytes") == F.col("__bytes")))
             .withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("slot", "bytes", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"),
                     "part", "print"))
    keys = ["slot", "bytes", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(max_bits), "a long, b long")


def print_classes(marked: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(print, first) rows -> print, class_first: the smallest ``first`` in reach of every distinct fingerprint."""
    distinct = saved(marked.groupBy("print").agg(F.min("first").alias("first")), "prints")
    reached = components(links(distinct.select("print"), max_bits, block))
    roots = saved(reached.union(reached.select("root", "root").distinct()), "roots")
    free(reached)
    member = distinct.join(roots, F.col("print") == F.col("node")).select("print", "first", "root")
    least = member.groupBy("root").agg(F.min("first").alias("class_first"))
    linked = member.join(least, "root").select(F.col("print").alias("__print"), "class_first")
    classes = saved(distinct.join(linked, F.col("print") == F.col("__print"), "left")
                    .select("print", F.when(F.col("__print").isNull(), F.col("first"))
                            .otherwise(F.col("class_first")).alias("class_first")), "classes")
    free(distinct, roots)
    return classes


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, print (signed fingerprint), component_id (the smallest id in reach)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = saved(with_fingerprint(own, "print", shingle=shingle, keep_text=False), "marked")
    classes = print_classes(marked.select("print", F.col("doc_id").alias("first")), max_bits, block)
    classes = classes.select(F.col("print").alias("__print"), "class_first")
    return (marked.join(classes, F.col("print") == F.col("__print"))
            .select("doc_id", "print", F.col("class_first").alias("component_id")))


def keep_one_per_class(docs: DataFrame, *, id_col="doc_id", text_col="text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: that of the smallest id (of equal ids, one row)."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    marked = saved(with_fingerprint(numbered, "__print", text_col=text_col, shingle=shingle), "marked")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    narrow = marked.select(F.col("__print").alias("print"), first.alias("first"))
    classes = print_classes(narrow, max_bits, block)
    stays = saved(classes.select(F.col("class_first.row").alias("__stays")).distinct(), "stays")
    free(classes)
    return marked.join(stays, F.col("__row") == F.col("__stays"), "left_semi").select(*docs.columns)
