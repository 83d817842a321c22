"""Operator 9: exact top-k inner products by columnar branch-and-bound.

Vectors become integers, floor(scale * x).  A batch of candidates is held dimension by dimension (vertical layout),
largest norm first.  For every query the inner products are accumulated one block of dimensions at a time; after
each block a candidate can still gain at most |rest of the query| * |rest of the candidate| (Cauchy-Schwarz on the
remaining mass), and the candidates that can't reach the query's k-th best score any more are compacted away.  What
survives all blocks has its exact score.  Equal scores are kept, so ties go to the smaller id.

The queries are read in passes of at most ``PASS_BYTES`` and broadcast; every pass streams over all candidates.  Each
task keeps k results a query; the partial top-k lists meet in one window per query.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; a shorter
vector counts as zero-padded; rows with the query's id are its own and no candidates; a repeated query row gets its
own list; products that a double can't hold exactly are computed with Python's integers, and a score beyond a long
becomes the nearest long; empty tables give an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 20
SCALE = 64
BLOCK = 16                  # dimensions accumulated between two bounds
PASS_BYTES = 64 << 20       # query vectors broadcast at once
GROUP = 64                  # queries that share a matrix product
LEAST, MOST = -(1 << 63), (1 << 63) - 1      # of a long
EXACT, EXACT_SINGLE = float(1 << 53), float(1 << 23)     # integers that doubles and floats hold
SLACK = 1 + 1e-5             # for the rounding of norms; half a point more is harmless, scores are integers


def integer_vectors(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix of integers held as doubles, shorter rows zero-padded) of the rows that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    present = np.asarray(pc.and_(pc.is_valid(ids), pc.is_valid(vectors)))
    flat = pc.list_flatten(vectors).cast(pa.float64())
    values = np.floor(np.asarray(pc.fill_null(flat, np.nan), np.float64) * scale)
    row = np.repeat(np.arange(len(sizes)), sizes)
    wrong = np.bincount(row, ~np.isfinite(values), len(sizes)) > 0
    keep = np.flatnonzero(present & ~wrong)
    out = np.zeros((len(keep), int(sizes[keep].max(initial=0))))
    place = np.full(len(sizes), -1)
    place[keep] = np.arange(len(keep))
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    used = place[row] >= 0
    out[place[row[used]], column[used]] = values[used]
    return np.asarray(ids.take(pa.array(keep)), np.int64), out


def _rest_norms(vectors: np.ndarray) -> list[np.ndarray]:
    """Per block the norm of what follows it."""
    squares = vectors ** 2
    return [np.sqrt(squares[:, at + BLOCK:].sum(axis=1)) for at in range(0, vectors.shape[1], BLOCK)]


class TopK:
    """The k best candidates of every query of a pass, over all batches a task has seen."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        queries, width = self.vectors, max(vectors.shape[1], self.vectors.shape[1])
        largest = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * width
        if not len(ids):
            return
        if largest >= EXACT:
            return self._add_big(ids, vectors)
        kind = np.float32 if largest < EXACT_SINGLE else np.float64
        queries, vectors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))).astype(kind) for x in (queries, vectors))
        order = np.argsort(-(vectors ** 2).sum(axis=1), kind="stable")
        ids, vectors = ids[order], vectors[order]
        columns = np.ascontiguousarray(vectors.T)
        rest_c, rest_q = _rest_norms(vectors), _rest_norms(queries)
        for lo in range(0, len(queries), GROUP):
            self._group(lo, queries[lo:lo + GROUP], [r[lo:lo + GROUP] for r in rest_q], ids, columns, rest_c)

    def _group(self, lo, queries, rest_q, ids, columns, rest_c):
        """One group of queries against a batch, a block of dimensions at a time."""
        own = self.ids[lo:lo + len(queries)]
        least = self.scores[lo:lo + len(queries), -1].copy()
        if np.isneginf(least).any() and len(ids) >= 4 * self.k:     # first bounds: the longest candidates in full
            some = queries @ columns[:, :4 * self.k]
            some[own[:, None] == ids[None, :4 * self.k]] = -np.inf
            least = np.maximum(least, np.sort(some, axis=1)[:, -self.k])
        least = least[:, None].astype(columns.dtype)
        alive = np.arange(len(ids))
        total = np.zeros((len(queries), len(ids)), columns.dtype)
        near = np.ones(total.shape, bool)
        for block, at in enumerate(range(0, len(columns), BLOCK)):
            part = columns[at:at + BLOCK]
            total += queries[:, at:at + BLOCK] @ (part if len(alive) == len(ids) else part[:, alive])
            reach = rest_q[block][:, None] * (rest_c[block][alive] * SLACK)
            reach += total
            near = reach + 0.5 >= least
            stay = near.any(axis=0)
            if 2 * np.count_nonzero(stay) < len(alive):     # compact: no query of the group needs the others
                alive, total, near = alive[stay], total[:, stay], near[:, stay]
        for q in np.flatnonzero(near.any(axis=1)):
            at = np.flatnonzero(near[q])
            at = at[ids[alive[at]] != own[q]]
            self._merge(lo + q, total[q, at].astype(float), ids[alive[at]])

    def _merge(self, q, scores, ids):
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], ids])
        if len(scores) > 8 * self.k:
            near = scores >= -np.partition(-scores, self.k - 1)[self.k - 1]
            scores, ids = scores[near], ids[near]
        best = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.found[q] = scores[best], ids[best]

    def _add_big(self, ids, vectors):
        """Without bounds, in Python's integers; only for components that doubles can't multiply exactly."""
        if self.scores.dtype != object:
            self.scores = self.scores.astype(object)
        columns = [[int(x) for x in row] for row in vectors]
        for q, query in enumerate(self.vectors):
            query = [int(x) for x in query]
            scores = [max(LEAST, min(MOST, sum(a * b for a, b in zip(query, c)))) for c in columns]
            every = [*zip([-s for s in self.scores[q]], self.found[q]),
                     *((-s, i) for s, i in zip(scores, ids.tolist()) if i != self.ids[q])]
            best = sorted(every)[:self.k]
            self.scores[q], self.found[q] = [-s for s, _ in best], [i for _, i in best]

    def rows(self, number: np.ndarray) -> pa.RecordBatch:
        q, at = np.nonzero((self.scores > -np.inf).astype(bool))
        scores = [int(s) for s in self.scores[q, at]]
        return pa.RecordBatch.from_arrays(
            [pa.array(number[q]), pa.array(self.ids[q]), pa.array(self.found[q, at]), pa.array(scores, pa.int64())],
            ["number", "query_id", "vec_id", "score"])


_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("number", "query_id", "vec_id", "score")])


def _search(candidates: DataFrame, queries: pa.Table, first_number: int, scale: int, k: int) -> DataFrame:
    parts = [integer_vectors(b, scale) for b in queries.combine_chunks().to_batches()]
    width = max([v.shape[1] for _, v in parts], default=0)
    ids = np.concatenate([i for i, _ in parts]) if parts else np.zeros(0, np.int64)
    vectors = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in parts] or [np.zeros((0, 0))])
    shared = candidates.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = TopK(*shared.value, k)
        for batch in batches:
            best.add(*integer_vectors(batch, scale))
        yield best.rows(first_number + np.arange(len(best.ids)))

    return candidates.mapInArrow(run, _FOUND)


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = K, scale: int = SCALE, id_col="vec_id",
                vector_col="embedding", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` largest inner products, ties to the smaller id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"),
                                           F.col(vector_col).alias("vector"))
    held = asked.agg(F.coalesce(F.sum(F.size("vector") * 8 + 16), F.lit(0))).first()[0]
    passes = max(1, -(-held // pass_bytes))
    found = None
    for p in range(passes):     # every pass holds about pass_bytes of queries, whatever the table's size
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toArrow()
        part = _search(rows, part, p << 40, scale, k)
        found = part if found is None else found.union(part)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
