"""Operator 7: language-model scores of whole documents by a gated recurrent network.

Corpus statistics come from all training documents: the count of every token (a stored table), their number N, the
number of distinct ones V, and the same for each class of rare words.  The network predicts slots: the ``WORDS`` most
frequent tokens, and ``RARE`` classes of all others by their last three bytes.  A rare word's probability is that of
its class times (count + 1) / (N + V + 1) of its class, whose last share is for unseen words.

Scoring is one pass: a task scores its batches of documents lane by lane, each document whole, with the state carried
across windows.  The ``KNOWN`` most frequent counts are broadcast (a fixed bound); the counts of the other words of
the documents come by a join on the word, pre-aggregated per document, so any vocabulary fits.

Network weights are fitted on every training document, dealt by a hash of the id into ``ROUNDS`` rounds.  In a round each
task runs backpropagation over its own documents from the broadcast weights, a batch of texts at a time, and the weights
and step sizes of all tasks are averaged by their tokens, block by block; the driver holds one set of weights.  Documents are
dealt to tasks by their ids, in a fixed order, and the number of tasks follows the number of tokens (``TRAINER_TOKENS``), so
neither the cluster's size, nor file splits, nor timing changes a weight.

Edge cases: a null or empty text is its end token alone; repeated rows are scored each; with no training documents all
counts are 0 and the base is 0; null ids fall in the fold of the empty text; an empty table gives an empty result.
Only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import SPACED_TABLE, crc_mod, id_text, saved
from pulse.llm.gru import GatedModel

WORDS = 4096            # slots of single words
RARE = 64               # slots of rare words, by ending
KNOWN = 65536           # counts that are broadcast
ROUNDS = 4              # averages of the network's weights in its one pass over the training documents
TRAINER_TOKENS = 4_000_000      # tokens of the corpus a training task
MAX_TRAINERS = 1024     # and so many tasks at most: each one's weights are averaged
BLOCK = 1 << 14         # weights averaged as one row
BATCH_BYTES = 16 << 20  # texts scored side by side
CHUNK_BYTES = 2 << 20   # texts whose words are looked up at once
COUNT_BYTES = 8 << 20   # texts whose words are counted at once
END = b""               # the end token; no word is empty


def rare_class(word: bytes, rare: int = RARE) -> int:
    return zlib.crc32(word[-3:]) % rare


def not_held_out(doc_id: Column) -> Column:
    """The fold that may teach: crc32 of the id's text modulo 7 is not 2."""
    return crc_mod(doc_id, 7) != 2


def _chunks(texts: pa.Array, most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(row, text in lower case with plain blanks) of texts of about ``most`` bytes together; longer ones are cut at blanks."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        data, lo = (text.as_py() or b"").translate(SPACED_TABLE), 0
        while lo < len(data):
            hi = data.find(b" ", lo + most) if lo + most < len(data) else -1
            hi = len(data) if hi < 0 else hi
            rows.append(row)
            parts.append(data[lo:hi])
            held, lo = held + hi - lo, hi
            if held >= most:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def _words(parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all parts, and the number of them in each."""
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    inner = data != 32
    first = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    end = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(end - first, out=offsets[1:])
    begins = np.cumsum([1, *(len(p) + 1 for p in parts)])
    each = np.diff(np.searchsorted(first, begins))
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inner])]), each


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> the distinct words of each chunk, with their numbers."""
    for batch in batches:
        for _, parts in _chunks(batch.column(0).cast(pa.binary()), COUNT_BYTES):
            found = pc.value_counts(_words(parts)[0])
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "count"])


def token_counts(texts: DataFrame) -> DataFrame:
    """(word as binary, count) of all tokens of the column ``text``, each text's end included; stored."""
    each = texts.select("text").mapInArrow(_count_words, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))
    ends = texts.agg(F.count(F.lit(1)).alias("count")).where("count > 0").select(F.lit(END).alias("word"), "count")
    return saved(each.union(ends), "counts")


@dataclass
class Statistics:
    tokens: int             # N
    distinct: int           # V
    top: list[tuple[bytes, int]]        # the most frequent words, the end token among them
    rare_tokens: np.ndarray             # per class of rare words, the words beyond ``top[:words]``
    rare_distinct: np.ndarray
    words: int


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words: all from the lowest count on that leaves no more than that; the end token always."""
    per = sorted(counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).limit(most).collect(),
                 reverse=True)
    least, held = None, 0
    for count, n in per:
        held += n
        if held > most:
            break
        least = count
    rows = counts.where((F.col("word") == F.lit(END)) | (F.col("count") >= (least if least is not None else 1 << 62))).collect()
    return sorted(((bytes(r[0]), r[1]) for r in rows), key=lambda r: (r[0] != END, -r[1], r[0]))


def statistics(counts: DataFrame, *, words: int = WORDS, rare: int = RARE, known: int = KNOWN) -> Statistics:
    whole = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    top = _most_frequent(counts, known)
    words = min(words, len(top))
    tokens, distinct = np.zeros(rare), np.zeros(rare)
    ending = F.expr("substring(word, greatest(octet_length(word) - 2, 1), 3)")
    for cls, n, v in counts.groupBy((F.crc32(ending) % rare).alias("cls")).agg(
            F.sum("count"), F.count(F.lit(1))).collect():
        tokens[cls], distinct[cls] = n, v
    for word, count in top[:words]:
        tokens[rare_class(word, rare)] -= count
        distinct[rare_class(word, rare)] -= 1
    return Statistics(whole[0], whole[1], top, tokens, distinct, words)


# what a byte adds to a checksum: crc32 of one byte, without the first and last complement
_CRC_TABLE = ~np.array([zlib.crc32(bytes([i ^ 255])) for i in range(256)], np.uint32) ^ np.uint32(0xFFFFFF)


def rare_classes(words: pa.Array, rare: int) -> np.ndarray:
    """``rare_class`` of many words."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes, ends, crc = np.diff(offsets), offsets[1:], np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        has = np.flatnonzero(sizes >= back)
        old = crc[has]
        crc[has] = _CRC_TABLE[(old ^ data[ends[has] - back]) & 255] ^ (old >> 8)
    return (~crc % np.uint32(rare)).astype(np.int64)


class Scorer:
    """What a task needs to score documents, but for the counts of words beyond ``Statistics.top``."""

    def __init__(self, stats: Statistics, model: GatedModel):
        self.top = pa.array([w for w, _ in stats.top], pa.binary())
        self.rare, self.words, self.model = len(stats.rare_tokens), stats.words, model
        self.rare_total = np.log10(stats.rare_tokens + stats.rare_distinct + 1)
        logs = np.log10(np.array([c for _, c in stats.top], float) + 1)
        rare_of = rare_classes(self.top, self.rare)
        # of every word of ``top``, and at the end of all others: what it adds to the base and to the score, its slot
        at = np.arange(len(logs))
        self.base_of = np.append(logs, 0.0) - np.log10(stats.tokens + stats.distinct + 1)
        self.score_of = np.append(np.where(at < self.words, 0.0, logs - self.rare_total[rare_of]), 0.0)
        self.slot_of = np.append(np.where(at < self.words, at, self.words + rare_of), 0)

    def _look_up(self, words: pa.Array):
        """(slot, base, score) of every word, and the places of those without a broadcast count."""
        codes = pc.fill_null(pc.index_in(words, value_set=self.top), -1).to_numpy()
        slots, base, score = self.slot_of[codes], self.base_of[codes], self.score_of[codes]
        unseen = np.flatnonzero(codes < 0)
        cls = rare_classes(words.take(pa.array(unseen)), self.rare)
        slots[unseen] = self.words + cls
        score[unseen] = -self.rare_total[cls]
        return slots, base, score, unseen

    def encode(self, texts: pa.Array):
        """Of whole texts: their slots, base and score so far, tokens with a broadcast count, and (row, word, times) of other words."""
        n = len(texts)
        (end,), end_base, end_score, end_unseen = self._look_up(pa.array([END], pa.binary()))
        slots = [[] for _ in range(n)]
        base, score, known = np.full(n, end_base[0]), np.full(n, end_score[0]), np.full(n, 1 - len(end_unseen))
        others = []
        for rows, parts in _chunks(texts, CHUNK_BYTES):
            words, each = _words(parts)
            own, word_base, word_score, unseen = self._look_up(words)
            row = np.repeat(rows, each)
            base += np.bincount(row, word_base, n)
            score += np.bincount(row, word_score, n)
            known += np.bincount(row, minlength=n) - np.bincount(row[unseen], minlength=n)
            for r, part in zip(rows, np.split(own, np.cumsum(each)[:-1])):
                slots[r].append(part)
            if len(unseen):
                pairs = pa.table({"row": row[unseen], "word": words.take(pa.array(unseen))})
                others.append(pairs.group_by(["row", "word"], use_threads=False).aggregate([([], "count_all")]))
        return [np.append(np.concatenate([*s, np.zeros(0, np.int64)]), end) for s in slots], base, score, known, others


def _listed(others: list[pa.Table], n: int) -> pa.Array:
    """Of every row its other words, as a list of (word, times)."""
    kind = pa.struct([("word", pa.binary()), ("times", pa.int64())])
    if not others:
        return pa.array([[]] * n, pa.list_(kind))
    every = pa.concat_tables(others).combine_chunks()
    row = every.column("row").to_numpy()
    order = np.argsort(row, kind="stable")
    own = every.take(pa.array(order))
    pairs = pa.StructArray.from_arrays([own.column("word").combine_chunks(), own.column("count_all").combine_chunks()], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32()), pairs)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of as many texts as fit ``BATCH_BYTES``, one at least."""
    lo = held = 0
    for hi, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if hi > lo and held >= BATCH_BYTES:
            yield lo, hi
            lo, held = hi, 0
        held += size
    if len(texts):
        yield lo, len(texts)


def _train(scorer, start):
    """Texts -> the weights and step sizes that a task's documents lead to from ``start``, in blocks, with their tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = scorer.value, 0
        model = copy(own.model)
        model.p, squares = ({k: v.copy() for k, v in x.items()} for x in start.value)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for lo, hi in _portions(texts):
                slots = own.encode(texts.slice(lo, hi - lo))[0]
                model.train(slots, squares=squares)
                tokens += sum(map(len, slots))
        if tokens:
            flat = np.concatenate([v.ravel().astype(np.float32) for x in (model.p, squares) for v in x.values()])
            parts = [flat[lo:lo + BLOCK].tobytes() for lo in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([tokens] * len(parts), pa.int64()),
                                              pa.array(parts, pa.binary())], ["block", "tokens", "weights"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by block -> one row a block, the weights times their tokens added."""
    def row():
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([tokens], pa.int64()),
                                           pa.array([sums.tobytes()], pa.binary())], ["block", "tokens", "sums"])
    block, tokens, sums = None, 0, None
    for batch in batches:
        for b, n, part in zip(*(batch.column(c).to_pylist() for c in ("block", "tokens", "weights"))):
            if b != block:
                if block is not None:
                    yield row()
                block, tokens, sums = b, 0, 0.0
            tokens, sums = tokens + n, sums + n * np.frombuffer(part, np.float32).astype(np.float64)
    if block is not None:
        yield row()


def trainers_of(tokens: int) -> int:
    """So many tasks train: by the corpus alone, so that no cluster's size changes a weight."""
    return max(1, min(MAX_TRAINERS, -(-tokens // TRAINER_TOKENS)))


def dealt_texts(docs: DataFrame, trainers: int) -> DataFrame:
    """The texts of (doc_id, text), dealt to ``trainers`` partitions by id, each in a fixed order."""
    own = docs.select("text", F.xxhash64(id_text(F.col("doc_id")), F.lit(6)).alias("hash"))
    # a session that deals to more partitions than asked for still trains in ``trainers`` tasks
    return own.repartition(trainers, "hash").sortWithinPartitions("hash", "text").select("text").coalesce(trainers)


def train_round(texts: DataFrame, scorer, model: GatedModel, squares: dict[str, np.ndarray]) -> int:
    """One round: all rows of the column ``text`` teach ``model``, each partition its own rows.  Returns their tokens."""
    start = texts.sparkSession.sparkContext.broadcast((model.p, squares))
    # a fixed order of the tasks in every sum, so it does not depend on which ended first
    dealt = texts.mapInArrow(_train(scorer, start), "block int, tokens long, weights binary").withColumn("task", F.spark_partition_id())
    rows = (dealt.repartition("block").sortWithinPartitions("block", "task").select("block", "tokens", "weights")
            .mapInArrow(_add_blocks, "block int, tokens long, sums binary").collect())
    start.destroy()
    if not rows:
        return 0
    flat = np.concatenate([np.frombuffer(r["sums"]) / r["tokens"] for r in sorted(rows, key=lambda r: r["block"])])
    for table in (model.p, squares):
        for k, v in table.items():
            table[k], flat = flat[:v.size].reshape(v.shape).astype(v.dtype), flat[v.size:]
    return rows[0]["tokens"]


def fit(docs: DataFrame, teaches: Callable[[Column], Column], *, rounds: int = ROUNDS,
        **options) -> tuple[DataFrame, Statistics, GatedModel]:
    """(counts, statistics, model) learned from the rows of (doc_id, text) whose id ``teaches`` accepts."""
    own = teaches(F.col("doc_id"))
    counts = token_counts(docs.where(own))
    stats = statistics(counts, **options)
    model = GatedModel(np.array([c for _, c in stats.top[:stats.words]], float), stats.rare_tokens)
    if stats.top:
        scorer = docs.sparkSession.sparkContext.broadcast(Scorer(stats, model))
        squares = model.squares()
        deal = F.pmod(F.xxhash64(id_text(F.col("doc_id")), F.lit(5)), F.lit(rounds))
        for k in range(rounds):
            train_round(dealt_texts(docs.where(own & (deal == k)), trainers_of(stats.tokens)), scorer, model, squares)
        scorer.destroy()
    return counts, stats, model


def _score(scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer.value
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lo, hi in _portions(texts):
                slots, base, score, known, others = own.encode(texts.slice(lo, hi - lo))
                score += own.model.score(slots) / np.log(10)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                    pa.array(list(map(len, slots)), pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    _listed(others, hi - lo)],
                    ["row", "doc_id", "n_tokens", "known", "base", "score", "others"])

    return run


def document_scores(docs: DataFrame, counts: DataFrame, stats: Statistics, model: GatedModel) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_tokens, n_known, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(stats, model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    scored = saved(numbered.mapInArrow(_score(shared), f"row long, doc_id {kind}, n_tokens long, known long, base double, "
                                       "score double, others array<struct<word: binary, times: long>>"), "scored")
    other = scored.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    counted = counts.select(F.col("word").alias("__word"), "count")
    # words without a count add log10(0 + 1) = 0 and are not known: an inner join is enough
    seen = (other.join(counted, F.col("word") == F.col("__word")).groupBy(F.col("row").alias("__row"))
            .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("count") + 1)).alias("logs")))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(seen, F.col("row") == F.col("__row"), "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def score_documents(docs: DataFrame, teaches: Callable[[Column], Column], *, id_col="doc_id", text_col="text",
                    **options) -> tuple[DataFrame, Statistics]:
    """Fit on the rows that teach, then score all: (scores, statistics)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts, stats, model = fit(own, teaches, **options)
    return document_scores(own, counts, stats, model), stats
