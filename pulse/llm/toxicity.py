"""Operator 4: toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is p = sigmoid(z), z = bias + the values of its distinct words; a
word's value is the weight of the word and of its first four and five bytes.  The document's score is the noisy-or
1 - prod(1 - p).  Weights are learned from document labels alone: with S = sum(softplus(z)) the noisy-or is
1 - exp(-S), and its log-likelihood is followed by proximal Adam steps, whose soft threshold leaves weight only on what
matters.  The sentence scores then locate the offending sentences.

Training reads a bounded sample of labelled documents (``SAMPLE_DOCS`` of each label, the first in a hash order of the
ids, of those that have a document); each label counts by its share of all teaching documents, sampled or not.  Scoring streams over all documents with the broadcast weights, whose size is bounded by the sample.

Edge cases: a null, empty or wordless text has no sentences and the score 0; repeated sentences count as often as they
stand; a document that is labelled more than once is toxic if one label says so; null labels or ids teach nothing;
without any label of both kinds the score of every text is 0.  Other columns are not read.
Columns that pass through must not be called __score: these are the operator's own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import PLAIN_TABLE, crc_mod, id_text, saved, text_slices

SAMPLE_DOCS = 4000      # labelled documents of each label that training reads at most
MIN_DOCS = 3            # toxic documents a feature must stand in to get a weight
LIFT = 2.0              # and how many times as often as in the others
STEPS = 300
RATE = 0.15
SPARSE = 0.0005        # soft threshold per step
START_BIAS = -7.0
GRAIN = 1 << 16         # weights are multiples of 1 / GRAIN, so sums don't depend on their order
THRESHOLD = 0.7
MEMO = 1 << 16          # word values a scorer remembers

_ENDS = re.compile(rb"[.!?\n\r]+")
# PLAIN_TABLE, but sentence ends become line feeds.
_LINES = bytes(10 if b in b".!?\n\r" else c for b, c in enumerate(PLAIN_TABLE))


def features(word: bytes) -> tuple[bytes, ...]:
    """The word and its openings of four and five bytes."""
    return (b"=" + word, word[:4], word[:5]) if len(word) > 4 else (b"=" + word, word[:4])


class _Values(dict):
    """Word -> value, computed once per word."""

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        value = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self) < MEMO and len(word) < 64:
            self[word] = value
        return value


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float

    def values(self) -> _Values:
        return _Values(self.weights)

    def sentences(self, text: bytes, values: _Values) -> list[tuple[int, int, float]]:
        """(first byte, end, z) of every sentence that has a word."""
        out, lo = [], 0
        for m in [*_ENDS.finditer(text), None]:
            hi = len(text) if m is None else m.start()
            words = set(text[lo:hi].translate(PLAIN_TABLE).split())
            if words:
                out.append((lo, hi, self.bias + sum(map(values.__getitem__, words))))
            lo = hi if m is None else m.end()
        return out

    def score(self, text: bytes | None, values: _Values) -> float:
        """The noisy-or of the sentences, from 0 to 1."""
        if not text or not self.weights:
            return 0.0
        z = [sum(map(values.__getitem__, set(words)))
             for words in map(bytes.split, text.translate(_LINES).split(b"\n")) if words]
        return float(-np.expm1(-np.logaddexp(0.0, np.array(z, float) + self.bias).sum()))


def train(texts: list[bytes], labels: list[int], counts_as: list[float] | None = None) -> ToxicityModel:
    """Weights from document labels, by proximal gradient steps on the noisy-or likelihood.

    ``counts_as``: how many documents each text stands for (1)."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, START_BIAS)
    times = np.ones(len(y)) if counts_as is None else np.array(counts_as, float)
    words: dict[bytes, bytes] = {}      # one object per distinct word
    bags = [[[words.setdefault(w, w) for w in s] for s in map(bytes.split, text.translate(_LINES).split(b"\n")) if s]
            for text in texts]
    toxic, other = Counter(), Counter()
    for bag, label in zip(bags, labels):
        if label:
            toxic.update({f for s in bag for w in s for f in features(w)})
    toxic = {f: n for f, n in toxic.items() if n >= MIN_DOCS}
    for bag, label in zip(bags, labels):
        if not label:
            other.update({f for s in bag for w in s for f in features(w) if f in toxic})
    lift = LIFT * y.sum() / (len(y) - y.sum())
    vocab = {f: i for i, f in enumerate(sorted(f for f, n in toxic.items() if n >= lift * other[f]))}
    coded: dict[bytes, list[int]] = {}
    doc_of, feature, owner = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            for w in sorted(set(s)):
                if w not in coded:
                    coded[w] = [vocab[f] for f in features(w) if f in vocab]
                feature.extend(coded[w])
                owner.extend([len(doc_of)] * len(coded[w]))
            doc_of.append(d)
    doc_of, feature, owner = (np.array(x, np.int64) for x in (doc_of, feature, owner))
    # sentences without a feature differ in nothing but their document
    w, bias, sentences = np.zeros(len(vocab)), START_BIAS, len(doc_of)
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(owner, w[feature], sentences)
        total = np.bincount(doc_of, np.logaddexp(0, z), len(y))
        pull = ((1 - y) - y / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9)) * times
        g_z = pull[doc_of] / (1 + np.exp(-z)) / times.sum()
        g = np.append(np.bincount(feature, g_z[owner], len(vocab)), g_z.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-4)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - SPARSE, 0)
    w = np.round(w * GRAIN) / GRAIN
    return ToxicityModel({f: float(w[i]) for f, i in vocab.items() if w[i]}, float(np.round(bias * GRAIN) / GRAIN))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col, text_col, label_id_col, label_col,
                    teaches, per_label: int) -> tuple[list[bytes], list[int], list[float]]:
    """At most ``per_label`` labelled texts of each label, the first in the hash order of their ids; their labels; how
    many labelled documents each stands for."""
    known = (labels.select(F.col(label_id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
             .where("__id is not null and __label is not null").where(teaches(F.col("__id")))
             .groupBy("__id").agg(F.max(F.when(F.col("__label") > 0, 1).otherwise(0)).alias("__label")))
    own = docs.select(F.col(id_col).alias("__doc"))
    known = saved(known.join(own, F.col("__id") == F.col("__doc"), "left_semi"), "teaching")
    size = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    times = {label: n / max(1, min(n, per_label)) for label, n in size.items()}
    order = [F.xxhash64(id_text(F.col("__id"))), F.col("__id")]
    picked = None
    for label in (0, 1):
        some = known.where(F.col("__label") == label).orderBy(*order).limit(per_label)
        picked = some if picked is None else picked.union(some)
    rows = (docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
            .join(F.broadcast(picked), F.col("__doc") == F.col("__id"))     # at most 2 * per_label ids
            .select("__id", "__text", "__label")).toArrow().to_pydict()
    found = sorted(zip(rows["__id"], (t or "" for t in rows["__text"]), rows["__label"]))
    return [t.encode() for _, t, _ in found], [y for *_, y in found], [times[y] for *_, y in found]


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_id_col="doc_id",
        label_col="toxic", teaches=lambda c: F.lit(True), per_label: int = SAMPLE_DOCS) -> ToxicityModel:
    """The model learned from ``labels``; ``teaches`` says by id which rows may teach."""
    return train(*labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_id_col=label_id_col,
                                  label_col=label_col, teaches=teaches, per_label=per_label))


def with_score(docs: DataFrame, model: ToxicityModel, name: str, *, text_col="text") -> DataFrame:
    """``docs`` with each text's score in a new column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        values = own.values()
        for batch in (part for whole in batches for part in text_slices(whole, at)):
            texts = batch.column(at).cast(pa.binary())
            scores = pa.array([own.score(t.as_py(), values) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, score."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_score(own, model, "score").select("doc_id", "score")


def offending_sentences(docs: DataFrame, model: ToxicityModel, *, id_col="doc_id", text_col="text",
                        least: float = 0.5) -> DataFrame:
    """doc_id, sentence (from 0, of those that have a word), text, score of the sentences that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value.values()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for k, (lo, hi, z) in enumerate(shared.value.sentences(text or b"", values)):
                    p = float(1 / (1 + np.exp(-z)))
                    if p >= least:
                        for column, value in zip(out, (key, k, text[lo:hi].decode(errors="replace").strip(), p)):
                            column.append(value)
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             ["doc_id", "sentence", "text", "score"])

    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], T.StructField("sentence", T.LongType()),
                                             T.StructField("text", T.StringType()),
                                             T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    return with_score(docs, model, "__score", text_col=text_col).where(F.col("__score") < threshold).drop("__score")


def not_held_out(col):
    """The fold that may teach: crc32 of the id's text modulo 3 is not 1."""
    return crc_mod(col, 3) != 1
