"""Operator 12: language identification by a byte convolutional network.

Filters of several widths run over the bytes of a window (A-Z lower-cased); each filter's maximum over the window, through a ReLU, feeds a
softmax over the learned languages.  Forward and backward pass, Adam included, are numpy.  A filter over an embedded byte
is a table of one value a byte and offset, so a convolution is a sum of table rows; training works on these tables and
takes their gradients back to embedding and filters.  For scoring, neighbouring offsets are joined to tables over byte
pairs in 16-bit fixed point.

A text is cut into windows of ``WINDOW`` bytes, each overlapping the next by the widest filter less one; windows of many
texts are scored as one batch.  The text's probabilities are the windows' means, weighted by their letter bytes, so every byte of
every text counts.

Training reads a bounded sample: of each of at most ``MAX_LANGS`` languages (the most frequent) the first ``SAMPLE_DOCS``
texts in the hash order of their ids, and of each at most ``DOC_WINDOWS`` windows, spread over the whole text and cut on the executors; some are
shortened so that short texts are learned too.  Scoring is one pass without a shuffle; what is broadcast is the network.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal results; null langs
and ids teach nothing; if nothing can be learned all texts are ``und``; ties go to the smaller language name; an empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import crc_mod, id_text, saved

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 24             # of each width
EMBED = 12
MAX_LANGS = 256
SAMPLE_DOCS = 600        # texts a language that training reads at most
DOC_WINDOWS = 4          # windows of each
EPOCHS = 10
BATCH = 128
RATE = 0.01
SEED = 20240601
PAD = 256                # the code behind the end of a text
PAD_VALUE = -7000        # fixed point; four of them still fit 16 bits
GRAIN = 256              # fixed point: weights in 1 / GRAIN
SCORED_AT_ONCE = 1024    # windows
LETTER = r"\p{L}"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)] + [False])


@dataclass
class ByteNet:
    """``langs`` and the network's weights: embedding (257, E), filters per width (width, E, F), biases, softmax."""
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]


def new_net(langs: list[str], rng: np.random.Generator) -> ByteNet:
    many = len(WIDTHS) * FILTERS
    return ByteNet(langs, rng.normal(0, 0.5, (PAD + 1, EMBED)),
                   [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS], np.zeros(many),
                   rng.normal(0, 1 / np.sqrt(many), (many, len(langs))), np.zeros(len(langs)))


def _tables(net: ByteNet) -> list[list[np.ndarray]]:
    """Per width and offset the value of every byte code for every filter; filters don't reach behind the end."""
    tables = [[net.embed @ own for own in filters] for filters in net.filters]
    for per in tables:
        for t in per:
            t[PAD] = PAD_VALUE / GRAIN
    return tables


def _forward(net: ByteNet, codes: np.ndarray):
    """codes (positions, windows) -> probabilities, hidden values, and where each filter had its maximum."""
    steps, n = codes.shape
    hidden, places = [], []
    for width, per in zip(WIDTHS, _tables(net)):
        most, place = np.full((n, FILTERS), -np.inf), np.zeros((n, FILTERS), np.int64)
        for t in range(steps - width + 1):
            z = per[0][codes[t]]
            for j in range(1, width):
                z += per[j][codes[t + j]]
            better = z > most
            place[better] = t
            np.maximum(most, z, out=most)
        hidden.append(most)
        places.append(place)
    h = np.maximum(np.concatenate(hidden, 1) + net.bias, 0)
    return _softmax(h @ net.out + net.out_bias), h, places


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(net: ByteNet, codes: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy and its gradient for every parameter."""
    p, h, places = _forward(net, codes)
    n = len(wanted)
    loss = -np.log(np.maximum(p[np.arange(n), wanted], 1e-12)).mean()
    p[np.arange(n), wanted] -= 1
    p /= n
    back = (p @ net.out.T) * (h > 0)
    d_embed, d_filters = np.zeros_like(net.embed), []
    rows, columns = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    for k, (width, place) in enumerate(zip(WIDTHS, places)):
        own = back[:, k * FILTERS:(k + 1) * FILTERS]
        grads = []
        for j in range(width):
            cell = codes[place + j, rows].astype(np.int64) * FILTERS + columns
            table = np.bincount(cell.ravel(), own.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
            table[PAD] = 0
            grads.append(net.embed.T @ table)
            d_embed += table @ net.filters[k][j].T
        d_filters.append(np.array(grads))
    return loss, [d_embed, *d_filters, back.sum(0), h.T @ p, p.sum(0)]


def train(windows: list[bytes], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteNet | None:
    """A network learned from windows and their languages; None without windows."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    net = new_net(names, rng)
    wanted = np.searchsorted(np.array(names), np.array(langs))
    # a language counts as much as any other, however many windows it has
    chance = 1 / np.bincount(wanted)[wanted]
    chance /= chance.sum()
    codes = np.full((len(windows), WINDOW), PAD, np.int16)
    sizes = np.array([len(w) for w in windows])
    for i, w in enumerate(windows):
        codes[i, :len(w)] = np.frombuffer(w, np.uint8)
    first, second = ([np.zeros_like(x) for x in net.params()] for _ in range(2))
    batches = max(20, -(-len(windows) // BATCH))
    steps = epochs * batches
    for step in range(1, steps + 1):
        picked = rng.choice(len(windows), BATCH, p=chance)
        # windows of one batch are cut to one size, from 8 bytes to all of them
        size = WINDOW if step % 3 == 0 else int(2 ** rng.uniform(3, 8))
        at = (rng.random(BATCH) * np.maximum(sizes[picked] - size + 1, 1)).astype(np.int64)
        reach = np.minimum(at[None, :] + np.arange(size)[:, None], WINDOW - 1)
        own = np.where(at[None, :] + np.arange(size)[:, None] < WINDOW, codes[picked[None, :], reach], PAD)
        _, grads = gradients(net, np.concatenate([own, np.full((max(WIDTHS) - 1, BATCH), PAD)]), wanted[picked])
        rate = RATE * (1 - (step - 1) / steps)
        for x, g, m, v in zip(net.params(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


class Scorer:
    """The network in fixed point, with tables over pairs of byte codes."""

    def __init__(self, net: ByteNet):
        self.net, self.per_width = net, []
        for per in _tables(net):
            fixed = [np.clip(np.round(t * GRAIN), PAD_VALUE, 7000).astype(np.int16) for t in per]
            joined, j = [], 0
            while j < len(fixed):
                if j + 1 < len(fixed):
                    joined.append((j, True, (fixed[j][:, None, :] + fixed[j + 1][None, :, :]).reshape(-1, FILTERS)))
                else:
                    joined.append((j, False, fixed[j]))
                j += 2
            self.per_width.append(joined)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """codes (WINDOW + widest - 1, windows) -> probabilities (windows, langs)."""
        n, steps = codes.shape[1], codes.shape[0] - max(WIDTHS) + 1
        most = [np.full((n, FILTERS), -32768, np.int16) for _ in WIDTHS]
        one, two = np.empty((n, FILTERS), np.int16), np.empty((n, FILTERS), np.int16)
        pairs = [codes[t] * (PAD + 1) + codes[t + 1] for t in range(min(len(codes) - 1, 4))]
        for t in range(steps):
            if t:
                pairs = [*pairs[1:], codes[t + 3] * (PAD + 1) + codes[t + 4] if t + 4 < len(codes) else pairs[-1]]
            for best, joined in zip(most, self.per_width):
                z = None
                for j, double, table in joined:
                    row = one if z is None else two
                    np.take(table, pairs[j] if double else codes[t + j], axis=0, out=row, mode="clip")
                    z = one if z is None else np.add(one, two, out=one)
                np.maximum(best, z, out=best)
        h = np.maximum(np.concatenate(most, 1) / GRAIN + self.net.bias, 0)
        return _softmax(h @ self.net.out + self.net.out_bias)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (texts, langs): the windows' means, weighted by letter bytes; rows without a letter are zero."""
        reach = max(WIDTHS) - 1
        size = WINDOW + reach
        total = np.zeros((len(texts), len(self.net.langs)))
        weight = np.zeros(len(texts))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            codes = np.concatenate([c for c, _ in held])
            owner = np.concatenate([o for _, o in held])
            held.clear()
            for lo in range(0, len(codes), SCORED_AT_ONCE):
                some, own = codes[lo:lo + SCORED_AT_ONCE], owner[lo:lo + SCORED_AT_ONCE]
                letters = _LETTERS[some[:, :WINDOW]].sum(1).astype(float)
                p = self.windows(np.ascontiguousarray(some.T).astype(np.int64)) * letters[:, None]
                np.add.at(total, own, p)
                np.add.at(weight, own, letters)

        count = 0
        for i, text in enumerate(texts):
            whole = np.frombuffer(text.translate(_LOWER), np.uint8)
            for lo in range(0, len(whole), WINDOW * SCORED_AT_ONCE):     # pieces of very long texts
                data = whole[lo:lo + WINDOW * SCORED_AT_ONCE + reach]
                many = max(1, -(-min(len(data), WINDOW * SCORED_AT_ONCE) // WINDOW))
                padded = np.full(many * WINDOW + reach, PAD, np.int16)
                padded[:len(data)] = data
                held.append((np.lib.stride_tricks.sliding_window_view(padded, size)[::WINDOW], np.full(many, i)))
                count += many
                if count >= SCORED_AT_ONCE:
                    flush()
                    count = 0
        if held:
            flush()
        return total / np.maximum(weight, 1)[:, None]


# ---------------------------------------------------------------------------
# on Spark
# ---------------------------------------------------------------------------
def _cut(text: str, most: int) -> list[bytes]:
    """At most ``most`` windows of a text, spread evenly from its first to its last byte."""
    data = text.encode().translate(_LOWER)
    last = max(len(data) - WINDOW, 0)
    at = sorted({last * k // max(1, most - 1) for k in range(most)} if last else {0})
    return [data[lo:lo + WINDOW] for lo in at]


def teaching_windows(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", teaches=lambda c: F.lit(True),
                     per_lang: int = SAMPLE_DOCS) -> tuple[list[bytes], list[str]]:
    """Windows that training reads and their languages, in a fixed order."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("id is not null and lang is not null").where(teaches(F.col("id")) & F.col("text").rlike(LETTER))
    ids = saved(known.select("id", "lang").distinct(), "teaching")
    langs = [r["lang"] for r in ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()]
    order = Window.partitionBy("lang").orderBy(F.xxhash64(id_text(F.col("id"))), "id")
    picked = (ids.where(F.col("lang").isin(langs)).withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_lang)
              .select("id", "lang"))
    rows = known.join(F.broadcast(picked), ["id", "lang"])      # at most MAX_LANGS * per_lang ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(key, lang, k, w) for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "lang")))
                   for k, w in enumerate(_cut(text, DOC_WINDOWS))]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.string(), pa.string(), pa.int32(), pa.binary()))], ["key", "lang", "k", "window"])

    cut = (rows.select(id_text(F.col("id")).alias("key"), "text", "lang")
           .mapInArrow(run, "key string, lang string, k int, window binary")).toArrow().to_pydict()
    found = sorted(zip(cut["lang"], cut["key"], cut["k"], cut["window"]))
    return [w for *_, w in found], [lang for lang, *_ in found]


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", teaches=lambda c: F.lit(True),
        per_lang: int = SAMPLE_DOCS, epochs: int = EPOCHS) -> ByteNet | None:
    """The network learned from the rows that ``teaches`` admits by id."""
    return train(*teaching_windows(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, teaches=teaches,
                                   per_lang=per_lang), epochs=epochs)


def predict(docs: DataFrame, net: ByteNet | None, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    own = docs.select(F.col(id_col).alias("doc_id"),
                      F.when(F.col(text_col).rlike(LETTER), F.col(text_col)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            texts = batch.column(1).cast(pa.binary())
            has = [i for i, ok in enumerate(texts.is_valid().to_pylist()) if ok] if scorer else []
            if has:
                p = scorer.texts([texts[i].as_py() for i in has])
                best = p.argmax(1)
                for i, k, score in zip(has, best.tolist(), p[np.arange(len(has)), best].tolist()):
                    langs[i], scores[i] = scorer.net.langs[k], min(1.0, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], T.StructField("lang_pred", T.StringType()),
                                             T.StructField("score", T.DoubleType())]))


def not_held_out(col):
    """The fold that may teach: crc32 of the id's text modulo 4 is not 2."""
    return crc_mod(col, 4) != 2
