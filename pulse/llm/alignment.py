"""Operator 13: alignment of two tokenizers' tokens over the bytes of a text.

A token covers a range of bytes, so a text and a tokenizer give an incidence matrix (tokens x bytes) in CSR form, built
here by hand.  Gustavson's row products of A with the transpose of B give the overlap links with the bytes they share; the
places where tokens of both end cut the text into groups, and the products of the group incidences (tokens x groups) give
the shared-group links.

On Spark: one pass encodes every text; it stores the token ids (two bytes each) and counts the id pairs of all links, in
each task first.  A second pass builds the links again from the stored ids and looks the corpus-wide counts up: the
``HOT_PAIRS`` most frequent id pairs are broadcast, links of all other pairs are joined and added up by document.  The pieces' largest
counts per B id are an aggregate of the same table.

Words between single blanks are encoded once and remembered, A's by tiktoken over the same file's vocabulary and the same cutting
rule; texts with runs of blanks, long words or other than Latin letters and plain punctuation are encoded whole by the
libraries of the two files.  Both ways give the same ids (tested).

Edge cases: null and empty texts, and texts whose joined tokens are not the text (B normalises or doesn't know a character,
or takes U+2581 for a blank), have no tokens: zeros and an empty ``groups``; special tokens' strings are plain text; repeated rows count as often as they
stand; ties of the highest count all count as best; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pulse.llm.common import saved

FOLDER = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
HOT_PAIRS = 1 << 20      # id pairs whose counts are broadcast: 17 bytes each
FLUSH = 1 << 20          # links or distinct pairs a task holds before it counts or hands them on
LONG_RUN = 256           # characters of a word that is not encoded on its own
MEMO = 1 << 18           # words a task remembers
TEXTS_AT_ONCE = 256
CHARS_AT_ONCE = 1 << 21

# Fixed value: the cutting rule that the byte-level vocabulary was made with.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters on which all libraries agree about letters, digits and white space.
_PLAIN = re.compile(r"[\n\r\t\x20-\x7e\xa1-\xac\xae-ſ–—‘-”…]*")


# ---------------------------------------------------------------------------
# sparse incidence matrices
# ---------------------------------------------------------------------------
@dataclass
class Csr:
    """Rows of sorted column numbers: row i holds ``columns[starts[i]:starts[i + 1]]`` with ``values``."""
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> "Csr":
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        counts = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), rows[order], self.values[order], len(self.starts) - 1)


def incidence(ends: np.ndarray) -> Csr:
    """Tokens x bytes: token i covers the bytes from the end of the one before to ``ends[i]``."""
    total = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(total), np.ones(total, np.int64), total)


def group_incidence(ends: np.ndarray, cuts: np.ndarray) -> Csr:
    """Tokens x groups: every token lies in the one group whose end is the first of ``cuts`` not before its own."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), np.ones(len(ends), np.int64), len(cuts))


def row_products(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries (row, column, value) of a @ b by Gustavson's rule, rows in order and columns sorted in them.

    Every entry (i, k) of ``a`` adds its multiple of row k of ``b`` to row i; equal (row, column) are added up.
    """
    rows = np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts))
    many = np.diff(b.starts)[a.columns]                 # entries of b's row that each entry of a meets
    if not many.sum():
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(rows, many)
    first = np.repeat(b.starts[a.columns] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    at = first + np.arange(len(row))
    key = row * b.width + b.columns[at]
    value = np.repeat(a.values, many) * b.values[at]
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[heads]
    return key // b.width, key % b.width, np.add.reduceat(value, heads)


def overlap_links(a_ends: np.ndarray, b_ends: np.ndarray):
    """(token of A, token of B, shared bytes) of all pairs whose byte ranges overlap."""
    return row_products(incidence(a_ends), incidence(b_ends).transposed())


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The ends of the groups: where tokens of both end (tokens without bytes don't end anything new)."""
    return np.intersect1d(a_ends, b_ends)


def group_links(a_ends: np.ndarray, b_ends: np.ndarray):
    """(token of A, token of B, 1) of all pairs in one group."""
    cuts = common_ends(a_ends, b_ends)
    return row_products(group_incidence(a_ends, cuts), group_incidence(b_ends, cuts).transposed())


# ---------------------------------------------------------------------------
# the two tokenizers
# ---------------------------------------------------------------------------
def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers with the bytes of their ids; one per Python worker."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = f"{folder}/{BYTE_BPE}"
        self.byte_bpe = Tokenizer.from_file(path)
        self.byte_bpe.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        of = _byte_of_char()
        special = {t.content for t in self.byte_bpe.get_added_tokens_decoder().values()}
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * self.byte_bpe.get_vocab_size(True)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.memo: dict[str, tuple[bytes, bytes | None]] = {}
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}")
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # decimal ids with what stands behind them in ``groups_text``: inside their part of a group, and at its end
        self.names = [b"%d%c" % (i, c) for own, marks in ((self.a_bytes, b",|"), (self.b_bytes, b",;"))
                      for c in marks for i in range(len(own))]

    def _words(self, text: str) -> list[str] | None:
        """The words of a text that may be encoded one by one, or None if it has to be taken as a whole.

        No token of either vocabulary goes on behind a single blank, so blank + word are encoded on their own, once
        for many texts.  Runs of blanks make tokens of their own; outside ``_PLAIN`` and for long words the
        libraries' rules are not relied on."""
        if not (text.isascii() or _PLAIN.fullmatch(text)) or "  " in text or text[0] == " " or text[-1] == " ":
            return None
        words = text.split(" ")
        return None if max(map(len, words)) >= LONG_RUN else words

    def _known(self, words: set[str]) -> dict[str, tuple[bytes, bytes | None]]:
        """Ids of words as two bytes each; B's are None if its tokens are not blank + word.

        The first ``MEMO`` words, which the frequent ones are among, are remembered; later ones live as long as their batch."""
        new = [w for w in words if w not in self.memo]
        own = self.memo if len(self.memo) + len(new) <= MEMO else {}
        for word, b in zip(new, self.pieces.encode(new, num_threads=1) if new else []):
            fits = b"".join(map(self.b_bytes.__getitem__, b)) == (" " + word).encode()
            own[word] = (array("H", self.fast.encode_ordinary(" " + word)).tobytes(), array("H", b).tobytes() if fits else None)
        return own

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) of each text; both empty where the joined tokens are not blank + text."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out, whole = [none] * len(texts), []
        parts = [self._words(text) if text else [] for text in texts]
        fresh = self._known({w for words in parts if words for w in words})
        for i, words in enumerate(parts):
            if words is None:
                whole.append(i)
            elif words:
                a, b = zip(*[self.memo.get(w) or fresh[w] for w in words])
                if None not in b:
                    out[i] = _unpacked(b"".join(a)), _unpacked(b"".join(b))
        if whole:
            some = [texts[i] for i in whole]
            byte_level = self.byte_bpe.encode_batch_fast([" " + t for t in some], add_special_tokens=False)
            for i, a, b in zip(whole, byte_level, self.pieces.encode(some, num_threads=1)):
                # byte-level tokens cut the bytes and change none; B's may
                data, ids = (" " + texts[i]).encode(), np.array(a.ids, np.int64)
                if self.a_sizes[ids].sum() == len(data) and b"".join(map(self.b_bytes.__getitem__, b)) == data:
                    out[i] = ids, np.array(b, np.int64)
        return out

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])

    def groups_text(self, a: np.ndarray, b: np.ndarray) -> tuple[int, bytes]:
        """The number of groups and ``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
        if not len(a):
            return 0, b""
        a_ends, b_ends = self.ends(a, b)
        ends_here = np.zeros(a_ends[-1] + 1, np.int8)
        ends_here[a_ends] += 1
        ends_here[b_ends] += 1
        a_last, b_last = ends_here[a_ends] == 2, ends_here[b_ends] == 2
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # a group's A ids stand behind all ids of the groups before it, its B ids behind its A ids
        a_after, b_before = np.flatnonzero(a_last) + 1, np.concatenate([[0], np.flatnonzero(b_last) + 1])
        codes = np.empty(len(a) + len(b), np.int64)
        most = len(self.a_bytes)
        codes[np.arange(len(a)) + b_before[a_group]] = a + a_last * most
        codes[np.arange(len(b)) + a_after[b_group]] = b + b_last * len(self.b_bytes) + 2 * most
        return len(a_after), b"".join(map(self.names.__getitem__, codes.tolist()))[:-1]

@lru_cache(1)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def _batched(texts: list[str]):
    """Ranges of texts of bounded number and size."""
    lo, chars = 0, 0
    for hi, text in enumerate(texts):
        chars += len(text)
        if chars >= CHARS_AT_ONCE or hi - lo >= TEXTS_AT_ONCE:
            yield lo, hi + 1
            lo, chars = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


# ---------------------------------------------------------------------------
# on Spark
# ---------------------------------------------------------------------------
def _packed(ids: np.ndarray) -> bytes:
    return ids.astype(np.uint16).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16).astype(np.int64)


ENCODED = "a_ids binary, b_ids binary, n_groups long, n_links long, groups_sha256 string, pair long, n long"


def _linked(both: Tokenizers, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The id pairs of a text's overlap links, A's id in the upper 32 bits."""
    i, j, _ = overlap_links(*both.ends(a, b))
    return a[i] << 32 | b[j]


class _PairCounts:
    """Counts of id pairs in one task; at most ``FLUSH`` links and pairs are held."""

    def __init__(self):
        self.links, self.size = [], 0
        self.pairs = self.counts = np.zeros(0, np.int64)

    def add(self, links: np.ndarray) -> bool:
        """Whether the pairs are many enough to be handed on."""
        self.links.append(links)
        self.size += len(links)
        if self.size >= FLUSH:
            self._count()
        return len(self.pairs) >= FLUSH

    def _count(self) -> None:
        found, n = np.unique(np.concatenate([*self.links, self.pairs[:0]]), return_counts=True)
        pairs, at = np.unique(np.concatenate([self.pairs, found]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, n]), len(pairs)).astype(np.int64)
        self.pairs, self.links, self.size = pairs, [], 0

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self._count()
        out = self.pairs, self.counts
        self.pairs = self.counts = np.zeros(0, np.int64)
        return out


def _with_nulls(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch of the given columns, all others null."""
    size = len(next(iter(columns.values())))

    def column(f):
        own = columns.get(f.name)
        return pa.nulls(size, f.type) if own is None else own if isinstance(own, pa.Array) else pa.array(own, f.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def encode_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", folder: str = FOLDER) -> DataFrame:
    """Stored: a row a document, and rows with the id pairs that one task has counted.

    doc_id, row (a number of the document's own), a_ids and b_ids (two bytes each), n_groups, n_links, groups_sha256; or pair and n.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                      F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("row", T.LongType()), *T.StructType.fromDDL(ENCODED).fields])
    schema["doc_id"].nullable = schema["row"].nullable = True
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, seen = tokenizers(folder), _PairCounts()
        for batch in batches:
            keys, rows, texts = (c.to_pylist() for c in batch.columns)
            texts = [t or "" for t in texts]
            for lo, hi in _batched(texts):
                out = {f.name: [] for f in arrow if f.name not in ("pair", "n")}
                out["doc_id"], out["row"] = keys[lo:hi], rows[lo:hi]
                for a, b in both.encode(texts[lo:hi]):
                    n, names = both.groups_text(a, b)
                    links = _linked(both, a, b)
                    for name, value in (("a_ids", _packed(a)), ("b_ids", _packed(b)), ("n_groups", n), ("n_links", len(links)),
                                        ("groups_sha256", hashlib.sha256(names).hexdigest() if len(a) else "")):
                        out[name].append(value)
                    if seen.add(links):
                        yield _with_nulls(arrow, dict(zip(("pair", "n"), seen.taken())))
                yield _with_nulls(arrow, out)
        yield _with_nulls(arrow, dict(zip(("pair", "n"), seen.taken())))

    return saved(own.mapInArrow(run, schema), "tokens")


def pair_counts(encoded: DataFrame) -> DataFrame:
    """Stored: pair (A's id * 2**32 + B's id), n (links that hold it linked, corpus-wide), best (the highest n of its B id)."""
    counts = saved(encoded.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("best"))    # at most B's vocabulary
    return saved(counts.join(best, b_id == F.col("b")).select("pair", "n", "best"), "pair-counts")


def hot_pairs(counts: DataFrame, most: int = HOT_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(pairs in order, counts, whether best, whether these are all) of at most ``most`` of the most frequent pairs."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = sorted(((r["level"], r["many"]) for r in counts.groupBy(level.alias("level"))
                    .agg(F.count(F.lit(1)).alias("many")).collect()), reverse=True)     # at most 64 rows
    least, total = 64, 0
    for own, many in sizes:
        if total + many > most:
            break
        least, total = own, total + many
    got = (counts.where(level >= least).select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
           .toArrow() if total else None)
    if got is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), not sizes
    pair, n, top = (got.column(c).to_numpy() for c in ("pair", "n", "top"))
    order = np.argsort(pair)
    return pair[order], n[order], top[order].astype(bool), total == sum(many for _, many in sizes)


def alignment_report(docs: DataFrame, *, id_col="doc_id", text_col="text", folder: str = FOLDER,
                     most: int = HOT_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair has its B id's highest corpus-wide count; count_sum: the links' counts added up.
    """
    encoded = encode_documents(docs, id_col=id_col, text_col=text_col, folder=folder)
    counts = pair_counts(encoded)
    *hot, whole = hot_pairs(counts, most)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kept = ["doc_id", "row", "n_groups", "n_links", "groups_sha256"]
    schema = T.StructType([*[encoded.schema[c] for c in kept],
                           *T.StructType.fromDDL("n_a long, n_b long, n_best long, count_sum long, pair long, times long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(folder)
        pair, n, top = shared.value
        for batch in batches:
            facts, rare = [], []
            for row, a, b in zip(*(batch.column(c).to_pylist() for c in ("row", "a_ids", "b_ids"))):
                a, b = _unpacked(a), _unpacked(b)
                links = _linked(both, a, b)
                at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
                known = pair[at] == links if len(pair) else np.zeros(len(links), bool)
                at = at[known]
                facts.append((len(a), len(b), int(top[at].sum()), int(n[at].sum())))
                if not known.all():
                    rest, times = np.unique(links[~known], return_counts=True)
                    rare.append((np.full(len(rest), row), rest, times))
            numbers = dict(zip(("n_a", "n_b", "n_best", "count_sum"), zip(*facts))) if facts else {}
            yield _with_nulls(arrow, {c: batch.column(c) for c in kept} | numbers)
            if rare:
                yield _with_nulls(arrow, dict(zip(("row", "pair", "times"), map(np.concatenate, zip(*rare)))))

    found = encoded.where("pair is null").select(*kept, "a_ids", "b_ids").mapInArrow(run, schema)
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if whole:
        return found.select(*result)
    found = saved(found, "alignments")
    rest = (found.where("pair is not null").select("row", "pair", "times").join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("n") * F.col("times")).alias("more_sum")))
    return (found.where("pair is null").join(rest, "row", "left")
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).select(*result))


def token_links(docs: DataFrame, *, id_col="doc_id", text_col="text", folder: str = FOLDER) -> DataFrame:
    """Every link of every document: doc_id, kind (overlap or group), a_at, b_at (places of the tokens), a_id, b_id, bytes
    (shared ones; of group links null)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], *T.StructType.fromDDL(
        "kind string, a_at long, b_at long, a_id long, b_id long, bytes long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(folder)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _batched(texts):
                for at, (a, b) in zip(range(lo, hi), both.encode(texts[lo:hi])):
                    ends = both.ends(a, b)
                    for kind, (i, j, shared) in (("overlap", overlap_links(*ends)), ("group", group_links(*ends))):
                        key = batch.column(0).slice(at, 1).take(pa.array(np.zeros(len(i), np.int64)))
                        size = pa.array(shared) if kind == "overlap" else pa.nulls(len(i), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [key, pa.array([kind] * len(i), pa.string()), *map(pa.array, (i, j, a[i], b[j])), size],
                            schema.names)

    return own.mapInArrow(run, schema)
