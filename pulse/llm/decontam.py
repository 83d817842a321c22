"""Operator 3: benchmark decontamination by a generalised suffix automaton.

The automaton holds every run of words of the normalised benchmark items.  Each
document's words are streamed through it; after each word its state and the longest matching
length say which windows (``window`` consecutive item words, or a whole shorter
item) end there.  Words inside such windows are hit.  A word that no item has
resets the automaton, so only runs of known words at least as long as the shortest
window have to be walked.

The benchmark is a test set: it is read in shards of at most ``SHARD_WORDS`` words,
each built once and broadcast; a larger benchmark takes one pass per shard, so
neither driver nor executors ever hold more than a shard.

Edge cases: a null or empty text has no words and no hits; items without words are no
windows; equal items are all reported; repeated document rows are judged each; an
empty benchmark hits nothing; texts are read in pieces of a few MB with the state
carried on.  All columns of the documents pass through; own columns have names
that start with "__" until the last step.
Columns that pass through must not be called __words, __spans and __items: these are the operator's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import PLAIN_TABLE, saved, text_slices

WINDOW = 13
COVERAGE = 20           # contaminated if COVERAGE * hit words >= words
SHARD_WORDS = 200_000   # benchmark words per broadcast automaton
PIECE = 4 << 20         # bytes of a text that are split into words at once

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class BenchmarkAutomaton:
    """Suffix automaton of many word sequences, with the windows marked at their states."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(key, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for key, words in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        own: dict[tuple[int, int], set] = {}
        self.shortest = window
        for key, codes in coded:
            size = min(window, len(codes))
            self.shortest = min(self.shortest, max(size, 1))
            state = 0
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    own.setdefault((at, size), set()).add(key)
        marks: list[tuple] = [()] * len(self.next)
        groups: list[tuple] = []
        at_state: dict[int, list] = {}
        for (at, size), keys in own.items():
            at_state.setdefault(at, []).append((size, len(groups)))
            groups.append(tuple(keys))
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            above = marks[self.link[state]] if state else ()
            marks[state] = tuple(at_state[state]) + above if state in at_state else above
        self.marks, self.groups = marks, groups

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words, hit spans as first and last word, groups of items whose windows occur)."""
        data = text.translate(PLAIN_TABLE)
        spans: list[list[int]] = []
        groups: set[int] = set()
        total, state, match, lo = 0, 0, 0, 0
        while lo < len(data):
            hi = data.find(b" ", lo + PIECE) if lo + PIECE < len(data) else -1
            hi = len(data) if hi < 0 else hi
            words = data[lo:hi].split()
            lo = hi
            if not words:       # a gap between words resets nothing
                continue
            codes = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
            known = np.concatenate(([False], codes >= 0, [False]))
            edge = np.flatnonzero(known[1:] != known[:-1])
            begins, ends = edge[::2], edge[1::2]
            # runs at the edges of a piece may go on in the next one
            keep = (ends - begins >= self.shortest) | (begins == 0) | (ends == len(words))
            if not (len(begins) and begins[0] == 0):
                state = match = 0
            for a, b in zip(begins[keep].tolist(), ends[keep].tolist()):
                if a:
                    state = match = 0
                state, match = self._walk(codes[a:b].tolist(), total + a, state, match, spans, groups)
            if len(words) and not known[-2]:
                state = match = 0
            total += len(words)
        return total, [tuple(s) for s in spans], groups

    def _walk(self, codes, at, state, match, spans, groups):
        nxt, link, length, marks = self.next, self.link, self.length, self.marks
        for i, c in enumerate(codes, at):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                match = length[state]
                to = nxt[state].get(c)
            if to is None:
                match = 0
                continue
            state = to
            match += 1
            for size, group in marks[state]:
                if size <= match:
                    groups.add(group)
                    first = i - size + 1
                    while spans and spans[-1][1] >= first - 1:
                        first = min(first, spans.pop()[0])
                    spans.append([first, i])
        return state, match


def item_shards(items: DataFrame, window: int, id_col: str, text_col: str,
                shard_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items' words, read row by row and cut into shards; a long item overlaps by a window."""
    shard, held = [], 0
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        words = row[1].encode().translate(PLAIN_TABLE).split()
        for lo in range(0, max(1, len(words) - window + 1), shard_words):
            part = words[lo:lo + shard_words + window - 1]
            if not part:
                continue
            if held and held + len(part) > shard_words:
                yield shard
                shard, held = [], 0
            shard.append((row[0], part))
            held += len(part)
    if shard:
        yield shard


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _scan(df: DataFrame, shard, window: int, text_col: str, finish=None) -> DataFrame:
    """``df`` with a shard's hits added; ``finish`` (columns, names) -> rows that stay, may change the columns."""
    automaton = df.sparkSession.sparkContext.broadcast(BenchmarkAutomaton(shard, window))
    names = df.columns
    text_at, spans_at, items_at, words_at = map(names.index, (text_col, "__spans", "__items", "__words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton.value
        for batch in (part for whole in batches for part in text_slices(whole, text_at)):
            texts = batch.column(text_at).cast(pa.binary())
            spans, items = batch.column(spans_at).to_pylist(), batch.column(items_at).to_pylist()
            words = []
            for i, text in enumerate(texts):
                n, hits, groups = found.scan(text.as_py() or b"")
                words.append(n)
                if groups:
                    before = [(s["start"], s["end"]) for s in spans[i]]
                    spans[i] = [{"start": a, "end": b} for a, b in _merge([*before, *hits])]
                    items[i] = sorted({*items[i], *(k for g in groups for k in found.groups[g])})
            columns = list(batch.columns)
            for at, values in ((spans_at, spans), (items_at, items), (words_at, words)):
                columns[at] = pa.array(values, batch.schema.field(at).type)
            keep = finish(columns, names) if finish else None
            out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield out if keep is None else out.filter(keep)

    return df.mapInArrow(run, df.schema)


def mark_hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, text_col="text", item_col="item_id",
              item_text_col="text", shard_words: int = SHARD_WORDS, finish=None) -> DataFrame:
    """``docs`` with ``__words`` (count), ``__spans`` (hit first and last words) and ``__items`` (ids)."""
    key = items.schema[item_col].dataType
    df = docs.withColumns({"__words": F.lit(0).cast("long"), "__spans": F.array().cast(_SPANS),
                           "__items": F.array().cast(T.ArrayType(key))})
    shards = item_shards(items, window, item_col, item_text_col, shard_words)
    shard, after = next(shards, []), next(shards, None)
    while after is not None:
        df = saved(_scan(df, shard, window, text_col), "decontam")
        shard, after = after, next(shards, None)
    return _scan(df, shard, window, text_col, finish)


def hit_words():
    return F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"] + 1)


def contaminated(coverage: int = COVERAGE):
    return (F.size("__spans") > 0) & (hit_words() * coverage >= F.col("__words"))


def contamination(docs: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text",
                  coverage: int = COVERAGE, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans, items (ids), contaminated."""
    marked = mark_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, **options)
    return marked.select("doc_id", F.col("__words").alias("n_words"), hit_words().alias("n_hit"),
                         F.col("__spans").alias("spans"), F.col("__items").alias("items"),
                         contaminated(coverage).alias("contaminated"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    parts, lo, spans = [], 0, list(spans)
    for i, m in enumerate(_WORD.finditer(text)):
        if not spans:
            break
        if i == spans[0][0]:
            parts.append(text[lo:m.start()])
        if i == spans[0][1]:
            lo = m.end()
            spans.pop(0)
    return "".join([*parts, text[lo:]])


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col="text", chars_col="n_chars",
                  coverage: int = COVERAGE, **options) -> DataFrame:
    """``docs`` without those over the coverage limit; spans over the length limit are cut from the rest.

    Documents without a hit keep their text; the columns stay, ``chars_col`` (if any) counts the new text.
    """
    finish = _drop_and_cut(text_col, chars_col, coverage)
    return mark_hits(docs, items, text_col=text_col, finish=finish, **options).select(*docs.columns)


def _drop_and_cut(text_col: str, chars_col: str, coverage: int):
    """Cuts the spans of the batch's documents below the limit; returns which documents stay."""
    def finish(columns: list, names: list[str]) -> pa.Array:
        at, spans = names.index(text_col), columns[names.index("__spans")].to_pylist()
        words = columns[names.index("__words")].to_pylist()
        hits = [sum(s["end"] - s["start"] + 1 for s in x) for x in spans]
        keep = [not h or coverage * h < n for h, n in zip(hits, words)]
        touched = [i for i, h in enumerate(hits) if h and keep[i]]
        if touched:
            texts = columns[at].to_pylist()
            for i in touched:
                texts[i] = cut_words(texts[i], [(s["start"], s["end"]) for s in spans[i]])
            columns[at] = pa.array(texts, columns[at].type)
            if chars_col in names:
                chars = columns[names.index(chars_col)].to_pylist()
                for i in touched:
                    chars[i] = len(texts[i])
                columns[names.index(chars_col)] = pa.array(chars, columns[names.index(chars_col)].type)
        return pa.array(keep)

    return finish
