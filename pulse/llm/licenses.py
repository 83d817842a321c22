"""Operator 8: license scans by diagonal voting.

All rolling ``K``-word grams of the documents are matched with the templates' grams, as numbers of exact word sequences,
and joined to the templates' positions.  Every match votes for the diagonal (document position - template position) of its
document and template.  A diagonal with a vote from each gram is a place where the template's words stand consecutively.
Otherwise neighbouring diagonals (at most ``GAP`` apart, as words were put in or left out) are merged, and the merged span
is verified: it must cover ``COVER`` of the template's grams and every gram of the template's required words.

Texts are read once: a task cuts each into words and numbers the grams that a template has; their places and the number of
words are stored, a row a document.

Templates are a fixed, bounded list: their words and the numbers of their grams are broadcast; their positions are broadcast up
to ``BROADCAST_GRAMS`` and shuffle-joined beyond.  Only matches are shuffled, never texts.

Edge cases: a null or empty text has no words and no labels; texts shorter than a gram match nothing; rows that repeat
both id and text get the same result each; template words repeat freely; an empty table gives an empty result.  Only id and
text are read.  Templates need at least ``K`` words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.llm.common import PLAIN_TABLE, saved, word_pieces

K = 3
GAP = 3                     # diagonals apart that are still one occurrence
COVER = 0.8                 # share of a notice's grams that a verified span has
BROADCAST_GRAMS = 100_000


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    exact: bool = False     # only places where all words stand consecutively
    required: str = ""      # consecutive words of the template that a span must have


# The phrases whose places are counted, and the openings of well-known public license notices.
PHRASES = (
    Template("mit", "under the mit license", exact=True),
    Template("apache-2", "apache license version 2", exact=True),
    Template("cc-by-nc", "cc by nc", exact=True),
)
NOTICES = (
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
             "compliance with the license", required="apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
             "that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
             required="creative commons attribution 4"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
             required="commons attribution sharealike 4"),
    Template("gpl-3", "licensed under the gnu general public license version 3", required="public license version 3"),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
             "general public license as published by the free software foundation either version 3 of the license",
             required="either version 3"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             required="public license v 2"),
)


class GramNumbers:
    """Numbers the distinct grams of ``k`` words each, and finds them in texts."""

    def __init__(self, grams: list[tuple[str, ...]], k: int):
        self.k, self.vocab = k, {}
        coded = np.array([[self.vocab.setdefault(w.encode(), len(self.vocab)) for w in g] for g in grams], np.int64).reshape(-1, k)
        self.of, self.longer = coded[:, 0], []      # a gram's opening is numbered word by word
        for word in coded.T[1:]:
            keys, number = np.unique(self.of * len(self.vocab) + word, return_inverse=True)
            self.longer.append(keys)
            self.of = number.reshape(-1)

    def find(self, text: bytes | None, piece: int = 4 << 20) -> tuple[int, np.ndarray, np.ndarray]:
        """(words, first words of the grams found, their numbers)."""
        total, held, places, numbers = 0, np.zeros(0, np.int64), [], []
        for words in word_pieces((text or b"").translate(PLAIN_TABLE), piece):
            codes = np.concatenate([held, np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))])
            at = np.flatnonzero(codes[:max(0, len(codes) - self.k + 1)] >= 0)
            number = codes[at]
            for k, keys in enumerate(self.longer, 1):
                word = codes[at + k]
                key = number * len(self.vocab) + word
                number = np.searchsorted(keys, key)
                known = (word >= 0) & (keys[np.minimum(number, len(keys) - 1)] == key)
                at, number = at[known], number[known]
            places.append(at + (total - len(held)))
            numbers.append(number)
            total += len(words)
            held = codes[max(0, len(codes) - self.k + 1):]
        return total, np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *numbers])


def template_grams(templates: tuple[Template, ...], k: int) -> list[tuple]:
    """(template, label, exact, grams of the template, position, gram, required) of every template position."""
    rows = []
    for t, template in enumerate(templates):
        words = template.words.split()
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {template.words}")
        last, must = len(words) - k, template.required.split()
        at = next((p for p in range(len(words)) if must and words[p:p + len(must)] == must), None)
        needed = range(0) if at is None else range(max(0, min(at, last)), max(at, at + len(must) - k) + 1)
        rows += [(t, template.label, template.exact, last + 1, p, " ".join(words[p:p + k]), p in needed)
                 for p in range(last + 1)]
    return rows


def _words_of(gram: str) -> tuple[str, ...]:
    return tuple(gram.split(" "))


_FOUND = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("number", T.IntegerType())]))


def scanned(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, *, id_col="doc_id", text_col="text",
            k: int = K) -> DataFrame:
    """Per row: doc_id, doc_hash, n_words, found (place and number of every gram that a template has); stored."""
    grams = GramNumbers([_words_of(r[5]) for r in template_grams(templates, k)], k)
    shared = docs.sparkSession.sparkContext.broadcast(grams)
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("doc_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shared.value.find(t.as_py()) for t in batch.column(2).cast(pa.binary())]
            ends = np.cumsum([0, *(len(at) for _, at, _ in every)])
            pairs = [pa.array(np.concatenate([np.zeros(0, np.int64), *(e[i] for e in every)]).astype(np.int32)) for i in (1, 2)]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(pairs, ["pos", "number"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _, _ in every], pa.int64()), found],
                                             ["doc_id", "doc_hash", "n_words", "found"])

    fields = [own.schema["doc_id"], T.StructField("doc_hash", T.LongType()), T.StructField("n_words", T.LongType()),
              T.StructField("found", _FOUND)]
    return saved(own.mapInArrow(run, T.StructType(fields)), "grams")


def gram_matches(scan: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, k: int = K) -> DataFrame:
    """Each match of a document gram (of ``scanned``) and a template position, as a vote for its diagonal."""
    rows = template_grams(templates, k)
    numbers = GramNumbers([_words_of(r[5]) for r in rows], k).of.tolist()
    known = scan.sparkSession.createDataFrame(
        [(*r[:5], n, r[6]) for r, n in zip(rows, numbers)],
        "template int, label string, exact boolean, grams int, at int, template_number int, needed boolean")
    if len(rows) <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    grams = scan.select("doc_id", "doc_hash", F.explode("found").alias("gram")).select("doc_id", "doc_hash", "gram.*")
    return (grams.join(known, F.col("number") == F.col("template_number"))
            .select("doc_id", "doc_hash", "template", "label", "exact", "grams", "at", "needed", "pos",
                    (F.col("pos") - F.col("at")).alias("diagonal")).distinct())


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, *, id_col="doc_id",
                  text_col="text", k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Verified spans: doc_id, doc_hash, label, exact, first (word, from 0), last, cover (share of the grams)."""
    return _spans(scanned(docs, templates, id_col=id_col, text_col=text_col, k=k), templates, k=k, gap=gap, cover=cover)


def _spans(scan: DataFrame, templates: tuple[Template, ...], *, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    votes = gram_matches(scan, templates, k)
    of = ["doc_id", "doc_hash", "template", "label", "exact", "grams"]
    must = {t: sum(r[6] for r in template_grams((x,), k)) for t, x in enumerate(templates)}
    needs = F.element_at(F.array(*[F.lit(n) for n in must.values()]), F.col("template") + 1)
    diagonals = votes.groupBy(*of, "diagonal").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("needed"), F.col("at"))).alias("musts"))
    # a diagonal holds a template position at most once, so both sets are as short as the template
    along = Window.partitionBy(*of).orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.lit(gap), F.lit(True)) | F.col("exact")
    merged = (diagonals.withColumn("opens", apart.cast("int"))
              .withColumn("span", F.sum("opens").over(along))
              .groupBy(*of, "span").agg(
                  F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"),
                  F.size(F.array_distinct(F.flatten(F.collect_set("ats")))).alias("covered"),
                  F.size(F.array_distinct(F.flatten(F.collect_set("musts")))).alias("met")))
    share = F.col("covered") / F.col("grams")
    good = F.when(F.col("exact"), F.col("covered") == F.col("grams")).otherwise(
        (share >= cover) & (F.col("met") == needs))
    return merged.where(good).select("doc_id", "doc_hash", "label", "exact", "first", "last", share.alias("cover"))


def license_labels(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, *, id_col="doc_id",
                   text_col="text", k: int = K, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    scan = scanned(docs, templates, id_col=id_col, text_col=text_col, k=k)
    spans = _spans(scan, templates, k=k, **options)
    found = spans.groupBy(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).agg(
        F.count_if("exact").alias("n_base"), F.min(F.when(F.col("exact"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("cover").alias("score"))
    every = scan.select("doc_id", "doc_hash", "n_words")
    none = F.array().cast("array<string>")
    return (every.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("doc_hash") == F.col("__hash")), "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
                    F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
