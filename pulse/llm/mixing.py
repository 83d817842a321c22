"""Operator 1: mixing sources to target weights by capped water-filling.

Targets: every source gets ``level * weight`` words, at most ``cap`` epochs of
its own size.  What a clamped source can't take is reshared by weight, until no
target is above its cap; each round is one aggregate over the per-source table.

Sampling: a source's rate (target / size) is split into whole repetitions and a
fraction.  The fraction is filled by whole documents in a seeded hash order up to
the document nearest the target, so the error of a source is at most half a
document.  The cut in the hash order is found by histograms of 4096 hash ranges, each
inside one range of the one before, so no task ever orders a whole (hot) source.

Edge cases: a null text has size 0; a null source is a source of its own, last in
code point order; a null id hashes as the empty text; rows with equal ids of one
source share one decision; an empty table gives an empty result; a source of size 0
has target 0.  Other columns are never read; those that ``mix_documents`` passes on must not begin with "__".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulse.llm.common import SPACED_WORD, id_text, ranked, saved

WEIGHTS = (5, 2, 1)     # by the source's place in code point order, repeating
SHARE = 1.5             # words of the mix per word of the corpus
CAP = 2                 # epochs a source may be read at most
SEED = 20240601
RANGE_BITS = (12, 24)   # hash bits that the histograms resolve one after the other


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def seeded_hash(doc_id: Column, seed: int) -> Column:
    """48 bits of md5("seed:id"): the seeded order of the documents."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), id_text(doc_id)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, size) rows -> source, source_size, weight, target."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranks = ranked(totals, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    per = saved(ranks.select("source", "source_size", weight.cast("long").alias("weight"),
                             (F.lit(cap) * F.col("source_size")).alias("cap")), "sources")
    whole = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"),
                    F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    goal, clamped, free, level = share * whole["s"], 0, whole["w"], 0.0
    while free:
        level = (goal - clamped) / free
        above = F.col("cap") < level * F.col("weight")
        now = per.agg(F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)).alias("c"),
                      F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("w")).first()
        if now["w"] == free:
            break
        clamped, free = now["c"], now["w"]
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _inside(sizes: DataFrame, edge: DataFrame, known: int, at: Column) -> DataFrame:
    """Words by ``at`` of the documents in their source's edge range, with the words up to there."""
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("hash", 48 - known) == F.col("__range"))
    words = (sizes.join(edge, same).groupBy("__s", "goal", "before", at.alias("__at"))
             .agg(F.sum("size").alias("words")))
    order = Window.partitionBy("__s").orderBy("__at")
    return words.withColumn("upto", F.col("before") + F.sum("words").over(order))


def sampling_rules(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole repetitions, and the hash up to which documents get one more."""
    need = targets.select(
        "source", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
        .otherwise(F.lit(0)).cast("long").alias("whole"))
    need = saved(need.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size")), "need")
    edge = need.select(F.col("source").alias("__s"), "goal", F.lit(0).cast("long").alias("before"),
                       F.lit(0).cast("long").alias("__range"))
    known = 0
    for bits in RANGE_BITS:         # narrow down, per source, the hash range in which the goal is reached
        words = _inside(sizes, edge, known, F.shiftright("hash", 48 - bits))
        edge = (words.where((F.col("upto") > F.col("goal")) & (F.col("upto") - F.col("words") <= F.col("goal")))
                .select("__s", "goal", (F.col("upto") - F.col("words")).alias("before"), F.col("__at").alias("__range")))
        edge, known = saved(edge, "edge"), bits
    nearest = (F.col("upto") - F.col("goal")) <= (F.col("goal") - (F.col("upto") - F.col("words")))
    cut = _inside(sizes, edge, known, F.col("hash")).where(nearest).groupBy("__s").agg(F.max("__at").alias("cut"))
    edge = edge.select(F.col("__s").alias("__e"), (F.shiftleft("__range", 48 - known) - 1).alias("low"))
    low = edge.join(cut, F.col("__e").eqNullSafe(F.col("__s")), "left").select(
        "__e", F.coalesce("cut", "low").alias("cut"))
    every = F.when(F.col("goal") > 0, F.lit(1 << 48)).otherwise(F.lit(-1))
    rules = need.join(low, F.col("source").eqNullSafe(F.col("__e")), "left").select(
        F.col("source").alias("rule_source"), "source_size", "weight", "target", "whole",
        F.coalesce("cut", every).alias("cut"))
    return saved(rules, "rules")


def mixing_rules(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source",
                 weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """(sizes, rules): a row per document, and a row per source."""
    sizes = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              word_count(F.col(text_col)).alias("size"),
                              seeded_hash(F.col(id_col), seed).alias("hash")), "sizes")
    return sizes, sampling_rules(sizes, source_targets(sizes, weights, share, cap))


def _repeats() -> Column:
    return (F.col("whole") + F.when(F.col("hash") <= F.col("cut"), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, weight, target, repeats, taken."""
    sizes, rules = mixing_rules(docs, **options)
    return (sizes.join(rules, F.col("source").eqNullSafe(F.col("rule_source")))
            .withColumn("repeats", _repeats())
            .select("doc_id", "source", "size", "source_size", "weight", "target", "repeats",
                    (F.col("repeats") * F.col("size")).alias("taken")))


def mix_documents(docs: DataFrame, *, id_col="doc_id", source_col="source", seed=SEED,
                  copy_col="copy", **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, numbered from 1 in ``copy_col``.

    If ``docs`` has a column of that name, it stays and the number's name gets underscores until it is free."""
    while copy_col in docs.columns:
        copy_col += "_"
    _, rules = mixing_rules(docs, id_col=id_col, source_col=source_col, seed=seed, **options)
    rules = rules.select(F.col("rule_source").alias("__src"), F.col("whole").alias("__whole"),
                         F.col("cut").alias("__cut"))
    times = (F.col("__whole") + F.when(seeded_hash(docs[id_col], seed) <= F.col("__cut"), 1).otherwise(0))
    return (docs.join(rules, docs[source_col].eqNullSafe(F.col("__src"))).where(times > 0)
            .select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times.cast("int"))).alias(copy_col)))
