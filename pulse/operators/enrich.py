"""Model enrichment: prompt column → answer column, with pluggable responders.

``enrich`` is the batch operator behind every model step:

1. hash each prompt (``sha2``) and keep one row per distinct prompt (one shuffle
   of prompt text, so a repeated prompt costs one call);
2. ``left_anti`` against the answer cache (prompts answered in an earlier run
   are not sent again);
3. call the model in Arrow batches through ``mapInPandas`` (one client per
   task, never per row);
4. append the new answers to the cache (or checkpoint them) *before* use, so a
   retried or re-planned stage never calls the model twice for a prompt;
5. join the answers back on the prompt hash.

Offline stand-ins (``rule_*``) compute answers in the JVM from the row itself
and emit the same JSON shapes, so the parsing steps downstream are exercised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.labels import sentiment_bucket

PromptFn = Callable[[list[str]], list[str]]


# ---------------------------------------------------------------------------
# Responders
# ---------------------------------------------------------------------------
class Responder:
    """Turns a DataFrame + prompt column into the same DataFrame + answer column."""

    def answer(self, df: DataFrame, prompt: Column, out: str) -> DataFrame:  # pragma: no cover
        raise NotImplementedError


class ColumnResponder(Responder):
    """Answers already present as a column (precomputed or replayed answers)."""

    def __init__(self, column: str):
        self.column = column

    def answer(self, df, prompt, out):
        return df.withColumn(out, F.col(self.column))


class RuleResponder(Responder):
    """Native stand-in: ``rule(df) -> Column`` evaluated per row on executors."""

    def __init__(self, rule: Callable[[DataFrame], Column]):
        self.rule = rule

    def answer(self, df, prompt, out):
        return df.withColumn(out, self.rule(df))


class ModelResponder(Responder):
    """A remote model called in batches (``call(prompts) -> answers``)."""

    def __init__(self, call: PromptFn, cache_path: str | None = None, batch_size: int = 16):
        self.call, self.cache_path, self.batch_size = call, cache_path, batch_size

    def answer(self, df, prompt, out):
        return enrich(df, prompt, self.call, out=out, cache_path=self.cache_path,
                      batch_size=self.batch_size)


# ---------------------------------------------------------------------------
# K1 operator
# ---------------------------------------------------------------------------
def prompt_hash(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def pending_prompts(prompts: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Distinct (hash, prompt) rows not yet answered in ``cache``."""
    todo = prompts.where(F.col("prompt").isNotNull()).dropDuplicates(["prompt_hash"])
    if cache is not None:
        todo = todo.join(cache.select("prompt_hash"), "prompt_hash", "left_anti")
    return todo


def _batch_caller(call: PromptFn, batch_size: int):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        for pdf in batches:
            hashes, prompts = pdf["prompt_hash"].tolist(), pdf["prompt"].tolist()
            answers: list = []
            for i in range(0, len(prompts), batch_size):
                answers.extend(call(prompts[i:i + batch_size]))
            yield pd.DataFrame({"prompt_hash": hashes, "answer": answers})
    return run


def _read_cache(spark, path: str | None) -> DataFrame | None:
    if not path:
        return None
    try:
        return spark.read.schema("prompt_hash STRING, answer STRING").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # no cache written yet
            return None
        raise  # an unreachable store must not look like an empty cache: every prompt would be paid for again


def enrich(df: DataFrame, prompt: Column, call: PromptFn, out: str = "answer",
           cache_path: str | None = None, batch_size: int = 16) -> DataFrame:
    spark = df.sparkSession
    with_p = df.withColumn("_prompt", prompt).withColumn("_prompt_hash", prompt_hash(F.col("_prompt")))
    prompts = with_p.select(F.col("_prompt_hash").alias("prompt_hash"),
                            F.col("_prompt").alias("prompt"))
    cache = _read_cache(spark, cache_path)
    todo = pending_prompts(prompts, cache)
    fresh = todo.mapInPandas(_batch_caller(call, batch_size),
                             schema="prompt_hash STRING, answer STRING")
    if cache_path:
        fresh.write.mode("append").parquet(cache_path)
        answers = _read_cache(spark, cache_path)
    else:
        # Materialise once in the shared checkpoint folder: the model is never re-called
        # when the plan is re-executed or an executor is lost.
        from pulse.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        answers = fresh.checkpoint(eager=True)
    # only this run's answers; two runs that wrote at once may both have answered a prompt
    answers = (answers.join(prompts.select("prompt_hash").distinct(), "prompt_hash", "left_semi")
               .dropDuplicates(["prompt_hash"]))
    return (with_p.join(answers.withColumnRenamed("prompt_hash", "_prompt_hash"),
                        "_prompt_hash", "left")
            .withColumnRenamed("answer", out).drop("_prompt", "_prompt_hash"))


# ---------------------------------------------------------------------------
# K12 lexicon sentiment stand-in
# ---------------------------------------------------------------------------
# Fixed valence lexicon of the stand-in (multiples of 0.5 keep sums exact).
LEXICON = {
    "good": 1.5, "great": 2.0, "excellent": 3.0, "positive": 2.0, "success": 2.0,
    "successful": 2.0, "improve": 1.5, "improved": 1.5, "improvement": 1.5, "benefit": 1.5,
    "strong": 1.5, "growth": 1.0, "support": 1.5, "trust": 1.5, "win": 2.0, "best": 2.5,
    "better": 1.5, "happy": 2.0, "love": 2.5, "safe": 1.0, "clean": 1.0, "healthy": 1.5,
    "progress": 1.5, "commit": 1.0, "commitment": 1.0, "achieve": 1.5, "achieved": 1.5,
    "sustainable": 1.0, "fair": 1.0, "praise": 2.0, "bad": -2.0, "poor": -2.0,
    "worse": -2.0, "worst": -3.0, "negative": -2.0, "fail": -2.0, "failed": -2.0,
    "failure": -2.0, "crisis": -2.5, "recall": -1.5, "risk": -1.0, "scandal": -3.0,
    "fraud": -3.0, "lawsuit": -2.0, "fine": -1.0, "loss": -1.5, "losses": -1.5,
    "decline": -1.5, "weak": -1.5, "harm": -2.0, "harmful": -2.0, "toxic": -2.5,
    "pollution": -2.0, "contamination": -2.5, "strike": -1.0, "protest": -1.5,
    "criticism": -2.0, "critical": -1.5, "problem": -1.5, "danger": -2.0,
    "unsafe": -2.0, "hate": -2.5, "greenwashing": -2.5, "misleading": -2.0,
}
VADER_ALPHA = 15.0


def _map_lit(d: dict) -> Column:
    pairs = []
    for k, v in d.items():
        pairs += [F.lit(k), F.lit(float(v))]
    return F.create_map(*pairs)


def tokens(c) -> Column:
    """Lower-cased ASCII letter runs."""
    return F.split(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z]+")


def _normalised(s: Column) -> Column:
    return s / F.sqrt(s * s + F.lit(VADER_ALPHA))


def lexicon_fold(text, finish: Callable[[Column], Column], lexicon: dict | None = None) -> Column:
    """Σ valence over the tokens (a literal-map lookup per token: no explode, no join,
    no shuffle), handed to ``finish`` inside the fold so the token pass runs once."""
    lex = _map_lit(lexicon or LEXICON)
    return F.aggregate(tokens(text), F.lit(0.0),
                       lambda acc, w: acc + F.coalesce(F.try_element_at(lex, w), F.lit(0.0)),
                       finish)


def lexicon_score(text, lexicon: dict | None = None) -> Column:
    """s / sqrt(s² + 15) of the valence sum s (Hutto & Gilbert, 2014)."""
    return lexicon_fold(text, _normalised, lexicon)


def lexicon_scores(df: DataFrame, key: str, text: str, lexicon: dict | None = None,
                   out: str = "score") -> DataFrame:
    """K12 as a table operator: (key, lexicon score) for rows unique on ``key``.

    Tokens are exploded and matched to the fixed lexicon with a broadcast hash join.
    The lexicon is a constant dimension, so its size is bounded.  One zero row per
    key (NULL for a NULL text) keeps texts without hits.  A single partial
    aggregate then shuffles about one row per key.  All of this is codegen'd,
    where the per-row fold (``lexicon_score``) evaluates a lambda per token;
    use the fold where the score must stay a column of the same row."""
    lex = df.sparkSession.createDataFrame(
        [(w, float(v)) for w, v in (lexicon or LEXICON).items()], "_w string, _v double")
    hits = (df.select(F.col(key).alias("_k"), F.explode(tokens(text)).alias("_w"))
            .join(F.broadcast(lex), "_w").select("_k", "_v"))
    zero = df.select(F.col(key).alias("_k"),
                     F.when(F.col(text).isNotNull(), F.lit(0.0)).alias("_v"))
    s = F.col("_s")
    return (hits.unionByName(zero).groupBy("_k").agg(F.sum("_v").alias("_s"))
            .select(F.col("_k").alias(key), _normalised(s).alias(out)))


def rule_sentiment(text: str = "clean_content", stance: str | None = None) -> Callable[[DataFrame], Column]:
    """K12 stand-in: JSON in the sentiment answer shape (one token pass per row)."""
    def rule(df: DataFrame) -> Column:
        def answer(s):
            score = F.round(_normalised(s), 4)
            st = F.col(stance) if stance else F.when(score <= -0.05, "critical") \
                .when(score >= 0.05, "supportive").otherwise("neutral")
            return F.to_json(F.struct(sentiment_bucket(score).alias("sentiment"),
                                      score.alias("score"), F.lit(0.5).alias("confidence"),
                                      F.array().cast("array<string>").alias("key_topics"),
                                      st.alias("stance")))
        return lexicon_fold(text, answer)
    return rule


# ---------------------------------------------------------------------------
# K13 keyword category / event rules
# ---------------------------------------------------------------------------
# Fixed keyword dimensions of the stand-in (category order breaks ties).
CATEGORY_KEYWORDS = {
    "Environmental": ["climate", "carbon", "emissions", "water", "plastic", "packaging",
                      "biodiversity", "energy", "waste", "pollution"],
    "Social": ["workers", "employees", "community", "health", "nutrition", "wages",
               "diversity", "safety", "labor", "rights"],
    "Governance": ["board", "governance", "audit", "shareholders", "compliance",
                   "transparency", "ethics", "certification", "executive", "disclosure"],
}
EVENT_KEYWORDS = {
    "recall": ["recall", "recalled", "contamination", "withdrawn"],
    "regulatory": ["regulator", "regulatory", "fine", "investigation", "ban"],
    "financial": ["shares", "profit", "revenue", "earnings", "loss"],
    "reputational": ["boycott", "scandal", "criticism", "protest", "backlash"],
    "positive": ["award", "praise", "launch", "partnership", "success"],
}


def keyword_fold(text, table: dict, finish: Callable[[Column], Column]) -> Column:
    """Per-class keyword hit counts in one pass over the tokens (keyword → class index
    map), handed to ``finish`` as an array of counts in ``table`` order."""
    idx = []
    for i, words in enumerate(table.values()):
        for w in words:
            idx += [F.lit(w), F.lit(i)]
    kw = F.create_map(*idx)
    zeros = F.array_repeat(F.lit(0), len(table))

    def merge(acc, w):
        k = F.try_element_at(kw, w)
        return F.when(k.isNull(), acc).otherwise(
            F.transform(acc, lambda c, i: c + F.when(i == k, 1).otherwise(0)))
    return F.aggregate(tokens(text), zeros, merge, finish)


def _argmax_class(counts: Column, table: dict, default: str) -> Column:
    """Class with most hits (ties → earlier class); no hits → default."""
    top = F.array_max(counts)
    names = F.array(*[F.lit(c) for c in table])
    return F.when(top == 0, F.lit(default)).otherwise(
        F.element_at(names, F.array_position(counts, top).cast("int")))


def keyword_class(text, table: dict, default: str) -> Column:
    return keyword_fold(text, table, lambda acc: _argmax_class(acc, table, default))


def keyword_classes(df: DataFrame, key: str, text: str, table: dict, default: str,
                    out: str = "label") -> DataFrame:
    """K13 as a table operator: (key, class with most keyword hits) for rows unique
    on ``key`` (ties → earlier class; no hits → ``default``; NULL text → NULL).

    Tokens are matched to the fixed keyword→class dimension (bounded, broadcast).
    One marker row per key keeps texts without hits.  A single partial
    aggregate counts hits per class."""
    kw = df.sparkSession.createDataFrame(
        [(w, i) for i, words in enumerate(table.values()) for w in words], "_w string, _c int")
    hits = (df.select(F.col(key).alias("_k"), F.explode(tokens(text)).alias("_w"))
            .join(F.broadcast(kw), "_w").select("_k", "_c", F.lit(True).alias("_nn")))
    marker = df.select(F.col(key).alias("_k"), F.lit(None).cast("int").alias("_c"),
                       F.col(text).isNotNull().alias("_nn"))
    agg = hits.unionByName(marker).groupBy("_k").agg(
        F.max("_nn").alias("_nn"),
        *[F.count_if(F.col("_c") == i).alias(f"_n{i}") for i in range(len(table))])
    counts = F.array(*[F.col(f"_n{i}").cast("int") for i in range(len(table))])
    return agg.select(F.col("_k").alias(key),
                      F.when(F.col("_nn"), _argmax_class(counts, table, default)).alias(out))


# Stand-in credibility by source type (fixed values of the offline rules).
SOURCE_CREDIBILITY = {"official": 8, "benchmark": 7, "news": 6, "ngo": 5, "social": 3}
DEFAULT_CREDIBILITY = 4


def rule_credibility(source_type: str = "source_type") -> Column:
    m = F.create_map(*[x for k, v in SOURCE_CREDIBILITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.col(source_type)), F.lit(DEFAULT_CREDIBILITY))


def rule_esg(text: str = "clean_content") -> Callable[[DataFrame], Column]:
    def rule(df: DataFrame) -> Column:
        cat = keyword_class(text, CATEGORY_KEYWORDS, "Not-ESG")
        return F.to_json(F.struct(cat.alias("esg_category"),
                                  F.lit(None).cast("string").alias("esg_sub_theme"),
                                  F.lit(0.5).alias("confidence"),
                                  F.array().cast("array<string>").alias("key_claims"),
                                  (F.col("source_type") == "official").alias("is_official_csr"),
                                  F.left(F.col(text), F.lit(200)).alias("impact_summary"),
                                  rule_credibility().alias("credibility_score")))
    return rule


def rule_event(text: str = "clean_content") -> Callable[[DataFrame], Column]:
    def rule(df: DataFrame) -> Column:
        def answer(counts):
            hits = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
            sev = F.when(hits >= 6, "critical").when(hits >= 4, "high") \
                .when(hits >= 2, "medium").otherwise("low")
            return F.to_json(F.struct(
                _argmax_class(counts, EVENT_KEYWORDS, "other").alias("event_type"),
                sev.alias("severity"), F.lit("Global").alias("affected_region"),
                F.lit(None).cast("string").alias("affected_product"),
                F.lit(None).cast("string").alias("financial_impact_estimate"),
                F.lit("Monitor coverage").alias("recommended_response")))
        return keyword_fold(text, EVENT_KEYWORDS, answer)
    return rule


# ---------------------------------------------------------------------------
# K14 claim extraction rules
# ---------------------------------------------------------------------------
COMMITMENT_WORDS = ["commit", "commits", "committed", "pledge", "pledged", "target", "aim",
                    "aims", "will", "achieved", "certified", "reduce", "reduced"]
SENTENCE_RE = r"(?<=[.!?])\s+"
NUMBER_RE = r"[0-9]"
METRIC_RE = r"([0-9]+(?:[.,][0-9]+)?\s*%)"
YEAR_RE = r"((?:19|20)[0-9]{2})"


def claim_sentences(text) -> Column:
    """Sentences holding a digit or a commitment word (whole text, every sentence)."""
    t = F.col(text) if isinstance(text, str) else text
    kw = F.array(*[F.lit(w) for w in COMMITMENT_WORDS])
    return F.filter(F.split(t, SENTENCE_RE),
                    lambda s: F.regexp_like(s, F.lit(NUMBER_RE))
                    | F.exists(tokens(s), lambda w: F.array_contains(kw, w)))


def rule_claims(text: str = "clean_content") -> Callable[[DataFrame], Column]:
    def rule(df: DataFrame) -> Column:
        def to_claim(s):
            ctype = (F.when(F.regexp_like(F.lower(s), F.lit("certif")), "certification")
                     .when(F.regexp_like(F.lower(s), F.lit("achiev|reached|reduced")), "achievement")
                     .when(F.regexp_like(F.lower(s), F.lit("target|aim|by 20")), "target")
                     .otherwise("commitment"))
            return F.struct(F.left(s, F.lit(500)).alias("claim_text"),
                            F.lit(None).cast("string").alias("esg_category"),
                            F.lit(None).cast("string").alias("sub_theme"),
                            F.nullif(F.regexp_extract(s, METRIC_RE, 1), F.lit("")).alias("metric"),
                            F.nullif(F.regexp_extract(s, YEAR_RE, 1), F.lit("")).alias("timeframe"),
                            ctype.alias("claim_type"))
        return F.to_json(F.transform(claim_sentences(text), to_claim))
    return rule


# ---------------------------------------------------------------------------
# K15 alignment rule
# ---------------------------------------------------------------------------
def alignment_rule(avg_sentiment="period_avg_sentiment", pct_critical="avg_pct_critical") -> Column:
    """clip(round(5 + 5·avg − pct/20), 0, 10); NULL inputs count as 0."""
    a = F.coalesce(F.col(avg_sentiment), F.lit(0.0))
    p = F.coalesce(F.col(pct_critical), F.lit(0.0))
    return F.least(F.greatest(F.round(F.lit(5.0) + a * 5.0 - p / 20.0, 0), F.lit(0.0)),
                   F.lit(10.0)).cast("int")


def alignment_label(score: Column) -> Column:
    return (F.when(score >= 7, "Aligned").when(score >= 4, "Partially aligned")
            .when(score >= 2, "Divergent").otherwise("Contradictory"))


def alignment_risk(score: Column) -> Column:
    return (F.when(score >= 7, "Low").when(score >= 4, "Medium").when(score >= 2, "High")
            .otherwise("Critical"))


def rule_delta() -> Callable[[DataFrame], Column]:
    """K5 stand-in: the delta answer as JSON text (ints and strings only)."""
    def rule(df: DataFrame) -> Column:
        s = alignment_rule()
        q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        return F.concat(
            F.lit('{"alignment_score": '), s.cast("string"),
            F.lit(', "alignment_label": '), q(alignment_label(s)),
            F.lit(', "gap_headline": '), q(F.concat(F.coalesce(F.col("esg_category"), F.lit("")),
                                                  F.lit(" alignment "), s.cast("string"),
                                                  F.lit("/10"))),
            F.lit(', "official_narrative": '), q(F.concat(F.col("claim_count").cast("string"),
                                                        F.lit(" claims"))),
            F.lit(', "public_narrative": '), q(F.concat(
                F.coalesce(F.col("total_articles").cast("string"), F.lit("0")),
                F.lit(" public articles"))),
            F.lit(', "key_gaps": [], "marketing_opportunity": null, "risk_level": '),
            q(alignment_risk(s)), F.lit("}"))
    return rule


def rule_quick_alignment() -> Callable[[DataFrame], Column]:
    def rule(df: DataFrame) -> Column:
        return F.concat(F.lit('{"alignment_score": '), alignment_rule().cast("string"), F.lit("}"))
    return rule


def rule_brief() -> Callable[[DataFrame], Column]:
    """K7 stand-in: brief JSON from the day's measures."""
    def rule(df: DataFrame) -> Column:
        q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        pulse = lambda c: F.least(F.col(c), F.lit(10)).cast("string")
        return F.concat(
            F.lit('{"headline": '), q(F.concat(F.col("total_articles").cast("string"),
                                               F.lit(" articles, "),
                                               F.col("critical_count").cast("string"),
                                               F.lit(" critical"))),
            F.lit(', "executive_brief": null, "top_risk": null, "top_opportunity": null'),
            F.lit(', "esg_pulse": {"environmental": '), pulse("env_count"),
            F.lit(', "social": '), pulse("social_count"),
            F.lit(', "governance": '), pulse("gov_count"),
            F.lit('}, "recommended_actions": []}'))
    return rule


def rule_headline() -> Callable[[DataFrame], Column]:
    def rule(df: DataFrame) -> Column:
        return F.concat(F.lit('{"headline": "'), F.col("total_articles").cast("string"),
                        F.lit(' articles today"}'))
    return rule

