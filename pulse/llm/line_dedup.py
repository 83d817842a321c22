"""Operator 6: line deduplication by an exact set-similarity join, with DataFrame functions only.

Lines are lower-cased and their words are what stands between white space (blank and \\x09-\\x0D).  A line's tokens are
its distinct ``SHINGLE``-word shingles (all its words, if it has no more).  A line is removed if an earlier line - smaller
document id, then text hash, then line number - has the same words or a Jaccard similarity of at least
``NUMERATOR / DENOMINATOR``.

Lines of equal words form a class, found by partial aggregation; only its first line goes on.  In any fixed order of the tokens,
two similar classes share s tokens of their openings: of n tokens the first n - ceil(t * n) + s (prefix filter).

1. In the order of the token hashes, classes that share fewer than ``SHARED`` tokens of their opening with others are done.
2. The others are read again as whole token sets, and each token's classes are counted.  A class of which fewer than
   ceil(t * n) tokens stand in another class is done.  The rest keep these shared tokens, ordered by rarity.
3. Classes that share a token of their openings by rarity are joined, if their sizes fit (length filter) and enough
   tokens are left after the shared one (positional filter); the token sets then give the exact Jaccard.  Every pair
   of similar classes is a link and found once; classes under a frequent token are compared in parts.

A line goes if its class has a link to an earlier one or an earlier line has the same words.  Components of the links
group the classes (``line_report``).

Edge cases: a null text has no lines and stays null; a line without words is never removed; a document may lose all its
lines and is then empty; rows that repeat both id and text share one result; null ids come last; other columns
pass through, own ones have names that start with "__".
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.llm.common import free, ranked, saved, sized
from pulse.llm.components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5
SHARED = 4              # tokens of the first openings that a similar line must have
FEW = 16                # openings of a token whose pairs are listed before they are compared
BLOCK = 2048            # classes under one token that are compared in one part
OTHER_BLANKS = "\t\x0b\f\r"
_PLACE = ["doc_hash", "line_no"]    # and doc_id, which may be null


def _one_each(docs: DataFrame) -> DataFrame:
    """(doc_id, text) without repeated rows; only documents that are repeated are shuffled."""
    hashed = docs.withColumn("doc_hash", F.xxhash64("text"))
    again = saved(hashed.groupBy(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash"))
                  .agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "repeated")
    if again.isEmpty():
        return docs
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("doc_hash") == F.col("__hash"))
    repeated = hashed.join(sized(again), same, "left_semi").dropDuplicates(["doc_id", "doc_hash"])
    once = hashed.join(sized(again), same, "left_anti")
    return once.unionByName(saved(repeated, "repeated-texts")).drop("doc_hash")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> every line, lower-cased, with plain blanks between its words."""
    other = [F.contains("text", F.lit(c)) for c in OTHER_BLANKS]
    # a look for rare characters is cheaper than translating every text
    plain = F.when(reduce(or_, other), F.translate("text", "".join(OTHER_BLANKS), " " * len(OTHER_BLANKS))).otherwise(F.col("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("doc_hash"),
                       F.posexplode(F.split(F.lower(plain), "\n")).alias("line_no", "line"))


def _with_words(lines: DataFrame) -> DataFrame:
    """The line's words instead of it."""
    return lines.withColumn("words", F.array_remove(F.split("line", " "), "")).drop("line")


def _with_tokens(lines: DataFrame) -> DataFrame:
    """The line's words become its tokens: the distinct shingle hashes, ascending."""
    starts = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    shingles = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(SHINGLE)]))
    tokens = F.when(F.size("words") > SHINGLE, F.sort_array(F.array_distinct(shingles))).otherwise(
        F.array(F.xxhash64("words")))
    return lines.withColumn("tokens", tokens).drop("words")


def _needed(n: Column) -> Column:
    """So many tokens of a set of n stand in any similar set."""
    return F.ceil(n * NUMERATOR / DENOMINATOR).cast("int")


def _opening_size(n: Column, shared: int = 1) -> Column:
    """Of this many first tokens of a set of n any similar set has ``shared`` (or all it needs) in its own opening."""
    return n - _needed(n) + F.least(F.lit(shared), _needed(n))


def _classes(lines: DataFrame) -> DataFrame:
    """One row per distinct words: its first place, numbered (cid) in the order of the first places, and its opening."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_hash", "line_no")).alias("first")
    flat = (lines.where("worded").groupBy("k1", "k2").agg(first, F.any_value(F.struct("opening", "need")).alias("own"))
            .select("k1", "k2", "first.*", "own.*"))
    order = [F.col(c) for c in ("none", "doc_id", "doc_hash", "line_no")]
    numbered = ranked(flat, *order, name="cid")
    classes = saved(numbered.drop("none"), "line-classes")
    free(numbered)
    return classes


def _firsts(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """The lines that are first of their class, with its cid."""
    keys = classes.select(*[F.col(c).alias(f"__{c}") for c in (*_PLACE, "doc_id")], "cid")
    same = [F.col(c) == F.col(f"__{c}") for c in _PLACE]
    return lines.join(keys, [*same, F.col("doc_id").eqNullSafe(F.col("__doc_id"))])


def _shared(posted: DataFrame) -> DataFrame:
    """token, alike: the tokens of more than one class, with the number of their classes (a partial aggregate)."""
    return (posted.groupBy("token").agg(F.count(F.lit(1)).alias("alike")).where("alike > 1")
            .select(F.col("token").alias("__token"), "alike"))


def _token_sets(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, tokens) of the classes of whose opening other classes' openings share ``SHARED`` tokens (or all it needs).

    Only these lines are cut into tokens again; storing them keeps that from being repeated in a filter.  Also the classes
    without openings, which replace ``classes``."""
    posted = classes.select("cid", "need", F.explode("opening").alias("token"))
    sharing = saved(posted.join(_shared(posted), F.col("token") == F.col("__token"), "left_semi")
                    .groupBy("cid", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("cid"), "sharing")
    wanted = saved(classes.drop("opening", "need").join(sized(sharing), "cid", "left_semi"), "wanted")
    narrow = saved(classes.drop("opening", "need"), "classes")
    free(sharing, classes)
    texts = wanted.select(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).distinct()
    some = docs.join(sized(saved(texts, "wanted-texts")), _same_document("doc_id", "text"), "left_semi")
    sets = saved(_with_tokens(_with_words(_firsts(_lines(some), sized(wanted)))).select("cid", "tokens"), "token-sets")
    free(wanted)
    return sets, narrow


def _candidates(sets: DataFrame) -> DataFrame:
    """(cid, n, common) of the classes with enough shared tokens for a match: their shared tokens, the rarest first.

    Tokens of one class alone come before them in the order of rarity and never match: their number is n less these."""
    posted = sets.select("cid", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = (posted.join(_shared(posted.select("token")), F.col("token") == F.col("__token"))
              .groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("alike", "token"))).alias("common")))  # its own tokens
    return common.where(F.size("common") >= _needed(F.col("n"))).withColumn("common", F.transform("common", lambda t: t["token"]))


def _posted(sets: DataFrame) -> DataFrame:
    """Every shared token of the openings by rarity: cid, n, at (its place in the whole order), token."""
    alone = F.col("n") - F.size("common")
    opening = F.slice("common", F.lit(1), F.greatest(_opening_size(F.col("n")) - alone, F.lit(0)))
    return sets.select("cid", "n", alone.alias("alone"), F.posexplode(opening).alias("at", "token")).select(
        "cid", "n", (F.col("at") + F.col("alone")).alias("at"), "token")


def _opening(common: str, n: str) -> Column:
    size = _opening_size(F.col(n)) - (F.col(n) - F.size(common))
    return F.slice(common, F.lit(1), F.greatest(size, F.lit(0)))


def _renamed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__{c}") for c in df.columns])


def _may_match() -> Column:
    """Length and positional filter of two classes under a token that both openings hold."""
    a, b = NUMERATOR, DENOMINATOR
    most = F.least("at", "__at") + F.least(F.col("n") - F.col("at"), F.col("__n") - F.col("__at"))
    return ((F.least("n", "__n") * b >= F.greatest("n", "__n") * a) & (most * (a + b) >= (F.col("n") + F.col("__n")) * a))


def _similar() -> Column:
    a, b = NUMERATOR, DENOMINATOR
    return F.size(F.array_intersect("common", "__common")) * (a + b) >= (F.col("n") + F.col("__n")) * a


def _links_of_rare(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links under tokens of at most ``FEW`` openings: a few pairs a class, made distinct and then verified."""
    pairs = posted.join(_renamed(posted), (F.col("token") == F.col("__token")) & (F.col("__cid") < F.col("cid")) & _may_match())
    pairs = saved(pairs.select("cid", F.col("__cid").alias("earlier")).distinct(), "line-pairs")
    links = saved(pairs.join(sets, "cid").join(_renamed(sets), F.col("earlier") == F.col("__cid")).where(_similar())
                  .select("cid", "earlier"), "rare-links")
    free(pairs)
    return links


def _links_of_frequent(posted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links under the other tokens: compared inside the join, so that only links leave it.

    A pair is compared under the first token that both openings have.  The classes of a token in more than ``BLOCK`` openings are
    dealt into parts on one side, and met by copies of the other."""
    posted = posted.join(sets.select("cid", "common"), "cid").withColumn("parts", F.ceil(F.col("alike") / BLOCK).cast("int")).drop("alike")
    left = posted.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    right = _renamed(posted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    both = F.array_intersect(_opening("common", "n"), _opening("__common", "__n"))
    links = left.join(right, (F.col("token") == F.col("__token")) & (F.col("part") == F.col("__part"))
                      & (F.col("__cid") < F.col("cid")) & _may_match() & (F.get(both, F.lit(0)) == F.col("token")) & _similar())
    return saved(links.select("cid", F.col("__cid").alias("earlier")), "frequent-links")


def line_links(sets: DataFrame) -> DataFrame:
    """(cid, earlier) of all similar classes, every pair once, from ``_candidates``.

    Classes are joined under the shared tokens of their openings, if their sizes fit (length filter) and enough tokens are
    left behind the shared one (positional filter); their token sets then give the exact Jaccard."""
    alone = saved(_posted(sets), "posted")
    posted = saved(alone.join(_shared(alone), F.col("token") == F.col("__token")).drop("__token"), "posted-shared")
    free(alone)
    rare = _links_of_rare(posted.where(F.col("alike") <= FEW).drop("alike"), sets)
    frequent = _links_of_frequent(posted.where(F.col("alike") > FEW), sets)
    links = saved(rare.unionByName(frequent).distinct(), "line-links")
    free(posted, rare, frequent)
    return links


def _linked(links: DataFrame, classes: DataFrame, grouped: bool) -> DataFrame:
    """Per linked class: links, near (an earlier class is similar) and, if ``grouped``, the id that its component is first in."""
    ends = links.select("cid", F.lit(True).alias("later")).unionByName(
        links.select(F.col("earlier").alias("cid"), F.lit(False).alias("later")))
    counted = ends.groupBy("cid").agg(F.count(F.lit(1)).alias("links"), F.max("later").alias("near"))
    if not grouped:
        return saved(counted, "linked-classes")
    reached = components(links.select(F.col("cid").alias("a"), F.col("earlier").alias("b")))
    roots = reached.join(classes.select(F.col("cid").alias("root"), F.col("doc_id").alias("root_id")), "root")
    out = saved(counted.join(roots.select(F.col("node").alias("cid"), "root_id"), "cid", "left"), "linked-classes")
    free(reached)
    return out


def judged_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", grouped: bool = False) -> DataFrame:
    """Every line that has words: doc_id, doc_hash, line_no, cid, first_id (of its class), links (of its class), removed.

    ``grouped``: first_id is that of the class's component, the classes that similar lines connect."""
    own = _one_each(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    words = _with_words(_lines(own)).withColumns({
        "k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit(1), F.col("words")), "worded": F.size("words") > 0})
    tokens = _with_tokens(words)
    opening = F.slice("tokens", F.lit(1), _opening_size(F.size("tokens"), SHARED))
    lines = saved(tokens.withColumns({"opening": opening, "need": F.least(F.lit(SHARED), _needed(F.size("tokens")))})
                  .drop("tokens"), "lines")
    classes = _classes(lines)
    narrow = saved(lines.where("worded").drop("opening", "need", "worded"), "narrow-lines")
    free(lines)
    token_sets, classes = _token_sets(own, classes)
    sets = saved(_candidates(token_sets), "candidates")
    free(token_sets)
    links = line_links(sets)
    free(sets)
    linked = _linked(links, classes, grouped)
    root = [F.coalesce("root_id", "__doc_id").alias("first_id")] if grouped else [F.col("__doc_id").alias("first_id")]
    judged = classes.join(sized(linked), "cid", "left").select(
        *[F.col(c).alias(f"__{c}") for c in ("k1", "k2", *_PLACE, "doc_id")], "cid", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("near", F.lit(False)).alias("near"), *(["root_id"] if grouped else []))
    is_first = ((F.col("doc_hash") == F.col("__doc_hash")) & (F.col("line_no") == F.col("__line_no"))
                & F.col("doc_id").eqNullSafe(F.col("__doc_id")))
    done = saved(narrow.join(judged, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")))
                 .select("doc_id", "doc_hash", "line_no", "cid", *root, "links", (~is_first | F.col("near")).alias("removed")),
                 "judged-lines")
    free(narrow, classes, links, linked)
    return done


def _per_document(lines: DataFrame) -> DataFrame:
    """Per document: the least first_id of its lines, the links of its distinct lines, its removed lines."""
    own = F.collect_set(F.struct("cid", "links"))       # at most the document's lines
    return lines.groupBy(F.col("doc_id").alias("__id"), F.col("doc_hash").alias("__hash")).agg(
        F.min("first_id").alias("__first"),
        F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["links"]).alias("__links"),
        F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line_no")))).alias("__removed"))


def _same_document(id_col: str, text_col: str) -> Column:
    return F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash"))


def line_report(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, class_id, n_lines, n_links, removed (line numbers).

    class_id: the smallest id in which an equal line of one of its lines stands, or a line that links of similar lines connect
    to it; n_links: pairs of one of its distinct lines and a similar, not equal line (a class of equal lines counts once)."""
    per = _per_document(judged_lines(docs, id_col=id_col, text_col=text_col, grouped=True))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("doc_hash"),
                      F.coalesce(F.size(F.split(text_col, "\n")), F.lit(0)).alias("lines"),
                      F.col(text_col).isNull().alias("none"))
    none = F.array().cast("array<int>")
    return own.join(per, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("doc_hash") == F.col("__hash")), "left").select(
        "doc_id", F.least("doc_id", "__first").alias("class_id"),
        F.when(F.col("none"), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
        F.coalesce("__links", F.lit(0)).alias("n_links"),
        F.coalesce("__removed", none).alias("removed"))


def dedup_lines(docs: DataFrame, *, id_col="doc_id", text_col="text", chars_col="n_chars") -> DataFrame:
    """``docs`` without the removed lines; ``chars_col`` (if any) counts the new text of changed documents."""
    per = _per_document(judged_lines(docs, id_col=id_col, text_col=text_col)).where(F.size("__removed") > 0)
    found = docs.join(per, _same_document(id_col, text_col), "left")
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    changed = F.col("__removed").isNotNull()
    found = found.withColumn("__text", F.when(changed, text).otherwise(F.col(text_col)))
    out = {text_col: F.col("__text")}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out[chars_col] = F.when(changed, F.length("__text").cast(kind)).otherwise(F.col(chars_col))
    return found.select(*[out.get(c, F.col(c)).alias(c) for c in docs.columns])
