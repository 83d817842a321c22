"""Search-response text → article records (B11, B12, B15, B17), natively.

A response holds result blocks headed ``WEB RESULTS:`` / ``NEWS RESULTS:``.
Blocks are cut with ``split``/``regexp_extract_all`` and exploded (a narrow
step: one output row per block, no shuffle).  Each block's line rules are
a small state machine, evaluated as a left fold over its lines with Spark's
``aggregate`` higher-order function and a struct accumulator — exact, JVM
side, and over the whole text:

* lines are matched trimmed; ``snippets:`` opens snippets and closes content;
  a lone ``content|page content|markdown|livecrawl content`` header (optional
  ``:`` or ``：``) opens content; a blank line closes snippets (and is kept
  as an empty line inside content); ``- x`` lines inside snippets are
  snippets; inside content nothing else is parsed;
* otherwise ``Title|URL|Published|Description: v`` fields, last one wins;
  Description only counts while no snippet and no content line was seen.

Body = content if longer than 200 chars, else snippets joined by a blank
line; records need a URL and a body of ≥ 80 chars (cut to 20 000).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.text import strip_py
from pulse.schemas import MAX_BODY_CHARS, MIN_BODY_CHARS

# The grammar of the input.  U: white space as in Unicode; d: only a line feed ends a line, so "."
# passes the other line separators of Unicode.
HEADER_RE = r"(?iUd)(WEB|NEWS) RESULTS:\s*\n"
CONTENT_HDR_RE = r"(?iUd)^(content|page content|markdown|livecrawl content)[:：]?\s*$"
CONTENTS_HDR_RE = r"(?iUd)^(content|markdown|page content)[:：]?\s*$"
FIELD_RE = r"(?iUd)^(Title|URL|Published|Description):\s*(.+)$"
TITLE_RE = r"(?iUd)^Title:\s*"


def _strip(c: Column) -> Column:
    return strip_py(c)


def _append(arr: Column, x: Column) -> Column:
    return F.concat(arr, F.array(x))


def _line_features(lines: Column, contents: bool = False) -> Column:
    """Per-line facts computed once (lambdas are evaluated without common-
    subexpression elimination, so each regex must appear exactly once, and
    only the facts the parser reads are computed: ``contents`` selects the
    page-contents parser's facts instead of the search-result ones)."""
    stripped = F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i"),
                                                        _strip(l).alias("s")))

    def feats(x):
        common = [x["l"].alias("l"), x["i"].alias("i"), x["s"].alias("s"),
                  (x["s"] == "").alias("blank")]
        if contents:
            return F.struct(*common,
                            x["s"].rlike(CONTENTS_HDR_RE).alias("contents_hdr"),
                            x["s"].rlike(TITLE_RE).alias("is_title"))
        return F.struct(*common,
                        F.lower(x["s"]).startswith("snippets:").alias("snip_hdr"),
                        x["s"].rlike(CONTENT_HDR_RE).alias("cont_hdr"),
                        x["s"].startswith("- ").alias("dash"),
                        F.lower(F.regexp_extract(x["s"], FIELD_RE, 1)).alias("key"))

    return F.transform(stripped, feats)


def _block_fold(feats: Column, n_lines: Column) -> Column:
    """Left fold over line features keeping O(1) state per step.

    Content and snippet sections are recorded as line ranges (segments) and
    sliced out once afterwards, so a block of n lines costs O(n)."""
    seg_t = "array<struct<kind:string,start:int,end:int>>"
    init = F.struct(F.lit(False).alias("snip"), F.lit(False).alias("cont"),
                    F.lit(0).alias("seg_start"), F.array().cast(seg_t).alias("segs"),
                    F.lit(0).alias("n_bullets"), F.lit(0).alias("n_content"),
                    F.lit(-1).alias("url"), F.lit(-1).alias("title"),
                    F.lit(-1).alias("published"), F.lit(-1).alias("desc"))

    def step(acc, x):
        snip_hdr = ~x["blank"] & x["snip_hdr"]
        cont_hdr = ~x["blank"] & ~x["snip_hdr"] & x["cont_hdr"]
        rest = ~x["blank"] & ~x["snip_hdr"] & ~x["cont_hdr"]
        bullet = rest & acc["snip"] & x["dash"]
        body_line = rest & ~bullet & acc["cont"]
        is_field = rest & ~bullet & ~acc["cont"] & (x["key"] != "")
        desc = is_field & (x["key"] == "description") & (acc["n_bullets"] == 0) \
            & (acc["desc"] < 0) & (acc["n_content"] == 0)
        header = snip_hdr | cont_hdr
        closes = (header & (acc["cont"] | acc["snip"])) | (x["blank"] & acc["snip"])
        kind = F.when(acc["cont"], F.lit("c")).otherwise(F.lit("s"))
        segs = F.when(closes, _append(acc["segs"], F.struct(
            kind.alias("kind"), acc["seg_start"].alias("start"), x["i"].alias("end")))) \
            .otherwise(acc["segs"])

        def field(name):  # index of the last line holding this field
            return F.when(is_field & (x["key"] == name), x["i"]).otherwise(acc[name])

        return F.struct(
            F.when(x["blank"], False).when(snip_hdr, True).when(cont_hdr, False)
             .otherwise(acc["snip"]).alias("snip"),
            F.when(snip_hdr, False).when(cont_hdr, True).otherwise(acc["cont"]).alias("cont"),
            F.when(header, x["i"] + 1).otherwise(acc["seg_start"]).alias("seg_start"),
            segs.alias("segs"),
            (acc["n_bullets"] + F.when(bullet, 1).otherwise(0)).alias("n_bullets"),
            (acc["n_content"] + F.when((x["blank"] & acc["cont"]) | body_line, 1).otherwise(0))
            .alias("n_content"),
            field("url").alias("url"), field("title").alias("title"),
            field("published").alias("published"),
            F.when(desc, x["i"]).otherwise(acc["desc"]).alias("desc"))

    def finish(acc):
        kind = F.when(acc["cont"], F.lit("c")).otherwise(F.lit("s"))
        segs = F.when(acc["cont"] | acc["snip"], _append(acc["segs"], F.struct(
            kind.alias("kind"), acc["seg_start"].alias("start"), n_lines.alias("end")))) \
            .otherwise(acc["segs"])
        return F.struct(acc["url"].alias("url"), acc["title"].alias("title"),
                        acc["published"].alias("published"), acc["desc"].alias("desc"),
                        segs.alias("segs"))

    return F.aggregate(feats, init, step, finish)


def _section(feats: Column, segs: Column, kind: str) -> Column:
    """Line features of all sections of one kind, in order (segments are [start, end))."""
    parts = F.transform(F.filter(segs, lambda g: g["kind"] == kind),
                        lambda g: F.slice(feats, g["start"] + 1, g["end"] - g["start"]))
    return F.flatten(parts)


def _field_value(feats: Column, idx: Column) -> Column:
    """Stripped value of the field line at ``idx`` ('' when there is none)."""
    line = F.element_at(feats, idx + 1)["s"]
    return F.when(idx >= 0, _strip(F.regexp_extract(line, FIELD_RE, 2))).otherwise(F.lit(""))


def _usable(records: DataFrame, body: str) -> DataFrame:
    """Records with a URL and a long enough body.

    A plain ``where`` would be pushed below the parsing projection and run the line fold once for the
    filter and once for every output column.  The parsed record is a one-element list here, which
    the filter empties before it is unfolded; every parsed column is read, so nothing is left to prune."""
    record = F.array(F.struct(*[F.col(c) for c in records.columns]))
    kept = F.filter(record, lambda r: (r["url"] != "") & (F.length(r[body]) >= MIN_BODY_CHARS))
    return records.select(F.inline(kept))


def _position(responses: DataFrame) -> list[str]:
    """The response's place in the collection (``tables.read_responses``), carried along if it is known."""
    return [c for c in ("position",) if c in responses.columns]


def explode_search_results(responses: DataFrame, text: str = "text") -> DataFrame:
    """One record per usable result block of each response row.

    Input columns: ``text`` plus the response's ``topic``, ``source_type``, ``query`` (and ``position``)."""
    t, place = F.col(text), _position(responses)
    ok = t.isNotNull() & (t != "") & ~_strip(t).startswith("Error:")
    blocks = F.slice(F.split(t, HEADER_RE, -1), 2, 1 << 30)
    kinds = F.regexp_extract_all(t, F.lit(HEADER_RE), 1)
    ex = (responses.where(ok)
          .select("source_type", "topic", "query", *place,
                  F.posexplode(F.arrays_zip(kinds.alias("kind"), blocks.alias("block")))
                  .alias("block_no", "b")))
    feats = ex.select("*", _line_features(F.split(F.col("b.block"), "\n", -1)).alias("_f"))
    folded = feats.select("*", _block_fold(F.col("_f"), F.size("_f")).alias("_p"))
    content_lines = F.transform(_section(F.col("_f"), F.col("_p.segs"), "c"),
                                lambda x: F.when(x["blank"], F.lit("")).otherwise(x["l"]))
    bullets = F.transform(F.filter(_section(F.col("_f"), F.col("_p.segs"), "s"),
                                   lambda x: x["dash"]),
                          lambda x: F.substring(x["s"], 3, 1 << 30))
    desc = _field_value(F.col("_f"), F.col("_p.desc"))
    snippets = F.concat(F.when(F.col("_p.desc") >= 0, F.array(desc))
                        .otherwise(F.array().cast("array<string>")), bullets)
    parts = folded.select(
        "source_type", "topic", "query", *place, "block_no", F.col("b.kind").alias("kind"),
        _field_value(F.col("_f"), F.col("_p.url")).alias("url"),
        _field_value(F.col("_f"), F.col("_p.title")).alias("title"),
        _field_value(F.col("_f"), F.col("_p.published")).alias("published"),
        _strip(F.array_join(content_lines, "\n")).alias("_content"),
        F.array_join(snippets, "\n\n").alias("_snips"))
    body = F.when(F.length("_content") > 200, F.col("_content")).otherwise(F.col("_snips"))
    out = parts.select(
        "url", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url")).alias("title"),
        body.alias("_body"), "source_type", F.col("topic").alias("search_topic"),
        F.col("published").alias("published_date"), F.lower("kind").alias("result_section"),
        F.lit("web-search").alias("scraper"), F.col("query").alias("search_query"), *place, "block_no")
    return _usable(out, "_body").select("url", "title", F.left("_body", F.lit(MAX_BODY_CHARS)).alias("content"),
                      "source_type", "search_topic", "published_date", "result_section",
                      "scraper", "search_query", (F.length("_body") > 500).alias("livecrawled"),
                      *place, "block_no")


def _contents_fold(feats: Column) -> Column:
    """Title state over the page-contents lines: a ``Title:`` line always sets it;
    before the first content header, the first other non-empty line sets it while empty."""
    init = F.struct(F.lit("").alias("title"), F.lit(False).alias("cont"))

    def step(acc, x):
        hdr = ~x["is_title"] & x["contents_hdr"]
        fallback = ~x["is_title"] & ~hdr & ~acc["cont"] & ~x["blank"] & (acc["title"] == "")
        return F.struct(
            F.when(x["is_title"], F.regexp_replace(x["s"], TITLE_RE, ""))
             .when(fallback, x["s"]).otherwise(acc["title"]).alias("title"),
            (acc["cont"] | hdr).alias("cont"))

    return F.aggregate(feats, init, step)


def explode_url_contents(responses: DataFrame, text: str = "text") -> DataFrame:
    """Page-contents text split on ``URL:`` lines → (url, title, content) records.

    Content = every line after the first content header except ``Title:`` lines
    and further headers (a content header never closes content here)."""
    t, place = F.col(text), _position(responses)
    ok = t.isNotNull() & (t != "") & ~_strip(t).startswith("Error:")
    blocks = F.slice(F.split(F.concat(F.lit("\n"), t), r"(?U)\nURL:\s*", -1), 2, 1 << 30)
    ex = responses.where(ok).select(*place, F.posexplode(blocks).alias("block_no", "block"))
    lines = F.split("block", "\n", -1)
    feats = ex.select(*place, "block_no", _strip(F.element_at(lines, 1)).alias("url"),
                      _line_features(F.slice(lines, 2, 1 << 30), contents=True).alias("_f"))
    first_hdr = F.array_position(
        F.transform("_f", lambda x: ~x["is_title"] & x["contents_hdr"]), True)
    body = F.filter(F.slice("_f", first_hdr + 1, 1 << 30),
                    lambda x: ~x["is_title"] & ~x["contents_hdr"])
    p = feats.select(*place, "block_no", "url", _contents_fold(F.col("_f"))["title"].alias("title"),
                     F.when(first_hdr > 0, _strip(F.array_join(F.transform(body, lambda x: x["l"]),
                                                               "\n")))
                     .otherwise(F.lit("")).alias("_c"))
    return (_usable(p, "_c")
            .select("url", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url"))
                    .alias("title"), F.left("_c", F.lit(MAX_BODY_CHARS)).alias("content"),
                    F.lit("page-contents").alias("scraper"), *place, "block_no"))
