"""DuckDB SQL of the queries over stored state (``pulse.plans.stored_blocks``)."""

from __future__ import annotations

from checks.oracle_sql import ORACLE, _collapse, _sq, _strip, q, spark_rounds
from pulse.functions import prompts as P

_EXPLORE = """
SELECT article_id, url, title, content_preview, source_type, search_topic, esg_category, esg_sub_theme,
  sentiment_label, round(sentiment_score, 3) AS sentiment_score, stance, credibility_score, is_official_csr,
  impact_summary, scraped_date, published_at, language, scraper
FROM insights {where}
ORDER BY scraped_date DESC NULLS LAST, credibility_score DESC NULLS LAST, article_id, url, published_at
LIMIT {limit} OFFSET {offset}"""

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# The day's records in phase order, with the place of each in its phase.
_DAY = f"""
, day_docs AS (
  SELECT *, 'https://day.example.org/d/' || CAST(doc_id - doc_id % 3 AS VARCHAR) AS d_url, -doc_id AS place FROM documents),
day_search AS (
  SELECT 0 AS phase, 'search' AS collector, place, d_url AS url, 'T' || CAST(doc_id AS VARCHAR) AS title, source AS source_type,
    'esg_news' AS search_topic, '' AS author, '2024-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS published_date,
    'web-search' AS scraper, left(body, 20000) AS content
  FROM (SELECT *, CASE WHEN length({_strip('text')}) > 200 THEN {_strip('text')}
          ELSE substr(regexp_replace('- ' || {_collapse('substr(text, 1, 120)')}, '\\s+$', '', 'g'), 3) END AS body FROM day_docs) x
  WHERE length(body) >= 80),
day_pages AS (
  SELECT 1 AS phase, 'search' AS collector, place, x.url, title, COALESCE(m.source_type, 'official') AS source_type,
    COALESCE(m.topic, 'direct_fetch') AS search_topic, '' AS author, '' AS published_date, 'page-contents' AS scraper, content
  FROM (SELECT place, 'C' || CAST(doc_id AS VARCHAR) AS title, left({_strip('text')}, 20000) AS content,
          CASE WHEN doc_id % 10 = 0 THEN d_url ELSE 'https://day.example.org/p/' || CAST(doc_id - doc_id % 2 AS VARCHAR) END AS url
        FROM day_docs WHERE length({_strip('text')}) >= 80) x
  LEFT JOIN (VALUES ('https://day.example.org/p/4', 'official', 'strategy'),
    ('https://day.example.org/p/8', 'ngo', 'human_rights')) m(url, source_type, topic) ON x.url = m.url),
feed_rows AS (
  SELECT source AS feed_name, doc_id AS item_no,
    CASE WHEN doc_id % 9 = 4 THEN '' WHEN doc_id % 9 = 5 THEN NULL
         ELSE 'https://feeds.example.org/i/' || CAST(doc_id AS VARCHAR) END AS link,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE substr(text, 1, 80) END AS title,
    CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN NULL ELSE '<p>' || text || '</p>' || chr(10) END AS summary,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE '<div class="d">' || text || '</div>' END AS description,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS author,
    CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN NULL
         ELSE 'Mon, ' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' Apr 2024 10:00:00 +0000' END AS pubDate,
    CASE WHEN doc_id % 3 = 0 THEN '2024-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T08:30:00' END AS updated
  FROM documents),
day_feeds AS (
  SELECT 2 AS phase, 'rss' AS collector, item_no AS place, link AS url, COALESCE(title, '') AS title, 'news' AS source_type,
    'feed' AS search_topic, COALESCE(author, '') AS author,
    COALESCE(strftime(COALESCE(timezone('UTC', try_strptime(substr(pubDate, 6), '%d %b %Y %H:%M:%S %z')),
      TRY_CAST(updated AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%S'), '') AS published_date, 'feed' AS scraper,
    trim(regexp_replace(COALESCE(NULLIF(summary, ''), NULLIF(description, '')), '<[^>]+>', ' ', 'g'), {_WS}) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY feed_name ORDER BY item_no) AS rn FROM feed_rows) i
  JOIN (SELECT 'src' || CAST(k AS VARCHAR) AS fname,
          CASE k % 3 WHEN 0 THEN ['the', 'und'] WHEN 1 THEN ['de'] ELSE [] END AS kw FROM range(20) r(k)) f ON feed_name = fname
  WHERE rn <= 20 AND link IS NOT NULL AND link != ''
    AND (len(kw) = 0 OR len(list_filter(kw, lambda k: contains(lower(COALESCE(title, '') || ' ' || COALESCE(summary, '')), lower(k)))) > 0)),
day_raw AS (SELECT * FROM day_search UNION ALL SELECT * FROM day_pages
  UNION ALL SELECT * FROM day_feeds WHERE content IS NOT NULL AND content != ''),
day_first AS (SELECT * FROM day_raw WHERE url IS NOT NULL AND url != ''
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY phase, place) = 1)
"""

_STORED = {
    "a11_incremental_weekly": "SELECT * FROM weekly",
    "a11_incremental_daily": "SELECT * FROM daily",
    "g01_deep_explore": _EXPLORE.format(where="", limit=50, offset=500),
    "g01_deep_explore_filtered": _EXPLORE.format(
        where="WHERE esg_category = 'Social' AND scraped_date >= DATE '2024-01-15'", limit=20, offset=40),
    "b08_many_keywords": """
, said AS (
  SELECT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS w FROM benchmark),
pairs AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS keyword FROM said, unnest(range(1, len(w))) u(i)),
long_pairs AS (SELECT keyword FROM pairs WHERE length(keyword) >= 12)
SELECT 'web' AS feed_name, page_id AS item_no FROM pages
WHERE EXISTS (SELECT 1 FROM long_pairs WHERE contains(lower(COALESCE(url, '') || ' ' || COALESCE(html, '')), keyword))""",
    "c10_quarantine": """
, cleaned AS (
  SELECT doc_id, url, source_type, content,
    trim(regexp_replace(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '&(amp|lt|gt|nbsp|quot);', ' ', 'g'), '\\s+', ' ', 'g')) AS c
  FROM landing WHERE url IS NOT NULL AND content IS NOT NULL),
judged AS (
  SELECT *, list_filter([CASE WHEN length(trim(content)) < 150 THEN 'raw_length' END,
      CASE WHEN COALESCE(length(c), 0) < 150 THEN 'valid_content' END,
      CASE WHEN length(url) <= 10 THEN 'valid_url' END], lambda x: x IS NOT NULL) AS broken FROM cleaned)
SELECT doc_id, url, source_type, length(c)::BIGINT AS clean_chars, array_to_string(broken, ',') AS broken_rules,
  CASE WHEN source_type IN ('official','news','social','ngo','benchmark','rss') THEN '' ELSE 'valid_source' END AS warnings
FROM judged WHERE len(broken) > 0""",
    "h02_first_across_runs": """
, runs AS (SELECT url, doc_id, source_type, scraped_at,
    CASE WHEN doc_id % 10 = 9 THEN doc_id % 3 ELSE doc_id % 2 END AS k FROM landing WHERE url IS NOT NULL AND url <> '')
SELECT url, doc_id, source_type, 'run-' || CAST(k AS VARCHAR) AS run FROM runs
QUALIFY row_number() OVER (PARTITION BY url ORDER BY k, scraped_at, doc_id) = 1""",
    "j05_stored_metrics": """
, counted AS (
  SELECT length(clean_content) AS c, url, source_type FROM silver0)
SELECT 'silver_articles' AS query, 'silver_quality' AS name, metric, value::BIGINT AS value FROM (
  SELECT unnest(['rows', 'valid_content_violations', 'valid_url_violations', 'valid_source_violations']) AS metric,
    unnest([COUNT(*), COUNT(*) FILTER (WHERE COALESCE(c, 0) < 150), COUNT(*) FILTER (WHERE COALESCE(length(url), 0) <= 10),
      COUNT(*) FILTER (WHERE NOT COALESCE(source_type IN ('official','news','social','ngo','benchmark','rss'), false))]) AS value
  FROM counted)""",
    "k01_resumable_answers": """
SELECT article_id, url, scraped_date,
  substr(sha256(concat_ws('|', source_type, search_topic, title)), 1, 16) AS answer FROM insights""",
    "l00_daily_landing": _DAY + """
SELECT url, title, source_type, search_topic, author, published_date, CAST(length(content) AS VARCHAR) AS content_length, scraper,
  'run-20240430' AS _scrape_run_id FROM day_first""",
    "l00_daily_run_log": _DAY + """
SELECT collector AS source_type, COUNT(*) AS count FROM day_raw GROUP BY collector
UNION ALL SELECT 'total', COUNT(*) FROM day_first""",
}

_MEAN = "CAST(round(COALESCE(period_avg_sentiment, 0.0), 2) AS VARCHAR)"
_STORED["k10_delta_prompts"] = f"""
, digests AS (
  SELECT esg_category, sub_theme, string_agg(left(claim_text, 200), ' | ' ORDER BY scraped_date DESC NULLS LAST, claim_id NULLS LAST) AS combined
  FROM claims WHERE claim_text IS NOT NULL GROUP BY ALL)
SELECT j.esg_category, j.sub_theme, latest_week, total_articles,
  sha256({_sq(P.DELTA_INSTR.format(entity=P.ENTITY))} || 'Topic ' || COALESCE(j.esg_category, '') || ', theme ' || COALESCE(j.sub_theme, '') ||
    '. What the company states: ' || left(combined, {P.DELTA_CLAIMS}) || ' What others write (mean score ' || {_MEAN} || ', ' ||
    CAST(round(COALESCE(avg_pct_critical, 0.0), 1) AS VARCHAR) || ' percent critical): ' ||
    left(COALESCE(sentiment_evidence_summary, 'nothing in this window'), {P.DELTA_EVIDENCE})) AS delta_prompt,
  sha256({_sq(P.QUICK_INSTR.format(entity=P.ENTITY))} || 'Statements: ' || left(combined, {P.QUICK_CLAIMS}) || ' Mean public score: ' || {_MEAN}) AS quick_prompt
FROM joined j JOIN digests d ON j.esg_category IS NOT DISTINCT FROM d.esg_category AND j.sub_theme IS NOT DISTINCT FROM d.sub_theme"""

STORED_ORACLE = {k: spark_rounds(q(v)) for k, v in _STORED.items()}
STORED_ORACLE |= {
    "a14_clustered_silver": ORACLE["l03_silver_articles"],
    "c18_title_search": ORACLE["m01_explore_filtered"],
    "e02_kpis_from_days": ORACLE["m06_kpis"],
    "g01_deep_events_page": ORACLE["m12_events_page"],
    "g01_deep_events": """
SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 50 OFFSET 5000""",
}
