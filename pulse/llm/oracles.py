"""DuckDB SQL of the operator queries that SQL can express."""

from __future__ import annotations

from pulse.llm.licenses import COVER, GAP, K, NOTICES, PHRASES, template_grams

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mixing_sql(docs: str = "documents", seed: int = 20240601) -> str:
    """CTEs ending in ``taken``: every row of ``docs`` with size, source_size, target and repeats."""
    return rf"""
sized as (
  select d.*, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint as u
  from {docs} d),
per as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight
  from sized group by source),
levels as (
  select *, 2 * source_size as cap,
         sum(2 * source_size) over w - 2 * source_size as clamped, sum(weight) over () - sum(weight) over w + weight as free,
         1.5::double * sum(source_size) over () as goal
  from per window w as (order by source_size / weight, source nulls last)),
level as (
  select max(l) as level from (
    select *, (goal - clamped)::double / free as l from levels) where cap >= l * weight),
targets as (
  select source, source_size, least(cap::double, level * weight) as target from levels, level),
rated as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from targets),
goals as (select *, target - whole * source_size as goal from rated),
hashed as (
  select source, u, sum(size) as words from sized group by source, u),
running as (
  select h.*, g.goal, sum(words) over (partition by h.source order by u) as upto
  from hashed h join goals g on h.source is not distinct from g.source),
cuts as (
  select source, max(u) as cut from running
  where upto <= goal or (upto - words <= goal and upto - goal <= goal - (upto - words)) group by source),
taken as (
  select s.*, g.source_size, g.target,
         (g.whole + case when s.u <= c.cut then 1 else 0 end)::bigint as repeats
  from sized s join goals g on s.source is not distinct from g.source
  left join cuts c on c.source is not distinct from s.source)"""


OP1 = f"""with {mixing_sql()}
select doc_id, size, source_size, target, (repeats * size)::bigint as taken, repeats from taken"""

OP2 = rf"""
with split as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rhost, rpath, says) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (
  select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule,
         max_by(says, length(rhost || rpath)) as says
  from (select distinct page_id, host, path from split) s
  join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id)
select s.page_id, s.host, s.path, f.rule, coalesce(f.says, 'allow') as verdict
from split s left join fits f on s.page_id = f.page_id"""


def plain_words(col: str = "text") -> str:
    return rf"regexp_extract_all(translate({col}, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def hits_sql(docs: str = "documents", benchmark: str = "benchmark") -> str:
    """CTEs ending in ``judged``: n_words, n_hit, n_items and items_sha256 of every row of ``docs``."""
    return rf"""
doc_words as (select row_number() over () as rid, doc_id, coalesce({plain_words()}, []) as words from {docs}),
item_words as (select item_id, {plain_words()} as words from {benchmark} where text is not null),
windows as (
  select distinct item_id, least(13, len(words)) as size, array_to_string(words[p:p + least(13, len(words)) - 1], ' ') as gram
  from item_words, unnest(range(1, len(words) - least(13, len(words)) + 2)) as u(p) where len(words) > 0),
grams as (
  select rid, p, size, array_to_string(words[p:p + size - 1], ' ') as gram
  from doc_words, (select distinct size from windows), unnest(range(1, len(words) - size + 2)) as u(p)
  where len(words) >= size),
matches as (select rid, p, g.size, item_id from grams g join windows w on g.size = w.size and g.gram = w.gram),
hit as (select rid, count(distinct p + o) as n_hit from matches, unnest(range(0, size)) as u(o) group by rid),
items as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
  from matches group by rid),
judged as (
  select d.rid, doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
         coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
         coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
  from doc_words d left join hit using (rid) left join items using (rid))"""


OP3 = f"""with {hits_sql()}
select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from judged"""

OP5 = """
with payloads as (select page_id, coalesce(html, '') as payload from pages),
hashed as (select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as h,
                  max(page_id) over (partition by payload) as best from payloads)
select page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)::int) & 31) + 1)::int, 1) for i in range(32)], '')
         as payload_digest,
       case when page_id is not distinct from best then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from best then best end as refers_to
from hashed"""

def line_sql(docs: str = "documents") -> str:
    """CTEs ending in ``lines``: every line of ``docs`` that has words, with its class's first id and whether it goes."""
    return rf"""
raw as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from (select distinct doc_id, text from {docs})),
worded as (select doc_id, text, line_no, list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from raw),
numbered as (select *, row_number() over (order by doc_id nulls last, text, line_no) as pos from worded where len(words) > 0),
classes as (select words, min(pos) as cid, arg_min(doc_id, pos) as first_id from numbered group by words),
tokens as (
  select distinct cid, array_to_string(words[p:p + 4], ' ') as token
  from classes, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as u(p)),
sizes as (select cid, count(*) as n from tokens group by cid),
links as (
  select x, y from (
    select a.cid as x, b.cid as y, count(*) as common from tokens a join tokens b on a.token = b.token and b.cid < a.cid group by 1, 2)
  join sizes s on s.cid = x join sizes t on t.cid = y where 5 * common >= 4 * (s.n + t.n - common)),
ends as (select x as a, y as b from links union all select y, x from links),
reached as (select a, b from ends union select r.a, e.b from reached r join ends e on r.b = e.a),
linked as (select a as cid, count(*) as n_links from ends group by a),
lines as (
  select n.doc_id, n.text, line_no, c.cid, coalesce(n_links, 0) as n_links,
    (select first_id from classes k where k.cid = least(c.cid, (select min(b) from reached where a = c.cid))) as first_id,
    pos <> c.cid or c.cid in (select x from links) as removed
  from numbered n join classes c on n.words = c.words left join linked l on l.cid = c.cid)"""


OP6 = f"""with recursive {line_sql()},
counted as (select doc_id, text, sum(n_links)::bigint as n_links from (select distinct doc_id, text, cid, n_links from lines) group by all),
per as (select l.doc_id, l.text, min(first_id) as first_id, any_value(c.n_links) as n_links,
               string_agg(line_no::varchar, ',' order by line_no) filter (where removed) as removed
        from lines l join counted c on l.doc_id is not distinct from c.doc_id and l.text = c.text group by l.doc_id, l.text)
select d.doc_id, least(d.doc_id, first_id) as class_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines,
       coalesce(n_links, 0)::bigint as n_links, coalesce(removed, '') as removed
from documents d left join per on d.doc_id is not distinct from per.doc_id and d.text = per.text"""

def _template_rows() -> str:
    return ", ".join(f"({t}, '{label}', {exact}, {n}, {at}, '{gram}', {needed})"
                     for t, label, exact, n, at, gram, needed in template_grams(PHRASES + NOTICES, K))


OP8 = f"""
with templates(template, label, exact, grams, tpos, gram, needed) as (values {_template_rows()}),
musts as (select template, count(*) filter (where needed) as needs from templates group by template),
doc_words as (select row_number() over () as rid, doc_id, coalesce({plain_words()}, []) as words from documents),
grams as (select rid, p - 1 as pos, array_to_string(words[p:p + {K} - 1], ' ') as gram
  from doc_words, unnest(range(1, len(words) - {K} + 2)) as u(p) where len(words) >= {K}),
votes as (select rid, template, label, exact, grams, tpos, needed, pos, pos - tpos as diagonal from grams join templates using (gram)),
gaps as (select *, diagonal - lag(diagonal) over (partition by rid, template order by diagonal) as gap
  from (select distinct rid, template, exact, diagonal from votes)),
spans as (select rid, template, diagonal,
    sum(case when exact or gap is null or gap > {GAP} then 1 else 0 end) over (partition by rid, template order by diagonal) as span
  from gaps),
merged as (
  select rid, template, label, exact, span, min(pos) as first, count(distinct tpos) as covered, any_value(grams) as grams,
         count(distinct tpos) filter (where needed) as met
  from votes join spans using (rid, template, diagonal) group by rid, template, label, exact, span),
good as (
  select rid, label, exact, first, covered / grams as cover from merged join musts using (template)
  where case when exact then covered = grams else covered / grams >= {COVER} and met = needs end),
found as (
  select rid, count(*) filter (where exact) as n_base, min(first) filter (where exact) as first_word,
         max(first) filter (where exact) as last_word, string_agg(distinct label, ',' order by label) filter (where exact) as base_labels,
         string_agg(distinct label, ',' order by label) as labels, max(cover) as score
  from good group by rid)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
       last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0)::double as score
from doc_words left join found using (rid)"""

OP9 = """
with vectors as (
  select vec_id, [floor(64 * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from vectors q join vectors c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranks as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored)
select query_id, rank, vec_id, score from ranks where rank <= 20"""

def _best(*ways: str) -> str:
    """The least (cost, audit) of some ways to a state."""
    return f"list_min([{', '.join(ways)}])"


def _plus(way: str, cost, letter: str) -> str:
    """A way with one more edit; null stays null."""
    return f"case when {way} is not null then {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}'}} end"


def _with_inserts(rows: str) -> str:
    """A select over ``rows`` with the inserts that may stand before the next row, at most two."""
    for _ in range(2):
        rows = (f"select * replace ({_best('w2', *(_plus(w, 2, 'I') for w in ('w0', 'w1', 'w3')))} as w2, "
                f"{_best('w3', _plus('w2', 2, 'I'))} as w3) from ({rows})")
    return rows


# States: 0 nothing written, 1 a system row, 2 a user's, 3 an assistant's; w0 to w3 are the cheapest ways to them.
_WAY = "struct(c bigint, a varchar)"
_KEPT = {0: ["null"], 1: ["case when role1 = 's' then w0 end"], 2: [f"case when role1 = 'u' then w{s} end" for s in (0, 1, 3)],
         3: ["case when role1 = 'a' then w2 end"]}
_REROLED = {0: [], 1: [], 2: ["w0", "w1", "w3"], 3: ["w2"]}


def _step(state: int) -> str:
    stays = [f"(case when fault < 2 then {_plus('(' + w + ')', 'fault', 'K')} end)" for w in _KEPT[state] if w != "null"]
    turns = [f"(case when fault < 2 then {_plus(w, '2 + fault', 'R')} end)" for w in _REROLED[state]]
    return f"{_best(_plus(f'w{state}', 3, 'D'), *stays, *turns)} as w{state}"


def _repaired_rows() -> str:
    """The repaired ``role:text`` of an audit: letters are followed row by row, inserts included."""
    return """
letters as (select key, audit, 1 as p, 0 as i, 0 as state, [] :: varchar[] as pieces from best
  union all
  select l.key, audit, p + 1, i + (letter <> 'I')::int,
    case when letter = 'D' then state when letter = 'K' then position(role1 in 'sua')::int when state = 2 then 3 else 2 end,
    case when letter = 'D' then pieces else list_append(pieces,
      case when letter = 'K' then role || ':' || text
           else case when state = 2 then 'assistant:' else 'user:' end || case when letter = 'R' then text else '' end end) end
  from (select *, substr(audit, p, 1) as letter from letters where p <= length(audit)) l
  left join numbered n on n.key = l.key and n.place = l.i + 1 and letter <> 'I'),
texts as (select key, sha256(array_to_string(pieces, chr(10))) as repaired_sha256 from letters where p > length(audit))"""


_CRC = """(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(name) + 1),
      lambda i: ('0x' || substr(hex(encode(name)), (2 * i - 1)::int, 2))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint))"""

OP11 = rf"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
kinds as (select *, {_CRC} % 20 as kind from named),
keys as (select conv_id, row_number() over (order by conv_id) as key from (select distinct conv_id from conversations)),
damaged as (
  select key, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from kinds join keys on kinds.conv_id is not distinct from keys.conv_id where kind <> 0),
numbered as materialized (
  select *, row_number() over w as place, row_number() over (partition by key, role, text order by turn nulls first, copy) as seen, left(role, 1) as role1,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed
  from damaged window w as (partition by key order by turn nulls first, role, md5(text), copy)),
judged as materialized (
  select *, case when trimmed = '' then 'blank' when seen > 1 then 'duplicate' when right(trimmed, 1) not in ('.', '!', '?') then 'truncated' else '' end as said,
    case when trimmed = '' or seen > 1 then 2 when right(trimmed, 1) not in ('.', '!', '?') then 1 else 0 end as fault,
    coalesce(lag(role1) over (partition by key order by place), '-') || role1 as pair from numbered),
facts as (
  select key, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where said = 'blank') as blank,
    count(*) filter (where said = 'duplicate') as duplicate, count(*) filter (where said = 'truncated') as truncated,
    count(*) filter (where place > 1 and pair not in ('su', 'ua', 'au')) as illegal from judged group by key),
ways as (
  select key, 0::bigint as i, {{'c': 0, 'a': ''}}::{_WAY} as w0, null::{_WAY} as w1, null::{_WAY} as w2, null::{_WAY} as w3 from facts
  union all
  select key, i + 1, {", ".join(_step(s) for s in range(4))}
  from (select o.*, role1, fault from ({_with_inserts("select key, i, w0, w1, w2, w3 from ways")}) o
        join judged j on j.key = o.key and j.place = o.i + 1)),
best as (
  select key, list_min([w0, w3]).c as cost, list_min([w0, w3]).a as audit
  from (select o.*, n from ({_with_inserts("select key, i, w0, w1, w2, w3 from ways")}) o join facts using (key)) where i = n),{_repaired_rows()}
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit,
  coalesce(repaired_sha256, sha256('')) as repaired_sha256
from keys left join facts using (key) left join best using (key) left join texts using (key)"""

ORACLE = {"op1_mix_sources": OP1, "op2_url_filter": OP2, "op3_decontamination": OP3, "op5_warc": OP5, "op6_line_dedup": OP6, "op8_license_scan": OP8,
          "op9_exact_top_k": OP9, "op11_conversation_repair": OP11}
