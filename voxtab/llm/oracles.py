"""SQL for DuckDB that gives the rows of the queries, where SQL can say it."""

from voxtab.llm import secret_scan
from voxtab.llm.url_filter import SHADY

SQL = {
    "op1_url_filter": r"""
with parts as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
  from (select page_id, coalesce(url, '') as url from pages)),
urls as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
rules(pattern, start, rule, verdict, rank) as (values
  ('com', '/', 'com/', 'allow', 4), ('example.com', '/en/', 'example.com/en/', 'block', 15),
  ('www.example.com', '/en/', 'www.example.com/en/', 'allow', 19),
  ('net', '/es/', 'net/es/', 'block', 7), ('net', '/fr/', 'net/fr/', 'block', 7)),
fits as (
  select u.page_id, u.host, u.path, r.rule, r.verdict,
    row_number() over (partition by u.page_id order by r.rank desc nulls last) as place
  from urls u left join rules r
    on (u.host = r.pattern or ends_with(u.host, '.' || r.pattern)) and starts_with(u.path, r.start))
select page_id, host, path, rule,
  coalesce(verdict, case when regexp_matches(host || path,
    '^([^/]*\.)?(WORDS)[.-]|-(WORDS)[./]|/(WORDS)[/-]') then 'block' else 'allow' end) as verdict
from fits where place = 1""".replace("WORDS", "|".join(SHADY)),
    "op10_topk": """
with rows as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as w
  from embeddings
  where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
  from rows q join rows c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10""",
}


def _spans_sql(kind: secret_scan.Kind, place: int) -> str:
    p = kind.pattern.replace("'", "''")
    least = f"and length(regexp_extract(m[i], '{p}', {kind.group})) >= {kind.least}" if kind.least else ""
    return f"""
select doc_id, {place} as place, '{kind.name}' as kind, '{kind.part}' as part,
  cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as s,
  length(m[i]) as n
from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i
  from (select doc_id, regexp_extract_all(t, '{p}') as m, string_split_regex(t, '{p}') as g from docs))
where length(m[i]) > 0 {least}"""


SQL["op2_secrets"] = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
parts as materialized ({" union all ".join(_spans_sql(k, i) for i, k in enumerate(secret_scan.KINDS))}),
spans as (
  select * from parts p
  where place < {len(secret_scan.STRONG)} or exists (
    select 1 from parts o where o.doc_id = p.doc_id and o.part <> p.part
      and o.s - (p.s + p.n) <= {secret_scan.REACH} and p.s - (o.s + o.n) <= {secret_scan.REACH})),
named as (select doc_id, place, kind, s, kind || ':' || s || ':' || (s + n) as span from spans),
lists as (
  select doc_id, count(*) filter (where place = 0) as n_assign, count(*) filter (where place = 1) as n_access,
    count(*) filter (where place = 2) as n_hex,
    string_agg(span, ',' order by s, place) filter (where place < 3) as base,
    string_agg(span, ',' order by s, place) as spans
  from named group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
  coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join lists using (doc_id)"""

_WORDS = r"[^\x20\x09-\x0D]+"
SQL["op7_quality_rules"] = f"""
with docs as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
words as materialized (select doc_id, host, t, regexp_extract_all(t, '{_WORDS}') as w from docs),
lines as materialized (
  select doc_id, host, t, line, len(regexp_extract_all(line, '{_WORDS}')) as n,
    regexp_replace(translate(array_to_string(regexp_extract_all(line, '{_WORDS}'), ' '),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') as norm
  from (select doc_id, host, t, unnest(string_split(t, chr(10))) as line from docs)
  where regexp_matches(line, '{_WORDS}')),
repeats as (
  select doc_id, sum(k - 1) as n_dup_lines
  from (select doc_id, line, count(*) as k from lines group by all) group by doc_id),
windows as (
  select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from words)),
twice as (select doc_id, a, b, c from windows group by all having count(*) > 1),
covered as (
  select doc_id, count(distinct i + d) as n_repeat_words
  from windows join twice using (doc_id, a, b, c), (values (0), (1), (2)) shift(d) group by doc_id),
counts as (
  select host, norm, count(distinct t) as texts, arg_min(t, doc_id) as first from lines group by all),
hosts as (select host, count(distinct t) as host_texts from docs group by host),
gone as (
  select l.doc_id, sum(l.n) as n_removed_words
  from lines l join counts c on l.host = c.host and l.norm = c.norm join hosts h on h.host = l.host
  where c.texts >= 3 and (100 * c.texts > host_texts or c.texts > 1000) and l.t <> c.first group by l.doc_id),
stats as (
  select doc_id, cast(len(w) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    cast(coalesce(n_removed_words, 0) as bigint) as n_removed_words
  from words left join repeats using (doc_id) left join covered using (doc_id) left join gone using (doc_id)),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from stats)
select *, not base_failed and 100 * n_removed_words <= 50 * n_words as kept from failed"""

SQL["op3_ngram_join"] = f"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') as w from documents),
sets as materialized (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from words)),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from sets x join sets y using (s)
  where x.doc_id <> y.doc_id group by all),
links as materialized (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * k >= 75 * (p.n + q.n - k)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select doc_id, coalesce(n, 0) as n_shingles, least_id as component_id
from (select doc_id, min(other) as least_id from reach group by doc_id) left join sizes using (doc_id)"""

SQL["op5_suffix_dedup"] = """
with docs as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as materialized (
  select doc_id, i, sha256(substr(h, 2 * i + 1, 100)) as w
  from (select doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as i from docs)),
firsts as (select w, min(doc_id) as least_id from windows group by w),
repeats as (select doc_id, i from windows join firsts using (w) where doc_id > least_id),
steps as (
  select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new
  from repeats),
spans as (
  select doc_id, min(i) as a, max(i) + 50 as b
  from (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from steps)
  group by doc_id, k),
edges as (
  select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans),
cuts as (
  select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last,
    string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as kept
  from edges join docs using (doc_id) group by doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from docs left join cuts using (doc_id)"""
