"""DuckDB counterparts of the corpus queries."""

MIX_SOURCES = r"""
with rows as (select doc_id, source, cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) as bigint) as size,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as pos from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size from rows group by source),
ranked as (select *, row_number() over (order by encode(source) nulls last) as rank from sizes),
weighted as (select *, [5, 2, 1][(rank - 1) % 3 + 1] as weight, source_size * 2e0 / [5, 2, 1][(rank - 1) % 3 + 1] as ratio from ranked),
levels as (select *, (1.5e0 * cast(sum(source_size) over () as bigint)
  - 2e0 * cast(coalesce(sum(source_size) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0) as bigint))
  / cast(sum(weight) over (order by ratio, rank rows between current row and unbounded following) as bigint) as level from weighted),
chosen as (select level from levels where level <= ratio order by ratio, rank limit 1),
targets as (select source, source_size, least(2e0 * source_size, coalesce((select level from chosen) * weight, 2e0 * source_size)) as target from levels),
plans as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
spread as (select r.doc_id, r.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as budget, r.pos,
  sum(r.size) over (partition by r.source order by r.pos range between unbounded preceding and current row) as until,
  sum(r.size) over (partition by r.source, r.pos) as here
  from rows r join plans p on r.source is not distinct from p.source)
select doc_id, size, source_size, target, cast(size * (whole + case when budget > 0
  and (until <= budget or (until - here <= budget and until - budget < budget - (until - here))) then 1 else 0 end) as bigint) as taken
from spread
"""

TOP_K = """
with vectors as (select vec_id, [cast(floor(256 * cast(x as double)) as double) for x in embedding] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
  from vectors q join vectors c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

EXACT_DEDUP = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

NEAR_DEDUP = r"""
with recursive rows as materialized (select doc_id, list_filter(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
sets as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from rows),
items as materialized (select doc_id, len(s) as n, unnest(s) as shingle from sets),
shared as (select a.doc_id as a, b.doc_id as b, a.n + b.n - count(*) as n_union, count(*) as n_both
  from items a join items b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n),
links as materialized (select a, b from shared where 100 * n_both >= 80 * n_union union all select b, a from shared where 100 * n_both >= 80 * n_union),
reach as (select doc_id, doc_id as seen from sets union select r.doc_id, l.b from reach r join links l on r.seen = l.a),
parts as (select doc_id, min(seen) as component_id from reach group by doc_id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, p.component_id, s.doc_id = p.component_id as kept from sets s join parts p using (doc_id)
"""

FILL_IN_MIDDLE = """
with rows as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (select *, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
  cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from rows),
cuts as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from cuts)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256,
  sha256(t) as restored_sha256 from parts
"""
