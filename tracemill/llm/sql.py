"""SQL twins of operators that need helpers in SQL, such as crc32."""

from __future__ import annotations

from tracemill.llm.license_rules import BASE, RULES, wrapped

#: A relation `crc` with the 256 values of the checksum's table, by its rule.
CRC_TABLE = "crc as (select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"


def crc32(s: str) -> str:
    """SQL of the unsigned crc32 of a string's UTF-8 bytes; `crc` must be in scope."""
    octets = f"list_transform(range(strlen({s})), lambda i: cast('0x' || substr(hex({s}), 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_RULES = ", ".join(f"({i}, '{r.label}', {r.priority}, {list(r.gates)}, '{wrapped(r.pattern)}')" for i, r in enumerate(RULES))

OP11_SQL = rf"""
with rule(rule, label, priority, gates, pattern) as (values {_RULES}),
doc as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
line as (select rid, w, ' ' || array_to_string(w, '  ') || ' ' as t from doc),
marked as (
  select rid, rule, label, priority, string_split(trim(regexp_replace(t, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g'), ' '), '  ') as m
  from line join rule on list_has_any(w, gates)
),
word as (select rid, rule, label, priority, i, m[i + 1] as x from marked, unnest(range(len(m))) as u(i) where len(m) > 0),
opened as (select *, row_number() over (partition by rid, rule order by i) as k from word where x like chr(1) || '%'),
closed as (select *, row_number() over (partition by rid, rule order by i) as k from word where x like '%' || chr(2)),
span as (select o.rid, o.rule, o.label, o.priority, o.i as start, c.i + 1 as stop from opened o join closed c using (rid, rule, k)),
kept as (
  select * from span d
  where d.rule < {len(BASE)} or not exists (
    select 1 from span e
    where e.rid = d.rid and e.start < d.stop and d.start < e.stop
      and (e.priority > d.priority or e.priority = d.priority and e.start <= d.start and e.stop >= d.stop and (e.stop - e.start > d.stop - d.start or e.rule < d.rule))
  )
),
base as (select rid, count(*) as n, min(start) as a, max(start) as b, string_agg(distinct label, ',' order by label) as labels from span where rule < {len(BASE)} group by rid),
best as (select rid, label, max(priority) as priority from kept group by rid, label),
told as (select rid, string_agg(label, ',' order by label) as labels, sum(priority) as weight from best group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, a as first_word, b as last_word,
       coalesce(base.labels, '') as base_labels, coalesce(told.labels, '') as labels, 1 - pow(2e0, -cast(coalesce(weight, 0) as double)) as score
from doc left join base using (rid) left join told using (rid)
"""

OP12_SQL = rf"""
with {CRC_TABLE},
doc as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
goal as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
),
gram as (select rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from doc),
goal_gram as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from goal),
name as (select f, {crc32("f")} % 10000 as bucket from (select f from gram union select f from goal_gram), crc),
s as (select bucket, count(*) as s from gram join name using (f) group by bucket),
t as (select bucket, count(*) as t from goal_gram join name using (f) group by bucket),
total as (select coalesce((select sum(s) from s), 0) as ss, coalesce((select sum(t) from t), 0) as tt),
gain as (
  select b.bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * (ss + 10000) as double) / cast((coalesce(s, 0) + 1) * (tt + 10000) as double))) as bigint) as gain
  from (select unnest(range(10000)) as bucket) b left join s using (bucket) left join t using (bucket), total
),
each as (
  select d.rid, count(g.f) as n_features, case when count(g.f) = 0 then 0 else cast(floor(cast(sum(gain) as double) / count(g.f)) as bigint) end as weight
  from doc d left join gram g using (rid) left join name using (f) left join gain using (bucket) group by d.rid
),
scored as (
  select rid, doc_id, len(w) as n, n_features, weight,
         weight + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || doc_id), 1, 8) as bigint) + 0.5e0) / 4294967296e0))) as bigint) as score
  from doc join each using (rid)
),
placed as (select rid, row_number() over (order by score desc, doc_id) as rank from scored where n >= 20)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       case when rank <= (select count(*) * 25 // 100 from placed) then rank end as rank
from scored left join placed using (rid)
"""

OP13_SQL = rf"""
with {CRC_TABLE},
doc as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
told as (select *, {crc32("cast(doc_id as varchar)")} as h, len(w) as n from doc, crc),
cut as (select rid, doc_id, w, n, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a, h // 10 as g from told),
said as (
  select rid, doc_id, case when a is null then w else list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) end as w
  from cut
),
six as (select rid, i, w[i + 1 : i + 6] as g from said, unnest(range(0, len(w) - 5)) as u(i)),
near as (select x.rid, x.i, y.i - x.i as q from six x join six y on x.rid = y.rid and x.g = y.g and x.i < y.i),
island as (select rid, q, i, i - row_number() over (partition by rid, q order by i) as part from near),
stretch as (select rid, q, min(i) as start, max(i) - min(i) + 6 + q as length from island group by rid, q, part),
long as (select * from stretch where length >= greatest(12, 2 * q)),
run as (
  select * from long x
  where not exists (select 1 from long y where y.rid = x.rid and y.q < x.q and y.start <= x.start and y.start + y.length >= x.start + x.length)
),
gone as (select distinct rid, unnest(range(start + q, start + length)) as i from run),
kept as (
  select s.rid, string_agg(s.word, ' ' order by s.i) as text
  from (select rid, i, w[i + 1] as word from said, unnest(range(0, len(w))) as u(i)) s anti join gone using (rid, i)
  group by s.rid
),
best as (select rid, start, length, q, row_number() over (partition by rid order by length desc, start, q) as k from run),
told_runs as (select rid, count(*) as n, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines from run group by rid)
select doc_id, cast(coalesce(r.n, 0) as bigint) as n_runs, b.start, b.length, b.q as period, 1000 * b.length // b.q as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from said left join told_runs r using (rid) left join (select * from best where k = 1) b using (rid) left join kept using (rid)
"""
