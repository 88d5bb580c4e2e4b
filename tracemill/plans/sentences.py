"""Queries of learned sentence borders, with SQL twins that count and decide place by place."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import punkt
from tracemill.plans.catalogue import query
from tracemill.sources import tables as src

_XLOG = "case when {x} = 0 then 0 else {x} * ln(greatest({p}, 1e-12)) end"


def _x(x: str, p: str) -> str:
    return "(" + _XLOG.format(x=f"({x})", p=p) + ")"


def _tie(a: str, b: str, ab: str, n: str) -> str:
    p, one, two = f"({b} / {n})", f"({ab} / {a})", f"case when {n} > {a} then ({b} - {ab}) / greatest({n} - {a}, 1e0) else 1e0 end"
    free = f"{_x(ab, p)} + {_x(f'{a} - {ab}', f'1 - {p}')} + {_x(f'{b} - {ab}', p)} + {_x(f'{n} - {a} - {b} + {ab}', f'1 - {p}')}"
    return f"(-2 * ({free} - case when {a} = {ab} then 0 else {_x(ab, one)} + {_x(f'{a} - {ab}', f'1 - {one}')} end - case when {b} = {ab} then 0 else {_x(f'{b} - {ab}', two)} + {_x(f'{n} - {a} - {b} + {ab}', f'1 - ({two})')} end))"


TYPES = rf"""word as (select rid, trace_index, w, unnest(range(len(w))) as i from (select row_number() over () as rid, doc_id as trace_index, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents)),
bare as (select rid, trace_index, i, regexp_replace(w[i + 1], '^[("''\[{{]+|[)"''\]}},;:]+$', '', 'g') as b from word),
body as (select rid, trace_index, i, lower(regexp_replace(b, '[.!?…]+$', '')) as t, case when b like '%..' or b like '%…' then '~' when b like '%.' then '.' when regexp_matches(b, '[!?]$') then '!' else '' end as e, case when regexp_matches(b, '^\p{{Lu}}') then 'U' when regexp_matches(b, '^\p{{Ll}}') then 'L' else '' end as c from bare),
tok as (select rid, trace_index, i, case when regexp_matches(t, '^[-+]?[.,]?\d[\d.,-]*$') then '#' else t end as t, e, c from body),
size as (select cast(count(*) as double) as n, cast(count(*) filter (e = '.') as double) as p from tok),
typ as (select t, cast(count(*) filter (e = '.') as double) as a, cast(count(*) filter (e <> '.') as double) as o from tok group by t),
shaped as (select t, a, o, length(t) - length(replace(t, '.', '')) as dots, cast(length(replace(t, '.', '')) as double) as letters, p / n as q, n, p from typ, size),
scored as (select t, a, o, case when a > 0 and regexp_matches(t, '\p{{L}}') and p < n then -2 * ({_x('a', 'q')} + {_x('o', '1 - q')} - {_x('a', '0.99e0')} - {_x('o', '1 - 0.99e0')}) * exp(-letters) * (dots + 1) * pow(letters, -o) else 0 end as score from shaped)"""


@query(f"with {TYPES} select t as type, cast(a as bigint) as with_period, cast(o as bigint) as without, round(score, 4) + 0 as score, score >= 0.3 as abbreviation from scored")
def punkt_types(spark, base):
    """Types of tokens with the score by which they pass for abbreviations."""
    model = punkt.fit(src.read_table(spark, base, "documents"))
    return model.types.select("type", "with_period", "without", F.round("score", 4).alias("score"), "abbreviation")


@query(
    rf"""with {TYPES}, short as (select t from scored where score >= 0.3),
seen as (select *, lag(t) over w as pt, lag(e) over w as pe, lead(t) over w as nt, lead(c) over w as nc from tok window w as (partition by rid order by i)),
marked as (select *, coalesce(pe = '!' or pe = '.' and pt not in (select t from short) and pt <> '#' and not regexp_full_match(pt, '\p{{L}}'), false) as border from seen),
use as (select t, count(*) filter (c = 'L') as lower, count(*) filter (c = 'U' and not border and pe is not null and pe <> '~') as inside, cast(count(*) filter (border) as double) as after from marked group by t),
every as (select cast(count(*) filter (border) as double) as b from marked),
known as (select u.*, a + o as f, coalesce(after > 0 and regexp_full_match(t, '\p{{L}}+') and {_tie('b', '(a + o)', 'after', 'n')} >= 30 and n * after > (a + o) * b, false) as starter from use u join typ using (t), size, every),
both_ as (select pt, t, cast(count(*) as double) as k from marked where pe = '.' and (regexp_matches(t, '\p{{L}}') or t = '#') and (pt = '#' or regexp_full_match(pt, '\p{{L}}') or pt in (select t from short)) group by pt, t having count(*) > 1),
tied as (select x.pt, x.t from both_ x join known l on l.t = x.pt join known r on r.t = x.t, size where {_tie('l.f', 'r.f', 'x.k', 'size.n')} >= 7.88 and size.n * x.k > l.f * r.f),
told as (select s.rid, s.trace_index, s.i, case when s.nt is null or s.e = '' then false when s.e = '!' then true when exists (select 1 from tied where tied.pt = s.t and tied.t = s.nt) then false
    when s.e = '~' or s.t in (select t from short) and not regexp_full_match(s.t, '\p{{L}}') then s.nc = 'U' and (k.starter or k.lower > 0 and k.inside = 0) when s.t = '#' then s.nc <> 'L'
    when regexp_full_match(s.t, '\p{{L}}') then s.nc <> 'L' and not (s.nc = 'U' and k.lower = 0) else true end as ends from seen s left join known k on k.t = s.nt),
per as (select rid, count(*) filter (ends) + 1 as n from told group by rid),
docs as (select row_number() over () as rid, doc_id as trace_index, len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')) as plain from documents)
select trace_index, cast(coalesce(n, 0) as bigint) as n_sentences, cast(plain as bigint) as n_by_marks from docs left join per using (rid)"""
)
def punkt_sentences(spark, base):
    """Numbers of sentences of every text by learned borders, beside those by marks alone."""
    docs = src.read_table(spark, base, "documents").select(F.col("doc_id").alias("trace_index"), "text", text.count_sentences("text").alias("n_by_marks"))
    return punkt.split(docs, punkt.fit(docs)).drop("borders")
