"""Further queries: text operators over texts of the tables, orders and rankings, lookups, prompts, reward scans."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tracemill import schema as S
from tracemill.functions import algebra, grading, jsonparse, text, tokens
from tracemill.operators import backtracking as bt, configs, curves, ordering, pu, traces as tr, versions
from tracemill.plans.catalogue import BINS, BT, BT_SUM, CURVE_PARTS, FIT, PENALISED, FX_BT, FX_JOINED, FX_PU, FX_RM, FX_TRACES, REGRESSION_SQL, _curve, _joined, query
from tracemill.sources import artifacts, scratch, tables as src

#: Whole texts, and their length, from which the queries' numbers come.
SLICE = r"s as (select doc_id as id, doc_id % 7 as k, length(coalesce(text, '')) as m, coalesce(text, '') as t from documents)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _slices(spark, base):
    """(id, k, m, t): every document's whole text and its length."""
    t = F.coalesce("text", F.lit(""))
    return src.read_table(spark, base, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("k"), F.length(t).cast("long").alias("m"), t.alias("t"))


def _by_k(*values):
    """One of several columns by the row's k."""
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col("k") == i, v).otherwise(out)
    return out


def _wrap(before: str, after: str):
    return F.concat(F.lit(before), F.col("t"), F.lit(after))


# --- text operators over texts of the tables --------------------------------------------------
@query(rf"""with {SLICE}, o as (select id, k, case k when 0 then 'x<think>' || t || '</think> answer' when 1 then '<|im_start|>assistant' || chr(10) || t || '<|im_end|>' when 2 then 'q[/INST]' || t || '</s>y' when 3 then '<start_of_turn>model' || t || '<end_of_turn>'
  when 4 then '<|start|>assistant<|channel|>analysis<|message|>' || t || '<|end|><|start|>assistant<|channel|>final<|message|>z' when 5 then 'a<|assistant|>' || t else t end as o from s),
p as (select id, k, case k when 0 then string_split(string_split(o, '<think>')[2], '</think>')[1] when 1 then string_split(string_split(o, 'assistant' || chr(10))[2], '<|im_end|>')[1] when 2 then string_split(string_split(o, '[/INST]')[2], '</s>')[1] when 3 then string_split(string_split(o, 'model')[2], '<end_of')[1]
  when 4 then string_split(string_split(o, 'analysis<|message|>')[2], '<|end|>')[1] when 5 then substr(o, strpos(o, '<|assistant|>')) else o end as o from o)
select id, case when k < 5 then {STRIP.format('o')} else o end as trace from p""", "extract_trace_by_family")
def _family_traces(spark, base):
    model = _by_k(*[F.lit(m) for m in ("Org/Qwen3-8B", "deepseek-R1", "Magistral-Small", "gemma-3", "gpt-oss-20b", "phi-4", "other")])
    q, g = text.QWEN, text.GPT
    output = _by_k(_wrap("x" + q[0], q[1] + " answer"), _wrap(q[2], q[3]), _wrap("q" + text.MISTRAL_START, text.MISTRAL_END + "y"), _wrap(text.GEMMA_START, text.GEMMA_END), _wrap(g[0], g[1] + g[2] + "z"), _wrap("a" + text.PHI_START, ""), F.col("t"))
    return _slices(spark, base).select("id", text.trace_of(output, model).alias("trace"))


@query(rf"""with {SLICE}, o as (select id, case k when 0 then t || ' The final answer is $' || m || '$. I hope it is correct.' when 1 then t || ' so \boxed{{1}} or \boxed{{' || m || '}} done' when 2 then t || ' thus the answer is ' || m || '.' when 3 then t || ' ANSWER: ' || m when 4 then t || ' so \boxed ' || m || '$ end' when 5 then t else t || ' 7 then ' || m end as o from s),
p as (select id, case when contains(o, '$. I hope') and contains(o, 'final answer is $') then string_split(string_split(o, 'final answer is $')[2], '$. I hope')[1] when contains(o, 'boxed') then coalesce(nullif(regexp_extract(string_split(o, 'boxed')[-1], '^\{{([^{{}}]*)\}}', 1), ''), string_split(string_split(o, 'boxed')[-1], '$')[1])
  when contains(o, 'he answer is') then string_split(o, 'he answer is')[-1] when contains(o, 'ANSWER:') then string_split(o, 'ANSWER:')[-1] else coalesce(regexp_extract_all(replace(o, ',', ''), '-?\d*\.?\d+')[-1], '') end as a from o),
c as (select id, regexp_replace(regexp_replace(regexp_replace({STRIP.format('a')}, '\.$', ''), '^\.', '0.'), '\.0*$', '') as c from p)
select id, case when regexp_full_match(c, '-?\d{{1,37}}') then cast(cast(c as hugeint) as varchar) else c end as answer from c""", "extract_answer_math")
def _math_answers(spark, base):
    n = F.col("m").cast("string")
    say = lambda a, b: F.concat("t", F.lit(a), n, F.lit(b))
    output = _by_k(say(" The final answer is $", "$. I hope it is correct."), say(" so \\boxed{1} or \\boxed{", "} done"), say(" thus the answer is ", "."), say(" ANSWER: ", ""), say(" so \\boxed ", "$ end"), F.col("t"), say(" 7 then ", ""))
    return _slices(spark, base).select("id", text.math_answer(output).alias("answer"))


@query(f"with {SLICE}, o as (select id, t || ' \\boxed{{' || chr(cast(65 + k as integer)) || '}} ' || case when id % 3 = 0 then '\\boxed{{B}}' else '' end as o from s) select id, list_extract(regexp_extract_all(o, '\\\\boxed\\{{([A-D])\\}}', 1), -1) as answer from o", "extract_answer_gpqa")
def _choice_answers(spark, base):
    o = F.concat("t", F.lit(" \\boxed{"), F.chr((F.col("k") + 65).cast("int")), F.lit("} "), F.when(F.col("id") % 3 == 0, "\\boxed{B}").otherwise(""))
    return _slices(spark, base).select("id", text.choice_answer(o).alias("answer"))


@query(f"""with {SLICE}, w as (select id, k, upper(regexp_replace(t, '[^A-Za-z]', '', 'g')) as w from s)
select id, case when k < 5 then '[{{"key":"G1 ' || w || '","value":["A","' || w || '"]}},{{"key":"G2","value":["B"]}}]' end as answer from w""", "extract_answer_connections")
def _group_answers(spark, base):
    w = F.regexp_replace("t", "[^A-Za-z]", "")
    body = F.concat(F.lit('{"groupings": {"1": {"category": "g1 '), w, F.lit('", "words": ["a", "'), w, F.lit('"]}, "2": {"category": "g2", "words": ["b"]}}}'))
    fence = lambda x: F.concat(F.lit("```json\n"), x, F.lit("\n```"))
    output = _by_k(fence(body), F.concat(fence(F.lit("{}")), F.lit(" then "), fence(body)), F.concat(F.lit("so { this "), body), F.concat(F.lit('{"Groupings": {}} or '), body, F.lit(" {")), F.concat(body, F.lit(' and {"a": 1}')), F.lit("nothing"), fence(F.lit('{"flat": ["a"]}')))
    return _slices(spark, base).select("id", F.to_json(F.array_sort(F.map_entries(text.connections_answer(output)))).alias("answer"))


@query(f"""with {SLICE}, n as (select id, k, cast(m % 97 as varchar) as n, cast(m % 8 + 1 as varchar) as d from s)
select id, case k when 0 then '\\frac{{' || d || '}}{{' || d || '}}' when 1 then n when 2 then '\\sqrt{{' || n || '}}' when 3 then '\\frac{{' || n || '}}{{' || d || '}}' when 4 then cast(cast(n || '000' as bigint) as varchar) else '\\infty' end as plain from n where k <> 5
union all select id, case when cast(d as int) <= 3 then d || ',3' else '3,' || d end from n where k = 5""", "normalize_answer")
def _normal_answers(spark, base):
    n, d = (F.col("m") % 97).cast("string"), (F.col("m") % 8 + 1).cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    answer = _by_k(c(" \\dfrac", d, d, ". "), c("x = ", n, ".00\\%"), c("\\sqrt", n, "\\text{ cm}"), c(n, "/", d), c("$", n, ",\\!000$"), c(d, ", 3"), F.lit("infinity"))
    return _slices(spark, base).select("id", text.normalise_answer(answer).alias("plain"))


@query(f"with {SLICE} select id, case when k < 4 then case when id % 2 = 0 then 0 else 9 end <= 1e-4 * (m + 11) when k = 4 then id % 2 = 0 else false end as equal from s", "grade_math_numeric")
def _graded_math(spark, base):
    n, off = F.col("m") + 2, F.when(F.col("id") % 2 == 0, 0).otherwise(9)
    s = lambda x: x.cast("string")
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    m = lambda x: c("\\begin{pmatrix}1 & ", s(x), "\\\\ 3 & 4\\end{pmatrix}")
    pred = _by_k(c("x = ", s(n)), m(n), c("(1, ", s(n), ".00)"), c(s(n * 100), "%"), c("{", s(n), "}a"), F.lit(None).cast("string"), c(s(n), " + b"))
    truth = _by_k(s(n + off), m(n + off), c("[1,", s(n + off), "]"), s(n + off), c(s(n + off), "a"), s(n), c("b + ", s(n)))
    return _slices(spark, base).select("id", grading.grade_math(pred, truth).alias("equal"))


@query(f"with {SLICE}, w as (select id, k, regexp_extract_all(upper(t), '[A-Z]+') as w from s) select id, cast(case when k > 0 then substr(w[1], 1, 1) end is not distinct from case when id % 5 > 0 then substr(w[-1], 1, 1) end as integer) as grade from w", "grade_choice")
def _graded_choice(spark, base):
    """The first letters of a text's first and last words, either of which may be missing."""
    # letters whose capital is one of A to Z; the capitals of a whole text may be longer (\u00df, \ufb01) and join words
    words = F.regexp_extract_all("t", F.lit("[A-Za-z\u0131\u017f]+"), F.lit(0))
    letter = lambda at: F.upper(F.substring(F.try_element_at(words, F.lit(at)), 1, 1))
    return _slices(spark, base).select("id", grading.grade_choice(F.when(F.col("k") > 0, letter(1)), F.when(F.col("id") % 5 > 0, letter(-1))).alias("grade"))


@query(f"with {SLICE} select id, case k % 4 when 0 then cast(abs(m - (m + 7 * (id % 2))) <= 1e-4 * (m + 7 * (id % 2)) as integer) when 1 then cast(k = 1 as integer) when 2 then 2 end as grade from s")
def grade_by_dataset(spark, base):
    """The grader that a dataset's name asks for."""
    d = F.when(F.col("k") % 4 == 0, "Math-500").when(F.col("k") % 4 == 1, "GPQA").when(F.col("k") % 4 == 2, "connections").otherwise("other")
    pred = F.when(F.col("k") % 4 == 0, F.col("m").cast("string")).when(F.col("k") % 4 == 1, F.when(F.col("k") == 1, "B").otherwise("C")).otherwise('{"A":["x","y"],"B":["y","x"],"C":["z"]}')
    truth = F.when(F.col("k") % 4 == 0, (F.col("m") + 7 * (F.col("id") % 2)).cast("string")).when(F.col("k") % 4 == 1, "B").otherwise('{"Q":["y","x"]}')
    return _slices(spark, base).select("id", grading.grade_answer(d, pred, truth).alias("grade"))


@query(f"with {SLICE} select id, case when o like '%</s>' then substr(o, 1, length(o) - 4) else o end as clipped from (select id, t || case k % 3 when 0 then '</s>' when 1 then '</s></s>' else '</s>b' end as o from s)", "clip_end_mark")
def _clipped(spark, base):
    full = F.concat("t", F.when(F.col("k") % 3 == 0, "</s>").when(F.col("k") % 3 == 1, "</s></s>").otherwise("</s>b"))
    return _slices(spark, base).select("id", text.clip_end(full, "</s>").alias("clipped"))


@query(f"with {SLICE}, n as (select id, cast(m % 90 + 1 as varchar) as b from s) select id, 'Org_Model.' || b || 'B-Instruct' as key, 'Model.' || b || 'B' as teacher, 'model_' || b || 'b' as student, cast(b as double) as size, case when cast(b as integer) > 50 then 'default_large' else 'default_small' end as config from n", "model_names")
def _names(spark, base):
    name = F.concat(F.lit("Org/Model."), (F.col("m") % 90 + 1).cast("string"), F.lit("B-Instruct"))
    return _slices(spark, base).select("id", text.canonical_model(name).alias("key"), text.teacher_short(name).alias("teacher"), text.student_short(name).alias("student"), text.model_size(name).alias("size"), text.default_config(name).alias("config"))


@query(rf"""with {SLICE}, o as (select id, list_extract(['rm::', 'pu_', 'eff_', 'bt_', 'red_', '', 'x'], cast(k + 1 as integer)) || t as o, lower(list_extract(['Qwen3', 'DeepSeek-Qwen', 'Gemma-llama', 'Meta-Llama-3', 'phi-4', 'QwQ-32B', 'Magistral'], cast(k + 1 as integer))) as f from s)
select id, case when o like 'rm::%' then 'RM: ' || substr(o, 5) when regexp_matches(o, '^(pu|eff|bt|red)_') then upper(string_split(o, '_')[1]) || ': ' || substr(o, strpos(o, '_') + 1) else o end as label,
  list_filter(['gpt-oss', 'deepseek', 'qwen', 'qwq', 'magistral', 'gemma', 'llama', 'openreasoning', 'phi'], lambda x: contains(f, x))[1] as family from o""", "metric_labels")
def _labels_and_families(spark, base):
    metric = F.concat(_by_k(*[F.lit(m) for m in ("rm::", "pu_", "eff_", "bt_", "red_", "", "x")]), "t")
    name = _by_k(*[F.lit(m) for m in ("Qwen3", "DeepSeek-Qwen", "Gemma-llama", "Meta-Llama-3", "phi-4", "QwQ-32B", "Magistral")])
    return _slices(spark, base).select("id", text.metric_label(metric).alias("label"), text.family(name).alias("family"))


WORDS, TENS = "zero one two three four five six seven eight nine".split(), "twenty thirty forty fifty sixty seventy eighty ninety".split()


@query(f"with {SLICE} select id, cast((m % 8 + 2) * 10 + m % 9 + 1 + 100 * (k + 1) as varchar) as number from s", "number_words")
def _numbers(spark, base):
    """Numbers of three digits, spelled out and read again."""
    small, tens = (F.array(*[F.lit(w) for w in x]) for x in (WORDS, TENS))
    phrase = F.concat(F.element_at(small, (F.col("k") + 2).cast("int")), F.lit(" hundred and "), F.element_at(tens, (F.col("m") % 8 + 1).cast("int")), F.lit("-"), F.element_at(small, (F.col("m") % 9 + 2).cast("int")))
    return _slices(spark, base).select("id", text.word_number(phrase).alias("number"))


NUMBER = r"-?\d*\.?\d+"


@query(rf"""with d as (select doc_id as id, replace(coalesce(text, ''), 'ки', '') as t, doc_id % 5 as k, cast(doc_id * 3 as varchar) as n from documents),
o as (select id, case k when 0 then t || ' so \boxed{{' || n || '}} or ' || n || ' apples, ' || n || '.' when 1 then t || ' The answer is  ' || n || '.' when 2 then t || ' 5, ' || n || ' then -' || n || ' of' when 3 then t || ' final answer is $ ' || n || ' $. I hope ' || n else t end as o from d),
p as (select id, o, case when contains(o, '$. I hope') and contains(o, 'final answer is $') then string_split(string_split(o, 'final answer is $')[2], '$. I hope')[1]
    when contains(o, 'boxed') then regexp_extract(string_split(o, 'boxed')[-1], '^\{{([^{{}}]*)\}}', 1) when contains(o, 'he answer is') then string_split(o, 'he answer is')[-1] else coalesce(regexp_extract_all(o, '{NUMBER}')[-1], '') end as part,
  case when contains(o, '$. I hope') and contains(o, 'final answer is $') then strpos(o, 'final answer is $') + 16 when contains(o, 'boxed') then length(o) - length(string_split(o, 'boxed')[-1]) + 1 when contains(o, 'he answer is') then length(o) - length(string_split(o, 'he answer is')[-1])
    when not regexp_matches(o, '{NUMBER}') then -1 else length(o) - length(regexp_split_to_array(o, '{NUMBER}')[-1]) - length(regexp_extract_all(o, '{NUMBER}')[-1]) end as pos from o),
r as (select id, regexp_replace(part, '^\s+|\s+$', '', 'g') as raw, case when pos < 0 then -1 else pos + length(part) - length(regexp_replace(part, '^\s+', '')) end as pos from p),
c as (select *, regexp_replace(regexp_replace(regexp_replace(raw, '\.$', ''), '^\.', '0.'), '\.0*$', '') as c from r)
select id, case when regexp_full_match(c, '-?\d{{1,37}}') then cast(cast(c as hugeint) as varchar) else c end as answer, cast(pos as integer) as start, cast(case when pos < 0 then -1 else pos + length(raw) end as integer) as stop from c""", "answer_spans")
def _spans(spark, base):
    """The stated answer of whole texts, and where it stands: in a box, behind a phrase, or as the last number, though it also stands elsewhere."""
    d = src.read_table(spark, base, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"), (F.col("doc_id") % 5).alias("k"), (F.col("doc_id") * 3).cast("string").alias("n"))
    say = lambda *x: F.concat("t", *[F.col("n") if v is None else F.lit(v) for v in x])
    out = _by_k(say(" so \\boxed{", None, "} or ", None, " apples, ", None, "."), say(" The answer is  ", None, "."), say(" 5, ", None, " then -", None, " of"), say(" final answer is $ ", None, " $. I hope ", None), F.col("t"))
    return d.select("id", text.answer_span(out).alias("s")).select("id", "s.answer", F.col("s.start").cast("int").alias("start"), F.col("s.end").cast("int").alias("stop"))


@query(f"""with {SLICE}, l as (select id, case when k < 5 then json_object('key', 'k' || id, 'response', json_object('candidates', json_array(json_object('content', json_object('parts', json_array(json_object('text', t), json_object('text', '!'))))), 'usageMetadata', json_object('promptTokenCount', m, 'candidatesTokenCount', k))) when k = 5 then json_object('key', 'k' || id, 'error', 'quota') else json_object('key', 'k' || id) end as l from s),
p as (select id, l, json_extract_string(l, '$.error') as e, json_extract(l, '$.response') is not null as there from l)
select id, json_extract_string(l, '$.key') as key, case when there then json_extract_string(l, '$.response.candidates[0].content.parts[0].text') || json_extract_string(l, '$.response.candidates[0].content.parts[1].text') end as text, cast(json_extract_string(l, '$.response.usageMetadata.promptTokenCount') as bigint) as prompt_tokens,
  cast(json_extract_string(l, '$.response.usageMetadata.candidatesTokenCount') as bigint) as output_tokens, case when e is not null then e when not there then 'no response' end as error from p""", "parse_batch_reply")
def _replies(spark, base):
    """A service's lines, put together as JSON and read again."""
    key = F.concat(F.lit("k"), F.col("id").cast("string"))
    usage = F.struct(F.col("m").alias("promptTokenCount"), F.col("k").alias("candidatesTokenCount"))
    parts = F.array(F.struct(F.col("t").alias("text")), F.struct(F.lit("!").alias("text")))
    response = F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"), usage.alias("usageMetadata"))
    line = F.when(F.col("k") < 5, F.to_json(F.struct(key.alias("key"), response.alias("response")))).when(F.col("k") == 5, F.to_json(F.struct(key.alias("key"), F.lit("quota").alias("error")))).otherwise(F.to_json(F.struct(key.alias("key"))))
    return _slices(spark, base).select("id", jsonparse.batch_reply(line).alias("r")).select("id", "r.key", F.when(F.col("r.error").isNull(), F.col("r.text")).alias("text"), "r.prompt_tokens", "r.output_tokens", "r.error")


@query("with c as (select c_custkey as id, c_acctbal as b from customer) select id, round(1 / (1 + exp(-case id % 3 when 0 then b / 5000 when 1 then b / 5000 else b / 10000 end)), 6) as score, round(tanh(b / 10000), 6) as class_one, round((b - b / 2 + (b / 2 - 1)) / 2, 4) as mean, round(least(b - b / 2, b / 2 - 1), 4) as min, round(greatest(b - b / 2, b / 2 - 1), 4) as max, round(b - b / 2, 4) as first from c", "reward_scores")
def _rewards(spark, base):
    b = F.col("c_acctbal")
    logits = F.when(F.col("c_custkey") % 3 == 0, F.array(b / 5000)).when(F.col("c_custkey") % 3 == 1, F.array(b / 5000, 2 * b / 5000)).otherwise(F.array(F.lit(1.0), F.lit(2.0), b / 10000))
    both = F.create_map(F.lit("a"), b - b / 2, F.lit("b"), b / 2 - 1)
    score = grading.transform_score(grading.logit_score(logits), "sigmoid")
    return src.read_table(spark, base, "customer").select(F.col("c_custkey").alias("id"), score.alias("score"), grading.transform_score(grading.logit_score(F.array(F.lit(0.0), b / 10000), "class1"), "tanh").alias("class_one"), *[F.round(grading.combine_rewards(both, m), 4).alias(m) for m in ("mean", "min", "max", "first")])


# --- orders, rankings, lookups -----------------------------------------------------------------
@query(f"with {BT}, {BT_SUM} select dataset, model, row_number() over (order by detected * 1.0 / greatest(total, 1) desc, dataset, model) as place from s")
def bt_rate_order(spark, base):
    """Models by detection rate; few rows, one for each model."""
    s = bt.summary(src.backtracking(spark, base), src.traces(spark, base))
    return s.select("dataset", "model", F.row_number().over(Window.orderBy((F.col("detected") / F.greatest("total", F.lit(1))).desc(), "dataset", "model")).cast("long").alias("place"))


@query(f"""with {FX_PU}, {CURVE_PARTS}, reg as ({REGRESSION_SQL}), r as (select dataset, teacher_model as model, round(avg(regression_percentage), 6) as p from reg group by all)
select dataset, model, row_number() over (order by dataset, p nulls first, model) as place, p as regression_percentage from r""")
def regression_order(spark, base):
    """Leaderboard rows by dataset, then least regression."""
    reg = pu.leaderboard_regressions(pu.regressions(src.pu_records(spark, base))).select("dataset", "model", F.round("regression_percentage", 6).alias("regression_percentage"))
    return reg.withColumn("place", F.row_number().over(Window.orderBy("dataset", F.col("regression_percentage").asc_nulls_first(), "model")).cast("long"))


@query(f"""with {FX_PU}, {CURVE_PARTS}, {PENALISED},
f as (select dataset, model, round({FIT["mse"].format(x="x", y="y")}, 9) as mse, round({FIT["r2"].format(x="x", y="y")}, 6) as r2 from parts group by all having count(*) >= 2)
select dataset, model, rank() over (partition by dataset order by round(normalized_auc - lp - cp - sp, 6) desc nulls last) as by_penalised_area, rank() over (partition by dataset order by mse nulls last) as by_smoothness, rank() over (partition by dataset order by r2 desc nulls last) as by_r2 from p join f using (dataset, model)""")
def pu_rankings(spark, base):
    """Teachers of each dataset by penalised area, by error of the line, by explained variance."""
    return curves.rankings(_curve(spark, base))


@query(f"""with {FX_PU}, {BINS}, e as (select *, min(n) over w as lo, max(n) over w as hi from bins window w as (partition by dataset, teacher_model, student_model))
select dataset, teacher_model, student_model, bin_center, round(mean_correct - std_correct / sqrt(greatest(n, 1)), 6) as lower, round(mean_correct + std_correct / sqrt(greatest(n, 1)), 6) as upper, round(case when hi = lo then 2.5e0 else 1.0e0 + 3.0e0 * (n - lo) / (hi - lo) end, 6) as line_width from e""")
def pu_error_band(spark, base):
    """Bins with the band of one standard error and a line width by count."""
    return curves.error_band(pu.percentage_bins(src.pu_records(spark, base)), list(S.CURVE))


@query(f"with {FX_JOINED}, f as (select *, row_number() over (partition by dataset, model order by trace_index) as i from fx_joined) select dataset, model, string_agg(cast(token_count as varchar), ',' order by trace_index) as tokens from f where i <= 10000 group by all")
def token_arrays(spark, base):
    """Token counts of each model in order of the traces, of the first 10000 at most, as the endpoint has them."""
    w = Window.partitionBy("dataset", "model").orderBy("trace_index")
    f = _joined(spark, base).withColumn("_i", F.row_number().over(w)).where("_i <= 10000")
    ordered = F.array_sort(F.collect_list(F.struct("trace_index", "token_count")))
    return f.groupBy("dataset", "model").agg(F.array_join(F.transform(ordered, lambda p: p["token_count"].cast("string")), ",").alias("tokens"))


@query(f"with {FX_RM} select dataset, rm, count(*) as n, round(avg(reward), 4) as mean from fx_rm where trace_index % 3 <> 0 or rm = 'rm_a' group by all")
def rm_per_model(spark, base):
    """Means from the maps of rewards by model."""
    wide = src.rewards(spark, base).groupBy(*S.KEY).agg(F.map_from_entries(F.collect_list(F.when((F.col("trace_index") % 3 != 0) | (F.col("rm") == "rm_a"), F.struct("rm", "reward")))).alias("rewards_by_model"))
    return tr.per_model_means(wide, "rewards_by_model").select("dataset", "rm", "n", F.round("mean", 4).alias("mean"))


REWARD_ROWS = "r as (select c_custkey as i, c_acctbal as b, case when c_custkey % 4 = 0 then c_acctbal end as reward, case when c_custkey % 4 = 1 then c_acctbal + 1 end as rm_reward, case when c_custkey % 4 = 2 then c_acctbal + 2 end as score from customer)"


@query(f"with {REWARD_ROWS} select i as trace_index, 'rm::x' as metric, round(coalesce(reward, rm_reward, score, case when i % 3 = 0 then null else b + 3 end), 6) as score from r")
def reward_scan(spark, base):
    """The score of a reward row: the first that is a finite number of reward, rm_reward, score, then of the rewards by model."""
    b, i = F.col("c_acctbal"), F.col("c_custkey")
    rows = src.read_table(spark, base, "customer").select(
        i.alias("trace_index"), F.when(i % 4 == 0, b).otherwise(float("nan")).alias("reward"), F.when(i % 4 == 1, b + 1).alias("rm_reward"), F.when(i % 4 == 2, b + 2).alias("score"),
        F.create_map(F.lit("p"), F.lit(float("nan")), F.lit("q"), F.when(i % 3 != 0, b + 3)).alias("rewards_by_model"),
    )
    return rows.select("trace_index", F.lit("rm::x").alias("metric"), artifacts.reward_of_row().alias("score"))


@query("select doc_id as trace_index, case n_chars % 3 when 0 then n_chars % 7 end as num_steps from documents")
def bt_step_counts(spark, base):
    """Number of steps in a verdict's JSON; null if it is no list."""
    n = F.col("n_chars")
    steps = F.when(n % 3 == 0, F.to_json(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda x: F.struct(x.alias("step_number"))))).when(n % 3 == 1, '{"a": 1}')
    cut = F.when(n % 3 == 0, F.to_json(F.slice(F.from_json(steps, "array<struct<step_number:int>>"), F.lit(1), (n % 7).cast("int")))).otherwise(steps)
    return src.read_table(spark, base, "documents").select(F.col("doc_id").alias("trace_index"), jsonparse.list_length(cut).cast("long").alias("num_steps"))


@query("select lang, source, 2 as members, count(*) as n from documents where lang is not null and source is not null group by all")
def canonical_forms(spark, base):
    """Maps of maps and lists with one content and another order of keys at both depths, beside sets in another order, are one canonical form."""
    d = src.read_table(spark, base, "documents").where("lang is not null and source is not null")
    inner = lambda *keys: F.create_map(*[x for k in keys for x in (F.lit(k), F.array(F.col(k), F.lit(k)))])
    outer = lambda a, b, *keys: F.create_map(F.lit(a), inner(*keys), F.lit(b), inner(*keys[:1]) if a == "q" else inner(*keys[1:]))
    m = F.when(F.col("doc_id") % 2 == 0, outer("q", "p", "lang", "source")).otherwise(F.map_concat(F.create_map(F.lit("p"), inner("lang")), F.create_map(F.lit("q"), inner("source", "lang"))))
    s = F.when(F.col("doc_id") % 3 == 0, F.array("lang", "source", "lang")).otherwise(F.array("source", "lang"))
    named = d.select("lang", "source", jsonparse.canonical(m).alias("m"), jsonparse.canonical_set(s).alias("s"))
    return named.groupBy("m", "s").agg(F.first("lang").alias("lang"), F.first("source").alias("source"), F.count("*").alias("n")).select("lang", "source", F.size("s").alias("members"), "n")


@query(f"with {FX_BT}, g as (select * from fx_bt where error is null and trace_index % 2 = 0), p as (select dataset, model, trace_index from fx_bt where trace_index % 4 < 2), b as (select dataset, model, trace_index from fx_bt where error is not null and trace_index % 3 = 0) select * from (select * from p except select dataset, model, trace_index from g) union select * from b")
def failed_pool(spark, base):
    """Keys to try again after a batch: those of before less successes, and what did not parse."""
    rows = src.backtracking(spark, base)
    return bt.failed_pool(rows.where("trace_index % 4 < 2"), rows.where("error is null and trace_index % 2 = 0"), rows.where("error is not null and trace_index % 3 = 0"))


@query(f"with {SLICE} select id as trace_index, k as num_steps from s where k <> 3 and not regexp_matches(t, '[0-9]') or k = 3 and not regexp_matches(t, '[QXYZ]')")
def second_pass(spark, base):
    """Records whose text gives no answer, a number or a capital, which are asked once more: one is null, the other empty."""
    found = F.when(F.col("k") == 3, F.regexp_extract("t", "[QXYZ]", 0)).otherwise(F.try_element_at(F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0)), F.lit(1)))
    return pu.without_answer(_slices(spark, base).select(F.col("id").alias("trace_index"), F.col("k").alias("num_steps"), found.alias("extracted_answer"))).select("trace_index", "num_steps")


@query(f"""with {FX_PU}, {FX_RM},
told as (select dataset, model, trace_index, case when reward > 0 then 1.0e0 else 0.0e0 end as score, 1 as place from fx_rm1 union all select 'other', model, trace_index, 5.0e0, 3 from fx_rm1
  union all select dataset, 'other', trace_index, 7.0e0, 3 from fx_rm1 union all select dataset, model, trace_index, 0.25e0, 2 from fx_rm1 where trace_index % 3 = 0 and trace_index % 2 = 0),
t as (select dataset, model, trace_index, arg_max(score, place) as score from told group by all)
select p.dataset, p.teacher_model, p.trace_index, count(*) as n, max(t.score) as teacher_score from fx_pu p left join t on t.dataset = p.dataset and t.model = p.teacher_model and t.trace_index = p.trace_index group by all""")
def pu_teacher_scores(spark, base):
    """Records with their teacher's score, looked up by dataset, teacher and index among rows that repeat all three; unknown ones stay."""
    records = src.pu_records(spark, base).drop("teacher_score")
    one = src.rewards(spark, base).where("rm = 'rm_a'").select(*S.KEY, F.when(F.col("reward") > 0, 1.0).otherwise(0.0).alias("score"), F.lit(1).alias("place"))
    strange = one.withColumn("dataset", F.lit("other")).withColumn("score", F.lit(5.0)).unionByName(one.withColumn("model", F.lit("other")).withColumn("score", F.lit(7.0))).withColumn("place", F.lit(3))
    later = one.where("trace_index % 3 = 0 and trace_index % 2 = 0").withColumn("score", F.lit(0.25)).withColumn("place", F.lit(2))
    got = pu.with_teacher_scores(records, one.unionByName(strange).unionByName(later), "place")
    return got.groupBy("dataset", "teacher_model", "trace_index").agg(F.count("*").alias("n"), F.max("teacher_score").alias("teacher_score"))


@query("select doc_id as trace_index, case when doc_id % 4 = 0 then n_chars + 1 when doc_id % 4 = 3 then null else n_chars end as value from documents")
def lookup_last_wins(spark, base):
    """Left join with a lookup whose later rows replace earlier ones of one index."""
    d = src.read_table(spark, base, "documents").select(F.col("doc_id").alias("trace_index"), "n_chars")
    one = d.where("trace_index % 4 <> 3").select("trace_index", F.col("n_chars").alias("value"), F.lit(1).alias("place"))
    two = d.where("trace_index % 4 = 0").select("trace_index", (F.col("n_chars") + 1).alias("value"), F.lit(2).alias("place"))
    return tr.with_last(d.select("trace_index"), one.unionByName(two), ["trace_index"], "place", ["value"])


@query(f"with {FX_TRACES} select dataset, model, trace_index, score from fx_traces where trace_index in (3, 5, 8, 13, 21, 34, 55, 89) and trace_index < 60")
def traces_in_list(spark, base):
    """Traces of a list that is known at run time, of the first so many."""
    return src.traces(spark, base).where(F.col("trace_index").isin(3, 5, 8, 13, 21, 34, 55, 89)).where("trace_index < 60").select(*S.KEY, "score")


@query("select distinct lang as dataset, source as model, lang || '/' || source || '/traces.parquet' as path, source <> 'src1' as there from documents where lang is not null and source is not null")
def trace_paths(spark, base):
    """Where each model's traces lie, and whether they are there."""
    pairs = src.traces(spark, base).select("dataset", "model").where("dataset is not null and model is not null").distinct()
    return artifacts.with_paths(pairs, pairs.where("model <> 'src1'"), "traces.parquet")


@query(r"""with t as (select doc_id as trace_index, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') as s from documents),
p as (select trace_index, s, unnest(list_distinct(list_append(range(0, greatest(len(s) - 1, 0) + 1, 10), greatest(len(s) - 1, 0)))) as j from t)
select trace_index, cast(j as bigint) as num_steps, md5(array_to_string(s[1:j], chr(10))) as prefix_md5 from p""")
def prefix_texts(spark, base):
    """The text before each sample point, as a digest."""
    t = src.traces(spark, base).select("trace_index", text.sentences("trace_text").alias("s"))
    return t.select("trace_index", "s", F.explode(text.prefix_points(F.size("s"), 10)).alias("num_steps")).select("trace_index", "num_steps", F.md5(text.prefix("s", "num_steps")).alias("prefix_md5"))


@query("select doc_id as trace_index, case when doc_id % 9 > 0 then substr(text, cast(doc_id % 9 + 1 as integer)) else text end as completion from documents")
def student_completions(spark, base):
    return src.traces(spark, base).select("trace_index", text.completion("trace_text", F.col("trace_index") % 9).alias("completion"))


@query(f"""with {SLICE}, b as (select id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as t, case when k = 0 then 'be brief' else '' end as sys from s), h as (select *, case when sys <> '' then 'System: ' || sys || chr(10) else '' end as head from b)
select id, 'trace_only' as mode, case when t <> '' then head || t else regexp_replace(head, '\\n$', '') end as scoring_text from h union all select id, 'completion_only', head || 'done' from h
union all select id, 'question_trace', head || 'Human: q' || chr(10) || 'Assistant: ' || t from h union all select id, 'question_completion', head || 'Human: q' || chr(10) || 'Assistant: done' from h""")
def scoring_modes(spark, base):
    """What a reward model reads, in all four modes."""
    s = _slices(spark, base).withColumn("sys", F.when(F.col("k") == 0, " be brief "))
    modes = [F.struct(F.lit(m).alias("mode"), text.scoring_text(m, "sys", F.lit("q "), "t", F.lit(" done")).alias("scoring_text")) for m in ("trace_only", "completion_only", "question_trace", "question_completion")]
    return s.select("id", F.explode(F.array(*modes)).alias("m")).select("id", "m.*")


@query(f"with {SLICE} select id, md5('What is the correct answer to this question: ' || t || chr(10) || 'Choices:' || chr(10) || 'A. one' || chr(10) || 'B. ' || t || chr(10) || 'C. ' || k || chr(10) || 'D. four' || chr(10) || chr(10) || 'Based on the above, what is the single, most likely answer choice? Reason step by step. Format your final answer as follows: \"The correct answer is \\boxed{{X}}\"' || chr(10)) as prompt_md5, t || case k % 2 when 0 then chr(10) || 'The answer is \\boxed' else chr(10) || 'My final groupings are:' || chr(10) || '```{{' end as forced from s")
def prompts(spark, base):
    """The prompt of a question with four choices, and a trace with what makes a student answer."""
    p = text.choice_prompt("t", F.lit("one"), "t", F.col("k").cast("string"), F.lit("four"))
    return _slices(spark, base).select("id", F.md5(p).alias("prompt_md5"), text.with_follow_up("t", F.when(F.col("k") % 2 == 0, "gpqa").otherwise("Connections")).alias("forced"))


# --- artifacts that are written as pickles, split by dataset and model, and read through the data source ------------
@query(f"with {FX_PU} select dataset, teacher_model, student_model, trace_index as index, num_steps, score, case when trace_index % 4 = 0 then 'late' end as grading_error, trace_index % 2 = 0 as ran_second_pass from fx_pu")
def artifact_utility(spark, base):
    """Utility records out of a tree of pickles, with the metadata of their files."""
    place = scratch.folder(spark, "utility")
    rec = src.pu_records(spark, base).select("dataset", F.col("teacher_model").alias("model"), "student_model", F.col("trace_index").alias("index"), "num_steps", "score", F.when(F.col("trace_index") % 4 == 0, "late").alias("grading_error"), F.when(F.col("trace_index") % 2 == 0, True).alias("ran_second_pass"))
    artifacts.write_pickles(rec, place, "pu_")
    return artifacts.pickled_utility(spark, place).drop("file", "extracted_answer")


@query("select lang as dataset, source as model, doc_id as trace_index, md5(text) as text_md5, n_chars, cast(length(text) as bigint) as length from documents where lang is not null and source is not null")
def artifact_traces(spark, base):
    """Whole texts of traces out of columnar pickles."""
    place = scratch.folder(spark, "traces")
    rec = src.read_table(spark, base, "documents").where("lang is not null and source is not null").select(F.col("lang").alias("dataset"), F.col("source").alias("model"), F.col("doc_id").alias("indices"), F.col("text").alias("full_traces"), "n_chars")
    artifacts.write_pickles(rec, place, "traces_", "columns")
    got = artifacts.pickled_traces(spark, place, {"indices": "long", "full_traces": "string", "n_chars": "long"})
    return got.select("dataset", "model", F.col("indices").alias("trace_index"), F.md5("full_traces").alias("text_md5"), "n_chars", F.length("full_traces").cast("long").alias("length"))


@query(f"with {FX_RM} select dataset, model, trace_index, 'rm::x' as rm, round(reward, 4) as reward from fx_rm1")
def artifact_rewards(spark, base):
    """Rewards out of pickles that name them in one of four ways."""
    place, i = scratch.folder(spark, "rewards"), F.col("trace_index") % 4
    one = src.rewards(spark, base).where("rm = 'rm_a'")
    rec = one.select("dataset", "model", F.col("trace_index").cast("string").alias("index"), F.when(i == 0, F.col("reward")).when(i == 1, float("nan")).alias("reward"), F.when(i == 1, F.col("reward")).alias("rm_reward"), F.when(i == 2, F.col("reward")).alias("score"), F.when(i == 3, F.create_map(F.lit("a"), F.lit(None).cast("double"), F.lit("b"), F.col("reward"))).alias("rewards_by_model"))
    artifacts.write_pickles(rec, place, "reward_model_x.")
    return artifacts.pickled_rewards(spark, place).withColumn("reward", F.round("reward", 4))


# --- algebra ----------------------------------------------------------------------------------
@query(r"""with d as (select doc_id as id, doc_id % 6 as k, n_chars % 9 + 1 as a, cast(doc_id / 6 as bigint) % 7 as b, doc_id % 4 as o,
  list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: len(w) > 2) as w from documents)
select id, case k when 0 then o = 0 when 1 then abs(a / (b + 1e0) - (a + o) / (b + 1e0)) <= 1e-4 * greatest(a / (b + 1e0), (a + o) / (b + 1e0)) when 2 then o = 0 when 3 then abs(sqrt(2e0 * a * a) - (a + o) * sqrt(2e0)) <= 1e-4 * greatest(sqrt(2e0 * a * a), (a + o) * sqrt(2e0)) when 4 then null
  else len(w) > 1 and list_sort(string_split(w[1], '')) = list_sort(string_split(case when o < 2 then reverse(w[1]) else w[2] end, '')) end as equal from d""")
def grade_math_symbolic(spark, base):
    """Equality by algebra: squares, fractions and decimals, turned equations, roots, what is undecided, and products of a text's letters."""
    d = src.read_table(spark, base, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 6).alias("k"), (F.col("n_chars") % 9 + 1).alias("a"), (F.floor(F.col("doc_id") / 6 + 0.5) % 7).alias("b"), (F.col("doc_id") % 4).alias("o"), F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2).alias("w"))
    a, b, o = (F.col(c) for c in "abo")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    first = F.try_element_at("w", F.lit(1))
    pred = _by_k(say("(x+", a, ")^2 - x\\cdot x"), say("\\frac{", a, "}{", b + 1, "}"), say(a, "x+y=", b), say("\\sqrt{", 2 * a * a, "}"), say("\\sin{x}+", a), first)
    truth = _by_k(say(2 * a, "x + ", a * a + o), say("(", a + o, ".0)/", b + 1), say(b + o, " = y + x*", a), say(a + o, "\\sqrt2"), say(a, "+\\cos{x}"), F.when(o < 2, F.reverse(first)).otherwise(F.try_element_at("w", F.lit(2))))
    two = F.size("w") > 1
    equal = algebra.symbolic_equal(pred, truth)
    return d.select("id", F.when((F.col("k") == 5) & ~two, False).otherwise(equal).alias("equal"))


@query(f"""with {FX_TRACES}, one as (select dataset, model, trace_index, score from fx_traces)
select dataset, model, trace_index, case when dataset in ('en', 'de') and trace_index % 5 = 0 then coalesce(score, 0) + 1 when dataset = 'fr' and trace_index % 3 = 0 then -1 else score end as score from one
union all select 'new', model, trace_index, score from one where trace_index % 10 = 0""")
def versioned_upserts(spark, base):
    """The newest version after loads that touch some partitions, and one that adds a partition."""
    table = versions.VersionedTable(spark, scratch.folder(spark, "versions"), list(S.KEY), ["dataset"])
    one = src.traces(spark, base).select(*S.KEY, "score", F.lit(1).alias("load_seq"))
    table.write(one)
    table.write(one.where("dataset in ('en', 'de') and trace_index % 5 = 0").select(*S.KEY, (F.coalesce("score", F.lit(0.0)) + 1).alias("score"), F.lit(2).alias("load_seq")))
    table.write(one.where("trace_index % 10 = 0").withColumn("dataset", F.lit("new")))
    table.write(one.where("dataset = 'fr' and trace_index % 3 = 0").select(*S.KEY, F.lit(-1.0).alias("score"), F.lit(3).alias("load_seq")))
    return table.read().drop("load_seq")


@query(f"""with {FX_JOINED}, f as (select *, row_number() over (partition by dataset, model order by trace_index) as i from fx_joined)
select dataset, model, string_agg(cast(token_count as varchar), ',' order by trace_index) as tokens, string_agg(cast(sentence_count as varchar), ',' order by trace_index) as sentences, string_agg(cast(cast(round(redundancy_score * 50) as bigint) as varchar), ',' order by trace_index) as redundancy from f where i <= 10000 group by all""")
def metric_arrays(spark, base):
    """Tokens, sentences and redundancy of each model's first traces, in order of the traces; what is missing is left out."""
    got = tr.metric_arrays(_joined(spark, base).withColumn("redundancy", F.round(F.col("redundancy_score") * 50).cast("long")), ["token_count", "sentence_count", "redundancy"], 10_000)
    said = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return got.select("dataset", "model", *[F.when(F.size(c) > 0, said(c)).alias(n) for c, n in (("token_count", "tokens"), ("sentence_count", "sentences"), ("redundancy", "redundancy"))])


@query(f"""with {FX_JOINED}, m as (select dataset, model, round(avg(score), 6) as accuracy, count(*) as n from fx_joined group by all)
select dataset, model, accuracy, row_number() over (order by dataset nulls first, accuracy desc nulls last, model nulls first) as place from m""")
def accuracy_order(spark, base):
    """Models of each dataset, most accurate first; a row for each model."""
    meta = tr.metadata(_joined(spark, base)).select("dataset", "model", F.round("accuracy", 6).alias("accuracy"))
    return meta.withColumn("place", F.row_number().over(Window.orderBy(F.col("dataset").asc_nulls_first(), F.col("accuracy").desc_nulls_last(), F.col("model").asc_nulls_first())).cast("long"))


@query(r"""with t as (select doc_id as trace_index, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') as s from documents),
p as (select trace_index, s, unnest(list_distinct(list_append(range(0, greatest(len(s) - 1, 0) + 1, 25), greatest(len(s) - 1, 0)))) as j from t),
x as (select trace_index, j, array_to_string(s[1:j], chr(10)) as t from p),
o as (select *, row_number() over w - 1 as place, lag(t) over w as b from x window w as (order by trace_index % 3, t, trace_index, j)),
l as (select *, least(length(t), length(b)) as m, string_split(t, '') as tc, string_split(b, '') as bc from o)
select trace_index, cast(j as bigint) as num_steps, place, cast(case when b is null or m = 0 then 0 else coalesce(list_position(list_transform(range(1, m + 1), lambda i: tc[i] <> bc[i]), true) - 1, m) end as bigint) as reused from l""")
def prefix_reuse(spark, base):
    """Prompts in an order of shared beginnings: the place of each, and how many characters it has in common with the one before."""
    t = src.traces(spark, base).select("trace_index", text.sentences("trace_text").alias("s"))
    prompts = t.select("trace_index", "s", F.explode(text.prefix_points(F.size("s"), 25)).alias("num_steps")).select("trace_index", "num_steps", text.prefix("s", "num_steps").alias("text"), (F.col("trace_index") % 3).alias("k"))
    return ordering.in_prefix_order(prompts, ["k", "text", "trace_index", "num_steps"]).select("trace_index", "num_steps", "place", "reused")


@query(r"""with m as (select distinct lang as dataset, 'Org/Model-' || (cast(substr(source, 4) as bigint) * 7 % 90 + 1) || 'B' as model from documents where lang is not null and source like 'src%'),
c as (select 'org--model-' || (n_nationkey * 14 % 90 + 1) || 'b' as name, cast(n_nationkey as varchar) as k, case when n_nationkey % 2 = 0 then 'en' else 'fr' end as over from nation union all select case r_regionkey when 0 then 'default_small' else 'default_large' end, 'd' || r_regionkey, 'de' from region where r_regionkey < 2),
r as (select m.*, coalesce(a.name, b.name) as config, coalesce(a.k, b.k) as k, coalesce(a.over, b.over) as over from m left join c a on a.name = replace(lower(m.model), '/', '--') left join c b on a.name is null and b.name = case when cast(regexp_extract(m.model, '-(\d+)B', 1) as double) > 50 then 'default_large' else 'default_small' end)
select dataset, model, config, case when dataset = over then 'x' || k else 't' || k end as temperature, 'm' || k as max_tokens, case when dataset = over then '["' || k || '"]' end as stop, '{"a":1}' as rope, case when dataset = over then 'true' end as eager from r""")
def generation_configs(spark, base):
    """Parameters of each model and dataset: own configs, defaults by size, overrides of a dataset laid over them."""
    d = src.read_table(spark, base, "documents").where("lang is not null and source like 'src%'")
    models = d.select(F.col("lang").alias("dataset"), F.concat(F.lit("Org/Model-"), (F.substring("source", 4, 9).cast("long") * 7 % 90 + 1).cast("string"), F.lit("B")).alias("model")).distinct()
    n = F.col("n_nationkey")
    named = src.read_table(spark, base, "nation").select(F.concat(F.lit("org--model-"), (n * 14 % 90 + 1).cast("string"), F.lit("b")).alias("name"), n.cast("string").alias("k"), F.when(n % 2 == 0, "en").otherwise("fr").alias("over"))
    sizes = src.read_table(spark, base, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "default_small").otherwise("default_large").alias("name"), F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("k"), F.lit("de").alias("over"))
    say = lambda *x: F.concat(*[F.col(v) if v in ("k", "over") else F.lit(v) for v in x])
    body = say('{"sampling_params": {"temperature": "t', "k", '", "max_tokens": "m', "k", '"}, "vllm_kwargs": {"rope": {"a": 1}}, "dataset_overrides": {"', "over", '": {"sampling_params": {"temperature": "x', "k", '", "stop": ["', "k", '"]}, "vllm_kwargs": {"eager": true}}}}')
    got = configs.resolve(models, named.unionByName(sizes).select("name", body.alias("body")))
    at = lambda s, k: F.try_element_at(s, F.lit(k)).alias(k)
    return got.select("dataset", "model", "config", *[at("sampling_params", k) for k in ("temperature", "max_tokens", "stop")], *[at("vllm_kwargs", k) for k in ("rope", "eager")])


@query("""with d as (select distinct lang as dataset, source as model from documents where lang is not null and source is not null)
select dataset, model, model not in ('src1', 'src4') as there, case when model not in ('src1', 'src4') then n end as rows from d left join (select lang, source, count(*) as n from documents group by all) c on c.lang = dataset and c.source = model""")
def artifact_paths(spark, base):
    """Which models' artifacts the file system has, and how many rows lie in them."""
    place, docs = scratch.folder(spark, "paths"), src.read_table(spark, base, "documents").where("lang is not null and source is not null")
    rows = docs.select(F.col("lang").alias("dataset"), F.col("source").alias("model"), F.col("doc_id").alias("index"))
    artifacts.write_pickles(rows.where("model not in ('src1', 'src4')"), place, "pu_")
    told = artifacts.with_paths(rows.select("dataset", "model").distinct(), artifacts.found_paths(spark, place), "pu_*.pkl")
    held = artifacts.read_pickles(spark, place).where("field = 'data'").groupBy("dataset", "model").agg(F.count("*").alias("rows"))
    return told.join(held, ["dataset", "model"], "left").select("dataset", "model", "there", "rows")


@query("select doc_id as trace_index, n_chars from documents order by doc_id limit 25")
def first_traces(spark, base):
    """The first traces by index, as a smoke run takes them."""
    return artifacts.first_rows(src.read_table(spark, base, "documents").select(F.col("doc_id").alias("trace_index"), "n_chars"), "trace_index", 25)


@query(f"""with {FX_TRACES}, b as (select dataset, model, min(trace_index) as a, min(trace_index) + 40 as z, count(*) % 3 as k, list_sort(list(trace_index) filter (trace_index % 50 = 0)) as l from fx_traces where dataset is not null and model is not null group by all)
select distinct dataset, model, cast(unnest(case when k = 0 then coalesce(l, []) else range(a, z) end) as bigint) as trace_index from b where k < 2""")
def bt_inflight(spark, base):
    """Keys on their way: indices that a batch lists, or its half-open range; finished batches have none."""
    t = src.traces(spark, base).where("dataset is not null and model is not null")
    k = F.col("k")
    b = t.groupBy("dataset", "model").agg(F.min("trace_index").alias("a"), (F.count("*") % 3).alias("k"), F.collect_list(F.when(F.col("trace_index") % 50 == 0, F.col("trace_index"))).alias("l"))
    listed = b.select("dataset", "model", F.when(k == 0, F.col("l")).alias("indices"), F.when(k > 0, F.col("a")).alias("start_index"), F.when(k > 0, F.col("a") + 40).alias("end_index"), F.when(k == 2, "completed").otherwise("running").alias("status"))
    return bt.inflight_keys(listed)


@query(None)
def bpe_token_counts(spark, base):
    """Tokens of every text by a public vocabulary, beside its white-space words."""
    ranks = tokens.read_ranks(spark)
    return src.traces(spark, base).select("dataset", "model", "trace_index", tokens.count_bpe_tokens("trace_text", ranks).alias("bpe_tokens"), text.count_tokens("trace_text").alias("token_count"))
