"""Registered queries of the engine, over the fixture views, and their SQL twins for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tracemill import schema as S
from tracemill.functions import grading, jsonparse, text
from tracemill.operators import backtracking as bt, curves, pu, stats, store, traces as tr
from tracemill.plans import serving
from tracemill.sources import tables as src

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, without a negative zero: sums differ in the last ones with the order of rows."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = lambda spark, base: rounded(f(spark, base))
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return register


# --- SQL of the fixture views ----------------------------------------------------------------
FX_TRACES = "fx_traces as (select d.lang as dataset, d.source as model, d.doc_id as trace_index, d.text as trace_text, d.n_chars, cast(l.quality as double) as score from documents d left join labels l on l.doc_id = d.doc_id)"
FX_BT = """fx_bt as (select lang as dataset, source as model, doc_id as trace_index, case when n_chars % 7 > 2 then 1 else 0 end as hit, n_chars % 7 as k,
  case when n_chars % 13 = 0 then null else (n_chars % 101) / 100.0e0 end as confidence, case when n_chars % 17 = 0 then 'parse error' end as error
  from documents where doc_id % 11 <> 0)"""
FX_PU = """fx_pu as (select dataset, teacher_model, student_model, trace_index, num_steps, total_steps, cast(num_steps as double) / total_steps * 100 as pct,
  case when dataset = 'connections' then least(4.0e0, floor(value / 40)) when value > 60 then 1.0e0 else 0.0e0 end as score, teacher_score
  from (select case user_id % 3 when 0 then 'math' when 1 then 'gpqa' else 'connections' end as dataset,
      concat('t', cast(cast(floor(user_id / 3) as bigint) % 2 as varchar)) as teacher_model, concat('s', cast(event_id % 2 as varchar)) as student_model, user_id as trace_index, value,
      row_number() over (partition by user_id, event_id % 2 order by ts, event_id) - 1 as num_steps, count(*) over (partition by user_id, event_id % 2) as total_steps,
      case when user_id % 5 = 0 then 0.0e0 else 1.0e0 end as teacher_score from events) e)"""
NORM = "case when dataset = 'connections' then score / 4 else score end"
FX_RM = """fx_rm1 as (select case c_custkey % 3 when 0 then 'math' when 1 then 'gpqa' else 'connections' end as dataset,
  concat('t', cast(cast(floor(c_custkey / 3) as bigint) % 2 as varchar)) as model, c_custkey as trace_index, c_acctbal as reward from customer),
fx_rm as (select dataset, model, trace_index, 'rm_a' as rm, reward from fx_rm1 union all select dataset, model, trace_index, 'rm_b', reward * -0.5 + trace_index from fx_rm1)"""
FX_STEPS = "fx_steps as (select cast(label as bigint) as trace_index, vec_id, embedding, row_number() over (partition by label order by vec_id) - 1 as step from embeddings)"
TOKENS = r"case when regexp_replace(coalesce(trace_text, ''), '^\s+|\s+$', '', 'g') = '' then 0 else len(regexp_split_to_array(regexp_replace(trace_text, '^\s+|\s+$', '', 'g'), '\s+')) end"
SENTENCES = r"len(list_filter(list_transform(regexp_split_to_array(coalesce(trace_text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''))"
FX_JOINED = f"""{FX_TRACES},
fx_eff as (select dataset, model, trace_index, score, {TOKENS} as token_count, {SENTENCES} as sentence_count from fx_traces),
fx_red as (select dataset, model, trace_index, n_chars % 50 / 50.0e0 as redundancy_score from fx_traces where trace_index % 7 <> 0),
fx_joined as (select t.*, e.token_count, e.sentence_count, r.redundancy_score from fx_traces t left join fx_eff e using (dataset, model, trace_index) left join fx_red r using (dataset, model, trace_index))"""
PEARSON = "case when count(*) filter ({x} is not null and {y} is not null) >= 3 and var_pop(case when {y} is not null then {x} end) * var_pop(case when {x} is not null then {y} end) > 0 then covar_pop({x}, {y}) / sqrt(var_pop(case when {y} is not null then {x} end) * var_pop(case when {x} is not null then {y} end)) end"


def pearson_sql(x: str, y: str) -> str:
    return PEARSON.format(x=x, y=y)


FIT = {
    "slope": "case when var_pop({x}) > 0 then regr_slope({y}, {x}) else 0.0e0 end",
    "intercept": "case when var_pop({x}) > 0 then regr_intercept({y}, {x}) else avg({y}) end",
    "mse": "case when var_pop({x}) > 0 then greatest(0.0e0, var_pop({y}) - covar_pop({y}, {x}) * covar_pop({y}, {x}) / var_pop({x})) else 0.0e0 end",
    "r2": "case when var_pop({x}) > 0 and var_pop({y}) > 0 then regr_r2({y}, {x}) else 0.0e0 end",
}


def _joined(spark, base, text_too: bool = False) -> DataFrame:
    """Traces with their metrics; the texts only where they are asked for, so that no join carries them."""
    known = src.traces(spark, base)
    return tr.with_metrics(known if text_too else known.drop("trace_text"), src.efficiency(spark, base), src.redundancy_scores(spark, base))


def _measured(spark, base) -> DataFrame:
    """The same metrics in one scan of the documents, without their texts: for statistics that need no join of artifacts."""
    d, l = src.read_table(spark, base, "documents"), src.read_table(spark, base, "labels")
    known = F.col("lang").isNotNull() & F.col("source").isNotNull()
    one = d.select("doc_id", F.col("lang").alias("dataset"), F.col("source").alias("model"), F.when(known, text.count_tokens("text")).alias("token_count"), F.when(known, text.count_sentences("text")).alias("sentence_count"), F.when(known & (F.col("doc_id") % 7 != 0), F.col("n_chars") % 50 / 50.0).alias("redundancy_score"))
    return one.join(l, "doc_id", "left").select("dataset", "model", F.col("doc_id").alias("trace_index"), F.col("quality").cast("double").alias("score"), "token_count", "sentence_count", "redundancy_score")


# --- transfer utility ------------------------------------------------------------------------
TOTALS = """select dataset, teacher_model, student_model, count(*) as total_questions, count(*) filter (regressions > 0) as regressed_questions, cast(sum(regressions) as bigint) as total_regressions,
  round(100.0e0 * count(*) filter (regressions > 0) / count(*), 6) as regression_percentage, round(cast(sum(regressions) as double) / count(*), 6) as avg_regressions_per_question
from events_ group by all"""
STEP_MEANS = f"""step_means as (select dataset, teacher_model, student_model, trace_index, num_steps, avg(case when score > 0 then 1.0e0 else 0.0e0 end) as c, avg({NORM}) as y from {{source}} group by all),
falls as (select *, lag(c) over (partition by dataset, teacher_model, student_model, trace_index order by num_steps) as prev from step_means)"""
REGRESSION_SQL = f"""with {FX_PU}, good as (select * from fx_pu where teacher_score > 0.5), {STEP_MEANS.format(source="good")},
events_ as (select dataset, teacher_model, student_model, trace_index, count(*) filter (prev >= 0.5 and c < 0.5) as regressions from falls group by all) {TOTALS}"""


@query(REGRESSION_SQL)
def pu_regression(spark: SparkSession, base: str) -> DataFrame:
    return pu.regressions(src.pu_records(spark, base))


@query(f"""with {FX_PU}, seen as (select *, max(case when score = 1 then 1 else 0 end) over (partition by dataset, teacher_model, student_model, trace_index order by num_steps rows between unbounded preceding and 1 preceding) as s from fx_pu where teacher_score > 0.5),
events_ as (select dataset, teacher_model, student_model, trace_index, count(*) filter (s = 1 and score = 0) as regressions from seen group by all) {TOTALS}""")
def pu_regression_latched(spark, base):
    return pu.latched_regressions(src.pu_records(spark, base))


BINS = f"bins as (select dataset, teacher_model, student_model, cast(floor(pct / 2) as bigint) * 2 + 1 as bin_center, avg({NORM}) as mean_correct, stddev_pop({NORM}) as std_correct, count(*) as n from fx_pu where teacher_score > 0.5 group by all)"


@query(f"with {FX_PU}, {BINS} select dataset, teacher_model, student_model, bin_center, round(mean_correct, 6) as mean_correct, round(std_correct, 6) as std_correct, n as count from bins")
def pu_percentage_bins(spark, base):
    return pu.percentage_bins(src.pu_records(spark, base))


@query(f"with {FX_PU} select dataset, teacher_model, student_model, cast(floor(num_steps / 10) as bigint) * 10 + 5.0e0 as bin_center, round(avg({NORM}), 6) as mean_correct, round(stddev_pop({NORM}), 6) as std_correct, count(*) as count from fx_pu where teacher_score > 0.5 group by all having count(*) >= 10")
def pu_absolute_bins(spark, base):
    return pu.absolute_bins(src.pu_records(spark, base))


@query(f"""with {FX_PU}, m as (select *, max(num_steps) over (partition by dataset, teacher_model) as top from fx_pu)
select dataset, teacher_model, cast(floor(num_steps / 2) as bigint) * 2 + 1.0e0 as bin, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, count(*) as count
from m where num_steps < cast(ceil((top + 2) / 2) as bigint) * 2 - 2 group by all having count(*) >= 10""")
def pu_step_bins_sample_std(spark, base):
    return pu.step_bins(src.pu_records(spark, base))


@query(f"""with {FX_PU}, m as (select *, cast(num_steps as double) * 100 / nullif(max(num_steps) over (partition by dataset, teacher_model), 0) as p from fx_pu)
select dataset, teacher_model, cast(floor(p / 2) as bigint) * 2 + 1.0e0 as bin, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, count(*) as count from m where p < 100 group by all having count(*) >= 10""")
def pu_percent_of_max_bins(spark, base):
    return pu.percent_of_max_bins(src.pu_records(spark, base))


TRACE_METRICS = f"""{STEP_MEANS.format(source="fx_pu")},
curve as (select dataset, teacher_model, student_model, trace_index, case when count(*) >= 2 then {FIT["mse"].format(x="cast(num_steps as double)", y="y")} end as linearity_mse,
  cast(count(*) filter (prev >= 0.5 and c < 0.5) as double) / nullif(count(prev), 0) as regression_rate from falls group by all),
av as (select dataset, teacher_model, student_model, trace_index, avg(case when score > 0 then 1.0e0 else 0.0e0 end) as avg_correct from fx_pu group by all),
tm as (select av.*, curve.linearity_mse, curve.regression_rate from av join curve using (dataset, teacher_model, student_model, trace_index)),
pt as (select dataset, teacher_model as model, trace_index, avg(avg_correct) as avg_correct, avg(linearity_mse) as linearity_mse, avg(regression_rate) as regression_rate from tm group by all)"""


@query(f"with {FX_PU}, {TRACE_METRICS} select dataset, model, trace_index, round(avg_correct, 6) as avg_correct, round(linearity_mse, 6) as linearity_mse, round(regression_rate, 6) as regression_rate from pt")
def pu_trace_metrics(spark, base):
    return pu.trace_metrics_of_students(pu.trace_metrics(src.pu_records(spark, base)))


@query(f"with {FX_PU} select dataset, teacher_model, round(avg(score), 6) as mean_score, round(stddev_samp(score), 6) as std_score, count(*) as count, round(avg(case when num_steps = 0 then score end), 6) as j0_accuracy from fx_pu group by all")
def pu_overall_by_teacher(spark, base):
    return pu.overall(src.pu_records(spark, base))


CURVE = f"{BINS}, curve as (select dataset, teacher_model as model, cast(bin_center as double) as x, avg(mean_correct) as y, cast(sum(n) as bigint) as n from bins group by all)"
CURVE_PARTS = f"{CURVE}, parts as (select *, (x - lag(x) over w) * (y + lag(y) over w) / 2.0e0 as part, abs(y - lag(y) over w) as d from curve window w as (partition by dataset, model order by x))"


def _curve(spark, base) -> DataFrame:
    return curves.over_students(pu.percentage_bins(src.pu_records(spark, base)))


@query(f"""with {FX_PU}, {CURVE_PARTS} select dataset, model, cast(sum(n) as bigint) as total_count, round(avg(y), 6) as mean_accuracy,
  {", ".join(f"case when count(*) >= 2 then round({FIT[k].format(x='x', y='y')}, 6) + 0 end as {k}" for k in ("slope", "r2", "mse"))},
  case when count(*) >= 2 then round(coalesce(sum(part) / nullif(max(x) - min(x), 0), 0), 6) end as auc from parts group by all""")
def pu_leaderboard_curve(spark, base):
    return curves.leaderboard(_curve(spark, base))


@query(f"""with reg as ({REGRESSION_SQL}) select dataset, teacher_model as model, cast(sum(total_questions) as bigint) as total_questions, cast(sum(regressed_questions) as bigint) as regressed_questions,
  cast(sum(total_regressions) as bigint) as total_regressions, round(avg(regression_percentage), 4) as regression_percentage from reg group by all""")
def pu_leaderboard_regressions(spark, base):
    return rounded(pu.leaderboard_regressions(pu.regressions(src.pu_records(spark, base))), 4)


@query(f"""with {FX_PU}, {CURVE}, c as (select *, ln(x + 1) as lx from curve) select dataset, model, count(*) as points,
  {", ".join(f"round({FIT[k].format(x=x, y='y')}, 6) + 0 as {k}_{kind}" for kind, x in (("linear", "x"), ("log", "lx")) for k in ("slope", "intercept", "mse", "r2"))} from c group by all having count(*) >= 3""")
def pu_curve_fit_log(spark, base):
    return curves.fits(_curve(spark, base))


@query(f"with {FX_PU}, {CURVE_PARTS} select dataset, model, round(coalesce(sum(d), 0.0e0), 6) as total_variation, round(coalesce(sum(d) / nullif(max(y) - min(y), 0), 0.0e0), 6) as normalized_tv, round(coalesce(avg(d), 0.0e0), 6) as mean_step from parts group by all")
def pu_total_variation(spark, base):
    return curves.total_variation(_curve(spark, base))


PENALISED = """m as (select dataset, model, sum(part) as raw_auc, coalesce(sum(part) / nullif(max(x) - min(x), 0), sum(part)) as normalized_auc, avg(x) as mean_steps, stddev_pop(x) as step_std, avg(d) as roughness from parts group by all having count(*) >= 2),
p as (select *, case when count(*) over w > 1 then 0.1e0 * coalesce(mean_steps / nullif(max(mean_steps) over w, 0), 0) end as lp, case when count(*) over w > 1 then 0.1e0 * coalesce(step_std / nullif(max(step_std) over w, 0), 0) end as cp, case when count(*) over w > 1 then 0.1e0 * roughness end as sp from m window w as (partition by dataset))"""


@query(f"""with {FX_PU}, {CURVE_PARTS},
{PENALISED}
select dataset, model, round(raw_auc, 6) as raw_auc, round(normalized_auc, 6) as normalized_auc, round(mean_steps, 6) as mean_steps, round(step_std, 6) as step_std, round(roughness, 6) as roughness, round(lp, 6) as length_penalty, round(cp, 6) as concentration_penalty, round(sp, 6) as smoothness_penalty, round(normalized_auc - lp - cp - sp, 6) as penalized_auc from p""")
def pu_penalized_auc(spark, base):
    return curves.penalised_area(_curve(spark, base))


@query(f"""with {FX_PU}, {CURVE}, r as (select *, row_number() over (partition by dataset, model order by x) - 1 as i, count(*) over (partition by dataset, model) as n2 from curve),
o as (select cast(unnest(range(-6, 7)) as bigint) as k), w as (select k, exp(-0.5e0 * (k / 1.5e0) * (k / 1.5e0)) as g from o), ws as (select k, g / sum(g) over () as g from w),
j as (select r.dataset, r.model, r.x, r.y, r.n2, ws.g, ((r.i + ws.k) % (2 * r.n2) + 2 * r.n2) % (2 * r.n2) as p from r cross join ws),
f as (select dataset, model, x, y, n2, g, case when p < n2 then p else 2 * n2 - 1 - p end as i from j)
select f.dataset, f.model, f.x, round(case when max(f.n2) >= 3 then sum(f.g * r.y) else max(f.y) end, 6) as y from f join r on r.dataset = f.dataset and r.model = f.model and r.i = f.i group by f.dataset, f.model, f.x""")
def pu_smoothed_curve(spark, base):
    return curves.smoothed(_curve(spark, base))


@query(f"""with {FX_PU}, {CURVE}, q as (select *, y / nullif(sum(y) over (partition by dataset, model), 0) as q from curve)
select dataset, model, count(*) as bins, round(case when count(*) > 1 then sum(-q * ln(q + 1e-12)) / ln(cast(count(*) as double)) end, 6) as entropy from q group by all""")
def pu_normalized_entropy(spark, base):
    return curves.entropy(_curve(spark, base), ["dataset", "model"], "y")


@query(f"""with {FX_PU}, pick as (select *, md5(concat_ws('|', cast(trace_index as varchar), cast(num_steps as varchar), student_model, '1')) as pick from fx_pu where teacher_score > 0.5 and pct >= 24 and pct < 26 order by pick limit 20)
select p.trace_index, p.dataset, p.teacher_model, p.student_model, p.num_steps, p.score, d.text as trace_text, p.pick from pick p join documents d on d.doc_id = p.trace_index""")
def pu_samples_in_bin(spark, base):
    got = pu.samples_in_bin(src.pu_records(spark, base), src.traces(spark, base), 25.0, 20)
    return got.select("trace_index", "dataset", "teacher_model", "student_model", "num_steps", "score", "trace_text", "pick")


# --- traces ----------------------------------------------------------------------------------
@query(f"with {FX_JOINED} select dataset, model, trace_index, score, cast(token_count as bigint) as token_count, cast(sentence_count as bigint) as sentence_count, round(redundancy_score, 6) as redundancy_score from fx_joined where score >= 0.5 order by trace_index limit 50 offset 50")
def trace_page(spark, base):
    return tr.page(_joined(spark, base), 0.5, None, 1, 50).drop("trace_text", "n_chars")


@query(f"with {FX_JOINED} select dataset, model, trace_index, trace_text, n_chars, score, cast(token_count as bigint) as token_count, cast(sentence_count as bigint) as sentence_count, round(redundancy_score, 6) as redundancy_score from fx_joined where dataset = 'en' and model = 'src3'")
def trace_detail(spark, base):
    return _joined(spark, base, True).where("dataset = 'en' and model = 'src3'")


META = "meta as (select dataset, model, count(*) as total_traces, avg(score) as accuracy, avg(token_count) as avg_tokens, avg(redundancy_score) as avg_redundancy from fx_joined group by all)"


@query(f"with {FX_JOINED}, {META} select dataset, model, total_traces, round(accuracy, 6) as accuracy, round(avg_tokens, 6) as avg_tokens, round(avg_redundancy, 6) as avg_redundancy from meta")
def model_metadata(spark, base):
    return tr.metadata(_joined(spark, base))


@query(f"with {FX_JOINED}, {META} select dataset, model, total_traces, cast(floor(coalesce(accuracy, 0) * total_traces) as bigint) as correct, total_traces - cast(floor(coalesce(accuracy, 0) * total_traces) as bigint) as incorrect from meta")
def models_summary(spark, base):
    return tr.models_summary(tr.metadata(_joined(spark, base)))


@query(f"with {FX_JOINED} select dataset, model, " + ", ".join(f"round({f}({c}), 6) as {n}_{c}" for c in ("token_count", "sentence_count", "redundancy_score") for n, f in (("mean", "avg"), ("median", "median"))) + " from fx_joined group by all")
def efficiency_by_model(spark, base):
    return tr.by_model(_measured(spark, base))


@query(f"with {FX_JOINED} select dataset, count(*) as n, " + ", ".join(f"round(avg({c}), 6) as mean_{c}, round(stddev_samp({c}), 6) as std_{c}, round(avg(case when score > 0.5 then {c} end), 6) as mean_{c}_correct, round(avg(case when score <= 0.5 then {c} end), 6) as mean_{c}_incorrect, round({pearson_sql(f'cast({c} as double)', 'score')}, 6) + 0 as r_{c}_score" for c in ("token_count", "sentence_count", "redundancy_score")) + " from fx_joined group by all")
def efficiency_stats(spark, base):
    return tr.length_stats(_measured(spark, base), ["token_count", "sentence_count", "redundancy_score"])


PER_STEP = f"""{FX_STEPS}, pairs as (select a.trace_index, a.step, b.step as prior, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double))) as sim from fx_steps a join fx_steps b on a.trace_index = b.trace_index and b.step < a.step),
best as (select trace_index, step, max(sim) as best, arg_max(prior, sim) as match from pairs group by all),
ps as (select s.trace_index, s.step, coalesce(b.best, 0.0e0) as best, cast(coalesce(b.match, -1) as bigint) as match from fx_steps s left join best b using (trace_index, step))"""


@query(f"with {PER_STEP} select trace_index, step, round(best, 6) as best, match from ps")
def redundancy_per_step(spark, base):
    return tr.redundancy_per_step(src.steps(spark, base))


@query(f"with {PER_STEP} select trace_index, count(*) as steps, round(coalesce(cast(count(*) filter (step > 0 and best > 0.3) as double) / nullif(count(*) filter (step > 0), 0), 0), 6) as redundancy_score, round(avg(case when step > 0 then best end), 6) as mean_best from ps group by all")
def redundancy_stats(spark, base):
    return tr.redundancy_stats(tr.redundancy_per_step(src.steps(spark, base)), 0.3)


# --- backtracking ----------------------------------------------------------------------------
BT = f"{FX_TRACES}, {FX_BT}, b as (select fx_bt.*, t.score from fx_bt left join fx_traces t using (dataset, model, trace_index))"
BT_SUM = "s as (select dataset, model, count(*) as total, count(*) filter (hit = 1) as detected, avg(case when hit = 1 then k end) as avg_steps, avg(confidence) as avg_confidence, avg(case when score > 0.5 then 1.0e0 else 0.0e0 end) as trace_accuracy, count(*) filter (score > 0.5) as correct, count(*) filter (score <= 0.5) as incorrect, count(*) filter (score > 0.5 and hit = 1) as correct_detected, count(*) filter (score <= 0.5 and hit = 1) as incorrect_detected from b group by all)"


@query(f"with {BT}, {BT_SUM} select dataset, model, total, detected, round(avg_steps, 6) as avg_steps, round(avg_confidence, 6) as avg_confidence, round(trace_accuracy, 6) as trace_accuracy, correct, incorrect, correct_detected, incorrect_detected from s")
def bt_summary(spark, base):
    return bt.summary(src.backtracking(spark, base), src.traces(spark, base))


@query(f"with {BT} select dataset, model, trace_index, hit as backtracking_detected, k as num_backtracking_steps, round(confidence, 6) as confidence, error, score from b where hit = 1 and score > 0.5 order by coalesce(k, -1) desc, trace_index limit 100")
def bt_trace_list(spark, base):
    return bt.trace_list(src.backtracking(spark, base), src.traces(spark, base), True, "correct", "steps", 100)


@query(f"""with {FX_JOINED}, {FX_BT}, b as (select fx_bt.*, t.score from fx_bt left join fx_traces t using (dataset, model, trace_index)), {META}, {BT_SUM}
select m.dataset, m.model, m.total_traces, round(m.accuracy, 6) as accuracy, round(m.avg_tokens, 6) as avg_tokens, round(m.avg_redundancy, 6) as avg_redundancy, s.total as bt_total, s.detected as bt_detected, round(s.avg_steps, 6) as bt_avg_steps, round(s.avg_confidence, 6) as bt_avg_confidence,
  round(cast(s.detected as double) / nullif(s.total, 0), 6) as bt_rate, round(cast(s.correct_detected as double) / nullif(s.correct, 0), 6) as bt_rate_correct, round(cast(s.incorrect_detected as double) / nullif(s.incorrect, 0), 6) as bt_rate_incorrect from meta m left join s using (dataset, model)""")
def bt_leaderboard(spark, base):
    return bt.leaderboard(tr.metadata(_joined(spark, base)), src.backtracking(spark, base), src.traces(spark, base))


@query(f"with {BT}, c as (select *, case when score > 0.5 then 1.0e0 else 0.0e0 end as ok, cast(k as double) as kd from b) select dataset, count(*) as n, count(*) filter (hit = 1) as detected, round(avg(case when hit = 1 then kd end), 6) as avg_steps, cast(sum(ok) as bigint) as correct, round({pearson_sql('kd', 'ok')}, 6) + 0 as r from c group by all")
def bt_correlation(spark, base):
    return bt.correlation(src.backtracking(spark, base), src.traces(spark, base))


BT_TABLE = "m as (select dataset, model, avg(k) as mean_steps, stddev_samp(k) as std_steps, avg(case when score > 0.5 then k end) as mean_correct, avg(case when score <= 0.5 then k end) as mean_incorrect from b group by all), tab as (select *, mean_steps = max(mean_steps) over (partition by dataset) as is_max, mean_steps = min(mean_steps) over (partition by dataset) as is_min from m)"


@query(f"with {BT}, {BT_TABLE} select dataset, model, round(mean_steps, 6) as mean_steps, round(std_steps, 6) as std_steps, round(mean_correct, 6) as mean_correct, round(mean_incorrect, 6) as mean_incorrect, is_max, is_min from tab")
def bt_table(spark, base):
    return bt.table(src.backtracking(spark, base), src.traces(spark, base))


@query(f"with {BT} select t.dataset, t.model, count(*) as needed, count(f.trace_index) as processed, count(*) filter (f.trace_index is not null and f.error is null) as ok from fx_traces t left join fx_bt f using (dataset, model, trace_index) group by all")
def bt_coverage(spark, base):
    return bt.coverage(src.backtracking(spark, base), src.traces(spark, base))


@query(f"""with {BT}, fl as (select * from fx_bt where error is not null and trace_index % 2 = 0), inf as (select * from fx_traces where trace_index % 22 = 0),
a as (select dataset, model, trace_index from fx_traces t where not exists (select 1 from fx_bt f where f.dataset = t.dataset and f.model = t.model and f.trace_index = t.trace_index) union select dataset, model, trace_index from fl)
select * from a where not exists (select 1 from inf where inf.dataset = a.dataset and inf.model = a.model and inf.trace_index = a.trace_index)""")
def bt_missing_targets(spark, base):
    all_, done = src.traces(spark, base), src.backtracking(spark, base)
    batches = all_.where("trace_index % 22 = 0").groupBy("dataset", "model").agg(F.collect_list("trace_index").alias("indices")).select("dataset", "model", "indices", F.lit(None).cast("long").alias("start_index"), F.lit(None).cast("long").alias("end_index"), F.lit("running").alias("status"))
    return bt.targets(all_, done, done.where("error is not null and trace_index % 2 = 0"), bt.inflight_keys(batches))


@query(f"""with {BT}, two as (select dataset, model, trace_index, k, error, 1 as batch_seq from fx_bt union all select dataset, model, trace_index, k + 10, case when trace_index % 3 = 0 then 'again' end, 2 from fx_bt where trace_index % 2 = 0)
select dataset, model, trace_index, k as num_backtracking_steps, error, batch_seq from (select *, row_number() over (partition by dataset, model, trace_index order by case when error is null then 0 else 1 end, batch_seq desc) as r from two) where r = 1""")
def bt_merge_precedence(spark, base):
    one = src.backtracking(spark, base).select(*S.KEY, "num_backtracking_steps", "error", F.lit(1).alias("batch_seq"))
    two = one.where("trace_index % 2 = 0").select(*S.KEY, (F.col("num_backtracking_steps") + 10).alias("num_backtracking_steps"), F.when(F.col("trace_index") % 3 == 0, "again").alias("error"), F.lit(2).alias("batch_seq"))
    return bt.merge(one, two)


@query(f"""with {FX_JOINED}, s as (select dataset, model, token_count, trace_index % 11 <> 0 as done, case when trace_index % 11 <> 0 then n_chars % 400 end as o, row_number() over (partition by dataset, model order by trace_index) as i from fx_joined),
m as (select dataset, model, count(*) filter (not done) as remaining, avg(case when i <= 50 then token_count end) as mean_prompt, coalesce(avg(case when i <= 50 then o end), 2048.0e0) as mean_output from s group by all)
select dataset, model, remaining, round(mean_prompt, 6) as mean_prompt, round(mean_output, 6) as mean_output, round(remaining * 1.1e0 * (mean_prompt * 0.15e0 + mean_output * 0.6e0) / 1e6, 6) as cost_usd from m""")
def bt_cost_estimate(spark, base):
    done = F.col("trace_index") % 11 != 0
    return bt.cost_estimate(_joined(spark, base).select("dataset", "model", "trace_index", F.col("token_count").alias("prompt_tokens"), F.when(done, F.col("n_chars") % 400).alias("output_tokens"), done.alias("done")), 0.15, 0.6)


@query(f"with {BT} select dataset, model, trace_index, hit as backtracking_detected, k as num_backtracking_steps, round(confidence, 6) as confidence, error, score from b where hit = 0 and score <= 0.5 order by coalesce(confidence, -1) desc, trace_index limit 40 offset 5")
def bt_trace_list_by_confidence(spark, base):
    """Wrong traces without a finding, surest first."""
    return bt.trace_list(src.backtracking(spark, base), src.traces(spark, base), False, "incorrect", "confidence", 40, 5)


@query(f"with {BT} select dataset, model, trace_index, hit as backtracking_detected, k as num_backtracking_steps, round(confidence, 6) as confidence, error, score from b order by trace_index, dataset, model limit 2000")
def bt_trace_list_by_index(spark, base):
    """All verdicts in order of index; a limit beyond the largest page is that of the largest page."""
    return bt.trace_list(src.backtracking(spark, base), src.traces(spark, base), limit=1_000_000, offset=-3)


@query(f"""with {FX_JOINED}, s as (select dataset, model, token_count, trace_index % 11 <> 0 as done, case when trace_index % 11 <> 0 then n_chars % 400 end as o, row_number() over (partition by dataset, model order by trace_index) as i from fx_joined),
m as (select dataset, model, count(*) filter (not done) as remaining, avg(case when i <= 50 then token_count end) as mean_prompt, coalesce(avg(case when i <= 50 then o end), 2048.0e0) as mean_output from s group by all)
select cast(sum(remaining) as bigint) as remaining, count(*) as pairs, round(sum(remaining * 1.1e0 * (mean_prompt * 0.15e0 + mean_output * 0.6e0) / 1e6), 6) as cost_usd from m""")
def bt_cost_total(spark, base):
    """Grand total of what remains and costs."""
    return bt.cost_total(bt_cost_estimate(spark, base))


@query(f"with {FX_BT}, e as (select *, case when trace_index % 5 = 0 then 'Timeout after 10 seconds' else error end as why from fx_bt) select dataset, count(*) as total, count(*) filter (why is null) as successful, count(*) filter (why = 'Timeout after 10 seconds') as timeouts, count(*) filter (why <> 'Timeout after 10 seconds') as exceptions, count(*) filter (hit = 1) as correct, round(100.0e0 * count(*) filter (why is null) / count(*), 6) as successful_percentage, round(100.0e0 * count(*) filter (why = 'Timeout after 10 seconds') / count(*), 6) as timeout_percentage, round(100.0e0 * count(*) filter (why <> 'Timeout after 10 seconds') / count(*), 6) as exception_percentage, round(100.0e0 * count(*) filter (hit = 1) / count(*), 6) as correct_percentage from e group by all")
def grading_classes(spark, base):
    """How grading went, by class of error."""
    rows = src.backtracking(spark, base).withColumn("error", F.when(F.col("trace_index") % 5 == 0, serving.TIMEOUT).otherwise(F.col("error"))).withColumn("score", F.col("backtracking_detected"))
    return serving.grading_classes(rows)


# --- rewards and correlations ----------------------------------------------------------------
RM_WIDE = "w as (select dataset, model, trace_index, avg(case when rm = 'rm_a' then reward end) as rm_a, avg(case when rm = 'rm_b' then reward end) as rm_b, (avg(case when rm = 'rm_a' then reward end) + avg(case when rm = 'rm_b' then reward end)) / 2 as rm_mean from fx_rm group by all)"


@query(f"with {FX_RM}, {RM_WIDE} select dataset, model, trace_index, round(rm_a, 6) as rm_a, round(rm_b, 6) as rm_b, round(rm_mean, 6) as rm_mean from w")
def rm_pivot_mean(spark, base):
    return tr.reward_pivot(src.rewards(spark, base), ["rm_a", "rm_b"])


@query(f"with {FX_RM} select dataset, rm, count(reward) as n, round(avg(reward), 4) as mean, round(stddev_pop(reward), 4) as std, round(min(reward), 4) as min, round(max(reward), 4) as max from fx_rm group by all")
def rm_stats(spark, base):
    return rounded(tr.reward_stats(src.rewards(spark, base)), 4)


@query(r"""with t as (select conv_id, turn, case when role = 'system' then 'be brief' else '' end as sys, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as body, regexp_replace(coalesce(role, ''), '^\s+|\s+$', '', 'g') as q from conversations)
select conv_id, turn, case when sys <> '' then 'System: ' || sys || chr(10) else '' end || 'Human: ' || q || chr(10) || 'Assistant: ' || body as scoring_text from t""")
def rm_scoring_text(spark, base):
    c = src.read_table(spark, base, "conversations")
    return c.select("conv_id", "turn", text.scoring_text("question_completion", F.when(F.col("role") == "system", "be brief").otherwise(""), "role", F.lit(""), "text").alias("scoring_text"))


PU_RM = f"""{FX_PU}, {TRACE_METRICS}, {FX_RM}, {RM_WIDE},
ok as (select distinct dataset, teacher_model as model, trace_index, teacher_score > 0.5 as trace_correct from fx_pu),
j as (select pt.*, w.rm_mean, coalesce(ok.trace_correct, false) as trace_correct from pt join w using (dataset, model, trace_index) left join ok using (dataset, model, trace_index)),
long as (select dataset, rm_mean, trace_correct, unnest(['avg_correct', 'linearity_mse', 'regression_rate']) as metric, unnest([avg_correct, linearity_mse, regression_rate]) as value from j),
both_ as (select 'overall' as dataset, rm_mean, trace_correct, metric, value from long union all select dataset, rm_mean, trace_correct, metric, value from long),
cond as (select 'unconditional' as condition, * from both_ union all select 'correct_only', * from both_ where trace_correct)"""


def _pu_rm(spark, base):
    records = src.pu_records(spark, base)
    ok = records.select("dataset", F.col("teacher_model").alias("model"), "trace_index", (F.col("teacher_score") > 0.5).alias("trace_correct")).distinct()
    return pu.trace_metrics_of_students(pu.trace_metrics(records)), tr.reward_pivot(src.rewards(spark, base), ["rm_a", "rm_b"]), ok


@query(f"with {PU_RM} select condition, dataset, metric, count(*) as n, round({pearson_sql('value', 'rm_mean')}, 6) + 0 as r from cond where value is not null and rm_mean is not null group by all having count(*) >= 3")
def pu_rm_correlation(spark, base):
    return tr.utility_reward_correlation(*_pu_rm(spark, base), ["avg_correct", "linearity_mse", "regression_rate"])


#: Two-sided p of r over n pairs by the finite series of Student's t for whole degrees of freedom.
STUDENT_P = """case when abs(r) >= 1 then 0.0e0 when (n - 2) % 2 = 0 then 1 - abs(r) * coalesce(list_sum(list_transform(range(0, cast((n - 2) // 2 as bigint)), lambda j: exp(lgamma(j + 0.5e0) - lgamma(0.5e0) - lgamma(j + 1.0e0)) * pow(1 - r * r, j))), 0)
  else 1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(0, cast((n - 2) // 2 as bigint)), lambda j: exp(lgamma(j + 1.0e0) + lgamma(1.5e0) - lgamma(j + 1.5e0)) * pow(sqrt(1 - r * r), 2 * j + 1))), 0)) end"""


def holm_sql(by: str, order: str, columns: str) -> str:
    """From m (…, n, r): p, and p adjusted within by."""
    return f"""p as (select *, greatest(0.0e0, {STUDENT_P}) as p from m where r is not null), h as (select *, p * (count(*) over (partition by {by}) - row_number() over (partition by {by} order by p, {order}) + 1) as raw from p)
select {columns}, n, round(r, 6) + 0 as r, round(p, 6) as p, round(least(1.0e0, max(raw) over (partition by {by} order by p, {order} rows between unbounded preceding and current row)), 6) as p_holm from h"""


@query(f"with {PU_RM}, m as (select condition, dataset, metric, count(*) as n, {pearson_sql('value', 'rm_mean')} as r from cond where value is not null and rm_mean is not null group by all having count(*) >= 3), {holm_sql('condition', 'dataset, metric', 'condition, dataset, metric')}")
def pu_rm_correlation_p(spark, base):
    r = tr.utility_reward_correlation(*_pu_rm(spark, base), ["avg_correct", "linearity_mse", "regression_rate"])
    return stats.holm(r.withColumn("p", stats.correlation_p("r", "n")).where("p is not null"), "p", ["condition"], ["dataset", "metric"])


METRICS = ["token_count", "sentence_count", "redundancy_score", "score"]


@query(f"with {FX_JOINED}, g as (select dataset, token_count * 1.0e0 as token_count, sentence_count * 1.0e0 as sentence_count, redundancy_score, score from fx_joined union all select 'all', token_count * 1.0e0, sentence_count * 1.0e0, redundancy_score, score from fx_joined) " + " union all ".join(f"select dataset, '{a}' as metric_x, '{b}' as metric_y, count(*) filter ({a} is not null and {b} is not null) as n, round({pearson_sql(a, b)}, 6) + 0 as r from g group by dataset" for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]))
def metric_correlation_long(spark, base):
    j = _measured(spark, base).select(F.explode(F.array("dataset", F.lit("all"))).alias("dataset"), *[F.col(m).cast("double").alias(m) for m in METRICS])
    return stats.correlation_pairs(j, ["dataset"], METRICS)


PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
PAIR = "condition, grp, metric_x, metric_y"


@query(f"""with {FX_JOINED}, g as (select 'unconditional' as condition, 'all' as grp, fx_joined.* from fx_joined union all select 'by_dataset', coalesce(dataset, 'none'), fx_joined.* from fx_joined union all select 'by_model', coalesce(model, 'none'), fx_joined.* from fx_joined),
c as (""" + " union all ".join(f"select condition, grp, '{a}' as metric_x, '{b}' as metric_y, cast({a} as double) as x, cast({b} as double) as y from g where {a} is not null and {b} is not null" for a, b in PAIRS) + f"""),
k as (select *, rank() over (partition by {PAIR} order by x) + (count(*) over (partition by {PAIR}, x) - 1) / 2.0e0 as rx, rank() over (partition by {PAIR} order by y) + (count(*) over (partition by {PAIR}, y) - 1) / 2.0e0 as ry from c),
m as (select {PAIR}, 'pearson' as method, count(*) as n, {pearson_sql('x', 'y')} as r from k group by all union all select {PAIR}, 'spearman', count(*), {pearson_sql('rx', 'ry')} from k group by all), {holm_sql('condition, grp, method', 'metric_x, metric_y', PAIR + ', method')}""")
def correlation_conditions(spark, base):
    """Pearson and Spearman of all pairs of metrics with their p-values, for all traces, by dataset and by model."""
    cell = lambda c, g: F.struct(F.lit(c).alias("condition"), g.alias("grp"))
    cells = F.array(cell("unconditional", F.lit("all")), cell("by_dataset", F.coalesce("dataset", F.lit("none"))), cell("by_model", F.coalesce("model", F.lit("none"))))
    j = _measured(spark, base).select(F.explode(cells).alias("c"), *[F.col(m).cast("double").alias(m) for m in METRICS]).select("c.*", *METRICS)
    return stats.correlation_rows(j, ["condition", "grp"], METRICS)


SERVED = {"eff_token_count": "token_count", "eff_sentence_count": "sentence_count", "red_redundancy_score": "redundancy_score", "trace_score": "score"}
CONDITIONS = """g as (select * replace (coalesce(dataset, 'none') as dataset, coalesce(model, 'none') as model) from fx_joined), f as (select 'unconditional' as condition, 'all' as grp, g.* from g union all select 'by_dataset', dataset, g.* from g union all select 'by_model', model, g.* from g union all select 'by_dataset_model', dataset || '::' || model, g.* from g),
hs as (select * from f union all select * replace (condition || '__correct_only' as condition) from f where score > 0.5 union all select * replace (condition || '__incorrect_only' as condition) from f where score <= 0.5)"""


def _all_conditions_sql(names: dict[str, str], columns: str) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in list(names)[i + 1 :]]
    return f"""with {FX_JOINED}, {CONDITIONS},
c as (""" + " union all ".join(f"select condition, grp, '{a}' as metric_x, '{b}' as metric_y, cast({names[a]} as double) as x, cast({names[b]} as double) as y from hs where {names[a]} is not null and {names[b]} is not null" for a, b in pairs) + f"""),
k as (select *, rank() over (partition by {PAIR} order by x) + (count(*) over (partition by {PAIR}, x) - 1) / 2.0e0 as rx, rank() over (partition by {PAIR} order by y) + (count(*) over (partition by {PAIR}, y) - 1) / 2.0e0 as ry from c),
m as (select {PAIR}, 'pearson' as method, count(*) as n, {pearson_sql('x', 'y')} as r from k group by all union all select {PAIR}, 'spearman', count(*), {pearson_sql('rx', 'ry')} from k group by all), {holm_sql('condition, grp, method', 'metric_x, metric_y', columns)}"""


def _by_condition(spark, base) -> DataFrame:
    wide = _measured(spark, base).select("dataset", "model", (F.col("score") > 0.5).alias("correct"), *[F.col(c).alias(n) for n, c in SERVED.items()])
    return stats.condition_correlations(wide, list(SERVED))


@query(_all_conditions_sql(SERVED, PAIR + ", method"))
def correlations_by_condition(spark, base):
    """Pearson and Spearman of all pairs for all twelve kinds of conditions, from one sum of co-moments."""
    return _by_condition(spark, base)


@query(f"""select condition, grp, method, metric_x, metric_y, n, r, p, p_holm, replace(replace(metric_x, 'eff_', 'EFF: '), 'red_r', 'RED: r') as label_x, replace(replace(metric_y, 'eff_', 'EFF: '), 'red_r', 'RED: r') as label_y
from ({_all_conditions_sql(SERVED, PAIR + ", method")}) where condition = 'by_dataset__correct_only' and grp = 'en'""")
def correlations_served(spark, base):
    """What one request for a dataset's correct traces gets, with labels."""
    return serving.served_correlations(_by_condition(spark, base), "en", "all", "correct_only", list(SERVED))


@query(f"with {FX_TRACES}, p as (select dataset, trace_index, (n_chars % 997 + 1) / 1000.0e0 as p from fx_traces), r as (select *, p * (count(*) over (partition by dataset) - row_number() over (partition by dataset order by p, trace_index) + 1) as raw from p) select dataset, trace_index, round(p, 6) as p, round(least(1.0e0, max(raw) over (partition by dataset order by p, trace_index rows between unbounded preceding and current row)), 6) as p_holm from r")
def holm_adjust(spark, base):
    p = src.traces(spark, base).select("dataset", "trace_index", ((F.col("n_chars") % 997 + 1) / 1000.0).alias("p"))
    return stats.holm(p, "p", ["dataset"], ["trace_index"])


@query(f"""with {FX_JOINED}, k as (select dataset, cast(token_count as double) as x, cast(sentence_count as double) as y from fx_joined where token_count is not null and sentence_count is not null),
r as (select dataset, rank() over (partition by dataset order by x) + (count(*) over (partition by dataset, x) - 1) / 2.0e0 as rx, rank() over (partition by dataset order by y) + (count(*) over (partition by dataset, y) - 1) / 2.0e0 as ry from k)
select dataset, count(*) as n, round({pearson_sql('rx', 'ry')}, 6) + 0 as rho from r group by all having count(*) >= 3""")
def spearman_by_group(spark, base):
    return stats.spearman(_measured(spark, base), ["dataset"], "token_count", "sentence_count")


@query(None)
def bootstrap_ci(spark, base):
    per, wide, _ = _pu_rm(spark, base)
    return stats.bootstrap_ci(per.join(wide.select(*S.KEY, "rm_mean"), list(S.KEY)), ["dataset"], "avg_correct", "rm_mean", ["model", "trace_index"])


@query(None)
def bootstrap_exact(spark, base):
    """Intervals from resamples that all have as many draws as there are pairs."""
    per, wide, _ = _pu_rm(spark, base)
    return stats.bootstrap_exact(per.join(wide.select(*S.KEY, "rm_mean"), list(S.KEY)), ["dataset"], "avg_correct", "rm_mean")


# --- text ------------------------------------------------------------------------------------
@query(f"""with {FX_TRACES}, s as (select trace_index, {SENTENCES} as n from fx_traces) select trace_index, cast(n as bigint) as n_sentences, cast(unnest(list_sort(list_distinct(list_append(range(0, greatest(n - 1, 0) + 1, 3), greatest(n - 1, 0))))) as bigint) as num_steps from s""")
def prefix_sample_points(spark, base):
    t = src.traces(spark, base).select("trace_index", text.count_sentences("trace_text").alias("n_sentences"))
    return t.select("trace_index", "n_sentences", F.explode(text.prefix_points("n_sentences", 3)).alias("num_steps"))


@query(r"""with t as (select doc_id as trace_index, text, doc_id % 9 as j, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') as s, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') as p from documents)
select trace_index, case when j > 0 and j < len(s) then array_to_string(s[1:j], ' ') when j > 0 and j < len(p) then array_to_string(p[1:j], chr(10) || chr(10)) else text end as partial from t""")
def partial_trace(spark, base):
    return src.traces(spark, base).select("trace_index", text.partial_trace("trace_text", F.col("trace_index") % 9).alias("partial"))


@query(r"""with c as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]+') as w from conversations),
g as (select conv_id, turn, [w[1:4], w[5:8], w[9:12]] as p, [list_reverse(w[1:4]), w[6:9], list_sort(w[9:12])] as t from c)
select conv_id, turn, cast(len(list_filter(p, lambda x: list_contains(list_transform(t, lambda y: list_sort(list_distinct(y))), list_sort(list_distinct(x))))) as integer) as grade from g""")
def grade_connections(spark, base):
    """Groups of a turn's words against groups of the same words in another order, or shifted by one."""
    c = src.read_table(spark, base, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-zà-ÿ]+"), F.lit(0)).alias("w"))
    part = lambda a: F.slice("w", a, 4)
    said = lambda *x: F.from_json(F.to_json(F.map_from_arrays(F.array(*[F.lit(f"g{i}") for i in range(3)]), F.array(*x))), "map<string,array<string>>")
    return c.select("conv_id", "turn", grading.grade_connections(said(part(1), part(5), part(9)), said(F.reverse(part(1)), part(6), F.array_sort(part(9)))).alias("grade"))


@query(r"""with c as (select conv_id, turn, role, coalesce(text, '') as t, (conv_id + turn) % 4 as k from conversations),
j as (select *, case when k = 3 then '{}' else json_object('backtracking_detected', turn % 2 = 0, 'final_answer', role, 'confidence', turn * 0.4e0 - 0.2e0, 'overall_reasoning', t,
  'backtracking_steps', case turn % 3 when 0 then json_array('junk', json_object('step_number', cast(turn as varchar), 'reasoning', t)) when 1 then json_array(json_object('original_claim', ' ' || role, 'correction_made', 'b'), json_object('step_number', turn, 'reason', 'r')) else json('7') end) end as j from c),
s as (select *, list_filter(from_json(case when json_type(j, '$.backtracking_steps') = 'ARRAY' then json_extract(j, '$.backtracking_steps') else json('[]') end, '["JSON"]'), lambda x: json_type(x) = 'OBJECT') as steps from j)
select conv_id, turn, coalesce(json_extract_string(j, '$.backtracking_detected') = 'true', false) as detected, coalesce(json_extract_string(j, '$.final_answer'), '') as final_answer, greatest(0, least(1, coalesce(cast(json_extract_string(j, '$.confidence') as double), 0))) as confidence,
  md5(coalesce(json_extract_string(j, '$.overall_reasoning'), '')) as reasoning_md5, cast(len(steps) as integer) as n_steps, case when len(steps) > 0 then coalesce(try_cast(json_extract_string(steps[1], '$.step_number') as integer), 0) end as first_step,
  md5(case when len(steps) > 0 then coalesce(json_extract_string(steps[1], '$.reason'), json_extract_string(steps[1], '$.reasoning'), 'original_claim: ' || trim(json_extract_string(steps[1], '$.original_claim')) || '; correction_made: ' || json_extract_string(steps[1], '$.correction_made')) end) as first_reason_md5 from s""")
def normalize_bt_json(spark, base):
    """Verdicts out of replies that hold them in a fenced block, in a bare fence, among words, or not at all."""
    c = src.read_table(spark, base, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"), ((F.col("conv_id") + F.col("turn")) % 4).alias("k"))
    turn = F.col("turn")
    one = F.to_json(F.struct(turn.cast("string").alias("step_number"), F.col("t").alias("reasoning")))
    two = F.concat(F.to_json(F.struct(F.concat(F.lit(" "), "role").alias("original_claim"), F.lit("b").alias("correction_made"))), F.lit(","), F.to_json(F.struct(turn.alias("step_number"), F.lit("r").alias("reason"))))
    steps = F.when(turn % 3 == 0, F.concat(F.lit('["junk",'), one, F.lit("]"))).when(turn % 3 == 1, F.concat(F.lit("["), two, F.lit("]"))).otherwise("7")
    head = F.to_json(F.struct((turn % 2 == 0).alias("backtracking_detected"), F.col("role").alias("final_answer"), (turn * 0.4 - 0.2).alias("confidence"), F.col("t").alias("overall_reasoning")))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"backtracking_steps":'), steps, F.lit("}"))
    fence = lambda name: F.concat(F.lit(f"```{name}\n"), body, F.lit("\n```"))
    reply = F.when(F.col("k") == 0, F.concat("t", F.lit("\n"), fence("json"), F.lit("\nso much for that"))).when(F.col("k") == 1, fence("")).when(F.col("k") == 2, F.concat(F.lit("well "), body, F.lit(" ok"))).otherwise(F.col("t"))
    v = c.select("conv_id", "turn", jsonparse.verdict(reply).alias("v"))
    first = F.try_element_at("v.backtracking_steps", F.lit(1))
    return v.select("conv_id", "turn", F.col("v.backtracking_detected").alias("detected"), "v.final_answer", "v.confidence", F.md5("v.overall_reasoning").alias("reasoning_md5"), F.size("v.backtracking_steps").alias("n_steps"), first["step_number"].alias("first_step"), F.md5(first["reason"]).alias("first_reason_md5"))


@query(r"""with c as (select conv_id, turn, regexp_replace(coalesce(text, '') || ' {' || role || ',' || turn || ', ' || conv_id || '}' || case when turn % 2 = 0 then chr(10) || 'then {{' || turn || ',x}}' else '' end, '^\s+|\s+$', '', 'g') as t from conversations)
select conv_id, turn, array_to_string(list_transform(regexp_extract_all(t, '\{.*,.*\}'), lambda m: '\begin{pmatrix}' || replace(regexp_replace(m, '^[{}]+|[{}]+$', '', 'g'), ',', '\') || '\end{pmatrix}'), ', ') as matrix from c""")
def vector_matrices(spark, base):
    """Braced lists in whole turns as column matrices."""
    c = src.read_table(spark, base, "conversations")
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" {"), "role", F.lit(","), "turn", F.lit(", "), "conv_id", F.lit("}"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nthen {{"), "turn", F.lit(",x}}"))).otherwise(""))
    return c.select("conv_id", "turn", text.vector_matrix(t).alias("matrix"))


# --- serving ---------------------------------------------------------------------------------
@query(f"""with {FX_PU}, {CURVE_PARTS}, lead_ as (select dataset, model, cast(sum(n) as bigint) as total_count, avg(y) as mean_accuracy from parts group by all), reg as ({REGRESSION_SQL}),
r as (select dataset, teacher_model as model, cast(sum(regressed_questions) as bigint) as regressed_questions, avg(regression_percentage) as regression_percentage from reg group by all)
select l.dataset, l.model, l.total_count, round(l.mean_accuracy, 4) as mean_accuracy, r.regressed_questions, round(r.regression_percentage, 4) as regression_percentage from lead_ l left join r using (dataset, model)""")
def pu_leaderboard_rows(spark, base):
    reg = pu.leaderboard_regressions(pu.regressions(src.pu_records(spark, base))).select("dataset", "model", "regressed_questions", "regression_percentage")
    lead = curves.leaderboard(_curve(spark, base)).select("dataset", "model", "total_count", "mean_accuracy")
    return rounded(serving.with_optional(lead, reg, ["dataset", "model"]), 4)


@query(f"with {FX_PU}, {BINS} select dataset, teacher_model, student_model, bin_center, round(mean_correct, 6) as mean_correct, round(std_correct, 6) as std_correct, n as count from bins where contains(translate(lower(teacher_model), '/ -.:', '_____'), 't1')")
def pu_bins_of_teacher(spark, base):
    return pu.percentage_bins(src.pu_records(spark, base)).where(text.same_teacher("teacher_model", "T1"))


@query(f"with {FX_TRACES} select dataset, model, round(avg(coalesce(score, 0)), 6) as average_score, round(avg(case when score = 1 or contains(trace_text, cast(trace_index % 10 as varchar)) then 1.0e0 else 0.0e0 end), 6) as average_boosted from fx_traces group by all")
def boosted_scores(spark, base):
    return serving.boosted(src.traces(spark, base).withColumn("answer", (F.col("trace_index") % 10).cast("string")))


@query(f"with {FX_BT} select dataset, count(*) as total, count(error) as errors, round(100.0e0 * count(error) / count(*), 6) as error_percentage from fx_bt group by all")
def grading_summary(spark, base):
    return serving.error_summary(src.backtracking(spark, base))


@query(f"with {FX_JOINED} select dataset, count(*) as traces, round(avg(score), 6) as accuracy, round(avg(token_count), 6) as mean_tokens, round(median(token_count), 6) as median_tokens, round(avg(redundancy_score), 6) as mean_redundancy, round(median(redundancy_score), 6) as median_redundancy from fx_joined group by all")
def index_summary(spark, base):
    return serving.index_summary(_measured(spark, base))


@query(f"with {BT}, {BT_TABLE}, v as (select *, printf('%.2f', round(mean_steps, 2)) as t from tab) select dataset, model, model || ' & ' || case when is_max then '\\textbf{{' || t || '}}' when is_min then '\\underline{{' || t || '}}' else t end as row from v")
def bt_latex_rows(spark, base):
    tab = bt.table(src.backtracking(spark, base), src.traces(spark, base))
    return bt.latex_rows(tab.withColumn("mean_steps", F.round("mean_steps", 2)))


@query(f"with {FX_JOINED} " + " union all ".join(f"select dataset, '{a}' as metric_x, " + ", ".join(f"1.0e0 as {b}" if a == b else f"round({pearson_sql(*(f'cast({c} as double)' for c in sorted((a, b), key=METRICS.index)))}, 6) + 0 as {b}" for b in METRICS) + " from fx_joined group by dataset" for a in METRICS))
def correlation_matrix(spark, base):
    j = _measured(spark, base).select("dataset", *[F.col(m).cast("double").alias(m) for m in METRICS])
    return serving.square(stats.correlation_pairs(j, ["dataset"], METRICS), ["dataset"], METRICS)


# --- store -----------------------------------------------------------------------------------
@query(f"with {FX_PU} select dataset, teacher_model, count(*) as n, round(avg(score), 6) as mean_score, round(stddev_pop(score), 6) as std_score from fx_pu group by all")
def shard_union_stats(spark, base):
    """Statistics recomputed on the union of four interleaved shards."""
    rec = src.pu_records(spark, base).withColumn("run", F.lit("r1"))
    whole = store.checked_union([store.shard(rec, "trace_index", 4, k) for k in range(4)], ["run"])
    return whole.groupBy("dataset", "teacher_model").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


@query(f"""with {FX_TRACES} select dataset, model, trace_index, case when trace_index % 5 = 0 then score + 1 else score end as score, case when trace_index % 5 = 0 then 2 else 1 end as load_seq from fx_traces
union all select dataset, model, trace_index + 1000000, score, 3 from fx_traces where trace_index % 10 = 0""")
def upsert_latest(spark, base):
    """A load that replaces one row in five, then one that adds only keys that are new."""
    one = src.traces(spark, base).select(*S.KEY, "score", F.lit(1).alias("load_seq"))
    two = one.where("trace_index % 5 = 0").select(*S.KEY, (F.col("score") + 1).alias("score"), F.lit(2).alias("load_seq"))
    kept = store.upsert(one, two, list(S.KEY))
    more = one.where("trace_index % 10 = 0").select("dataset", "model", (F.col("trace_index") + 1_000_000).alias("trace_index"), "score", F.lit(3).alias("load_seq"))
    return kept.unionByName(store.only_new(more.unionByName(one.withColumn("load_seq", F.lit(3))), kept, list(S.KEY)))


@query("select distinct lang as dataset, source as model from documents")
def datasets_and_models(spark, base):
    return src.traces(spark, base).select("dataset", "model").distinct()


@query(f"with {FX_PU} select distinct dataset, student_model from fx_pu")
def pu_students(spark, base):
    return src.pu_records(spark, base).select("dataset", "student_model").distinct()


@query(f"with {FX_JOINED} select dataset, model, cast(grouping_id(dataset, model) as integer) as level, count(*) as n, round(avg(score), 6) as accuracy, round(avg(token_count), 6) as mean_tokens from fx_joined group by grouping sets ((), (dataset), (model), (dataset, model))")
def condition_families(spark, base):
    """Summaries of the four families of conditions in one pass."""
    return _measured(spark, base).groupingSets([[], ["dataset"], ["model"], ["dataset", "model"]], "dataset", "model").agg(F.grouping_id("dataset", "model").cast("int").alias("level"), F.count("*").alias("n"), F.avg("score").alias("accuracy"), F.avg("token_count").alias("mean_tokens"))


from tracemill.plans import more  # noqa: E402,F401  (registers its queries, with the helpers of this module)
from tracemill.plans import sentences  # noqa: E402,F401
