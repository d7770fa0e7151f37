"""Named queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions import text as tx
from gradus.operators import benchmarks, classify, evidence, jobs, paired, population, providers, ranking, regression, retrieval, sampling, thresholds, transitions, validate
from gradus.operators.order import numbered
from gradus.plans import views as v
from gradus.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, n: int = 9) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, n) for f in df.schema.fields if f.dataType.simpleString() == "double"})


def _truth(spark, d) -> DataFrame:
    return ranking.qrel_grades(v.topics(spark, d), v.qrels(spark, d))


def _scored(spark, d, which: str, ks) -> DataFrame:
    ranked = v.rank_a(spark, d) if which == "a" else v.rank_b(spark, d)
    return ranking.per_query(_truth(spark, d), retrieval.rankings(ranked), ks)


# ---- retrieval -------------------------------------------------------------------------------------------------


@query(f"with {v.RANK_A} select query_id, document_id, rank, round(score, 9) as score from rank_a")
def bm25_topk(spark, d):
    return _round(v.rank_a(spark, d).select("query_id", "document_id", F.col("rank").cast("long").alias("rank"), "score"))


@query(f"with {v.RANK_A} select token, count(*) as df, sum(tf)::bigint as cf, max(tf) as max_tf from post group by token")
def bm25_postings_stats(spark, d):
    return retrieval.token_statistics(v.corpus(spark, d))


@query(f"with {v.RANK_A} select n_docs, round(avg_length, 9) as avg_length from stats")
def bm25_corpus_stats(spark, d):
    return _round(retrieval.corpus_statistics(retrieval.tokenized(v.corpus(spark, d))))


@query(f"with {v.RANK_A}, {v.RANK_B} select query_id, document_id, rank, score from rank_b")
def shared_token_topk(spark, d):
    return v.rank_b(spark, d).select("query_id", "document_id", F.col("rank").cast("long").alias("rank"), "score")


@query(f"with {v.TOPICS}, {v.CORPUS}, {v.QRELS} select * from qrels")
def containment_qrels(spark, d):
    return v.qrels(spark, d).distinct()


def _per_query_sql(which: str) -> str:
    return f"""{v.RANK_A}, {v.RANK_B}, {v.QRELS},
rel as (select query_id, count(*) as n_rel from qrels group by 1),
hits as (select r.query_id, r.rank from rank_{which} r join qrels using (query_id, document_id)),
ks(k) as (values (1), (5), (10)),
per as (select t.query_id, ks.k, coalesce(max(n_rel), 0) as n_rel, count(h.rank) filter (h.rank <= ks.k) as n, min(h.rank) as first,
  coalesce(sum(1 / log2(h.rank + 1)) filter (h.rank <= ks.k), 0) as dcg from topics t cross join ks left join rel using (query_id) left join hits h on h.query_id = t.query_id group by all),
scored as (select query_id, k, case when n_rel = 0 then 'SHOULD_ABSTAIN' when n > 0 then 'PASS' else 'RETRIEVAL_MISS' end as category, n / k as precision,
  case when n_rel > 0 then n / n_rel else 0 end as recall, case when n > 0 then 1.0 else 0.0 end::double as hit_rate, coalesce(1 / first, 0) as mrr,
  case when n_rel > 0 then dcg / (select sum(1 / log2(i + 1)) from range(1, 1 + least(n_rel, k)) x(i)) else 0 end as ndcg from per)"""


_M = ", ".join(f"round({m}, 9) as {m}" for m in ranking.METRICS)
_AVG = ", ".join(f"round(avg({m}), 9) as {m}" for m in ranking.METRICS)


@query(f"with {_per_query_sql('a')} select query_id, k, category, {_M} from scored")
def retrieval_per_query_metrics(spark, d):
    return _round(_scored(spark, d, "a", (1, 5, 10)))


@query(f"with {_per_query_sql('a')} select k, count(*) as queries, {_AVG} from scored group by k")
def retrieval_macro_metrics_by_k(spark, d):
    return _round(ranking.macro(_scored(spark, d, "a", (1, 5, 10))))


@query(f"with {_per_query_sql('b')} select k, count(*) as queries, {_AVG} from scored group by k")
def retrieval_macro_metrics_by_k_b(spark, d):
    return _round(ranking.macro(_scored(spark, d, "b", (1, 5, 10))))


@query(f"""with {_per_query_sql('a')} select k, count(*) filter (category = 'PASS') as "PASS", count(*) filter (category = 'RETRIEVAL_MISS') as "RETRIEVAL_MISS",
count(*) filter (category = 'SHOULD_ABSTAIN') as "SHOULD_ABSTAIN" from scored group by k""")
def retrieval_failure_counts(spark, d):
    return ranking.failure_counts(_scored(spark, d, "a", (1, 5, 10)))


@query(f"""with {v.RANK_A}, {v.QRELS}, t as (select distinct query_id from qrels), p as (select distinct query_id from rank_a),
n as (select count(*) filter (t.query_id is not null and p.query_id is not null) as matching, count(*) filter (p.query_id is null) as missing, count(*) filter (t.query_id is null) as extra
  from t full join p using (query_id))
select *, concat_ws(',', case when missing > 0 then 'MISSING_PREDICTIONS' end, case when extra > 0 then 'EXTRA_PREDICTIONS' end) as warnings from n""")
def retrieval_pair_validation(spark, d):
    return ranking.pair_validation(v.qrels(spark, d).select("query_id").distinct(), v.rank_a(spark, d).select("query_id").distinct())


@query(f"with {v.RANK_A}, {v.RANK_B} select query_id, rank, concat_ws(' ', query_id, 'Q0', document_id, rank, score::bigint, 'shared') as line from rank_b")
def trec_run_lines(spark, d):
    return ranking.trec_lines(v.rank_b(spark, d), "shared").withColumn("rank", F.col("rank").cast("long"))


@query("select (select count(*) from benchmark) as query_count, (select count(*) from documents) as corpus_count, (select count(*) from benchmark t join documents c on contains(c.text, t.text)) as qrel_count")
def benchmark_counts(spark, d):
    return benchmarks.counts(v.topics(spark, d), v.qrels(spark, d), v.corpus(spark, d))


@query(f"with {v.TOPICS}, {v.CORPUS}, {v.QRELS}, c as (select count(*) as n, count(distinct query_id) as q from qrels) select 'UNKNOWN_QUERY_ID' as code, query_id as message, query_id as record_id from qrels where query_id in (select query_id from topics where length(text) < 150) "
       "union all select 'UNKNOWN_CORPUS_DOCUMENT_ID', document_id, query_id from qrels join documents on doc_id = cast(document_id as bigint) where lang = 'de'")
def qrel_issues(spark, d):
    other = v.table(spark, d, "documents").where("lang <> 'de'").select(F.col("doc_id").cast("string").alias("document_id"))
    return validate.qrels(v.topics(spark, d).where("length(text) >= 150"), v.qrels(spark, d), other, "text")


# ---- regression, transitions, compatibility --------------------------------------------------------------------

_POLICY = [("precision_at_5", "higher_is_better", 0.01, None, 0.0), ("recall_at_5", "higher_is_better", None, None, 0.05), ("hit_rate_at_5", "higher_is_better", None, None, 0.0), ("mrr", "higher_is_better", 0.9, None, 0.1), ("ndcg_at_5", "higher_is_better", None, None, 0.02), ("map_at_5", "higher_is_better", None, None, 0.0)]


def _both_metrics(spark, d):
    return (ranking.long_metrics(_scored(spark, d, w, (5,)), 5) for w in ("b", "a"))


def _two(sql_of=_per_query_sql) -> str:
    a = sql_of("a")
    b = a[a.index("hits as (") :].replace("hits", "hits_b").replace("rank_a", "rank_b").replace("per as", "per_b as").replace("from per)", "from per_b)").replace("scored as", "scored_b as").replace("ks(k) as (values (1), (5), (10)),\n", "")
    return f"{a}, {b}"


_LONG = "unnest([{{m: 'precision_at_5', x: avg(precision)}}, {{m: 'recall_at_5', x: avg(recall)}}, {{m: 'hit_rate_at_5', x: avg(hit_rate)}}, {{m: 'mrr', x: avg(mrr)}}, {{m: 'ndcg_at_5', x: avg(ndcg)}}]) as u from {} where k = 5"


@query(f"""with {_two()}, base as (select u.m as metric, u.x as baseline from (select {_LONG.format('scored')})), cur as (select u.m as metric, u.x as current from (select {_LONG.format('scored_b')})),
rules(metric, low, allowed) as (values ('precision_at_5', 0.01, 0.0), ('recall_at_5', null, 0.05), ('hit_rate_at_5', null, 0.0), ('mrr', 0.9, 0.1), ('ndcg_at_5', null, 0.02), ('map_at_5', null, 0.0)),
j as (select metric, current, baseline, low, allowed::double as allowed from rules left join cur using (metric) left join base using (metric)),
r as (select *, case when current is null then 'MISSING_CURRENT' when current < low then 'BELOW_MINIMUM' when baseline is null then 'MISSING_BASELINE' when current < baseline - allowed then 'DEGRADED' else 'OK' end as reason from j)
select metric, round(current, 9) as current, round(baseline, 9) as baseline, round(baseline - current, 9) as degradation, reason,
case when reason = 'OK' then 'PASS' when starts_with(reason, 'MISSING') then 'MISSING' else 'REGRESSION' end as status from r""")
def regression_report(spark, d):
    current, baseline = _both_metrics(spark, d)
    return _round(regression.compare(current, baseline, regression.rules_frame(spark, _POLICY)))


@query(ORACLE_SQL["regression_report"].replace("select metric, round(current, 9)", ", fin as (select metric, round(current, 9)", 1).replace("as status from r", "as status from r) select coalesce(bool_and(status = 'PASS'), false) as passed, count(*) filter (status = 'REGRESSION') as regressions, count(*) filter (status = 'MISSING') as missing from fin"))
def regression_verdict(spark, d):
    return regression.verdict(regression_report(spark, d))


_TRANSITION = "select query_id, x.category as baseline_category, y.category as candidate_category, case when x.category = 'PASS' and y.category = 'PASS' then '{0}' when x.category = 'PASS' then '{1}' when y.category = 'PASS' then '{2}' when x.category = y.category then '{3}' else '{4}' end as transition from scored x join scored_b y using (query_id, k) where k = 5"


def _categories(spark, d):
    return (_scored(spark, d, w, (5,)).select("query_id", "category") for w in ("a", "b"))


@query(f"with {_two()} " + _TRANSITION.format("UNCHANGED_PASS", "REGRESSED", "IMPROVED", "PERSISTENT_FAILURE", "CHANGED_FAILURE"))
def failure_transitions(spark, d):
    return transitions.workspace_transitions(*_categories(spark, d))


@query(f"with {_two()} " + _TRANSITION.format("STABLE_PASS", "INTRODUCED_FAILURE", "RESOLVED_FAILURE", "PERSISTENT_CATEGORY", "CHANGED_FAILURE_CATEGORY"))
def console_transitions(spark, d):
    return transitions.console_transitions(*_categories(spark, d))


@query(f"with {_two()}, t as (" + _TRANSITION.format("UNCHANGED_PASS", "REGRESSED", "IMPROVED", "PERSISTENT_FAILURE", "CHANGED_FAILURE") + ") select * from t where candidate_category = 'PASS' and (baseline_category = 'PASS' or candidate_category = 'PASS') and contains(query_id, '1')")
def transition_filter(spark, d):
    return transitions.filter_transitions(transitions.workspace_transitions(*_categories(spark, d)), category="PASS", candidate_category="PASS", contains="1")


def _long_per_query(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("value")) for m in ranking.METRICS])))


_UNPIVOT = ", ".join("{{m: '%s', x: round(%s, 9)}}" % (m, m) for m in ranking.METRICS)


@query(f"with {_two()}, x as (select query_id, u.m as metric, u.x as baseline from (select query_id, unnest([{_UNPIVOT.format()}]) as u from scored where k = 5)), y as (select query_id, u.m as metric, u.x as candidate from (select query_id, unnest([{_UNPIVOT.format()}]) as u from scored_b where k = 5)) select query_id, metric, baseline, candidate, round(candidate - baseline, 9) as delta from x full join y using (query_id, metric) where baseline is distinct from candidate")
def transition_metric_deltas(spark, d):
    a, b = (_long_per_query(_scored(spark, d, w, (5,))) for w in ("a", "b"))
    return _round(transitions.metric_deltas(a, b))


def _pairs(spark, d) -> DataFrame:
    return v.comparisons(spark, d).select(F.col("artifact_id").alias("comparison_id"), "baseline_id", "candidate_id")


_CONFIG = ("annotation_policy", "benchmark", "dataset_name", "dataset_revision", "dataset_version", "evaluator_config", "evaluator_versions", "language", "quality_filter", "split")
_VEILED = "case when {test} then {{{{f: '{name}', b: case when {x} then 'missing' else 'present' end, c: case when {y} then 'missing' else 'different' end}}}} end"


def _compat_sql() -> str:
    differ = lambda f, name=None: _VEILED.format(test=f"a.{f} is distinct from b.{f}", name=name or f, x=f"a.{f} is null", y=f"b.{f} is null")
    seen = "a.truth_fingerprint is not null and b.truth_fingerprint is not null and "
    rows = [differ("schema_version", "run_schema_version"), differ("workspace_id"), differ("evaluation_type"), *map(differ, _CONFIG)]
    rows.append("case when a.top_k <> b.top_k then {{f: 'top_k', b: cast(a.top_k as varchar), c: cast(b.top_k as varchar)}} end")
    rows.append(_VEILED.format(test="a.evaluation_type <> 'retrieval' or b.evaluation_type <> 'retrieval'", name="retrieval_only", x="false", y="false"))
    rows.append(_VEILED.format(test="a.truth_fingerprint is null or b.truth_fingerprint is null", name="verified_population", x="a.truth_fingerprint is null", y="b.truth_fingerprint is null"))
    rows += [_VEILED.format(test=f"{seen} a.{f} <> b.{f}", name=n, x="false", y="false") for f, n in (("truth_fingerprint", "ground_truth_population"), ("query_fingerprint", "query_population"))]
    for side, name in (("a", "baseline"), ("b", "candidate")):
        for test, what in ((f"not {side}.identity_valid", "result_identity"), (f"{seen} {side}.prediction_fingerprint <> {side}.query_fingerprint", "prediction_coverage"), (f"{seen} {side}.reported_count <> {side}.prediction_count", "prediction_count")):
            rows.append(_VEILED.format(test=test, name=f"{name}_{what}", x="true", y="false"))
    listed = ", ".join(rows).replace("{{", "{").replace("}}", "}")
    return f"""with {v.RUNS},
loc as (select artifact_id as run_id, 'workspace-run-v1' as schema_version, case when k % 14 = 2 then 'ws-2' else 'ws-1' end as workspace_id, evaluation_type, case when k % 3 = 0 then 'strict-groundedness' end as annotation_policy, benchmark,
  dataset_name, dataset_revision, dataset_version, 'k1=1.2' as evaluator_config, evaluator_versions, language, 'good' as quality_filter, split, top_k, k % 13 <> 0 as identity_valid,
  case when k % 17 <> 0 then 't' || (k % 2) end as truth_fingerprint, case when k % 17 <> 0 then 'q' || (k % 2) end as query_fingerprint, case when k % 6 = 0 then 'other' else 'q' || (k % 2) end as prediction_fingerprint,
  40 as prediction_count, case when k % 8 = 0 then 39 else 40 end as reported_count from runs),
known as (select c.* from comparisons c where baseline_id in (select run_id from loc) and candidate_id in (select run_id from loc)),
reasons as (select comparison_id, u.f as field, u.b as baseline, u.c as candidate from (
  select c.artifact_id as comparison_id, unnest(list_filter([{listed}], lambda x: x is not null)) as u from known c join loc a on a.run_id = c.baseline_id join loc b on b.run_id = c.candidate_id))"""


def _known_pairs(spark, d) -> DataFrame:
    ids = v.runs(spark, d).select("artifact_id")
    pairs = _pairs(spark, d)
    for side in ("baseline_id", "candidate_id"):
        pairs = pairs.join(ids.withColumnRenamed("artifact_id", side), side, "left_semi")
    return pairs


@query(_compat_sql() + " select * from reasons")
def compat_reasons(spark, d):
    return population.compatibility(_known_pairs(spark, d), v.local_runs(spark, d))


@query(_compat_sql() + " select artifact_id as comparison_id, case when n is null then 'COMPARABLE' else 'NON_COMPARABLE' end as status, coalesce(n, 0) as reasons from known left join (select comparison_id, count(*) as n from reasons group by 1) r on r.comparison_id = known.artifact_id")
def compat_status(spark, d):
    return population.status(_known_pairs(spark, d), compat_reasons(spark, d))


_SAME = " and ".join(f"a.{f} is not distinct from b.{f}" for f in ("dataset_name", "dataset_version", "dataset_revision", "evaluation_type", "benchmark", "language", "split", "top_k", "evaluator_versions"))


@query(f"with {v.RUNS} select c.artifact_id as comparison_id, case when {_SAME} then 'MATCHED' else 'INCOMPATIBLE' end as population_compatibility from comparisons c join runs a on a.artifact_id = c.baseline_id join runs b on b.artifact_id = c.candidate_id")
def population_match(spark, d):
    return population.population_match(_known_pairs(spark, d), v.runs(spark, d))


_PARTS = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint)::hugeint as p{i}" for i in range(4))


@query(f"""with {v.TOPICS}, {v.CORPUS}, {v.QRELS}, h as (select sha256(to_json({{query_id: query_id, document_id: document_id}})::varchar) as h from qrels), t as (select count(*) as n_records, {_PARTS} from h)
select n_records, sha256(concat_ws(':', n_records, p0, p1, p2, p3)) as fingerprint from t""")
def population_fingerprint(spark, d):
    return population.fingerprint(v.qrels(spark, d).distinct(), ["query_id", "document_id"])


# ---- classification --------------------------------------------------------------------------------------------


@query(f"""with t as (select conv_id, turn, role, text, lead(role) over w as next_role, lead(text) over w as response from conversations window w as (partition by conv_id order by turn)),
p as (select conv_id || '-' || turn as example_id, {v.OVERLAP} as c, {v.OVERLAP.replace('(text,', '(response,')} as r from t where role = 'user' and next_role = 'assistant'),
s as (select example_id, case when len(r) = 0 then 1.0 when len(c) = 0 then 0.0 else len(list_intersect(r, c)) / len(r) end as support from p)
select example_id, round(support, 9) as support, round(1 - support, 9) as score, case when support >= 0.4 then 'GROUNDED' else 'HALLUCINATED' end as predicted from s""")
def heuristic_support(spark, d):
    rows = v.turns(spark, d)
    rows = rows.select("example_id", classify.overlap_support(tx.overlap_tokens(F.col("response")), tx.overlap_tokens(F.col("context"))).alias("support"))
    return _round(rows.withColumns(classify.from_support(F.col("support"), 0.4)))


@query(f"with {v.SCORED}, c as (select {v.CELLS} from scored) select total, tp, tn, fp, fn, {v.RATES} from c")
def confusion_overall(spark, d):
    return _round(classify.confusion(v.scored(spark, d)))


@query(f"""with {v.SCORED}, c as (select case when grouping(task_type) = 0 then 'task_type' when grouping(model) = 0 then 'model' else 'all' end as dimension, coalesce(task_type, model, 'all') as value, {v.CELLS}
from scored group by grouping sets ((), (task_type), (model))) select dimension, value, total, tp, tn, fp, fn, {v.RATES} from c""")
def confusion_slices(spark, d):
    return _round(classify.slices(v.scored(spark, d), ["task_type", "model"]))


@query(f"with {v.SCORED} select example_id, case when predicted = 'HALLUCINATED' then 'FALSE_POSITIVE' else 'FALSE_NEGATIVE' end as kind from scored where human <> predicted")
def fp_fn_ids(spark, d):
    return classify.errors(v.scored(spark, d))


@query(f"with {v.PREDICTIONS} select example_id, human, case when a and b then 'BOTH_CORRECT' when a then 'A_ONLY' when b then 'B_ONLY' else 'BOTH_WRONG' end as category from correct")
def paired_categories(spark, d):
    return paired.paired_categories(_correct(spark, d), "a", "b")


def _correct(spark, d) -> DataFrame:
    p = v.predictions(spark, d)
    return paired.correctness(p.select("example_id", "human").distinct(), p, ["a", "b", "c"])


@query(f"with {v.PREDICTIONS} select example_id, case when b then 'FIXED_' else 'NEW_' end || case when human = 'HALLUCINATED' then 'FALSE_NEGATIVE' else 'FALSE_POSITIVE' end as change from correct where a <> b")
def paired_changes(spark, d):
    return paired.changes(paired_categories(spark, d))


@query(f"""with {v.PREDICTIONS}, n as (select count(*) filter (a and not b) as b, count(*) filter (b and not a) as c from correct),
lf as (select i, coalesce(sum(ln(i)) filter (i > 0) over (order by i), 0) as lf from range(0, (select b + c + 1 from n)) r(i)),
p as (select least(1, sum(exp((select lf from lf where i = b + c) - x.lf - y.lf + ln(2) - (b + c) * ln(2)))) as p from n, lf x, lf y where x.i <= least(b, c) and y.i = b + c - x.i)
select b, c, round(case when b + c = 0 then 0 else pow(abs(b - c) - 1, 2) / (b + c) end, 9) as statistic, round(case when b + c = 0 then 1 else p end, 9) as p_value from n, p""")
def mcnemar_exact(spark, d):
    return _round(paired.mcnemar(paired.discordant(paired_categories(spark, d))))


_AGREE = """select example_id, unnest(list_filter([case when n = 3 then 'ALL_CORRECT' end, case when n = 0 then 'ALL_WRONG' end, case when n = 1 and a then 'A_ONLY' end, case when n = 1 and b then 'B_ONLY' end, case when n = 1 and c then 'C_ONLY' end,
case when a and b then 'A_AND_B' end, case when a and c then 'A_AND_C' end, case when b and c then 'B_AND_C' end], lambda x: x is not null)) as category from (select *, a::int + b::int + c::int as n from correct)"""


@query(f"with {v.PREDICTIONS} {_AGREE}")
def three_evaluator_categories(spark, d):
    return paired.agreement_three(_correct(spark, d), "a", "b", "c")


@query(f"with {v.PREDICTIONS} select example_id, case a::int + b::int + c::int when 3 then 'ALL_CORRECT' when 0 then 'ALL_WRONG' when 1 then case when a then 'A_ONLY' when b then 'B_ONLY' else 'C_ONLY' end else case when a and b then 'A_AND_B' when a then 'A_AND_C' else 'B_AND_C' end end as category from correct")
def multi_evaluator_categories(spark, d):
    return paired.agreement_many(_correct(spark, d), ["a", "b", "c"])


_SWEEP = f"with {v.EXAMPLES}, x as (select human, t as threshold, case when support_a < t then 'HALLUCINATED' else 'GROUNDED' end as predicted from examples, (values (0.1::double), (0.3::double), (0.5::double), (0.7::double), (0.9::double)) v(t)), c as (select threshold, {v.CELLS} from x group by threshold) select threshold, total, tp, tn, fp, fn, {v.RATES} from c"
_STEPS = (0.1, 0.3, 0.5, 0.7, 0.9)


def _supports(spark, d) -> DataFrame:
    return v.examples(spark, d).select("human", F.col("support_a").alias("support"))


@query(_SWEEP)
def threshold_sweep(spark, d):
    return _round(thresholds.sweep(_supports(spark, d), _STEPS))


@query(f"select * from ({_SWEEP}) order by f1 desc, threshold limit 1")
def threshold_select(spark, d):
    return _round(thresholds.select_threshold(_supports(spark, d), _STEPS, split="validation"))


_BINS = f"{v.SCORED}, p as (select score as p, (human = 'HALLUCINATED')::int::double as y from scored), b as (select least(9, greatest(0, floor(p * 10)))::int as bin, count(*) as n, avg(p) as mp, avg(y) as my from p group by 1)"


def _probability(spark, d):
    return v.scored(spark, d), F.col("score"), F.col("human") == classify.POSITIVE


@query(f"with {_BINS} select i::int as bin, coalesce(n, 0) as n, round(mp, 9) as mean_probability, round(my, 9) as mean_outcome, round(abs(mp - my), 9) as gap from range(0, 10) r(i) left join b on b.bin = i")
def calibration_bins(spark, d):
    return _round(classify.calibration_bins(*_probability(spark, d)))


@query(f"with {_BINS} select (select count(*) from p) as n, round((select avg(pow(p - y, 2)) from p), 9) as brier, round((select sum(n * abs(mp - my)) / sum(n) from b), 9) as ece")
def ece_brier(spark, d):
    return _round(classify.calibration(*_probability(spark, d)))


@query(f"""with {v.SCORED}, q as (select *, 'Q' || (1 + least(3, ((row_number() over (order by n_chars, example_id) - 1) * 4) // count(*) over ())) as quartile from scored),
c as (select quartile, min(n_chars) as min_length, max(n_chars) as max_length, {v.CELLS} from q group by quartile) select quartile, min_length, max_length, total, tp, tn, fp, fn, {v.RATES} from c""")
def length_quartile_slices(spark, d):
    rows = classify.length_quartiles(v.scored(spark, d), F.col("n_chars"))
    bounds = rows.groupBy("quartile").agg(F.min("n_chars").alias("min_length"), F.max("n_chars").alias("max_length"))
    return _round(classify.confusion(rows, ["quartile"]).join(bounds, "quartile"))


_ERRORS = f"{v.SCORED}, e as (select *, case when predicted = 'HALLUCINATED' then 'FALSE_POSITIVE' else 'FALSE_NEGATIVE' end as kind, case when predicted = 'HALLUCINATED' then score else 1 - score end as sure from scored where human <> predicted)"


@query(f"""with {_ERRORS} select case when grouping(task_type) = 0 then 'task_type' when grouping(model) = 0 then 'model' else 'all' end as dimension, coalesce(task_type, model, 'all') as value, kind, count(*) as n, round(avg(sure), 9) as mean_confidence
from e group by grouping sets ((kind), (task_type, kind), (model, kind))""")
def error_analysis(spark, d):
    return _round(classify.error_analysis(v.scored(spark, d), ["task_type", "model"]))


@query(f"with {_ERRORS} select example_id, human, predicted, round(sure, 9) as confidence from e where sure >= 0.8::double")
def high_confidence_errors(spark, d):
    return _round(classify.high_confidence_errors(v.scored(spark, d)))


@query("select count(*) as responses, count(distinct source) as sources, count(*) filter (toxic = 1) as hallucinated, count(*) filter (quality = 1) as good from documents join labels using (doc_id)")
def dataset_summary(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id")).join(v.table(spark, d, "labels"), "doc_id")
    rows = rows.select("source_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("quality"), F.when(F.col("toxic") == 1, "HALLUCINATED").otherwise("GROUNDED").alias("human"))
    return benchmarks.dataset_summary(rows)


@query("select case when quality = 1 then 'good' else 'poor' end as quality, quality <> 1 as excluded, count(*) as n from labels group by all")
def exclusion_reasons(spark, d):
    rows = v.table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("quality"))
    sides = benchmarks.quality_filter(rows).withColumn("excluded", F.lit(False)).unionByName(benchmarks.quality_filter(rows, ["poor"]).withColumn("excluded", F.lit(True)))
    return sides.groupBy("quality", "excluded").agg(F.count("*").alias("n"))


@query(f"""with {v.SCORED} select example_id, task_type, human, draw from (select *, row_number() over (partition by task_type, human order by md5('7:' || example_id), example_id) as draw from scored) where draw <= 20""")
def stratified_sample(spark, d):
    return sampling.stratified(v.scored(spark, d), ["task_type", "human"], 20, 7).select("example_id", "task_type", "human", F.col("draw").cast("long").alias("draw"))


@query(f"""with {v.SCORED} select example_id, task_type, human, draw from (select *, row_number() over (partition by task_type, human order by md5('11:' || example_id), example_id) as draw from scored) where draw <= 2""")
def consistency_subsample(spark, d):
    return sampling.stratified(v.scored(spark, d), ["task_type", "human"], 2, 11).select("example_id", "task_type", "human", F.col("draw").cast("long").alias("draw"))


@query()
def seeded_pilot_sample(spark, d):
    rows = v.scored(spark, d).withColumn("example_id", F.col("example_id").cast("string"))
    strata = [r[0] for r in rows.select(F.concat_ws(":", "task_type", "human")).distinct().orderBy(F.concat_ws(":", "task_type", "human")).collect()]  # task types by label
    return sampling.seeded(rows, F.concat_ws(":", "task_type", "human"), 20, 20260825, strata=strata)


@query()
def run_fingerprints(spark, d):
    """Each language's documents as a run: the words of its sources as relevant ids, its documents as queries."""
    rows = v.table(spark, d, "documents").select(F.col("lang").alias("run_id"), F.col("doc_id").cast("string").alias("query_id"), F.array("source", F.concat_ws("-", "source", "lang")).alias("relevant"))
    return population.run_fingerprints(rows, rows.where("doc_id % 3 > 0"))


@query(f"with {v.SCORED} select task_type || ':' || human as stratum, count(*) as n from scored group by all")
def stratum_counts(spark, d):
    return v.scored(spark, d).groupBy(F.concat_ws(":", "task_type", "human").alias("stratum")).agg(F.count("*").alias("n"))


@query()
def bootstrap_ci(spark, d):
    wide = v.predictions(spark, d).groupBy("example_id", "human").agg(F.max(F.when(F.col("evaluator") == "a", F.col("predicted"))).alias("a"), F.max(F.when(F.col("evaluator") == "b", F.col("predicted"))).alias("b"))
    return _round(sampling.bootstrap(wide))


@query(f"with {v.PREDICTIONS}, one as (select example_id from predictions where evaluator = 'a' and example_id % 10 <> 0), two as (select example_id from predictions where evaluator = 'a' and example_id % 7 <> 0) select case when two.example_id is null then 'MISSING_PREDICTION' else 'UNKNOWN_EXAMPLE' end as code, example_id from one full join two using (example_id) where one.example_id is null or two.example_id is null")
def population_guard(spark, d):
    rows = v.predictions(spark, d).where("evaluator = 'a'").select("example_id")
    return classify.guard_populations(rows.where("example_id % 10 <> 0"), rows.where("example_id % 7 <> 0"))


def _examples(spark, d) -> DataFrame:
    rows = v.examples(spark, d)
    return rows.withColumn("quality", F.when(F.col("quality") == 1, "good").otherwise("poor"))


_GOOD = f"{v.SCORED}, {v.TOPICS}, {v.CORPUS}, good as (select * from scored where quality = 1)"


@query(f"""with {v.SCORED} select 'total' as part, 'all' as reason, count(*) as n from scored union all select 'included', 'all', count(*) from scored where quality = 1 union all select 'excluded', 'all', count(*) from scored where quality <> 1
union all select 'exclusion', 'quality:poor', count(*) from scored where quality <> 1""")
def groundedness_counts(spark, d):
    parts = _groundedness(spark, d)
    n = parts["counts"].select(F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.lit("all").alias("reason"), F.col(c).alias("n")) for c in ("total", "included", "excluded")])))
    return n.unionByName(parts["exclusion_reasons"].select(F.lit("exclusion").alias("part"), "reason", "n"))


def _groundedness(spark, d) -> dict[str, DataFrame]:
    predictions = v.scored(spark, d).where("quality = 1").select("example_id", "predicted", "score")
    found = span_issues(spark, d).select("code", F.col("document_id").alias("record_id"))
    return benchmarks.groundedness_benchmark(_examples(spark, d), predictions, found)


@query(f"""with {_GOOD}, c as (select case when grouping(task_type) = 0 then 'task_type' when grouping(model) = 0 then 'model' else 'all' end as dimension, coalesce(task_type, model, 'all') as value, {v.CELLS}
from good group by grouping sets ((), (task_type), (model))) select dimension, value, total, tp, tn, fp, fn, {v.RATES} from c""")
def groundedness_slices(spark, d):
    return _round(_groundedness(spark, d)["slices"])


@query(f"""with {_GOOD}, s as (select document_id, query_id, strpos(c.text, t.text) - 1 as start, c.text, t.text as quoted from corpus c join topics t on contains(c.text, t.text)), sp as (select *, start + length(quoted) + cast(query_id as int) % 3 as "end" from s),
i as (select document_id, unnest(list_filter([case when "end" > length(text) then 'END_OUT_OF_RANGE' end, case when "end" <= length(text) and substr(text, start + 1, "end" - start) <> quoted then 'TEXT_OFFSET_MISMATCH' end], lambda x: x is not null)) as code from sp)
select case when predicted = 'HALLUCINATED' then 1 else 2 end as section, case when predicted = 'HALLUCINATED' then 'HALLUCINATION_FALSE_POSITIVE' else 'HALLUCINATION_FALSE_NEGATIVE' end as category, 'EVALUATOR_UNCERTAINTY' as failure_class,
cast(example_id as varchar) as record_id, null::varchar as code from good where human <> predicted union all select 3, 'DATASET_AMBIGUOUS', 'DATASET', document_id, code from i""")
def groundedness_failures(spark, d):
    return _groundedness(spark, d)["failures"]


def _full(spark, d) -> dict[str, DataFrame]:
    rows = v.scored(spark, d)
    lengths = rows.select("example_id", F.col("n_chars").alias("response_chars"), (F.col("n_chars") * 7919 % 10007).alias("source_context_chars"))
    return benchmarks.full_summary(rows.select("example_id", "human", "task_type", "model"), rows.select("example_id", "predicted", "score"), lengths)


@query(f"""with {v.SCORED}, l as (select *, u.f as length, u.n as size from (select *, unnest([{{f: 'response_chars', n: n_chars}}, {{f: 'source_context_chars', n: n_chars * 7919 % 10007}}]) as u from scored)),
q as (select *, 'Q' || (1 + least(3, ((row_number() over (partition by length order by size, example_id) - 1) * 4) // count(*) over (partition by length))) as quartile from l),
c as (select length, quartile, min(size) as min_length, max(size) as max_length, {v.CELLS} from q group by all) select length, quartile, min_length, max_length, total, tp, tn, fp, fn, {v.RATES} from c""")
def full_length_slices(spark, d):
    return _round(_full(spark, d)["length_slices"])


@query(f"""with {v.EXAMPLES}, p as (select example_id, case when example_id % 97 = 0 then 1 - quality else quality end as quality from examples where example_id % 89 <> 0),
n as (select (select count(*) from p) as total, (select count(*) from p where quality = 1) as included, (select count(*) from p where quality <> 1) as excluded, (select count(*) from labels) as all_, (select count(*) from labels where quality = 1) as good, (select count(*) from labels where quality <> 1) as poor,
  (select count(*) from ((select doc_id from labels where doc_id % 89 <> 0) except (select example_id from p))) + (select count(*) from ((select example_id from p) except (select doc_id from labels where doc_id % 89 <> 0))) as ids,
  (select count(*) from ((select doc_id, quality from labels) except (select example_id, quality from p))) + (select count(*) from ((select example_id, quality from p) except (select doc_id, quality from labels))) as pairs,
  (select count(*) from documents c join benchmark t on contains(c.text, t.text)) as issues, (select count(distinct example_id) from p where quality = 1) as ids_included)
select r.name as "check", r.passed as passed from (select unnest([{{name: 'total', passed: total = all_}}, {{name: 'included', passed: included = good}}, {{name: 'excluded', passed: excluded = poor}}, {{name: 'validation_issues', passed: issues = 0}},
{{name: 'unique_included_ids', passed: ids_included = included}}, {{name: 'excluded_quality_counts', passed: excluded = poor}}, {{name: 'ids_checksum', passed: ids = 0}}, {{name: 'quality_checksum', passed: pairs = 0}}]) as r from n)""")
def population_checks(spark, d):
    """The prepared examples (some are gone, some of another quality) against the labels that they were made of: totals, and digests of ids (of those that were to be kept) and of ids with quality."""
    frozen = v.table(spark, d, "labels").select(F.col("doc_id").alias("example_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("quality"))
    kept = _examples(spark, d).select("example_id", "quality").where("example_id % 89 <> 0")
    kept = kept.withColumn("quality", F.when(F.col("example_id") % 97 == 0, F.when(F.col("quality") == "good", "poor").otherwise("good")).otherwise(F.col("quality")))
    digest = lambda rows, *columns: population.fingerprint(rows, columns).first().fingerprint
    n = {r.quality: r["count"] for r in frozen.groupBy("quality").count().collect()}
    expected = {"total": sum(n.values()), "included": n.get("good", 0), "excluded": n.get("poor", 0), "excluded_by_quality": {"poor": n.get("poor", 0)}}
    expected["checksums"] = {"ids": digest(frozen.where("example_id % 89 <> 0"), "example_id"), "quality": digest(frozen, "example_id", "quality")}
    return validate.population_checks(kept, v.qrels(spark, d), expected, {"ids": digest(kept, "example_id"), "quality": digest(kept, "example_id", "quality")})


@query(f"""with {v.EXAMPLES}, m as (select example_id, task_type || ':' || case when example_id % 9 = 0 then 'OTHER' else human end as stratum, task_type, case when example_id % 7 = 0 then 'GROUNDED' else human end as human, human as own, quality, example_id % 11 = 0 as gone from examples)
select example_id, unnest(list_filter([case when stratum <> task_type || ':' || human then 'MANIFEST_LABEL_MISMATCH' end, case when gone then 'MANIFEST_ID_MISSING' end, case when not gone and quality <> 1 then 'EXAMPLE_OUTSIDE_FROZEN_POPULATION' end,
case when not gone and own <> human then 'HUMAN_LABEL_MISMATCH' end], lambda x: x is not null)) as code from m""")
def manifest_guard(spark, d):
    rows = _examples(spark, d).withColumn("split", F.lit("test"))
    k = F.col("example_id")
    manifest = rows.select("example_id", F.concat_ws(":", "task_type", F.when(k % 9 == 0, "OTHER").otherwise(F.col("human"))).alias("stratum"), "task_type", F.when(k % 7 == 0, "GROUNDED").otherwise(F.col("human")).alias("human"))
    return validate.manifest_guard(manifest, rows.where("example_id % 11 <> 0"))


@query(f"""with {v.ATTEMPTS}, m as (select distinct user_id as example_id from events where user_id % 10 <> 0) select provider, example_id, unnest(list_filter([case when provider <> 'click' then 'EXPERIMENT_MIX' end,
case when example_id not in (select example_id from m) then 'ID_MISMATCH' end, case when status = 'SUCCESS' and k % 8 = 0 then 'SUCCESS_PROVENANCE_FAILED' end], lambda x: x is not null)) as code from attempts""")
def state_guard(spark, d):
    rows = v.attempts(spark, d).withColumn("prompt_sha256", F.when(F.col("k") % 8 == 0, "old").otherwise("new"))
    manifest = v.table(spark, d, "events").where("user_id % 10 <> 0").select(F.col("user_id").alias("example_id"))
    return validate.state_guard(rows, "click", manifest, {"prompt_sha256": "new"})


@query(f"""with {v.PREDICTIONS}, p as (select evaluator, count(*) filter (human = 'HALLUCINATED' and predicted = 'HALLUCINATED') as tp, count(*) filter (human <> 'HALLUCINATED' and predicted <> 'HALLUCINATED') as tn,
count(*) filter (human <> 'HALLUCINATED' and predicted = 'HALLUCINATED') as fp, count(*) filter (human = 'HALLUCINATED' and predicted <> 'HALLUCINATED') as fn from predictions group by 1), m as (select evaluator, {v.RATES} from p),
w as (select count(*) filter (a and not b) as local_only, count(*) filter (b and not a) as other_only from correct)
select case when x.balanced_accuracy >= y.balanced_accuracy and x.f1 >= y.f1 and x.false_positive_rate <= y.false_positive_rate and local_only >= other_only then 'RECOMMEND_FULL_LOCAL_RUN' else 'RECOMMEND_NO_FULL_LOCAL_RUN' end as status,
'OWNER_AUTHORIZATION_REQUIRED' as decision_gate, local_only, other_only from m x, m y, w where x.evaluator = 'a' and y.evaluator = 'b'""")
def local_recommendation(spark, d):
    metrics = _round(classify.confusion(v.predictions(spark, d), ["evaluator"]))
    paired_rows = paired_categories(spark, d)
    wins = paired_rows.agg(F.expr("count_if(category = 'A_ONLY')").alias("local_only"), F.expr("count_if(category = 'B_ONLY')").alias("other_only"))
    local = metrics.where("evaluator = 'a'").withColumns({"missing_count": F.lit(0), "parse_success_rate": F.lit(1.0)})
    return population.local_recommendation(local, metrics.where("evaluator = 'b'"), wins)


@query(f"""with {v.PREDICTIONS}, p as (select evaluator, count(*) filter (human = 'HALLUCINATED' and predicted = 'HALLUCINATED') as tp, count(*) filter (human <> 'HALLUCINATED' and predicted <> 'HALLUCINATED') as tn,
count(*) filter (human <> 'HALLUCINATED' and predicted = 'HALLUCINATED') as fp, count(*) filter (human = 'HALLUCINATED' and predicted <> 'HALLUCINATED') as fn, count(*) filter (score > 0.97) as missing from predictions group by 1),
m as (select evaluator, missing, {v.RATES} from p), w as (select count(*) filter (a and not b) as local_only, count(*) filter (b and not a) as other_only from correct)
select case when x.missing > 0 then 'INCONCLUSIVE' when x.balanced_accuracy >= y.balanced_accuracy and x.f1 >= y.f1 and x.false_positive_rate <= y.false_positive_rate and local_only >= other_only then 'RECOMMEND_FULL_LOCAL_RUN' else 'RECOMMEND_NO_FULL_LOCAL_RUN' end as status,
'OWNER_AUTHORIZATION_REQUIRED' as decision_gate, local_only, other_only from m x, m y, w where x.evaluator = 'b' and y.evaluator = 'a'""")
def local_recommendation_with_gaps(spark, d):
    """The same for evaluator b as the local one, whose least sure answers count as missing."""
    rows = v.predictions(spark, d)
    metrics = _round(classify.confusion(rows, ["evaluator"]))
    wins = paired_categories(spark, d).agg(F.expr("count_if(category = 'A_ONLY')").alias("local_only"), F.expr("count_if(category = 'B_ONLY')").alias("other_only"))
    missing = rows.where("evaluator = 'b'").agg(F.count_if(F.col("score") > 0.97).alias("missing_count"))
    local = metrics.where("evaluator = 'b'").crossJoin(missing).withColumn("parse_success_rate", F.lit(1.0))
    return population.local_recommendation(local, metrics.where("evaluator = 'a'"), wins)


@query("""select min(id) as model_id from (select case when (p_partkey % 3) = 0 then '0:' else '1:' end as plain, 'm-' || p_partkey || case when p_size % 4 = 0 then ':free' else '' end as id, p_type from part)
where contains(id, ':free') and p_type <> 'ECONOMY' and plain = (select min(case when (p_partkey % 3) = 0 then '0:' else '1:' end) from part where p_size % 4 = 0 and p_type <> 'ECONOMY')""")
def free_model(spark, d):
    rows = v.table(spark, d, "part")
    name = F.concat(F.lit("m-"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 4 == 0, ":free").otherwise(""))
    modality = F.when(F.col("p_type") == "ECONOMY", "image->text").when(F.col("p_type") != "STANDARD", "text->text")
    return providers.free_model(rows.select(name.alias("model_id"), modality.alias("modality"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("tools"), F.lit("response_format"))).alias("supported_parameters")))


_LABELS = "(['Gemini Flash', 'deepseek-v4-pro', 'qwen3.5-9b', 'my mistral', 'llama tts', 'Claude X', 'gpt-9', 'grok', 'nova preview', 'perplexity', 'phi', 'gemma vision'])[p_partkey % 12 + 1]"


@query(f"""with m as (select 'm-' || p_partkey as model_id, {_LABELS} as name, case when p_size % 5 <> 0 then p_size end as quota from part) select case when contains(name, 'Gemini') or contains(name, 'gemma') then 'Gemini' when contains(name, 'deepseek') then 'DeepSeek' when contains(name, 'qwen') then 'Qwen'
when contains(name, 'mistral') then 'Mistral' when contains(name, 'llama') then 'Meta/Llama' when contains(name, 'Claude') then 'Claude' when contains(name, 'gpt-') then 'OpenAI' when contains(name, 'grok') then 'xAI' when contains(name, 'nova') then 'Nova'
when contains(name, 'perplexity') then 'Perplexity' else 'Other' end as family, not regexp_matches(lower(name), 'embedding|rerank|vision|image|audio|tts') as text_chat, count(*) as n from m group by all""")
def model_families(spark, d):
    rows = _models(spark, d)
    name = F.concat_ws(" ", "model_id", "name")
    return rows.groupBy(providers.model_family(name).alias("family"), providers.is_text_chat(name).alias("text_chat")).agg(F.count("*").alias("n"))


def _models(spark, d) -> DataFrame:
    names = ("Gemini Flash", "deepseek-v4-pro", "qwen3.5-9b", "my mistral", "llama tts", "Claude X", "gpt-9", "grok", "nova preview", "perplexity", "phi", "gemma vision")
    k = F.col("p_partkey")
    return v.table(spark, d, "part").select(F.concat(F.lit("m-"), k.cast("string")).alias("model_id"), F.get(F.array(*map(F.lit, names)), (k % 12).cast("int")).alias("name"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("quota"))


@query(f"""with m as (select 'm-' || p_partkey as model_id, {_LABELS} as name, case when p_size % 5 <> 0 then p_size end as quota from part)
select model_id, name from m where not regexp_matches(lower(name), 'gemini|gemma|google|embedding|rerank|vision|image|audio|tts') order by contains(name, 'preview'), coalesce(quota, -1) desc, model_id limit 3""")
def model_candidates(spark, d):
    return providers.model_candidates(_models(spark, d)).select("model_id", "name")


# ---- validation and spans --------------------------------------------------------------------------------------


@query("select 'DUPLICATE_ID' as code, 'occurrence ' || n as message, key as record_id from (select md5(text) as key, row_number() over (partition by md5(text) order by doc_id) as n from documents) where n > 1")
def validate_duplicates(spark, d):
    return validate.duplicates(v.table(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id"), "key", "doc_id")


@query("select 'UNKNOWN_DOCUMENT' as code, cast(doc_id as varchar) as message, cast(doc_id as varchar) as record_id from labels where doc_id not in (select doc_id from documents where lang = 'en')")
def validate_unknown_documents(spark, d):
    english = v.table(spark, d, "documents").where("lang = 'en'")
    return validate.unknown(v.table(spark, d, "labels").select("doc_id"), "doc_id", english, "doc_id", "UNKNOWN_DOCUMENT", "doc_id")


@query(f"with {v.TOPICS}, {v.CORPUS}, {v.QRELS} select 'UNKNOWN_QUERY_ID' as code, query_id as message, query_id as record_id from qrels where query_id not in (select query_id from topics where length(text) > 200)")
def validate_unknown_queries(spark, d):
    return validate.unknown(v.qrels(spark, d), "query_id", v.topics(spark, d).where("length(text) > 200"), "query_id", "UNKNOWN_QUERY_ID", "query_id")


@query()
def near_duplicate_docs(spark, d):
    return _round(validate.near_duplicates(v.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "doc_id"))


_SPANS = f"""{v.TOPICS}, {v.CORPUS}, s as (select document_id, query_id, strpos(c.text, t.text) - 1 as start, c.text, t.text as quoted from corpus c join topics t on contains(c.text, t.text)),
sp as (select *, start + length(quoted) + cast(query_id as int) % 3 as "end" from s)"""


def _spans(spark, d) -> DataFrame:
    rows = v.qrels(spark, d).join(v.corpus(spark, d), "document_id").join(v.topics(spark, d).withColumnRenamed("text", "quoted"), "query_id")
    rows = rows.withColumn("start", F.expr("instr(text, quoted) - 1"))
    return rows.withColumn("end", F.col("start") + F.length("quoted") + F.col("query_id").cast("int") % 3)


@query(f"""with {_SPANS}, i as (select document_id, query_id, unnest(list_filter([case when "end" > length(text) then 'END_OUT_OF_RANGE' end, case when "end" <= length(text) and substr(text, start + 1, "end" - start) <> quoted then 'TEXT_OFFSET_MISMATCH' end], lambda x: x is not null)) as code from sp) select * from i""")
def span_issues(spark, d):
    rows = _spans(spark, d)
    return rows.select("document_id", "query_id", F.explode(tx.span_issues(F.col("text"), F.col("start"), F.col("end"), F.col("quoted"))).alias("code"))


@query(f"""with {_SPANS}, x as (select document_id, query_id, greatest(0, least("end", start + 100) - greatest(start, 50)) as overlap, "end" - start as a, start + 100 - 50 as b from sp)
select document_id, query_id, overlap::bigint as overlap, round(case when a + b - overlap = 0 then 0 else overlap / (a + b - overlap) end, 9) as iou from x""")
def span_iou(spark, d):
    rows = _spans(spark, d)
    own = (F.col("start"), F.col("end"), F.lit(50), F.col("start") + 100)
    return _round(rows.select("document_id", "query_id", tx.span_overlap(*own).cast("long").alias("overlap"), tx.span_iou(*own).alias("iou")))


# ---- providers and jobs ----------------------------------------------------------------------------------------


@query("select event_type as provider, count(value) as count, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by 1")
def latency_summary(spark, d):
    rows = v.attempts(spark, d).select("provider", "latency_ms")
    return providers.latency(rows, "provider").withColumn("mean", F.round("mean", 6))


@query(f"""with {v.ATTEMPTS} select provider, count(*) as total, count(label) as evaluated_count, count(*) - count(label) as missing_count, round(avg(api_success::int), 9) as api_success_rate, round(avg(parse_success::int), 9) as parse_success_rate,
round(avg((api_success and not parse_success)::int), 9) as schema_validation_failure_rate from attempts group by provider""")
def provider_summary(spark, d):
    return _round(providers.reliability(_failed(spark, d), "provider"))


def _failed(spark, d) -> DataFrame:
    """Attempts with the class of what went wrong."""
    api = F.col("api_success")
    return v.attempts(spark, d).withColumn("error_class", F.when(~api, providers.error_class(F.col("http_status"))).when(~F.col("parse_success"), F.when(F.col("k") % 2 == 0, "PARSE_ERROR").otherwise("SCHEMA_VALIDATION_ERROR")))


@query(f"""with {v.ATTEMPTS}, t as (select provider, count(*) as total_records, count(*) filter (api_success) as api_success_count, count(*) filter (parse_success) as parse_success_count, count(label) as valid_success_count,
count(*) - count(label) as terminal_failure_count, count(*) filter (attempt > 1) as retry_record_count from attempts group by 1)
select *, round(valid_success_count / total_records, 9) as validity_rate, case when terminal_failure_count >= 10 or total_records >= 100 and valid_success_count / total_records < 0.98 then 'TRIPPED' else 'NOT_TRIPPED' end as circuit_breaker from t""")
def technical_reliability(spark, d):
    return _round(providers.technical_reliability(v.attempts(spark, d), "provider"))


@query(f"""with {v.ATTEMPTS}, r as (select provider, row_number() over w as nth, count(label) over w as valid from attempts window w as (partition by provider order by ts, event_id rows unbounded preceding))
select provider, min(nth) filter (nth - valid >= 10 or nth >= 100 and valid / nth < 0.98) as stop_at from r group by provider""")
def full_run_breaker(spark, d):
    return providers.full_run_breaker(v.attempts(spark, d), "provider", ["ts", "event_id"])


@query(f"""with {v.ATTEMPTS}, m as (select user_id as example_id, row_number() over (order by user_id desc) as position from (select distinct user_id from events)),
f as (select example_id, case when http_status = 401 then 'API_AUTH_ERROR' when http_status = 429 then 'API_RATE_LIMIT' when http_status = 503 then 'API_SERVER_ERROR' when k % 2 <> 0 then 'PERSISTED_SCHEMA_VALIDATION_SUBTYPE_UNKNOWN'
  when k % 3 = 0 then 'OUTPUT_TOKEN_LIMIT' else 'PERSISTED_PARSE_ERROR_SUBTYPE_UNKNOWN' end as category from attempts where status <> 'SUCCESS' and provider = 'click')
select category, position, example_id from f join m using (example_id)""")
def failure_breakdown(spark, d):
    rows = _failed(spark, d).where("provider = 'click'").withColumn("finish_reason", F.when(F.col("k") % 3 == 0, "length").otherwise("stop"))
    manifest = numbered(v.table(spark, d, "events").select(F.col("user_id").alias("example_id")).distinct(), F.desc("example_id"), name="position")
    return providers.failure_breakdown(rows, manifest)


@query(f"""with {v.ATTEMPTS} select provider, count(latency_ms) as load_count, round(avg(latency_ms * 1000 / 1000000), 9) as load_mean_ms, round(max(latency_ms * 1000 / 1000000), 9) as load_max_ms, sum(k)::double as completion_tokens, round(sum(k * 1000.0::double) / 1000000000, 9) as eval_seconds,
round(avg(latency_ms), 6) as latency_mean_ms, round(sum(k) / (sum(k * 1000.0::double) / 1000000000), 3) as tokens_per_second, round(avg(latency_ms) * 2675 / 3600000, 9) as projected_hours from attempts group by 1""")
def operational_summary(spark, d):
    k = F.col("k").cast("double")
    use = F.create_map(F.lit("load_duration_ns"), F.col("latency_ms") * 1000, F.lit("eval_duration_ns"), k * 1000, F.lit("completion_tokens"), k)
    return _round(providers.operational(v.attempts(spark, d).withColumn("usage", use), "provider")).withColumns({"latency_mean_ms": F.round("latency_mean_ms", 6), "tokens_per_second": F.round("tokens_per_second", 3)})


@query(f"""with {v.ATTEMPTS}, r as (select event_id, http_status in (429, 503) as may, coalesce(sum((http_status in (429, 503))::int) over (partition by provider, example_id order by attempt rows between unbounded preceding and 1 preceding), 0)::bigint as retries from attempts)
select event_id, retries, case when may and retries < 2 then least(2.0::double, 0.1::double * pow(2, retries)) end as delay_seconds from r""")
def retry_plan(spark, d):
    return _round(providers.retry_plan(_failed(spark, d), ["provider", "example_id"], ["attempt"]).select("event_id", "retries", "delay_seconds"))


@query(f"with {v.ATTEMPTS} select provider, sum(k)::double as input_tokens, sum(case when k % 2 = 0 then k * 2 else 0 end)::double as output_tokens, sum(k * 3)::double as total_tokens from attempts group by provider")
def usage_totals(spark, d):
    k = F.col("k").cast("double")
    even = F.map_concat(F.create_map(F.lit("prompt_tokens"), k, F.lit("totalTokenCount"), k * 3), F.when(F.col("k") % 2 == 0, F.create_map(F.lit("eval_count"), k * 2)).otherwise(F.create_map().cast("map<string,double>")))
    return providers.usage(v.attempts(spark, d).withColumn("usage", even), "provider").select("provider", "input_tokens", "output_tokens", "total_tokens")


@query(f"""with {v.ATTEMPTS}, g as (select event_id // 6 as example_id, count(*) as n, count(*) filter (label = 'HALLUCINATED') as h, avg(confidence) as m, max(confidence) - min(confidence) as r from attempts where label is not null group by 1 having count(*) = 3)
select count(*) as examples, round(coalesce(sum((h * (h - 1) + (3 - h) * (2 - h)) / 2) / (count(*) * 3), 0), 9) as pairwise_agreement, round(coalesce(avg((h = 0 or h = 3)::int), 0), 9) as unanimity, round(avg(m), 9) as mean_confidence, round(max(r), 9) as max_confidence_range from g""")
def consistency_three_runs(spark, d):
    return _round(paired.consistency(v.attempts(spark, d).select(F.floor(F.col("event_id") / 6).alias("example_id"), "label", "confidence")))


_JUDGES = f"""with {v.ATTEMPTS}, s as (select provider || '-' || (event_id // 4) as provider, round(avg((label = 'GROUNDED')::int), 9) as balanced_accuracy, round(avg(confidence), 9) as f1, round(avg((label = 'HALLUCINATED')::int), 9) as false_positive_rate,
count(*) - count(label) as missing_count, round(avg(api_success::int), 9) as api_success_rate, round(avg(parse_success::int), 9) as parse_success_rate, quantile_disc(latency_ms, 0.95) as p95, sum(k)::double as total_tokens from attempts group by 1),
r as (select *, row_number() over (order by balanced_accuracy desc, f1 desc, false_positive_rate, parse_success_rate desc, p95, total_tokens, provider) as place from s where missing_count = 0 and api_success_rate = 1 and parse_success_rate = 1)"""


def _judges(spark, d) -> DataFrame:
    """Judges: a provider and a few events in a row; few enough that some are complete."""
    share = lambda c: F.round(F.avg(F.expr(c).cast("int")), 9)
    rows = v.attempts(spark, d).withColumn("provider", F.concat_ws("-", "provider", F.floor(F.col("event_id") / 4).cast("string")))
    return rows.groupBy("provider").agg(
        share("label = 'GROUNDED'").alias("balanced_accuracy"), F.round(F.avg("confidence"), 9).alias("f1"), share("label = 'HALLUCINATED'").alias("false_positive_rate"), (F.count("*") - F.count("label")).alias("missing_count"),
        share("api_success").alias("api_success_rate"), share("parse_success").alias("parse_success_rate"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95"), F.sum("k").cast("double").alias("total_tokens"),
    )


@query(_JUDGES + " select * from r")
def judge_recommendation(spark, d):
    return providers.recommend(_judges(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(_JUDGES + " select case when count(*) = 0 then 'UNVERIFIED' else 'RECOMMENDED' end as status, arg_min(provider, place) as provider from r")
def judge_choice(spark, d):
    return providers.recommendation(_judges(spark, d))


@query(f"""with {v.ATTEMPTS}, m as (select distinct user_id as example_id, user_id as position from events union select max(user_id) + 1, max(user_id) + 1 from events), s as (select example_id, bool_or(status = 'SUCCESS') as ok from attempts where provider = 'click' group by 1)
select position, example_id, case when ok then 'SUCCESSFUL' when ok is null then 'NEVER_ATTEMPTED' else 'PREVIOUSLY_FAILED' end as state, not coalesce(ok, false) as pending from m left join s using (example_id)""")
def resume_partition(spark, d):
    users = v.table(spark, d, "events").select("user_id")
    manifest = users.distinct().unionByName(users.agg((F.max("user_id") + 1).alias("user_id"))).select(F.col("user_id").alias("position"), F.col("user_id").alias("example_id"))
    return providers.resume(manifest, v.attempts(spark, d).where("provider = 'click'"))


@query(f"""with {v.ATTEMPTS}, r as (select provider, example_id, event_id, ts, http_status = 429 as lim, sum((http_status <> 429)::int) over (partition by provider, example_id order by ts, event_id) as reset from attempts),
s as (select *, sum(lim::int) over (partition by provider, example_id, reset order by ts, event_id rows unbounded preceding) as streak, epoch_us(ts) - epoch_us(lag(ts) over (partition by provider, example_id order by ts, event_id)) as gap from r)
select event_id, streak::bigint as streak, round(gap / 1000000, 6) as gap_seconds, max(streak) over (partition by provider, example_id order by ts, event_id rows unbounded preceding) >= 3 as open from s""")
def rate_limit_streaks(spark, d):
    rows = v.attempts(spark, d).withColumns({"error_class": F.when(~F.col("api_success"), providers.error_class(F.col("http_status"))), "who": F.concat_ws("|", "provider", F.col("example_id").cast("string"))})
    return providers.streaks(rows, "who", ["ts", "event_id"]).select("event_id", "streak", F.round("gap_seconds", 6).alias("gap_seconds"), "open")


_CODES = "codes as (select event_id, ([0, 200, 204, 302, 400, 401, 402, 403, 404, 408, 429, 500, 502, 503, 504, 505])[event_id % 16 + 1] as status, ['completion', 'discovery', 'timeout'][event_id % 3 + 1] as phase, ['', 'CUDA out of memory', 'model failed to load', 'quota rpd'][event_id % 4 + 1] as body from events)"


def _codes(spark, d) -> DataFrame:
    """HTTP outcomes, one for each event: status, phase, body."""
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % n).cast("int"))
    return v.table(spark, d, "events").select("event_id", at((0, 200, 204, 302, 400, 401, 402, 403, 404, 408, 429, 500, 502, 503, 504, 505), 16).alias("status"), at(("completion", "discovery", "timeout"), 3).alias("phase"), at(("", "CUDA out of memory", "model failed to load", "quota rpd"), 4).alias("body"))


@query(f"""with {_CODES} select phase, case when status between 200 and 299 then 'PASS' when status in (401, 403) then 'AUTH_FAILED' when status = 402 then 'QUOTA_EXHAUSTED' when status = 404 and phase = 'completion' then 'MODEL_UNAVAILABLE'
when status = 429 then 'RATE_LIMITED' when status in (0, 408, 500, 502, 503, 504) or phase = 'timeout' then 'NETWORK_FAILED' else 'INVALID_RESPONSE' end as health,
case when status in (401, 403) then 'API_AUTH_ERROR' when status = 402 then 'API_QUOTA_ERROR' when status = 429 then 'API_RATE_LIMIT' when status in (408, 504) then 'API_TIMEOUT' when status between 500 and 599 then 'API_SERVER_ERROR' else 'API_ERROR' end as hosted,
case when contains(body, 'out of memory') then 'LOCAL_OOM' when contains(body, 'failed to load') then 'LOCAL_RESOURCE_ERROR' when status = 404 then 'LOCAL_MODEL_NOT_FOUND' when status in (408, 504) then 'LOCAL_TIMEOUT'
when status between 500 and 599 then 'LOCAL_SERVER_ERROR' else 'LOCAL_REQUEST_ERROR' end as local, case when status = 429 then case when contains(body, 'rpd') then 'RPD' else 'OTHER' end end as dimension, count(*) as n from codes group by all""")
def status_classes(spark, d):
    rows, status = _codes(spark, d), F.col("status")
    health = F.coalesce(*[F.when(F.col("phase") == p, providers.health_status(status, p)) for p in ("completion", "discovery", "timeout")])
    return rows.groupBy("phase", health.alias("health"), providers.error_class(status).alias("hosted"), providers.local_error_class(status, F.col("body")).alias("local"), providers.rate_limit_dimension(status, F.col("body")).alias("dimension")).agg(F.count("*").alias("n"))


@query(f"with {v.ATTEMPTS} select case when http_status = 401 then 'API_AUTH_ERROR' when http_status = 429 then 'API_RATE_LIMIT' when http_status = 503 then 'API_SERVER_ERROR' when k % 2 = 0 then 'PARSE_ERROR' else 'SCHEMA_VALIDATION_ERROR' end as error_class, count(*) as n from attempts where not parse_success group by 1")
def error_counts(spark, d):
    return providers.error_counts(_failed(spark, d))


@query("select count(*) as n, ceil((sum(ceil(length(text) / 3)) + count(*) * 64) * 1.25)::bigint as tokens from conversations")
def token_estimate(spark, d):
    return providers.token_estimate(v.table(spark, d, "conversations"), 64, "text")


@query("select u.f as field, min(u.n) as min, quantile_disc(u.n, 0.5) as p50, quantile_disc(u.n, 0.95) as p95, max(u.n) as max, round(avg(u.n), 6) as mean from (select unnest([{f: 'text', n: length(text)}, {f: 'role', n: length(role)}]) as u from conversations) group by 1")
def length_summary(spark, d):
    return providers.lengths(v.table(spark, d, "conversations"), ["text", "role"]).withColumn("mean", F.round("mean", 6))


_JOB_LAGS = f"{v.JOBS}, l as (select *, lag(state) over w as was, lag(cancel_requested) over w as asked from log window w as (partition by job_id order by revision))"


@query(f"""with {_JOB_LAGS}, i as (select job_id, revision, unnest(list_filter([case when was in ('COMPLETE', 'FAILED', 'CANCELLED', 'INTERRUPTED') then 'TERMINAL' end,
case when was <> state and was not in ('COMPLETE', 'FAILED', 'CANCELLED', 'INTERRUPTED') and not list_contains(case was when 'QUEUED' then ['VALIDATING', 'CANCELLED', 'FAILED'] when 'VALIDATING' then ['EVALUATING', 'FAILED', 'CANCELLED', 'INTERRUPTED']
when 'EVALUATING' then ['ANALYZING', 'FAILED', 'CANCELLED', 'INTERRUPTED'] when 'ANALYZING' then ['WRITING_ARTIFACT', 'FAILED', 'CANCELLED', 'INTERRUPTED'] else ['COMPLETE', 'FAILED', 'CANCELLED', 'INTERRUPTED'] end, state) then 'ILLEGAL_TRANSITION' end,
case when asked and not cancel_requested then 'CANCEL_WITHDRAWN' end, case when was = state and asked = cancel_requested then 'NO_CHANGE' end], lambda x: x is not null)) as code from l) select * from i""")
def job_fsm_violations(spark, d):
    return jobs.fsm_violations(v.job_log(spark, d))


@query(f"with {v.JOBS}, l as (select run_id, job_id, arg_max(state, revision) as state, arg_max(created_at, revision) as created_at from log group by 1, 2) select run_id, arg_max(job_id, (created_at, job_id)) as job_id, arg_max(state, (created_at, job_id)) as state from l group by run_id")
def latest_job_per_run(spark, d):
    return jobs.latest_per_run(v.job_log(spark, d))


@query(f"with {v.JOBS}, l as (select job_id, arg_max(state, revision) as state from log group by 1) select job_id, case when state = 'QUEUED' then 'REQUEUE' else 'INTERRUPT' end as action from l where state not in ('COMPLETE', 'FAILED', 'CANCELLED', 'INTERRUPTED')")
def job_recovery(spark, d):
    return jobs.recovery(v.job_log(spark, d))


@query(f"""with {v.EXAMPLES}, a as (select example_id, human from examples where example_id % 6 <> 0), b as (select example_id, case when example_id % 7 = 0 then 'GROUNDED' else human end as human from examples where example_id % 5 <> 0)
select example_id, case when b.human is null then 'ONLY_IN_FIRST' when a.human is null then 'ONLY_IN_SECOND' else 'HUMAN_LABEL_MISMATCH' end as code from a full join b using (example_id) where a.human is distinct from b.human""")
def pairing_violations(spark, d):
    rows = v.examples(spark, d).select("example_id", "human")
    return paired.pairing_violations(rows.where("example_id % 6 <> 0"), rows.where("example_id % 5 <> 0").withColumn("human", F.when(F.col("example_id") % 7 == 0, "GROUNDED").otherwise(F.col("human"))))


# ---- evidence --------------------------------------------------------------------------------------------------


@query(f"""with {v.RUNS}, a as (select artifact_id, verification_status, data_kind, claim_scope from runs union all select artifact_id, verification_status, data_kind, claim_scope from comparisons)
select artifact_id, unnest(list_filter([case when verification_status = 'NOT_RUN' then 'NOT_RUN_IS_NOT_EVIDENCE' end, case when data_kind = 'SYNTHETIC_FIXTURE' and claim_scope <> 'INTEGRATION_ONLY' then 'SYNTHETIC_FIXTURE_NEEDS_INTEGRATION_ONLY' end,
case when claim_scope = 'BENCHMARK_RESULT' and data_kind <> 'OFFICIAL_BENCHMARK' then 'BENCHMARK_RESULT_NEEDS_OFFICIAL_BENCHMARK' end], lambda x: x is not null)) as code from a""")
def claim_violations(spark, d):
    claims = ["artifact_id", "verification_status", "data_kind", "claim_scope"]
    return population.claim_violations(v.runs(spark, d).select(*claims).unionByName(v.comparisons(spark, d).select(*claims)))


@query(f"""with {v.RUNS}, a as (select artifact_id, 'run' as artifact_type, null as baseline_id, null as candidate_id from runs union all select artifact_id, 'run', null, null from runs where k % 25 = 7
union all select artifact_id, 'comparison', baseline_id, candidate_id from comparisons)
select artifact_id, 'DUPLICATE_ARTIFACT' as code from a group by 1 having count(*) > 1 union all select artifact_id, 'SELF_COMPARISON' from a where baseline_id = candidate_id
union all select artifact_id, 'UNKNOWN_RUN' from a where artifact_type = 'comparison' and (baseline_id not in (select artifact_id from runs) or candidate_id not in (select artifact_id from runs))""")
def index_integrity(spark, d):
    none = F.lit(None).cast("string")
    run = v.runs(spark, d).select("artifact_id", "artifact_type", none.alias("baseline_id"), none.alias("candidate_id"))
    again = run.where("cast(substring(artifact_id, 5) as long) % 25 = 7")
    return evidence.index_violations(run.unionByName(again).unionByName(v.comparisons(spark, d).select(*run.columns)))


@query(f"""with {v.RUNS}, s as (select * from (values ('UNVERIFIED', 0), ('PARTIAL', 1), ('VERIFIED', 2)) t(status, s)),
j as (select c.*, a.artifact_id as a_id, b.artifact_id as b_id, a.data_kind as a_kind, b.data_kind as b_kind, a.claim_scope as a_scope, b.claim_scope as b_scope, cs.s as own, least(sa.s, sb.s) as weakest, {_SAME} as same
  from comparisons c left join runs a on a.artifact_id = c.baseline_id left join runs b on b.artifact_id = c.candidate_id left join s cs on cs.status = c.verification_status
  left join s sa on sa.status = a.verification_status left join s sb on sb.status = b.verification_status)
select artifact_id, unnest(list_filter([case when a_id is null then 'UNKNOWN_BASELINE' end, case when b_id is null then 'UNKNOWN_CANDIDATE' end, case when baseline_id = candidate_id then 'SELF_COMPARISON' end,
case when a_id is not null and b_id is not null and (data_kind <> a_kind or data_kind <> b_kind) then 'DATA_KIND_MISMATCH' end, case when a_id is not null and b_id is not null and (claim_scope <> a_scope or claim_scope <> b_scope) then 'CLAIM_SCOPE_MISMATCH' end,
case when a_id is not null and b_id is not null and own > weakest then 'STRONGER_THAN_OPERANDS' end, case when a_id is not null and b_id is not null and population_compatibility = 'MATCHED' and not same then 'POPULATION_MISMATCH' end], lambda x: x is not null)) as code from j""")
def operand_violations(spark, d):
    return population.operand_violations(v.comparisons(spark, d), v.runs(spark, d))


@query(f"with {v.RUNS} select artifact_id, verification_status, data_kind, claim_scope from runs where verification_status = 'PARTIAL' and claim_scope = 'PROTOCOL_SPECIFIC'")
def catalog_filter(spark, d):
    chosen = {"verification": ["PARTIAL"], "scope": ["PROTOCOL_SPECIFIC"], "data": ["nonsense"], "population": ["MATCHED", "UNVERIFIED"]}
    return evidence.catalog_filter(v.runs(spark, d), chosen).select("artifact_id", "verification_status", "data_kind", "claim_scope")


@query(f"with {v.RUNS} select artifact_id, population_compatibility, result from comparisons where population_compatibility = 'MATCHED' and result = 'REGRESSION' and data_kind = 'CURATED_DATASET'")
def comparison_filter(spark, d):
    chosen = {"population": ["MATCHED"], "result": ["REGRESSION"], "data": ["CURATED_DATASET"], "scope": ["PILOT"]}
    return evidence.catalog_filter(v.comparisons(spark, d), chosen).select("artifact_id", "population_compatibility", "result")


_SECRETS = "(?i)(?:api[_-]?key|authorization|bearer|password|secret|token)\\s*[:=]"
_NAMES = "(?i)^(?:api[_-]?key|authorization|bearer|password|secret|token)(?:[_-]?value)?$"


def _policy_sql(most: int) -> str:
    t = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    return f"""select doc_id, 'text' as field, code from (select doc_id, case when t = '' then 'EMPTY_TEXT' when length(t) > {most} then 'TEXT_TOO_LONG' when regexp_matches(t, '{_SECRETS}') or regexp_matches(t, '{_NAMES}')
or regexp_matches(t, '^[A-Za-z]:[\\\\/]') or starts_with(t, '/') then 'UNSAFE_TEXT' when regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') then 'CONTROL_CHARACTER' end as code from (select doc_id, {t} as t from documents)) where code is not null"""


@query(_policy_sql(500))
def public_text_violations(spark, d):
    return evidence.text_violations(v.table(spark, d, "documents"), "doc_id", ["text"])


@query(_policy_sql(1_000_000))
def unsafe_texts(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", F.lit("text").alias("field"), evidence.text_violation(F.col("text"), 1_000_000).alias("code"))
    return rows.where("code is not null")


# ---- operators over the same views -----------------------------------------------------------------------------

_VALUES = f"""{v.RUNS}, values_ as (select artifact_id as run_id, m.name as metric, case when m.name = 'mrr_at_10' and k % 6 = 0 then 'nan'::double else (k * m.times % 101)::double / 100 end as value from runs,
(select unnest([{{name: 'mrr_at_10', times: 7}}, {{name: 'ndcg_at_10', times: 11}}, {{name: 'precision_at_5', times: 13}}, {{name: 'recall_at_5', times: 17}}]) as m))"""


def _metrics(spark, d) -> DataFrame:
    """Metrics of the published runs, in long form; some are no numbers."""
    runs = v.runs(spark, d).select(F.col("artifact_id").alias("run_id"), F.substring("artifact_id", 5, 20).cast("long").alias("k"))
    made = F.array(*[F.struct(F.lit(n).alias("metric"), ((F.col("k") * by) % 101 / 100).alias("value")) for n, by in (("mrr_at_10", 7), ("ndcg_at_10", 11), ("precision_at_5", 13), ("recall_at_5", 17))])
    rows = runs.select("run_id", "k", F.inline(made))
    return rows.select("run_id", "metric", F.when((F.col("metric") == "mrr_at_10") & (F.col("k") % 6 == 0), float("nan")).otherwise(F.col("value")).alias("value"))


@query(f"with {_VALUES} select x.metric, x.value as baseline, y.value as candidate, round(y.value - x.value, 9) as delta from values_ x join values_ y using (metric) where x.run_id = 'run-1' and y.run_id = 'run-2'")
def metric_deltas(spark, d):
    of = lambda run: _metrics(spark, d).where(F.col("run_id") == run).select("metric", "value")
    return _round(paired.metric_deltas(of("run-1"), of("run-2")))


@query(f"with {_VALUES} select run_id, metric, value, nth from (select *, row_number() over (partition by run_id order by metric) as nth from values_ where not isnan(value)) where nth <= 3")
def first_metrics(spark, d):
    return evidence.first_metrics(_metrics(spark, d).where(evidence.finite(F.col("value")))).withColumn("nth", F.col("nth").cast("long"))


@query(f"""with {_VALUES}, q as (select 'run-' || (o_orderkey % 50) as run_id, cast(o_orderkey as varchar) as query_id, o_orderstatus as category from orders),
m as (select run_id, string_agg(metric || '=' || round(value, 6), ',' order by metric) as metrics from values_ where not isnan(value) group by 1), p as (select run_id, count(*) as n, min(query_id) as first from q group by 1)
select artifact_id, verification_status, data_kind, claim_scope, dataset_version as version, top_k::int as top_k, metrics, case when data_kind = 'SYNTHETIC_FIXTURE' then coalesce(n, 0) else 0 end as queries, case when data_kind = 'SYNTHETIC_FIXTURE' then first end as first_query
from runs left join m on m.run_id = artifact_id left join p on p.run_id = artifact_id""")
def run_artifacts(spark, d):
    """Public forms of all runs, their nested parts as text and counts."""
    runs = v.runs(spark, d).withColumnsRenamed({"artifact_id": "run_id"}).withColumns({"limitations": F.array(F.lit("b"), F.lit("a"), F.lit("b")), "secret_token": F.lit("x")})
    queries = v.table(spark, d, "orders").select(F.concat(F.lit("run-"), (F.col("o_orderkey") % 50).cast("string")).alias("run_id"), F.col("o_orderkey").cast("string").alias("query_id"), F.col("o_orderstatus").alias("category"))
    out = evidence.run_artifact(runs, _metrics(spark, d), queries)
    pairs = F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string")))
    return out.select(
        "artifact_id", "verification_status", "data_kind", "claim_scope", F.col("run.dataset_version").alias("version"), F.col("run.top_k").alias("top_k"), F.array_join(F.array_sort(pairs), ",").alias("metrics"),
        F.coalesce(F.array_size("queries"), F.lit(0)).cast("long").alias("queries"), F.get("queries", F.lit(0))["query_id"].alias("first_query"),
    )


@query(f"with {v.RUNS} select artifact_id, artifact_type, verification_status, data_kind, claim_scope from runs union all select artifact_id, artifact_type, verification_status, data_kind, claim_scope from comparisons")
def artifact_index(spark, d):
    return evidence.index(v.runs(spark, d), v.comparisons(spark, d))


_DELTAS = f"""{_VALUES}, c as (select c.artifact_id, baseline_id, candidate_id, 'ndcg_at_10' as metric, round((substr(candidate_id, 5)::bigint * 11 % 101)::double / 100 - (substr(baseline_id, 5)::bigint * 11 % 101)::double / 100, 9) + case when substr(c.artifact_id, 5)::bigint % 8 = 0 then 0.5 else 0 end as delta from comparisons c)"""


@query(f"""with {_DELTAS} select c.artifact_id, c.metric, round(delta, 9) as delta, round(y.value - x.value, 9) as recomputed, coalesce(abs(delta - (y.value - x.value)) < 1e-9, false) as matches
from c left join values_ x on x.run_id = baseline_id and x.metric = c.metric left join values_ y on y.run_id = candidate_id and y.metric = c.metric""")
def recomputed_deltas(spark, d):
    """Stored differences, some of them changed, against the runs' own metrics."""
    metrics = _metrics(spark, d).withColumnRenamed("run_id", "artifact_id")
    own = v.comparisons(spark, d).select("artifact_id", "baseline_id", "candidate_id", F.lit("ndcg_at_10").alias("metric"))
    value = lambda c: F.substring(c, 5, 20).cast("long") * 11 % 101 / 100
    changed = F.when(F.substring("artifact_id", 5, 20).cast("long") % 8 == 0, 0.5).otherwise(0.0)
    return _round(population.recomputed_deltas(own.withColumn("delta", value("candidate_id") - value("baseline_id") + changed), metrics))


_STATUSES = "s as (select 'cmp-' || (o_orderkey % 300) as artifact_id, case when o_orderstatus = 'P' then 'REGRESSION' when o_orderpriority = '1-URGENT' then null else 'PASS' end as status, (o_orderkey % 300) % 2 = 0 as passed from orders)"


@query(f"with {_STATUSES} select artifact_id, first(passed) as passed, bool_and(coalesce(status = 'PASS', false)) as recomputed, first(passed) = bool_and(coalesce(status = 'PASS', false)) as matches from s group by 1")
def recomputed_verdicts(spark, d):
    k = F.col("o_orderkey") % 300
    rows = v.table(spark, d, "orders").select(F.concat(F.lit("cmp-"), k.cast("string")).alias("artifact_id"), (k % 2 == 0).alias("passed"), F.when(F.col("o_orderstatus") == "P", "REGRESSION").when(F.col("o_orderpriority") != "1-URGENT", "PASS").alias("status"))
    return population.recomputed_verdicts(rows)


@query(f"with {v.EXAMPLES}, e as (select example_id, case when example_id % 3 = 0 then 'train' else 'test' end as split, case when quality = 1 then 'good' else 'poor' end as quality from examples) select example_id from e where split = 'test' and quality = 'good'")
def eligible_examples(spark, d):
    rows = _examples(spark, d).withColumn("split", F.when(F.col("example_id") % 3 == 0, "train").otherwise("test"))
    return benchmarks.eligible(rows).select("example_id")


@query(f"with {v.ATTEMPTS}, r as (select provider || '-' || example_id as run_id, case when k % 29 = 0 then 'v2' else 'v1' end as model_version from attempts) select run_id, count(distinct model_version) as versions from r group by 1 having count(distinct model_version) > 1")
def model_version_changes(spark, d):
    rows = v.attempts(spark, d).select(F.concat_ws("-", "provider", F.col("example_id").cast("string")).alias("run_id"), F.when(F.col("k") % 29 == 0, "v2").otherwise("v1").alias("model_version"))
    return validate.version_changes(rows)


@query("""with p as (select cast(l_orderkey as varchar) as query_id, list(cast(l_partkey % 40 as varchar) order by l_linenumber) as docs, count(*) - case when l_orderkey % 5 = 0 then 1 else 0 end as n_scores from lineitem group by l_orderkey)
select 'DUPLICATE_DOCUMENT' as code, query_id as record_id from p where len(list_distinct(docs)) <> len(docs) union all select 'SCORES_LENGTH', query_id from p where n_scores <> len(docs)""")
def validate_predictions(spark, d):
    rows = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 40).cast("string").alias("doc")))).alias("rows"))
    scores = F.when(F.col("l_orderkey") % 5 == 0, F.slice("rows", 1, F.size("rows") - 1)).otherwise(F.col("rows"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("query_id"), F.col("rows.doc").alias("retrieved_document_ids"), F.transform(scores, lambda r: r["l_linenumber"].cast("double")).alias("scores"))
    return validate.predictions(rows).select("code", "record_id")


@query(f"""with {v.ATTEMPTS} select event_id, case when label = 'HALLUCINATED' then confidence else round(1 - confidence, 12) end as score, round(1 - case when label = 'HALLUCINATED' then confidence else round(1 - confidence, 12) end, 9) as support from attempts where label is not null""")
def decision_scores(spark, d):
    rows = v.attempts(spark, d).where("label is not null")
    return rows.select("event_id", *[c.alias(n) for n, c in classify.from_decision(F.col("label"), F.col("confidence")).items()]).withColumn("support", F.round("support", 9))


_INFO = """i as (select conv_id, turn, case turn % 4 when 0 then 'QA' when 1 then 'Summary' when 2 then 'Data2txt' else 'else' end as task_type,
  case turn % 4 when 0 then to_json({passages: text, question: role}) when 1 then to_json(text) when 2 then to_json({b: turn, a: role}) else text end as info, text, role from conversations)"""


@query(f"""with {_INFO}, c as (select *, case turn % 4 when 2 then '{{"a":"' || role || '","b":' || turn || '}}' else text end as context from i) select conv_id, turn, context, context as premise from c""")
def source_contexts(spark, d):
    """What a response was given, from objects with passages, strings, other objects and plain text, by family of the task."""
    text, turn = F.col("text"), F.col("turn")
    kind = F.get(F.array(*map(F.lit, ("QA", "Summary", "Data2txt", "else"))), (turn % 4).cast("int"))
    info = F.when(turn % 4 == 0, F.to_json(F.struct(text.alias("passages"), F.col("role").alias("question")))).when(turn % 4 == 1, F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)).when(turn % 4 == 2, F.to_json(F.struct(turn.alias("b"), F.col("role").alias("a")))).otherwise(text)
    rows = v.table(spark, d, "conversations").select("conv_id", "turn", kind.alias("kind"), info.alias("info"))
    rows = rows.withColumn("context", readers.source_context(F.col("info")))
    return rows.select("conv_id", "turn", "context", readers.premise(F.col("kind"), F.col("info"), F.col("context")).alias("premise"))


@query(f"""with {_VALUES}, p as (select unnest(['precision_at_10', 'recall_at_10', 'hit_rate_at_10', 'mrr', 'ndcg_at_10']) as metric), a as (select metric, value from values_ where run_id = 'run-1'), b as (select metric, value from values_ where run_id = 'run-2')
select metric, a.value as current, b.value as baseline, case when a.value is null or b.value is null then 'MISSING' when a.value < b.value then 'REGRESSION' else 'PASS' end as status from p left join a using (metric) left join b using (metric)""")
def workspace_policy(spark, d):
    of = lambda run: _metrics(spark, d).where(F.col("run_id") == run).select("metric", "value")
    return regression.compare(of("run-1"), of("run-2"), regression.rules_frame(spark, regression.retrieval_policy(10))).select("metric", "current", "baseline", "status")


@query(f"""with {v.EXAMPLES}, e as (select example_id, model, case when example_id % 3 = 0 then 'train' else 'test' end as split, case when quality = 1 then 'good' else 'poor' end as quality, case when human = 'HALLUCINATED' then 1 + example_id % 3 else 0 end as spans from examples)
select count(*) as responses, count(distinct model) as sources, count(*) filter (spans > 0) as hallucination_responses, sum(spans)::bigint as hallucination_spans, count(*) filter (split = 'test') as test, count(*) filter (split = 'train') as train, count(*) filter (quality = 'good') as good,
count(*) filter (quality = 'poor') as poor, (select count(*) from documents c join benchmark t on contains(c.text, t.text)) as validation_issues from e""")
def preparation_summary(spark, d):
    rows = _examples(spark, d).select(F.col("model").alias("source_id"), F.when(F.col("example_id") % 3 == 0, "train").otherwise("test").alias("split"), "quality", F.when(F.col("human") == "HALLUCINATED", F.array_repeat(F.lit("s"), (1 + F.col("example_id") % 3).cast("int"))).otherwise(F.array().cast("array<string>")).alias("spans"))
    one = benchmarks.preparation_summary(rows, v.qrels(spark, d))
    of = lambda c, k: F.coalesce(F.try_element_at(c, F.lit(k)), F.lit(0))
    return one.select("responses", "sources", "hallucination_responses", "hallucination_spans", of("split_counts", "test").alias("test"), of("split_counts", "train").alias("train"), of("quality_counts", "good").alias("good"), of("quality_counts", "poor").alias("poor"), "validation_issues")
