"""The evaluation tables that the named queries derive from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions.text import overlap_tokens
from gradus.operators import classify, population, retrieval

K = 10
JOB_STATES = ("QUEUED", "VALIDATING", "EVALUATING", "ANALYZING", "WRITING_ARTIFACT", "COMPLETE", "FAILED", "CANCELLED", "INTERRUPTED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def corpus(spark, d) -> DataFrame:
    """All documents."""
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")


def rank_a(spark, d) -> DataFrame:
    return retrieval.bm25(corpus(spark, d), topics(spark, d), K)


def rank_b(spark, d) -> DataFrame:
    return retrieval.shared_tokens(corpus(spark, d), topics(spark, d), K)


def qrels(spark, d) -> DataFrame:
    """A document is relevant to a topic whose text it contains.

    The longest words inside a topic (not at its ends, which may be parts of words) have to be words of the document: documents that have them all are looked
    up by word, without their texts, and only those are read again and checked."""
    words = F.split("text", r"\s+")
    inside = F.array_distinct(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != ""))
    longest = F.slice(F.sort_array(F.transform(inside, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))), asc=False), 1, 3)
    asked = topics(spark, d).select("query_id", F.col("text").alias("topic"), longest["word"].alias("anchors"))
    anchors = asked.select("query_id", F.size("anchors").alias("n"), F.explode("anchors").alias("word"))
    docs = corpus(spark, d)
    have = docs.select("document_id", F.explode(F.array_distinct(words)).alias("word")).join(anchors, "word")
    pairs = have.groupBy("query_id", "document_id").agg(F.count("*").alias("found"), F.first("n").alias("n")).where("found = n").select("query_id", "document_id")
    found = docs.join(pairs, "document_id").join(asked, "query_id").where("contains(text, topic)").select("query_id", "document_id")
    bare = asked.where("size(anchors) = 0")
    if bare.take(1):  # topics of one or two words have no word inside
        found = found.unionByName(docs.join(F.broadcast(bare), F.expr("contains(text, topic)")).select("query_id", "document_id"))
    return found.withColumn("relevance", F.lit(1).cast("long"))


def examples(spark, d) -> DataFrame:
    """Labelled documents with two supports and meta data: example_id, task_type, model, quality, human, human_quality, n_chars, support_a, support_b, support_c.

    The common context is all tokens of the benchmark: a table to join with, not a list to carry along."""
    context = table(spark, d, "benchmark").select(F.explode(overlap_tokens(F.col("text"))).alias("t")).distinct()
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    docs = docs.select(F.col("doc_id").alias("example_id"), F.col("lang").alias("task_type"), F.col("source").alias("model"), "quality", "toxic", "n_chars", overlap_tokens(F.col("text")).alias("t"))
    docs = classify.with_common_support(docs, "example_id", "t", context, "support_a")
    c = F.pmod(F.col("example_id") * 37, F.lit(101)) / 100
    human = F.when(F.col("toxic") == 1, classify.POSITIVE).otherwise(classify.NEGATIVE)
    return docs.select("example_id", "task_type", "model", "quality", "n_chars", human.alias("human"), "support_a", ((F.col("n_chars") % 100) / 100).alias("support_b"), F.least(c, F.lit(1.0)).alias("support_c"))


def scored(spark, d, which: str = "a", threshold: float = 0.4) -> DataFrame:
    rows = examples(spark, d)
    return rows.withColumns(classify.from_support(F.col(f"support_{which}"), threshold))


def predictions(spark, d) -> DataFrame:
    """(evaluator, example_id, predicted, score) of three evaluators, and their labels."""
    rows = examples(spark, d)
    each = F.array(*[F.struct(F.lit(n).alias("evaluator"), *[v.alias(k) for k, v in classify.from_support(F.col(f"support_{n}"), t).items()]) for n, t in (("a", 0.4), ("b", 0.4), ("c", 0.3))])
    return rows.select("example_id", "human", F.inline(each))


def turns(spark, d) -> DataFrame:
    """(example_id, context, response): a user's turn and the assistant's that follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("response"))
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"), F.col("text").alias("context"), "response")


def attempts(spark, d) -> DataFrame:
    """Events as a provider's attempts: event type as provider, user as example, value as latency, k of the properties as usage and success."""
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("provider"), F.col("user_id").alias("example_id"), F.row_number().over(w).alias("attempt"), "event_id", "ts", F.col("value").alias("latency_ms"), F.coalesce(k, F.lit(0)).alias("k")
    )
    status = F.when(F.col("k") % 7 == 0, 429).when(F.col("k") % 11 == 0, 503).when(F.col("k") % 13 == 0, 401).otherwise(200)
    rows = rows.withColumn("http_status", status)
    ok = F.col("http_status") == 200
    return rows.select(
        "provider", "example_id", "attempt", "event_id", "ts", "latency_ms", "k", "http_status", ok.alias("api_success"), (ok & (F.col("k") % 5 != 0)).alias("parse_success"),
        F.when(ok & (F.col("k") % 5 != 0), "SUCCESS").otherwise("FAILED").alias("status"),
        F.when(ok & (F.col("k") % 5 != 0), F.when(F.col("k") % 3 == 0, "HALLUCINATED").otherwise("GROUNDED")).alias("label"), ((F.col("k") % 50) / 50 * 0.5 + 0.5).alias("confidence"),
    )


def job_log(spark, d) -> DataFrame:
    """A log made of events: a job for each user and event type, its revisions in order of time."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    states = F.array(*map(F.lit, JOB_STATES))
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.row_number().over(w).alias("n"))
    return rows.select(
        F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("job_id"), F.col("user_id").cast("string").alias("run_id"), F.col("n").cast("long").alias("revision"),
        F.when(F.col("n") == 1, "QUEUED").otherwise(F.get(states, (F.col("event_id") % len(JOB_STATES)).cast("int"))).alias("state"), (F.col("event_id") % 4 == 0).alias("cancel_requested"), F.col("event_id").alias("created_at"),
    )


def runs(spark, d) -> DataFrame:
    """Published runs, one for each supplier: artifact_id, claims and the metadata that makes a population."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = table(spark, d, "supplier").select(
        F.concat(F.lit("run-"), k.cast("string")).alias("artifact_id"), F.lit("run").alias("artifact_type"), pick(("VERIFIED", "PARTIAL", "UNVERIFIED", "NOT_RUN"), k % 4).alias("verification_status"),
        pick(population.DATA_KINDS, F.floor(k / 4) % 3).alias("data_kind"), pick(population.CLAIM_SCOPES, n % 3).alias("claim_scope"), F.lit("documents").alias("dataset_name"),
        F.when(k % 10 == 3, "2").otherwise("1").alias("dataset_version"), F.when(k % 5 != 0, "r1").alias("dataset_revision"), F.when(k % 11 == 0, "hallucination").otherwise("retrieval").alias("evaluation_type"),
        F.lit("passages").alias("benchmark"), F.when(n % 7 == 0, "th").otherwise("en").alias("language"), F.lit("test").alias("split"), F.when(k % 9 == 0, 5).otherwise(10).cast("int").alias("top_k"),
        F.when(n % 8 == 1, "retrieval=2").otherwise("retrieval=1").alias("evaluator_versions"),
    )
    return rows


def comparisons(spark, d) -> DataFrame:
    """Published comparisons, one for each customer, between two of ``runs`` or, now and then, with one that isn't there."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by.cast("int"))
    k = F.col("c_custkey")
    name = lambda x: F.concat(F.lit("run-"), x.cast("string"))
    return table(spark, d, "customer").select(
        F.concat(F.lit("cmp-"), k.cast("string")).alias("artifact_id"), F.lit("comparison").alias("artifact_type"), name(k % 97).alias("baseline_id"), name((k * 7) % 103).alias("candidate_id"),
        pick(("UNVERIFIED", "PARTIAL", "VERIFIED"), k % 3).alias("verification_status"), pick(population.DATA_KINDS, F.col("c_nationkey") % 3).alias("data_kind"), pick(population.CLAIM_SCOPES, F.floor(k / 3) % 3).alias("claim_scope"),
        pick(("MATCHED", "UNVERIFIED", "INCOMPATIBLE"), k % 3).alias("population_compatibility"), F.when(F.col("c_acctbal") < 0, "REGRESSION").otherwise("PASS").alias("result"),
    )


def local_runs(spark, d) -> DataFrame:
    """The same runs as local ones, with configuration and fingerprints: run_id and what ``population.compatibility`` reads."""
    k = F.substring("artifact_id", 5, 20).cast("long")
    none = F.lit(None).cast("string")
    return runs(spark, d).select(
        F.col("artifact_id").alias("run_id"), F.lit("workspace-run-v1").alias("schema_version"), F.when(k % 14 == 2, "ws-2").otherwise("ws-1").alias("workspace_id"), "evaluation_type", F.when(k % 3 == 0, "strict-groundedness").otherwise(none).alias("annotation_policy"),
        "benchmark", "dataset_name", "dataset_revision", "dataset_version", F.lit("k1=1.2").alias("evaluator_config"), "evaluator_versions", "language", F.lit("good").alias("quality_filter"), "split", "top_k",
        (k % 13 != 0).alias("identity_valid"), F.when(k % 17 != 0, F.concat(F.lit("t"), (k % 2).cast("string"))).alias("truth_fingerprint"), F.when(k % 17 != 0, F.concat(F.lit("q"), (k % 2).cast("string"))).alias("query_fingerprint"),
        F.when(k % 6 == 0, "other").otherwise(F.concat(F.lit("q"), (k % 2).cast("string"))).alias("prediction_fingerprint"), F.lit(40).alias("prediction_count"), F.when(k % 8 == 0, 39).otherwise(40).alias("reported_count"),
    )


RUNS = """
runs as (select 'run-' || s_suppkey as artifact_id, 'run' as artifact_type, ['VERIFIED', 'PARTIAL', 'UNVERIFIED', 'NOT_RUN'][s_suppkey % 4 + 1] as verification_status,
  ['SYNTHETIC_FIXTURE', 'CURATED_DATASET', 'OFFICIAL_BENCHMARK'][(s_suppkey // 4) % 3 + 1] as data_kind, ['INTEGRATION_ONLY', 'PROTOCOL_SPECIFIC', 'BENCHMARK_RESULT'][s_nationkey % 3 + 1] as claim_scope,
  'documents' as dataset_name, case when s_suppkey % 10 = 3 then '2' else '1' end as dataset_version, case when s_suppkey % 5 <> 0 then 'r1' end as dataset_revision,
  case when s_suppkey % 11 = 0 then 'hallucination' else 'retrieval' end as evaluation_type, 'passages' as benchmark, case when s_nationkey % 7 = 0 then 'th' else 'en' end as language, 'test' as split,
  case when s_suppkey % 9 = 0 then 5 else 10 end as top_k, case when s_nationkey % 8 = 1 then 'retrieval=2' else 'retrieval=1' end as evaluator_versions, s_suppkey as k from supplier),
comparisons as (select 'cmp-' || c_custkey as artifact_id, 'comparison' as artifact_type, 'run-' || (c_custkey % 97) as baseline_id, 'run-' || ((c_custkey * 7) % 103) as candidate_id,
  ['UNVERIFIED', 'PARTIAL', 'VERIFIED'][c_custkey % 3 + 1] as verification_status, ['SYNTHETIC_FIXTURE', 'CURATED_DATASET', 'OFFICIAL_BENCHMARK'][c_nationkey % 3 + 1] as data_kind,
  ['INTEGRATION_ONLY', 'PROTOCOL_SPECIFIC', 'BENCHMARK_RESULT'][(c_custkey // 3) % 3 + 1] as claim_scope, ['MATCHED', 'UNVERIFIED', 'INCOMPATIBLE'][c_custkey % 3 + 1] as population_compatibility,
  case when c_acctbal < 0 then 'REGRESSION' else 'PASS' end as result from customer)"""
TOPICS = "topics as (select cast(item_id as varchar) as query_id, text from benchmark)"
CORPUS = "corpus as (select cast(doc_id as varchar) as document_id, text from documents)"
# the tables' letters beyond ASCII are Latin ones, which normalisation leaves alone and of which only ß folds to others
TOKENS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]+|[0-9]+(?:[.,][0-9]+)?')"
RANK_A = f"""
{TOPICS}, {CORPUS},
toks as (select document_id, {TOKENS} as terms from corpus),
lens as (select document_id, len(terms) as length from toks),
stats as (select count(*) as n_docs, avg(length) as avg_length from lens),
post as (select token, document_id, count(*) as tf from (select document_id, unnest(terms) as token from toks) group by all),
qt as (select distinct query_id, unnest({TOKENS}) as token from topics),
idf as (select token, ln(1 + (n_docs - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf from post, stats group by token, n_docs),
parts as (select query_id, document_id, token, idf * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * length / avg_length)) as part
          from qt join post using (token) join idf using (token) join lens using (document_id), stats),
scores_a as (select query_id, document_id, sum(part order by token) as score from parts group by all),
rank_a as (select * from (select *, row_number() over (partition by query_id order by score desc, document_id) as rank from scores_a) where rank <= {K})"""
RANK_B = f"""rank_b as (select * from (select query_id, document_id, count(*)::double as score, row_number() over (partition by query_id order by count(*) desc, document_id) as rank
          from qt join post using (token) group by query_id, document_id) where rank <= {K})"""
QRELS = "qrels as (select query_id, document_id, 1::bigint as relevance from topics t join corpus c on contains(c.text, t.text))"
OVERLAP = r"list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[\p{L}\p{N}]+'), lambda x: lower(x)))"
EXAMPLES = f"""
context as (select list(distinct t) as context from (select unnest({OVERLAP}) as t from benchmark)),
labelled as (select doc_id as example_id, lang as task_type, source as model, quality, toxic, n_chars, {OVERLAP} as t from documents join labels using (doc_id)),
examples as (select example_id, task_type, model, quality, n_chars, case when toxic = 1 then 'HALLUCINATED' else 'GROUNDED' end as human,
  case when len(t) = 0 then 1.0::double when len(context) = 0 then 0.0::double else len(list_intersect(t, context))::double / len(t) end as support_a,
  (n_chars % 100)::double / 100 as support_b, least(((example_id * 37) % 101)::double / 100, 1.0::double) as support_c from labelled, context)"""
SCORED = f"""{EXAMPLES},
scored as (select *, support_a as support, case when support_a >= 0.4::double then 'GROUNDED' else 'HALLUCINATED' end as predicted, round(1 - support_a, 12) as score from examples)"""
PREDICTIONS = f"""{EXAMPLES},
predictions as (
  select 'a' as evaluator, example_id, human, case when support_a >= 0.4::double then 'GROUNDED' else 'HALLUCINATED' end as predicted, 1 - support_a as score from examples union all
  select 'b', example_id, human, case when support_b >= 0.4::double then 'GROUNDED' else 'HALLUCINATED' end, 1 - support_b from examples union all
  select 'c', example_id, human, case when support_c >= 0.3::double then 'GROUNDED' else 'HALLUCINATED' end, 1 - support_c from examples),
correct as (select example_id, human, bool_or(predicted = human) filter (evaluator = 'a') as a, bool_or(predicted = human) filter (evaluator = 'b') as b, bool_or(predicted = human) filter (evaluator = 'c') as c from predictions group by all)"""
ATTEMPTS = """
raw as (select event_type as provider, user_id as example_id, row_number() over (partition by event_type, user_id order by ts, event_id) as attempt, event_id, ts, value as latency_ms,
  coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k from events),
coded as (select *, case when k % 7 = 0 then 429 when k % 11 = 0 then 503 when k % 13 = 0 then 401 else 200 end as http_status from raw),
attempts as (select *, http_status = 200 as api_success, http_status = 200 and k % 5 <> 0 as parse_success, case when http_status = 200 and k % 5 <> 0 then 'SUCCESS' else 'FAILED' end as status,
  case when http_status = 200 and k % 5 <> 0 then case when k % 3 = 0 then 'HALLUCINATED' else 'GROUNDED' end end as label, (k % 50)::double / 50 * 0.5::double + 0.5::double as confidence from coded)"""
JOBS = """
nth as (select user_id, event_type, event_id, ts, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
log as (select user_id || '-' || event_type as job_id, cast(user_id as varchar) as run_id, n::bigint as revision,
  case when n = 1 then 'QUEUED' else ['QUEUED', 'VALIDATING', 'EVALUATING', 'ANALYZING', 'WRITING_ARTIFACT', 'COMPLETE', 'FAILED', 'CANCELLED', 'INTERRUPTED'][event_id % 9 + 1] end as state, event_id % 4 = 0 as cancel_requested, event_id as created_at from nth)"""
CELLS = """count(*) as total, count(*) filter (human = 'HALLUCINATED' and predicted = 'HALLUCINATED') as tp, count(*) filter (human <> 'HALLUCINATED' and predicted <> 'HALLUCINATED') as tn,
  count(*) filter (human <> 'HALLUCINATED' and predicted = 'HALLUCINATED') as fp, count(*) filter (human = 'HALLUCINATED' and predicted <> 'HALLUCINATED') as fn"""
_R = "coalesce(({})::double / nullif({}, 0), 0.0)"
RATES = ", ".join(
    f"round({e}, 9) as {n}"
    for n, e in (
        ("precision", _R.format("tp", "tp + fp")), ("recall", _R.format("tp", "tp + fn")), ("accuracy", _R.format("tp + tn", "tp + tn + fp + fn")), ("specificity", _R.format("tn", "tn + fp")),
        ("f1", _R.format("2 * tp", "2 * tp + fp + fn")), ("balanced_accuracy", "(" + _R.format("tp", "tp + fn") + " + " + _R.format("tn", "tn + fp") + ") / 2"),
        ("false_positive_rate", _R.format("fp", "fp + tn")), ("false_negative_rate", _R.format("fn", "fn + tp")),
    )
)
