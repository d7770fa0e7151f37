"""Operators that no query over the driver's tables shows in full."""

import json

import pytest
from pyspark.sql import functions as F

from gradus.functions import judge
from gradus.operators import classify, evidence, paired, regression, validate
from gradus.sources import readers


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_titles(spark):
    names = spark.createDataFrame([("ndcg_at_10",), ("mrr",), ("mrr_at_5",), ("hit_rate_at_1",), ("false_positive_rate",), ("f1",), ("a_at_b",), ("",), ("x__y",)], "n string").coalesce(1)
    assert [r[0] for r in values(names, evidence.metric_title(F.col("n")))] == ["nDCG@10", "MRR", "MRR@5", "Hit Rate@1", "False Positive Rate", "F1", "A At B", "", "X  Y"]
    labels = spark.createDataFrame([("CURATED_DATASET",), ("not_RUN",), ("",)], "n string").coalesce(1)
    assert [r[0] for r in values(labels, evidence.label_title(F.col("n")))] == ["Curated Dataset", "not Run", ""]
    numbers = spark.createDataFrame([(0.5,), (1.0,), (0.1234,), (0.0006,), (100.0,), (-2.25,), (0.0,)], "x double").coalesce(1)
    assert [r[0] for r in values(numbers, evidence.metric_value(F.col("x")))] == ["0.5", "1", "0.123", "0.001", "100", "-2.25", "0"]
    days = spark.sql("select timestamp '2026-09-03 23:59:59' as t union all select timestamp '2024-01-31 00:00:00'").coalesce(1)
    assert {r[0] for r in values(days, evidence.day_title(F.col("t")))} == {"3 Sept 2026", "31 Jan 2024"}


def test_usage_and_quota(spark):
    whole = {"daily_quota_tokens": 10, "daily_usage_tokens": 2.5, "daily_remaining_tokens": 7, "account": "x"}
    rows = [json.dumps(whole), json.dumps(whole | {"daily_usage_tokens": "2"}), json.dumps(whole | {"daily_usage_tokens": True}), json.dumps({"daily_quota_tokens": 1}), "[]", "no", None]
    got = [r[0] for r in values(spark.createDataFrame([(r,) for r in rows], "q string").coalesce(1), judge.quota_projection(F.col("q")))]
    assert got == [{"daily_quota_tokens": 10.0, "daily_usage_tokens": 2.5, "daily_remaining_tokens": 7.0}, *[None] * 6]
    usage = spark.createDataFrame([({"prompt_tokens": 1.0, "totalCost": 2.0, "id": 3.0},), ({"id": 1.0},), (None,)], "u map<string,double>").coalesce(1)
    assert [r[0] for r in values(usage, judge.usage_projection(F.col("u")))] == [{"prompt_tokens": 1.0, "totalCost": 2.0}, None, None]


def test_catalog_artifact_and_models(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\na\n  \n")
    assert sorted(r[0] for r in readers.catalog(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    (tmp_path / "o.json").write_text('{"x":\n 1}')
    assert readers.artifact(spark, str(tmp_path / "o.json")).selectExpr("variant_get(v, '$.x', 'int') as x").first().x == 1
    for text in ("[1]", "no json", "3"):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(Exception, match="root has to be an object"):
            readers.artifact(spark, str(tmp_path / "bad.json")).collect()
    bodies = [json.dumps(b) for b in ({"data": [{"id": "m1", "api_key": "s"}, {"model": "m2"}]}, [{"name": "m3"}, "m4"], {"result": {"models": [{"id": "m1"}]}}, {"else": 1})]
    got = {r.model_id: r.entry for r in readers.model_catalog(spark, spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert set(got) == {"m1", "m2", "m3", "m4"} and "secret" not in str(got) and "api_key" not in got["m1"]


def test_contexts_and_premises(spark):
    rows = [("QA", '{"question": "q", "passages": "p"}'), ("QA", '{"question": "q"}'), ("Summary", '"text"'), ("Data2txt", '{"b": 1, "a": {"d": 2, "c": [1, 2]}}'), ("Other", "plain text"), ("QA", None)]
    df = spark.createDataFrame(rows, "kind string, info string").coalesce(1).withColumn("context", readers.source_context(F.col("info")))
    got = values(df, "context", readers.premise(F.col("kind"), F.col("info"), F.col("context")))
    assert got == [("p", "p"), ('{"question":"q"}', '{"question":"q"}'), ("text", "text"), *[('{"a":{"c":[1,2],"d":2},"b":1}',) * 2], ("plain text", "plain text"), (None, None)]


def test_decisions_deltas_and_versions(spark):
    df = spark.createDataFrame([("HALLUCINATED", 0.9), ("GROUNDED", 0.7), ("GROUNDED", 1.0)], "l string, c double").coalesce(1)
    found = classify.from_decision(F.col("l"), F.col("c"))
    assert values(df, found["score"]) == [(0.9,), (0.3,), (0.0,)] and [round(r[0], 12) for r in values(df, found["support"])] == [0.1, 0.7, 1.0]
    a, b = (spark.createDataFrame(rows, "metric string, value double") for rows in ([("x", 0.5), ("y", 1.0)], [("x", 0.75), ("z", 1.0)]))
    assert values(paired.metric_deltas(a, b), "metric", "delta") == [("x", 0.25)]
    records = spark.createDataFrame([("r1", "v1"), ("r1", "v1"), ("r2", "v1"), ("r2", "v2"), ("r3", None), ("r3", "v1")], "run_id string, model_version string")
    assert values(validate.version_changes(records), "run_id", "versions") == [("r2", 2)]


def test_policy_and_comparison_artifact(spark):
    assert [r[0] for r in regression.retrieval_policy(5)] == ["precision_at_5", "recall_at_5", "hit_rate_at_5", "mrr", "ndcg_at_5"] and {r[1:] for r in regression.retrieval_policy(5)} == {("higher_is_better", None, None, 0.0)}
    m = lambda **x: spark.createDataFrame(list(x.items()), "metric string, value double")
    base = {"precision_at_5": 0.5, "recall_at_5": 0.5, "hit_rate_at_5": 1.0, "mrr": 0.5, "ndcg_at_5": 0.5}
    compared = regression.compare(m(**(base | {"mrr": 0.4})), m(**base), regression.rules_frame(spark, regression.retrieval_policy(5)))
    one = evidence.comparison_artifact("c1", "a", "b", compared).first()
    assert one.passed is False and [c.metric for c in one.comparisons] == sorted(base) and one.baseline_id == "a"
    failures = spark.createDataFrame([("r2", "A", "x"), ("r1", "B", None), ("r1", "A", "y"), ("r1", "A", None)], "record_ref string, category string, failure_class string")
    assert values(evidence.sorted_failures(failures), "record_ref", "category", "failure_class") == [("r1", "A", None), ("r1", "A", "y"), ("r1", "B", None), ("r2", "A", "x")]
