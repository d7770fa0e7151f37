import inspect
import json
import math

import pytest
from pyspark.sql import functions as F

from gradus.functions import text as tx
from gradus.operators import classify, paired, sampling, thresholds
from gradus.plans import catalog

H, G = "HALLUCINATED", "GROUNDED"
DDL = "example_id string, human string, predicted string, task string, score double"


def test_confusion_and_slices(spark):
    rows = spark.createDataFrame([("a", H, H, "QA", 0.9), ("b", G, G, "QA", 0.1), ("c", G, H, None, 0.8), ("d", H, G, None, 0.2)], DDL)
    one = classify.confusion(rows).first()
    assert (one["tp"], one["tn"], one["fp"], one["fn"]) == (1, 1, 1, 1)
    assert all(one[r] == pytest.approx(0.5) for r in classify.RATES)
    got = {(r.dimension, r.value): r.total for r in classify.slices(rows, ["task"]).collect()}
    assert got == {("all", "all"): 4, ("task", "QA"): 2, ("task", "unknown"): 2}
    assert sorted(classify.errors(rows).collect()) == [("c", "FALSE_POSITIVE"), ("d", "FALSE_NEGATIVE")]
    assert classify.high_confidence_errors(rows).count() == 2


def test_empty_population_is_all_zero(spark):
    one = classify.confusion(spark.createDataFrame([], DDL)).first()
    assert one["total"] == 0 and all(one[r] == 0.0 for r in classify.RATES)


def test_guard(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "example_id string") for ids in (["1", "2", "2"], ["2", "3"]))
    assert sorted(classify.guard_populations(a, b).collect()) == [("DUPLICATE_LABEL", "2"), ("MISSING_PREDICTION", "1"), ("UNKNOWN_EXAMPLE", "3")]


def test_policies(spark):
    row = spark.createDataFrame([([(True,)],), ([],)], "spans array<struct<implicit_true:boolean>>")
    got = row.select(classify.human_label(F.col("spans")).alias("a"), classify.human_label(F.col("spans"), "factual-correctness").alias("b")).collect()
    assert got == [(H, G), (G, G)]


def test_support(spark):
    rows = spark.createDataFrame([("the Cat ไทย9", "cat the"), ("", "x"), ("x", "")], "r string, c string")
    got = [r[0] for r in rows.select(classify.overlap_support(tx.overlap_tokens(F.col("r")), tx.overlap_tokens(F.col("c")))).collect()]
    assert got == [pytest.approx(2 / 3), 1.0, 0.0]


def test_thresholds(spark):
    rows = spark.createDataFrame([(H, 0.2), (G, 0.8)], "human string, support double")
    got = {r.threshold: r for r in thresholds.sweep(rows, [0.9, 0.5, 0.5]).collect()}
    assert got[0.5]["f1"] == 1 and got[0.9]["false_positive_rate"] == 1
    assert thresholds.select_threshold(rows, [0.3, 0.5, 0.7], split="validation").first()["threshold"] == 0.3
    with pytest.raises(ValueError):
        thresholds.select_threshold(rows, [0.3], split="test")


@pytest.mark.parametrize(("b", "c", "p"), [(146, 284, 2.6749e-11), (333, 298, 0.17584), (218, 391, 2.2745e-12), (5, 5, 1.0), (0, 0, 1.0), (700, 760, 0.12253)])
def test_mcnemar(spark, b, c, p):
    counts = spark.createDataFrame([(b, c, 0.0)], "b long, c long, statistic double")
    assert paired.mcnemar(counts).first()["p_value"] == pytest.approx(p, rel=1e-4)


def test_mcnemar_of_many_pairs():
    assert paired.exact_p(10**9, 10**9 + 60_000) == pytest.approx(math.erfc(59_999 / math.sqrt(2 * 2e9)), rel=1e-3)
    assert paired.exact_p(0, 5) == 2 / 32 and paired.exact_p(0, 5000) == 0


def test_pairing(spark):
    a, b = (spark.createDataFrame(x, "example_id string, human string") for x in ([("1", H), ("2", H), ("3", G)], [("1", H), ("2", G), ("4", G)]))
    assert sorted(paired.pairing_violations(a, b).collect()) == [("2", "HUMAN_LABEL_MISMATCH"), ("3", "ONLY_IN_FIRST"), ("4", "ONLY_IN_SECOND")]
    assert sorted(paired.pairing_violations(a, b, subset=True).collect()) == [("2", "HUMAN_LABEL_MISMATCH"), ("3", "ONLY_IN_FIRST")]


def test_common_support(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["x"]), (4, ["a"])], "example_id long, t array<string>")
    context = spark.createDataFrame([("a",), ("z",)], "t string")
    got = lambda c: {r.example_id: r.s for r in classify.with_common_support(rows, "example_id", "t", c, "s").collect()}
    assert got(context) == {1: 0.5, 2: 1.0, 3: 0.0, 4: 1.0} and got(context.limit(0)) == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0}


def test_pairs_and_agreement(spark):
    right = spark.createDataFrame([("1", G, True, True, True), ("2", G, True, False, False), ("3", H, False, True, True), ("4", H, False, False, False)], "example_id string, human string, a boolean, b boolean, c boolean")
    pairs = paired.paired_categories(right, "a", "b")
    assert sorted(r.category for r in pairs.collect()) == ["A_ONLY", "BOTH_CORRECT", "BOTH_WRONG", "B_ONLY"]
    assert paired.discordant(pairs).first()["statistic"] == 0.5
    assert sorted(paired.changes(pairs).collect()) == [("2", "NEW_FALSE_POSITIVE"), ("3", "FIXED_FALSE_NEGATIVE")]
    three = sorted(paired.agreement_three(right, "a", "b", "c").collect())
    assert three == [("1", "ALL_CORRECT"), ("1", "A_AND_B"), ("1", "A_AND_C"), ("1", "B_AND_C"), ("2", "A_ONLY"), ("3", "B_AND_C"), ("4", "ALL_WRONG")]


def test_consistency(spark):
    runs = spark.createDataFrame([("a", G, 0.5), ("a", G, 0.6), ("a", H, 0.7), ("b", H, 0.5), ("b", H, 0.5), ("b", H, 0.5), ("c", H, 0.5), ("c", None, 0.5)], "example_id string, label string, confidence double")
    row = paired.consistency(runs).first()
    assert (row["examples"], row["unanimity"]) == (2, 0.5) and row["pairwise_agreement"] == pytest.approx(4 / 6)


def test_quartiles_are_not_ntile(spark):
    rows = spark.createDataFrame([(str(i), i) for i in range(6)], "example_id string, n int")
    got = {r.example_id: r.quartile for r in classify.length_quartiles(rows, F.col("n")).collect()}
    assert got == {str(i): f"Q{min(3, i * 4 // 6) + 1}" for i in range(6)}


def test_calibration(spark):
    rows = spark.createDataFrame([(1.0, True), (0.05, False)], "p double, y boolean")
    bins = {r.bin: r.n for r in classify.calibration_bins(rows, F.col("p"), F.col("y")).collect()}
    assert len(bins) == 10 and bins[9] == 1 and bins[0] == 1
    assert classify.calibration(rows, F.col("p"), F.col("y")).first()["brier"] == pytest.approx(0.05**2 / 2)


def test_sample_and_bootstrap(spark):
    rows = spark.createDataFrame([(str(i), "x" if i % 3 else "y") for i in range(60)], "example_id string, s string")
    pick = lambda n: sorted(r.example_id for r in sampling.stratified(rows.repartition(n), ["s"], 5, 1).collect())
    assert pick(1) == pick(7) and len(pick(1)) == 10
    scored = spark.createDataFrame([(H, H, G)] * 30 + [(G, G, G)] * 30 + [(H, G, H)] * 5, "human string, a string, b string")
    low, high = next((r.low, r.high) for r in sampling.bootstrap(scored, replicates=500).collect() if r.metric == "a_recall")
    assert low < 30 / 35 < high and high - low < 0.4
    assert sampling.bootstrap(scored.limit(0)).count() == 0


def test_spans(spark):
    row = spark.createDataFrame([(2, 6, 4, 8)], "a long, b long, c long, d long").select(tx.span_overlap(*map(F.col, "abcd")), tx.span_iou(*map(F.col, "abcd"))).first()
    assert row[0] == 2 and row[1] == pytest.approx(1 / 3)
    rows = spark.createDataFrame([("abcé", 0, 4, "abcé"), ("abc", 2, 1, ""), ("abc", 0, 9, "abc"), ("abc", 0, 2, "xx"), ("abc", 5, 9, "")], "t string, s long, e long, q string")
    got = [r[0] for r in rows.select(tx.span_issues(F.col("t"), F.col("s"), F.col("e"), F.col("q"))).collect()]
    assert got == [[], ["END_BEFORE_START"], ["END_OUT_OF_RANGE"], ["TEXT_OFFSET_MISMATCH"], ["END_OUT_OF_RANGE", "START_OUT_OF_RANGE"]]


def test_registered_bootstrap_draws_the_default(spark, monkeypatch):
    seen, real = [], sampling.bootstrap
    monkeypatch.setattr(sampling, "bootstrap", lambda rows, **own: seen.append(inspect.signature(real).bind(rows, **own)) or real(rows, **own))
    assert catalog.QUERIES["bootstrap_ci"](spark, "/root/testdata/sf0.001").count() == 12
    seen[0].apply_defaults()
    assert seen[0].arguments["replicates"] == 10_000


def test_registered_consistency_counts_all_attempts(spark, tmp_path):
    ks = {1: [7] * 24 + [1, 2, 3], 2: [1, 2, 4] + [7] * 21 + [1], 3: [3, 6, 9]}  # a multiple of 7 is an attempt without a decision
    rows = [(100 * user + i, user, "click", float(i), f'{{"k": {k}}}') for user, own in ks.items() for i, k in enumerate(own)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    row = catalog.QUERIES["consistency_three_runs"](spark, str(tmp_path)).first()
    decided = {}
    for i, _, _, _, props in rows:
        if (k := json.loads(props)["k"]) != 7:
            decided.setdefault(i // 6, []).append(k % 3 == 0)
    three = [x for x in decided.values() if len(x) == 3]
    agree = sum(x[i] == x[j] for x in three for i, j in ((0, 1), (0, 2), (1, 2))) / (3 * len(three))
    assert len(three) > 1 and (row["examples"], row["pairwise_agreement"], row["unanimity"]) == (len(three), round(agree, 9), round(sum(len(set(x)) == 1 for x in three) / len(three), 9))
