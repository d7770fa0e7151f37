import math
import random

import pytest
from pyspark.sql import functions as F

from gradus.operators import classify, order, providers


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    # a hot group, a hot value, nulls, and groups of one row
    made = [("hot", draw.choice([7.0, 7.0, 7.0, draw.random() * 100]), i) for i in range(3000)] + [(f"g{i % 40}", float(draw.randint(0, 9)), 3000 + i) for i in range(400)]
    return made + [(None, 1.5, 9000), (None, None, 9001), ("none", None, 9002), ("one", 4.0, 9003)]


def nearest(values, p):
    values = sorted(values)
    return values[max(0, math.ceil(p * len(values)) - 1)]


def linear(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (values[math.ceil(at)] - values[low]) * (at - low)


def test_percentiles(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(7)
    by = {}
    for g, v, _ in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for exact, how in ((nearest, False), (linear, True)):
        got = {r.g: r for r in order.percentiles(df, "v", ps, "g", linear=how).collect()}
        assert set(got) == set(by)
        assert all(got[g][n] == pytest.approx(exact(v, p), abs=1e-12) for g, v in by.items() for n, p in ps.items())
        one = order.percentiles(df, "v", ps, linear=how).first()
        every = [v for v in (r[1] for r in rows) if v is not None]
        assert all(one[n] == pytest.approx(exact(every, p), abs=1e-12) for n, p in ps.items())
    assert order.percentiles(df.limit(0), "v", ps, "g").count() == 0


def test_latency_of_nothing(spark, rows):
    df = spark.createDataFrame(rows, "g string, latency_ms double, id long")
    none = providers.latency(df.where("g = 'none'")).first()
    assert (none["count"], none["mean"], none.p50, none.p95) == (0, 0.0, 0.0, 0.0)
    by = {r.g: r for r in providers.latency(df, "g").collect()}
    assert by["none"].p95 == 0.0 and by[None].p50 == 1.5 and by["hot"]["count"] == 3000


def test_numbered_and_running(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(5)
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=key), 1)}
    placed = order.numbered(df, F.desc("v"), F.asc("id"))
    assert {r.id: r.place for r in placed.collect()} == want and placed.columns == [*df.columns, "place"]
    sums = order.running(df, [F.col("id")], {"nth": F.lit(1), "total": F.col("id") % 3}, partition=["g"])
    seen: dict = {}
    for g, _, i in sorted(rows, key=lambda r: r[2]):
        n, t = seen.get(g, [(0, 0)])[-1]
        seen.setdefault(g, [(0, 0)]).append((n + 1, t + i % 3))
    assert {(r.g, r.nth, r.total) for r in sums.collect()} == {(g, *x) for g, own in seen.items() for x in own[1:]}
    assert order.numbered(df.limit(0), F.col("id")).count() == 0
    # ranges hold the rows; only one row for each range meets in one task
    assert "rangepartitioning" in plan(df.repartitionByRange("v", "id")) and "row_number" not in plan(placed)


def test_quartiles_of_one_length(spark):
    df = spark.range(1000).select(F.col("id").alias("example_id"), F.when(F.col("id") < 990, 5).otherwise(F.col("id")).cast("long").alias("n"))
    got = {r.example_id: r.quartile for r in classify.length_quartiles(df, F.col("n")).collect()}
    assert got == {i: f"Q{1 + min(3, i * 4 // 1000)}" for i in range(1000)}


def test_breaker_counts_missing_predictions(spark):
    rows = [("parse", i, True, None) for i in range(12)] + [("fine", i, True, "GROUNDED") for i in range(300)]
    rows += [("late", i, True, None if i in (3, 50, 98) else "GROUNDED") for i in range(150)] + [("api", i, i % 9 > 0, "GROUNDED" if i % 9 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "provider string, nth_call long, api_success boolean, label string").repartition(6)
    got = {r.provider: r.stop_at for r in providers.full_run_breaker(df, "provider", ["nth_call"]).collect()}
    assert got == {"parse": 10, "fine": None, "late": 100, "api": 82}


def test_rate_limit_words(spark):
    cases = [("x requestsPerDay y", "RPD"), ("requests_per_day", "RPD"), ("RPD", "RPD"), ("TokensPerMinute and rpm", "TPM"), ("tokens_per_minute", "TPM"), ("requestsPerMinute", "RPM"), ("rpm", "RPM"), ("other", "OTHER"), (None, "OTHER")]
    df = spark.createDataFrame([(429, e, w) for e, w in cases] + [(500, "rpd", None)], "status int, error string, want string")
    assert df.where(~providers.rate_limit_dimension(F.col("status"), F.col("error")).eqNullSafe(F.col("want"))).count() == 0
