"""Policy-driven regression decisions over long metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_DDL = "metric string, direction string, minimum_acceptable double, maximum_acceptable double, max_degradation double"


def rules_frame(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    if not rules:
        raise ValueError("a policy needs at least one rule")
    for name, direction, low, high, allowed in rules:
        if direction not in ("higher_is_better", "lower_is_better"):
            raise ValueError(f"{name}: no such direction: {direction}")
        for x in (low, high, allowed):
            if isinstance(x, bool) or (x is not None and not (isinstance(x, (int, float)) and abs(x) < float("inf"))):
                raise ValueError(f"{name}: limits have to be finite numbers")
        if allowed is None or allowed < 0:
            raise ValueError(f"{name}: the allowed degradation has to be 0 or more")
    f = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(n, d, f(a), f(b), f(c)) for n, d, a, b, c in rules], RULES_DDL)


def retrieval_policy(k: int) -> list[tuple]:
    """Five rules, higher is better, nothing lost."""
    return [(name if name == "mrr" else f"{name}_at_{k}", "higher_is_better", None, None, 0.0) for name in ("precision", "recall", "hit_rate", "mrr", "ndcg")]


def compare(current: DataFrame, baseline: DataFrame, rules: DataFrame) -> DataFrame:
    """(metric, current, baseline, degradation, status, reason). ``current`` and ``baseline``: metric, value.

    In this order: not finite, missing now, beyond an acceptable limit of its direction, missing before, worse by more than allowed.
    Exactly the allowed degradation passes."""
    rows = rules.join(current.select("metric", F.col("value").alias("current")), "metric", "left").join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "left")
    odd = lambda c: F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")))
    higher = F.col("direction") == "higher_is_better"
    degradation = F.when(higher, F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    # the limit is taken from the baseline first: in floating point, exactly the allowed degradation then passes
    worse = F.when(higher, F.col("current") < F.col("baseline") - F.col("max_degradation")).otherwise(F.col("current") > F.col("baseline") + F.col("max_degradation"))
    reason = (
        F.when(odd("current") | odd("baseline"), "NOT_FINITE")
        .when(F.col("current").isNull(), "MISSING_CURRENT")
        .when(higher & (F.col("current") < F.col("minimum_acceptable")), "BELOW_MINIMUM")
        .when(~higher & (F.col("current") > F.col("maximum_acceptable")), "ABOVE_MAXIMUM")
        .when(F.col("baseline").isNull(), "MISSING_BASELINE")
        .when(worse, "DEGRADED")
        .otherwise("OK")
    )
    status = F.when(F.col("reason") == "OK", "PASS").when(F.col("reason").startswith("MISSING"), "MISSING").when(F.col("reason") == "NOT_FINITE", "ERROR").otherwise("REGRESSION")
    return rows.withColumns({"degradation": degradation, "reason": reason}).withColumn("status", status).select("metric", "current", "baseline", "degradation", "status", "reason")


def verdict(compared: DataFrame) -> DataFrame:
    """One row: passed (every rule passes, so a missing metric fails), regressions, missing."""
    return compared.agg(F.coalesce(F.every(F.col("status") == "PASS"), F.lit(False)).alias("passed"), F.expr("count_if(status = 'REGRESSION')").alias("regressions"), F.expr("count_if(status = 'MISSING')").alias("missing"))
