"""Two and more evaluators on the same examples: paired categories, exact McNemar, agreement maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def correctness(labels: DataFrame, predictions: DataFrame, names: Sequence[str]) -> DataFrame:
    """(example_id, human, one boolean per evaluator): examples that all evaluators decided. ``predictions``: evaluator, example_id, predicted."""
    picks = [F.max(F.when(F.col("evaluator") == n, F.col("predicted"))).alias(n) for n in names]
    wide = predictions.where(F.col("evaluator").isin(*names)).groupBy("example_id").agg(*picks)
    both = labels.select("example_id", "human").join(wide, "example_id")
    return both.where(F.expr(" and ".join(f"`{n}` is not null" for n in names))).select("example_id", "human", *[(F.col(n) == F.col("human")).alias(n) for n in names])


def missing_by_evaluator(labels: DataFrame, predictions: DataFrame, names: Sequence[str]) -> DataFrame:
    spark = labels.sparkSession
    every = labels.select("example_id").crossJoin(F.broadcast(spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("evaluator"))))
    return every.join(predictions.select("example_id", "evaluator"), ["example_id", "evaluator"], "left_anti")


def paired_categories(correct: DataFrame, a: str, b: str) -> DataFrame:
    category = F.when(F.col(a) & F.col(b), "BOTH_CORRECT").when(F.col(a), "A_ONLY").when(F.col(b), "B_ONLY").otherwise("BOTH_WRONG")
    return correct.select("example_id", "human", category.alias("category"))


def changes(paired: DataFrame, positive: str = "HALLUCINATED") -> DataFrame:
    """(example_id, change): false positives and negatives that the second evaluator fixed or added."""
    kind = F.when(F.col("human") == positive, "FALSE_NEGATIVE").otherwise("FALSE_POSITIVE")
    change = F.when(F.col("category") == "B_ONLY", F.concat(F.lit("FIXED_"), kind)).when(F.col("category") == "A_ONLY", F.concat(F.lit("NEW_"), kind))
    return paired.select("example_id", change.alias("change")).where("change is not null")


def discordant(paired: DataFrame) -> DataFrame:
    """One row: b (only the first is right), c (only the second), and McNemar's statistic with continuity correction, not floored."""
    n = paired.agg(F.expr("count_if(category = 'A_ONLY')").alias("b"), F.expr("count_if(category = 'B_ONLY')").alias("c"))
    total = F.col("b") + F.col("c")
    return n.withColumn("statistic", F.when(total == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2)) / total))


def exact_p(b: int, c: int) -> float:
    """Twice the binomial tail up to the smaller count, at most 1.

    The tail's terms fall from the largest, so they are added from there until they no longer count: some square root of the discordant pairs, and no
    factorial overflows."""
    n, low = b + c, min(b, c)
    if n == 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2))
    total, i = 0.0, low
    while term > total * 1e-18 and i >= 0:
        total += term
        term *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * total)


@F.pandas_udf(T.DoubleType())
def _exact_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([exact_p(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")


def mcnemar(counts: DataFrame) -> DataFrame:
    """``counts`` (b, c, statistic) with the exact two-sided p."""
    return counts.withColumn("p_value", _exact_p("b", "c"))


def pairing_violations(first: DataFrame, second: DataFrame, *, subset: bool = False) -> DataFrame:
    """(example_id, code) of two artifacts (example_id, human) that can't be paired: ids of one side only, and other human labels. With ``subset`` the second
    may have more ids than the first, as a baseline that a pilot is compared with."""
    both = first.select("example_id", F.col("human").alias("a")).join(second.select("example_id", F.col("human").alias("b")), "example_id", "full_outer")
    extra = F.when(F.col("a").isNull() & F.lit(not subset), "ONLY_IN_SECOND")
    code = F.when(F.col("b").isNull(), "ONLY_IN_FIRST").when(F.col("a").isNotNull() & (F.col("a") != F.col("b")), "HUMAN_LABEL_MISMATCH").otherwise(extra)
    return both.select("example_id", code.alias("code")).where("code is not null")


def agreement_three(correct: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """(example_id, category): who is right. The categories of pairs hold the examples that all three have right as well."""
    n = F.col(a).cast("int") + F.col(b).cast("int") + F.col(c).cast("int")
    tags = F.array(
        F.when(n == 3, "ALL_CORRECT"), F.when(n == 0, "ALL_WRONG"),
        F.when((n == 1) & F.col(a), f"{a.upper()}_ONLY"), F.when((n == 1) & F.col(b), f"{b.upper()}_ONLY"), F.when((n == 1) & F.col(c), f"{c.upper()}_ONLY"),
        *[F.when(F.col(x) & F.col(y), f"{x.upper()}_AND_{y.upper()}") for x, y in ((a, b), (a, c), (b, c))],
    )
    return correct.select("example_id", F.explode(F.array_compact(tags)).alias("category"))


def agreement_many(correct: DataFrame, names: Sequence[str]) -> DataFrame:
    """(example_id, category) for any number of evaluators: all, none, exactly one, exactly two (named), or how many."""
    right = F.array_compact(F.array(*[F.when(F.col(n), n.upper()) for n in names]))
    n = F.size(right)
    category = F.when(n == len(names), "ALL_CORRECT").when(n == 0, "ALL_WRONG").when(n == 1, F.concat(right[0], F.lit("_ONLY"))).when(n == 2, F.array_join(right, "_AND_")).otherwise(F.concat(n.cast("string"), F.lit("_CORRECT")))
    return correct.select("example_id", category.alias("category"))


def metric_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(metric, baseline, candidate, delta) of metrics that both have."""
    return baseline.select("metric", F.col("value").alias("baseline")).join(candidate.select("metric", F.col("value").alias("candidate")), "metric").withColumn("delta", F.col("candidate") - F.col("baseline"))


def consistency(runs: DataFrame, repeats: int = 3) -> DataFrame:
    """One row over repeated decisions (example_id, label, confidence): examples with exactly ``repeats`` decided runs, agreement of
    pairs, unanimity, mean and range of confidence."""
    per = runs.where("label is not null").groupBy("example_id").agg(
        F.count("*").alias("n"), F.expr("count_if(label = 'HALLUCINATED')").alias("h"), F.avg("confidence").alias("mean"), (F.max("confidence") - F.min("confidence")).alias("range")
    ).where(F.col("n") == repeats)
    g = F.col("n") - F.col("h")
    matches = (F.col("h") * (F.col("h") - 1) + g * (g - 1)) / 2
    pairs = repeats * (repeats - 1) / 2
    return per.agg(
        F.count("*").alias("examples"), F.coalesce(F.sum(matches) / (F.count("*") * pairs), F.lit(0.0)).alias("pairwise_agreement"),
        F.coalesce(F.avg(((F.col("h") == 0) | (g == 0)).cast("double")), F.lit(0.0)).alias("unanimity"), F.avg("mean").alias("mean_confidence"), F.max("range").alias("max_confidence_range"),
    )
