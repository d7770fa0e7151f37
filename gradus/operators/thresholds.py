"""Threshold sweeps over support scores, and the choice of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators.classify import NEGATIVE, POSITIVE, cells, with_rates


def sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, counts, rates): a row is called hallucinated if its support is below the threshold. One pass for all thresholds."""
    each = F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])
    rows = scored.select("human", "support", F.explode(each).alias("threshold")).withColumn("predicted", F.when(F.col("support") < F.col("threshold"), POSITIVE).otherwise(NEGATIVE))
    return with_rates(rows.groupBy("threshold").agg(F.count("*").alias("total"), *cells(F.col("human"), F.col("predicted"))))


def select_threshold(scored: DataFrame, thresholds: Sequence[float], metric: str = "f1", *, split: str) -> DataFrame:
    """The threshold with the largest metric, the smallest one at ties. Never on the test split."""
    if split == "test":
        raise ValueError("a threshold is not to be chosen on the test split")
    return sweep(scored, thresholds).orderBy(F.desc(metric), F.asc("threshold")).limit(1)
