"""What became of each query between two runs, in both vocabularies, with metric deltas and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return baseline.select("query_id", F.col("category").alias("baseline_category")).join(candidate.select("query_id", F.col("category").alias("candidate_category")), "query_id")


def guard_queries(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Ids that only one run has: (query_id, side). Both have to be equal for a comparison."""
    one = baseline.select("query_id").join(candidate, "query_id", "left_anti").select("query_id", F.lit("BASELINE_ONLY").alias("side"))
    return one.unionByName(candidate.select("query_id").join(baseline, "query_id", "left_anti").select("query_id", F.lit("CANDIDATE_ONLY").alias("side")))


def _case(passed: str, broke: str, mended: str, same: str, other: str) -> Column:
    a, b = F.col("baseline_category"), F.col("candidate_category")
    return F.when((a == "PASS") & (b == "PASS"), passed).when(a == "PASS", broke).when(b == "PASS", mended).when(a == b, same).otherwise(other)


def workspace_transitions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return _both(baseline, candidate).withColumn("transition", _case("UNCHANGED_PASS", "REGRESSED", "IMPROVED", "PERSISTENT_FAILURE", "CHANGED_FAILURE"))


def console_transitions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return _both(baseline, candidate).withColumn("transition", _case("STABLE_PASS", "INTRODUCED_FAILURE", "RESOLVED_FAILURE", "PERSISTENT_CATEGORY", "CHANGED_FAILURE_CATEGORY"))


def metric_deltas(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(query_id, metric, baseline, candidate, delta) of long per-query metrics; unchanged ones are left out, a missing side has no delta."""
    rows = baseline.select("query_id", "metric", F.col("value").alias("baseline")).join(candidate.select("query_id", "metric", F.col("value").alias("candidate")), ["query_id", "metric"], "full_outer")
    return rows.where(~F.col("baseline").eqNullSafe(F.col("candidate"))).withColumn("delta", F.col("candidate") - F.col("baseline"))


def changed_records(transitions: DataFrame, deltas: DataFrame) -> DataFrame:
    """Queries with a metric delta or a transition other than stable."""
    moved = transitions.where(~F.col("transition").isin("STABLE_PASS", "PERSISTENT_CATEGORY", "UNCHANGED_PASS", "PERSISTENT_FAILURE")).select("query_id")
    return moved.unionByName(deltas.select("query_id")).distinct()


def filter_transitions(
    rows: DataFrame, *, transition: str | None = None, category: str | None = None, candidate_category: str | None = None, query_id: str | None = None, contains: str | None = None, ignore_case: bool = False, changed: DataFrame | None = None
) -> DataFrame:
    """``category`` may be on either side; ``contains`` looks for a part of the id; ``changed`` (ids of ``changed_records``) keeps only those."""
    if transition is not None:
        rows = rows.where(F.col("transition") == transition)
    if category is not None:
        rows = rows.where((F.col("baseline_category") == category) | (F.col("candidate_category") == category))
    if candidate_category is not None:
        rows = rows.where(F.col("candidate_category") == candidate_category)
    if query_id is not None:
        rows = rows.where(F.col("query_id") == query_id)
    if contains is not None:
        rows = rows.where(F.lower("query_id").contains(contains.lower()) if ignore_case else F.col("query_id").contains(contains))
    return rows if changed is None else rows.join(changed.select("query_id").distinct(), "query_id", "left_semi")
