"""Fingerprints of populations, compatibility of runs, and claim rules of published evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.canonical import canonical

# Configuration that two local runs have to share, and metadata that two published runs have to.
RUN_FIELDS = ("annotation_policy", "benchmark", "dataset_name", "dataset_revision", "dataset_version", "evaluator_config", "evaluator_versions", "language", "quality_filter", "split", "top_k")
POPULATION_FIELDS = ("dataset_name", "dataset_version", "dataset_revision", "evaluation_type", "benchmark", "language", "split", "top_k", "evaluator_versions")
# How strong evidence is, what it is made of, and what it may claim.
STRENGTH = {"UNVERIFIED": 0, "PARTIAL": 1, "VERIFIED": 2}
DATA_KINDS = ("SYNTHETIC_FIXTURE", "CURATED_DATASET", "OFFICIAL_BENCHMARK")
CLAIM_SCOPES = ("INTEGRATION_ONLY", "PROTOCOL_SPECIFIC", "BENCHMARK_RESULT")


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_records, fingerprint. The same for any order of rows.

    Each record's hash is summed as a number, in four parts of 60 bits that cannot cancel, so the rows are never gathered or sorted."""
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    return rows.select(line.alias("__l"), *columns).agg(F.count("*").alias("n_records"), *parts).select("n_records", F.sha2(F.concat_ws(":", F.col("n_records").cast("string"), *[F.col(f"p{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def ordered_fingerprint(rows: DataFrame, line: Column) -> DataFrame:
    """Hash over the sorted lines themselves, for small populations whose hash another engine has to repeat."""
    return rows.select(line.alias("l")).agg(F.count("*").alias("n_records"), F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("fingerprint"))


def run_fingerprints(truth: DataFrame, predicted: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, ground_truth_fingerprint, ground_truth_query_ids_fingerprint, prediction_query_ids_fingerprint, ground_truth_query_count, prediction_query_count): SHA-256 of the canonical JSON of each run's
    queries with their relevant documents, and of the ids of its queries, all sorted and each once.

    ``truth``: run, query_id, relevant (arrays of ids; those of a repeated query are put together). ``predicted``: run, query_id. A digest is a chain, so a run's queries pass through one task,
    in order, but one at a time: none is held. Rows without a run or a query aren't queries; a side that has none is an empty list."""
    one = truth.where(f"`{run}` is not null and query_id is not null").select(run, "query_id", F.explode_outer("relevant").alias("d")).groupBy(run, "query_id").agg(F.sort_array(F.collect_set("d")).alias("own"))
    ids = predicted.where(f"`{run}` is not null and query_id is not null").select(run, "query_id").distinct()
    rows = one.select(F.col(run).alias("run"), F.lit(0).alias("side"), F.col("query_id").cast("string").alias("q"), "own").unionByName(ids.select(F.col(run).alias("run"), F.lit(1).alias("side"), F.col("query_id").cast("string").alias("q"), F.array().cast("array<string>").alias("own")))
    kind = truth.schema[run].dataType.simpleString()
    sides = rows.repartition("run", "side").sortWithinPartitions("run", "side", "q").mapInArrow(_chained, f"run {kind}, side int, n long, whole string, ids string")
    empty = hashlib.sha256(b"[]").hexdigest()
    pick = lambda side, c, other: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(other))
    out = sides.groupBy("run").agg(pick(0, "whole", empty).alias("ground_truth_fingerprint"), pick(0, "ids", empty).alias("ground_truth_query_ids_fingerprint"), pick(1, "ids", empty).alias("prediction_query_ids_fingerprint"), pick(0, "n", 0).alias("ground_truth_query_count"), pick(1, "n", 0).alias("prediction_query_count"))
    return out.withColumnRenamed("run", run)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the sorted rows of each run and side, that of whole rows and that of their ids."""
    key, whole, ids, n, kind = None, None, None, 0, None

    def closed() -> pa.RecordBatch:
        whole.update(b"]")
        ids.update(b"]")
        return pa.record_batch([pa.array([v], t) for v, t in ((key[0], kind), (key[1], pa.int32()), (n, pa.int64()), (whole.hexdigest(), pa.string()), (ids.hexdigest(), pa.string()))], ["run", "side", "n", "whole", "ids"])

    for batch in batches:
        kind = batch.schema.field("run").type
        for run, side, q, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (run, side):
                if key is not None:
                    yield closed()
                key, whole, ids, n = (run, side), hashlib.sha256(b"["), hashlib.sha256(b"["), 0
            comma = "," if n else ""
            whole.update((comma + canonical([q, own])).encode())
            ids.update((comma + canonical(q)).encode())
            n += 1
    if key is not None:
        yield closed()


def _sides(pairs: DataFrame, runs: DataFrame, key: str = "run_id") -> DataFrame:
    """``pairs`` (baseline_id, candidate_id) with both runs as structs a and b."""
    whole = F.struct(*runs.columns)
    for name, side in (("baseline", "a"), ("candidate", "b")):
        pairs = pairs.join(runs.select(F.col(key).alias(f"{name}_id"), whole.alias(side)), f"{name}_id", "left")
    return pairs


def compatibility(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(comparison_id, field, baseline, candidate): why two local retrieval runs can't be compared; none if they can.

    ``pairs``: comparison_id, baseline_id, candidate_id. ``runs``: run_id, schema_version, workspace_id, evaluation_type, the RUN_FIELDS, identity_valid (the
    result belongs to the run's frozen configuration), truth_fingerprint, query_fingerprint and prediction_fingerprint (null: not verified), prediction_count and
    reported_count. Only top_k shows its values; of other fields a row says whether they are there, are missing or differ. Retrievers may differ: they
    are what is compared."""
    rows = _sides(pairs.select("comparison_id", "baseline_id", "candidate_id"), runs)
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    veiled = lambda f, x, y: F.struct(F.lit(f).alias("field"), F.when(x, "missing").otherwise("present").alias("baseline"), F.when(y, "missing").otherwise("different").alias("candidate"))
    differ = lambda f, name=None: F.when(~a(f).eqNullSafe(b(f)), veiled(name or f, a(f).isNull(), b(f).isNull()))
    invalid = lambda name, bad: F.when(bad, veiled(name, F.lit(True), F.lit(False)))
    unverified = a("truth_fingerprint").isNull() | b("truth_fingerprint").isNull()
    both = lambda x: F.when(~unverified, x)
    found = [differ("schema_version", "run_schema_version"), differ("workspace_id"), differ("evaluation_type")]
    found.append(F.when((a("evaluation_type") != "retrieval") | (b("evaluation_type") != "retrieval"), veiled("retrieval_only", a("evaluation_type").isNull(), b("evaluation_type").isNull())))
    found += [F.when(~a(f).eqNullSafe(b(f)), F.struct(F.lit(f).alias("field"), a(f).cast("string").alias("baseline"), b(f).cast("string").alias("candidate"))) if f == "top_k" else differ(f) for f in RUN_FIELDS]
    found.append(F.when(unverified, veiled("verified_population", a("truth_fingerprint").isNull(), b("truth_fingerprint").isNull())))
    found += [both(differ("truth_fingerprint", "ground_truth_population")), both(differ("query_fingerprint", "query_population"))]
    for side, name in ((a, "baseline"), (b, "candidate")):
        found.append(invalid(f"{name}_result_identity", ~side("identity_valid")))
        found.append(both(invalid(f"{name}_prediction_coverage", side("prediction_fingerprint") != side("query_fingerprint"))))
        found.append(both(invalid(f"{name}_prediction_count", ~side("reported_count").eqNullSafe(side("prediction_count")))))
    return rows.select("comparison_id", F.inline(F.array_sort(F.array_compact(F.array(*found)))))


def status(pairs: DataFrame, reasons: DataFrame) -> DataFrame:
    """(comparison_id, status, reasons): COMPARABLE without reasons, else NON_COMPARABLE. A canonical comparison needs the first, an exploratory one doesn't."""
    n = reasons.groupBy("comparison_id").agg(F.count("*").alias("reasons"))
    return pairs.select("comparison_id").join(n, "comparison_id", "left").select("comparison_id", F.when(F.col("reasons").isNull(), "COMPARABLE").otherwise("NON_COMPARABLE").alias("status"), F.coalesce("reasons", F.lit(0)).alias("reasons"))


def population_match(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """(comparison_id, population_compatibility): MATCHED if two published runs agree on all POPULATION_FIELDS, else INCOMPATIBLE. ``runs``: artifact_id and the fields."""
    same = F.lit(True)
    for f in POPULATION_FIELDS:
        same &= F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    rows = _sides(pairs.select("comparison_id", "baseline_id", "candidate_id"), runs, "artifact_id")
    return rows.select("comparison_id", F.when(same, "MATCHED").otherwise("INCOMPATIBLE").alias("population_compatibility"))


def claim_violations(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, code). ``artifacts``: artifact_id, verification_status, data_kind, claim_scope."""
    rules = F.array(
        F.when(F.col("verification_status") == "NOT_RUN", "NOT_RUN_IS_NOT_EVIDENCE"),
        F.when((F.col("data_kind") == "SYNTHETIC_FIXTURE") & (F.col("claim_scope") != "INTEGRATION_ONLY"), "SYNTHETIC_FIXTURE_NEEDS_INTEGRATION_ONLY"),
        F.when((F.col("claim_scope") == "BENCHMARK_RESULT") & (F.col("data_kind") != "OFFICIAL_BENCHMARK"), "BENCHMARK_RESULT_NEEDS_OFFICIAL_BENCHMARK"),
    )
    return artifacts.select("artifact_id", F.explode(F.array_compact(rules)).alias("code"))


def strength(verification: Column) -> Column:
    """Null for a status that is no evidence, such as NOT_RUN."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv]), verification)


def operand_violations(comparisons: DataFrame, runs: DataFrame) -> DataFrame:
    """(artifact_id, code): comparisons that contradict the runs that they compare.

    ``comparisons``: artifact_id, baseline_id, candidate_id, verification_status, data_kind, claim_scope, population_compatibility; ``runs``: artifact_id, the same three
    claims and POPULATION_FIELDS. A comparison names two different known runs, shares kind and scope with both, is no stronger than the weaker one, and
    calls their populations matched only if they are."""
    rows = _sides(comparisons, runs, "artifact_id")
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    known = a("artifact_id").isNotNull() & b("artifact_id").isNotNull()
    same = F.lit(True)
    for f in POPULATION_FIELDS:
        same &= a(f).eqNullSafe(b(f))
    weakest = F.least(strength(a("verification_status")), strength(b("verification_status")))
    rules = F.array(
        F.when(a("artifact_id").isNull(), "UNKNOWN_BASELINE"), F.when(b("artifact_id").isNull(), "UNKNOWN_CANDIDATE"), F.when(F.col("baseline_id") == F.col("candidate_id"), "SELF_COMPARISON"),
        *[F.when(known & ((F.col(c) != a(c)) | (F.col(c) != b(c))), f"{c.upper()}_MISMATCH") for c in ("data_kind", "claim_scope")],
        F.when(known & (strength(F.col("verification_status")) > weakest), "STRONGER_THAN_OPERANDS"), F.when(known & (F.col("population_compatibility") == "MATCHED") & ~same, "POPULATION_MISMATCH"),
    )
    return rows.select("artifact_id", F.explode(F.array_compact(rules)).alias("code"))


def recomputed_deltas(comparisons: DataFrame, metrics: DataFrame) -> DataFrame:
    """(artifact_id, metric, delta, recomputed, matches). ``comparisons``: artifact_id, baseline_id, candidate_id, metric, delta; ``metrics``: artifact_id, metric, value.
    A metric that an operand lacks doesn't match."""
    side = lambda name: metrics.select(F.col("artifact_id").alias(f"{name}_id"), "metric", F.col("value").alias(name))
    rows = comparisons.join(side("baseline"), ["baseline_id", "metric"], "left").join(side("candidate"), ["candidate_id", "metric"], "left")
    again = F.col("candidate") - F.col("baseline")
    return rows.select("artifact_id", "metric", "delta", again.alias("recomputed"), F.coalesce(F.col("delta") == again, F.lit(False)).alias("matches"))


def recomputed_verdicts(comparisons: DataFrame) -> DataFrame:
    """(artifact_id, passed, recomputed, matches): a comparison passes if each of its metrics does. ``comparisons``: artifact_id, passed, status, a row for each metric."""
    rows = comparisons.groupBy("artifact_id").agg(F.first("passed").alias("passed"), F.bool_and(F.coalesce(F.col("status") == "PASS", F.lit(False))).alias("recomputed"))
    return rows.withColumn("matches", F.col("passed") == F.col("recomputed"))


def local_recommendation(local: DataFrame, other: DataFrame, wins: DataFrame) -> DataFrame:
    """One row: status and decision_gate of a full local run after a pilot.

    ``local`` and ``other``: one row each of balanced_accuracy, f1, false_positive_rate (``local`` also missing_count, parse_success_rate); ``wins``: one row of local_only and
    other_only, the examples that one alone has right. Incomplete pilots are inconclusive; else the local judge has to be at least as good in each of the four."""
    both = local.select(F.struct(*local.columns).alias("a")).crossJoin(other.select(F.struct(*other.columns).alias("b"))).crossJoin(wins)
    of = lambda side, c, default: F.coalesce(F.col(f"{side}.{c}").cast("double"), F.lit(default))
    fine = (of("a", "balanced_accuracy", 0.0) >= of("b", "balanced_accuracy", 0.0)) & (of("a", "f1", 0.0) >= of("b", "f1", 0.0)) & (of("a", "false_positive_rate", 1.0) <= of("b", "false_positive_rate", 1.0)) & (F.col("local_only") >= F.col("other_only"))
    whole = F.coalesce((F.col("a.missing_count") == 0) & (F.col("a.parse_success_rate") == 1.0), F.lit(False))
    return both.select(F.when(~whole, "INCONCLUSIVE").when(fine, "RECOMMEND_FULL_LOCAL_RUN").otherwise("RECOMMEND_NO_FULL_LOCAL_RUN").alias("status"), F.lit("OWNER_AUTHORIZATION_REQUIRED").alias("decision_gate"), "local_only", "other_only")
