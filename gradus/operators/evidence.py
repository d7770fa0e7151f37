"""Public evidence: artifacts of runs and comparisons, their index, and text and metric policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and texts that look like secrets, Windows paths, the length of a public text, public fields of a run, and values of catalog filters.
UNSAFE_NAME = r"(?i)^(?:api[_-]?key|authorization|bearer|password|secret|token)(?:[_-]?value)?$"
UNSAFE_TEXT = r"(?i)(?:api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]"
WINDOWS_PATH = r"^[A-Za-z]:[\\/]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
MOST_CHARACTERS = 500
PUBLIC_FIELDS = (
    "evaluation_type", "run_id", "dataset_name", "dataset_version", "dataset_revision", "system_name", "model", "model_provider", "benchmark", "language", "split", "retriever", "retriever_version",
    "tokenization_strategy", "top_k", "evaluator_versions", "random_seed", "timestamp", "git_commit",
)
FILTERS = {
    "verification": ("verification_status", ("VERIFIED", "PARTIAL", "UNVERIFIED", "NOT_RUN")),
    "data": ("data_kind", ("SYNTHETIC_FIXTURE", "CURATED_DATASET", "OFFICIAL_BENCHMARK")),
    "scope": ("claim_scope", ("INTEGRATION_ONLY", "PROTOCOL_SPECIFIC", "BENCHMARK_RESULT")),
    "population": ("population_compatibility", ("MATCHED", "UNVERIFIED", "INCOMPATIBLE")),
    "result": ("result", ("PASS", "REGRESSION")),
}


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _unsafe(text: Column) -> Column:
    return text.rlike(UNSAFE_NAME) | text.rlike(UNSAFE_TEXT)


def text_violation(text: Column, most: int = MOST_CHARACTERS) -> Column:
    """Why a text may not be published, the first of: EMPTY_TEXT, TEXT_TOO_LONG, UNSAFE_TEXT (secrets, paths), CONTROL_CHARACTER; else null."""
    t = _stripped(F.coalesce(text, F.lit("")))
    return F.when(t == "", "EMPTY_TEXT").when(F.length(t) > most, "TEXT_TOO_LONG").when(_unsafe(t) | t.rlike(WINDOWS_PATH) | t.startswith("/"), "UNSAFE_TEXT").when(t.rlike(CONTROL), "CONTROL_CHARACTER")


def text_violations(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, code) of texts that may not be published."""
    checks = F.array(*[F.when(text_violation(F.col(c)).isNotNull(), F.struct(F.lit(c).alias("field"), text_violation(F.col(c)).alias("code"))) for c in columns])
    return rows.select(key, F.inline(F.array_compact(checks)))


def safe_identifier(name: Column) -> Column:
    """Whether a name can't be taken for a path and doesn't look like a secret."""
    t = _stripped(F.coalesce(name, F.lit("")))
    return (t != "") & ~t.isin(".", "..") & ~t.rlike(r"[/\\]") & ~_unsafe(t)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def run_artifact(run: DataFrame, metrics: DataFrame, per_query: DataFrame | None = None) -> DataFrame:
    """A run's public form: allowed fields and finite metrics; evidence of single queries only for synthetic fixtures."""
    values = metrics.where(finite(F.col("value"))).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.round("value", 12))))).alias("metrics"))
    out = run.join(values, "run_id", "left").select(F.col("run_id").alias("artifact_id"), F.lit("run").alias("artifact_type"), F.lit("public-evidence-v1").alias("schema_version"), "verification_status", "data_kind", "claim_scope", F.struct(*[c for c in PUBLIC_FIELDS if c in run.columns]).alias("run"), F.array_sort(F.array_distinct("limitations")).alias("limitations"), "metrics")
    if per_query is not None:
        shown = run.where("data_kind = 'SYNTHETIC_FIXTURE'").select("run_id")
        rows = per_query.join(shown, "run_id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("query_id", "category"))).alias("queries"))
        out = out.join(rows.withColumnRenamed("run_id", "artifact_id"), "artifact_id", "left")
    return out


def comparison_artifact(artifact_id: str, baseline_id: str, candidate_id: str, compared: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("metric", "baseline", "current", "degradation", "status")))
    return compared.agg(rows.alias("comparisons"), F.every(F.col("status") == "PASS").alias("passed")).select(F.lit(artifact_id).alias("artifact_id"), F.lit("comparison").alias("artifact_type"), F.lit(baseline_id).alias("baseline_id"), F.lit(candidate_id).alias("candidate_id"), "passed", "comparisons")


def index(runs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Summaries of all artifacts, by id."""
    a = runs.select("artifact_id", F.lit("run").alias("artifact_type"), "verification_status", "data_kind", "claim_scope")
    none = F.lit(None).cast("string")
    b = comparisons.select("artifact_id", F.lit("comparison").alias("artifact_type"), *[(F.col(c) if c in comparisons.columns else none).alias(c) for c in ("verification_status", "data_kind", "claim_scope")])
    return a.unionByName(b).orderBy("artifact_id")


def index_violations(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, code): repeated ids, and comparisons that refer to themselves or to no run of this index."""
    again = artifacts.groupBy("artifact_id").agg(F.count("*").alias("n")).where("n > 1").select("artifact_id", F.lit("DUPLICATE_ARTIFACT").alias("code"))
    ends = artifacts.where("artifact_type = 'comparison'").select("artifact_id", F.explode(F.array("baseline_id", "candidate_id")).alias("run"), (F.col("baseline_id") == F.col("candidate_id")).alias("same"))
    runs = artifacts.where("artifact_type = 'run'").select(F.col("artifact_id").alias("run")).distinct()
    gone = ends.join(runs, "run", "left_anti").select("artifact_id", F.lit("UNKNOWN_RUN").alias("code"))
    return again.unionByName(gone).unionByName(ends.where("same").select("artifact_id", F.lit("SELF_COMPARISON").alias("code"))).distinct()


def catalog_filter(rows: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """Rows that match every filter of FILTERS that is chosen with exactly one of its values; others are ignored."""
    for name, values in chosen.items():
        column, allowed = FILTERS.get(name, (name, ()))
        if len(values) == 1 and values[0] in allowed:
            rows = rows.where(F.col(column) == values[0])
    return rows


def run_items(index: DataFrame) -> DataFrame:
    """What a catalog shows of a run."""
    return index.where("artifact_type = 'run'").select("artifact_id", "run_id", "dataset_name", "evaluation_type", "verification_status", "data_kind", "claim_scope", "metrics")


def comparison_items(comparisons: DataFrame) -> DataFrame:
    """What a catalog shows of a comparison: its claims, result (PASS, REGRESSION, or null where neither) and regression_count. ``comparisons``: passed, and statuses
    (an array) of its metrics."""
    n = F.size(F.filter("statuses", lambda s: s == "REGRESSION"))
    result = F.when(F.col("passed"), "PASS").when(n > 0, "REGRESSION")
    return comparisons.select("artifact_id", "baseline_id", "candidate_id", "verification_status", "data_kind", "claim_scope", "population_compatibility", result.alias("result"), n.alias("regression_count"))


def sorted_failures(rows: DataFrame) -> DataFrame:
    """Failures by record, category and class, a missing class first."""
    return rows.orderBy("record_ref", "category", F.coalesce("failure_class", F.lit("")))


def first_metrics(metrics: DataFrame, n: int = 3) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("metric"))
    return metrics.withColumn("nth", nth).where(F.col("nth") <= n)


# Metrics that aren't written like other words, and months as British English shortens them.
TITLES = {"Ndcg": "nDCG", "Mrr": "MRR"}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec")


def _worded(name: Column, rest) -> Column:
    return F.array_join(F.transform(F.split(name, "_", -1), lambda p: F.concat(F.substring(p, 1, 1), rest(F.substr(p, F.lit(2))))), " ")


def metric_title(name: Column) -> Column:
    """``ndcg_at_10`` as nDCG@10: words with a capital, the cut-off behind an @."""
    k = F.regexp_extract(name, r"^(?s)(.*)_at_([0-9]+)$", 2)
    base = F.when(k != "", F.regexp_extract(name, r"^(?s)(.*)_at_([0-9]+)$", 1)).otherwise(name)
    pretty = F.array_join(F.transform(F.split(base, "_", -1), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), " ")
    for plain, own in TITLES.items():
        pretty = F.when(pretty == plain, own).otherwise(pretty)
    return F.when(k != "", F.concat(pretty, F.lit("@"), k)).otherwise(pretty)


def metric_value(value: Column) -> Column:
    """Three decimal places, rounded half up from the number's shortest form, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", value.cast("double")), "0+$", ""), r"\.$", "")


def label_title(value: Column) -> Column:
    """``CURATED_DATASET`` as Curated Dataset."""
    return _worded(value, F.lower)


def day_title(at: Column) -> Column:
    """The day of a timestamp as in 3 Sept 2026; in UTC if the session is."""
    return F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.get(F.array(*map(F.lit, MONTHS)), F.month(at) - 1), F.year(at).cast("string"))
