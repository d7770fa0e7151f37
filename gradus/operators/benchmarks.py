"""Whole benchmarks: retrieval over a corpus with judgments, groundedness of labelled responses, and the summary of a full run.

Each returns a dict of frames, one for each part of its report; nothing runs before a part is asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.operators import classify, evidence, population, ranking, regression, retrieval, validate

# Cut-offs that are reported besides top_k, and splits by the names that files use.
CUTS = (1, 5, 10)
SPLITS = {"train": "train", "dev": "dev", "testa": "testA", "testb": "testB"}


def metric_ks(top_k: int) -> tuple[int, ...]:
    """The usual cut-offs up to top_k, and top_k."""
    return tuple(sorted({k for k in CUTS if k <= retrieval.check_k(top_k)} | {top_k}))


def split_alias(name: Column) -> Column:
    """test-a and testA are one split; null for a name that isn't one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv]), F.replace(F.lower(name), F.lit("-"), F.lit("")))


def quality_filter(examples: DataFrame, qualities: Sequence[str] | None = None) -> DataFrame:
    """Examples of the given qualities; of ``good`` quality if none are given."""
    return examples.where(F.col("quality").isin(*(qualities or ("good",))))


def eligible(examples: DataFrame, qualities: Sequence[str] | None = None) -> DataFrame:
    """Examples that a pilot may draw: the test split, of the given qualities."""
    return quality_filter(examples.where("split = 'test'"), qualities)


def dataset_summary(examples: DataFrame) -> DataFrame:
    """One row: responses, sources, hallucinated, good. ``examples``: source_id, quality, human."""
    return examples.agg(
        F.count("*").alias("responses"), F.countDistinct("source_id").alias("sources"), F.count_if(F.col("human") == classify.POSITIVE).alias("hallucinated"), F.count_if(F.col("quality") == "good").alias("good")
    )


def preparation_summary(examples: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: responses, sources, hallucination_responses, hallucination_spans, split_counts and quality_counts (maps), validation_issues.

    ``examples``: source_id, split, quality and spans (an array; a response with any span is hallucinated); ``issues``: a row for each."""
    n = examples.agg(
        F.count("*").alias("responses"), F.countDistinct("source_id").alias("sources"), F.count_if(F.size("spans") > 0).alias("hallucination_responses"),
        F.coalesce(F.sum(F.greatest(F.size("spans"), F.lit(0)).cast("long")), F.lit(0)).alias("hallucination_spans"),
    )
    by = lambda c: examples.groupBy(c).agg(F.count("*").alias("n")).where(F.col(c).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"{c}_counts"))
    return n.crossJoin(by("split")).crossJoin(by("quality")).crossJoin(issues.agg(F.count("*").alias("validation_issues")))


def evidence_bundle(runs: DataFrame, truth: DataFrame, predictions: dict[str, DataFrame], k: int, rules: Sequence[tuple], comparison: dict[str, str]) -> dict[str, DataFrame]:
    """Public evidence of retrieval runs and of one comparison: frames (artifact_id, and what the artifact says) by their part: runs, comparison, index.

    ``runs``: run_id, claims and PUBLIC_FIELDS; ``predictions``: query_id and retrieved, by run; ``comparison``: artifact_id, baseline_id and candidate_id, which takes the claims of its baseline. ``sinks.write_bundle`` writes them."""
    spark = runs.sparkSession
    scored = {run: ranking.per_query(truth, rows, [k]) for run, rows in predictions.items()}
    values, queries = None, None
    for run, rows in scored.items():
        own = ranking.long_metrics(rows, k).withColumn("run_id", F.lit(run))
        each = rows.select(F.lit(run).alias("run_id"), "query_id", "category")
        values, queries = (own, each) if values is None else (values.unionByName(own), queries.unionByName(each))
    public = evidence.run_artifact(runs, values, queries)
    of = lambda name: ranking.long_metrics(scored[comparison[name]], k)
    compared = regression.compare(of("candidate_id"), of("baseline_id"), regression.rules_frame(spark, rules))
    one = evidence.comparison_artifact(comparison["artifact_id"], comparison["baseline_id"], comparison["candidate_id"], compared)
    claims = runs.where(F.col("run_id") == comparison["baseline_id"]).select("verification_status", "data_kind", "claim_scope")
    pair = spark.createDataFrame([(comparison["artifact_id"], comparison["baseline_id"], comparison["candidate_id"])], "comparison_id string, baseline_id string, candidate_id string")
    fields = runs.withColumnRenamed("run_id", "artifact_id")
    for f in population.POPULATION_FIELDS:
        if f not in fields.columns:
            fields = fields.withColumn(f, F.lit(None).cast("string"))
    match = population.population_match(pair, fields).select("population_compatibility")
    one = one.crossJoin(claims).crossJoin(match)
    return {"runs": public, "comparison": one, "index": evidence.index(public, one)}


def counts(topics: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: query_count, corpus_count, qrel_count."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(topics, "query_count").crossJoin(one(corpus, "corpus_count")).crossJoin(one(qrels, "qrel_count"))


def retrieval_benchmark(topics: DataFrame, qrels: DataFrame, corpus: DataFrame, top_k: int, *, order: str = "query_id") -> dict[str, DataFrame]:
    """Judgments are checked first (``issues``: any makes the other parts meaningless, ``readers.strict`` turns them into an error); then BM25 ranks the corpus.

    Parts: issues, ranked, per_query (for each k of ``metric_ks``), metrics_by_k, failure_counts (at top_k), failures (at top_k, other than PASS), counts."""
    ranked = retrieval.bm25(corpus, topics, top_k)
    scored = ranking.per_query(ranking.qrel_grades(topics, qrels), retrieval.rankings(ranked), metric_ks(top_k))
    top = scored.where(F.col("k") == top_k)
    return {
        "issues": validate.qrels(topics, qrels, corpus, order), "ranked": ranked, "per_query": scored, "metrics_by_k": ranking.macro(scored), "failure_counts": ranking.failure_counts(top),
        "failures": top.where("category <> 'PASS'").select("query_id", "category"), "counts": counts(topics, qrels, corpus),
    }


def groundedness_failures(scored: DataFrame, issues: DataFrame) -> DataFrame:
    """(section, category, failure_class, record_id, code): false positives, then false negatives, then what is wrong with the dataset itself, that of
    excluded examples too. ``issues``: code, record_id."""
    kind = F.col("kind")
    own = classify.errors(scored).select(
        F.when(kind == "FALSE_POSITIVE", 1).otherwise(2).alias("section"), F.concat(F.lit("HALLUCINATION_"), kind).alias("category"), F.lit("EVALUATOR_UNCERTAINTY").alias("failure_class"),
        F.col("example_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("code"),
    )
    return own.unionByName(issues.select(F.lit(3).alias("section"), F.lit("DATASET_AMBIGUOUS").alias("category"), F.lit("DATASET").alias("failure_class"), F.col("record_id").cast("string").alias("record_id"), "code"))


def groundedness_benchmark(examples: DataFrame, predictions: DataFrame, issues: DataFrame, *, qualities: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """An evaluator against human labels. ``examples``: example_id, quality, task_type, model, human; ``predictions``: example_id, predicted, score.

    Parts: counts (one row: total, included, excluded), exclusion_reasons (``quality:`` and the quality, n), confusion, slices by task type and model, failures
    (sorted by section and record). An included example without a prediction, or a prediction of another one, is in ``mismatched``."""
    fit = F.col("quality").isin(*(qualities or ("good",)))
    included = quality_filter(examples, qualities)
    scored = included.join(predictions, "example_id")
    return {
        "counts": examples.agg(F.count("*").alias("total"), F.count_if(fit).alias("included"), F.count_if(~fit).alias("excluded")),
        "exclusion_reasons": examples.where(~fit).groupBy(F.concat(F.lit("quality:"), "quality").alias("reason")).agg(F.count("*").alias("n")),
        "mismatched": classify.guard_populations(included, predictions.join(examples.where(~fit), "example_id", "left_anti")),
        "confusion": classify.confusion(scored), "slices": classify.slices(scored, ["task_type", "model"]), "failures": groundedness_failures(scored, issues).orderBy("section", "record_id", "code"),
    }


def full_summary(labels: DataFrame, predictions: DataFrame, lengths: DataFrame) -> dict[str, DataFrame]:
    """A complete run: ``labels`` (example_id, human, task_type, model), ``predictions`` (example_id, predicted, score), ``lengths`` (example_id, and a column for each length).

    Parts: mismatched (ids that labels, predictions and lengths don't share; the rest means something only if it is empty), slices (all, by task type and by model),
    length_slices (quartiles of each length, with their ranges), calibration, calibration_bins, error_analysis, high_confidence_errors."""
    columns = [c for c in lengths.columns if c != "example_id"]
    sides = classify.guard_populations(labels, predictions).withColumn("side", F.lit("predictions")).unionByName(classify.guard_populations(labels, lengths).withColumn("side", F.lit("lengths")))
    scored = labels.join(predictions, "example_id")
    positive = F.col("human") == classify.POSITIVE
    parts = None
    for c in columns:
        rows = classify.length_quartiles(scored.join(lengths.select("example_id", c), "example_id"), F.col(c))
        bounds = rows.groupBy("quartile").agg(F.min(c).alias("min_length"), F.max(c).alias("max_length"))
        part = classify.confusion(rows, ["quartile"]).join(bounds, "quartile").withColumn("length", F.lit(c))
        parts = part if parts is None else parts.unionByName(part)
    return {
        "mismatched": sides, "slices": classify.slices(scored, ["task_type", "model"]), "length_slices": parts, "calibration": classify.calibration(scored, F.col("score"), positive),
        "calibration_bins": classify.calibration_bins(scored, F.col("score"), positive), "error_analysis": classify.error_analysis(scored, ["task_type", "model"]), "high_confidence_errors": classify.high_confidence_errors(scored),
    }
