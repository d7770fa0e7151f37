"""Classification metrics against human labels, slices, calibration and error analysis. The positive class is HALLUCINATED."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import safe_ratio
from gradus.operators.order import numbered

POSITIVE, NEGATIVE = "HALLUCINATED", "GROUNDED"
RATES = ("precision", "recall", "f1", "accuracy", "specificity", "balanced_accuracy", "false_positive_rate", "false_negative_rate")


def human_label(spans: Column, policy: str = "strict-groundedness") -> Column:
    """Any span, or under factual correctness any that is not marked as true in fact, makes a response hallucinated."""
    if policy == "strict-groundedness":
        bad = F.size(spans) > 0
    elif policy == "factual-correctness":
        bad = F.exists(spans, lambda s: ~F.coalesce(s["implicit_true"], F.lit(False)))
    else:
        raise ValueError(f"no such policy: {policy}")
    return F.when(F.coalesce(bad, F.lit(False)), POSITIVE).otherwise(NEGATIVE)


def overlap_support(response: Column, context: Column) -> Column:
    """Share of the response's tokens that the context has: 1 for a response without tokens, 0 for a context without."""
    shared = F.size(F.array_intersect(response, context))
    return F.when(F.size(response) == 0, 1.0).when(F.size(context) == 0, 0.0).otherwise(shared / F.size(response))


def with_common_support(rows: DataFrame, key: str, tokens: str, context: DataFrame, name: str) -> DataFrame:
    """``rows`` with the column ``name`` instead of the set ``tokens``: the share of them that one context for all rows has (one column of distinct tokens).

    Tokens meet the context's by a join. Keys have to be unique."""
    word = context.columns[0]
    hits = rows.select(key, F.explode(tokens).alias(word)).join(context, word, "left_semi").groupBy(key).agg(F.count("*").alias("__hits"))
    some = context.limit(1).agg(F.count("*").alias("__some"))
    n = F.size(tokens)
    support = F.when(n == 0, 1.0).when(F.col("__some") == 0, 0.0).otherwise(F.coalesce("__hits", F.lit(0)) / n)
    return rows.join(hits, key, "left").crossJoin(F.broadcast(some)).withColumn(name, support).drop("__hits", "__some", tokens)


def from_support(support: Column, threshold: float) -> dict[str, Column]:
    """Label by the support as it is, score from it rounded to 12 places."""
    return {"predicted": F.when(support >= F.lit(float(threshold)), NEGATIVE).otherwise(POSITIVE), "score": F.round(1 - support, 12)}


def from_decision(label: Column, confidence: Column) -> dict[str, Column]:
    score = F.when(label == POSITIVE, confidence).otherwise(F.round(1 - confidence, 12))
    return {"score": score, "support": 1 - score}


def guard_populations(labels: DataFrame, predictions: DataFrame, key: str = "example_id") -> DataFrame:
    """Violations, as (code, example_id): ids on one side only, and ids that repeat. Empty if both sides agree."""
    both = labels.groupBy(key).agg(F.count("*").alias("n_labels")).join(predictions.groupBy(key).agg(F.count("*").alias("n_predictions")), key, "full_outer")
    code = F.when(F.col("n_predictions").isNull(), "MISSING_PREDICTION").when(F.col("n_labels").isNull(), "UNKNOWN_EXAMPLE").when(F.col("n_labels") > 1, "DUPLICATE_LABEL").when(F.col("n_predictions") > 1, "DUPLICATE_PREDICTION")
    return both.select(code.alias("code"), key).where("code is not null")


def cells(human: Column, predicted: Column) -> list[Column]:
    positive, said = human == POSITIVE, predicted == POSITIVE
    return [F.count_if(positive & said).alias("tp"), F.count_if(~positive & ~said).alias("tn"), F.count_if(~positive & said).alias("fp"), F.count_if(positive & ~said).alias("fn")]


def with_rates(df: DataFrame) -> DataFrame:
    """Eight rates of tp, tn, fp and fn; 0 where a denominator is 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    df = df.withColumns({"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn), "specificity": safe_ratio(tn, tn + fp)})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumns({"f1": safe_ratio(2 * p * r, p + r), "balanced_accuracy": (r + F.col("specificity")) / 2, "false_positive_rate": safe_ratio(fp, fp + tn), "false_negative_rate": safe_ratio(fn, fn + tp)})


def confusion(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates, of all rows (one row even of none) or for each value of ``by``. ``scored``: human, predicted."""
    counts = [F.count("*").alias("total"), *cells(F.col("human"), F.col("predicted"))]
    return with_rates(scored.groupBy(*by).agg(*counts) if by else scored.agg(*counts))


def slices(scored: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, total, counts, rates) for everything (dimension ``all``) and each dimension, in one pass of grouping sets.

    A null value counts as ``unknown``; the grouping id, not a null, tells the sets apart."""
    rows = scored.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit("unknown")) for d in dimensions})
    counts = [F.count("*").alias("total"), *cells(F.col("human"), F.col("predicted")), F.grouping_id().alias("set")]
    found = rows.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(*counts)
    top = (1 << len(dimensions)) - 1
    name, value = F.when(F.col("set") == top, "all"), F.when(F.col("set") == top, "all")
    for i, d in enumerate(dimensions):
        at = top - (1 << (len(dimensions) - 1 - i))
        name, value = name.when(F.col("set") == at, d), value.when(F.col("set") == at, F.col(d))
    return with_rates(found.select(name.alias("dimension"), value.alias("value"), "total", "tp", "tn", "fp", "fn"))


def errors(scored: DataFrame) -> DataFrame:
    """(example_id, kind): false positives and false negatives."""
    kind = F.when((F.col("human") == NEGATIVE) & (F.col("predicted") == POSITIVE), "FALSE_POSITIVE").when((F.col("human") == POSITIVE) & (F.col("predicted") == NEGATIVE), "FALSE_NEGATIVE")
    return scored.select("example_id", kind.alias("kind")).where("kind is not null")


def confidence(predicted: Column, score: Column) -> Column:
    return F.when(predicted == POSITIVE, score).otherwise(1 - score)


def error_analysis(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(dimension, value, kind, n, mean_confidence) of errors, by each of ``by`` and over all."""
    rows = scored.join(errors(scored), "example_id").withColumn("sure", confidence(F.col("predicted"), F.col("score")))
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in by])
    return rows.select("kind", "sure", F.inline(pairs)).groupBy("dimension", "value", "kind").agg(F.count("*").alias("n"), F.avg("sure").alias("mean_confidence"))


def high_confidence_errors(scored: DataFrame, least: float = 0.8) -> DataFrame:
    sure = confidence(F.col("predicted"), F.col("score"))
    return scored.where((F.col("human") != F.col("predicted")) & (sure >= least)).select("example_id", "human", "predicted", sure.alias("confidence"))


def calibration_bins(scored: DataFrame, probability: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """(bin, n, mean_probability, mean_outcome, gap) for every bin, empty ones included; the last one holds 1.0."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(probability * bins))).cast("int")
    found = scored.select(at.alias("bin"), probability.alias("p"), outcome.cast("double").alias("y")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_probability"), F.avg("y").alias("mean_outcome"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_probability", "mean_outcome", F.abs(F.col("mean_probability") - F.col("mean_outcome")).alias("gap"))


def calibration(scored: DataFrame, probability: Column, outcome: Column, bins: int = 10) -> DataFrame:
    """One row: n, brier, ece."""
    table = calibration_bins(scored, probability, outcome, bins)
    ece = table.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))), F.sum("n").cast("double")), F.lit(0.0)).alias("ece"))
    return scored.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.pow(probability - outcome.cast("double"), F.lit(2))), F.lit(0.0)).alias("brier")).crossJoin(ece)


def length_quartiles(rows: DataFrame, length: Column, key: str = "example_id") -> DataFrame:
    """``rows`` with quartile (Q1 to Q4): four times the rank by length and key over the number of rows, not ntile.

    The rank over everything is summed up over ranges of the order, so neither many rows nor many of one length meet in a task."""
    ranked = numbered(rows.withColumn("__len", length), F.col("__len"), F.col(key), name="__place").crossJoin(F.broadcast(rows.agg(F.count("*").alias("__all"))))
    quartile = F.concat(F.lit("Q"), (F.least(F.lit(3), F.floor((F.col("__place") - 1) * 4 / F.col("__all"))) + 1).cast("string"))
    return ranked.withColumn("quartile", quartile).drop("__len", "__all", "__place")
