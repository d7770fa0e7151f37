"""Ranking metrics: precision, recall, hit rate, reciprocal rank and nDCG, per query and averaged."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators.retrieval import check_k

METRICS = ("precision", "recall", "hit_rate", "mrr", "ndcg")


def grades(truth: DataFrame) -> DataFrame:
    """(query_id, grades): a map of graded relevance, from a column ``relevant`` of ids or ``grades`` itself."""
    if "grades" in truth.columns:
        return truth.select("query_id", F.col("grades").cast("map<string,double>"))
    return truth.select("query_id", F.map_from_arrays(F.array_distinct("relevant"), F.array_repeat(F.lit(1.0), F.size(F.array_distinct("relevant")))).alias("grades"))


def qrel_grades(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Grades of all ``queries``; one that no judgment names has an empty map. Of several judgments of one pair the highest counts."""
    one = qrels.groupBy("query_id", "document_id").agg(F.max("relevance").alias("relevance"))
    found = one.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("document_id", F.col("relevance").cast("double")))).alias("grades"))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("grades", F.coalesce("grades", F.create_map().cast("map<string,double>")))


def per_query(truth: DataFrame, predicted: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(query_id, k, category, precision, recall, hit_rate, mrr, ndcg) for each query of ``truth`` and each k, in one pass.

    A query without a prediction retrieved nothing; predictions of other queries are ignored. Precision divides by k. Repeated documents
    count once and keep their place. The reciprocal rank looks at the whole list, the category at the first k."""
    ks = sorted({check_k(k) for k in ks})
    both = grades(truth).join(predicted.select("query_id", "retrieved"), "query_id", "left")
    both = both.select("query_id", "grades", F.map_filter("grades", lambda _, g: g > 0).alias("gain"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))
    both = both.select("query_id", "grades", "gain", F.map_keys("gain").alias("good"), "retrieved", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    top = F.slice("retrieved", F.lit(1), F.col("k"))
    hits = F.size(F.array_intersect(top, F.col("good")))
    first = F.array_min(F.filter(F.transform("good", lambda d: F.array_position(F.col("retrieved"), d)), lambda p: p > 0))
    gain = lambda g, place: (F.pow(F.lit(2.0), g) - 1) / F.log2(place.cast("double") + 2)
    own = F.transform(top, lambda d, i: F.when(F.array_position(F.col("retrieved"), d) == i + 1, F.coalesce(gain(F.try_element_at(F.col("gain"), d), i), F.lit(0.0))).otherwise(0.0))
    ideal = F.transform(F.slice(F.sort_array(F.map_values("gain"), asc=False), F.lit(1), F.col("k")), gain)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    both = both.withColumns({"hits": hits, "first": first, "dcg": total(own), "best": total(ideal)})
    return both.select(
        "query_id", "k",
        F.when(F.size("grades") == 0, "SHOULD_ABSTAIN").when(F.col("hits") > 0, "PASS").otherwise("RETRIEVAL_MISS").alias("category"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.when(F.size("good") > 0, F.col("hits") / F.size("good")).otherwise(0.0).alias("recall"),
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"),
    )


def macro(scored: DataFrame) -> DataFrame:
    """Means over all queries, for each k."""
    return scored.groupBy("k").agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def failure_counts(scored: DataFrame) -> DataFrame:
    """(k, PASS, RETRIEVAL_MISS, SHOULD_ABSTAIN), zeros included."""
    return scored.groupBy("k").agg(*[F.count_if(F.col("category") == c).alias(c) for c in ("PASS", "RETRIEVAL_MISS", "SHOULD_ABSTAIN")])


def long_metrics(scored: DataFrame, k: int) -> DataFrame:
    """(metric, value): the averages at one k, named as policies name them."""
    one = macro(scored.where(F.col("k") == check_k(k)))
    names = {m: m if m == "mrr" else f"{m}_at_{k}" for m in METRICS}
    return one.select(F.inline(F.array(*[F.struct(F.lit(names[m]).alias("metric"), F.col(m).alias("value")) for m in METRICS])))


def pair_validation(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: how many query ids match, miss a prediction or are extra, and the warnings that follow."""
    both = truth.select("query_id", F.lit(1).alias("t")).join(predicted.select("query_id", F.lit(1).alias("p")), "query_id", "full_outer")
    n = both.agg(
        F.expr("count_if(t is not null and p is not null)").alias("matching"), F.expr("count_if(p is null)").alias("missing"), F.expr("count_if(t is null)").alias("extra")
    )
    warned = F.array_join(F.array_compact(F.array(F.when(F.col("missing") > 0, "MISSING_PREDICTIONS"), F.when(F.col("extra") > 0, "EXTRA_PREDICTIONS"))), ",")
    return n.withColumn("warnings", warned)


def trec_lines(ranked: DataFrame, tag: str) -> DataFrame:
    """(query_id, rank, line): ``qid Q0 doc rank score tag``; scores with 12 significant digits, formatted as C does."""
    @F.pandas_udf("string")
    def digits(scores: pd.Series) -> pd.Series:
        return scores.map(lambda x: f"{x:.12g}")

    return ranked.select("query_id", "rank", F.concat_ws(" ", "query_id", F.lit("Q0"), "document_id", F.col("rank").cast("string"), digits("score"), F.lit(tag)).alias("line"))
