"""Stratified samples that are the same in every run, and bootstrap intervals."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators.order import percentiles, running

POSITIVE = "HALLUCINATED"
# The strata of a pilot, task type and label.
STRATA = ("QA:GROUNDED", "QA:HALLUCINATED", "Summary:GROUNDED", "Summary:HALLUCINATED", "Data2txt:GROUNDED", "Data2txt:HALLUCINATED")


def stratified(rows: DataFrame, strata: Sequence[str], per_stratum: int, seed: int, key: str = "example_id") -> DataFrame:
    """Up to ``per_stratum`` rows of each stratum: those of the smallest hashes of seed and id. Independent of order and partitioning;
    each task keeps no more than that many rows of a stratum before anything moves."""
    draw = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("draw", F.row_number().over(draw)).where(F.col("draw") <= per_stratum)


def seeded(rows: DataFrame, stratum: Column, per_stratum: int, seed: int, *, key: str = "example_id", strata: Sequence[str] = STRATA) -> DataFrame:
    """(stratum, key): the ids that ``random.Random(seed)`` samples from the sorted ids of each of ``strata``, stratum by stratum in order of their names.

    A sample depends on how many ids a stratum has, and not on which: the generator draws places on the driver, and the ids at these places are looked up. Ids are
    numbered over ranges, so no stratum is gathered. Strings sort by code points. Rows of other strata, and rows without an id, aren't drawn; repeated ids count each time."""
    if per_stratum < 1:
        raise ValueError("per_stratum must be positive")
    own = rows.select(stratum.alias("stratum"), F.col(key)).where(F.col("stratum").isin(*strata) & F.col(key).isNotNull())
    sizes = {r.stratum: r.n for r in own.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # as many rows as strata
    generator, drawn = random.Random(seed), []
    for name in sorted(strata):
        n = sizes.get(name, 0)
        drawn += [(name, place + 1) for place in generator.sample(range(n), min(per_stratum, n))]
    places = rows.sparkSession.createDataFrame(drawn, "stratum string, place long")
    numbered = running(own, [F.col(key)], {"place": F.lit(1)}, partition=["stratum"])
    return numbered.join(F.broadcast(places), ["stratum", "place"]).select("stratum", key)


def _measures(tp, tn, fp, fn) -> dict[str, np.ndarray]:
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"f1": ratio(2 * precision * recall, precision + recall), "balanced_accuracy": (recall + ratio(tn, tn + fp)) / 2, "recall": recall, "false_positive_rate": ratio(fp, fp + tn)}


def bootstrap(scored: DataFrame, *, replicates: int = 10_000, level: float = 0.95, seed: int = 20260830) -> DataFrame:
    """(metric, low, high): percentile intervals of four metrics of evaluator a, of b, and of b minus a.

    ``scored``: human, a, b. Metrics depend on the eight counts of human x a x b alone, so a replicate is one multinomial draw of
    them, whatever the number of rows. A replicate's generator is seeded by its number: partitions don't matter."""
    kinds = {(h, a, b): F.expr(f"count_if((human = '{POSITIVE}') = {h} and (a = '{POSITIVE}') = {a} and (b = '{POSITIVE}') = {b})").cast("double").alias(f"c{int(h)}{int(a)}{int(b)}") for h in (False, True) for a in (False, True) for b in (False, True)}
    cells = list(scored.agg(*kinds.values()).first())  # eight numbers
    total = int(sum(cells))
    order = list(kinds)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            picks = np.array([np.random.default_rng([seed, int(i)]).multinomial(total, np.array(cells) / total) for i in pdf["id"]], float).reshape(-1, 8)
            sums = lambda test: picks[:, [i for i, c in enumerate(order) if test(c)]].sum(1)
            m = [_measures(sums(lambda c: c[0] and c[s]), sums(lambda c: not c[0] and not c[s]), sums(lambda c: not c[0] and c[s]), sums(lambda c: c[0] and not c[s])) for s in (1, 2)]
            out = {f"a_{k}": v for k, v in m[0].items()} | {f"b_{k}": v for k, v in m[1].items()} | {f"delta_{k}": m[1][k] - m[0][k] for k in m[0]}
            yield pd.DataFrame({"metric": np.repeat(list(out), len(pdf)), "value": np.concatenate(list(out.values()))})

    spark = scored.sparkSession
    if not total:
        return spark.createDataFrame([], "metric string, low double, high double")
    values = spark.range(replicates).mapInPandas(draw, "metric string, value double")
    side = (1 - level) / 2
    return percentiles(values, "value", {"low": side, "high": 1 - side}, "metric", linear=True)
