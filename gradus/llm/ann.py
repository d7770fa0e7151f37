"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

1. Equal vectors become one row with the smallest of their ids, as many as a result can hold.
2. TABLES tables hash a unit vector by HASHES projections on Gaussian directions, cut into steps of WIDTH: its bucket. A bucket
   directory (at most STEPS ** HASHES buckets for each table, at any size of the data) has the occupied ones with their rows.
3. A query visits buckets in the order of the estimated probability that a near neighbour lies there. For unit vectors of
   cosine c, the neighbour's projection is normal around c times the query's; each query's c is a low guess of its k-th neighbour's from a
   bounded sample of rows, so a query far from all others looks farther. It goes on until the probabilities add up to TARGET and the buckets hold LEAST ids, and k besides the query's own, or all
   buckets are visited, so probes follow the data and have no cap.
4. Buckets in a row fill blocks of BLOCK rows; a bucket that holds more is dealt over several by a hash of the id. Each block
   compares its rows with the queries that visit them, a chunk of queries at a time, and hands on each query's best.
5. The tables' candidates are merged and ranked by the exact cosine.

On data without structure (the driver's vectors are near uniform on the sphere), neighbours lie hardly closer than anything else, and
a recall of 0.9 takes visits to most buckets: no hashing avoids that. Blocks then do it as matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import stash

TABLES, HASHES, WIDTH, STEPS, TARGET, LEAST, BLOCK, QUERIES, SAMPLE = 2, 6, 1.5, 6, 0.93, 256, 2048, 50_000, 2048

_GRID = np.linspace(-9, 9, 18_001)
_PHI = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in _GRID])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors], np.float64)


class _Hashing:
    """Directions and offsets of all tables, from a fixed seed."""

    def __init__(self, dimension: int):
        rng = np.random.default_rng(4)
        self.directions = rng.standard_normal((TABLES, dimension, HASHES))
        self.offsets = rng.random((TABLES, HASHES)) * WIDTH
        self.powers = STEPS ** np.arange(HASHES)

    def steps(self, unit: np.ndarray, table: int) -> np.ndarray:
        at = np.floor((unit @ self.directions[table] + self.offsets[table]) / WIDTH).astype(np.int64) + STEPS // 2
        return np.clip(at, 0, STEPS - 1)

    def bucket(self, unit: np.ndarray, table: int) -> np.ndarray:
        return self.steps(unit, table) @ self.powers

    def chances(self, unit: np.ndarray, table: int, buckets: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """For each query and bucket, the probability that a neighbour of the query's cosine is there."""
        cosine = cosine[:, None, None]
        spread = np.sqrt(np.maximum(1e-6, 1 - cosine * cosine))
        bounds = (np.arange(1, STEPS) - STEPS // 2) * WIDTH
        at = (bounds[None, None, :] - self.offsets[table][None, :, None] - cosine * (unit @ self.directions[table])[:, :, None]) / spread
        below = np.interp(at, _GRID, _PHI)
        one = np.diff(np.concatenate([np.zeros_like(below[..., :1]), below, np.ones_like(below[..., :1])], axis=2), axis=2)
        out = np.ones((len(unit), len(buckets)))
        for i in range(HASHES):
            out *= one[:, i, (buckets // self.powers[i]) % STEPS]
        return out


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("id").agg(F.min("v").alias("v"))


def _cosines_of_kth(queries: np.ndarray, sample: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each query a low guess of its k-th largest cosine among n rows: what a normal law with mean and spread of its cosines to the sample says, or the k-th in
    the sample itself if that is less; in the whole table it is nearer, never farther."""
    if len(sample) <= k + 1:
        return np.zeros(len(queries))
    c = queries @ sample.T
    own = c > 1 - 1e-9  # the query itself, where it is in the sample
    c[own] = np.nan
    z = float(np.interp(1 - min(0.5, k / max(n, 1)), _PHI, _GRID))
    normal = np.nanmean(c, axis=1) + z * np.nanstd(c, axis=1)
    c[own] = -np.inf
    return np.clip(np.minimum(normal, np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k]), 0.0, 0.99)


def _compare(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(queries) or not len(rows):
            return none
        ids, low = list(rows["ids"]), np.array([i[0] for i in rows["ids"]])
        alone = np.array([len(i) == 1 for i in rows["ids"]])
        vectors = _matrix(rows["v"])
        unit = _unit(vectors)
        buckets, own = np.unique(rows["bucket"].to_numpy(), return_inverse=True)
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            q = _unit(_matrix(part["v"]))
            visits = np.zeros((len(part), len(buckets)), bool)
            for i, wanted in enumerate(part["buckets"]):
                visits[i, np.searchsorted(buckets, np.intersect1d(wanted, buckets))] = True
            scores = q @ unit.T
            scores[~visits[:, own]] = -np.inf
            for i, query_id in enumerate(part["query_id"]):
                s = scores[i]
                s[alone & (low == query_id)] = -np.inf
                m = min(len(s), k + 12)
                cut = np.partition(s, len(s) - m)[len(s) - m]
                best = np.flatnonzero((s >= cut) & (s > -np.inf))
                if not len(best):
                    continue
                exact = np.clip(np.einsum("ij,ij->i", np.broadcast_to(q[i], (len(best), q.shape[1])), unit[best]), -1.0, 1.0)
                order = np.lexsort((low[best], -exact))[: k + 1]
                found = sorted((-exact[j], int(v)) for j in order for v in ids[best[j]] if v != query_id)[:k]
                out_q += [query_id] * len(found)
                out_s += [-x for x, _ in found]
                out_v += [v for _, v in found]
        return pd.DataFrame({"query_id": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, np.float64)})

    return run


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` marks (a condition on the column ``id``), its k nearest others found, or all others if there are fewer.

    Larger cosine first, smaller id at ties. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do those of another length than most of the sample. Of rows that repeat an id, the smallest vector counts."""
    spark = vectors.sparkSession
    valid = _valid(vectors, id_col, vec_col)
    few = Window.partitionBy("v").orderBy("id")
    reps = valid.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    reps = stash(reps, "ann-vectors")
    sample = [v for (v,) in reps.orderBy(F.xxhash64(F.col("ids")[0])).select("v").limit(SAMPLE).collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    dimension = int(pd.Series([len(v) for v in sample]).mode()[0])
    reps = reps.where(F.size("v") == dimension)
    hashing = _Hashing(dimension)
    n = reps.count()
    some = spark.sparkContext.broadcast(_unit(_matrix([v for v in sample if len(v) == dimension])))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(_matrix(pdf["v"]))
                yield pd.concat([pd.DataFrame({"table": t, "bucket": hashing.bucket(unit, t), "n": pdf["n"]}) for t in range(TABLES)])

    counts = reps.select("v", F.size("ids").alias("n")).mapInPandas(place, "table int, bucket long, n long").groupBy("table", "bucket").agg(F.count("*").alias("count"), F.sum("n").alias("ids")).orderBy("table", "bucket").toPandas()
    directory = []
    for t in range(TABLES):
        own = counts[counts["table"] == t]
        size = own["count"].to_numpy()
        directory.append((own["bucket"].to_numpy(), np.cumsum(size) - size, size, own["ids"].to_numpy()))
    shared = spark.sparkContext.broadcast(directory)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            unit = _unit(_matrix(pdf["v"]))
            for t, (buckets, first, size, _) in enumerate(shared.value):
                bucket = hashing.bucket(unit, t)
                at = np.searchsorted(buckets, bucket)
                yield pd.DataFrame({"table": t, "block": (first[at] + pdf["salt"].to_numpy() % size[at]) // BLOCK, "bucket": bucket, "ids": pdf["ids"], "v": pdf["v"]})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                unit = _unit(_matrix(part["v"]))
                cosine = _cosines_of_kth(unit, some.value, k, n)
                rows: list[tuple] = []
                for t, (buckets, first, size, ids) in enumerate(shared.value):
                    chance = hashing.chances(unit, t, buckets, cosine)
                    order = np.argsort(-chance, axis=1, kind="stable")
                    mass = np.cumsum(np.take_along_axis(chance, order, 1), axis=1)
                    stop = (mass < TARGET * mass[:, -1:]).sum(1) + 1
                    held = np.cumsum(ids[order], axis=1)
                    stop = np.minimum(np.maximum(stop, (held < max(k + 1, LEAST)).sum(1) + 1), len(buckets))
                    for i, query_id in enumerate(part["query_id"]):
                        visit = order[i, : stop[i]]
                        lo, hi = first[visit] // BLOCK, (first[visit] + size[visit] - 1) // BLOCK
                        for block in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in np.unique(np.stack([lo, hi], 1), axis=0)])):
                            rows.append((t, block, query_id, part["v"].iloc[i], np.sort(buckets[visit[(lo <= block) & (hi >= block)]])))
                yield pd.DataFrame(rows, columns=["table", "block", "query_id", "v", "buckets"])

    asked = valid.where(F.size("v") == dimension).where(is_query).select(F.col("id").alias("query_id"), "v")
    chunks = max(1, -(-asked.count() // QUERIES))
    queries = asked.mapInPandas(probe, "table int, block long, query_id long, v array<double>, buckets array<long>").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    rows = reps.select("ids", "v", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(1 << 40)).alias("salt")).mapInPandas(index, "table int, block long, bucket long, ids array<long>, v array<double>")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    by = ["table", "block", "chunk"]
    found = queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(_compare(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
