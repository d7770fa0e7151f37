"""Similar sets of one group but of different labels, by their rarest elements.

Elements order by how often they occur in their group, as far as a table of fixed size tells, and then by hash: one order everywhere. Of two sets that share enough, the first shared
element in this order stands near the head of both, so only heads meet: of the smaller set an even shorter one. Elements that most members have come last and meet nobody."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import stash
from gradus.llm.components import components

#: Buckets of counts that go to every task, 4 bytes each.
FEWEST_BITS, MOST_BITS = 16, 22

_HEADS = pa.schema([("family", pa.int64()), ("element", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("short", pa.bool_())])


def _bucket(family: np.ndarray, element: np.ndarray, bits: int) -> np.ndarray:
    h = (element.view(np.uint64) ^ (family.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)).astype(np.int64)


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all sets, one after another, and sizes."""
    own = batch.column("own")
    return own.flatten().to_numpy(), np.diff(own.offsets.to_numpy())


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.int64)
        for batch in batches:
            flat, sizes = _sets(batch)
            np.add.at(table, _bucket(np.repeat(batch.column("family").to_numpy(), sizes), flat, bits), 1)
        at = np.flatnonzero(table)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(table[at])], ["at", "n"])

    return run


def _heads(shared, pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = len(table).bit_length() - 1
        for batch in batches:
            flat, sizes = _sets(batch)
            family, node, label = (batch.column(c).to_numpy() for c in ("family", "node", "label"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            count = table[_bucket(family[owner], flat, bits)]
            order = np.lexsort((flat, count, owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = sizes.astype(np.int64)
            head, short = n + (-pct * n // 100) + 1, n + (-2 * pct * n // (100 + pct)) + 1
            keep = (place < head[owner]) & (count[order] > 1)
            o, at = owner[keep], order[keep]
            yield pa.record_batch([pa.array(x) for x in (family[o], flat[at], node[o], label[o], n[o], place[keep], place[keep] < short[o])], schema=_HEADS)

    return run


_DDL = "family long, element long, node long, label long, n long, place long, short boolean"


def linked_labels(sets: DataFrame, pct: int, made: list[DataFrame]) -> DataFrame:
    """(a, b): labels of one family that a link joins, the smaller first. ``sets``: family, label, node, own (an array of different hashes), a written table; a link is an intersection of ``pct`` percent
    of the union or more. Every two labels that links join directly are there, or hold together by pairs that are. ``made`` gets the tables that are written.

    First each label of an element meets two of that element's labels, one member each: that is linear, and joins what near copies of one text have left apart. Then members of labels that are
    still apart meet, at an element that can be the first one that they share."""
    spark = sets.sparkSession
    total = int(sets.agg(F.coalesce(F.sum(F.size("own").cast("long")), F.lit(0))).first()[0])
    bits = min(MOST_BITS, max(FEWEST_BITS, (2 * total).bit_length()))
    found = sets.select("family", "own").mapInArrow(_counted(bits), "at int, n long").groupBy("at").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    table = np.zeros(1 << bits, np.int32)
    table[found.column("at").to_numpy()] = found.column("n").to_numpy()
    heads = stash(sets.select("family", "label", "node", "own").mapInArrow(_heads(spark.sparkContext.broadcast(table), pct), _DDL), "near-dedup-heads")
    made.append(heads)
    known = stash(_confirmed(_stars(heads, pct), sets, pct), "near-dedup-stars")
    made.append(known)
    joined = components(known).select(F.col("node").alias("label"), F.col("component").alias("now"))
    rows = heads.join(joined, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")
    return known.unionByName(_confirmed(_apart(rows, pct), sets, pct)).distinct()


def _side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select("family", "element", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "n", "place")])


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _stars(heads: DataFrame, pct: int) -> DataFrame:
    """A member of each label at an element, with one of the smallest and one of the largest label there."""
    one = heads.groupBy("family", "element", "label").agg(F.min(F.struct("n", "node", "place")).alias("r")).select("family", "element", "label", "r.*")
    ends = one.groupBy("family", "element").agg(*[f(F.struct("label", "node", "n", "place")).alias(n) for n, f in (("low", F.min), ("high", F.max))]).where("low.label < high.label")
    ends = ends.select("family", "element", F.explode(F.array("low", "high")).alias("e")).select("family", "element", "e.*")
    return _pairs(_side(one, "x").join(_side(ends, "y"), ["family", "element"]).where(f"label_x <> label_y and 100 * least(n_x, n_y) >= {pct} * greatest(n_x, n_y)"))


def _apart(heads: DataFrame, pct: int) -> DataFrame:
    """Members of different labels at elements that may be the first that they share: enough of both sets comes after."""
    needed = f"ceil({pct} * (n_x + n_y) / {100 + pct}D - 1e-9D)"
    near = f"label_x <> label_y and n_x <= n_y and 100 * n_x >= {pct} * n_y and least(n_x - place_x, n_y - place_y) >= {needed}"
    return _pairs(_side(heads.where("short"), "x").join(_side(heads, "y"), ["family", "element"]).where(near))


def _confirmed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs of labels of those pairs of members that are links."""
    own = lambda c: sets.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("own").alias(f"own_{c}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").withColumn("shared", F.size(F.array_intersect("own_a", "own_b")))
    both = both.where(f"100 * shared >= {pct} * (size(own_a) + size(own_b) - shared)")
    return both.select(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).distinct()
