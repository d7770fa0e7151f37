"""Lloyd's rounds with two trees.

Vectors, as integers, lie in blocks; each block carries a cover tree, built once and written with it. In each round the centroids, a few, get a cover tree
too, and every block walks pairs of nodes of both trees from the roots down. A node knows its point and the distance of its farthest descendant, which bounds
every distance between two nodes: a pair goes if another centroid is surely nearer to all vectors of its node. What is left at the leaves is compared exactly, in
integers. Tasks hand on sums and numbers of vectors by centroid, never vectors.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import discard, small_batches, stash

#: Vectors of a block, points of a leaf, and pairs of points that are compared at once.
BLOCK, LEAF, PAIRS = 2048, 8, 1 << 14
#: A component times the scale has to stay below this, so that squared distances stay exact in 64 bits.
LARGEST = 1 << 26


class CoverTree:
    """Nodes in order of breadth: ``point`` and ``radius`` of each, children from ``low`` to ``high``, and, for leaves, members ``order[first:last]``.

    A node's children are points of it, the first its own; each child covers what lies within half the node's radius, and no two children lie that close."""

    FIELDS = ("point", "radius", "low", "high", "first", "last", "order")
    TYPES = (np.int32, np.float64, np.int32, np.int32, np.int32, np.int32, np.int32)

    def __init__(self, *arrays: np.ndarray):
        self.point, self.radius, self.low, self.high, self.first, self.last, self.order = arrays

    @classmethod
    def build(cls, points: np.ndarray) -> CoverTree:
        x = points.astype(np.float64)
        nodes, order = [[0, 0.0, 0, 0, 0, 0]], []
        waiting = deque([(0, np.arange(len(x)), _far(x, x[0]))])
        while waiting:
            node, members, far = waiting.popleft()
            radius = float(far.max())
            nodes[node][1] = radius * (1 + 1e-12)
            if len(members) <= LEAF or radius == 0:
                nodes[node][4:] = [len(order), len(order) + len(members)]
                order.extend(members.tolist())
                continue
            nodes[node][2] = len(nodes)
            center, left, away = nodes[node][0], members, far
            while len(left):
                near = away <= radius / 2
                waiting.append((len(nodes), left[near], away[near]))
                nodes.append([center, 0.0, 0, 0, 0, 0])
                left = left[~near]
                if len(left):
                    center = int(left[0])
                    away = _far(x[left], x[center])
            nodes[node][3] = len(nodes)
        columns = [np.array(c, t) for c, t in zip(zip(*nodes, strict=True), cls.TYPES, strict=False)]
        return cls(*columns, np.array(order, np.int32))

    def pack(self) -> list[bytes]:
        return [getattr(self, f).tobytes() for f in self.FIELDS]

    @classmethod
    def unpack(cls, packed: list[bytes]) -> CoverTree:
        return cls(*[np.frombuffer(b, t) for b, t in zip(packed, cls.TYPES, strict=True)])


def _far(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _children(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ranges' owners, and the ranges' numbers, one after another."""
    size = (high - low).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def nearest(x: np.ndarray, tree: CoverTree, c: np.ndarray, centers: CoverTree) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the number of the nearest row of ``c`` (ties: the smaller) and the squared distance, exactly."""
    best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(c))
    above = np.full(len(tree.point), np.inf)  # no vector of the node is farther from its nearest centroid
    u, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    while len(u):
        d = np.empty(len(u))
        for i in range(0, len(u), PAIRS):
            s = slice(i, i + PAIRS)
            d[s] = np.sqrt(((xf[tree.point[u[s]]] - cf[centers.point[q[s]]]) ** 2).sum(1))
        ru, rq = tree.radius[u], centers.radius[q]
        np.minimum.at(above, u, d + ru)
        near = d - ru - rq <= above[u] * (1 + 1e-9) + 1e-6  # the slack is far above what rounding does
        u, q, ru, rq = u[near], q[near], ru[near], rq[near]
        leaf, end = tree.high[u] == 0, centers.high[q] == 0
        both = leaf & end
        _compare(x, tree, c, centers, u[both], q[both], best, number)
        down = ~leaf & (end | (ru >= rq))
        owner, kids = _children(tree.low[u[down]], tree.high[u[down]])
        above[kids] = np.minimum(above[kids], above[u[down]][owner])
        other = ~both & ~down
        owner2, kids2 = _children(centers.low[q[other]], centers.high[q[other]])
        u, q = np.concatenate([kids, u[other][owner2]]), np.concatenate([q[down][owner], kids2])
    return number, best


def _compare(x: np.ndarray, tree: CoverTree, c: np.ndarray, centers: CoverTree, u: np.ndarray, q: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
    """Pairs of leaves, point by point."""
    owner, at = _children(tree.first[u], tree.last[u])
    row, q = tree.order[at], q[owner]
    owner, at = _children(centers.first[q], centers.last[q])
    row, col = row[owner], centers.order[at]
    for i in range(0, len(row), PAIRS):
        r, k = row[i : i + PAIRS], col[i : i + PAIRS]
        d = ((x[r] - c[k]) ** 2).sum(1)
        order = np.lexsort((k, d, r))
        r, k, d = r[order], k[order], d[order]
        first = np.append(True, r[1:] != r[:-1])
        r, k, d = r[first], k[first], d[first]
        better = (d < best[r]) | ((d == best[r]) & (k < number[r]))
        best[r[better]], number[r[better]] = d[better], k[better]


_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), *((f, pa.binary()) for f in CoverTree.FIELDS)])


def _blocks(size: int, scale: int):
    def block(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        if np.abs(x).max() >= LARGEST:
            raise ValueError(f"a component times {scale} has to lie below {LARGEST}")
        x = x.astype(np.int64)
        row = [ids, x.tobytes(), *CoverTree.build(x).pack()]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []
        for batch in batches:
            flat = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size) * scale)
            own = batch.column(0).to_pylist()
            for i in range(0, len(own), BLOCK):
                ids, parts = ids + own[i : i + BLOCK], [*parts, flat[i : i + BLOCK]]
                while len(ids) >= BLOCK:
                    x = np.concatenate(parts)
                    yield block(ids[:BLOCK], [x[:BLOCK]])
                    ids, parts = ids[BLOCK:], [x[BLOCK:]]
        if ids:
            yield block(ids, parts)

    return run


def _assigned(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    centers = CoverTree.build(c)
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["vectors"], np.int64).reshape(-1, c.shape[1])
            yield row["ids"], x, *nearest(x, CoverTree.unpack([row[f] for f in CoverTree.FIELDS]), c, centers)


def _sums(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for _, x, number, _ in _assigned(batches, c):
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            totals[own] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(number, minlength=len(c))
        for k in np.flatnonzero(counts).tolist():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([int(counts[k])], pa.int64()), pa.array([totals[k].tolist()], pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _members(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, best in _assigned(batches, c):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def lloyd(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the vectors with exactly ``size`` components, none null or non-finite.

    Components count as floor(scale x). The first centroids are the ``k`` vectors with the smallest sha256 of ``salt:id``, or all if there are fewer; ties go by the vector.
    A centroid moves to the floor of its vectors' mean, and stays if it has none. Repeated rows count each time; rows without an id are assigned but never begin
    as centroids (if no row has an id, there are no centroids and no rows). An empty table gives none. Other columns of any name aren't read. Components that reach LARGEST after scaling are an error.

    ``k`` and ``size`` are parameters: centroids are what is broadcast and gathered, k times size integers."""
    spark = vectors.sparkSession
    small_batches(spark)
    fine = F.expr(f"size(embedding) = {size} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")).where(fine)
    drawn = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("draw"), "embedding").orderBy("draw", "embedding").limit(k).collect()
    if not drawn:
        return rows.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    c = np.floor(np.array([r.embedding for r in drawn]) * scale).astype(np.int64)
    blocks = stash(rows.mapInArrow(_blocks(size, scale), "ids array<long>, vectors binary, " + ", ".join(f"{f} binary" for f in CoverTree.FIELDS)), "cluster-blocks")
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(c), "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "part"))
        c = c.copy()
        for r in sums.groupBy("cluster", "at").agg(F.sum("part").alias("total"), F.sum("n").alias("n")).collect():  # k times size rows
            c[r.cluster, r["at"]] = r.total // r.n
    members = stash(blocks.mapInArrow(_members(c), "vec_id long, cluster int, distance long"), "cluster-members")
    discard(blocks)
    own = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    rows = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in own), hashlib.sha256(",".join(map(str, c[r.cluster].tolist())).encode()).hexdigest()) for r in own]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
