"""Near-duplicates by an LSH forest over MinHash signatures.

1. One pass gives each document its number of shingles, a 128-bit key of its set and a signature. Equal sets
   become one representative, so copies cost nothing further.
2. Each of TREES orders sorts the representatives by its own DEPTH signature values. Range partitions follow the order, so a
   region of many similar documents spreads over partitions.
3. A sweep through each partition takes the runs whose first LEAST values agree. A run of more than REGION is
   split where deeper values differ, as deep as that region needs, and then by its sketches; what all these leave together is taken in pieces.
   Such parts share the region's first member. Rows at the ends of partitions are swept once more with the neighbouring partition's.
4. In a region, documents are compared by sketches (four bits of each signature value). A spanning forest of the
   closest pairs is handed on, a number of pairs linear in the rows, and confirmed on full sets.
5. The confirmed pairs' components label the documents of each family (what all pairs of the forest hold together). Where a
   family has several labels, its members meet across labels by the rarest of their shingles and are compared on full sets, so no link is missed that the
   forest did not need. Components of all links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import discard, partitions, sieved, stash
from gradus.llm.components import components
from gradus.llm.prefix_join import linked_labels

TREES, DEPTH, LEAST, REGION = 20, 6, 3, 1024
HASHES = TREES * DEPTH
#: How far below the wanted similarity a sketch's estimate may fall: over five of its standard errors at 0.8. All trees share the sketch, so what falls
#: below is lost for good: a pair at 0.8 with a chance under 1e-6.
SLACK = 0.20
#: Levels of four bits, from the sketch, that split a region further when the values of its order are used up.
DEEPER = 8

_random = np.random.default_rng(8)
_A = (_random.integers(1, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_known = _WordHashes()


def shingle_set(text: str | None, words: int = 2) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; of the whole sequence, if it has fewer words; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(own), 2048):
        low = np.minimum(low, ((own[at : at + 2048, None] * _A + _B) >> np.uint64(32)).min(0).astype(np.uint32))
    return low


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = shingle_set(text, words)
                some = len(own) > 0
                for column, value in zip(rows, (doc, len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest() if some else None, signature(own).tobytes() if some else None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["doc_id", "n_shingles", "key", "signature"])

    return run


_NODE = pa.schema([("order", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
_NODE_DDL = "order binary, node long, n long, sketch binary"


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the tree and its values, big-endian, so that bytes sort as values do."""
    for batch in batches:
        node, n, data = (batch.column(i).to_pylist() for i in range(3))
        for at in range(0, len(node), 1000):
            s = np.frombuffer(b"".join(data[at : at + 1000]), np.uint32).reshape(-1, HASHES)
            low = (s & np.uint32(15)).astype(np.uint8)
            sketch = [x.tobytes() for x in (low[:, ::2] << 4) | low[:, 1::2]]
            m = len(s)
            order = np.empty((TREES, m, 1 + 4 * DEPTH), np.uint8)
            for t in range(TREES):
                order[t, :, 0] = t
                order[t, :, 1:] = np.ascontiguousarray(s[:, t * DEPTH : (t + 1) * DEPTH].astype(">u4")).view(np.uint8).reshape(m, -1)
            flat = order.tobytes()
            w = 1 + 4 * DEPTH
            yield pa.RecordBatch.from_arrays(
                [pa.array([flat[i : i + w] for i in range(0, len(flat), w)], pa.binary()), *(pa.array(x[at : at + 1000] * TREES, pa.int64()) for x in (node, n)), pa.array(sketch * TREES, pa.binary())], schema=_NODE
            )


class _Region:
    """Pairs of a region: estimates from sketches, which sizes too unlike rule out."""

    def __init__(self, threshold: float):
        self.low, self.size = threshold - SLACK, threshold
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, node: np.ndarray, n: np.ndarray, sketch: list[bytes]) -> None:
        s = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(node), -1)
        self._forest(node, n, np.concatenate([s >> 4, s & 15], axis=1))

    def _near(self, s: np.ndarray, n: np.ndarray, i: int, others) -> np.ndarray:
        match = np.count_nonzero(s[others] == s[i], axis=1) / s.shape[1]
        size = n[others]
        return np.where(np.minimum(size, n[i]) >= self.size * np.maximum(size, n[i]), (match - 1 / 16) / (15 / 16), -1.0)

    def _emit(self, a: np.ndarray, b: np.ndarray) -> None:
        differ = a != b
        self.a.append(np.minimum(a, b)[differ])
        self.b.append(np.maximum(a, b)[differ])

    def _forest(self, node, n, s) -> None:
        """Prim's algorithm: the closest pairs that hold together what can be held together."""
        left = np.arange(1, len(node))
        best, by = self._near(s, n, 0, left), np.zeros(len(left), np.int64)
        a, b = [], []
        while len(left):
            k = int(np.argmax(best))
            i = left[k]
            if best[k] >= self.low:
                a.append(node[by[k]])
                b.append(node[i])
            left, best, by = np.delete(left, k), np.delete(best, k), np.delete(by, k)
            if len(left):
                near = self._near(s, n, i, left)
                closer = near > best
                best[closer], by[closer] = near[closer], i
        self._emit(np.array(a, np.int64), np.array(b, np.int64))

    def split(self, order: np.ndarray, node, n, sketch: list[bytes], depth: int = LEAST) -> None:
        """``order``: the values of rows that agree in the first ``depth``."""
        m = len(node)
        if m < 2:
            return
        if m <= REGION:
            self.add(node, n, sketch)
        elif depth < DEPTH:
            cuts = np.flatnonzero(order[1:, depth] != order[:-1, depth]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), m]):
                self.split(order[lo:hi], node[lo:hi], n[lo:hi], sketch[lo:hi], depth + 1)
        else:
            self._deeper(node, n, sketch, int(order[0, 0]) % (HASHES // 2), 0)

    def _deeper(self, node, n, sketch: list[bytes], at: int, level: int) -> None:
        """A region that agrees in all values of its order: split by bytes of the sketch from a place that the region chooses, then taken in pieces. Each part has
        the region's first member as well, which holds the parts together."""
        m = len(node)
        if m <= REGION:
            self.add(node, n, sketch)
        elif level < DEEPER // 2:
            groups: dict[int, list[int]] = {}
            for i, s in enumerate(sketch):
                groups.setdefault(s[(at + level) % len(s)], []).append(i)
            for own in groups.values():
                pick = own if own[0] == 0 else [0, *own]
                if len(pick) == m:
                    self._deeper(node, n, sketch, at, DEEPER)
                else:
                    self._deeper(node[pick], n[pick], [sketch[i] for i in pick], at, level + 1)
        else:
            for lo in range(0, m, REGION - 1):
                pick = np.unique(np.concatenate(([0], np.arange(lo, min(lo + REGION, m)))))
                self.add(node[pick], n[pick], [sketch[i] for i in pick])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.a, self.b))
        self.a, self.b = [], []
        return a, b


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int64()), *_NODE])
_OUT_DDL = "a long, b long, edge long, " + _NODE_DDL


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), f.type) for f in _OUT]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none[2:]], schema=_OUT)


def _values(order: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(order), np.uint8).reshape(len(order), -1)
    return np.ascontiguousarray(raw[:, 1:]).view(">u4").astype(np.uint32), raw[:, 0]


def _runs(values: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """Where runs begin, and the end."""
    new = (values[1:, :LEAST] != values[:-1, :LEAST]).any(1) | (tree[1:] != tree[:-1])
    return np.concatenate(([0], np.flatnonzero(new) + 1, [len(values)]))


def _sweep(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, part = _Region(threshold), TaskContext.get().partitionId()
        held: pa.Table | None = None
        first = True

        def ends(rows: pa.Table, edge: int) -> pa.RecordBatch:
            none = pa.nulls(len(rows), pa.int64())
            return pa.Table.from_arrays([none, none, pa.array([edge] * len(rows), pa.int64()), *rows.columns], schema=_OUT).combine_chunks().to_batches()[0]

        def work(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """All runs of ``rows`` but for the last one, which may go on."""
            nonlocal held, first
            order = rows.column(0).to_pylist()
            values, tree = _values(order)
            starts = _runs(values, tree)
            if not last and len(starts) == 2 and len(rows) < 64 * REGION:
                held = rows
                return
            stop = len(starts) - 1 if last or len(starts) == 2 else len(starts) - 2
            node, n = (rows.column(i).to_numpy() for i in (1, 2))
            sketch = rows.column(3)
            for k in np.flatnonzero(np.diff(starts[: stop + 1]) > 1):
                lo, hi = starts[k], starts[k + 1]
                region.split(values[lo:hi], node[lo:hi], n[lo:hi], sketch.slice(lo, hi - lo).to_pylist())
            yield _found(*region.pairs())
            if first:
                yield ends(rows.slice(0, min(starts[1], REGION // 2)), 2 * part)
                first = False
            if last:
                lo = max(starts[-2], len(rows) - REGION // 2)
                yield ends(rows.slice(lo), 2 * part + 1)
            held = rows.slice(starts[stop]) if starts[stop] < len(rows) else None
            if held is None and not last:  # a run too long to be held: its first member goes on with what follows
                held = rows.slice(starts[stop - 1], 1)

        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            yield from work(rows.combine_chunks(), False)
        if held is not None:
            yield from work(held.combine_chunks(), True)

    return run


def _border(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        region = _Region(threshold)
        rows = rows.sort_by([("order", "ascending"), ("node", "ascending")]).combine_chunks()
        values, tree = _values(rows.column("order").to_pylist())
        starts = _runs(values, tree)
        node, n = (rows.column(c).to_numpy() for c in ("node", "n"))
        for k in np.flatnonzero(np.diff(starts) > 1):
            lo, hi = starts[k], starts[k + 1]
            region.split(values[lo:hi], node[lo:hi], n[lo:hi], rows.column("sketch").slice(lo, hi - lo).to_pylist())
        a, b = region.pairs()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _candidates(nodes: DataFrame, threshold: float, made: list[DataFrame]) -> DataFrame:
    """(a, b), distinct: pairs to confirm. ``nodes``: node, n, signature; ``made`` gets the tables that are written."""
    spark = nodes.sparkSession
    rows = nodes.select("node", "n", "signature").mapInArrow(_orders, _NODE_DDL)
    swept = rows.repartitionByRange(partitions(spark), "order", "node").sortWithinPartitions("order", "node").mapInArrow(_sweep(threshold), _OUT_DDL)
    swept = stash(swept, "near-dedup-forest")
    made.append(swept)
    ends = swept.where("edge is not null").select("edge", "order", "node", "n", "sketch")
    # the end of a partition meets the beginning of the next one that has rows: a few numbers for each partition
    used = ends.select(F.floor(F.col("edge") / 2).alias("part")).distinct()
    before = used.select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    ends = ends.withColumn("part", F.floor(F.col("edge") / 2)).join(F.broadcast(before), "part")
    border = ends.withColumn("border", F.when(F.col("edge") % 2 == 1, F.col("part")).otherwise(F.col("before"))).where("border is not null")
    border = border.select("border", "order", "node", "n", "sketch").groupBy("border").applyInArrow(_border(threshold), "a long, b long")
    return swept.where("a is not null").select("a", "b").unionByName(border).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, own): the full sets of the wanted nodes (node, key), read from the texts again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, shingle_set(t, words)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for _, x in out], pa.binary()), pa.array([x.view(np.int64) for _, x in out], pa.list_(pa.int64()))], names=["node", "key", "own"])

    some = sieved(docs, wanted.withColumnRenamed("node", "doc_id"), "doc_id").where("hit").select("doc_id", "text").mapInArrow(run, "node long, key binary, own array<long>")
    return some.join(wanted, ["node", "key"], "left_semi").dropDuplicates(["node"]).select("node", "own")


def _confirm(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int, threshold_pct: int, made: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    made.append(stash(ends.join(nodes.select("node", "key"), "node"), "near-dedup-ends"))
    some = _sets(docs, made[-1], words)
    left = pairs.join(some.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")
    both = left.join(some.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return both.where(100 * shared >= threshold_pct * (F.size("own_a") + F.size("own_b") - shared)).select("a", "b")


def _crossing(docs: DataFrame, near: DataFrame, labels: DataFrame, nodes: DataFrame, words: int, threshold_pct: int, made: list[DataFrame]) -> DataFrame:
    """Links that the forest missed, as pairs (a, b) of labels: between the components of a family, the documents that candidate pairs hold together.

    Sets of a family meet by their rarest shingles, never all with all, so a family that a template holds together below the threshold is no more work than its rows."""
    members = components(near).withColumnRenamed("component", "family").join(labels, "node", "left").select("node", "family", F.coalesce("component", "node").alias("label"))
    members = stash(members, "near-dedup-members")
    several = members.groupBy("family").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one < other").select("family")
    rows = stash(members.join(several, "family", "left_semi").join(nodes.select("node", "key"), "node"), "near-dedup-family")
    sets = stash(_sets(docs, rows.select("node", "key"), words).join(rows.drop("key"), "node"), "near-dedup-sets")
    made += [members, rows, sets]
    return linked_labels(sets, threshold_pct, made)


def _group_rows(docs: DataFrame, words: int, threshold_pct: int) -> DataFrame:
    """``group`` where different sets have the same smallest id: rows are told apart by a hash of id and text."""
    rows = docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    judged = stash(group(rows, id_col="row", words=words, threshold_pct=threshold_pct).withColumnRenamed("doc_id", "row"), "near-dedup-rows")
    own = judged.drop("kept").join(rows.where("row is not null").select("row", "doc_id").distinct(), "row", "left")
    smallest = own.groupBy("component_id").agg(F.min("doc_id").alias("smallest"))
    return own.join(smallest, "component_id", "left").select("doc_id", "n_shingles", F.col("smallest").alias("component_id"), F.coalesce(F.col("smallest") == F.col("doc_id"), F.lit(True)).alias("kept"))


def group(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", words: int = 5, threshold_pct: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept (it is its own).

    Two texts are linked if their sets of shingles share ``threshold_pct`` percent of their union or more. Texts without words have no
    shingles, are linked with nothing and kept. Repeated ids: each row is judged by its own text. Rows without an id are kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stash(docs.mapInArrow(_sign(words), "doc_id long, n_shingles long, key binary, signature binary"), "near-dedup-signed")
    keyed = signed.where("key is not null")
    reps = stash(keyed.groupBy("key").agg(F.min("doc_id").alias("node")), "near-dedup-reps")
    if reps.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").take(1):
        return _group_rows(docs, words, threshold_pct)
    nodes = stash(keyed.join(reps, (keyed["key"] == reps["key"]) & (keyed["doc_id"] == reps["node"])).select("node", keyed["key"], F.col("n_shingles").alias("n"), "signature").dropDuplicates(["node"]), "near-dedup-nodes")
    made: list[DataFrame] = []
    near = stash(_candidates(nodes, threshold_pct / 100, made), "near-dedup-pairs")
    discard(*made)
    made = [near, nodes]
    links = stash(_confirm(docs, near, nodes, words, threshold_pct, made), "near-dedup-links")
    labels = stash(components(links), "near-dedup-labels")
    discard(links)
    more = stash(_crossing(docs, near, labels, nodes, words, threshold_pct, made), "near-dedup-more")
    discard(*made)
    if more.take(1):  # joined labels; a document that had no link is its own
        joined = components(more)
        old = joined.select(F.col("node").alias("component"), F.col("component").alias("new"))
        labels = labels.join(old, "component", "left").select("node", F.coalesce("new", "component").alias("component")).unionByName(joined).groupBy("node").agg(F.min("component").alias("component"))
    whole = signed.where("key is not null").select("doc_id", "n_shingles", "key").join(reps, "key").join(labels, "node", "left")
    whole = whole.select("doc_id", "n_shingles", "component", "node").unionByName(signed.where("key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("node")))
    own = F.coalesce("component", "node", "doc_id")
    return whole.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
