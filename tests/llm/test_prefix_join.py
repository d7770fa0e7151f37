import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import near_dedup, prefix_join
from gradus.llm.common import stash

DDL = "family long, label long, node long, own array<long>"


def brute(rows, pct):
    sets = [(f, lab, n, set(own)) for f, lab, n, own in rows]
    return {(min(a[1], b[1]), max(a[1], b[1])) for i, a in enumerate(sets) for b in sets[:i] if a[0] == b[0] and a[1] != b[1] and 100 * len(a[3] & b[3]) >= pct * len(a[3] | b[3])}


@pytest.mark.parametrize(("bits", "pct"), [((16, 22), 80), ((3, 3), 80), ((16, 22), 65)])
def test_no_link_is_lost(spark, monkeypatch, bits, pct):
    """Sets near the threshold on either side, of many sizes; with a table of counts that tells nothing as well."""
    monkeypatch.setattr(prefix_join, "FEWEST_BITS", bits[0])
    monkeypatch.setattr(prefix_join, "MOST_BITS", bits[1])
    rng = np.random.default_rng(3)
    rows, node = [], 0
    for family in range(12):
        base = rng.integers(-(1 << 62), 1 << 62, int(rng.integers(1, 120)))
        for _ in range(40):
            own = base[rng.random(len(base)) < rng.choice([1.0, 0.95, 0.9, 0.8])]
            own = np.concatenate([own, rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, max(2, len(base) // 4))))])
            if len(own):
                rows.append((family, int(rng.integers(0, 25)) + 100 * family, node, sorted(set(own.tolist()))))
                node += 1
    made = []
    got = [tuple(r) for r in prefix_join.linked_labels(stash(spark.createDataFrame(rows, DDL).repartition(3), "test"), pct, made).collect()]
    want = brute(rows, pct)
    assert set(got) <= want and len(got) == len(set(got)) and groups(got) == groups(want) and len(want) > 20
    assert prefix_join.linked_labels(stash(spark.createDataFrame([], DDL), "test"), pct, made).count() == 0


def groups(pairs):
    above = {}

    def find(x):
        while above.get(x, x) != x:
            x = above[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        above[max(x, y)] = min(x, y)
    return {x: find(x) for p in pairs for x in p}


def test_near_copies_left_apart_are_linear_work(spark):
    """Thousands of near copies of one text, with hundreds of labels: what meets stays far below their pairs."""
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 62), 1 << 62, 200)
    rows = []
    for i in range(3000):
        own = base.copy()
        own[rng.integers(0, 200, 6)] = rng.integers(-(1 << 62), 1 << 62, 6)
        rows.append((0, i if i % 10 == 0 else 0, i, sorted(set(own.tolist()))))
    sets, made = stash(spark.createDataFrame(rows, DDL).repartition(4), "test"), []
    links = prefix_join.linked_labels(sets, 80, made).collect()
    assert set(groups([tuple(r) for r in links]).values()) == {0} and len(groups([tuple(r) for r in links])) == 300
    heads, known = made
    assert prefix_join._stars(heads, 80).count() < 20 * len(rows)
    rest = heads.withColumn("label", F.lit(0).cast("long"))
    assert known.count() > 0 and prefix_join._apart(rest, 80).count() == 0


def test_a_template_is_linear_work(spark):
    """Pages of one template, none linked but the planted pairs: what meets doesn't grow with the square of the family."""
    shared = [f"t{i}" for i in range(160)]
    met = []
    for n in (1500, 6000):
        texts = [" ".join([*shared, *(f"o{i}-{k}" for k in range(40))]) for i in range(n)]
        for i in range(0, 40, 2):
            texts[i + 1] = texts[i].replace(f"o{i}-3 ", "")
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        got = {r.doc_id: r.component_id for r in near_dedup.group(docs, words=2).collect()}
        assert got == {i: i - 1 if i < 40 and i % 2 else i for i in range(n)}
        sets = spark.createDataFrame([(0, i, i, [int(x) for x in near_dedup.shingle_set(t).view(np.int64)]) for i, t in enumerate(texts)], DDL)
        sets = stash(sets, "test")
        heads = sets.select("family", "label", "node", "own").mapInArrow(prefix_join._heads(spark.sparkContext.broadcast(_table(sets)), 80), prefix_join._DDL)
        pairs = heads.where("short").alias("x").join(heads.alias("y"), ["family", "element"]).where("x.label <> y.label").count()
        met.append(pairs)
    assert met[1] <= 5 * met[0] + 1000 and met[1] < 6000 * 20


def _table(sets):
    table = np.zeros(1 << 20, np.int32)
    found = sets.select("family", "own").mapInArrow(prefix_join._counted(20), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    table[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return table
