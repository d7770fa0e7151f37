"""Decontamination, clustering and collocations against brute force, on odd rows too."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradus.llm import clusters, contamination, phrases

SMALL = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- decontamination ---------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def marked(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = Counter()
    for i, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if (own := tuple(w[at : at + n])) in windows:
                    hit |= set(range(at, at + n))
                    found |= {x for x in windows[own] if x is not None}
        listed = sorted(map(str, found))
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)] += 1
    return out


def rows_of(frame):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


def test_decontamination(spark):
    draw = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "ß", "日本", "x"]
    say = lambda n: " ".join(draw.choices(words, k=n))
    items = [(i, say(draw.randint(10, 40))) for i in range(30)] + [(100 + n, say(n)) for n in range(1, 10) for _ in range(2)]
    items += [(200, items[0][1]), (200, items[1][1]), (None, say(30)), (201, None), (202, ""), (203, " .,"), (204, "the " * 12), (9, items[9][1]), (10, say(12))]
    docs = [(i, say(draw.randint(0, 60))) for i in range(60)]
    for i, (_, t) in enumerate(items):
        own = (t or "").split()
        docs.append((1000 + i, f"{say(5)}, {(t or '').upper()}! {say(5)}"))
        docs.append((2000 + i, f"{say(3)} {' '.join(own[2:])}\n{' '.join(own[: len(own) // 2])}"))
        docs.append((3000 + i, "-".join(own[:9])))
    docs += [(1, None), (2, ""), (None, items[3][1]), (4, docs[70][1]), (4, docs[70][1]), (4, docs[71][1]), (5, "the " * 5000), (6, " ".join(t or "" for _, t in items) * 3)]
    frame = spark.createDataFrame([(i, t, 7, "old", 1) for i, t in docs], "doc_id long, text string, n_hit int, own_words string, text_one int").repartition(5)
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, w string")
    got = contamination.mark(frame, bench)
    assert got.columns[:2] == ["doc_id", "text"] and got.where("own_words <> 'old' or text_one <> 1").count() == 0
    assert rows_of(got) == marked(docs, items)
    whole = [x for x in items if len(WORD.findall(lower(x[1]))) >= 10]
    assert rows_of(contamination.mark(frame, bench.where("size(split(text, ' ')) >= 10"))) == marked(docs, whole)
    assert rows_of(contamination.mark(frame, bench.limit(0))) == marked(docs, [])
    assert contamination.mark(frame.limit(0), bench).count() == 0


def test_decontamination_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(contamination, "MOST_BROADCAST", 0)
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = marked([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert rows_of(contamination.mark(docs, bench)) == want and any(k[-1] for k in want)


# ---- clustering --------------------------------------------------------------------------------------------------


def lloyd(rows, size, k, rounds):
    rows = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centers = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))
    for _ in range(rounds if centers else 0):
        own = defaultdict(list)
        for _, v in rows:
            own[nearest(v)[1]].append(v)
        centers = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centers)]
    found = [(i, *nearest(v)) for i, v in rows] if centers else []
    inertia = Counter()
    for _, d, n in found:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for i, d, n in found)


def clustered(spark, rows, size, k, rounds):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    return Counter(tuple(r) for r in clusters.lloyd(frame, size=size, k=k, rounds=rounds).collect())


def as_floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_clusters(spark):
    rng = np.random.default_rng(2)
    some = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    lumps = [(i, (rng.normal(size=4) * 0.05 + 3 * (i % 7)).tolist()) for i in range(300)]
    odd = [(5000, None), (5001, [1.0, 2.0, 3.0]), (5002, [1.0, None, 2.0, 3.0]), (5003, [1.0, float("nan"), 2.0, 3.0]), (5004, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5]), (7, some[7][1]), (7, some[8][1]), (5005, []), (5006, [300.0, -400.0, 1e-9, -1e-9])]
    copies = [(6000 + i, [0.25, -0.25, 0.0, 1.0]) for i in range(200)]
    ties = [(i, [float(i % 3), 0.0, 0.0, float(i % 2)]) for i in range(50)]
    for rows, k, rounds in ((some + odd + copies, 12, 3), (lumps, 7, 4), (ties, 9, 2), (some[:3], 40, 2), ([], 4, 2), ([(None, [1.0] * 4)], 4, 1), (copies, 5, 2)):
        rows = as_floats(rows)
        assert clustered(spark, rows, 4, k, rounds) == lloyd(rows, 4, k, rounds)


def test_pruned_pairs_lose_nothing():
    rng = np.random.default_rng(5)
    for spread in (1, 20, 2000):
        centers = rng.integers(-5000, 5000, (30, 6))
        x = centers[rng.integers(0, 30, 900)] + rng.integers(-spread, spread + 1, (900, 6))
        c = np.concatenate([x[:25], x[:3]])
        number, best = clusters.nearest(x, clusters.CoverTree.unpack(clusters.CoverTree.build(x).pack()), c, clusters.CoverTree.build(c))
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (number == d.argmin(1)).all()


def test_cover_tree():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-100, 100, (400, 3)), np.zeros((30, 3), np.int64)])
    tree = clusters.CoverTree.build(x)
    far = lambda a, b: np.sqrt(((x[a] - x[b]) ** 2).sum(-1))

    def members(n):
        if tree.high[n] == 0:
            return tree.order[tree.first[n] : tree.last[n]].tolist()
        return [m for kid in range(tree.low[n], tree.high[n]) for m in members(kid)]

    assert sorted(members(0)) == list(range(len(x)))
    for n in range(len(tree.point)):
        assert tree.point[n] in members(n) and all(far(tree.point[n], m) <= tree.radius[n] for m in members(n))
        kids = tree.point[tree.low[n] : tree.high[n]]
        assert len(kids) == 0 or kids[0] == tree.point[n]
        assert all(far(a, b) > tree.radius[n] / 2 * (1 - 1e-9) for i, a in enumerate(kids) for b in kids[:i])


# ---- collocations ------------------------------------------------------------------------------------------------


def collocated(docs, least, top, longest=5):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = defaultdict(int)
    for (lang, w), a in often.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in often.items():
        if inside[lang, w] < a:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for r, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


@pytest.mark.parametrize(("hot", "together"), [(phrases.HOT, phrases.TOGETHER), (7, 300)])
def test_collocations(spark, hot, together):
    draw = random.Random(3)
    docs = []
    for i in range(200):
        lang = draw.choice(["en", "de", "und", None, "日"])
        some = ["a", "b", "c", "d"] if i % 3 else [f"W{k}" for k in range(40)] + ["É", "é", "x-y", "\x00", "ｗ"]
        docs.append((lang, "".join(draw.choice(some) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " ! "]) for _ in range(draw.randint(0, 120)))))
    docs += [("en", None), ("en", ""), ("en", " . "), ("en", "new york city hall now " * 40), ("en", docs[0][1]), ("en", docs[0][1]), ("", "a b a b a b a b a b"), ("de", "same " * 500), ("de", "p q. " * 300)]
    frame = spark.createDataFrame([(i, *d, "k") for i, d in enumerate(docs)], "doc_id long, lang string, text string, phrase string").repartition(4)
    for least, top in ((5, 2000), (12, 6)):
        got = [tuple(r) for r in phrases.collocations(frame, least=least, top=top, hot=hot, together=together).collect()]
        want = collocated(docs, least, top)
        assert len(got) == len(want) > 20 and set(got) == want
    assert phrases.collocations(frame.limit(0)).count() == 0 and phrases.collocations(frame, least=10**6).count() == 0


def test_scores_beyond_64_bits(spark):
    one = spark.createDataFrame([("en", "a b", 4 * 10**15)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "a", 5 * 10**15), ("en", "b", 7 * 10**15)], "lang string, phrase string, a long")
    got = phrases._ranked(one, words, spark.createDataFrame([("en", 9 * 10**17)], "lang string, n long"), 5).first()
    assert got.score == 1000 * 4 * 10**15 * 9 * 10**17 // (35 * 10**30)


# ---- long tokens and words in personal data ----------------------------------------------------------------------


def test_long_tokens_are_told_apart(spark):
    same, word = "k9" * 200, "w" * 80
    seeds = [f"write to user{i}@mail.example now" for i in range(6)]
    texts = [*seeds, f"please write to {same}a here", f"other words {same}b here", f"other words {same}a here"]
    # words that end alike are two contexts: only the first one precedes seeds
    texts += [f"x {'a' + word} {'b' + word} one{i}@mail.example" for i in range(6)] + [f"x {'a' + word} {'b' + word} id-77", f"x {'c' + word} {'d' + word} id-88"]
    from gradus.llm import pii

    got = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[6] == f"id:16:{16 + len(same) + 1}" and got[7] == "" and got[8].startswith("id:12:")
    assert got[15].startswith("id:") and got[16] == ""
