"""The first ten operators against brute force, on the smallest table and on odd rows: nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gradus.llm import ann, byte_bpe, common, near_dedup, packing, pii, quality, queries, repeats, token_count, toxicity, url_filter

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n a", "a\n", "\t x", "x\x1cy z\x85 q\xa0r", "it's I'LL 'Re don't'd", "▁a ▁ b", "<|endoftext|> hi <s>", "日本語 テキスト", "Ünïcödé ﬁ ½ ² ª é", "İstanbul ΑΣ ẞ",
    "a" * 3000, " " * 500, "🙂 x y", "12 345 ١٢ €", "a\r\nb\x0bc", "\x00a\x7f", "one", "ONE", "one two", "Two one", "a b c d e f a b c d e f g", "l\nl\nl\n \n \n",
    "a@b.c@d.e x@y @z.w a@b.c.d-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.04", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713 +1234567890123456 +12", "é@x.y a@@b.c", "xyz " * 400,
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate(ODD)] + [(10**6 + 50, "b" * 400), (10**6 + 51, "b" * 400), (10**6 + 52, "q" + rows[5][1] + "é" + rows[7][1]), (10**6 + 53, "é" * 300 + "x" + "é" * 300)]
    return rows


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n_tokens int").repartition(3)


EMPTY = "doc_id long, text string"


def test_url_filter(spark):
    urls = ["https://a.example.net/en/1?x", "http://EXAMPLE.net/de/#y", "https://example.com/de/", "https://x.org/fr/z", "https://x.org", "x", None, "https://notexample.net/en/", "ftp://net/", "https://net", "https://a..net/q", "https://example.net:80/en/", "://", "https://example.net/en/", "https://example.net/en/"]
    rules = url_filter.DEFAULT_RULES + (("a.example.net", "/", "block"),)
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for chunks in (1, 5):
        got = {r.page_id: r for r in url_filter.filter_urls(rows, url_filter.rules_frame(spark, rules), chunks=chunks).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            rest = u.split("://", 1)[1] if u and "://" in u else ""
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
            fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
            best = max(fit, default=(0, 0, None, "allow"))
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[2], best[3])
    assert url_filter.filter_urls(rows.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_token_counts(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, docs), path, limit=100).collect()}
    for i, t in docs:
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), t
    assert token_count.count_tokens(spark.createDataFrame([], EMPTY), path).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = defaultdict(list)
    rows = packing.pack(frame(spark, docs), path, window=512).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids.tobytes() and own[0].doc_tokens == len(ids), t
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in own)
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 512 + r.offset == at and r.offset + r.length <= 512
        at += r.length
    assert packing.pack(spark.createDataFrame([], EMPTY), path).count() == 0


def test_short_way_of_the_word_encoder():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    encoder, library = packing.WordEncoder(path), Tokenizer.from_file(path)
    assert encoder.coder is not None
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyzéèßñü0123456789.,-'!")
    for _ in range(3000):
        word = "".join(rng.choice(letters, rng.integers(1, 14)))
        assert np.frombuffer(encoder.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_byte_bpe(spark, docs, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(byte_bpe, "BLOCK", 20_000)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(frame(spark, docs), path, P.PATTERN), path).collect()
    want = Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in docs)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == want
    assert byte_bpe.encode(spark.createDataFrame([], EMPTY), path, P.PATTERN).count() == 0


def test_quality(spark, docs):
    got = {r.doc_id: r for r in quality.score(frame(spark, docs)).collect()}
    for i, t in docs:
        words = WORD.findall(t or "")

        def inside(n, words=words):
            grams = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
            return {k + j for k in range(len(words) - n + 1) if grams[tuple(words[k : k + n])] > 1 for j in range(n)}

        seen, copies, chars = set(), 0, 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                copies += line in seen
                chars += (line in seen) * sum(map(len, WORD.findall(line)))
                seen.add(line)
        total, five = sum(map(len, words)), len(inside(5))
        failed = len(words) < 10 or 100 * five > 20 * len(words)
        shares = all(sum(len(words[k]) for k in inside(n)) <= s * total for n, s in quality.NGRAM_SHARE.items()) and chars <= quality.LINE_SHARE * total
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), total, len(re.findall(r"[#*$%&|<>]", t or "")), copies, five)
        assert (r.base_failed, r.kept) == (failed, not failed and shares)


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def test_pii_base(spark, docs):
    rows = {r.doc_id: r for r in pii.detect(frame(spark, docs)).collect()}
    assert len(rows) == len(docs)
    for i, t in docs:
        spans = sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, t or "") if base_passes(kind, m[0]))
        line = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) <= set(rows[i].spans.split(",")), t


def test_pii_bootstrap(spark):
    rows = [(i, f"please mail to: u{i}@x.org now") for i in range(9)] + [(20, "mail to: jane(at)x1 now and elsewhere jane(at)x1"), (21, "token = abc123def"), (22, None)]
    found = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(rows, EMPTY)).collect()}
    assert found[20] == "id:9:19,id:38:48" and found[21] == "" and found[22] == ""
    texts = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, EMPTY)).collect()}
    assert texts[20] == "mail to: <id> now and elsewhere <id>" and texts[0] == "please mail to: <email> now" and texts[22] is None
    assert pii.detect(spark.createDataFrame([], EMPTY)).count() == 0


def test_pii_bootstrap_goes_on_and_needs_no_context(spark):
    texts = [f"please mail to: u{i}@x.org now" for i in range(12)] + [f"please mail to: one-{i}1 now" for i in range(3)]
    texts += [f"the code is one-{i % 3}1 here" for i in range(12)] + [f"the code is two-{i}2 here" for i in range(3)]
    texts += [f"a ref no two-{i % 3}2 end" for i in range(12)] + [f"a ref no three-{i}3 end" for i in range(3)]
    texts += ["one-01 is first", "then one-01", "a " + "w" * 500 + " one-01", "three-03", "u1@x.org", "other-77 x", "then other-77"]
    found = {texts[r.doc_id]: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), EMPTY)).collect()}
    assert [found[f"a ref no three-{i}3 end"] for i in range(3)] == ["id:9:17"] * 3
    assert [found[t] for t in texts[-7:]] == ["id:0:6", "id:5:11", "id:503:509", "id:0:8", "email:0:8", "", ""]
    long = "f" * 90 + " " + "g" * 700 + " x1yz"
    assert pii._context(long, len(long) - 4) == "\t".join(pii._named(c * n, pii.LONG_WORD) for c, n in (("f", 90), ("g", 700))) and pii._context("b" * 390 + " cd ef12", 394) == pii._named("b" * 390, pii.LONG_WORD) + "\tcd"


def components_of(docs, words, pct=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    above = {i: i for i, _ in sets}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= pct * len(a | b):
                x, y = find(i), find(j)
                above[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup(spark, docs, words):
    want = components_of(docs, words)
    got = {r.doc_id: r for r in near_dedup.group(frame(spark, docs), words=words).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_near_dedup_star(spark):
    """Copies that are linked with their base alone: the forest can't show all links, the families have to."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 80):
        own = list(base)
        for k in rng.choice(299, 18 + i % 16, replace=False):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_dedup.group(spark.createDataFrame(rows, EMPTY), words=2).collect()}
    assert got == {i: c for i, (_, c) in components_of(rows, 2).items()}
    assert near_dedup.group(spark.createDataFrame([], EMPTY)).count() == 0


def test_near_dedup_of_odd_rows(spark):
    words = [f"w{i}" for i in range(300)]
    a, b = " ".join(words[:60]), " ".join(words[100:160])
    rows = [(5, a)] * 40 + [(3, a.upper()), (None, a), (None, None), (None, ""), (9, " \n"), (8, None), (8, None), (2, b), (7, b + " more")]
    docs = spark.createDataFrame(rows, EMPTY).selectExpr("*", "'k' as key", "1 as node", "2 as n", "3 as label", "4 as component_id", "'s' as signature").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.group(docs).collect())
    assert got == Counter({(5, 56, 3, False): 40, (3, 56, 3, True): 1, (None, 56, 3, True): 1, (None, 0, None, True): 2, (9, 0, 9, True): 1, (8, 0, 8, True): 2, (2, 56, 2, True): 1, (7, 57, 2, False): 1})


def test_regions_of_any_size_hold_together():
    """Many near copies of one text, all alike in their order's values: the parts that a large region is taken in stay one component."""
    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    rows = []
    for _ in range(3000):
        own = base.copy()
        own[rng.integers(0, len(own), 8)] = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
        rows.append(near_dedup.signature(np.unique(own)))
    low = (np.array(rows) & np.uint32(15)).astype(np.uint8)
    sketch = [x.tobytes() for x in (low[:, ::2] << 4) | low[:, 1::2]]
    region = near_dedup._Region(0.8)
    region.split(np.ones((3000, near_dedup.DEPTH), np.uint32), np.arange(3000), np.full(3000, 200), sketch)
    first, second = region.pairs()
    above = list(range(3000))

    def find(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for x, y in zip(first.tolist(), second.tolist()):
        above[find(x)] = find(y)
    assert len({find(x) for x in range(3000)}) == 1 and len(first) < 6 * 3000


def test_sketches_lose_no_pair_at_the_threshold():
    """12,000 pairs whose sets share exactly 80 of 100 shingles: none falls below what the sketches let through."""
    rng = np.random.default_rng(8)
    lost = 0
    for _ in range(12_000):
        x = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = near_dedup.signature(x[:90]) & np.uint32(15), near_dedup.signature(x[10:]) & np.uint32(15)
        lost += ((a == b).mean() - 1 / 16) / (15 / 16) < 0.8 - near_dedup.SLACK
    assert lost == 0


def test_repeats(spark, docs):
    rows = [*docs, docs[-1]]
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    want = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if count[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        want[(i, len(b), sum(gone), len(re.findall(b"\1+", gone)), bytes(x for x, g in zip(b, gone) if not g))] += 1
    together = repeats.TOGETHER
    for some in (together, 0):
        repeats.TOGETHER = some
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(frame(spark, rows)).collect())
        assert got == want
    repeats.TOGETHER = together
    both = repeats.remove_repeats(frame(spark, rows), words=50).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in both) == want
    cut = [(i, b, [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]) for i, b in data]
    cut = [(i, b, at, [b[x:y] for x, y in at]) for i, b, at in cut]
    count = Counter(tuple(w[k : k + 50]) for _, _, _, w in cut for k in range(len(w) - 49))
    want = Counter()
    for i, b, at, w in cut:
        gone = bytearray(len(b))
        covered = bytearray(len(w))
        for k in range(len(w) - 49):
            if count[tuple(w[k : k + 50])] > 1:
                covered[k : k + 50] = b"\1" * 50
        for m in re.finditer(b"\1+", covered):
            x, y = at[m.start()][0], at[m.end() - 1][1]
            gone[x:y] = b"\1" * (y - x)
        want[(i, bytes(x for x, g in zip(b, gone) if not g).decode())] += 1
    assert Counter((r.doc_id, r.passages) for r in both) == want and any(t != b.decode() for (_, t), (_, b) in zip(want, data))
    assert Counter((r.doc_id, r.text or "") for r in repeats.remove_passages(frame(spark, rows)).collect()) == want
    for f in (repeats.remove_repeats, repeats.remove_passages):
        assert f(spark.createDataFrame([], EMPTY)).count() == 0


def test_repeats_of_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    passage, own = (" ".join(f"{rng.integers(1 << 30):x}" for _ in range(60)) for _ in range(2))
    rows = [(None, passage)] * 300 + [(3, f"here {passage} there")] * 300 + [(None, own), (5, ""), (6, None), (None, None)]
    docs = spark.createDataFrame(rows, EMPTY).selectExpr("doc_id", "text", "1 as n_bytes", "2 as row", "3 as hit", "4 as found", "'k' as passages", "'z' as text_hash").repartition(5)
    got = Counter((r.doc_id, r.text, r.n_removed, r.passages, r.row, r.hit, r.found, r.text_hash) for r in repeats.remove_repeats(docs, words=50).collect())
    n = len(passage)
    assert got == Counter({(None, passage, n, "", 2, 3, 4, "z"): 300, (3, f"here {passage} there", n + 11, "", 2, 3, 4, "z"): 300, (None, own, 0, own, 2, 3, 4, "z"): 1, (5, "", 0, "", 2, 3, 4, "z"): 1, (6, None, 0, "", 2, 3, 4, "z"): 1, (None, None, 0, "", 2, 3, 4, "z"): 1})
    left = Counter((r.doc_id, r.text, r.n_bytes) for r in repeats.remove_passages(docs).collect())
    assert left == Counter({(None, "", 1): 300, (3, "", 1): 300, (None, own, 1): 1, (5, "", 1): 1, (6, None, 1): 1, (None, None, 1): 1})


def test_redaction_of_rows_and_clashing_columns(spark):
    rows = [(7, "mail ann.lee@mail.example now")] * 50 + [(7, "nothing here"), (None, "call +49 30 1234567 99"), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, EMPTY).selectExpr("doc_id", "text", "'a' as __key", "'b' as __found", "1 as key", "2 as hit", "3 as found", "4 as row").repartition(3)
    got = Counter(tuple(r) for r in pii.redact(docs).collect())
    rest = ("a", "b", 1, 2, 3, 4)
    assert got == Counter({(7, "mail <email> now", *rest): 50, (7, "nothing here", *rest): 1, (None, "call <phone>", *rest): 1, (None, None, *rest): 1, (8, "", *rest): 1})
    assert pii.redact(spark.createDataFrame([], EMPTY)).count() == 0
    assert pii.detect(spark.createDataFrame([], EMPTY)).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[:120] = x[0]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [1.0]), (5, x[5].tolist())]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 50):
        scores = np.round(u @ u[q], 12)
        want = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:5]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s - scores[v]) < 1e-9 for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(want))
        if q < 120:
            assert [v for _, v, _ in mine] == want
    assert hit >= 0.9 * 60 and set(got) == set(range(0, 600, 50))
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


def found_by_ann(spark, vectors, every=1):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").coalesce(2)
    got = defaultdict(list)
    for r in ann.search(rows, F.col("id") % every == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: [v for _, v, _ in sorted(rows)] for q, rows in got.items()}


def recall_of(vectors, got, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = total = 0
    for q, mine in got.items():
        scores = unit @ unit[q]
        scores[q] = -np.inf
        least = np.sort(scores)[-min(k, len(scores) - 1)]
        assert len(mine) == len(set(mine)) == min(k, len(vectors) - 1)
        hits += sum(scores[v] >= least - 1e-12 for v in mine)
        total += len(mine)
    return hits / total


def test_ann_is_complete_and_exact_on_small_tables(spark):
    for n in (2, 3, 6, 9, 51, 200):
        vectors = np.random.default_rng(n).standard_normal((n, 64))
        got = found_by_ann(spark, vectors)
        assert set(got) == set(range(n)) and recall_of(vectors, got) == 1
    # one query, and all others in another direction
    rng = np.random.default_rng(1)
    vectors = np.concatenate([-np.ones((1, 16)), np.ones((8, 16)) + 1e-3 * rng.standard_normal((8, 16))])
    assert recall_of(vectors, found_by_ann(spark, vectors, 100)) == 1


@pytest.mark.parametrize("kind", ["random", "clusters", "threes", "outliers"])
def test_ann_recall(spark, kind):
    rng = np.random.default_rng(3)
    n = 2400
    centres = {"random": n, "clusters": 40, "threes": 800, "outliers": 40}[kind]
    vectors = rng.standard_normal((centres, 32))[np.arange(n) % centres] + 0.2 * rng.standard_normal((n, 32))
    if kind == "outliers":
        vectors[::10] = 3 * rng.standard_normal((n // 10, 32))
    got = found_by_ann(spark, vectors, 30)
    assert len(got) == n // 30 and recall_of(vectors, got) >= 0.9


def test_ann_on_given_embeddings(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    rows = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) == 64 and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids = np.array([i for i, _ in rows])
    unit = np.array([v / np.linalg.norm(v) for _, v in rows])
    hits = total = 0
    found = defaultdict(list)
    for r in ann.search(table.withColumns({"query_id": F.lit(1), "rank": F.lit(2), "score": F.lit("s"), "bucket": F.lit(0)}), F.col("id") % 50 == 0).collect():
        found[r.query_id].append(r.vec_id)
    for q, mine in found.items():
        scores = unit @ unit[np.flatnonzero(ids == q)[0]]
        order = [ids[j] for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != q][:5]
        hits, total = hits + len(set(order) & set(mine)), total + len(mine)
        assert len(mine) == 5
    assert total and hits >= 0.9 * total


def test_toxicity(spark):
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("aeiourstnl"), 5)) for _ in range(3000)]
    bad = ["zqxwort", "pfkjhund", "mmvgraz"]
    rows, marks = [], []
    for i in range(600):
        text = [words[k] for k in rng.integers(0, 3000, 150)]
        if toxic := i % 4 == 0:
            for k in rng.integers(0, 150, 12):
                text[k] = bad[rng.integers(3)]
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    rows += [(900, ""), (901, None), (902, "word " * 20_000)]
    docs, labels = spark.createDataFrame(rows, EMPTY), spark.createDataFrame(marks + [(901, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_table(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    none = toxicity.fit_table(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    # repeated rows change neither the model nor its scores; clashing columns are replaced, others stay; null and empty texts have one score
    again = toxicity.fit_table(docs.unionByName(docs).unionByName(docs.where("doc_id < 5")), labels.unionByName(labels))
    assert again == model
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (None, "x")], EMPTY).selectExpr("*", "'s' as score", "5 as held_out", "6 as kept")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows if not r.text}) == 1 and all(0 <= r.score <= 1 and r.kept == 6 and r.held_out in (True, False) for r in rows)
    empty = spark.createDataFrame([], EMPTY)
    assert toxicity.score(empty, toxicity.fit_table(empty, labels)).count() == 0


def test_queries_have_the_columns_of_their_contracts(spark):
    columns = {
        "op1_url_filters": "page_id host path rule verdict", "op2_token_counts": "doc_id n_bytes n_tokens over_limit", "op3_toxicity": "doc_id held_out score predicted", "op4_ann": "query_id rank vec_id score",
        "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op6_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op7_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op8_near_dedup": "doc_id n_shingles component_id kept", "op9_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op10_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op11_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op12_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op13_collocations": "lang rank phrase a l r n score",
    }
    assert set(columns) == set(queries.QUERIES)
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.shuffle.partitions")
    for name, run in queries.QUERIES.items():
        found = run(spark, SMALL)
        assert set(columns[name].split()) <= set(found.columns), name
        assert found.count(), name
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.shuffle.partitions")) == before


def test_queries_are_registered():
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries()) and set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


def test_shared_folder():
    class Conf:
        def __init__(self, own):
            self.own = own

        def get(self, key, default=None):
            return self.own.get(key, default)

    class Context:
        applicationId = "app-of-this-test"

        def __init__(self, master, own):
            self.master, self.own = master, own

        def getConf(self):
            return Conf(self.own)

    class Session:
        def __init__(self, master, own, runtime=None):
            self.sparkContext, self.conf = Context(master, own), Conf(runtime or {})

    assert common.shared_dir(Session("yarn", {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x" == common.shared_dir(Session("yarn", {}, {"spark.checkpoint.dir": "hdfs:///x"}))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session(master, {}))
    assert common.shared_dir(Session("local[4]", {})) == common.shared_dir(Session("local", {}))
