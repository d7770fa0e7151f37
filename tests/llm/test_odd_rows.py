"""Repeated rows, rows without ids, empty tables and columns of clashing names, for the operators that work row by row."""

import base64
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gradus.llm import ann, byte_bpe, packing, quality, token_count, url_filter

ROWS = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, None), (2, "another text"), (2, ""), (3, "Ünï 日本 \n\n x"), (3, "Ünï 日本 \n\n x")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "old", 5, 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_tokens int, part int").repartition(4)


def test_token_counts(spark, docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_count.count_tokens(docs, path)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "")), False) for i, t in ROWS)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == want
    assert got.where("kept <> 'old' or part <> 7").count() == 0 and token_count.count_tokens(docs.limit(0), path).count() == 0


def test_quality(docs):
    got = quality.score(docs)
    assert Counter((r.doc_id, r.n_words) for r in got.collect()) == Counter((i, len((t or "").split())) for i, t in ROWS)
    assert got.where("kept").count() == 0 == quality.score(docs.limit(0)).count()
    long = docs.select(F.lit(1).cast("long").alias("doc_id"), F.lit(" ".join(f"w{i}" for i in range(50))).alias("text"))
    assert quality.score(long).where("kept and n_words = 50").count() == len(ROWS)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, window=4).collect()
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in ROWS}
    assert sum(r.length for r in pieces) == sum(len(ids[t]) for _, t in ROWS)
    # whole documents, put together in order of the sequences, are those that went in
    flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]).tolist()
    ends = [i for i, x in enumerate(flat) if x == 2]
    assert Counter(tuple(flat[a:b]) for a, b in zip([0, *(e + 1 for e in ends)], [e + 1 for e in ends])) == Counter(tuple(ids[t]) for _, t in ROWS)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces) and Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in ROWS)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_byte_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows) == Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in ROWS)
    assert byte_bpe.encode(docs.limit(0), path, P.PATTERN).count() == 0


def test_url_filter(spark):
    rows = [(1, "https://a.net/x"), (1, "https://a.net/x"), (None, "https://a.net/x"), (None, None), (2, None), (3, "https://b.org/fr/")]
    urls = spark.createDataFrame([(i, u, "k", "old") for i, u in rows], "page_id long, url string, row string, verdict string").repartition(3)
    rules = url_filter.rules_frame(spark)
    got = Counter((r.page_id, r.host, r.rule, r.verdict, r.row) for r in url_filter.filter_urls(urls, rules).collect())
    assert got == Counter({(1, "a.net", "net/", "block", "k"): 2, (None, "a.net", "net/", "block", "k"): 1, (None, "", None, "allow", "k"): 1, (2, "", None, "allow", "k"): 1, (3, "b.org", "org/fr/", "allow", "k"): 1})
    assert url_filter.filter_urls(urls.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(urls, rules.limit(0)).collect()} == {"allow"}


def test_search(spark):
    """Of rows that repeat an id, the smallest vector counts; copies under other ids are all found; other lengths take no part."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.1, 1.0]), (3, [0.1, 1.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [])]
    frame = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, id int").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(frame, F.col("id") == 0, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 1)]
    assert ann.search(frame.limit(0), F.col("id") == 0).count() == 0


def test_missed_words_are_made_once(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    encoder = packing.WordEncoder(P.path("word_bpe_49k.json"))
    made = []
    monkeypatch.setattr(encoder.words, "make", lambda word: made.append(word) or encoder._word(word))
    encoder.words.clear()
    text = "one two one three it's x1y2 one two"
    assert encoder.encode(text) == np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert made == ["one", "two", "three", "it's", "x1y2"]  # a miss doesn't begin the text anew
    encoder.encode("six seven")
    assert set(encoder.words) == {"six", "seven"}
