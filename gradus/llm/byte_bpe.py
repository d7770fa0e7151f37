"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens, a block of documents at a time. A block keeps, for each document, the positions
   as numbers of the block's distinct words, and sends each distinct word once to the bucket of its hash.
2. A bucket encodes each distinct word of the corpus once and answers every block that sent it.
3. The answers meet the positions again by block; the ids are put together by position.

What is shuffled are distinct words of blocks, never all pre-tokens, so a word that makes up
any share of the corpus moves once per block. Words and answers travel as compressed lists, one row for
each block and bucket. Decoding looks the ids up in the table of the tokens' bytes, whose size the vocabulary bounds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import partitions, stash

#: Characters of text that make a block, and words that make a row of positions.
BLOCK, CHUNK = 5_000_000, 500_000
#: Words whose ids a bucket's task keeps at most; beyond that a word may be encoded again.
KNOWN = 1_000_000

#: For texts of these characters, the pattern for letters and spaces of any script and this one cut the same way.
_OTHER = re.compile("[^\x00-~¡§«»¿À-ÖØ-öø-ſ–—‘-„…€]")
_L = "A-Za-zÀ-ÖØ-öø-ſ"
_S = " \t-\r"
_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")

_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("check", pa.int64()), ("data", pa.binary())])
_DDL = "block long, kind int, bucket long, n long, check long, data binary"


def ranks_of(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _cutter(pattern: str):
    """Pre-tokens of a text. The short pattern stands for GPT-2's; any other pattern, and texts with other characters, go through ``regex``.

    White space is spelled out, as Unicode has it: the regex module counts U+001C to U+001F too."""
    import regex

    space = r"\t-\r \x85\xa0  -     　"
    full = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
    known = pattern == r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return lambda text: full.findall(text) if not known or _OTHER.search(text) else _WORD.findall(text)


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SCHEMA)], schema=_SCHEMA)


def _documents(some: list) -> bytes:
    """Ids, whether they are null, and numbers of words."""
    ids = np.array([d or 0 for d, _ in some], "<i8").tobytes()
    return ids + bytes(d is None for d, _ in some) + np.array([len(x) for _, x in some], "<u4").tobytes()


def _split(pattern: str, buckets: int, kind: int):
    """kind 0: the blocks' distinct words, by bucket; 1: the documents as positions of these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, n = _cutter(pattern), 0, 0
        seen: dict[str, int] = {}
        docs: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, seen, docs, size
            block = (part << 24) + n
            words = [w.encode() for w in seen]
            to = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(to, kind="stable")
            place = np.empty(len(words), "<u4")
            place[order] = np.arange(len(words), dtype="<u4")
            bounds = np.searchsorted(to[order], np.arange(buckets + 1))
            order = order.tolist()
            sent = [b for b in range(buckets) if bounds[b + 1] > bounds[b]]
            lists, check = [], 0
            for b in sent:
                own = [words[i] for i in order[bounds[b] : bounds[b + 1]]]
                lists.append(_pack(np.array([len(w) for w in own], "<u4").tobytes() + b"".join(own)))
                check = zlib.crc32(b"\xff".join(own), check)
            if kind == 0:
                if sent:
                    yield _row([block] * len(sent), [0] * len(sent), sent, [int(bounds[b + 1] - bounds[b]) for b in sent], [check] * len(sent), lists)
            else:  # words are numbered by how often they occur, which packs better
                every = np.concatenate([x for _, x in docs])
                often = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), "<u4")
                rank[often] = np.arange(len(words), dtype="<u4")
                yield _row([block], [1], [0], [len(words)], [check], [_pack(place[often].tobytes())])
                some, held, k = [], 0, 0
                for doc in docs:
                    some.append(doc)
                    held += len(doc[1])
                    if held >= CHUNK or doc is docs[-1]:
                        at = rank[np.concatenate([x for _, x in some])]
                        yield _row([block], [2], [k], [len(some)], [check], [_pack(_documents(some) + at.view(np.uint8).reshape(-1, 4).T.tobytes())])
                        some, held, k = [], 0, k + 1
            n, seen, docs, size = n + 1, {}, [], 0

        for batch in batches:
            if len(batch):
                part = batch.column(2)[0].as_py()
            for doc, text in ((d.as_py(), t.as_py()) for d, t in zip(batch.column(0), batch.column(1))):
                words = cut(text) if text else []
                try:
                    at = list(map(seen.__getitem__, words))
                except KeyError:
                    at = [seen.setdefault(w, len(seen)) for w in words]
                docs.append((doc, np.array(at, np.int64)))
                size += len(text or "")
                if size >= BLOCK:
                    yield from flush()
        if docs:
            yield from flush()

    return run


def _encode(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = ranks_of(ranks_path)
        single = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for block, bucket, n, check, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                data = _unpack(data)
                ends = np.cumsum(np.frombuffer(data, "<u4", n)).astype(np.int64) + 4 * n
                starts = np.concatenate(([4 * n], ends[:-1])).tolist()
                out = []
                for a, b in zip(starts, ends.tolist()):
                    word = data[a:b]
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        ids = known[word] = np.array(single(word), "<u4").tobytes()
                    out.append(ids)
                yield _row([block], [0], [bucket], [n], [check], [_pack(np.array([len(x) // 4 for x in out], "<u4").tobytes() + b"".join(out))])

    return run


def _gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``flat`` in a row; run i begins at first[i] and has sizes[i] items."""
    n = sizes[at]
    total = int(n.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return flat[np.arange(total) + shift]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    current = check = None
    sizes, ids, ready = [], [], None
    out: list[list] = [[], [], []]
    held = 0

    def rows() -> pa.RecordBatch:
        nonlocal out, held
        got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        out, held = [[], [], []], 0
        return got

    for batch in batches:
        for block, kind, n, sum_, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
            if block != current:
                current, check, sizes, ids, ready = block, sum_, [], [], None
            if sum_ != check:
                raise ValueError("the input gave other rows, or another order, when it was read again; write it as a table first")
            data = _unpack(data)
            if kind == 0:
                data = np.frombuffer(data, "<u4")
                sizes.append(data[:n])
                ids.append(data[n:])
            elif kind == 1:
                size = np.concatenate(sizes or [np.empty(0, "<u4")]).astype(np.int64)
                place = np.frombuffer(data, "<u4")
                ready = (np.concatenate(ids or [np.empty(0, "<u4")]), (np.cumsum(size) - size)[place], size[place])
            else:
                doc, null = np.frombuffer(data, "<i8", n), data[8 * n : 9 * n]
                words = np.frombuffer(data, "<u4", n, 9 * n).astype(np.int64)
                at = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * int(words.sum()), 13 * n).reshape(4, -1).T).view("<u4").ravel()
                end = np.cumsum(words)
                for i, a, b in zip(range(n), (end - words).tolist(), end.tolist()):
                    got = _gather(*ready, at[a:b])
                    for column, value in zip(out, (None if null[i] else int(doc[i]), len(got), got.tobytes())):
                        column.append(value)
                    held += got.nbytes
                    if held > 16 << 20:
                        yield rows()
    yield rows()


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", id_col: str = "doc_id", steady: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian 32-bit integers, one row for each row of ``docs``. Null and empty texts have none.

    Texts are read and cut twice, once for the words and once for the positions, which costs less than keeping both. Rows have to come in the same order each time. ``steady`` says that they do, as
    they do where ``docs`` only reads a table and picks columns or rows; else the input is written first, since a lost executor may change the order after a shuffle. A checksum of each block's words
    stands guard over that. Repeated rows stay repeated, rows without an id keep their nulls, and an empty table gives an empty one."""
    buckets = partitions(docs.sparkSession)
    if not steady:
        docs = stash(docs.select(id_col, text), "bpe-texts")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    words = texts.mapInArrow(_split(pattern, buckets, 0), _DDL).repartition(buckets, "bucket").mapInArrow(_encode(ranks_path), _DDL)
    both = words.unionByName(texts.mapInArrow(_split(pattern, buckets, 1), _DDL)).repartition(buckets, "block").sortWithinPartitions("block", "kind", "bucket")
    return both.mapInArrow(_assemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes of its ids."""

    @F.pandas_udf("binary")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = sorted((i, b) for b, i in ranks_of(ranks_path).items())
        sizes = np.zeros(tokens[-1][0] + 1, np.int64)
        for i, b in tokens:
            sizes[i] = len(b)
        flat, first = np.frombuffer(b"".join(b for _, b in tokens), np.uint8), np.cumsum(sizes) - sizes
        for ids in batches:
            yield pd.Series([_gather(flat, first, sizes, np.frombuffer(x, "<u4")).tobytes() for x in ids])

    return encoded.withColumn("decoded", look_up(F.col("ids")))
