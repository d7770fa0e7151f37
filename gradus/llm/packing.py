"""Packing: all documents as one stream of tokens, cut into windows of fixed size.

Pass one encodes each text, closes it with the end id and writes the ids with the place of the document in its
partition. The partitions' token totals (one number per partition) give each partition's global offset by
prefix sums. Pass two cuts the stream at the multiples of the window; a document that crosses
them becomes several pieces. All sequences are full but the last one.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import stash

#: Entries of a worker's two caches, and bytes of ids in a batch that a worker hands back.
WORDS, PARTS, BATCH = 300_000, 150_000, 4 << 20

#: Characters of which white space, lower case and composition are the same everywhere; other texts go to the library whole.
_OTHER = re.compile("[^\t-\r -~¡§«»¿À-ÖØ-öø-įı-ňŊ-ž–—‘-„…€]")
_PART = re.compile("[a-zß-öø-ž]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t-\ra-zß-öø-ž0-9]+")


class _Cache(dict):
    """Makes what it misses; begins anew when it is full."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = found
        return found


class WordEncoder:
    """Ids of a text by a word-level BPE file of the tokenizers library, as little-endian 32-bit integers.

    White space is dropped and nothing merges across it, so a text's ids are those of its words in a row.
    Words come from a cache. What it misses is cut as the file's pre-tokenizer does and merged by a byte-pair
    coder that has the file's vocabulary as ranks, the word end being byte 0xFF, which UTF-8 never has.
    The short way is taken only if the file has the expected steps and it agrees with the library on a probe."""

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
        self.words, self.parts = _Cache(self._word, WORDS), _Cache(self._part, PARTS)
        self.coder = self._coder(spec)
        probe = "Straße d'été, it's 2024 naïve-co. I'LL (foo)... Œuvre 'tis «¡ÀÈÎ!» ça x1y2 #42"
        if self.coder is not None and np.frombuffer(self.encode(probe), "<u4").tolist() != self.library.encode(probe, add_special_tokens=False).ids:
            self.coder = None

    @staticmethod
    def _coder(spec: dict):
        import tiktoken

        model, steps = spec["model"], [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or steps != ["NFC", "Replace", "Lowercase"]:
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {}
        for piece, i in model["vocab"].items():
            end = piece.endswith("</w>") and piece != "</w>"
            chars = piece[:-4] if end else piece
            if chars and all(c in byte for c in chars) and not piece.startswith("<|"):
                ranks[bytes(byte[c] for c in chars) + b"\xff" * end] = i
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _part(self, part: str) -> bytes:
        ids = self.coder.encode_single_piece(part.encode() + b"\xff")
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        parts = _PART.findall(word)
        return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self.parts.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        if self.coder is None or _OTHER.search(text) or self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", id_col: str = "doc_id", end_id: int = 2) -> DataFrame:
    """(doc_id, part, before, doc_tokens, ids): the ids of each row, closed by ``end_id``, and how many ids its partition has before it.

    A null or empty text has the end id alone. Repeated rows are encoded as often as they occur."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(path).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, size = ([], [], [], []), 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (encode(t) if t else b"") + end
                for column, value in zip(rows, (i, before, len(ids) // 4, ids)):
                    column.append(value)
                before += len(ids) // 4
                size += len(ids)
                if size >= BATCH:
                    yield _batch(rows, part, schema)
                    rows, size = ([], [], [], []), 0
            yield _batch(rows, part, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, part long, before long, doc_tokens long, ids binary")


def _batch(rows: tuple, part: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array([part] * len(rows[0]), pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary())], schema=schema)


def pack(docs: DataFrame, path: str, *, text: str = "text", id_col: str = "doc_id", end_id: int = 2, window: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    The end of a document is an id too, so every row, also one of a null or empty text, has at least one piece. Repeated rows are packed as often as they occur, rows without an id keep their null.
    No rows: no pieces."""
    encoded = stash(encode_documents(docs, path, text=text, id_col=id_col, end_id=end_id), "packing")
    totals = sorted(encoded.groupBy("part").agg(F.sum("doc_tokens")).collect())
    base = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))
    spark = docs.sparkSession
    bases = spark.sparkContext.broadcast(base)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bases.value
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, part, before, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                first = at[part] + before
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc, start, length, piece, zlib.crc32(piece), n, sequence, offset)):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return encoded.select("doc_id", "part", "before", "doc_tokens", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
