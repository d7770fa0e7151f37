"""Token counts of whole texts by a sentencepiece BPE model, without shuffling pre-tokens.

A text is cut where no piece of the vocabulary can reach across: before a space that follows another
character, and around newlines (both checked against the vocabulary when a worker starts; a model that fails the check is
applied to whole texts). Counts of the chunks add up to the count of the text. Tier one is a broadcast hash
table of the counts of frequent chunks; tier two a bounded cache in each worker, filled by
encoding what tier one misses. The table is a cache only, so it may come from a bounded sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table, rows and characters of each row that it is made from, and entries of a worker's cache.
FREQUENT, SAMPLE_ROWS, SAMPLE_CHARS, CACHE = 50_000, 2_000, 8_192, 400_000

_CHUNK = re.compile(r"\n| *[^ \n]+| +")


class _Lengths(dict):
    """Counts of chunks: the frequent ones, and those met since; what is missing is encoded."""

    def __init__(self, model: str, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent = frequent
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces) and self._plain()
        self.after_newline = len(self.sp.encode("\n"))

    def _plain(self) -> bool:
        """Spaces are kept one by one, one is put before the text, and characters stay as they are."""
        return self.sp.encode(" a", out_type=str) == ["▁", "▁a"] and self.sp.encode("ﬁ ", out_type=str)[-1] == "▁" and self.sp.encode("") == []

    def __missing__(self, chunk: str) -> int:
        if chunk[0] == " ":
            n = len(self.sp.encode(chunk[1:]))  # the library puts the space back
            if chunk == " ":
                n = 1
        else:
            n = len(self.sp.encode("\n" + chunk)) - self.after_newline
        if chunk == "\n":
            n = self.after_newline - 1
        if len(self) > len(self.frequent) + CACHE:
            self.clear()
            self.update(self.frequent)
        self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.sp.encode(text))
        return sum(map(self.__getitem__, _CHUNK.findall(" " + text.replace("▁", " "))))


_loaded: dict[tuple, _Lengths] = {}


def _lengths(model: str, broadcast) -> _Lengths:
    key = (model, broadcast.value[0])
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = _Lengths(model, dict(zip(broadcast.value[1].split("\x00"), broadcast.value[2])) if broadcast.value[1] else {})
    return _loaded[key]


def frequent_chunks(docs: DataFrame, model: str, *, text: str = "text", id_col: str = "doc_id") -> dict[str, int]:
    """Counts of the most frequent chunks in the first ``SAMPLE_CHARS`` characters of about ``SAMPLE_ROWS`` rows."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    rows = docs.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select(F.left(text, F.lit(SAMPLE_CHARS)).alias("t")).limit(2 * SAMPLE_ROWS).collect()
    seen: Counter = Counter()
    for (t,) in rows:
        seen.update(x for x in _CHUNK.findall(" " + (t or "")) if "\x00" not in x and len(x) < 100)
    lengths = _Lengths(model, {})
    return {x: n for x, _ in seen.most_common(FREQUENT) if (n := lengths[x]) < 256} if lengths.cuts else {}


def count_tokens(docs: DataFrame, model: str, *, text: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (clashing columns are replaced). A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows are counted alike, rows without an id like all others, and an empty table stays empty."""
    frequent = frequent_chunks(docs, model, text=text, id_col=id_col)
    table = docs.sparkSession.sparkContext.broadcast((hash(frozenset(frequent.items())), "\x00".join(frequent), bytes(frequent.values())))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _lengths(model, table)
        for texts in batches:
            yield pd.Series([lengths.count(t) if t else 0 for t in texts], dtype="int64")

    return docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": n_tokens(F.col(text))}).withColumn("over_limit", F.col("n_tokens") > limit)
