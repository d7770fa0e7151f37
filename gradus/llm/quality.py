"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes over a text's words find the n-grams that occur twice or more; what
counts is how many characters of the words lie inside such n-grams, and inside lines equal to an earlier one.
Texts are worked on in numpy, a few hundred thousand words at a time; a text itself is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import free_name, small_batches

#: Rejected is a text with a greater share of its words' characters inside n-grams found twice or more (by n), or inside repeated lines.
NGRAM_SHARE = {5: 0.25, 7: 0.22, 10: 0.20}
LINE_SHARE = 0.30
#: Characters that are worked on together.
TOGETHER = 1_000_000

_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 -      　]")
_BASE = np.uint64(0x9E3779B97F4A7C15)

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in NGRAM_SHARE))


def words_of(text: str) -> list[str]:
    """Runs of characters other than the six ASCII white spaces."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(first: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of ``first``: sums of hash times a power of the base, put together from those of half the length."""
    if n == 1:
        return first
    half = _rolling(first, n // 2)
    both = half[: len(half) - n // 2] * np.uint64(pow(int(_BASE), n // 2, 1 << 64)) + half[n // 2 :]
    return both if n % 2 == 0 else both[: len(both) - 1] * _BASE + first[n - 1 :]


def covered(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it lies in an n-gram that its own document holds twice or more."""
    if len(ids) < n:
        return np.zeros(len(ids), bool)
    keys = _rolling(_mix(ids.astype(np.uint64) + np.uint64(1)), n)
    at = np.flatnonzero(doc[: len(keys)] == doc[n - 1 :])
    keys = _mix(keys[at] + doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + n, -1)
    return np.cumsum(step[:-1]) > 0


def _measure(texts: list[str]) -> pd.DataFrame:
    seen: dict[str, int] = {}
    number = seen.setdefault
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    flat = [w for own in words for w in own]
    ids = np.array([number(w, i) for i, w in enumerate(flat)], np.int64)
    size = np.array(list(map(len, flat)), np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    total = lambda mask: np.bincount(doc[mask], size[mask], len(texts)).astype(np.int64)
    five = covered(ids, doc, 5)
    out = {
        "n_words": n_words, "word_chars": np.bincount(doc, size, len(texts)).astype(np.int64), "n_symbols": [sum(map(t.count, _SYMBOLS)) for t in texts],
        "n_dup_lines": [], "n_repeat_words": np.bincount(doc[five], minlength=len(texts)), "dup_line_chars": [],
    }
    for t in texts:
        lines = t.split("\n") if "\n" in t else ()
        earlier: set[str] = set()
        copies = chars = 0
        for line in lines:
            if line in earlier:
                copies += 1
                chars += len(line) - sum(map(line.count, _SPACES))
            elif line.strip(_SPACES):
                earlier.add(line)
        out["n_dup_lines"].append(copies)
        out["dup_line_chars"].append(chars)
    for n in NGRAM_SHARE:
        out[f"dup_chars_{n}"] = total(five if n == 5 else covered(ids, doc, n))
    return pd.DataFrame(out).astype("int64")


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in FIELDS]))
def _measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        texts, parts, some, size = [t or "" for t in texts], [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= TOGETHER:
                parts.append(_measure(some))
                some, size = [], 0
        parts.append(_measure(some))
        yield pd.concat(parts, ignore_index=True)


def score(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the measures of FIELDS, base_failed and kept (clashing columns are replaced).

    ``base_failed``: under 10 words, or over 20 % of the words in repeated 5-grams. ``kept``: not failed, and every
    share of characters within its limit. Null and empty texts have no words and fail. Repeated rows are judged alike, an empty table stays empty."""
    small_batches(docs.sparkSession)
    own = free_name(docs, "measures")
    found = docs.withColumn(own, _measures(F.col(text)))
    found = found.withColumns({n: F.col(f"{own}.{n}") for n in FIELDS}).drop(own)
    found = found.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    fine = F.col("dup_line_chars") <= LINE_SHARE * F.col("word_chars")
    for n, share in NGRAM_SHARE.items():
        fine &= F.col(f"dup_chars_{n}") <= share * F.col("word_chars")
    return found.withColumn("kept", ~F.col("base_failed") & fine)
