"""Text functions: tokenizers, normalisers, span arithmetic and truth values, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a token of the ranking and of the overlap tokenizer is.
ASCII_TOKEN = r"[a-z]+|[0-9]+(?:[.,][0-9]+)?"
MIXED_TOKEN = r"[\x{0E00}-\x{0E7F}]+|[a-z]+|\p{Nd}+(?:[.,]\p{Nd}+)?"
OVERLAP_TOKEN = r"[A-Za-z0-9]+|[\p{L}\p{N}]+"
# Characters that count as space at the ends of an id.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
TRUTHY = ("1", "true", "yes")


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def ascii_tokens(text: Column) -> Column:
    """Ranking tokens of ASCII text, where lower case equals folded and normalised text. JVM only."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ASCII_TOKEN), F.lit(0))


def _fold(text: Column) -> Column:
    """NFKC and case folding. For ASCII text and Latin letters with marks that is lower case, and two s for a sharp one, so only other rows leave the JVM."""
    text = F.coalesce(text, F.lit(""))
    other = text.rlike(r"[^\x00-\x7F\xC0-\xD6\xD8-\xF6\xF8-\xFF]")
    return F.when(other, _folded(F.when(other, text))).otherwise(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def _grams(run: Column, n: int) -> Column:
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Ranking tokens of any text: NFKC, case folding, then runs of Thai, Latin letters or digits. A Thai run gives
    its bigrams, then its trigrams, or itself if it is one character. Only normalisation of non-ASCII text leaves the JVM."""
    runs = F.regexp_extract_all(_fold(text), F.lit(MIXED_TOKEN), F.lit(0))
    thai = lambda r: r.rlike(r"^[\x{0E00}-\x{0E7F}]")
    return F.flatten(F.transform(runs, lambda r: F.when(thai(r) & (F.length(r) > 1), F.concat(_grams(r, 2), _grams(r, 3))).otherwise(F.array(r))))


def overlap_tokens(text: Column) -> Column:
    """The set of lower-cased alphanumeric runs; a run of Latin letters and digits ends where another script begins."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(OVERLAP_TOKEN), F.lit(0)), F.lower))


# Bytes of Latin-1: capitals to small letters, what is neither letter, digit nor underscore, and signs that normalisation may change.
_SMALL = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_NO_WORD = bytes(c for c in range(128) if not (chr(c).isalnum() or c == 95))
_SIGNS = bytes([*range(0x80, 0xC0), 0xD7, 0xF7])
_NOT_ASKED = re.compile("[^\\w\u0e00-\u0e7f]+")


def _question(text: str | None) -> str:
    if not text:
        return ""
    try:
        data = text.encode("latin-1")
        plain = text.isascii() or len(data.translate(None, _SIGNS)) == len(data)
    except UnicodeEncodeError:
        plain = False
    if plain:
        return data.replace(b"\xdf", b"ss").translate(_SMALL, _NO_WORD).decode("latin-1")
    return _NOT_ASKED.sub("", unicodedata.normalize("NFKC", text).casefold())


@F.pandas_udf(T.StringType())
def _questions(texts: pd.Series) -> pd.Series:
    return texts.map(_question)


def normalized_question(text: Column) -> Column:
    """Folded text with nothing but word characters and the Thai block; empty for null. Texts of ASCII and Latin letters with marks go through tables of bytes."""
    return _questions(text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def truthy(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin(*TRUTHY)


def span_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    both = span_overlap(a_start, a_end, b_start, b_end)
    either = (a_end - a_start) + (b_end - b_start) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def span_issues(text: Column, start: Column, end: Column, quoted: Column) -> Column:
    """Codes of what is wrong with a span, in a fixed order. Offsets count code points."""
    length = F.length(text)
    checks = [
        (end < start, "END_BEFORE_START"),
        (end > length, "END_OUT_OF_RANGE"),
        ((end >= start) & (end <= length) & (F.substring(text, start + 1, end - start) != quoted), "TEXT_OFFSET_MISMATCH"),
        (start > length, "START_OUT_OF_RANGE"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
