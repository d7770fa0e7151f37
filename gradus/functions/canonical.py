"""Canonical JSON: keys sorted, no spaces, letters of any script as they are, numbers in their shortest form; and its SHA-256."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _reread(text: str | None) -> str | None:
    try:
        return None if text is None else canonical(json.loads(text))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON texts in canonical form; null for null and for what is no JSON. Of a repeated key the last one counts."""
    return texts.map(_reread).astype(object)


@F.pandas_udf(T.StringType())
def canonical_digest(texts: pd.Series) -> pd.Series:
    """SHA-256, in hexadecimal digits, of the canonical form."""
    return texts.map(_reread).map(lambda t: None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()).astype(object)
