"""Toxicity by compression distance.

In one point this departs from training a dictionary on toxic text: that dictionary is trained on what toxic texts have beyond ordinary ones, since on
whole toxic texts it learns ordinary language too and the difference drowns in noise (README has the figures).

Two zstandard dictionaries are trained on labelled text: one on ordinary texts, one on what toxic texts have beyond them (the
words that are much more frequent in toxic than in ordinary training texts, in their order). A text is cut into windows that overlap by half;
each is compressed with the ordinary dictionary alone and with the toxic one put before it. The toxic dictionary shortens only
windows with toxic content, so the difference in bytes is the window's evidence. Its likelihood ratios are calibrated on training
texts that the dictionaries haven't seen, and a logistic curve over a text's evidence gives the score.

The model is fitted on a bounded sample of labelled rows (MOST_TOXIC and MOST_ORDINARY, the smallest hashes of the ids) and is a few
kilobytes; all texts are scored whole, each in one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOXIC, MOST_ORDINARY = 2000, 6500
#: Bytes of a window and from one to the next, of the ordinary dictionary, and the level of compression.
WINDOW, STEP, ORDINARY_BYTES, LEVEL = 256, 128, 8192, 10
#: Sizes of the toxic dictionary and of its segments that are tried, on so many training texts of each kind.
TOXIC_BYTES, SEGMENTS, TRIAL = (768, 1024, 1536), (8, 10, 12, 16), 400
LOW, HIGH = -8, 15

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    ratios: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.constant is None:
            raw = zstandard.DICT_TYPE_RAWCONTENT
            dictionaries = [zstandard.ZstdCompressionDict(x, dict_type=raw) for x in (model.ordinary, model.toxic + model.ordinary)]
            for x in dictionaries:
                x.precompute_compress(level=LEVEL)
            self.short, self.long = (zstandard.ZstdCompressor(level=LEVEL, dict_data=x, write_content_size=False, write_checksum=False, write_dict_id=False).compress for x in dictionaries)

    def evidence(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves, for each window."""
        data = text.lower().encode()
        windows = [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW // 3), STEP)]
        return np.clip([len(self.short(w)) - len(self.long(w)) for w in windows], LOW, HIGH)

    def features(self, evidence: np.ndarray) -> list[float]:
        ratio = np.array(self.model.ratios)[evidence - LOW]
        n, total = len(ratio), float(np.clip(ratio.sum(), -10, 10))
        return [total, ratio.mean(), ratio.max(), math.log(n + 1), np.maximum(ratio, 0).sum() / math.sqrt(n), total * math.log(n + 1)]

    def score(self, text: str) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        z = (np.array(self.features(self.evidence(text))) - m.mean) / m.spread
        return float(1 / (1 + math.exp(-float(np.clip(z @ np.array(m.weights[:-1]) + m.weights[-1], -30, 30)))))


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: all of it, as far as it fits
        return b" ".join(samples)[-size:]


def fit(texts: list[str], toxic: list[bool]) -> Model:
    """A model of labelled texts. Without both kinds of text, a constant score."""
    kinds = [list(dict.fromkeys(t for t, y in zip(texts, toxic) if y is kind)) for kind in (True, False)]
    if min(map(len, kinds)) < 4:
        return Model(b"", b"", constant=0.0 if len(kinds[0]) <= len(kinds[1]) else 1.0)
    cut = [len(kinds[0]) * 6 // 10, len(kinds[1]) * 7 // 10]
    seen = [Counter(w for t in kind[:n] for w in set(_WORD.findall(t.lower()))) for kind, n in zip(kinds, cut)]
    least = max(2, cut[0] // 100)
    marked = {w for w, n in seen[0].items() if n >= least and n / cut[0] >= 8 * (seen[1][w] + 0.5) / cut[1]}
    # in the order of the ids' hashes: the trainer picks from one stretch of samples after another, so each should be a mixture
    beyond = dict.fromkeys(" ".join(["", *(w for w in _WORD.findall(t.lower()) if w in marked), ""]).encode() for t in kinds[0][: cut[0]])
    ordinary = [t.lower().encode() for t in kinds[1][: min(cut[1], 1500)]]
    samples, plain = [x for x in beyond if len(x) > 8], _dictionary(ordinary, ORDINARY_BYTES, 32, 8)
    unseen = [kind[n:] for kind, n in zip(kinds, cut)]
    some = [kind[:TRIAL] for kind in unseen]
    tried = [Model(_dictionary(samples, size, k, 6), plain) for size in TOXIC_BYTES for k in SEGMENTS]
    best = max(tried, key=lambda m: _calibrated(m, some)[1])
    return _calibrated(best, unseen)[0]


def _calibrated(model: Model, kinds: list[list[str]]) -> tuple[Model, float]:
    """The model with ratios and weights fitted on toxic and ordinary texts, and the chance that it ranks a pair of them rightly."""
    scorer = _Scorer(model)
    found = [[scorer.evidence(t) for t in kind] for kind in kinds]
    shares = []
    for kind in found:
        h = np.full(HIGH - LOW + 1, 0.5)
        for e in kind:
            value, n = np.unique(e - LOW, return_counts=True)
            h[value] += n / math.sqrt(len(e))
        shares.append(h / h.sum())
    model = replace(model, ratios=tuple(np.log(shares[0] / shares[1])))
    scorer = _Scorer(model)
    x = np.array([scorer.features(e) for kind in found for e in kind])
    y = np.repeat([1.0, 0.0], [len(kind) for kind in found])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - mean) / spread, np.ones(len(x))]
    weights = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(weights)), x.T @ (p - y) + 0.1 * weights)
    z = x @ weights
    right = float((np.searchsorted(np.sort(z[y == 0]), z[y == 1])).mean() / max(1, (y == 0).sum()))
    return replace(model, mean=tuple(mean), spread=tuple(spread), weights=tuple(weights)), right


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_table(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Model:
    """Fit on at most MOST_TOXIC toxic and MOST_ORDINARY other ids among those that are not held out, those of the smallest hashes (ties by id). Rows without an id or a text,
    and labels other than 0 and 1, take no part; an id with both labels is toxic. Empty tables, or too few texts of a kind, give a constant score."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label).alias("y"))
    hashed = known.withColumn("h", F.xxhash64(id_col))
    some = hashed.where("y = 1").orderBy("h", id_col).limit(MOST_TOXIC).unionByName(hashed.where("y = 0").orderBy("h", id_col).limit(MOST_ORDINARY))
    # of rows that repeat an id, the text of the smallest hash counts, so as many texts reach the driver as ids were picked
    rows = docs.select(id_col, F.col(text).alias("t")).join(F.broadcast(some), id_col).where("t is not null").groupBy("h", id_col, "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("h", "t", "y").toPandas().sort_values(["h", "t"])
    return fit(rows["t"].tolist(), [bool(y) for y in rows["y"]])


_scorers: dict[Model, _Scorer] = {}


def score(docs: DataFrame, model: Model, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with held_out, score and predicted (clashing columns are replaced). A null text scores as an empty one, repeated rows score alike, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if shared.value not in _scorers:
            _scorers.clear()
            _scorers[shared.value] = _Scorer(shared.value)
        scorer = _scorers[shared.value]
        for texts in batches:
            yield pd.Series([scorer.score(t or "") for t in texts], dtype="float64")

    return docs.withColumns({"held_out": held_out(F.col(id_col)), "score": run(F.col(text))}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
