"""Scores by a model that workers load: only if it is the reviewed one, in batches that give way to memory errors, with a record of each call."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Pairs = list[tuple[str, str]]
Model = Callable[[Pairs], list[float]]

#: Calls that have to succeed in a row before a batch grows again.
CALM = 8
FIELDS = "example_id string, support double, input_length long, truncated boolean, call string, call_size int, halved int, milliseconds double"


class GateError(ValueError):
    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field = field


def gate(spark: SparkSession, manifest_path: str, approved: Mapping[str, object], *, revision: str) -> dict:
    """The manifest at ``manifest_path`` (an object of JSON), if it says what was approved: every field of ``approved`` as it is there, objects included, and the revision that is to be loaded.

    Nothing of the model is read before this holds. Its ``files`` (name to SHA-256) are what ``score`` checks on each worker."""
    try:
        rows = spark.read.text(manifest_path, wholetext=True).collect()  # one small file
        found = json.loads(rows[0][0])
    except Exception as e:
        raise GateError("manifest", f"{manifest_path} cannot be read") from e
    if not isinstance(found, dict):
        raise GateError("manifest", "the root has to be an object")
    if revision != approved.get("revision"):
        raise GateError("revision", f"{revision} is not the approved one")
    for field, wanted in approved.items():
        if found.get(field) != wanted:
            raise GateError(field, "is not as approved")
    return found


_loaded: dict[tuple, Model] = {}


def _load(load: Callable[[], Model], files: tuple[tuple[str, str], ...]) -> Model:
    """The model of this worker. Files are hashed right before they are loaded, once for each worker."""
    key = (getattr(load, "__module__", ""), getattr(load, "__qualname__", repr(load)), files)
    if not files or key not in _loaded:
        for path, wanted in files:
            digest = hashlib.sha256()
            with open(path, "rb") as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            if digest.hexdigest() != wanted:
                raise GateError(path, "the file's hash is not the reviewed one")
        if not files:
            return load()
        _loaded[key] = load()
    return _loaded[key]


def _out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or isinstance(error, RuntimeError) and "out of memory" in str(error).casefold()


def score(rows: DataFrame, load: Callable[[], Model], *, batch: int = 16, files: Mapping[str, str] | None = None) -> DataFrame:
    """(example_id, support, input_length, truncated, call, call_size, halved, milliseconds) for ``rows`` of example_id, context, response.

    ``load`` gives the model on a worker: a callable of a list of pairs to as many numbers; an attribute ``last_batch_metadata`` (dicts of input_length and truncated) is read if it is there.
    A batch that runs out of memory is halved and tried again, down to single pairs, where it is an error; after CALM calls batches double again up to ``batch``. Another number of scores than of
    pairs, or a score that is no number, is an error. ``files``: paths that every worker can read, with the hashes that they must have."""
    wanted = tuple(sorted((files or {}).items()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        model, size, calm, call = None, batch, 0, 0
        for pdf in batches:
            if model is None:
                model = _load(load, wanted)
            pairs, out, at, halved = list(zip(pdf["context"], pdf["response"], strict=True)), [], 0, 0
            while at < len(pairs):
                some, began = pairs[at : at + size], time.perf_counter()
                try:
                    found = list(model(some))
                except (MemoryError, RuntimeError) as e:
                    if not _out_of_memory(e):
                        raise
                    if len(some) == 1:
                        raise RuntimeError("the model runs out of memory on a single pair") from e
                    size, calm, halved = max(1, len(some) // 2), 0, halved + 1
                    continue
                if len(found) != len(some):
                    raise ValueError("the model gave another number of scores than it was asked for")
                try:
                    found = [float(x) for x in found]
                except (TypeError, ValueError) as e:
                    raise ValueError("a support score has to be a number") from e
                about = getattr(model, "last_batch_metadata", None)
                about = about if about is not None and len(about) == len(some) else [{}] * len(some)
                name, spent = f"{context.partitionId()}-{context.attemptNumber()}-{call}", 1000 * (time.perf_counter() - began)
                out += [(x, m.get("input_length"), m.get("truncated"), name, len(some), halved, spent) for x, m in zip(found, about, strict=True)]
                at, call, calm, halved = at + len(some), call + 1, calm + 1, 0
                if calm >= CALM and size < batch:
                    size, calm = min(batch, 2 * size), 0
            yield pd.DataFrame(
                {"example_id": pdf["example_id"].astype("object"), "support": pd.Series([o[0] for o in out], dtype="float64"), "input_length": pd.Series([o[1] for o in out], dtype="Int64"), "truncated": pd.Series([o[2] for o in out], dtype="boolean")}
                | {n: pd.Series([o[k] for o in out], dtype=t) for k, (n, t) in enumerate((("call", "object"), ("call_size", "int32"), ("halved", "int32"), ("milliseconds", "float64")), 3)}
            )

    own = rows.select(F.col("example_id").cast("string").alias("example_id"), "context", "response")
    return own.mapInPandas(run, FIELDS).withColumn("example_id", F.col("example_id").cast(rows.schema["example_id"].dataType))
