"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that go to a Python worker at once. Texts are long, so the usual 10,000 would be tens of megabytes on both sides.
BATCH_ROWS = 500
#: With this seed, XXH64 of a string's bytes is what Spark's xxhash64 gives.
SPARK_SEED = 42


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel in batches of BATCH_ROWS rows, or of fewer where the session says so."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder if the executors are in the driver's own
    process; anywhere else that folder would be another one on each machine, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if spark.sparkContext.applicationId not in _own:
        _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="gradus-shared-")
    return _own[spark.sparkContext.applicationId]


_own: dict[str, str] = {}


_cleaned: set[str] = set()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table below the shared folder and read it back. The folder goes when the driver ends."""
    spark = df.sparkSession
    small_batches(spark)
    root = f"{shared_dir(spark).rstrip('/')}/gradus-{spark.sparkContext.applicationId}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.stash_path = path
    return written


def discard(*stashes: DataFrame) -> None:
    """Delete stashes that nothing reads any more: all that was made of them has been written, so a lost executor needs them no more."""
    for written in stashes:
        _drop(written.sparkSession, written.stash_path)


def _drop(spark: SparkSession, root: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bit_filter(keys: DataFrame, column: str, bits: int, *, hashed: bool = False):
    """A broadcast bit set of fixed size in which each value of a column has its bit: a first sieve, whose hits an exact join has to check.

    However many the keys, ``bits / 8`` bytes are gathered; more keys only let more through. ``hashed``: the column holds hashes already."""
    at = keys.select(F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(bits)).alias("at"))
    words = at.selectExpr("cast(at div 64 as int) as i", "shiftleft(1L, cast(at % 64 as int)) as bit").groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(bits // 64, np.int64)
    mask[words.column("i").to_numpy()] = words.column("bits").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(mask.view(np.uint64))


def bit_mask(keys: DataFrame, column: str, *, hashed: bool = False):
    """``bit_filter`` sized by its keys, and its bits: sixteen for each key, between 2^20 and 2^27 (16 MB) in all. Beyond that more passes, and the exact join has more to drop."""
    bits = _bits(keys, column)
    return bit_filter(keys, column, bits, hashed=hashed), bits


def _bits(keys: DataFrame, column: str) -> int:
    n = keys.select(F.approx_count_distinct(column)).first()[0]
    return 1 << min(27, max(20, (16 * int(n)).bit_length()))


def sieved(df: DataFrame, keys: DataFrame, column: str, name: str = "hit") -> DataFrame:
    """``df`` with the column ``name``: whether a row's ``column`` may be among those of ``keys``.

    A bit set as for ``bit_mask``, but as a table of 64-bit words that is broadcast and joined (two million rows at most), so no row leaves the JVM."""
    bits = _bits(keys, column)
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = keys.select(at(column).alias("at")).selectExpr("at div 64 as __word", "shiftleft(1L, cast(at % 64 as int)) as bit").groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    place = free_name(df, "place")
    joined = df.withColumn(place, at(column)).join(F.broadcast(words), F.expr(f"`{place}` div 64") == F.col("__word"), "left")
    bit = F.expr(f"shiftright(__bits, cast(`{place}` % 64 as int)) & 1L = 1L")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__word", "__bits", place)
