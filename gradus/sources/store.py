"""Commits on the file system that driver and executors share: files that appear whole and only once, and snapshots of a table that a writer may replace only if it has read the last one.

Paths may name any file system that Hadoop knows. A file is written beside its place and renamed; where the local file system would let a rename replace a file, a hard link claims the name."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession



class Conflict(RuntimeError):
    """Another writer was first."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, source: str, target: str, *, replace: bool) -> None:
    """Atomic where the file system's rename is; fails where there is something already, unless a file is to be replaced."""
    fs = _system(spark, target)
    if fs.getScheme() == "file":
        a, b = (fs.resolvePath(_path(spark, source)).toUri().getPath(), fs.makeQualified(_path(spark, target)).toUri().getPath())
        try:
            if replace:
                os.replace(a, b)
            elif os.path.isdir(a):
                os.mkdir(b)  # of two writers, one fails here
                os.rename(a, b)
            else:
                os.link(a, b)
                os.unlink(a)
        except FileExistsError as e:
            raise Conflict(target) from e
        for name in (a, b):  # a checksum beside a file would speak of the old content
            folder, base = os.path.split(name)
            if os.path.exists(sum_of := os.path.join(folder, f".{base}.crc")):
                os.unlink(sum_of)
        return
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    kinds = spark.sparkContext._gateway.new_array(options, 1)
    kinds[0] = options.OVERWRITE if replace else options.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, source), _path(spark, target), kinds)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise Conflict(target) from e
        raise


def write(spark: SparkSession, path: str, data: bytes, *, replace: bool = False) -> None:
    """A file that appears whole; a ``Conflict`` if there is one already, unless it is to be replaced."""
    fs = _system(spark, path)
    temporary = f"{path}.tmp-{uuid.uuid4().hex}"
    try:
        out = fs.create(_path(spark, temporary), False)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        _rename(spark, temporary, path, replace=replace)
    finally:
        fs.delete(_path(spark, temporary), True)


def read(spark: SparkSession, path: str) -> bytes:
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def export(spark: SparkSession, directory: str, files: dict[str, bytes]) -> None:
    """Several files as one folder that appears whole, and only where none is yet."""
    for name in files:
        if not name or "/" in name or name in (".", ".."):
            raise ValueError(f"not a file name: {name}")
    fs = _system(spark, directory)
    if fs.exists(_path(spark, directory)):
        raise Conflict(directory)
    temporary = f"{directory}.tmp-{uuid.uuid4().hex}"
    try:
        fs.mkdirs(_path(spark, temporary))
        for name, data in files.items():
            write(spark, f"{temporary}/{name}", data)
        _rename(spark, temporary, directory, replace=False)
    finally:
        fs.delete(_path(spark, temporary), True)


# ---- snapshots ---------------------------------------------------------------------------------------------------


def revision(spark: SparkSession, path: str) -> int:
    """The number of the last snapshot; 0 if there is none."""
    fs, folder = _system(spark, path), _path(spark, f"{path}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def snapshot(spark: SparkSession, path: str, at: int | None = None) -> DataFrame | None:
    """The rows of a snapshot, by default the last one; None before the first. A snapshot's files never change, so a reader isn't disturbed by later ones."""
    at = revision(spark, path) if at is None else at
    if not at:
        return None
    return spark.read.parquet(f"{path}/{json.loads(read(spark, f'{path}/commits/{at:020d}.json'))['rows']}")


def commit(rows: DataFrame, path: str, read_revision: int) -> int:
    """Write ``rows`` as the snapshot after the one that the writer has read, and return its number. If another writer has moved on meanwhile, it is a ``Conflict`` and nothing of these rows is ever seen.

    Rows are written first, by tasks, where no reader looks; one small file then says that they count."""
    spark = rows.sparkSession
    if revision(spark, path) != read_revision:
        raise Conflict(f"{path}: revision {read_revision} is not the last one")
    name = f"rows/{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    _system(spark, path).mkdirs(_path(spark, f"{path}/commits"))
    try:
        write(spark, f"{path}/commits/{read_revision + 1:020d}.json", json.dumps({"rows": name}).encode())
    except Conflict:
        _system(spark, path).delete(_path(spark, f"{path}/{name}"), True)
        raise
    return read_revision + 1


def upsert(changes: DataFrame, path: str, key: list[str], *, tries: int = 5) -> int:
    """Apply changes to the last snapshot (successes stay as they are) and commit; with another writer's commit in between, once more from there."""
    from gradus.sources import sinks

    spark = changes.sparkSession
    for left in range(tries, 0, -1):
        at = revision(spark, path)
        state = snapshot(spark, path, at)
        try:
            return commit(changes if state is None else sinks.upsert(state, changes, key), path, at)
        except Conflict:
            if left == 1:
                raise
    raise ValueError("tries has to be positive")
