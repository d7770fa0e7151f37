"""Sinks: canonical JSON, run lines, immutable runs, upserts of state, public artifacts."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.sources import store


def canonical_json(value, path: str | None = None, *, exclusive: bool = False, spark: SparkSession | None = None) -> str:
    """Sorted keys, two spaces, text as it is, a newline at the end. Given a path, the file appears whole or not at all; ``exclusive``: only where none is yet. With a session the
    path may be on any file system that Spark can write, else it is the driver's own."""
    text = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n"
    if path is not None and spark is not None:
        store.write(spark, path, text.encode(), replace=not exclusive)
    elif path is not None:
        temporary = f"{path}.tmp-{uuid.uuid4().hex}"
        try:
            with open(temporary, "x", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            if exclusive:
                os.link(temporary, path)  # fails if the path exists
            else:
                os.replace(temporary, path)
        finally:
            if os.path.exists(temporary):
                os.unlink(temporary)
    return text


def preparation_manifest(spark: SparkSession, summary: dict, files: list[str], path: str | None = None) -> dict:
    """What was prepared: a summary's figures, and length and sha256 of each file, as canonical JSON. Files are hashed where they are read; one of an earlier manifest
    at ``path`` whose hash has changed is an error."""
    rows = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256")).orderBy("name").collect()
    manifest = summary | {"checksums": {r.name: r.sha256 for r in rows}, "bytes": {r.name: r.length for r in rows}}
    if path is not None:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                before = json.load(f).get("checksums", {})
            if moved := sorted(n for n, h in before.items() if manifest["checksums"].get(n, h) != h):
                raise ValueError(f"changed since the last preparation: {', '.join(moved)}")
        canonical_json(manifest, path)
    return manifest


def export_bundle(directory: str, files: dict[str, object], *, spark: SparkSession | None = None) -> None:
    """Several JSON documents as one folder that appears whole, and only where none is yet. With a session the folder may be on any file system that Spark can write."""
    if spark is not None:
        store.export(spark, directory, {name: canonical_json(value).encode() for name, value in files.items()})
        return
    if os.path.lexists(directory):
        raise FileExistsError(directory)
    temporary = f"{directory}.tmp-{uuid.uuid4().hex}"
    os.mkdir(temporary)
    try:
        for name, value in files.items():
            if "/" in name or name in (".", ".."):
                raise ValueError(f"not a file name: {name}")
            canonical_json(value, os.path.join(temporary, name))
        os.mkdir(directory)  # the claim: of two exports, one fails here
        os.rename(temporary, directory)
    finally:
        shutil.rmtree(temporary, ignore_errors=True)


def one_row(report: DataFrame) -> dict:
    """A report of one row as a dict for ``canonical_json``."""
    return report.first().asDict(recursive=True)


def write_trec(lines: DataFrame, path: str) -> None:
    """Lines of ranking.trec_lines in order of query and rank; written by as many tasks as the order has ranges."""
    lines.orderBy("query_id", "rank").select("line").write.text(path)


def write_immutable(rows: DataFrame, path: str, run_id: str) -> str:
    """A run's evidence below ``path/run_id=…``. A second write of one run fails. Returns the fingerprint of the rows."""
    from gradus.operators.population import fingerprint

    if not run_id or any(c in run_id for c in "/\\.:= \t\n"):
        raise ValueError("a run id is a safe name")
    rows.write.mode("errorifexists").parquet(f"{path}/run_id={run_id}")
    return fingerprint(rows.sparkSession.read.parquet(f"{path}/run_id={run_id}"), sorted(rows.columns)).first()["fingerprint"]


def verified(spark: SparkSession, path: str, run_id: str, expected: str) -> DataFrame:
    from gradus.operators.population import fingerprint

    rows = spark.read.parquet(f"{path}/run_id={run_id}")
    if fingerprint(rows, sorted(rows.columns)).first()["fingerprint"] != expected:
        raise ValueError(f"{run_id}: the rows are not those that were written")
    return rows


def write_comparison(comparison: DataFrame, failures: DataFrame, path: str, comparison_id: str) -> dict[str, str]:
    """A comparison and, beside it, its failures: both immutable. Returns the fingerprints that ``read_comparison`` asks for."""
    marks = {"failures": write_immutable(failures, f"{path}/failures", comparison_id)}
    return marks | {"comparison": write_immutable(comparison, f"{path}/comparisons", comparison_id)}


def read_comparison(spark: SparkSession, path: str, comparison_id: str, expected: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    return verified(spark, f"{path}/comparisons", comparison_id, expected["comparison"]), verified(spark, f"{path}/failures", comparison_id, expected["failures"])


def provenance_violations(evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(run_id, field) where a run's evidence and its frozen snapshot disagree. Both: run_id, workspace_id, config_sha256, truth_sha256, predictions_sha256."""
    fields = ("workspace_id", "config_sha256", "truth_sha256", "predictions_sha256")
    rows = evidence.select("run_id", F.struct(*fields).alias("a")).join(snapshots.select("run_id", F.struct(*fields).alias("b")), "run_id", "left")
    found = F.array(F.when(F.col("b").isNull(), "run_id"), *[F.when(F.col("b").isNotNull() & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields])
    return rows.select("run_id", F.explode(F.array_compact(found)).alias("field"))


def upsert(state: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """State with changes applied: successes stay as they are, for other keys the change counts."""
    done = state.where("status = 'SUCCESS'").select(*key)
    new = changes.join(done, key, "left_anti")
    return state.join(new.select(*key), key, "left_anti").unionByName(new)


def rounded(value: Column, kind: T.DataType, places: int = 12) -> Column:
    """A value of any type with every floating number in it rounded."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.round(value, places)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rounded(x, kind.elementType, places))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rounded(x, kind.valueType, places))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[rounded(value[f.name], f.dataType, places).alias(f.name) for f in kind.fields]))
    return value


def public_artifact(rows: DataFrame) -> DataFrame:
    """(artifact_id, json): one JSON text per artifact, keys sorted, nulls left out, floats to 12 places at any depth."""
    rows = rows.select(*[rounded(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])
    return rows.select("artifact_id", F.to_json(F.struct(*sorted(rows.columns))).alias("json"))


def write_bundle(parts: dict[str, DataFrame], directory: str, *, most: int = 10_000) -> list[str]:
    """The parts of ``benchmarks.evidence_bundle`` as one folder that appears whole: a file for each artifact, by its id, and index.json. Returns the files' names.

    A bundle is for people and small: with over ``most`` artifacts, or an id that is no safe name, nothing is written."""
    from gradus.operators.evidence import safe_identifier

    spark = parts["index"].sparkSession
    made = public_artifact(parts["runs"]).unionByName(public_artifact(parts["comparison"])).withColumn("safe", safe_identifier(F.col("artifact_id")))
    rows = made.limit(most + 1).collect()
    if len(rows) > most or not all(r.safe for r in rows) or len({r.artifact_id for r in rows}) < len(rows):
        raise ValueError("a bundle needs few artifacts, each with a safe name of its own")
    listed = [json.loads(r[0]) for r in parts["index"].orderBy("artifact_id").select(F.to_json(F.struct("*"))).collect()]
    files = {f"{r.artifact_id}.json": json.loads(r.json) for r in rows} | {"index.json": {"artifact_type": "index", "schema_version": "public-evidence-v1", "artifacts": listed}}
    store.export(spark, directory, {name: canonical_json(value).encode() for name, value in files.items()})
    return sorted(files)


def load_public_artifacts(spark: SparkSession, path) -> DataFrame:
    """(artifact_id, artifact_type, v): one JSON object in a line, read as VARIANT; an unknown schema version or type, or no id, is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    fine = (text("schema_version") == "public-evidence-v1") & text("artifact_type").isin("run", "comparison", "index") & (F.length(text("artifact_id")) > 0)
    kind = F.when(F.coalesce(fine, F.lit(False)), text("artifact_type")).otherwise(F.raise_error(F.lit("not a public artifact")).cast("string"))
    return rows.select(text("artifact_id").alias("artifact_id"), kind.alias("artifact_type"), "v")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
