"""A corpus pipeline over ``documents``: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), reads all that the stage before kept, and returns a DataFrame. ``run`` writes each
stage's result below the shared folder and reads it again for the next one; a result goes when the one after it is written. No stage can be expressed in SQL as
a whole. Rows without an id or a text, repeated rows, empty tables and further columns of any name pass as each stage says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import near_dedup, packing, pii, quality, repeats
from gradus.llm.common import discard, free_name, stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return quality.score(rows).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id; of rows equal in id and text, one. Rows without an id stay.

    Where ids repeat, rows are told apart by a hash of id and text."""
    rest = docs.where("doc_id is null")
    named = docs.where("doc_id is not null")
    again = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.take(1):
        key = free_name(docs, "row")
        rows = named.withColumn(key, F.xxhash64("doc_id", "text"))
        groups = near_dedup.group(rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
        first = F.min(F.struct("doc_id", key)).alias("first")
        kept = groups.join(rows.select(key, "doc_id").distinct(), key).groupBy("component_id").agg(first).select(f"first.{key}")
        one = rows.join(kept, key, "left_semi")
        one = one.join(again, "doc_id", "left_anti").unionByName(one.join(again, "doc_id", "left_semi").dropDuplicates([key]))
    else:
        one = named.join(near_dedup.group(docs).where("kept and doc_id is not null").select("doc_id"), "doc_id", "left_semi")
    return one.select(*docs.columns).unionByName(rest)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of fifty whole words or more that are repeated anywhere."""
    return _counted(repeats.remove_passages(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def _counted(rows: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("personal data", personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, f"pipeline-{name.replace(' ', '-')}")
            if before is not None:
                discard(before)
            before = docs
    return docs
