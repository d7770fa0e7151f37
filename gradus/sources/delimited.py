"""CSV files of any size by several tasks, records that span lines included.

Lines are read in blocks. Whether a line begins inside a quoted field depends on all lines before it, but only through two cases: each line says how it ends if it begins outside quotes and if it
begins inside. Lines that end the same way in either case fix the state, others keep or turn it, so states come from the last line that fixes it and the number of
turns since: running maxima and sums in a block, and over a file's blocks, one row each. Records are then put together from their own lines and parsed."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A field that is not quoted may hold quotes further on; a quote in a quoted field is doubled.
_FIELDS = r'(?:[^",][^,]*+,|"(?:[^"]++|"")*+"[^,]*+,|,)*+'
_OPEN = r'"(?:[^"]++|"")*+$'
_ENDS_INSIDE_FROM_OUTSIDE = f"^{_FIELDS}{_OPEN}"
_ENDS_INSIDE_FROM_INSIDE = f'^(?:[^"]++|"")*+(?:$|"[^,]*+,{_FIELDS}{_OPEN})'


def lines(spark: SparkSession, path) -> DataFrame:
    """(value, file, block, id, last): lines without their line feed; a carriage return before it stays. Ids ascend within a block."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))


def _folded(rows: DataFrame, by: list[str], order: str, ends: tuple[str, str], before: Column) -> DataFrame:
    """``rows`` with ``inside``: the state before each row, if ``before`` is the one before the first of its group. ``ends``: the states after it from outside and from inside."""
    out, inside = (F.col(c) for c in ends)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((out & ~inside).cast("int")).over(upto), F.lit(0))
    rows = rows.withColumn("__turns", turns).withColumn("__after", F.col("__turns") + (out & ~inside).cast("int"))
    fixed = F.max(F.when(out == inside, F.struct(F.col(order).alias("at"), out.alias("state"), F.col("__after").alias("turns")))).over(upto)
    rows = rows.withColumn("__fixed", fixed)
    state, since = F.coalesce(F.col("__fixed.state"), before), F.col("__turns") - F.coalesce(F.col("__fixed.turns"), F.lit(0))
    return rows.withColumn("inside", state != (since % 2 == 1)).drop("__turns", "__after", "__fixed")


def records(spark: SparkSession, path) -> DataFrame:
    """(file, line, text, whole): the text of each record and the number of its first line in its file. Not whole is one that a file's end cuts inside quotes."""
    own = lines(spark, path)
    own = own.withColumns({"from_out": F.col("value").rlike(_ENDS_INSIDE_FROM_OUTSIDE), "from_in": F.col("value").rlike(_ENDS_INSIDE_FROM_INSIDE)})
    # a block as a whole, from either state: its last line that fixes the state, and the turns after it
    last = F.max(F.when(F.col("from_out") == F.col("from_in"), F.struct("id", "from_out")))
    fixed = own.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), last.alias("fixed"))
    after = own.join(fixed.select("file", "block", "fixed"), ["file", "block"]).where("fixed is null or id > fixed.id").groupBy("file", "block").agg(F.count_if(F.col("from_out") & ~F.col("from_in")).alias("turns"))
    blocks = fixed.join(after, ["file", "block"], "left").withColumn("odd", F.coalesce(F.col("turns"), F.lit(0)) % 2 == 1)
    blocks = blocks.withColumns({"block_out": F.coalesce("fixed.from_out", F.lit(False)) != F.col("odd"), "block_in": F.coalesce("fixed.from_out", F.lit(True)) != F.col("odd")})
    blocks = blocks.withColumn("lines_before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n"))
    begun = _folded(blocks, ["file"], "block", ("block_out", "block_in"), F.lit(False)).select("file", "block", "first", "lines_before", F.col("inside").alias("block_inside"))
    placed = _folded(own.join(begun, ["file", "block"]), ["file", "block"], "id", ("from_out", "from_in"), F.col("block_inside"))
    placed = placed.select("file", "value", (F.col("lines_before") + F.col("id") - F.col("first") + 1).alias("line"), "inside", F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")).alias("open"))
    single = placed.where("not inside and not open").select("file", "line", F.col("value").alias("text"), F.lit(True).alias("whole"))
    # only lines of records with several lines go on: a record's number in its file counts those that begin before it
    some = placed.where("inside or open")
    nth = F.sum((~F.col("inside")).cast("int")).over(Window.partitionBy("file").orderBy("line"))
    parts = some.withColumn("nth", nth).groupBy("file", "nth").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts"), F.max_by("open", "line").alias("cut"))
    joined = parts.select("file", "line", F.array_join(F.col("parts.value"), "\n").alias("text"), (~F.col("cut")).alias("whole"))
    return single.unionByName(joined)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _rows(texts: pd.Series) -> pd.Series:
    """Rows of a record's text, by the strict rule; null if it breaks it. Carriage returns outside quotes separate rows, so a text may hold several."""

    def one(text: str | None) -> list[list[str]] | None:
        try:
            return [r for r in csv.reader(io.StringIO(text or "", newline=""), strict=True) if r]
        except csv.Error:
            return None

    return texts.map(one)


def table(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Rows (file, line, nth, fields) in order of line and nth, and issues (code, message, record_id): INVALID_UTF8 and INVALID_CSV, with the line. Blank rows are skipped; a byte order mark
    before the first line goes."""
    found = records(spark, path)
    fine = F.is_valid_utf8("text")
    text = F.when(F.col("line") == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text"))
    parsed = found.withColumn("rows", F.when(fine & F.col("whole"), _rows(F.when(fine, text))))
    at = F.concat(F.lit("line "), F.col("line").cast("string"))
    code = F.when(~fine, "INVALID_UTF8").when(~F.col("whole") | F.col("rows").isNull(), "INVALID_CSV")
    issues = parsed.where(code.isNotNull()).select(code.alias("code"), at.alias("message"), F.lit(None).cast("string").alias("record_id"))
    return parsed.where("rows is not null").select("file", "line", F.posexplode("rows").alias("nth", "fields")), issues
