"""Schema-first readers. Each takes a path, or a list of them, that Spark can read (compressed files by extension).

``strict`` readers put the check into the plan, so a bad record fails the query that meets it; otherwise a second frame
of issues (code, message, record_id) comes back and bad records are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus import schemas
from gradus.functions.text import span_issues, stripped, truthy
from gradus.sources import delimited

MAX_INPUT_BYTES = 10 * 1024 * 1024


class InputError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def _issue(code: str, message: Column, record: Column) -> list[Column]:
    return [F.lit(code).alias("code"), message.cast("string").alias("message"), record.cast("string").alias("record_id")]


def numbered(spark: SparkSession, path) -> DataFrame:
    """(value, file, line): lines of text with their numbers from 1 in each file.

    A file is read in blocks by several tasks; lines are counted for each block, so a line's number is its place in the block after the lines of the blocks
    before. No file is gathered in one task."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = blocks.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).select("file", "block", "first", "before")
    return rows.join(before, ["file", "block"]).select("value", "file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"))


def read_jsonl(spark: SparkSession, path, schema: T.StructType, *, key: str | None = None, code: str = "INVALID_JSONL", each_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records and issues: lines that don't parse or lack the key, and every record of a key that occurs again (in one file, with ``each_file``); these are left out of
    the records. Blank lines are skipped. An issue's message begins with its line; lines are numbered only if issues are asked for."""

    def parsed(lines: DataFrame) -> DataFrame:
        kind = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
        rows = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
        return rows.withColumn("__broken", F.col("r.__bad").isNotNull() | (F.coalesce(F.trim(F.col(f"r.{key}")), F.lit("")) == "" if key else F.lit(False)))

    plain = parsed(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))
    fields = [F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields]
    by = ["file", key] if each_file else [key]
    fine = plain.where("not __broken").select("file", *fields)
    good = fine
    lines = parsed(numbered(spark, path))
    at = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "))
    issues = lines.where("__broken").select(*_issue(code, F.concat(at, F.substring("value", 1, 200)), F.col(f"r.{key}") if key else F.lit(None)))
    if key:
        again = fine.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
        good = fine.join(again, by, "left_anti")
        repeats = lines.where("not __broken").select("file", "line", F.col(f"r.{key}").alias(key)).join(again, by, "left_semi")
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("file", "line"))
        repeats = repeats.withColumn("nth", nth).where("nth > 1")
        issues = issues.unionByName(repeats.select(*_issue(f"DUPLICATE_{key.upper()}", F.concat(at, F.lit("occurrence "), F.col("nth").cast("string")), F.col(key))))
    return good.select(*schema.names), issues


def strict(records: DataFrame, issues: DataFrame) -> DataFrame:
    """``records``, with an error raised by the query that reads them if there is any issue."""
    wrong = issues.agg(F.count("*").alias("n"), F.max(F.concat_ws(" ", "code", "record_id", "message")).alias("m"))
    guard = wrong.select(F.when(F.col("n") > 0, F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" issues, such as "), F.col("m")))).otherwise(F.lit(None).cast("void")).isNull().alias("__fine"))
    return records.crossJoin(F.broadcast(guard)).where("__fine").drop("__fine")


def ground_truth(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    records, issues = read_jsonl(spark, path, schemas.GROUND_TRUTH, key="query_id")
    return records.select("query_id", F.col("relevant_document_ids").alias("relevant")), issues


def predictions(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Lists of ids; scores are checked and dropped."""
    records, issues = read_jsonl(spark, path, schemas.PREDICTION, key="query_id")
    bad = (F.size(F.array_distinct("retrieved_document_ids")) != F.size("retrieved_document_ids")) | F.coalesce(F.size("scores") != F.size("retrieved_document_ids"), F.lit(False)) & F.col("scores").isNotNull()
    issues = issues.unionByName(records.where(bad).select(*_issue("INVALID_PREDICTION", F.to_json("retrieved_document_ids"), F.col("query_id"))))
    return records.where(~bad).select("query_id", F.col("retrieved_document_ids").alias("retrieved")), issues


def topics(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """``id<TAB>text``; both have to be there, so a blank line is an issue."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).select("value", F.trim(F.get(parts, F.lit(0))).alias("query_id"), F.trim(F.get(parts, F.lit(1))).alias("text"))
    bad = (F.col("query_id") == "") | F.coalesce(F.col("text") == "", F.lit(True))
    return rows.where(~bad).drop("value"), rows.where(bad).select(*_issue("INVALID_TOPIC", F.col("value"), F.col("query_id")))


def qrels(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """``id Q0 document relevance``, four fields, a relevance of 0 or more, each pair once; pairs that repeat are left out. Blank lines are issues."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select("value", F.size(parts).alias("n"), *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("query_id", "q0", "document_id"))], F.get(parts, F.lit(3)).try_cast("bigint").alias("relevance"))
    good = (F.col("n") == 4) & (F.col("q0") == "Q0") & F.coalesce(F.col("relevance") >= 0, F.lit(False))
    issues = rows.where(~good).select(*_issue("INVALID_QREL", F.col("value"), F.col("query_id")))
    kept = rows.where(good).select("query_id", "document_id", "relevance")
    again = kept.groupBy("query_id", "document_id").agg(F.count("*").alias("n")).where("n > 1")
    return kept.join(again, ["query_id", "document_id"], "left_anti"), issues.unionByName(again.select(*_issue("DUPLICATE_QREL", F.col("document_id"), F.col("query_id"))))


def corpus(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Shards of ``docid, title?, text``; an id may not occur again in its own shard."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("docid", "title", "text")])
    records, issues = read_jsonl(spark, paths, schema, key="docid", each_file=True)
    return records.select(F.col("docid").alias("document_id"), F.coalesce("title", F.lit("")).alias("title"), "text"), issues


def source_context(info: Column) -> Column:
    """A string as it is; the passages of an object; else its JSON with keys sorted."""
    v = F.try_parse_json(info)
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$.passages", "string"), F.to_json(v), info)


def premise(task_type: Column, info: Column, context: Column) -> Column:
    """What a model is given as the premise, by the family of the task."""
    v = F.try_parse_json(info)
    kind = F.lower(task_type)
    return F.when(kind == "qa", F.coalesce(F.try_variant_get(v, "$.passages", "string"), context)).when(kind == "summary", F.coalesce(F.try_variant_get(v, "$", "string"), context)).when(kind == "data2txt", F.coalesce(F.to_json(v), context)).otherwise(context)


def labelled_responses(spark: SparkSession, responses, sources, *, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Responses with their source, normalised spans and span issues; and the dataset's issues.

    Repeated response ids are looked for before the split filter, unknown sources after it. Labels may be a list or a JSON string of one."""
    raw = T.StructType([f if f.name != "labels" else T.StructField("labels", T.StringType()) for f in schemas.RESPONSE.fields])
    rows, issues = read_jsonl(spark, responses, raw, key="id")
    info, more = read_jsonl(spark, sources, schemas.SOURCE, key="source_id")
    issues = issues.unionByName(more)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    issues = issues.unionByName(rows.join(info, "source_id", "left_anti").select(*_issue("UNKNOWN_SOURCE", F.col("source_id"), F.col("id"))))
    # booleans come as such or as 1, true or yes in any case
    loose = T.ArrayType(T.StructType([f if not isinstance(f.dataType, T.BooleanType) else T.StructField(f.name, T.StringType()) for f in schemas.SPAN.fields]))
    spans = F.from_json(F.when(F.trim("labels") == "", "[]").otherwise(F.coalesce("labels", F.lit("[]"))), loose)
    spans = F.transform(F.coalesce(spans, F.array().cast(loose)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["label_type"].alias("label_type"), F.coalesce(truthy(s["due_to_null"]), F.lit(False)).alias("due_to_null"), F.coalesce(truthy(s["implicit_true"]), F.lit(False)).alias("implicit_true"), s["meta"].alias("meta")))
    joined = rows.withColumn("spans", spans).drop("labels").join(info, "source_id").withColumnRenamed("id", "example_id")
    checked = F.transform("spans", lambda s: s.withField("validation_issues", span_issues(F.col("response"), s["start"], s["end"], s["text"])))
    joined = joined.withColumn("spans", checked).withColumn("context", source_context(F.col("source_info")))
    found = joined.select("example_id", F.explode("spans").alias("s")).select("example_id", F.explode("s.validation_issues").alias("i"))
    return joined, issues.unionByName(found.select(F.col("i").alias("code"), F.lit("span").alias("message"), F.col("example_id").alias("record_id")))


def rag_cases(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Cases with the number of their line, and issues that begin with it. ``strict`` fails at any of them."""
    kind = T.StructType([*schemas.RAG_CASE.fields, T.StructField("__bad", T.StringType())])
    rows = numbered(spark, path).where(F.trim("value") != "").withColumn("r", F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("r.__bad").isNotNull()
    issues = rows.where(bad).select(*_issue("INVALID_JSONL", F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), F.substring("value", 1, 200)), F.col("r.id")))
    return rows.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schemas.RAG_CASE.fields], "line"), issues


def catalog(spark: SparkSession, path) -> DataFrame:
    """One id in a line, trimmed, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("document_id")).where("document_id <> ''").distinct()


def artifact(spark: SparkSession, path) -> DataFrame:
    """A JSON document with an object as its root."""
    rows = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return rows.select(F.when(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)), F.col("v")).otherwise(F.raise_error(F.lit("the root has to be an object"))).alias("v"))


def checked_file(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """(path, length, sha256, content): within the size limit, and of the expected hash if one is given."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")
    rows = rows.withColumn("content", F.when(F.col("length") > MAX_INPUT_BYTES, F.raise_error(F.lit("INPUT_TOO_LARGE"))).otherwise(F.col("content")))
    if sha256 is not None:
        rows = rows.withColumn("content", F.when(F.col("sha256") != sha256, F.raise_error(F.lit("CHECKSUM_MISMATCH"))).otherwise(F.col("content")))
    return rows


def registered_input(spark: SparkSession, path: str, kind: str, sha256: str | None = None) -> DataFrame:
    """One row: kind, records, length, sha256 of a file of ground truth or predictions within the size limit. Any issue, or another hash than the one expected, is an error.

    What can be known before any record is read is an InputError at once: UNSUPPORTED_KIND, UNSUPPORTED_FORMAT (not .jsonl), INVALID_REFERENCE_PATH (not absolute, or a network share), NOT_A_FILE,
    UNREADABLE_INPUT, INPUT_TOO_LARGE, EMPTY_INPUT, INVALID_UTF8."""
    if kind not in ("ground_truth", "predictions"):
        raise InputError("UNSUPPORTED_KIND", kind)
    if not path.lower().endswith(".jsonl"):
        raise InputError("UNSUPPORTED_FORMAT", path)
    _check_path(spark, path, MAX_INPUT_BYTES)
    text = spark.read.option("lineSep", "\n").text(path)
    seen = text.agg(F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.count_if(F.trim(F.make_valid_utf8("value")) != "").alias("some")).first()
    if seen.bad:
        raise InputError("INVALID_UTF8", path)
    if not seen.some:
        raise InputError("EMPTY_INPUT", path)
    records, issues = (ground_truth if kind == "ground_truth" else predictions)(spark, path)
    file = checked_file(spark, path, sha256).select("length", "sha256", F.length("content").alias("read"))
    n = strict(records, issues).agg(F.count("*").alias("records"))
    return n.crossJoin(file.where("read = length")).select(F.lit(kind).alias("kind"), "records", "length", "sha256")


def _check_path(spark: SparkSession, path: str, most: int | None = None) -> None:
    """Whether ``path`` is an absolute path of a regular file that can be read, by the file system it names (links are followed)."""
    bare = path.split("://", 1)[1] if "://" in path else path.removeprefix("file:")
    if path.startswith(("\\\\", "//")) or "://" not in path and not bare.startswith("/"):
        raise InputError("INVALID_REFERENCE_PATH", path)
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
        regular, size = status.isFile(), status.getLen()
    except Exception as e:
        raise InputError("UNREADABLE_INPUT", path) from e
    if not regular:
        raise InputError("NOT_A_FILE", path)
    if most is not None and size > most:
        raise InputError("INPUT_TOO_LARGE", path)


def mapped_csv(spark: SparkSession, path: str, kind: str, mapping: dict[str, str], delimiter: str = "|", *, most_bytes: int | None = None) -> DataFrame:
    """``csv_records`` of which any issue fails the query."""
    return strict(*csv_records(spark, path, kind, mapping, delimiter, most_bytes=most_bytes))


def csv_records(spark: SparkSession, path: str, kind: str, mapping: dict[str, str], delimiter: str = "|", *, most_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Ground truth or predictions from two named columns of a CSV file of any size, and issues: INVALID_UTF8, INVALID_CSV (also rows of another length than the header), INVALID_RECORD (no query id, or
    documents that repeat) and DUPLICATE_QUERY_ID; these are left out. The ids of a cell are split, trimmed and blanks dropped.

    An InputError at once are UNSUPPORTED_KIND, INVALID_MAPPING, UNSUPPORTED_FORMAT (not .csv), NOT_A_FILE, UNREADABLE_INPUT, INPUT_TOO_LARGE (with ``most_bytes``), EMPTY_INPUT, DUPLICATE_HEADERS
    and MISSING_COLUMN."""
    if kind not in ("ground_truth", "predictions"):
        raise InputError("UNSUPPORTED_KIND", kind)
    names = {k: v.strip() for k, v in mapping.items()}
    if len(delimiter) != 1 or set(names) != {"query_id", "document_ids"} or len(set(names.values())) != 2 or not all(names.values()):
        raise InputError("INVALID_MAPPING", "a mapping names one column for query_id and another for document_ids, and a delimiter of one character")
    if not path.lower().endswith(".csv"):
        raise InputError("UNSUPPORTED_FORMAT", path)
    _check_path(spark, path, most_bytes)
    rows, issues = delimited.table(spark, path)
    # the header is the first row, after any blank ones: the least line of a file is a partial minimum, not a sort
    first = rows.agg(F.min(F.struct("line", "nth", "fields")).alias("head")).first().head
    if first is None:
        broken = issues.agg(F.min("code").alias("code")).first().code
        raise InputError(broken or "EMPTY_INPUT", path)
    head = [h.strip() for h in first.fields]
    if len(set(head)) != len(head) or not all(head):
        raise InputError("DUPLICATE_HEADERS", ", ".join(head))
    if missing := set(names.values()) - set(head):
        raise InputError("MISSING_COLUMN", ", ".join(sorted(missing)))
    body = rows.where((F.col("line") > first.line) | (F.col("line") == first.line) & (F.col("nth") > first.nth))
    if not body.take(1) and not issues.take(1):
        raise InputError("EMPTY_INPUT", path)
    at = F.concat(F.lit("line "), F.col("line").cast("string"))
    ragged = F.size("fields") != len(head)
    issues = issues.unionByName(body.where(ragged).select(*_issue("INVALID_CSV", at, F.lit(None))))
    cell = lambda k: F.get("fields", F.lit(head.index(names[k])))
    ids = F.filter(F.transform(F.split(cell("document_ids"), "\\Q" + delimiter + "\\E", -1), stripped), lambda x: x != "")
    own = body.where(~ragged).select("line", stripped(cell("query_id")).alias("query_id"), ids.alias("ids"))
    bad = (F.col("query_id") == "") | (F.size(F.array_distinct("ids")) != F.size("ids"))
    issues = issues.unionByName(own.where(bad).select(*_issue("INVALID_RECORD", at, F.col("query_id"))))
    again = own.groupBy("query_id").agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
    issues = issues.unionByName(again.select(*_issue("DUPLICATE_QUERY_ID", at, F.col("query_id"))))
    good = own.where(~bad).join(again, "query_id", "left_anti")
    return good.select("query_id", F.col("ids").alias("relevant" if kind == "ground_truth" else "retrieved")), issues


def model_catalog(spark: SparkSession, responses: DataFrame) -> DataFrame:
    """(model_id, entry): models in a JSON body, be it a list or an object that nests one; the first of a repeated id counts. Secrets are dropped."""
    v = F.try_parse_json("body")
    entries = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.data", "$.models", "$.items", "$.result", "$.result.models", "$.data.models")])
    rows = responses.select(F.posexplode(entries).alias("at", "e"))
    rows = rows.select("at", F.coalesce(F.try_variant_get("e", "$.id", "string"), F.try_variant_get("e", "$.model", "string"), F.try_variant_get("e", "$.name", "string"), F.try_variant_get("e", "$", "string")).alias("model_id"), F.to_json("e").alias("entry"))
    kept = rows.where("model_id is not null").groupBy("model_id").agg(F.min_by("entry", "at").alias("entry"))
    return kept.withColumn("entry", F.regexp_replace("entry", r'"(?:api_key|key|secret|token|authorization)"\s*:\s*"[^"]*",?', ""))
