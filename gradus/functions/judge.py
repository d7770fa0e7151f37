"""Prompts and outputs of judge models, as Column expressions, and model calls through an injected callable."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import scoring

# Labels and fields of a decision, and lengths of its texts and of error texts.
LABELS = ("GROUNDED", "HALLUCINATED")
FIELDS = ("label", "confidence", "unsupported_claims", "reason")
MAX_TEXT, MAX_ERROR = 300, 240
_DDL = "struct<label:string,confidence:double,unsupported_claims:array<string>,reason:string>"


def escape(text: Column) -> Column:
    """The three characters that could open or close a section; quotes stay."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def prompt(template: str, context: Column, response: Column) -> Column:
    """``template`` with {context} and {response} filled by escaped texts."""
    before, rest = template.split("{context}")
    middle, after = rest.split("{response}")
    return F.concat(F.lit(before), escape(context), F.lit(middle), escape(response), F.lit(after))


def prompt_sha256(template: str) -> str:
    """What a trace keeps of a prompt: the hash of its template, not of the texts."""
    return hashlib.sha256(template.encode()).hexdigest()


def schema_sha256(schema: dict) -> str:
    """Hash of a JSON schema with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(schema, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def output_category(output: Column) -> Column:
    """What is wrong with an answer, the first of a fixed order of checks, or VALID_STRUCTURED_OUTPUT. Nothing is repaired.

    A number in quotes is a confidence, and true is 1. Fields that a decision doesn't have, texts that are too long and a confidence that is no number are
    general schema errors."""
    text = F.regexp_replace(F.coalesce(output, F.lit("")), r"^\s+|\s+$", "")
    v = F.try_parse_json(text)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    field = lambda name, t: F.try_variant_get(v, f"$.{name}", t)
    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    label, confidence, claims, reason = field("label", "string"), field("confidence", "double"), field("unsupported_claims", "array<string>"), field("reason", "string")
    missing = F.size(F.array_except(F.array(*map(F.lit, FIELDS)), names)) > 0
    strange = F.size(F.array_except(names, F.array(*map(F.lit, FIELDS)))) > 0
    kinds = F.transform(field("unsupported_claims", "array<variant>"), F.schema_of_variant)
    types = (~kind("$.reason").startswith("STRING")) | ~kind("$.unsupported_claims").startswith("ARRAY") | F.exists(kinds, lambda k: k != "STRING")
    enum = ~F.coalesce((kind("$.label") == "STRING") & label.isin(*LABELS), F.lit(False))
    long = (F.length(reason) > MAX_TEXT) | F.exists(claims, lambda c: F.length(c) > MAX_TEXT)
    false = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(text == "", "EMPTY_CONTENT").when(v.isNull() & text.startswith("```"), "JSON_CODE_FENCE").when(v.isNull() & ~text.rlike(r"[}\]]$"), "TRUNCATED_JSON").when(v.isNull(), "INVALID_JSON")
        .when(~kind("$").startswith("OBJECT"), "PARSE_ERROR_ROOT_NOT_OBJECT").when(missing, "SCHEMA_MISSING_FIELD").when(enum, "INVALID_LABEL_ENUM").when(false(~confidence.between(0.0, 1.0)), "CONFIDENCE_OUT_OF_RANGE")
        .when(false(types), "UNSUPPORTED_CLAIMS_TYPE_ERROR").when(strange | false(long) | confidence.isNull(), "SCHEMA_VALIDATION_ERROR")
        .when((label == "GROUNDED") & (F.size(claims) > 0) | (label == "HALLUCINATED") & (F.size(claims) == 0), "LABEL_CLAIM_CONSISTENCY_FAILURE").otherwise("VALID_STRUCTURED_OUTPUT")
    )


def parse_status(category: Column) -> Column:
    unread = ("EMPTY_CONTENT", "JSON_CODE_FENCE", "TRUNCATED_JSON", "INVALID_JSON", "PARSE_ERROR_ROOT_NOT_OBJECT")
    return F.when(category == "VALID_STRUCTURED_OUTPUT", "OK").when(category.isin(*unread), "PARSE_ERROR").otherwise("SCHEMA_VALIDATION_ERROR")


def decision(output: Column) -> Column:
    return F.when(output_category(output) == "VALID_STRUCTURED_OUTPUT", F.from_json(output, _DDL))


def content_text(body: Column) -> Column:
    """The text of a completion: a string, or the text parts of a list joined; empty if there is neither."""
    v = F.try_parse_json(body)
    at = "$.choices[0].message.content"
    whole = F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING", F.try_variant_get(v, at, "string"))
    parts = F.try_variant_get(v, at, "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.when(F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string"))), "")
    return F.coalesce(whole, joined, F.lit(""))


def completion(body: Column, expected_text: str, schema: dict[str, str] | None = None) -> Column:
    """How a completion fared, as a struct that keeps neither its text nor its reasoning.

    completion_status: PASS with content or tool calls, else INVALID_RESPONSE. instruction_adherence_status: PASS if the trimmed content is the expected text, FAIL without
    content, else PARTIAL. structured_output_status: NOT_RUN without a schema (fields and their values); else PASS or PARSE_FAILED."""
    v = F.try_parse_json(body)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    message = "$.choices[0].message"
    there = kind(message).startswith("OBJECT")
    content = F.when(there, content_text(body)).otherwise("")
    bare = F.regexp_replace(content, r"^\s+|\s+$", "")
    tools = there & kind(f"{message}.tool_calls").startswith("ARRAY") & (F.size(F.try_variant_get(v, f"{message}.tool_calls", "array<variant>")) > 0)
    thought = F.coalesce(F.try_variant_get(v, f"{message}.reasoning", "variant"), F.try_variant_get(v, f"{message}.reasoning_content", "variant"))
    thought = F.when(there & (F.schema_of_variant(thought) != "VOID"), F.coalesce(F.try_variant_get(thought, "$", "string"), F.to_json(thought)))
    answer = F.try_parse_json(content)
    fits = F.lit(True)
    for name, value in (schema or {}).items():
        fits &= F.coalesce(F.try_variant_get(answer, f"$.{name}", "string") == value, F.lit(False))
    structured = F.lit("NOT_RUN") if schema is None else F.when(there & F.coalesce(F.schema_of_variant(answer).startswith("OBJECT"), F.lit(False)) & fits, "PASS").when(there, "PARSE_FAILED").otherwise("NOT_RUN")
    return F.struct(
        text("$.object").alias("response_object_type"), text("$.model").alias("returned_model"), F.when(there, text("$.choices[0].finish_reason")).alias("finish_reason"),
        F.when(there & ((bare != "") | tools), "PASS").otherwise("INVALID_RESPONSE").alias("completion_status"), structured.alias("structured_output_status"),
        F.when(bare == "", "FAIL").when(bare == expected_text, "PASS").otherwise("PARTIAL").alias("instruction_adherence_status"), (bare != "").alias("assistant_content_present"),
        F.length(content).alias("assistant_content_length"), thought.isNotNull().alias("reasoning_present"), F.coalesce(F.length(thought), F.lit(0)).alias("reasoning_length"), tools.alias("tool_calls_present"),
        kind("$.usage").startswith("OBJECT").alias("usage_metadata_present"),
    )


def redacted(message: Column) -> Column:
    """An error text of at most 240 characters, spaces folded: nothing of it if it speaks of credentials, else without the values of keys and tokens."""
    text = F.regexp_replace(F.regexp_replace(message, r"\s+", " "), "^ | $", "")
    hidden = F.lower(text).rlike("credential|authorization|bearer|secret")
    masked = F.regexp_replace(text, r"(?i)(api[-_ ]?key|token)\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]")
    return F.when(text == "", F.lit(None)).when(hidden, "[REDACTED_ERROR_MESSAGE]").otherwise(F.left(masked, F.lit(MAX_ERROR)))


def usage_projection(usage: Column) -> Column:
    """The entries of a map whose names speak of tokens or costs; null if there is none."""
    kept = F.map_filter(usage, lambda k, _: F.lower(k).contains("token") | F.lower(k).contains("cost"))
    return F.when(F.size(kept) > 0, kept)


# What a record keeps of a provider's quota.
QUOTA = ("daily_quota_tokens", "daily_usage_tokens", "daily_remaining_tokens")


def quota_projection(quota: Column) -> Column:
    """Three numbers of a JSON object, as a map of name and number; null unless all of them are there as numbers (not as texts or truth values)."""
    v = F.try_parse_json(quota)
    number = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, f"$.{k}", "double"))
    whole = F.lit(True)
    for k in QUOTA:
        whole &= number(k).isNotNull()
    return F.when(whole, F.create_map(*[x for k in QUOTA for x in (F.lit(k), number(k))]))


def evaluate(rows: DataFrame, call: Callable[[list[tuple[str, str]]], list[float]], *, batch: int = 16, threshold: float = 0.5) -> DataFrame:
    """Support of (context, response) pairs by an injected model (``scoring.score``), with score and predicted label.

    ``rows``: example_id, context, response. The callable is sent to the workers; it loads its model there."""
    scored = scoring.score(rows, lambda: call, batch=batch)
    return scored.select("example_id", "support", (1 - F.col("support")).alias("score"), F.when(F.col("support") >= threshold, LABELS[0]).otherwise(LABELS[1]).alias("predicted"))
