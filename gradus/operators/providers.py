"""Analytics over a log of attempts: latency, usage, reliability, streaks, resuming, recommendation, HTTP classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.text import safe_ratio
from gradus.operators.order import numbered, percentiles, running

# Names that providers give to token counts, in order of preference, and the preference order of judges.
TOKEN_ALIASES = {
    "input_tokens": ("input_tokens", "prompt_tokens", "promptTokenCount", "prompt_eval_count"),
    "output_tokens": ("output_tokens", "completion_tokens", "candidatesTokenCount", "eval_count"),
    "thinking_tokens": ("reasoning_tokens", "thoughtsTokenCount"),
    "total_tokens": ("total_tokens", "totalTokenCount"),
    "cost": ("cost", "total_cost"),
}
RETRYABLE = ("API_RATE_LIMIT", "API_SERVER_ERROR", "API_TIMEOUT", "LOCAL_CONNECTION_ERROR", "LOCAL_SERVER_ERROR", "LOCAL_TIMEOUT")
# Families of models by parts of their names, in order, and parts of names of models that don't chat.
FAMILIES = (
    ("Gemini", ("gemini", "gemma", "google")), ("DeepSeek", ("deepseek",)), ("Qwen", ("qwen",)), ("Mistral", ("mistral",)), ("Meta/Llama", ("llama", "meta")),
    ("Claude", ("claude", "anthropic")), ("OpenAI", ("openai", "gpt-")), ("xAI", ("grok", "xai")), ("Nova", ("nova",)), ("Perplexity", ("perplexity",)),
)
# Words of an error that say which limit was reached, in order.
RATE_LIMITS = (
    ("RPD", ("requestsperday", "requests_per_day", "rpd")),
    ("TPM", ("tokensperminute", "tokens_per_minute", "tpm")),
    ("RPM", ("requestsperminute", "requests_per_minute", "rpm")),
)
NO_CHAT = ("embedding", "rerank", "vision", "image", "audio", "tts")
PREFERRED = ("deepseek-v4-flash", "deepseek-v4-pro", "qwen3.6-flash", "qwen3.5-9b", "mistral-medium-3.1", "llama-4-scout", "llama-4-maverick")


# What a trace may show of a request: no content, no reasoning.
TRACE_FIELDS = (
    "provider", "requested_model", "gateway", "catalog_model_name", "returned_model", "model_version", "response_id", "observed_at", "returned_provider", "backend_revision", "api_success", "http_status",
    "response_object_type", "finish_reason", "assistant_content_present", "assistant_content_length", "reasoning_present", "reasoning_length", "tool_calls_present", "usage_metadata_present", "usage", "quota",
    "request_id", "latency_ms", "retry_after_seconds", "rate_limit_dimension", "structured_requested", "requested_output_mode", "actual_output_mode", "provider_schema_enforced", "local_schema_validated",
    "error_class", "safe_error_summary",
)
PROGRESS_FIELDS = (
    "api_success", "parse_success", "structured_output_status", "requested_model", "model_version", "response_id", "observed_at", "usage", "latency_ms", "error_class", "rate_limit_dimension", "retry_after_seconds",
)


def safe_projection(rows: DataFrame, key: list[str], allowed: tuple[str, ...] = TRACE_FIELDS) -> DataFrame:
    """The key and those columns that may be shown, in their fixed order; all others are dropped."""
    return rows.select(*key, *[c for c in allowed if c in rows.columns and c not in key])


def latency(rows: DataFrame, by: str | None = None, column: str = "latency_ms") -> DataFrame:
    """count, mean, p50 and p95 by nearest rank; zeros for no rows."""
    aggs = [F.count(column).alias("count"), F.coalesce(F.avg(column), F.lit(0.0)).alias("mean")]
    at = percentiles(rows, column, {"p50": 0.5, "p95": 0.95}, by)
    out = rows.groupBy(by).agg(*aggs).join(at.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by") if by else rows.agg(*aggs).crossJoin(at)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("p50", "p95")})


def usage(rows: DataFrame, by: str | None = None, column: str = "usage") -> DataFrame:
    """Totals of token counts in a map column; of several names for one count in a record, the first one counts."""
    pick = lambda names: F.coalesce(*[F.try_element_at(F.col(column), F.lit(n)) for n in names])
    aggs = [F.coalesce(F.sum(pick(names)), F.lit(0.0)).alias(name) for name, names in TOKEN_ALIASES.items()]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def tokens_per_second(tokens: Column, nanoseconds: Column) -> Column:
    return F.try_divide(tokens * 1e9, nanoseconds)


def reliability(rows: DataFrame, by: str) -> DataFrame:
    """(by, total, evaluated_count, missing_count, api_success_rate, parse_success_rate, schema_validation_failure_rate), all rates of all records.

    A record counts as evaluated if it has a prediction (``label``); a failure of validation is a PARSE_ERROR or SCHEMA_VALIDATION_ERROR."""
    n = rows.groupBy(by).agg(
        F.count("*").alias("total"), F.count("label").alias("evaluated_count"), F.expr("count_if(api_success)").alias("api"), F.expr("count_if(parse_success)").alias("parsed"),
        F.expr("count_if(error_class in ('PARSE_ERROR', 'SCHEMA_VALIDATION_ERROR'))").alias("schema"),
    )
    rate = lambda c: safe_ratio(F.col(c), F.col("total"))
    return n.select(by, "total", "evaluated_count", (F.col("total") - F.col("evaluated_count")).alias("missing_count"), rate("api").alias("api_success_rate"), rate("parsed").alias("parse_success_rate"), rate("schema").alias("schema_validation_failure_rate"))


def technical_reliability(rows: DataFrame, by: str | None = None, *, failures: int = 10, least_valid: float = 0.98, after: int = 100) -> DataFrame:
    """Of a full run: total_records, api_success_count, parse_success_count, valid_success_count, terminal_failure_count, retry_record_count (attempt beyond the first),
    validity_rate and circuit_breaker, TRIPPED by too many failures or, after enough records, too small a share of valid ones."""
    valid = F.count("label")
    aggs = [
        F.count("*").alias("total_records"), F.count_if("api_success").alias("api_success_count"), F.count_if("parse_success").alias("parse_success_count"), valid.alias("valid_success_count"),
        (F.count("*") - valid).alias("terminal_failure_count"), F.expr("count_if(attempt > 1)").alias("retry_record_count"),
    ]
    out = (rows.groupBy(by) if by else rows).agg(*aggs).withColumn("validity_rate", safe_ratio(F.col("valid_success_count"), F.col("total_records")))
    tripped = (F.col("terminal_failure_count") >= failures) | ((F.col("total_records") >= after) & (F.col("validity_rate") < least_valid))
    return out.withColumn("circuit_breaker", F.when(tripped, "TRIPPED").otherwise("NOT_TRIPPED"))


def operational(rows: DataFrame, by: str | None = None, *, examples: int = 2675) -> DataFrame:
    """load_count, load_mean_ms, load_max_ms, completion_tokens, eval_seconds, tokens_per_second, latency_mean_ms, projected_hours of a run over ``examples``.

    ``rows``: usage (a map with load_duration_ns, eval_duration_ns, completion_tokens), latency_ms."""
    use = lambda k: F.try_element_at("usage", F.lit(k))
    load = use("load_duration_ns") / 1e6
    aggs = [
        F.count(load).alias("load_count"), F.avg(load).alias("load_mean_ms"), F.max(load).alias("load_max_ms"), F.coalesce(F.sum(use("completion_tokens")), F.lit(0.0)).alias("completion_tokens"),
        (F.coalesce(F.sum(use("eval_duration_ns")), F.lit(0.0)) / 1e9).alias("eval_seconds"), F.avg("latency_ms").alias("latency_mean_ms"),
    ]
    out = (rows.groupBy(by) if by else rows).agg(*aggs)
    return out.withColumns({"tokens_per_second": F.try_divide("completion_tokens", "eval_seconds"), "projected_hours": F.col("latency_mean_ms") * examples / 3_600_000})


def failure_breakdown(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(category, position, example_id) of unsuccessful records: what their stored error class and finish reason prove, with their places in the manifest.

    Sorted by category and position; records of no example of the manifest are left out."""
    parse, schema = F.col("error_class") == "PARSE_ERROR", F.col("error_class") == "SCHEMA_VALIDATION_ERROR"
    category = (
        F.when(parse & (F.col("finish_reason") == "length"), "OUTPUT_TOKEN_LIMIT").when(parse, "PERSISTED_PARSE_ERROR_SUBTYPE_UNKNOWN").when(schema, "PERSISTED_SCHEMA_VALIDATION_SUBTYPE_UNKNOWN")
        .otherwise(F.coalesce(F.when(F.col("error_class") != "", F.col("error_class")), F.lit("UNKNOWN_FAILURE")))
    )
    failed = records.where(~F.col("status").eqNullSafe("SUCCESS")).select("example_id", category.alias("category"))
    return failed.join(manifest.select("example_id", "position"), "example_id").select("category", "position", "example_id").orderBy("category", "position")


def error_counts(rows: DataFrame) -> DataFrame:
    return rows.where("error_class is not null").groupBy("error_class").agg(F.count("*").alias("n")).orderBy("error_class")


def health_status(status: Column, phase: str) -> Column:
    """What an HTTP outcome of a health check means; 0 stands for a failed transport. A phase is completion, discovery, timeout and the like."""
    out = (
        F.when(status.between(200, 299), "PASS").when(status.isin(401, 403), "AUTH_FAILED").when(status == 402, "QUOTA_EXHAUSTED").when((status == 404) & F.lit(phase == "completion"), "MODEL_UNAVAILABLE")
        .when(status == 429, "RATE_LIMITED").when(status.isin(0, 408, 500, 502, 503, 504), "NETWORK_FAILED")
    )
    return out.otherwise("NETWORK_FAILED" if phase == "timeout" else "INVALID_RESPONSE")


def error_class(status: Column) -> Column:
    """Class of a failed request to a hosted model."""
    return (
        F.when(status.isin(401, 403), "API_AUTH_ERROR").when(status == 402, "API_QUOTA_ERROR").when(status == 429, "API_RATE_LIMIT").when(status.isin(408, 504), "API_TIMEOUT")
        .when(status.between(500, 599), "API_SERVER_ERROR").otherwise("API_ERROR")
    )


def local_error_class(status: Column, body: Column) -> Column:
    """Class of a failed request to a local model; words of the body come before the status."""
    text = F.lower(F.coalesce(body, F.lit("")))
    has = lambda *terms: F.greatest(*[text.contains(t) for t in terms])
    return (
        F.when(has("out of memory", "outofmemory", "oom"), "LOCAL_OOM").when(has("failed to load", "insufficient memory", "resource exhausted"), "LOCAL_RESOURCE_ERROR").when(status == 404, "LOCAL_MODEL_NOT_FOUND")
        .when(status.isin(408, 504), "LOCAL_TIMEOUT").when(status.between(500, 599), "LOCAL_SERVER_ERROR").otherwise("LOCAL_REQUEST_ERROR")
    )


def rate_limit_dimension(status: Column, error: Column) -> Column:
    """Only for 429, by words of the body's error: requests per day before tokens and requests per minute, else OTHER."""
    text = F.lower(F.coalesce(error, F.lit("")))
    out = F.when(status != 429, F.lit(None))
    for name, terms in RATE_LIMITS:
        out = out.when(F.greatest(*[text.contains(t) for t in terms]), name)
    return out.otherwise("OTHER")


def retry_after(header: Column, details: Column) -> Column:
    """Seconds: the header if it is a number of 0 or more, else the details' number, which may carry an s."""
    head = F.when(F.trim(header).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.trim(header).try_cast("double"))
    detail = F.regexp_extract(details, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*s?\s*$", 1).try_cast("double")
    return F.coalesce(F.when(head >= 0, head), detail)


def field_violations(violations: Column, most: int = 8) -> Column:
    """The first few violations (structs of field and description) that say anything."""
    return F.slice(F.filter(violations, lambda x: x["field"].isNotNull() | x["description"].isNotNull()), 1, most)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key, reduced in each task before it moves."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def resume(manifest: DataFrame, attempts: DataFrame) -> DataFrame:
    """(position, example_id, state) in the manifest's order: SUCCESSFUL, PREVIOUSLY_FAILED or NEVER_ATTEMPTED; what is not successful is pending."""
    per = attempts.groupBy("example_id").agg(F.bool_or(F.col("status") == "SUCCESS").alias("ok"))
    state = F.when(F.col("ok"), "SUCCESSFUL").when(F.col("ok").isNull(), "NEVER_ATTEMPTED").otherwise("PREVIOUSLY_FAILED")
    return manifest.join(per, "example_id", "left").select("position", "example_id", state.alias("state"), (state != "SUCCESSFUL").alias("pending"))


def retry_plan(attempts: DataFrame, by: list[str], order: list[str], most: int = 2) -> DataFrame:
    """Each attempt with ``retries`` (how many followed a failure that may be tried again, up to here) and delay_seconds before the next one; null where there is none: after
    success, after a failure of another kind, and when ``most`` retries are used up."""
    may = F.coalesce(F.col("error_class").isin(*RETRYABLE), F.lit(False))
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts.withColumn("retries", F.coalesce(F.sum(may.cast("int")).over(before), F.lit(0)))
    return rows.withColumn("delay_seconds", F.when(may & (F.col("retries") < most), F.least(F.lit(2.0), 0.1 * F.pow(F.lit(2.0), F.col("retries").cast("double")))))


def within_budget(pending: DataFrame, budget: int, used: int = 0) -> DataFrame:
    """Pending examples (position, pending) that the rest of a budget of requests covers, in the manifest's order."""
    return pending.where("pending").orderBy("position").limit(max(0, budget - used))


def streaks(attempts: DataFrame, by: str, order: list[str], limit: int = 3) -> DataFrame:
    """Each attempt with the gap to the one before, the length of the run of rate limits that it ends, and whether the breaker is open: after ``limit`` in a row, or at
    once if ``rate_limit_dimension`` is there and says that a day's requests are used up."""
    ordered = Window.partitionBy(by).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limited = F.col("error_class") == "API_RATE_LIMIT"
    rows = attempts.withColumn("limited", F.coalesce(limited, F.lit(False))).withColumn("reset", F.sum((~F.col("limited")).cast("int")).over(upto))
    run = Window.partitionBy(by, "reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("streak", F.sum(F.col("limited").cast("int")).over(run))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (micros - F.lag(micros).over(ordered)) / 1e6
    stop = F.col("streak") >= limit
    if "rate_limit_dimension" in attempts.columns:
        stop |= F.col("limited") & F.col("rate_limit_dimension").eqNullSafe("RPD")
    return rows.withColumns({"gap_seconds": gap, "open": F.max(stop).over(upto)}).drop("limited", "reset")


def full_run_breaker(attempts: DataFrame, by: str, order: list[str], failures: int = 10, least_valid: float = 0.98, after: int = 100) -> DataFrame:
    """(by, stop_at): the number of the first attempt that makes too many failures, or too few valid ones after enough of them; null if none does.

    Valid is an attempt with a prediction (``label``), whatever the call itself gave. A provider's log of any length is summed over ranges of its order."""
    rows = running(attempts.select(by, *order, "label"), [F.col(c) for c in order], {"nth": F.lit(1), "valid": F.when(F.col("label").isNotNull(), 1).otherwise(0)}, partition=[by])
    stop = (F.col("nth") - F.col("valid") >= failures) | ((F.col("nth") >= after) & (F.col("valid") / F.col("nth") < least_valid))
    return rows.groupBy(by).agg(F.min(F.when(stop, F.col("nth"))).alias("stop_at"))


def recommend(summaries: DataFrame) -> DataFrame:
    """Complete providers in order of preference, with ``place`` from 1: balanced accuracy, F1, fewer false positives, parsing, p95, tokens, name.

    Complete are those with nothing missing and all calls and parses successful. Missing figures count as the worst ones."""
    worst = {"balanced_accuracy": 0.0, "f1": 0.0, "false_positive_rate": 1.0, "p95": float("inf"), "total_tokens": float("inf")}
    rows = summaries.where("missing_count = 0 and api_success_rate = 1.0 and parse_success_rate = 1.0").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(w)) for c, w in worst.items()})
    order = [F.desc("balanced_accuracy"), F.desc("f1"), F.asc("false_positive_rate"), F.desc("parse_success_rate"), F.asc("p95"), F.asc("total_tokens"), F.asc("provider")]
    return numbered(rows, *order)


def recommendation(summaries: DataFrame) -> DataFrame:
    """One row: status, provider. RECOMMENDED with the first of ``recommend``, or UNVERIFIED if no provider is complete."""
    first = recommend(summaries).agg(F.min_by("provider", "place").alias("provider"))
    return first.select(F.when(F.col("provider").isNull(), "UNVERIFIED").otherwise("RECOMMENDED").alias("status"), "provider")


def token_estimate(rows: DataFrame, output_tokens: int, column: str = "prompt") -> DataFrame:
    """One row: n, tokens, from a third of the characters, the outputs, and a quarter on top."""
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.ceil(F.length(column) / 3)), F.lit(0)).alias("inputs"))
    return n.select("n", F.ceil((F.col("inputs") + F.col("n") * output_tokens) * 1.25).cast("long").alias("tokens"))


def lengths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, min, p50, p95, max, mean) of characters."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.length(c).alias("n")) for c in columns])))
    at = percentiles(long, "n", {"p50": 0.5, "p95": 0.95}, "field")
    out = long.groupBy("field").agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean")).join(at, "field", "left")
    return out.select("field", "min", F.col("p50").cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"), "max", "mean")


def model_family(name: Column) -> Column:
    """Family by parts of id and name, the first of FAMILIES that fits, else Other."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike("|".join(terms)), family) for family, terms in FAMILIES], F.lit("Other"))


def is_text_chat(name: Column) -> Column:
    return ~F.lower(name).rlike("|".join(NO_CHAT))


def quota_gate(remaining: Column, estimated: Column) -> Column:
    """PASS if the remaining tokens of the day cover the estimate; null if they aren't known."""
    return F.when(remaining >= estimated, "PASS").when(remaining < estimated, "QUOTA_INSUFFICIENT")


def model_candidates(models: DataFrame, preferred: tuple[str, ...] = PREFERRED, most: int = 3) -> DataFrame:
    """Chat models of other families than Gemini: preferred ones in their order, previews last, larger quotas first (unknown ones last), then by id.

    ``models``: model_id, name, quota."""
    if not 1 <= most <= 3:
        raise ValueError("one to three candidates")
    both = F.concat_ws(" ", "model_id", "name")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col("model_id")), F.lit(0)) if preferred else F.lit(0)
    fit = models.where((model_family(both) != "Gemini") & is_text_chat(both))
    return fit.orderBy(F.when(place > 0, place).otherwise(len(preferred) + 1), F.lower(both).contains("preview").cast("int"), F.desc(F.coalesce("quota", F.lit(-1))), "model_id").limit(most)


def free_model(models: DataFrame) -> DataFrame:
    """One row: model_id of the free model to use, those with structured output first, then by id; null if there is none.

    ``models``: model_id, modality (null counts as text), supported_parameters (an array). Free are ids with ``:free``; the modality has to begin with ``text->``."""
    structured = F.coalesce(F.arrays_overlap("supported_parameters", F.array(F.lit("response_format"), F.lit("structured_outputs"))), F.lit(False))
    fit = models.where(F.col("model_id").contains(":free") & (F.col("modality").isNull() | F.col("modality").startswith("text->")))
    return fit.agg(F.min(F.struct((~structured).cast("int").alias("plain"), "model_id")).alias("best")).select("best.model_id")
