"""URL filters: allow and block rules for a host, its subdomains and a path prefix.

Sort-merge range join, DataFrame operations only. A host is keyed by its labels in reverse, each
closed by a dot (``de.example.net`` -> ``net.example.de.``), so a rule's host with all subdomains is the
interval of keys that start with the rule's key. Such intervals nest or are disjoint. The bounds
of all rule intervals are events that carry the stack of rules active from there on; a sweep in key order
hands each url the stack of the last event at or before its key. The stack's rules whose path fits are
ordered by length, and the longest decides.

The sweep runs in ``chunks`` independent sweeps. Urls are dealt to them by a hash of their row, not by
key, so a host with any share of the rows spreads evenly; each chunk sweeps all rule events. Rules are
configuration (their events are repeated ``chunks`` times); urls move through one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Rule = tuple[str, str, str]

#: (host, path, verdict)
DEFAULT_RULES: tuple[Rule, ...] = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty for null or no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack): from ``key`` on, the rules of ``stack`` are active, until the next event.

    An interval of key ``k`` ends where ``k`` with its last dot replaced by the next character (``/``) begins."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    hosts = rules.select("rule_host").distinct()
    labels = F.split("rule_host", r"\.", -1)
    above = hosts.select("rule_host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up", "at_host"))
    active = above.join(rules.withColumnRenamed("rule_host", "at_host"), "at_host")
    rule = F.struct(
        (F.length("at_host") + F.length("rule_path")).alias("size"), F.length("at_host").alias("host_size"), F.concat("at_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"), F.col("rule_path").alias("path"),
    )
    key = _key(F.col("rule_host"))
    starts = active.groupBy("rule_host").agg(F.collect_list(rule).alias("stack")).select(key.alias("key"), "stack")
    outer = active.filter("up > 0").groupBy("rule_host").agg(F.collect_list(rule).alias("stack"))
    ends = hosts.withColumn("k", key).join(outer, "rule_host", "left").select(F.expr("concat(substring(k, 1, length(k) - 1), '/')").alias("key"), "stack")
    return starts.unionByName(ends)


def filter_urls(urls: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", chunks: int | None = None) -> DataFrame:
    """``urls`` with host, path, rule and verdict added (a clashing column of the input is replaced).

    Of the rules that fit, the one with the most characters of host and path wins; at equal
    length the one with the longer host, then the greater rule string, then the greater verdict (``block``).
    A null url, or one without ``://``, has an empty host and path, fits no rule and gets ``default``. Repeated rows stay repeated, an empty table stays empty, and without rules every row gets ``default``."""
    spark = urls.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rows = urls.withColumn("__u", F.col(url)).select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), url_host(F.col("__u")).alias("host"), url_path(F.col("__u")).alias("path"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("chunk"),
    )
    events = rule_events(rules)
    events = events.select(
        F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"), "key", F.coalesce("stack", F.array().cast(events.schema["stack"].dataType)).alias("stack"), F.lit(0).alias("is_url"),
    )
    both = rows.withColumns({"key": _key(F.col("host")), "stack": F.lit(None).cast(events.schema["stack"].dataType), "is_url": F.lit(1)}).unionByName(events)
    sweep = Window.partitionBy("chunk").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("is_url = 1")
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.withColumn("best", best).select(
        *[F.col("row").getField(c).alias(c) for c in own], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    rows = [F.struct(F.lit(host).alias("host"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict")) for host, path, verdict in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
