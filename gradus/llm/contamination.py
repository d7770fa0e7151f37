"""Benchmark passages in documents, by winnowing; DataFrame operations only.

A window is WINDOW words of a benchmark item, or all words of a shorter one. For each length of window, hashes of all k-grams (k half of it) of a text are cut to the
smallest of each stretch that a window spans, and equal neighbours become one run. A window that document and item share has the same smallest hash in both, so it lies in a run whose
hash is also one of the benchmark's: no shared window is missed. Where hashes meet, the words of the run's windows are compared, and hits
that overlap are put together. Only runs move, never words or texts of all documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import discard, free_name, sieved, stash

WINDOW = 10
#: Rows of the benchmark's hashes, or windows, up to which they are broadcast (some 100 MB of windows at most); beyond, both sides are shuffled.
MOST_BROADCAST = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII; A-Z lower-cased, other letters as they are."""
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _least(values: list[Column]) -> Column:
    return values[0] if len(values) == 1 else F.least(*values)


def runs(own: Column, length: int) -> Column:
    """Runs (hash, at, last) of the windows of ``length`` words of an array of words: the smallest k-gram hash that the windows from ``at`` to ``last`` share."""
    k = (length + 1) // 2
    span = length - k + 1
    to = lambda n: F.sequence(F.lit(0), n)
    grams = lambda h: F.transform(to(F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    lows = lambda g: F.transform(to(F.size(g) - span), lambda i: _least([F.get(g, i + j) for j in range(span)]))
    first = lambda m: F.filter(F.transform(m, lambda x, i: F.struct(x.alias("hash"), i.alias("at"))), lambda x: (x["at"] == 0) | (x["hash"] != F.get(m, x["at"] - 1)))
    last = lambda r, n: F.transform(r, lambda x, i: F.struct(x["hash"].alias("hash"), x["at"].alias("at"), (F.coalesce(F.get(r, i + 1)["at"], n) - 1).alias("last")))
    found = _let(F.transform(own, lambda w: F.xxhash64(w)), lambda h: _let(grams(h), lambda g: _let(lows(g), lambda m: _let(first(m), lambda r: last(r, F.size(m))))))
    return F.when(F.size(own) >= length, found).otherwise(F.array().cast("array<struct<hash:bigint,at:int,last:int>>"))


def _window(own: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(own, at + 1, length), " ")


def _broadcast(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence of a window), n_items (items with an occurring window), items_sha256 (of their ids, sorted as strings and joined by
    commas) and contaminated (clashing columns are replaced).

    Null and empty texts have no words, and items without words no window. An id that several items carry counts once. Windows of items without an id count as hits, but such items
    are neither counted nor listed. Repeated documents are marked alike; an empty table stays empty, and with an empty benchmark nothing is hit."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(item_text).alias("w")).where("size(w) > 0")
    items = items.withColumn("length", F.least(F.size("w"), F.lit(window)))
    known = stash(items.select("item", "w", "length"), "benchmark-items")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most ``window`` numbers
    placed = known.select("item", "length", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("at"))
    windows = placed.select("item", "length", _window(F.col("w"), F.col("at"), F.col("length")).alias("window")).distinct()
    # windows of the same items are one set: what documents carry on is the set, not its items
    digest = F.struct(F.count("item").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("xor"))
    sets = stash(windows.groupBy("length", "window").agg(F.xxhash64(digest).alias("set")), "benchmark-windows")
    members = windows.where("item is not null").join(sets, ["length", "window"]).select("set", "item").distinct()
    hashes = stash(_union([known.where(F.col("length") == n).select(F.lit(n).alias("length"), F.explode(runs(F.col("w"), n)["hash"]).alias("hash")) for n in lengths]).distinct(), "benchmark-hashes") if lengths else None

    # texts are told apart by two hashes of 64 bits each; equal ones share their hits
    one, two, own = (free_name(docs, n) for n in ("text_one", "text_two", "own_words"))
    keys = [F.xxhash64(text).alias(one), F.xxhash64(F.lit(1), text).alias(two)]
    if hashes is None:
        hit = docs.limit(0).select(*keys).selectExpr(f"`{one}`", f"`{two}`", "0L as hit", "array(0L) as sets")
    else:
        split = docs.select(*keys, words(text).alias("w"))
        of = lambda n: lambda r: F.struct(F.lit(n).alias("length"), r["hash"].alias("hash"), r["at"].alias("at"), r["last"].alias("last"))
        all_runs = F.flatten(F.array(*[F.transform(runs(F.col("w"), n), of(n)) for n in lengths]))
        cut = split.select(one, two, F.explode(all_runs).alias("r")).select(one, two, "r.*")
        met = cut.join(_broadcast(hashes), ["length", "hash"], "left_semi").groupBy(one, two).agg(F.collect_set(F.struct("length", "at", "last")).alias("runs"))
        met = stash(met, "document-runs")
        near = sieved(docs.select(*keys, F.col(text).alias("text")), met, one, "near").where("near").drop("near").join(met, [one, two])
        near = near.select(one, two, words("text").alias("w"), "runs")
        place = F.transform(F.col("runs"), lambda r: F.transform(F.sequence(r["at"], r["last"]), lambda i: F.struct(r["length"].alias("length"), i.alias("at"))))
        starts = near.withColumn("place", F.flatten(place)).select(one, two, F.explode(F.transform("place", lambda p: F.struct(p["length"].alias("length"), p["at"].alias("at"), _window(F.col("w"), p["at"], p["length"]).alias("window")))).alias("p"))
        found = starts.select(one, two, "p.*").join(_broadcast(sets), ["length", "window"]).groupBy(one, two).agg(F.collect_set(F.struct("at", "length")).alias("places"), F.sort_array(F.collect_set("set")).alias("sets"))
        grown = F.aggregate(
            F.sort_array("places"), F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("to")),
            lambda s, p: F.struct((s["hit"] + F.greatest(p["at"] + p["length"] - F.greatest(s["to"], p["at"]), F.lit(0))).alias("hit"), F.greatest(s["to"], p["at"] + p["length"]).alias("to")),
        )["hit"]
        hit = stash(found.select(one, two, grown.alias("hit"), "sets"), "document-hits")
        discard(met)
    named = hit.select("sets").distinct().withColumn("set", F.explode("sets")).join(members, "set").select("sets", "item").distinct().groupBy("sets").agg(F.sort_array(F.collect_list("item")).alias("items"))
    named = stash(named.select("sets", F.size("items").alias("items"), F.sha2(F.array_join("items", ","), 256).alias("digest")), "document-items")
    marks = hit.join(named, "sets", "left").select(one, two, F.struct("hit", "items", "digest").alias(own))
    counted = docs.withColumn("n_words", F.size(words(text)).cast("long")).withColumns({one: keys[0], two: keys[1]})
    joined = counted.join(marks, [one, two], "left")
    nothing = F.sha2(F.lit(""), 256)
    facts = {"n_hit": F.coalesce(F.col(f"{own}.hit"), F.lit(0).cast("long")), "n_items": F.coalesce(F.col(f"{own}.items"), F.lit(0)).cast("long"), "items_sha256": F.coalesce(F.col(f"{own}.digest"), nothing)}
    joined = joined.withColumns(facts).drop(one, two, own)
    return joined.withColumn("contaminated", F.col("n_hit") > 0)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
