"""Personal data: fixed patterns, and more of it by bootstrapped contextual extraction.

1. One pass finds e-mail addresses, IP addresses, card and phone numbers (the seeds), and other tokens with a digit or @
   (the candidates), each with its lexical pattern: the two words before it. The pass is written; texts are
   not needed again but for the counts of step 3.
2. Patterns that precede at least SUPPORT different known entities form the pattern side of a graph, all strings found
   in their slots the instance side.
3. A pattern's confidence is the score of what fills its slots over how often its words occur at all, whatever
   follows. An instance scores one if known, else one minus the product of its patterns' doubts. Both are
   iterated. Patterns of CONFIDENCE and more make their instances known, which may support new patterns, and so on until nothing new is known.

Patterns and instances stay in Spark. To count patterns, one pass over the texts takes bit sets of them to the workers, of at most 16 MB at any
size of the corpus, and an exact join drops what passes by chance.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradus.llm.common import SPARK_SEED, bit_mask, discard, sieved, stash

SUPPORT, CONFIDENCE, STEPS = 3, 0.8, 2
#: Words that a worker remembers, and pairs of words that it counts before it hands them on.
CACHED = 100_000
#: The added kind, after the base kinds in their order.
KINDS = ("email", "ip", "card", "phone", "id")

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACE = " \t\n\x0b\x0c\r"
_AROUND = "\"'`.,;:!?()[]{}<>|#*$%&="
#: Characters beyond which a word of a context, and an instance, go by a hash of the whole.
LONG_WORD, LONG_INSTANCE = 64, 256


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered."""
    if not _ANY.search(text):
        return []
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            found.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _token_start(text: str, at: int) -> int:
    while at > 0 and text[at - 1] not in _SPACE:
        at -= 1
    return at


def _named(word: str, most: int) -> str:
    """A word itself, or a hash of a longer one; no word begins like the latter."""
    return word if len(word) <= most else " " + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def _context(text: str, start: int) -> str | None:
    """The two words before the token at ``start``, lower-cased; None if there are fewer."""
    low = max(0, start - 400)
    while True:
        before = text[low:start].split()
        if low == 0 or len(before) > 2:
            return "\t".join(_named(w.lower(), LONG_WORD) for w in before[-2:]) if len(before) >= 2 else None
        low = max(0, start - 4 * (start - low))


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(start, end, instance, context, is_seed) of seeds and of other tokens with a digit or @. A context may be None: no pattern, but a known instance is found."""
    out = [(a, b, _named(text[a:b].lower(), LONG_INSTANCE), _context(text, _token_start(text, a)), True) for a, _, b in base]
    ends = sorted((a, b) for a, _, b in base)
    done = k = reach = 0
    while m := _ANY.search(text, done):
        start, end = _token_start(text, m.start()), m.end()
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        done = end
        token = text[start:end]
        left = len(token) - len(token.lstrip(_AROUND))
        token = token.strip(_AROUND)
        while k < len(ends) and ends[k][0] < end:
            reach = max(reach, ends[k][1])
            k += 1
        if len(token) >= 4 and reach <= start:
            out.append((start + left, start + left + len(token), _named(token.lower(), LONG_INSTANCE), _context(text, start), False))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("context", pa.string()), ("is_seed", pa.bool_())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("base", pa.list_(_SPAN)), ("found", pa.list_(_FOUND))])
_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, found array<struct<start:long,end:long,instance:string,context:string,is_seed:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in _SCHEMA]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base = base_spans(text) if text else []
            n = Counter(k for _, k, _ in base)
            digest = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
            found = _candidates(text, base) if text else []
            for column, value in zip(rows, (doc, n[0], n[1], n[2], n[3], digest, [dict(zip(("start", "kind", "end"), s)) for s in base], [dict(zip(("start", "end", "instance", "context", "is_seed"), f)) for f in found])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _SCHEMA)], schema=_SCHEMA)


def _occurrences(docs: DataFrame, supported: DataFrame) -> DataFrame:
    """(context, total): how often each pair of words that may be one of ``supported`` occurs. Two bit sets of bounded size go to the workers, one of second
    words and one of pairs; what passes by chance finds no partner in the join that follows."""
    first, second = (F.xxhash64(F.substring_index("context", "\t", n)) for n in (1, -1))
    ends, end_bits = bit_mask(supported.select(second.alias("at")), "at", hashed=True)
    pairs, pair_bits = bit_mask(supported.select(first.bitwiseXOR(F.shiftrightunsigned(second, 7)).alias("at")), "at", hashed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end_mask, pair_mask = ends.value.tobytes(), pairs.value.tobytes()
        own: dict[str, tuple[int, int | None]] = {}  # a word's hash as a first word, and as a second one if it may be one
        total: Counter[str] = Counter()

        def known(word: str) -> tuple[int, int | None]:
            if len(own) >= CACHED:
                own.clear()
            h = xxhash.xxh64_intdigest(word.encode(), SPARK_SEED)
            at = h & (end_bits - 1)
            own[word] = h, h >> 7 if end_mask[at >> 3] >> (at & 7) & 1 else None
            return own[word]

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["context", "total"])
            total.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = (text or "").lower().split()
                before = None
                for i, w in enumerate(words):
                    if len(w) > LONG_WORD:
                        w = words[i] = _named(w, LONG_WORD)
                    h, as_second = own.get(w) or known(w)
                    if as_second is not None and before is not None:
                        at = (before ^ as_second) & (pair_bits - 1)
                        if pair_mask[at >> 3] >> (at & 7) & 1:
                            total[f"{words[i - 1]}\t{w}"] += 1
                    before = h
            if len(total) > CACHED:
                yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "context string, total long").groupBy("context").agg(F.sum("total").alias("total"))


def detect(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, joined by commas),
    and found (the spans as structs of start, kind and end).

    Offsets count code points, ends are exclusive. A null or empty text has no spans; repeated rows stay repeated."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = stash(docs.mapInArrow(_scan, _DDL).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    slots = scanned.select("row", F.inline("found"))
    pairs = stash(slots.groupBy("context", "instance").agg(F.count("*").alias("n"), F.max("is_seed").alias("is_seed")), "pii-pairs")
    known = pairs.where("is_seed").select("instance").distinct()
    patterns = edges = None
    made: list[DataFrame] = []
    for round_ in itertools.count():
        supported = pairs.where("context is not null").join(known, "instance", "left_semi").groupBy("context").agg(F.count("*").alias("support")).where(F.col("support") >= SUPPORT).select("context")
        if patterns is not None:
            supported = supported.join(patterns, "context", "left_anti")
        supported = stash(supported, f"pii-supported-{round_}")
        made.append(supported)
        if supported.take(1):
            counted = _occurrences(docs, supported)
            counted = supported.join(counted, "context", "left").select("context", F.coalesce("total", F.lit(0)).alias("total"))
            patterns = stash(counted if patterns is None else patterns.unionByName(counted), f"pii-patterns-{round_}")
            edges = stash(pairs.join(patterns, "context"), f"pii-edges-{round_}")
            made += [patterns, edges]
        elif patterns is None:
            break
        score = known.withColumn("score", F.lit(1.0))
        for _ in range(STEPS):
            trust = edges.join(score, "instance", "left").groupBy("context").agg((F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))) / F.greatest(F.max("total"), F.sum("n"))).alias("confidence"))
            guessed = edges.join(trust, "context").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(1 - 1e-9)))))).alias("guess"))
            score = guessed.join(known.withColumn("sure", F.lit(1.0)), "instance", "full").select("instance", F.coalesce("sure", "guess").alias("score"))
        trusted = stash(trust.where(F.col("confidence") >= CONFIDENCE).select("context"), f"pii-trusted-{round_}")
        more = stash(edges.join(trusted, "context", "left_semi").select("instance").join(known, "instance", "left_anti").distinct(), f"pii-more-{round_}")
        made += [trusted, more]
        if not more.take(1):
            break
        known = stash(known.unionByName(more), f"pii-known-{round_}")
        made.append(known)
    learned = stash(known.join(pairs.where("is_seed").select("instance"), "instance", "left_anti").select("instance"), "pii-learned")
    discard(pairs, *made)
    extra = slots.where("not is_seed").join(learned, "instance", "left_semi")
    extra = extra.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
    every = scanned.drop("found").join(extra, "row", "left").withColumn("found", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))))
    kinds = F.array(*map(F.lit, KINDS))
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return every.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", joined.alias("spans"), "found")


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series, found: pd.Series) -> pd.Series:
    out = []
    for text, spans in zip(texts, found):
        if text is None or spans is None or not len(spans):
            out.append(text)
            continue
        parts, at = [], 0
        for s in spans:
            if s["start"] >= at:
                parts += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
            at = max(at, s["end"])
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype="object")


def redact(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; of spans that overlap, the first names the kind.

    Rows are told apart by a hash of id and text, so rows without an id, or that repeat one, are treated alike. Only texts with spans move; null and
    empty texts stay as they are, and an empty table stays empty."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col), F.col(text)).alias("key"), F.col(text).alias("text"))
    spans = detect(keyed, id_col="key").where(F.size("found") > 0).groupBy(F.col("doc_id").alias("key")).agg(F.first("found").alias("found"))
    spans = stash(spans, "pii-spans")
    marked = sieved(keyed, spans, "key")
    hits = marked.where("hit").join(spans, "key", "left").withColumn("masked", F.when(F.col("found").isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col("found"))))
    every = hits.select("row", "masked").unionByName(marked.where("not hit").select("row", F.col("text").alias("masked")))
    return every.select(*[F.col("masked").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
