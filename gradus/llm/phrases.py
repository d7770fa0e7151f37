"""Collocations by pivot partitions, as in MG-FSM.

1. Words are counted in each language. What the later steps need of these counts is a table of fixed size: for each hash bucket the largest count of a word
   in it, never less than a word's own.
2. Words order by that bound and their hash, one order everywhere. Each occurrence of an n-gram has one rarest word in it, the first where it occurs more than
   once: its pivot. Around each position goes a fragment, as far as no rarer word (nor an infrequent one or a border) stands, four words at most to either side.
   Equal fragments are counted before they move, and a row holds all fragments that a task found for a pivot.
3. Fragments meet by pivot; n-grams are counted there, and only those that hold the pivot. A pivot with more than HOT occurrences has several parts, dealt by
   hash of the fragment, whose counts are added.
4. Phrases, and words, found often enough join as parts of longer phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.llm.common import SPARK_SEED, small_batches, stash

#: Occurrences of a pivot beyond which its fragments are dealt out as several groups.
HOT = 200_000
#: Buckets of word counts that go to every task, 4 bytes each: sixteen for each frequent word, within these bounds.
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 12, 1 << 22
#: Bytes of text, and words of fragments, that are worked on together.
TOGETHER, WORDS = 9_000_000, 600_000
#: Words that a task counts before it hands counts on.
COUNTED = 500_000

# No word holds these: the border of a piece, or a pivot's place in its fragment, and the end of a fragment.
_END, _CUT = b".", b"!"
_CLASS = bytes(c + 32 if 65 <= c <= 90 else 46 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def _texts(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[dict[str, bytes]]:
    """By language, prepared bytes: A-Z lower, borders of pieces as full stops. Long texts are cut at borders; a piece is never cut."""
    own: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, at = text.encode().translate(_CLASS), 0
            while at < len(data):
                end = len(data) if len(data) - at <= together else data.find(_END, at + together)
                part = data[at : end if end >= 0 else len(data)]
                own.setdefault(lang, []).append(part)
                size, at = size + len(part), at + len(part)
                if size >= together:
                    yield {k: _END.join(v) for k, v in own.items()}
                    own, size = {}, 0
    if own:
        yield {k: _END.join(v) for k, v in own.items()}


def _tokens(data: bytes) -> list[bytes]:
    """Words, and a full stop for each border."""
    return data.replace(_END, b" . ").split()


def _count_words(together: int):
    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(_END, None)
            yield pa.record_batch([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for texts in _texts(batches, together):
            for lang, data in texts.items():
                counts.setdefault(lang, Counter()).update(_tokens(data))
            if sum(map(len, counts.values())) > COUNTED:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)

    return run


def _shifted(a: np.ndarray, by: int) -> np.ndarray:
    """``a`` at positions ``by`` further on; 0 beyond its ends."""
    out = np.zeros_like(a)
    if abs(by) < len(a):
        if by > 0:
            out[:-by] = a[by:]
        else:
            out[-by:] = a[:by]
    return out


def _reach(rank: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each frequent word (rank 1 is the most frequent, 0 none), how many words before it are less rare, and how many after it are not rarer: at most ``most``."""
    before, after = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    more, also = rank > 0, rank > 0
    for j in range(1, most + 1):
        left, right = _shifted(rank, -j), _shifted(rank, j)
        more = more & (left > 0) & (left < rank)
        also = also & (right > 0) & (right <= rank)
        before += more
        after += also
    return before, after


def _fragments(tokens: list[bytes], lang: str, bounds: np.ndarray, least: int, longest: int, hot: int) -> Iterator[tuple]:
    """(head, body) for each pivot, or part of one, of these words: which one it is, and its different fragments with their numbers. A fragment has a full stop for its pivot."""
    words = sorted(set(tokens))
    index = dict(zip(words, range(len(words)), strict=True))
    ids = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
    seed = xxhash.xxh64_intdigest(lang.encode(), seed=SPARK_SEED)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))
    bound = bounds[(hashes & np.uint64(len(bounds) - 1)).astype(np.int64)].astype(np.int64)
    if _END in index:
        bound[index[_END]] = 0
    place = np.empty(len(words), np.int64)
    place[np.lexsort((np.arange(len(words)), hashes, -bound))] = np.arange(1, len(words) + 1)
    place[bound < least] = 0
    rank = place[ids]
    before, after = _reach(rank, longest - 1)
    at = np.flatnonzero(before + after)
    if not len(at):
        return
    before, after = before[at], after[at]
    one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(1 - longest, longest):  # two hashes of each fragment; what they tell apart wrongly or not is only counted apart or together before it moves
        inside = (-j <= before) & (j <= after)
        value = np.zeros(len(at), np.uint64)
        value[inside] = rank[at[inside] + j].astype(np.uint64)
        one = (one ^ (value + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0x9E3779B97F4A7C15)
        one ^= one >> np.uint64(29)
        two = (two + value * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + longest)) * np.uint64(0xC2B2AE3D27D4EB4F)
        two ^= two >> np.uint64(31)
    parts = np.maximum(1, -(-bound[ids[at]] // hot))
    part = (two % parts.astype(np.uint64)).astype(np.int64)
    after_next, before_last = rank[np.minimum(at + 1, len(rank) - 1)], rank[np.maximum(at - 1, 0)]  # neighbours in the order share words, so they take less room
    order = np.lexsort((one, np.where(before > 0, before_last, 0), np.where(after > 0, after_next, 0), part, rank[at]))
    at, before, after, one, two, parts, part = (x[order] for x in (at, before, after, one, two, parts, part))
    pivot = ids[at]
    new = np.ones(len(at), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (pivot[1:] != pivot[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at))).astype(np.int32)
    at, before, after, parts, part, pivot = (x[first] for x in (at, before, after, parts, part, pivot))
    lines = [b" ".join((*tokens[a:p], _END, *tokens[p + 1 : b])) for a, p, b in zip((at - before).tolist(), at.tolist(), (at + after + 1).tolist(), strict=True)]
    starts = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
        yield _head(words[pivot[a]], int(part[a]), int(parts[a]), lang), _body(lines[a:b], counts[a:b])


def _head(pivot: bytes, part: int, parts: int, lang: str) -> bytes:
    return b"%b\n%d %d %b" % (pivot, part, parts, lang.encode())


def _unhead(head: bytes) -> tuple[str, bytes, bool]:
    """(lang, pivot, whether it has one part)."""
    pivot, rest = head.split(b"\n", 1)
    _, parts, lang = rest.split(b" ", 2)
    return lang.decode(), pivot, parts == b"1"


def _body(lines: list[bytes], counts: np.ndarray) -> bytes:
    """Numbers take a byte each, or four if one of them needs more."""
    kind = "<u1" if counts.max() < 256 else "<u4"
    return len(lines).to_bytes(4, "little") + kind[-1:].encode() + counts.astype(kind).tobytes() + b"\n".join(lines)


def _unbody(body: bytes) -> tuple[bytes, np.ndarray]:
    n, width = int.from_bytes(body[:4], "little"), int(body[4:5])
    return body[5 + n * width :], np.frombuffer(body, f"<u{width}", n, 5).astype(np.int64)


_ROUTED = pa.schema([("head", pa.binary()), ("body", pa.binary())])


def _route(bounds, least: int, longest: int, hot: int, together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _texts(batches, together):
            for lang, data in texts.items():
                rows = list(_fragments(_tokens(data), lang, bounds.value, least, longest, hot))
                for i in range(0, len(rows), 2000):
                    yield pa.record_batch([pa.array(list(x), f.type) for x, f in zip(zip(*rows[i : i + 2000], strict=True), _ROUTED, strict=True)], schema=_ROUTED)

    return run


def _ngrams(groups: list[tuple[str, bytes, bool, list[tuple[bytes, np.ndarray]]]], least: int, longest: int) -> list[tuple[str, bytes, int]]:
    """(lang, phrase, count) of the n-grams that hold their fragment's pivot; of whole groups only those found often enough."""
    tokens = b" ! ".join(lines.replace(b"\n", b" ! ") for *_, rows in groups for lines, _ in rows).split(b" ")
    counts = np.concatenate([c for *_, rows in groups for _, c in rows])
    group = np.repeat(np.arange(len(groups)), [sum(len(c) for _, c in rows) for *_, rows in groups])
    whole = np.array([w for _, _, w, _ in groups])
    words = sorted({*tokens, *(p for _, p, *_ in groups)})
    index = dict(zip(words, range(len(words)), strict=True))
    ids = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
    end = ids == index.get(_CUT, -1)
    fragment = np.cumsum(end)
    start = np.concatenate([[0], np.flatnonzero(end) + 1])
    offset = np.arange(len(ids)) - start[fragment]
    pivots = np.flatnonzero(ids == index[_END])
    places = offset[pivots]  # one in each fragment
    ids[pivots] = np.array([index[p] for _, p, *_ in groups])[group]
    size = np.diff(np.append(start, len(ids) + 1)) - 1
    at = np.flatnonzero(~end & (offset <= places[fragment]))
    gram, found = np.unique(group[fragment[at]] * len(words) + ids[at], return_inverse=True)[1], []
    for n in range(2, longest + 1):
        fits = offset[at] + n <= size[fragment[at]]
        at, gram = at[fits], gram[fits]
        if not len(at):
            break
        _, first, gram = np.unique(gram * len(words) + ids[at + n - 1], return_index=True, return_inverse=True)
        held = offset[at] + n > places[fragment[at]]
        total = np.bincount(gram[held], counts[fragment[at[held]]], len(first)).astype(np.int64)
        own = group[fragment[at[first]]]
        often = (total >= least) | (~whole[own] & (total > 0))
        for i in np.flatnonzero(often).tolist():
            p, (lang, pivot, *_) = at[first[i]], groups[own[i]]
            found.append((lang, b" ".join(tokens[p : p + n]).replace(_END, pivot), int(total[i])))
        keep = ~held | often[gram]  # what is too rare with its pivot stays so when it grows
        at, gram = at[keep], gram[keep]
    return found


def _mine(least: int, longest: int):
    def rows(groups: list) -> pa.RecordBatch:
        found = _ngrams(groups, least, longest)
        return pa.record_batch([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.binary()).cast(pa.string()), pa.array([x[2] for x in found], pa.int64())], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size, last = [], 0, None
        for batch in batches:
            for head, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head != last:
                    if size >= WORDS:
                        yield rows(groups)
                        groups, size = [], 0
                    groups.append((*_unhead(head), []))
                    last = head
                lines, counts = _unbody(body)
                groups[-1][3].append((lines, counts))
                size += lines.count(b" ") + len(counts)
        if groups:
            yield rows(groups)

    return run


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, hot: int = HOT, together: int = TOGETHER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    Everything is counted by language (null: ``und``): n all words, a the phrase, l and r the parts of its weakest cut, with score floor(1000 a n / (l r)); of equal
    cuts the first. Phrases inside a longer one that occurs as often go. Order: score, a (both descending), phrase. Null and empty texts hold no words; repeated rows
    count each time; an empty table has no phrases. Other columns of any name are not read. A piece (a run without punctuation) is worked on whole."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_count_words(together), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stash(counts, "phrase-words")
    words = counts.where(F.col("n") >= least)
    many = words.count()
    buckets = min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (16 * many).bit_length()))
    largest = words.groupBy(F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)).cast("int").alias("at")).agg(F.least(F.max("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    bounds = np.zeros(buckets, np.int32)
    bounds[largest.column("at").to_numpy()] = largest.column("n").to_numpy()
    routed = texts.mapInArrow(_route(spark.sparkContext.broadcast(bounds), least, longest, hot, together), "head binary, body binary")
    routed = routed.repartition("head").sortWithinPartitions("head")
    mined = routed.mapInArrow(_mine(least, longest), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return _ranked(stash(mined, "phrases"), words.selectExpr("lang", "word as phrase", "n as a"), counts.groupBy("lang").agg(F.sum("n").alias("n")), top)


def _ranked(phrases: DataFrame, words: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    joined = "array_join(slice(w, {0}, {1}), ' ')"
    split = phrases.withColumn("w", F.split("phrase", " ", -1))
    inner = split.where("size(w) > 2").selectExpr("lang", "a", "w", "explode(sequence(2, size(w) - 1)) as m").selectExpr("lang", "a", "w", "m", "explode(sequence(1, size(w) - m + 1)) as i")
    inner = inner.selectExpr("lang", joined.format("i", "m") + " as phrase", "a").groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = split.join(inner, ["lang", "phrase"], "left").where("inside is null or inside < a").drop("inside")
    cuts = kept.selectExpr("lang", "phrase", "a", "w", "explode(sequence(1, size(w) - 1)) as k")
    cuts = cuts.selectExpr("lang", "phrase", "a", "k", joined.format(1, "k") + " as head", joined.format("k + 1", "size(w) - k") + " as rest")
    parts = phrases.unionByName(words)
    cuts = cuts.join(parts.selectExpr("lang", "phrase as head", "a as l"), ["lang", "head"]).join(parts.selectExpr("lang", "phrase as rest", "a as r"), ["lang", "rest"]).join(sizes, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*").drop("k")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
