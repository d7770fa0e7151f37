"""Repeated passages: removal of each byte that a string of LENGTH bytes covers which also starts anywhere else, and of passages of so many equal words.

The method first thought of, external induced suffix sorting, takes every suffix through disk-backed priority queues; the README has
its measured rate in Python, some fifteen times over the limits. Here a sparse sample of positions stands for the suffixes,
chosen so that equal strings are always met. Symbols are bytes or words:

1. In each window of so many symbols, the sample-gram of the smallest hash (leftmost at ties) is its anchor. Equal
   windows have equal anchors at equal offsets. Windows in a row share anchors: one for each few hundred bytes.
2. An anchor's row has the hash of the anchor and of its context, the symbols that all windows of this anchor cover. Counts
   by both are summed before they move, so copies in any number are one row for each task. A context found twice or more:
   all its windows are repeated.
3. An anchor found in different contexts, as at the ends of a shared passage: the contexts' symbols meet by anchor and their
   windows are compared one by one. An anchor in very many contexts is not gathered; its windows are counted as rows.
4. The repeated windows of a document are merged, and what they cover goes.

Windows count as equal if 64-bit hashes of the anchor and of the context (or the window) are. All counts cover all documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import discard, partitions, sieved, stash

#: Bytes of a repeated string, and words of a repeated passage.
LENGTH, WORDS = 400, 50
#: Symbols of a text worked on at once (windows of the next part begin where those of the last end), and bytes of short texts that are worked on together.
PART, CHUNK = 1 << 18, 1 << 16
#: Contexts of one anchor that are compared in one task; of an anchor with more, windows are counted as rows.
TOGETHER = 4_000

_random = np.random.default_rng(9)
_TABLES = _random.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_POSITION = np.uint64((1 << 24) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = b" \t\n\x0b\x0c\r"
_INSIDE = np.array([i not in _SPACES for i in range(256)], np.int8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@functools.cache
def _powers(n: int, base: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


class _Runs:
    """Hashes of runs of symbols by prefix sums: the sum of value times power, divided by the power of the run's place, so equal runs are equal wherever they lie."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        size = 1 << max(12, n.bit_length())
        self.down = _powers(size, pow(int(_BASE), -1, 1 << 64))
        up = _powers(size, int(_BASE))[:n]
        values = (t[symbols] for t in _TABLES) if symbols.dtype == np.uint8 else (_mix(symbols + t[0]) for t in _TABLES)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * up))) for v in values]

    def all(self, n: int) -> np.ndarray:
        """Of each run of n symbols, by the first table only."""
        sums = self.sums[0]
        return (sums[n:] - sums[: len(sums) - n]) * self.down[: len(sums) - n]

    def at(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = ((s[end] - s[first]) * self.down[first] for s in self.sums)
        return _mix(a) + b * _BASE


@dataclass(frozen=True)
class Unit:
    """What a text is cut into. ``length``: symbols of a window, ``sample``: of the gram that is its anchor."""

    words: bool
    length: int
    sample: int

    def symbols(self, data: bytes) -> np.ndarray:
        """Bytes, or hashes of words."""
        if not self.words:
            return np.frombuffer(data, np.uint8)
        out = []
        for at in range(0, len(data), PART):  # about PART bytes at once, cut at white space
            lo, hi = (_space_before(data, x) for x in (at, min(at + PART, len(data))))
            raw = np.frombuffer(data, np.uint8)[lo:hi]
            first, end = _places(raw)
            out.append(_Runs(raw).at(first, end))
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of several texts in a row, and where each text's begin and end among them."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        if not self.words:
            return raw, begin, begin + sizes
        first, end = _places(raw)
        return _Runs(raw).at(first, end), np.searchsorted(first, begin), np.searchsorted(first, begin + sizes)

    def spans(self, data: bytes, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of bytes that repeated windows cover; ``first`` and ``last`` windows of runs, in any order."""
        order = np.argsort(first, kind="stable")
        first, end = first[order], np.maximum.accumulate(last[order] + self.length) if len(order) else last
        new = np.concatenate(([True], first[1:] > end[:-1])) if len(order) else np.zeros(0, bool)
        first, end = first[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(new) - 1]))] if len(order) else end
        if self.words and len(first):
            starts, ends = _places(np.frombuffer(data, np.uint8))
            first, end = starts[first], ends[end - 1]
        return list(zip(first.tolist(), end.tolist()))


def _space_before(data: bytes, at: int) -> int:
    """The end of the data, or the last place up to ``at`` that begins the data or follows white space."""
    if at >= len(data):
        return len(data)
    while at > 0 and data[at - 1] not in _SPACES:
        at -= 1
    return at


def _places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    edge = np.diff(_INSIDE[raw], prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def byte_strings(length: int = LENGTH, sample: int | None = None) -> Unit:
    return Unit(False, length, sample or max(1, length // 6))


def word_passages(words: int = WORDS, sample: int | None = None) -> Unit:
    return Unit(True, words, sample or max(1, words // 8))


def _minima(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n in a row."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def anchors(symbols: np.ndarray, length: int, sample: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, context, place, first window, last window) of each anchor of texts that lie between ``begin`` and ``end``."""
    whole = np.flatnonzero(end - begin >= length)
    if not len(whole):
        return (np.empty(0, np.int64),) * 5
    runs = _Runs(symbols)
    grams = _mix(runs.all(sample))
    low = _minima((grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64), length - sample + 1)
    step = np.zeros(len(symbols) + 1, np.int8)  # a text's windows begin between its begin and its end less a window
    step[begin[whole]] = 1
    step[end[whole] - length + 1] -= 1
    window = np.flatnonzero(np.cumsum(step[: len(low)]))
    at = (low[window] & _POSITION).astype(np.int64)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    first = window[new]
    last = window[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
    place = at[new]
    context = _mix(runs.at(first, last + length) + (place - first).astype(np.uint64) * _BASE)
    return grams[place].view(np.int64), context.view(np.int64), place, first, last


def _together(texts: list[bytes]) -> Iterator[list[int]]:
    """Texts of about CHUNK bytes in all; a longer one alone."""
    some, held = [], 0
    for i, t in enumerate(texts):
        if some and held + len(t) > CHUNK:
            yield some
            some, held = [], 0
        some.append(i)
        held += len(t)
    if some:
        yield some


_ANCHOR_DDL = "doc_id long, text_hash long, anchor long, context long, first long, last long, place long"


def _anchor_rows(unit: Unit):
    names = [f.split()[0] for f in _ANCHOR_DDL.split(", ")]

    def rows(doc, text_hash, key, context, place, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, text_hash, key, context, first, last, place)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(i).to_numpy() for i in (0, 1))
            texts = [t if isinstance(t, bytes) else t.encode() for t in batch.column(2).to_pylist()]
            for some in _together(texts):
                if len(some) == 1 and len(texts[some[0]]) > PART:
                    symbols = unit.symbols(texts[some[0]])
                    for at in range(0, len(symbols) - unit.length + 1, PART):
                        part = symbols[at : at + PART + unit.length - 1]
                        key, context, *where = anchors(part, unit.length, unit.sample, np.array([0]), np.array([len(part)]))
                        yield rows(np.full(len(key), doc[some[0]]), np.full(len(key), text_hash[some[0]]), key, context, *(x + at for x in where))
                    continue
                symbols, begin, end = unit.many([texts[i] for i in some])
                key, context, *where = anchors(symbols, unit.length, unit.sample, begin, end)
                of = np.searchsorted(begin, where[0], side="right") - 1 if len(key) else np.empty(0, np.int64)
                yield rows(doc[some][of], text_hash[some][of], key, context, *(x - begin[of] for x in where))

    return run


_PIECE_DDL = "anchor long, doc_id long, text_hash long, first long, place long, piece binary"


def _listed(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Of a list of structs: where each row's items begin (and the end), and fields of all items."""
    flat = column.flatten()
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), *(flat.field(n).to_numpy() for n in names)


def _pieces(unit: Unit):
    """For each wanted anchor of a text, a row with the symbols of its context."""
    width = 8 if unit.words else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 100):
                batch = whole.slice(at, 100)
                bounds, first, last, anchor, place = _listed(batch.column(3), "first", "last", "anchor", "place")
                lo, hi, pieces = (first * width).tolist(), ((last + unit.length) * width).tolist(), []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    data = unit.symbols(text.encode()).tobytes()
                    pieces += [data[a:b] for a, b in zip(lo[bounds[i] : bounds[i + 1]], hi[bounds[i] : bounds[i + 1]])]
                doc, text_hash = (np.repeat(batch.column(i).to_numpy(), np.diff(bounds)) for i in (0, 1))
                columns = [*(pa.array(x, pa.int64()) for x in (anchor, doc, text_hash, first, place)), pa.array(pieces, pa.binary())]
                rows = pa.RecordBatch.from_arrays(columns, names=["anchor", "doc_id", "text_hash", "first", "place", "piece"])
                for k in range(0, len(rows), 5000):
                    yield rows.slice(k, 5000)

    return run


def _windows(rows: pa.Table, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first symbol, hash of anchor and offset, hash of window) of every window of the pieces."""
    pieces = [np.frombuffer(p, np.uint64 if unit.words else np.uint8) for p in rows.column("piece").to_pylist()]
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = sizes - unit.length + 1
    row = np.repeat(np.arange(len(pieces)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    window, held, some = [], 0, 0
    for i, size in enumerate(sizes.tolist()):  # about CHUNK symbols at once
        held += size
        if held >= CHUNK or i == len(sizes) - 1:
            own = sizes[some : i + 1]
            begin = np.concatenate([np.arange(k - unit.length + 1) + e for k, e in zip(own.tolist(), (np.cumsum(own) - own).tolist())])
            window.append(_mix(_Runs(np.concatenate(pieces[some : i + 1])).at(begin, begin + unit.length)))
            some, held = i + 1, 0
    window = np.concatenate(window) if window else np.empty(0, np.uint64)
    anchor, first, place = (rows.column(c).to_numpy() for c in ("anchor", "first", "place"))
    start = first[row] + inside
    spot = _mix(anchor[row].view(np.uint64) + (place[row] - start).astype(np.uint64) * _BASE)
    return row, start, spot.view(np.int64), window.view(np.int64)


def _match(unit: Unit):
    """Of pieces in order of their anchors: the runs of windows that another piece of the anchor has at the same offset."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        row, start, spot, window = _windows(rows, unit)
        order = np.lexsort((window, spot))
        same = (spot[order][1:] == spot[order][:-1]) & (window[order][1:] == window[order][:-1])
        again = np.zeros(len(row), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        new = np.concatenate(([True], (row[at][1:] != row[at][:-1]) | (start[at][1:] != start[at][:-1] + 1))) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(at) - 1])) if len(at) else first
        take = row[at[first]]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows.column("doc_id").to_numpy()[take], rows.column("text_hash").to_numpy()[take], start[at[first]], start[at[last]])], names=["doc_id", "text_hash", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            anchor = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(-(anchor != anchor[-1]).astype(np.int8), 0))  # where the last anchor's rows begin
            if cut:
                yield found(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield found(held)

    return run


def _window_rows(unit: Unit):
    """(doc_id, text_hash, start, place, window): pieces as rows for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = pa.Table.from_batches([batch.slice(at, 500)])
                row, start, spot, window = _windows(rows, unit)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows.column("doc_id").to_numpy()[row], rows.column("text_hash").to_numpy()[row], start, spot, window)], names=["doc_id", "text_hash", "start", "place", "window"])

    return run


def _marks(docs: DataFrame, unit: Unit, name: str) -> DataFrame:
    """(doc_id, text_hash, and ``name``: the repeated windows of a text as runs of their first symbols), written. ``docs``: doc_id, text_hash, text."""
    docs = docs.select("doc_id", "text_hash", "text").where(F.octet_length("text") >= (2 * unit.length - 1 if unit.words else unit.length))
    anchored = stash(docs.mapInArrow(_anchor_rows(unit), _ANCHOR_DDL), "repeats-anchors")
    counts = stash(anchored.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min("doc_id").alias("one")), "repeats-contexts")
    # written, so that the join below can deal out the contexts of a frequent anchor
    shared = stash(counts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).where("n > 1").drop("n"), "repeats-shared")
    found = stash(counts.withColumnRenamed("n", "same").join(shared, "anchor").select("anchor", "context", "same", "one", "contexts"), "repeats-found")
    discard(counts)
    rows = stash(sieved(anchored, shared, "anchor").where("hit").drop("hit").join(found, ["anchor", "context"]), "repeats-rows")
    discard(anchored, found)
    whole = rows.where("same > 1").select("doc_id", "text_hash", "first", "last")
    # one text for each context is enough: where there are more, all windows are repeated anyway
    some = rows.where("contexts > 1 and doc_id = one")
    wanted = some.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last", "anchor", "place")).alias("wanted"))
    texts = sieved(docs, some, "doc_id").where("hit").join(wanted, ["doc_id", "text_hash"])
    pieces = stash(texts.select("doc_id", "text_hash", "text", "wanted").mapInArrow(_pieces(unit), _PIECE_DDL).join(shared, "anchor"), "repeats-pieces")
    kind = "doc_id long, text_hash long, first long, last long"
    few = pieces.where(F.col("contexts") <= TOGETHER).drop("contexts").repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor").mapInArrow(_match(unit), kind)
    windows = pieces.where(F.col("contexts") > TOGETHER).drop("contexts").mapInArrow(_window_rows(unit), "doc_id long, text_hash long, start long, place long, window long")
    again = windows.groupBy("place", "window").agg(F.count("*").alias("n")).where("n > 1").select("place", "window")
    many = windows.join(again, ["place", "window"]).select("doc_id", "text_hash", F.col("start").alias("first"), F.col("start").alias("last"))
    every = whole.unionByName(few).unionByName(many)
    marks = stash(every.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias(name)), "repeats-marks")
    discard(shared, rows, pieces)
    return marks


def _keyed(docs: DataFrame, text: str, id_col: str, own: list[str]) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def _cut(strings: Unit | None, passages: Unit | None):
    """(row, n_removed, n_spans, kept, passages): texts without their repeated strings, and without their repeated passages, as far as they are asked for."""
    kinds = dict(zip(("n_removed", "n_spans", "kept", "passages"), (pa.int64(), pa.int64(), pa.binary(), pa.string())))

    def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
        kept, at = [], 0
        for first, end in spans:
            kept.append(data[at:first])
            at = end
        return b"".join([*kept, data[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            (f, f_first, f_last), (s, s_first, s_last) = (_listed(batch.column(i), "first", "last") for i in (2, 3))
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                spans = strings.spans(data, f_first[f[i] : f[i + 1]], f_last[f[i] : f[i + 1]]) if strings else []
                left = without(data, spans) if strings else None
                prose = without(data, passages.spans(data, s_first[s[i] : s[i + 1]], s_last[s[i] : s[i + 1]])).decode() if passages else None
                for column, value in zip(out, (len(data) - len(left) if strings else None, len(spans), left, prose)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds.values()))], names=["row", *kinds])

    return run


def _applied(keyed: DataFrame, marks: DataFrame, strings: Unit | None, passages: Unit | None) -> DataFrame:
    """Rows with marks (found, short) are cut in workers; all others pass without leaving the JVM or moving."""
    marked = sieved(keyed, marks, "doc_id")
    kind = keyed.schema["row"].dataType.simpleString()
    cut = marked.where("hit").join(marks, ["doc_id", "text_hash"], "left").select("row", "text", "found", "short")
    cut = cut.mapInArrow(_cut(strings, passages), f"row {kind}, n_removed long, n_spans long, kept binary, passages string")
    none, whole = F.lit(0).cast("long"), F.coalesce("text", F.lit(""))
    kept, prose = F.encode(whole, "UTF-8") if strings else F.lit(None).cast("binary"), whole if passages else F.lit(None).cast("string")
    return cut.unionByName(marked.where("not hit").select("row", none.alias("n_removed"), none.alias("n_spans"), kept.alias("kept"), prose.alias("passages")))


def _no_marks():
    return F.lit(None).cast("array<struct<first:bigint,last:bigint>>")


def remove_repeats(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, sample: int | None = None, words: int = 0) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept, the remaining bytes; with ``words`` also passages, the text without passages of
    that many words or more that start anywhere else too (clashing columns are replaced).

    Texts count as UTF-8 bytes, so what is kept may begin or end inside a character; passages are whole words between ASCII white space, which may
    differ. A null text is empty, a text of under ``length`` bytes stays whole, and a repeated row is a repeat of all its windows, so both lose them. An empty
    table gives an empty one."""
    own = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept", *(["passages"] if words else []))]
    keyed = _keyed(docs, text, id_col, own)
    strings, passages = byte_strings(length, sample), word_passages(words) if words else None
    marks = _marks(keyed, strings, "found")
    if passages is None:
        marks = marks.withColumn("short", _no_marks())
    else:
        single = [marks, _marks(keyed, passages, "short")]
        marks = stash(single[0].join(single[1], ["doc_id", "text_hash"], "full"), "repeats-both")
        discard(*single)
    cut = _applied(keyed, marks, strings, passages)
    extra = [] if passages is None else ["passages"]
    return cut.select("row.*", F.coalesce(F.octet_length(F.col(f"row.`{text}`")), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept", *extra)


def remove_passages(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", words: int = WORDS) -> DataFrame:
    """``docs`` without passages of ``words`` words or more that start anywhere else too. A null text stays null; rows without ids and repeated rows are treated
    like all others."""
    keyed = _keyed(docs, text, id_col, docs.columns)
    passages = word_passages(words)
    cut = _applied(keyed, _marks(keyed, passages, "short").withColumn("found", _no_marks()), None, passages)
    return cut.select(*[(F.when(F.col(f"row.`{c}`").isNotNull(), F.col("passages")) if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
