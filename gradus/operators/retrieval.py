"""BM25 ranking over a postings table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions.cutting import cut
from gradus.functions.text import ascii_tokens, tokens

# The usual parameters of BM25.
K1, B = 1.2, 0.75
# Terms and queries that are broadcast at most, and cells of documents by queries, and documents, that are worked on at once.
MOST_TERMS, MOST_QUERIES, CELLS, ROWS = 500_000, 20_000, 200_000, 1000
# Different tokens that a worker counts before it hands them on.
HELD = 400_000


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k has to be a positive integer")
    return k


def _text(corpus: DataFrame) -> Column:
    """A title, if there is one, comes before the text."""
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), "text") if "title" in corpus.columns else F.col("text")


def tokenized(corpus: DataFrame, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(document_id, terms, length)."""
    return corpus.select("document_id", tokenizer(_text(corpus)).alias("terms")).withColumn("length", F.size("terms"))


def _read(corpus: DataFrame, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """What a worker counts tokens of: texts, which it cuts itself, or the tokens of another tokenizer than the usual one."""
    if tokenizer is tokens:
        return corpus.select("document_id", _text(corpus).alias("text"))
    return tokenized(corpus, tokenizer).select("document_id", "terms")


def postings(docs: DataFrame) -> DataFrame:
    """(token, document_id, tf, length)."""
    return docs.select("document_id", "length", F.explode("terms").alias("token")).groupBy("token", "document_id", "length").agg(F.count("*").alias("tf"))


def token_statistics(corpus: DataFrame, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """(token, df, cf, max_tf): documents that have a token, its occurrences, and the most in one document.

    Workers cut and count, and hand on a row for each of a portion's tokens (HELD different ones and those of one more document at most), not one for each token of each document. Where
    ids repeat, which is looked up when this is called, rows of one id are one document, and tokens are grouped by it."""
    if corpus.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        own = tokenized(corpus, tokenizer).select("document_id", F.explode("terms").alias("token")).groupBy("token", "document_id").agg(F.count("*").alias("tf"))
        return own.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))
    docs = _read(corpus, tokenizer).drop("document_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf, most = {}, {}, {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t.decode() if isinstance(t, bytes) else t for t in cf], pa.string()), pa.array([df[t] for t in cf], pa.int64()), pa.array(cf.values(), pa.int64()), pa.array([most.get(t, 1) for t in cf], pa.int64())], ["token", "df", "cf", "max_tf"])

        for batch in batches:
            for row in batch.column(0).to_pylist():
                tf = Counter(row or () if batch.schema.names[0] == "terms" else cut(row))
                for t, n in tf.items():
                    if t in cf:
                        df[t] += 1
                        cf[t] += n
                    else:
                        df[t], cf[t] = 1, n
                    if n > 1 and n > most.get(t, 1):
                        most[t] = n
                if len(cf) >= HELD:
                    yield counted()
                    df, cf, most = {}, {}, {}
        yield counted()

    found = docs.mapInArrow(run, "token string, df long, cf long, max_tf long")
    return found.groupBy("token").agg(*[how(c).alias(c) for how, c in ((F.sum, "df"), (F.sum, "cf"), (F.max, "max_tf"))])


def corpus_statistics(docs: DataFrame) -> DataFrame:
    """One row: n_docs, avg_length."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))


def query_terms(queries: DataFrame, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("token"))


def rank(scores: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of each query by score, ties to the smaller document id as a string, ranks from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("document_id"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= check_k(k))


def _scale(n: Column) -> Column:
    return F.when(n > 200, 1e12).otherwise(1e15)


class _Terms:
    """The queries' terms, as far as they fit in a broadcast: query ids, the vocabulary, and for each token the queries that ask for it."""

    def __init__(self, rows: list):
        self.queries = [r.query_id for r in rows]
        self.scale = np.array([r.scale for r in rows])
        self.vocabulary = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(self.vocabulary)}
        self.number: dict[bytes, int] | None = None  # made by each worker
        pairs = sorted((number[t], q) for q, r in enumerate(rows) for t in r.terms)
        self.asked = np.array([q for _, q in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.vocabulary) + 1))

    def counts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, token, how often) of the batch's tokens that a query asks for, documents by their place; and how many tokens each document has."""
        if "text" in batch.schema.names:
            if self.number is None:
                self.number = {t.encode(): i for i, t in enumerate(self.vocabulary)}
            get, hits, lengths = self.number.get, [], []
            for text in batch.column("text").to_pylist():
                own = cut(text)
                lengths.append(len(own))
                hits.append([i for t in own if (i := get(t)) is not None])
            length = np.array(lengths, np.int64)
            key = np.repeat(np.arange(len(batch)), [len(h) for h in hits]) * len(self.vocabulary) + np.fromiter(chain.from_iterable(hits), np.int64)
        else:
            lists = batch.column("terms")
            length = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=pa.array(self.vocabulary, pa.string())), -1).to_numpy()
            key = (np.repeat(np.arange(len(batch)), length) * len(self.vocabulary) + at)[at >= 0]
        key, tf = np.unique(key, return_counts=True)
        return key // len(self.vocabulary), key % len(self.vocabulary), tf, length


def _collected(queries: DataFrame, tokenizer: Callable[[Column], Column]) -> _Terms | None:
    """The queries' terms on the driver, or None if they are more than MOST_TERMS or MOST_QUERIES."""
    terms = queries.select("query_id", F.array_distinct(tokenizer(F.col("text"))).alias("terms")).withColumn("scale", _scale(F.size("terms"))).where("size(terms) > 0")
    size = terms.agg(F.count("*").alias("q"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()
    return _Terms(terms.orderBy("query_id").collect()) if size.q <= MOST_QUERIES and size.n <= MOST_TERMS else None


def _best(shared, weigh, k: int):
    """Scores all queries over batches of documents, and hands on each query's best ``k`` of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: _Terms = shared.value
        m = len(terms.queries)
        step = max(1, min(ROWS, CELLS // m))
        query, units, ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)

        def cut() -> None:
            nonlocal query, units, ids
            place = np.unique(ids.astype(str), return_inverse=True)[1] if len(ids) else ids
            order = np.lexsort((place, -units, query))
            query, units, ids = query[order], units[order], ids[order]
            start = np.searchsorted(query, query, side="left")
            keep = np.arange(len(query)) - start < k
            query, units, ids = query[keep], units[keep], ids[keep]

        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                doc, token, tf, length = terms.counts(batch)
                part = weigh(token, tf, length[doc])
                n = (terms.first[1:] - terms.first[:-1])[token]
                of = terms.asked[np.arange(n.sum()) + np.repeat(terms.first[token] - (np.cumsum(n) - n), n)]
                grid = np.zeros(len(batch) * m, np.int64)
                np.add.at(grid, np.repeat(doc, n) * m + of, np.rint(np.repeat(part, n) * terms.scale[of]).astype(np.int64))
                grid = grid.reshape(-1, m)
                if len(batch) > 4 * k:  # of many documents, those below a query's k-th best go first
                    low = np.partition(grid, len(batch) - k, axis=0)[len(batch) - k]
                    where, of = np.nonzero((grid >= low) & (grid > 0))
                else:
                    where, of = np.nonzero(grid)
                names = np.array(batch.column("document_id").to_pylist(), object)
                named = names[where] != None  # noqa: E711  a document without an id counts in the statistics but can't be named
                where, of = where[named], of[named]
                query, units, ids = np.concatenate((query, of)), np.concatenate((units, grid[where, of])), np.concatenate((ids, names[where]))
                if len(query) > 4 * k * m + 100_000:
                    cut()
        cut()
        yield pa.RecordBatch.from_arrays([pa.array([terms.queries[q] for q in query], pa.string()), pa.array(list(ids), pa.string()), pa.array(units / terms.scale[query], pa.float64())], names=["query_id", "document_id", "score"])

    return run


def bm25(corpus: DataFrame, queries: DataFrame, k: int, *, tokenizer: Callable[[Column], Column] = tokens, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, document_id, score, rank). Only documents that share a token with the query appear.

    Where the queries' terms fit in a broadcast (MOST_TERMS), the corpus is read twice, cut and counted by workers in one go, and hardly anything moves: once for the frequencies of these terms and the mean
    length, which are counted when this is called, and once for scores, of which each task hands on its best ``k`` for each query. Beyond that, postings of the
    queries' tokens are joined (``bm25_joined``). Both add up parts of a score as integers of 15 decimal places (12 for queries of over 200 tokens, so that sums fit): a
    score is the same for every order and partitioning, and equal documents are equal."""
    terms = _collected(queries, tokenizer)
    if terms is None:
        return bm25_joined(corpus, queries, k, tokenizer=tokenizer, k1=k1, b=b)
    docs, spark = _read(corpus, tokenizer), corpus.sparkSession
    schema = "query_id string, document_id string, score double"
    if not terms.queries:
        return rank(spark.createDataFrame([], schema), k)
    shared = spark.sparkContext.broadcast(terms)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(shared.value.vocabulary) + 1, np.int64), 0, 0
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                _, token, _, own = shared.value.counts(batch.slice(at, ROWS))
                df[:-1] += np.bincount(token, minlength=len(df) - 1)
                length += int(own.sum())
            n += len(batch)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int64()), pa.array([*df[some], n], pa.int64()), pa.array([*[0] * len(some), length], pa.int64())], names=["token", "df", "length"])

    rows = docs.mapInArrow(frequencies, "token long, df long, length long").groupBy("token").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))
    total = F.first(F.when(F.col("token") == -1, F.col("df")), ignorenulls=True)
    one = rows.agg(total.alias("n_docs"), F.max("length").alias("total"))
    rows = rows.where("token >= 0").crossJoin(F.broadcast(one)).select("token", "n_docs", "total", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    found = rows.toPandas()  # as many rows as the queries have different tokens
    idf = np.zeros(len(terms.vocabulary))
    idf[found["token"].to_numpy()] = found["idf"].to_numpy()
    average = float(found["total"].iloc[0] / found["n_docs"].iloc[0]) if len(found) else 1.0
    weigh = lambda token, tf, length: idf[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
    return rank(docs.mapInArrow(_best(shared, weigh, check_k(k)), schema), k)


def bm25_joined(corpus: DataFrame, queries: DataFrame, k: int, *, tokenizer: Callable[[Column], Column] = tokens, k1: float = K1, b: float = B) -> DataFrame:
    """``bm25`` for any number of queries, by joins: tokens of no query are dropped before postings are counted, and scores are grouped by query and document."""
    docs = tokenized(corpus, tokenizer)
    terms = queries.select("query_id", F.array_distinct(tokenizer(F.col("text"))).alias("terms"))
    terms = terms.select("query_id", _scale(F.size("terms")).alias("scale"), F.explode("terms").alias("token"))
    wanted = terms.select("token").distinct()
    used = docs.select("document_id", "length", F.explode("terms").alias("token")).join(wanted, "token", "left_semi")
    used = used.groupBy("document_id", "length", "token").agg(F.count("*").alias("tf"))
    df = used.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(corpus_statistics(docs))).select("token", "avg_length", F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    parts = used.join(idf, "token").select("token", "document_id", weight.alias("part")).join(terms, "token")
    scores = parts.groupBy("query_id", "document_id", "scale").agg(F.sum(F.rint(F.col("part") * F.col("scale")).cast("long")).alias("units"))
    return rank(scores.select("query_id", "document_id", (F.col("units") / F.col("scale")).alias("score")), k)


def shared_tokens(corpus: DataFrame, queries: DataFrame, k: int, *, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """A plainer ranking to compare with: how many different query tokens a document has. In one pass over the corpus where the terms fit in a broadcast, else by a join."""
    docs, spark, schema = _read(corpus, tokenizer), corpus.sparkSession, "query_id string, document_id string, score double"
    terms = _collected(queries, tokenizer)
    if terms is None:
        have = tokenized(corpus, tokenizer).select("document_id", F.explode(F.array_distinct("terms")).alias("token"))
        return rank(have.join(query_terms(queries, tokenizer), "token").groupBy("query_id", "document_id").agg(F.count("*").cast("double").alias("score")), k)
    if not terms.queries:
        return rank(spark.createDataFrame([], schema), k)
    terms.scale = np.ones(len(terms.queries))
    one = lambda token, tf, length: np.ones(len(token))
    return rank(docs.mapInArrow(_best(spark.sparkContext.broadcast(terms), one, check_k(k)), schema), k)


def rankings(ranked: DataFrame) -> DataFrame:
    """(query_id, retrieved, scores): ids in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "document_id", "score")))
    return ranked.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.col("rows.document_id").alias("retrieved"), F.col("rows.score").alias("scores"))


__all__ = ["ascii_tokens", "bm25", "bm25_joined", "check_k", "corpus_statistics", "postings", "query_terms", "rank", "rankings", "shared_tokens", "token_statistics", "tokenized", "tokens"]
