import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gradus.functions import text as tx
from gradus.operators import ranking, regression, retrieval, transitions
from gradus.plans import catalog

TRUTH = [("Q1", ["001"]), ("Q2", []), ("Q3", ["002", "003"]), ("Q4", ["004"]), ("Q5", ["005", "006"])]
FOUND = [("Q1", ["001", "999"]), ("Q2", ["999"]), ("Q3", ["003", "002"]), ("Q4", ["999"]), ("Q5", ["005", "999"]), ("extra", ["1"])]


def frames(spark, truth=TRUTH, found=FOUND):
    return spark.createDataFrame(truth, "query_id string, relevant array<string>"), spark.createDataFrame(found, "query_id string, retrieved array<string>")


def test_macro_golden(spark):
    row = ranking.macro(ranking.per_query(*frames(spark), [5])).first()
    assert row["queries"] == 5
    for name, value in {"precision": 0.16, "recall": 0.5, "hit_rate": 0.6, "mrr": 0.6, "ndcg": 0.5226294385530916}.items():
        assert row[name] == pytest.approx(value, abs=1e-12)


def test_categories_and_missing_prediction(spark):
    truth, found = frames(spark)
    rows = {r.query_id: r.category for r in ranking.per_query(truth, found.where("query_id <> 'Q1'"), [5]).collect()}
    assert rows == {"Q1": "RETRIEVAL_MISS", "Q2": "SHOULD_ABSTAIN", "Q3": "PASS", "Q4": "RETRIEVAL_MISS", "Q5": "PASS"}
    counts = ranking.failure_counts(ranking.per_query(truth, found, [5])).first()
    assert (counts["PASS"], counts["RETRIEVAL_MISS"], counts["SHOULD_ABSTAIN"]) == (3, 1, 1)


def test_graded_ndcg(spark):
    truth = spark.createDataFrame([("q", {"d1": 2.0, "d2": 1.0})], "query_id string, grades map<string,double>")
    found = spark.createDataFrame([("q", ["d2", "d1"])], "query_id string, retrieved array<string>")
    assert ranking.per_query(truth, found, [2]).first()["ndcg"] == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))


def test_duplicates_keep_their_place_and_mrr_is_not_cut(spark):
    truth, found = frames(spark, [("q", ["a", "b"]), ("r", ["z"])], [("q", ["a", "a", "b"]), ("r", ["x", "y", "z"])])
    rows = {r.query_id: r for r in ranking.per_query(truth, found, [3]).collect()}
    assert rows["q"]["precision"] == pytest.approx(2 / 3) and rows["q"]["ndcg"] == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3)))
    cut = {r.query_id: r for r in ranking.per_query(truth, found, [2]).collect()}
    assert cut["r"]["mrr"] == pytest.approx(1 / 3) and cut["r"]["category"] == "RETRIEVAL_MISS"


def test_only_zero_grades_is_a_miss(spark):
    truth = spark.createDataFrame([("q", {"d": 0.0})], "query_id string, grades map<string,double>")
    found = spark.createDataFrame([("q", ["d"])], "query_id string, retrieved array<string>")
    assert ranking.per_query(truth, found, [1]).first()["category"] == "RETRIEVAL_MISS"


@pytest.mark.parametrize("k", [0, -1, True, 1.5])
def test_k_is_checked(k):
    with pytest.raises(ValueError):
        retrieval.check_k(k)


def test_bm25_ties_and_partitions(spark):
    docs = spark.createDataFrame([("d2", "same words"), ("d1", "same words"), ("d3", "other")], "document_id string, text string")
    asked = spark.createDataFrame([("q", "same words words"), ("none", "")], "query_id string, text string")
    for n in (1, 7):
        rows = [(r.query_id, r.document_id, r["rank"]) for r in retrieval.bm25(docs.repartition(n), asked, 5).orderBy("rank").collect()]
        assert rows == [("q", "d1", 1), ("q", "d2", 2)]


def test_bm25_score(spark):
    docs = spark.createDataFrame([("a", "", "x x y"), ("b", "", "z")], "document_id string, title string, text string")
    asked = spark.createDataFrame([("q", "X")], "query_id string, text string")
    idf = math.log1p((2 - 1 + 0.5) / 1.5)
    assert retrieval.bm25(docs, asked, 1).first()["score"] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2)))


def test_tokens(spark):
    row = spark.createDataFrame([("Ａbc 1,5 ไทย ก Straße x٣4",)], "t string").select(tx.tokens(F.col("t")).alias("t")).first()["t"]
    assert row == ["abc", "1,5", "ไท", "ทย", "ไทย", "ก", "strasse", "x", "٣4"]


RULES = [("m", "higher_is_better", 0.7, None, 0.05)]


@pytest.mark.parametrize(("now", "before", "status"), [(0.85, 0.90, "PASS"), (0.849, 0.90, "REGRESSION"), (0.69, 0.70, "REGRESSION"), (None, 0.9, "MISSING"), (0.9, None, "MISSING"), (float("nan"), 0.9, "ERROR")])
def test_regression(spark, now, before, status):
    frame = lambda x: spark.createDataFrame([("m", x)] if x is not None else [], "metric string, value double")
    done = regression.compare(frame(now), frame(before), regression.rules_frame(spark, RULES))
    assert done.first()["status"] == status
    assert regression.verdict(done).first()["passed"] is (status == "PASS")


def test_policy_is_checked(spark):
    for rules in ([], [("m", "higher_is_better", float("inf"), None, 0.0)], [("m", "higher_is_better", True, None, 0.0)], [("m", "up", None, None, 0.0)], [("m", "higher_is_better", None, None, -1.0)]):
        with pytest.raises(ValueError):
            regression.rules_frame(spark, rules)


def test_transitions(spark):
    a = spark.createDataFrame([("1", "PASS"), ("2", "PASS"), ("3", "RETRIEVAL_MISS"), ("4", "RETRIEVAL_MISS"), ("5", "RETRIEVAL_MISS")], "query_id string, category string")
    b = spark.createDataFrame([("1", "PASS"), ("2", "RETRIEVAL_MISS"), ("3", "PASS"), ("4", "RETRIEVAL_MISS"), ("5", "SHOULD_ABSTAIN")], "query_id string, category string")
    got = {r.query_id: r.transition for r in transitions.workspace_transitions(a, b).collect()}
    assert got == {"1": "UNCHANGED_PASS", "2": "REGRESSED", "3": "IMPROVED", "4": "PERSISTENT_FAILURE", "5": "CHANGED_FAILURE"}
    assert transitions.guard_queries(a, b.where("query_id <> '5'")).collect() == [("5", "BASELINE_ONLY")]
    x = spark.createDataFrame([("1", "mrr", 1.0), ("1", "p", 1.0), ("1", "only", 2.0)], "query_id string, metric string, value double")
    y = spark.createDataFrame([("1", "mrr", 0.5), ("1", "p", 1.0)], "query_id string, metric string, value double")
    assert sorted((r.metric, r.delta) for r in transitions.metric_deltas(x, y).collect() if r.delta is not None) == [("mrr", -0.5)]
    assert transitions.metric_deltas(x, y).count() == 2


def test_bm25_in_one_pass_equals_joins(spark, monkeypatch):
    import random

    draw = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = [(f"d{i}", " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(300)] + [("x", None), ("dup", "waa wba"), ("dup2", "waa wba")]
    asked = [(f"q{i}", " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(20)] + [("long", " ".join(words * 5)), ("other", "nothing known"), ("none", "")]
    corpus = spark.createDataFrame(docs, "document_id string, text string").repartition(5)
    queries = spark.createDataFrame(asked, "query_id string, text string")
    for cells in (retrieval.CELLS, 50):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        one = sorted(map(tuple, retrieval.bm25(corpus, queries, 7).select("query_id", "rank", "document_id", "score").collect()))
        assert one == sorted(map(tuple, retrieval.bm25_joined(corpus, queries, 7).select("query_id", "rank", "document_id", "score").collect())) and len(one) > 100
    shared = sorted(map(tuple, retrieval.shared_tokens(corpus, queries, 7).select("query_id", "rank", "document_id", "score").collect()))
    monkeypatch.setattr(retrieval, "MOST_TERMS", 3)
    assert shared == sorted(map(tuple, retrieval.shared_tokens(corpus, queries, 7).select("query_id", "rank", "document_id", "score").collect()))
    assert one == sorted(map(tuple, retrieval.bm25(corpus, queries, 7).select("query_id", "rank", "document_id", "score").collect()))
    monkeypatch.undo()
    assert retrieval.bm25(corpus, queries.where("query_id = 'none'"), 3).count() == 0 == retrieval.bm25(corpus.limit(0), queries, 3).count()


def test_transition_filters(spark):
    rows = spark.createDataFrame([("1", "PASS", "PASS", "STABLE_PASS"), ("12", "PASS", "RETRIEVAL_MISS", "INTRODUCED_FAILURE"), ("3", "RETRIEVAL_MISS", "PASS", "RESOLVED_FAILURE")], "query_id string, baseline_category string, candidate_category string, transition string")
    ids = lambda **f: sorted(r.query_id for r in transitions.filter_transitions(rows, **f).collect())
    assert ids(candidate_category="PASS") == ["1", "3"] and ids(category="RETRIEVAL_MISS") == ["12", "3"] and ids(contains="1", transition="STABLE_PASS") == ["1"]
    assert ids(changed=transitions.changed_records(rows, spark.createDataFrame([("1",)], "query_id string"))) == ["1", "12", "3"]


MIXED = ["Die Straße nach Ａachen ist länger als jede andere Straße", "la niña come 3,5 kilos de piñas cada día en Perú", "plain words about the road", "ไทย ก ٣4", "THE ROAD is long", ""]


def by_hand(text):
    out = []
    for t in re.findall(r"[\u0e00-\u0e7f]+|[a-z]+|\d+(?:[.,]\d+)?", unicodedata.normalize("NFKC", text).casefold()):
        out += [t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)] if "\u0e00" <= t[0] <= "\u0e7f" and len(t) > 1 else [t]
    return out


def test_queries_rank_all_documents(spark, tmp_path):
    asked = ["straße aachen road", "la niña come 3,5 kilos de piñas", "ไทย road"]
    spark.createDataFrame(list(enumerate(MIXED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = {str(i): by_hand(t) for i, t in enumerate(MIXED)}
    mean, wanted = sum(map(len, docs.values())) / len(docs), set()
    for q, text in enumerate(asked):
        for d, terms in docs.items():
            score = 0.0
            for t in set(by_hand(text)) & set(terms):
                df, tf = sum(t in x for x in docs.values()), terms.count(t)
                score += math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / mean))
            if score:
                wanted.add((str(q), d, round(score, 9)))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.document_id, r.score) for r in run("bm25_topk")} == wanted
    assert {(r.query_id, r.document_id, r.score) for r in run("shared_token_topk")} == {(str(q), d, float(n)) for q, a in enumerate(asked) for d, terms in docs.items() if (n := len(set(by_hand(a)) & set(terms)))}
    assert {(r.token, r.df, r.cf) for r in run("bm25_postings_stats")} == {(t, sum(t in x for x in docs.values()), sum(x.count(t) for x in docs.values())) for x in docs.values() for t in x}
    assert [tuple(r) for r in run("bm25_corpus_stats")] == [(6, round(mean, 9))]
    assert {(r.query_id, r.document_id) for r in run("containment_qrels")} == {("1", "1")}


def test_cutting_equals_the_column(spark):
    import random

    from gradus.functions import text as tx
    from gradus.functions.cutting import cut

    draw = random.Random(6)
    letters = [*"abzABZ019.,;' \n\t-", "é", "ß", "ẞ", "Ü", "ÿ", "×", "÷", "«", "½", "²", "µ", "ª", "\xa0", "ﬁ", "Ａ", "１", "٣", "ก", "ข", "๑", "日", "İ", "Σ", "ς", "ſ", "K", "𝒳", "𝟘", "\x00", "\x85", "é"]
    texts = ["".join(draw.choices(letters if n % 3 else letters[:24], k=draw.randint(0, 30))) for n in range(3000)] + [None, "", "1.2,3 4,5.6", "ก", "กข", "กขค1", "Straße 12,5", "x" * 5000]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").unionByName(docs).select("text", tx.tokens(F.col("text")).alias("terms")).collect()
    for r in rows:
        assert [t.encode() for t in r.terms] == cut(r.text), r.text


def test_both_ways_of_bm25_are_equal_to_the_bit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    asked = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select(F.col("item_id").cast("string").alias("query_id"), "text")
    one, two = ({(r.query_id, r.document_id): r.score for r in f(docs, asked, 10).collect()} for f in (retrieval.bm25, retrieval.bm25_joined))
    assert one == two and len(one) == 400
    other = {(r.query_id, r.document_id): r.score for r in retrieval.bm25(docs, asked, 10, tokenizer=lambda c: retrieval.tokens(c)).collect()}
    assert other == one


def test_token_statistics(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(retrieval, "HELD", 3)
    texts = [*MIXED, "one two two", "two three 3.5 3.5 3.5", "", None, "one one one one"]
    for ids in (range(len(texts)), [1] * 4 + [None] * 2 + [*range(6, len(texts))]):
        rows = spark.createDataFrame([(None if i is None else str(i), t) for i, t in zip(ids, texts, strict=True)], "document_id string, text string").repartition(3)
        for tokenizer in (retrieval.tokens, retrieval.ascii_tokens):
            cut = {t: r for t, r in rows.select("text", tokenizer(F.col("text")).alias("terms")).collect()}
            documents = {}
            for i, t in zip(ids, texts, strict=True):
                documents.setdefault(i, Counter()).update(cut[t] or [])
            found = retrieval.token_statistics(rows, tokenizer)
            wanted = {t: (sum(t in d for d in documents.values()), sum(d[t] for d in documents.values()), max(d[t] for d in documents.values())) for d in documents.values() for t in d}
            assert {r.token: (r.df, r.cf, r.max_tf) for r in found.collect()} == wanted


def test_token_statistics_move_no_postings(spark):
    rows = spark.range(0, 3000, 1, 3).select(F.col("id").cast("string").alias("document_id"), F.lit("a b c a").alias("text"))
    found = retrieval.token_statistics(rows)
    assert sorted(map(tuple, found.collect())) == [("a", 3000, 6000, 2), ("b", 3000, 3000, 1), ("c", 3000, 3000, 1)]
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
