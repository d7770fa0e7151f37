import corpus_pipeline
from gradus.llm import near_dedup, quality
from gradus.llm.common import stash

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    results = []
    for name, stage in corpus_pipeline.STAGES:
        read = docs
        docs = stash(stage(spark, docs, SMALL), "test")
        results.append((name, read, docs))
    assert [n for n, _, _ in results] == ["quality rules", "near duplicates", "repeated passages", "personal data", "packing"]
    for _, before, after in results[:-1]:
        assert after.dtypes == before.dtypes
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, packed) = results
    kept = {r.doc_id for r in quality.score(a).where("kept").collect()}
    assert {r.doc_id for r in b.collect()} == kept
    one = {r.doc_id for r in near_dedup.group(b).where("kept").collect()}
    assert sorted(r.doc_id for r in c.collect()) == sorted(one) and c.count() == d.count() == e.count()
    assert all(r.n_chars == len(r.text) for r in e.collect())
    assert not e.where(r"text rlike '[a-z]@mail[0-9]'").count()
    assert packed.selectExpr("sum(length)").first()[0] == packed.select("doc_id", "doc_tokens").distinct().selectExpr("sum(doc_tokens)").first()[0]


def test_repeated_ids_of_different_texts(spark):
    words = [f"w{i}" for i in range(400)]
    copied, clean, other, third = (" ".join(words[a : a + 60]) for a in (0, 80, 160, 240))
    near = other.replace("w200 ", "")
    rows = [(1, copied), (2, copied), (2, clean), (3, clean), (4, other), (4, near), (5, third), (5, third), (5, clean + " " + third), (6, near)]
    docs = spark.createDataFrame([(*r, "en", "x", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 4):
        got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(n), SMALL).collect())
        assert len(got) == 5 and set(got) - {(4, other), (4, near)} == {(1, copied), (2, clean), (5, third), (5, clean + " " + third)}
        found = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.group(docs.repartition(n)).collect()}
        assert found == {(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (5, 5, True), (6, 4, False)}


def test_stages_on_empty_tables_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:80]), " ".join(words[:80]), " ".join([*words[100:160], "own", "mail a.b@mail.example"]), " ".join(["else", *words[100:160]]), None, ""]
    rows = [(i, t, "en", "x", len(t or ""), "k", "r", 1, False, "t") for i, t in enumerate(texts)] + [(None, texts[0], "en", "x", 3, "k", "r", 1, False, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, row string, hit int, kept boolean, text_hash string")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stash(stage(spark, some, SMALL), "test")
            if name == "packing":
                assert got.count() == (0 if some is not docs else 7)
            else:
                assert got.dtypes == some.dtypes and got.where("key <> 'k' or row <> 'r' or hit <> 1 or kept or text_hash <> 't'").count() == 0
            found = {r.doc_id: r.text for r in got.collect()} if name != "packing" else {}
            if some is docs and name == "quality rules":
                assert set(found) == {0, 1, 2, 3, None}
            if some is docs and name == "near duplicates":
                assert set(found) == {0, 2, 4, 5, None}
            if some is docs and name == "repeated passages":
                assert found == {0: "", 1: "", 2: " own mail a.b@mail.example", 3: "else ", 4: None, 5: "", None: ""}
            if some is docs and name == "personal data":
                assert found[2].endswith("own mail <email>") and found[4] is None
