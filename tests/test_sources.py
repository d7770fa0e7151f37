import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gradus.functions import judge
from gradus.operators import evidence, jobs, population, providers, validate
from gradus.sources import readers, sinks


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = lines(tmp_path / "g.jsonl", [{"query_id": "1", "relevant_document_ids": ["a"]}, "", "{broken", {"query_id": "2", "relevant_document_ids": []}, {"query_id": "2", "relevant_document_ids": []}])
    good, issues = readers.ground_truth(spark, p)
    assert [r.query_id for r in good.collect()] == ["1"]
    assert sorted((r.code, r.message.split(":")[0], r.record_id) for r in issues.collect()) == [("DUPLICATE_QUERY_ID", "line 5", "2"), ("INVALID_JSONL", "line 3", None)]
    with pytest.raises(Exception, match="DUPLICATE_QUERY_ID|INVALID_JSONL"):
        readers.strict(good, issues).collect()
    q = lines(tmp_path / "p.jsonl", [{"query_id": "1", "retrieved_document_ids": ["a", "a"]}, {"query_id": "2", "retrieved_document_ids": ["a"], "scores": [1.0, 2.0]}, {"query_id": "3", "retrieved_document_ids": ["a"]}])
    good, issues = readers.predictions(spark, q)
    assert [r.query_id for r in good.collect()] == ["3"] and issues.count() == 2


def test_topics_qrels_corpus(spark, tmp_path):
    good, issues = readers.topics(spark, lines(tmp_path / "t.tsv", ["1\ta\tb", "2", "", "\tx"]))
    assert good.collect() == [("1", "a\tb")] and issues.count() == 3
    good, issues = readers.qrels(spark, lines(tmp_path / "q.tsv", ["1 Q0 d 1", "1 Q0 d 1", "1 Q1 d 1", "1 Q0 d -1", "1 Q0 d x", "1 Q0 d"]))
    assert good.count() == 0 and sorted(r.code for r in issues.collect()) == ["DUPLICATE_QREL"] + ["INVALID_QREL"] * 4
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write(json.dumps({"docid": "d1", "text": "x"}) + "\n")
    again = [{"docid": "d1", "title": "t", "text": "y"}, {"docid": "d2", "text": "z"}, {"docid": "d2", "text": "z"}]
    rows, issues = readers.corpus(spark, [str(tmp_path / "c.jsonl.gz"), lines(tmp_path / "c2.jsonl", again)])
    assert sorted(r.text for r in rows.collect()) == ["x", "y"] and [(r.code, r.record_id, r.message) for r in issues.collect()] == [("DUPLICATE_DOCID", "d2", "line 3: occurrence 2")]


def test_line_numbers_over_blocks_and_files(spark, tmp_path):
    for n in (1, 300, 4000):
        (tmp_path / f"{n}.txt").write_text("".join(f"{i} {'x' * (i % 50)}\n" for i in range(1, n + 1)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = readers.numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == 4301 and all(int(r.value.split()[0]) == r.line for r in rows)


def test_cases_and_registered_inputs(spark, tmp_path):
    p = lines(tmp_path / "c.jsonl", [{"id": "a", "question": "q"}, "", "{broken"])
    cases, issues = readers.rag_cases(spark, p)
    assert [(r.id, r.line) for r in cases.collect()] == [("a", 1)] and [r.message for r in issues.collect()] == ["line 3: {broken"]
    with pytest.raises(Exception, match="line 3"):
        readers.strict(cases, issues).collect()
    p = lines(tmp_path / "g.jsonl", [{"query_id": "1", "relevant_document_ids": ["a"]}, {"query_id": "2", "relevant_document_ids": []}])
    got = readers.registered_input(spark, p, "ground_truth").first()
    assert got.records == 2 and got.sha256 == hashlib.sha256(open(p, "rb").read()).hexdigest()
    assert readers.registered_input(spark, p, "ground_truth", got.sha256).count() == 1
    with pytest.raises(Exception, match="CHECKSUM_MISMATCH"):
        readers.registered_input(spark, p, "ground_truth", "0").collect()


def test_labelled_responses(spark, tmp_path):
    info = [{"source_id": "s", "task_type": "QA", "source": "x", "prompt": "p", "source_info": json.dumps({"question": "q", "passages": "pass"})}]
    label = {"start": 0, "end": 5, "text": "Paris", "label_type": "x", "due_to_null": "yes", "implicit_true": False}
    rows = [{"id": "r1", "source_id": "s", "split": "test", "quality": "good", "response": "Paris!", "labels": [label]}, {"id": "r2", "source_id": "s", "split": "test", "quality": "good", "response": "green.", "labels": json.dumps([label])}, {"id": "r3", "source_id": "none", "split": "test", "quality": "good", "response": "x", "labels": None}, {"id": "r4", "source_id": "none", "split": "train", "quality": "good", "response": "x", "labels": ""}]
    got, issues = readers.labelled_responses(spark, lines(tmp_path / "r.jsonl", rows), lines(tmp_path / "s.jsonl", info), split="test")
    by = {r.example_id: r for r in got.collect()}
    assert set(by) == {"r1", "r2"} and by["r1"].context == "pass" and by["r1"].spans[0].due_to_null is True
    assert by["r1"].spans[0].validation_issues == [] and by["r2"].spans[0].validation_issues == ["TEXT_OFFSET_MISMATCH"]
    assert sorted(r.code for r in issues.collect()) == ["TEXT_OFFSET_MISMATCH", "UNKNOWN_SOURCE"]


def test_csv(spark, tmp_path):
    p = lines(tmp_path / "x.csv", ["id , docs", '1,"a| b ||c"', "2,"])
    got = {r.query_id: r.relevant for r in readers.mapped_csv(spark, p, "ground_truth", {"query_id": "id", "document_ids": "docs"}).collect()}
    assert got == {"1": ["a", "b", "c"], "2": []}
    for kind, mapping, code in (("other", {}, "UNSUPPORTED_KIND"), ("ground_truth", {"query_id": "id"}, "INVALID_MAPPING"), ("ground_truth", {"query_id": "id", "document_ids": "no"}, "MISSING_COLUMN")):
        with pytest.raises(readers.InputError) as e:
            readers.mapped_csv(spark, p, kind, mapping)
        assert e.value.code == code


def test_sinks(spark, tmp_path):
    assert sinks.canonical_json({"b": 1, "a": "é"}, str(tmp_path / "x.json")) == '{\n  "a": "é",\n  "b": 1\n}\n' == (tmp_path / "x.json").read_text()
    rows = spark.createDataFrame([("1", 0.5)], "query_id string, value double")
    mark = sinks.write_immutable(rows, str(tmp_path / "runs"), "run-1")
    assert sinks.verified(spark, str(tmp_path / "runs"), "run-1", mark).count() == 1
    with pytest.raises(Exception):
        sinks.write_immutable(rows, str(tmp_path / "runs"), "run-1")
    with pytest.raises(ValueError):
        sinks.verified(spark, str(tmp_path / "runs"), "run-1", "other")
    with pytest.raises(FileExistsError):
        sinks.canonical_json({}, str(tmp_path / "x.json"), exclusive=True)
    sinks.export_bundle(str(tmp_path / "bundle"), {"a.json": {"x": 1}, "b.json": []})
    assert sorted(f.name for f in (tmp_path / "bundle").iterdir()) == ["a.json", "b.json"]
    with pytest.raises(FileExistsError):
        sinks.export_bundle(str(tmp_path / "bundle"), {})
    with pytest.raises(ValueError):
        sinks.export_bundle(str(tmp_path / "other"), {"../x": 1})
    assert not [f for f in tmp_path.iterdir() if "tmp-" in f.name or f.name == "other"]
    manifest = str(tmp_path / "preparation-manifest.json")
    made = sinks.preparation_manifest(spark, {"mode": "full"}, [str(tmp_path / "x.json")], manifest)
    assert list(made["checksums"]) == ["x.json"] and json.loads(open(manifest).read()) == made
    (tmp_path / "x.json").write_text("else")
    with pytest.raises(ValueError, match="x.json"):
        sinks.preparation_manifest(spark, {"mode": "full"}, [str(tmp_path / "x.json")], manifest)
    failures = spark.createDataFrame([("1", "REGRESSED")], "query_id string, transition string")
    marks = sinks.write_comparison(rows, failures, str(tmp_path / "cmp"), "c-1")
    a, b = sinks.read_comparison(spark, str(tmp_path / "cmp"), "c-1", marks)
    assert a.count() == b.count() == 1
    with pytest.raises(ValueError):
        sinks.read_comparison(spark, str(tmp_path / "cmp"), "c-1", marks | {"failures": "0"})
    ddl = "run_id string, workspace_id string, config_sha256 string, truth_sha256 string, predictions_sha256 string"
    proof, frozen = spark.createDataFrame([("r", "w", "1", "2", "3"), ("s", "w", "1", "2", "3")], ddl), spark.createDataFrame([("r", "w", "1", "x", "3")], ddl)
    assert sorted(sinks.provenance_violations(proof, frozen).collect()) == [("r", "truth_sha256"), ("s", "run_id")]
    nested = spark.createDataFrame([("a", [{"m": 1 / 3}], {"x": 2 / 3})], "artifact_id string, rows array<struct<m: double>>, metrics map<string,double>")
    assert json.loads(sinks.public_artifact(nested).first().json) == {"artifact_id": "a", "metrics": {"x": 0.666666666667}, "rows": [{"m": 0.333333333333}]}
    p = lines(tmp_path / "art.jsonl", [{"artifact_id": "a", "artifact_type": "run", "schema_version": "public-evidence-v1"}])
    assert [(r.artifact_id, r.artifact_type) for r in sinks.load_public_artifacts(spark, p).select("artifact_id", "artifact_type").collect()] == [("a", "run")]
    with pytest.raises(Exception, match="not a public artifact"):
        sinks.load_public_artifacts(spark, lines(tmp_path / "bad.jsonl", [{"artifact_id": "a", "artifact_type": "other", "schema_version": "public-evidence-v1"}])).select("artifact_type").collect()
    ddl = "example_id string, status string"
    state, change = spark.createDataFrame([("a", "SUCCESS"), ("b", "FAILED")], ddl), spark.createDataFrame([("a", "FAILED"), ("b", "SUCCESS"), ("c", "FAILED")], ddl)
    assert sorted(sinks.upsert(state, change, ["example_id"]).collect()) == [("a", "SUCCESS"), ("b", "SUCCESS"), ("c", "FAILED")]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([("1", None), ("2", "x")], "k string, v string")
    mark = lambda df: population.fingerprint(df, ["k", "v"]).first()["fingerprint"]
    assert mark(a) == mark(a.orderBy(F.desc("k")).repartition(3)) != mark(a.withColumn("v", F.lit("x")))


def test_validation(spark):
    ddl = "line long, id string, question string, ground_truth string, relevant_document_ids array<string>, category string, difficulty string"
    cases = spark.createDataFrame([(0, "a", "What is the capital of France today?", "x", ["d"], "direct_factual", "easy"), (1, "a", "What is the capital of France today!", "x", ["no"], "direct_factual", "easy"), (2, "c", "Else?", " ", [], "nonsense", "easy")], ddl)
    catalog = spark.createDataFrame([("d",)], "document_id string")
    found = sorted((r.code, r.record_id) for r in validate.rag_cases(cases, catalog).collect())
    assert found == [("DUPLICATE_ID", "a"), ("EMPTY_GROUND_TRUTH", "c"), ("INVALID_CATEGORY", "c"), ("NEAR_DUPLICATE_QUESTION", "a"), ("UNKNOWN_DOCUMENT", "a")]
    assert validate.report(validate.rag_cases(cases, catalog), cases).first() == (False, 5, 3)


def test_near_duplicates_lose_nothing(spark):
    import random
    from difflib import SequenceMatcher

    random.seed(3)
    base = "".join(random.choice("abcdefgh ") for _ in range(60))
    texts = [base]
    for _ in range(40):
        t = list(random.choice(texts))
        for _ in range(random.randint(1, 3)):
            t[random.randrange(len(t))] = random.choice("abcdefgh")
        texts.append("".join(t))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r.earlier, r.later) for r in validate.near_duplicates(rows, "i", "t", "i").collect()}
    flat = [t.replace(" ", "") for t in texts]
    assert got == {(i, j) for i in range(41) for j in range(i + 1, 41) if SequenceMatcher(None, flat[i], flat[j]).ratio() >= 0.95}


def test_judge(spark):
    ok = {"label": "GROUNDED", "confidence": 0.9, "unsupported_claims": [], "reason": "r"}
    cases = [
        ("", "EMPTY_CONTENT"), (" \n", "EMPTY_CONTENT"), ("```json\n{}\n```", "JSON_CODE_FENCE"), ('{"label": ', "TRUNCATED_JSON"), ('[{"label": ', "TRUNCATED_JSON"), ("nonsense}", "INVALID_JSON"), ("[1, }]", "INVALID_JSON"), ("[1]", "PARSE_ERROR_ROOT_NOT_OBJECT"),
        ('"x"', "PARSE_ERROR_ROOT_NOT_OBJECT"), ('{"label": "GROUNDED"}', "SCHEMA_MISSING_FIELD"), (json.dumps(ok | {"label": "X"}), "INVALID_LABEL_ENUM"), (json.dumps(ok | {"label": 3}), "INVALID_LABEL_ENUM"), (json.dumps(ok | {"label": "X", "confidence": 2}), "INVALID_LABEL_ENUM"),
        (json.dumps(ok | {"confidence": 2}), "CONFIDENCE_OUT_OF_RANGE"), (json.dumps(ok | {"confidence": -0.1}), "CONFIDENCE_OUT_OF_RANGE"), (json.dumps(ok | {"confidence": "a"}), "SCHEMA_VALIDATION_ERROR"), (json.dumps(ok | {"confidence": "0.5"}), "VALID_STRUCTURED_OUTPUT"),
        (json.dumps(ok | {"unsupported_claims": "c"}), "UNSUPPORTED_CLAIMS_TYPE_ERROR"), (json.dumps(ok | {"unsupported_claims": [1]}), "UNSUPPORTED_CLAIMS_TYPE_ERROR"), (json.dumps(ok | {"reason": 1}), "UNSUPPORTED_CLAIMS_TYPE_ERROR"), (json.dumps(ok | {"reason": "r" * 301}), "SCHEMA_VALIDATION_ERROR"),
        (json.dumps(ok | {"more": 1}), "SCHEMA_VALIDATION_ERROR"), (json.dumps(ok | {"unsupported_claims": ["c"]}), "LABEL_CLAIM_CONSISTENCY_FAILURE"), (json.dumps(ok | {"label": "HALLUCINATED"}), "LABEL_CLAIM_CONSISTENCY_FAILURE"), (json.dumps(ok), "VALID_STRUCTURED_OUTPUT"),
    ]
    got = [r[0] for r in spark.createDataFrame(cases, "o string, c string").coalesce(1).select(judge.output_category(F.col("o"))).collect()]
    assert got == [c for _, c in cases]
    status = [r[0] for r in spark.createDataFrame(cases, "o string, c string").coalesce(1).select(judge.parse_status(judge.output_category(F.col("o")))).collect()]
    assert status[0] == status[8] == "PARSE_ERROR" and status[9] == "SCHEMA_VALIDATION_ERROR" and status[-1] == "OK"
    texts = spark.createDataFrame([("a & <b>", "it's \"so\"")], "c string, r string")
    assert texts.select(judge.prompt("C {context} R {response} .", F.col("c"), F.col("r"))).first()[0] == "C a &amp; &lt;b&gt; R it's \"so\" ."
    assert judge.prompt_sha256("x") == hashlib.sha256(b"x").hexdigest() and judge.schema_sha256({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    bodies = [{"object": "chat", "model": "m", "choices": [{"finish_reason": "stop", "message": {"content": "OK"}}], "usage": {}}, {"choices": [{"message": {"content": [{"text": "a"}, {"text": "b"}], "reasoning": "hm"}}]}, {"choices": [{"message": {"content": None, "tool_calls": [1]}}]}, {"choices": []}, [1]]
    got = [r[0] for r in spark.createDataFrame([(json.dumps(b),) for b in bodies], "b string").coalesce(1).select(judge.completion(F.col("b"), "OK")).collect()]
    assert [(r.completion_status, r.instruction_adherence_status, r.assistant_content_length, r.reasoning_length, r.tool_calls_present, r.usage_metadata_present) for r in got] == [("PASS", "PASS", 2, 0, False, True), ("PASS", "PARTIAL", 2, 2, False, False), ("PASS", "FAIL", 0, 0, True, False), ("INVALID_RESPONSE", "FAIL", 0, 0, False, False), ("INVALID_RESPONSE", "FAIL", 0, 0, False, False)]
    assert (got[0].finish_reason, got[0].returned_model, got[0].structured_output_status) == ("stop", "m", "NOT_RUN")
    shaped = [{"choices": [{"message": {"content": c}}]} for c in ('{"status": "ok"}', '{"status": "no"}', "ok")]
    got = [r[0] for r in spark.createDataFrame([(json.dumps(b),) for b in shaped], "b string").coalesce(1).select(judge.completion(F.col("b"), "OK", {"status": "ok"})["structured_output_status"]).collect()]
    assert got == ["PASS", "PARSE_FAILED", "PARSE_FAILED"]
    errors = spark.createDataFrame([("bad  api_key: abc, x",), ("Bearer x",), (" ",), ("e" * 300,)], "m string").coalesce(1)
    assert [r[0] for r in errors.select(judge.redacted(F.col("m"))).collect()] == ["bad api_key=[REDACTED], x", "[REDACTED_ERROR_MESSAGE]", None, "e" * 240]
    pairs = spark.createDataFrame([("1", "c", "r"), ("2", "c", "rr")], "example_id string, context string, response string")
    assert {r.example_id: r.predicted for r in judge.evaluate(pairs, lambda ps: [1 / len(r) for _, r in ps], threshold=0.6).collect()} == {"1": "GROUNDED", "2": "HALLUCINATED"}


def test_providers(spark):
    rows = spark.createDataFrame([("p", {"prompt_tokens": 10.0, "input_tokens": 7.0}), ("p", {"promptTokenCount": 3.0})], "provider string, usage map<string,double>")
    assert providers.usage(rows, "provider").first()["input_tokens"] == 10
    rows = spark.createDataFrame([(float(i),) for i in range(1, 8)], "latency_ms double")
    got = providers.latency(rows).first()
    assert (got["p50"], got["p95"], got["count"]) == (4.0, 7.0, 7) and providers.latency(rows.limit(0)).first()["p95"] == 0
    both = [("groq", 0.5, 0.5, 0.1, 1.0, 1.0, 1.0, 0, 1.0), ("gemini", 0.5, 0.5, 0.2, 1.0, 1.0, 1.0, 0, 1.0), ("other", 0.9, 0.9, 0.0, 1.0, 1.0, 1.0, 1, 1.0), ("more", 0.9, 0.9, 0.0, 0.9, 1.0, 1.0, 0, 1.0)]
    frame = spark.createDataFrame(both, "provider string, balanced_accuracy double, f1 double, false_positive_rate double, parse_success_rate double, p95 double, total_tokens double, missing_count long, api_success_rate double")
    assert [r.provider for r in providers.recommend(frame).orderBy("place").collect()] == ["groq", "gemini"]
    assert providers.recommendation(frame).collect() == [("RECOMMENDED", "groq")] and providers.recommendation(frame.where("provider = 'other'")).collect() == [("UNVERIFIED", None)]


def test_http_outcomes(spark):
    rows = spark.createDataFrame([(429, "requests_per_day"), (429, "RequestsPerDay x"), (429, "tokens_per_minute"), (429, "RPM"), (429, "per day"), (200, "rpd")], "s int, e string").coalesce(1)
    assert [r[0] for r in rows.select(providers.rate_limit_dimension(F.col("s"), F.col("e"))).collect()] == ["RPD", "RPD", "TPM", "RPM", "OTHER", None]
    rows = spark.createDataFrame([("5", None), ("5s", "7s"), (None, "2.5"), ("-1", "3 s"), ("x", "y"), ("1e1", None)], "h string, d string").coalesce(1)
    assert [r[0] for r in rows.select(providers.retry_after(F.col("h"), F.col("d"))).collect()] == [5.0, 7.0, 2.5, 3.0, None, 10.0]
    rows = spark.createDataFrame([(504,), (404,), (0,), (418,)], "s int").coalesce(1)
    assert [tuple(r) for r in rows.select(providers.error_class(F.col("s")), providers.health_status(F.col("s"), "completion"), providers.health_status(F.col("s"), "timeout")).collect()] == [
        ("API_TIMEOUT", "NETWORK_FAILED", "NETWORK_FAILED"), ("API_ERROR", "MODEL_UNAVAILABLE", "NETWORK_FAILED"), ("API_ERROR", "NETWORK_FAILED", "NETWORK_FAILED"), ("API_ERROR", "INVALID_RESPONSE", "NETWORK_FAILED")]
    many = spark.createDataFrame([([(None, None), *[(str(i), None) for i in range(10)]],)], "v array<struct<field: string, description: string>>")
    assert [x.field for x in many.select(providers.field_violations(F.col("v"))).first()[0]] == [str(i) for i in range(8)]
    log = spark.createDataFrame([("p", i, "API_RATE_LIMIT" if i != 2 else None, "RPD" if i == 4 else "RPM") for i in range(6)], "who string, i int, error_class string, rate_limit_dimension string").withColumn("ts", F.timestamp_seconds("i"))
    assert [(r.streak, r.open) for r in providers.streaks(log, "who", ["i"]).orderBy("i").collect()] == [(1, False), (2, False), (0, False), (1, False), (2, True), (3, True)]


def test_retries_budgets_and_projections(spark):
    log = spark.createDataFrame([("e", i, c) for i, c in enumerate(["API_TIMEOUT", "LOCAL_TIMEOUT", "API_RATE_LIMIT"])] + [("f", 0, "API_AUTH_ERROR"), ("g", 0, None)], "example_id string, attempt int, error_class string")
    got = {(r.example_id, r.attempt): r.delay_seconds for r in providers.retry_plan(log, ["example_id"], ["attempt"]).collect()}
    assert got == {("e", 0): 0.1, ("e", 1): 0.2, ("e", 2): None, ("f", 0): None, ("g", 0): None}
    pending = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "position int, pending boolean")
    assert [r.position for r in providers.within_budget(pending, 5, 2).collect()] == [0, 2, 4] and providers.within_budget(pending, 2, 5).count() == 0
    rows = spark.createDataFrame([("e", "secret text", 3.0, "API_ERROR")], "example_id string, content string, latency_ms double, error_class string")
    assert providers.safe_projection(rows, ["example_id"]).columns == ["example_id", "latency_ms", "error_class"]
    items = spark.createDataFrame([("c", "a", "b", True, ["PASS"]), ("d", "a", "b", False, ["REGRESSION", "MISSING", "REGRESSION"]), ("e", "a", "b", False, ["MISSING"])], "artifact_id string, baseline_id string, candidate_id string, passed boolean, statuses array<string>")
    items = items.withColumns({c: F.lit("x") for c in ("verification_status", "data_kind", "claim_scope", "population_compatibility")})
    assert [(r.result, r.regression_count) for r in evidence.comparison_items(items).orderBy("artifact_id").collect()] == [("PASS", 0), ("REGRESSION", 2), (None, 0)]


def test_readiness_and_diversity(spark):
    ddl = "provider string, api_success_count long, parse_success_count long, provider_family string"
    ready = lambda *rows: tuple(validate.readiness(spark.createDataFrame(rows, ddl)).first())
    assert ready(("a", 5, 5, "x"), ("b", 5, 4, "y")) == (True, False, ["a"], ["b"], ["x"])
    assert ready(("a", 5, 5, "x"), ("b", 5, 5, "x")) == (True, False, ["a", "b"], [], ["x", "x"])
    assert ready(("a", 5, 5, None), ("b", 5, 5, "")) == (True, True, ["a", "b"], [], ["a", "b"])
    assert ready(("a", 0, 0, "x"), ("b", None, None, "y")) == (False, False, [], ["a", "b"], [])
    ddl = "provider string, backend_provider string, selected_model string, returned_model string, benchmark_eligible boolean, completion_status string"
    paths = lambda *rows: tuple(validate.diversity(spark.createDataFrame(rows, ddl)).first())
    assert paths(("x", None, "m", None, True, "PASS"), ("y", None, "m", None, True, "PASS")) == (False, 2)
    assert paths(("Gemini", None, "m", None, True, "PASS"), ("y", None, None, "n", True, "PASS")) == (True, 2)
    assert paths(("gemini", None, "m", None, True, "PASS"), ("y", "GEMINI", "m", None, True, "PASS")) == (False, 1)
    assert paths(("gemini", None, "m", None, False, "PASS"), ("y", None, "m", None, True, "FAIL")) == (False, 0)


def test_compatibility_allows_other_retrievers(spark):
    fields = {f: "same" for f in population.RUN_FIELDS} | {"top_k": 5, "schema_version": "v", "workspace_id": "w", "evaluation_type": "retrieval", "retriever": "bm25", "identity_valid": True, "truth_fingerprint": "t", "query_fingerprint": "q", "prediction_fingerprint": "q", "prediction_count": 2, "reported_count": 2}
    runs = [fields | {"run_id": "a"}, fields | {"run_id": "b", "retriever": "dense"}, fields | {"run_id": "c", "top_k": 10, "language": None, "prediction_fingerprint": "p"}, fields | {"run_id": "d", "truth_fingerprint": None, "query_fingerprint": None}]
    ddl = ", ".join(f"{c} {'boolean' if c == 'identity_valid' else 'int' if c == 'top_k' or c.endswith('count') else 'string'}" for c in runs[0])
    runs = spark.createDataFrame([tuple(r[c] for c in runs[0]) for r in runs], ddl)
    pairs = spark.createDataFrame([("ab", "a", "b"), ("ac", "a", "c"), ("ad", "a", "d")], "comparison_id string, baseline_id string, candidate_id string")
    found = population.compatibility(pairs, runs)
    assert sorted(found.collect()) == [("ac", "candidate_prediction_coverage", "missing", "different"), ("ac", "language", "present", "missing"), ("ac", "top_k", "5", "10"), ("ad", "verified_population", "present", "missing")]
    assert sorted(population.status(pairs, found).collect()) == [("ab", "COMPARABLE", 0), ("ac", "NON_COMPARABLE", 3), ("ad", "NON_COMPARABLE", 1)]


def test_jobs(spark):
    log = spark.createDataFrame([("j", "r", 0, "QUEUED", False, 1), ("j", "r", 1, "COMPLETE", False, 1), ("j", "r", 3, "FAILED", False, 1), ("k", "r", 0, "QUEUED", True, 2), ("k", "r", 1, "QUEUED", False, 2)], "job_id string, run_id string, revision long, state string, cancel_requested boolean, created_at long")
    moves = [("QUEUED", "FAILED"), ("WRITING_ARTIFACT", "CANCELLED"), ("QUEUED", "INTERRUPTED"), ("VALIDATING", "INTERRUPTED"), ("QUEUED", "EVALUATING")]
    steps = spark.createDataFrame([(f"{a}>{b}", i, s, False) for a, b in moves for i, s in enumerate((a, b))], "job_id string, revision long, state string, cancel_requested boolean")
    assert sorted(r.job_id for r in jobs.fsm_violations(steps).where("code = 'ILLEGAL_TRANSITION'").collect()) == ["QUEUED>EVALUATING", "QUEUED>INTERRUPTED"]
    assert sorted(jobs.fsm_violations(log).collect()) == [("j", 1, "ILLEGAL_TRANSITION"), ("j", 3, "STALE_REVISION"), ("j", 3, "TERMINAL"), ("k", 1, "CANCEL_WITHDRAWN")]
    assert jobs.latest_per_run(log).collect() == [("r", "k", "QUEUED")]
    assert jobs.recovery(log).collect() == [("k", "REQUEUE")]


def test_evidence_text(spark):
    texts = ["fine text", "api_key=abc", "/home/me/x", "a\x01b", "the secret garden", "secret", "a password : x", "C:\\x", " ", "x" * 501, "see /home/me"]
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "i int, t string")
    assert {r.i: r.code for r in evidence.text_violations(rows, "i", ["t"]).collect()} == {2: "UNSAFE_TEXT", 3: "UNSAFE_TEXT", 4: "CONTROL_CHARACTER", 6: "UNSAFE_TEXT", 7: "UNSAFE_TEXT", 8: "UNSAFE_TEXT", 9: "EMPTY_TEXT", 10: "TEXT_TOO_LONG"}
    names = spark.createDataFrame([("run-1",), ("a/b",), ("..",), ("token",), (" ",), ("a b",), ("a\\b",)], "n string").coalesce(1)
    assert [r[0] for r in names.select(evidence.safe_identifier(F.col("n"))).collect()] == [True, False, False, False, False, True, False]


def test_case_categories(spark):
    names = ["ambiguous_query", "numeric_reasoning", "citation_sensitive", "adversarial_noise", "paraphrase", "numerical", None]
    rows = spark.createDataFrame([(i, str(i), f"Question number {i * 7919} of {i * i}?", "x", [], c, "easy") for i, c in enumerate(names)], "line long, id string, question string, ground_truth string, relevant_document_ids array<string>, category string, difficulty string")
    found = validate.rag_cases(rows, spark.createDataFrame([], "document_id string")).where("code = 'INVALID_CATEGORY'").collect()
    assert sorted(r.record_id for r in found) == ["4", "5", "6"]


def test_benchmarks(spark):
    from gradus.operators import benchmarks

    topics = spark.createDataFrame([("q1", "red fox"), ("q2", "blue sea"), ("q3", "nothing here")], "query_id string, text string")
    corpus = spark.createDataFrame([("d1", "the red fox"), ("d2", "a blue sky"), ("d3", "deep sea")], "document_id string, text string")
    qrels = spark.createDataFrame([("q1", "d1", 1), ("q2", "d1", 1)], "query_id string, document_id string, relevance long")
    parts = benchmarks.retrieval_benchmark(topics, qrels, corpus, 3)
    assert benchmarks.metric_ks(3) == (1, 3) and benchmarks.metric_ks(20) == (1, 5, 10, 20)
    assert parts["issues"].count() == 0 and parts["counts"].collect() == [(3, 3, 2)]
    assert sorted(parts["failures"].collect()) == [("q2", "RETRIEVAL_MISS"), ("q3", "SHOULD_ABSTAIN")] and parts["failure_counts"].collect() == [(3, 1, 1, 1)]
    assert benchmarks.retrieval_benchmark(topics, qrels, corpus.where("document_id <> 'd1'"), 3)["issues"].count() == 2
    names = spark.createDataFrame([("test-a",), ("testB",), ("DEV",), ("other",)], "n string").coalesce(1)
    assert [r[0] for r in names.select(benchmarks.split_alias(F.col("n"))).collect()] == ["testA", "testB", "dev", None]
    rows = spark.createDataFrame([("1", "good", "QA", "m", "GROUNDED"), ("2", "good", "QA", None, "HALLUCINATED"), ("3", "truncated", "QA", "m", "GROUNDED")], "example_id string, quality string, task_type string, model string, human string")
    said = spark.createDataFrame([("1", "HALLUCINATED", 0.9), ("2", "GROUNDED", 0.1)], "example_id string, predicted string, score double")
    found = spark.createDataFrame([("END_OUT_OF_RANGE", "3")], "code string, record_id string")
    parts = benchmarks.groundedness_benchmark(rows, said, found)
    assert parts["counts"].collect() == [(3, 2, 1)] and parts["exclusion_reasons"].collect() == [("quality:truncated", 1)] and parts["mismatched"].count() == 0
    assert [(r.section, r.category, r.record_id, r.code) for r in parts["failures"].collect()] == [(1, "HALLUCINATION_FALSE_POSITIVE", "1", None), (2, "HALLUCINATION_FALSE_NEGATIVE", "2", None), (3, "DATASET_AMBIGUOUS", "3", "END_OUT_OF_RANGE")]
    assert benchmarks.groundedness_benchmark(rows, said, found, qualities=["good", "truncated"])["mismatched"].collect() == [("MISSING_PREDICTION", "3")]


def test_job_stream(spark, tmp_path):
    from gradus.streaming import jobs as stream

    rows = [("a", 0, "QUEUED"), ("a", 1, "VALIDATING"), ("a", 1, "VALIDATING"), ("a", 2, "FAILED"), ("a", 3, "COMPLETE"), ("b", 5, "QUEUED")]
    spark.createDataFrame(rows, stream.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(stream.SCHEMA).parquet(str(tmp_path / "in"))
    q = stream.rising_revisions(source).writeStream.format("memory").queryName("rising").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.sql("select job_id, revision from rising").collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 5)]
