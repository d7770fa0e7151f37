"""Record schemas of the evaluation data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_IDS, _MAP, _NUMBERS = T.ArrayType(_S), T.MapType(_S, _S), T.MapType(_S, _D)

RAG_CASE = _struct(id=_S, question=_S, ground_truth=_S, relevant_document_ids=_IDS, acceptable_answers=_IDS, category=_S, difficulty=_S, requires_abstention=_B, metadata=_MAP)
ISSUE = _struct(code=_S, message=_S, record_id=_S)
QUERY = _struct(query_id=_S, text=_S)
DOCUMENT = _struct(document_id=_S, title=_S, text=_S)
QREL = _struct(query_id=_S, document_id=_S, relevance=_L)
GROUND_TRUTH = _struct(query_id=_S, relevant_document_ids=_IDS)
PREDICTION = _struct(query_id=_S, retrieved_document_ids=_IDS, scores=T.ArrayType(_D))
SPAN = _struct(start=_L, end=_L, text=_S, meta=_S, label_type=_S, due_to_null=_B, implicit_true=_B)
RESPONSE = _struct(id=_S, source_id=_S, model=_S, temperature=_D, split=_S, quality=_S, response=_S, labels=T.ArrayType(SPAN))
SOURCE = _struct(source_id=_S, task_type=_S, source=_S, prompt=_S, source_info=_S)
CLASSIFICATION = _struct(evaluator=_S, example_id=_S, predicted=_S, score=_D, support=_D, input_length=_L, truncated=_B, context_strategy=_S, config=_MAP)
RUN_CONFIG = _struct(
    run_id=_S, dataset_name=_S, dataset_version=_S, system_name=_S, model=_S, model_provider=_S, prompt_version=_S, retriever=_S, embedding_model=_S, top_k=_L, evaluator_versions=_MAP, random_seed=_L, timestamp=_TS, git_commit=_S, benchmark=_S,
    language=_S, split=_S, dataset_revision=_S, corpus_revision=_S, tokenization_strategy=_S, retriever_version=_S, retriever_config=_MAP, annotation_policy=_S, quality_filter=_IDS, evaluator_config=_MAP
)
METRIC = _struct(run_id=_S, metric=_S, value=_D)
FAILURE = _struct(run_id=_S, record_id=_S, category=_S, failure_class=_S, evidence=_MAP)
RULE = _struct(metric=_S, direction=_S, minimum_acceptable=_D, maximum_acceptable=_D, max_degradation=_D)
ATTEMPT = _struct(provider=_S, example_id=_S, attempt=_L, status=_S, api_success=_B, parse_success=_B, label=_S, confidence=_D, latency_ms=_D, error_class=_S, usage=_NUMBERS, updated_at=_TS)
MANIFEST = _struct(example_id=_S, source_id=_S, task_type=_S, human_label=_S, stratum=_S)
DECISION = _struct(label=_S, confidence=_D, unsupported_claims=_IDS, reason=_S)
JOB = _struct(job_id=_S, workspace_id=_S, run_id=_S, state=_S, revision=_L, cancel_requested=_B, safe_error=_struct(code=_S, message=_S), created_at=_TS, updated_at=_TS)
ARTIFACT = _struct(artifact_id=_S, artifact_type=_S, schema_version=_S, verification_status=_S, data_kind=_S, claim_scope=_S, created_at=_TS, limitations=_IDS, metrics=_NUMBERS, baseline_id=_S, candidate_id=_S)
MODEL = _struct(model_id=_S, name=_S, quota=_L, modality=_S, supported_parameters=_IDS)
