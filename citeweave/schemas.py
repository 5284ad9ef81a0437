"""Closed record schemas as DDL, one per table the engine reads or writes."""

from __future__ import annotations

PAGE = (
    "page_id STRING, document_id BIGINT, page_number BIGINT, text STRING, character_count BIGINT, "
    "extraction_status STRING, source_path STRING, source_url STRING, citation_url STRING, document_sha256 STRING"
)
CHUNK = (
    "chunk_id STRING, document_id BIGINT, chunk_index BIGINT, page_start BIGINT, page_end BIGINT, "
    "page_ids ARRAY<STRING>, text STRING, word_count BIGINT, character_count BIGINT, token_estimate BIGINT, "
    "citation_url STRING, source_url STRING, document_sha256 STRING"
)
CHUNKING_RECEIPT = (
    "document_id BIGINT, page_count BIGINT, nonempty_page_count BIGINT, total_words BIGINT, chunk_count BIGINT"
)
DOWNLOAD_RECEIPT = (
    "document_id BIGINT, source_url STRING, local_path STRING, sha256 STRING, size_bytes BIGINT, status STRING, "
    "error STRING"
)
EXTRACTION_RECEIPT = (
    "document_id BIGINT, source_path STRING, document_sha256 STRING, page_count BIGINT, nonempty_page_count BIGINT, "
    "status STRING, error STRING"
)
MANIFEST_ENTRY = (
    "document_id BIGINT, title STRING, abstract STRING, citation_url STRING, pdf_url STRING, fulltext_url STRING, "
    "downloads_available BOOLEAN, keywords ARRAY<STRING>, subject_categories ARRAY<STRING>, sti_type STRING, "
    "distribution STRING, disseminated STRING, source_queries ARRAY<STRING>"
)
QUERY = "query_id STRING, query STRING"
JUDGMENT = "query_id STRING, relevant_chunk_ids ARRAY<STRING>"
GENERATION_QUERY = "query_id STRING, query STRING, expected_answerable BOOLEAN, expected_terms ARRAY<STRING>"
CONCEPT_ANNOTATION = (
    "query_id STRING, expected_concepts ARRAY<STRUCT<concept_id: STRING, canonical_text: STRING, "
    "accepted_phrases: ARRAY<STRING>>>"
)
ANNOTATION_POOL = (
    "query_id STRING, query STRING, candidates ARRAY<STRUCT<candidate_id: STRING, chunk_id: STRING, "
    "document_id: BIGINT, page_start: BIGINT, page_end: BIGINT, text_preview: STRING, citation_url: STRING, "
    "source_url: STRING, relevant: BOOLEAN>>"
)
TRAINING_EXAMPLE = (
    "example_id STRING, query STRING, max_claims BIGINT, evidence ARRAY<STRUCT<evidence_id: STRING, chunk_id: STRING, "
    "document_id: BIGINT, page_start: BIGINT, page_end: BIGINT, text: STRING>>, response STRUCT<answer: STRING, "
    "claims: ARRAY<STRUCT<text: STRING, evidence_ids: ARRAY<STRING>>>, insufficient_evidence: BOOLEAN>"
)
VISUAL_ASSET = (
    "asset_id STRING, document_id BIGINT, page_id STRING, page_number BIGINT, asset_type STRING, asset_index BIGINT, "
    "caption_text STRING, source_path STRING, source_url STRING, citation_url STRING, document_sha256 STRING"
)
ANNOTATION_TASK = "task_id STRING, task_version STRING, task_kind STRING, " + VISUAL_ASSET
ANNOTATION_RESPONSE = "task_id STRING, annotator_id STRING, decision STRING, notes STRING"
PLAN_RECEIPT = (
    "plan_id STRING, example_type STRING, status STRING, example_id STRING, question_attempts BIGINT, "
    "verification_attempts BIGINT, answer_attempts BIGINT, input_tokens BIGINT, output_tokens BIGINT, "
    "total_tokens BIGINT, estimated_cost_usd DOUBLE, telemetry_complete BOOLEAN, rejection_reason STRING"
)
PAGE_RENDER = "page_id STRING, document_id BIGINT, page_number BIGINT, png_path STRING, dpi BIGINT"
CHECKPOINT = "thread_id STRING, sequence BIGINT, state STRING"
