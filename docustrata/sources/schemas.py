"""Explicit schemas of the domain tables, as Spark DDL."""

from __future__ import annotations

SCHEMAS = {
    "documents": "document_id string, normalized_code string, display_code string, document_type string, title string, status_normalized string, current_version_id string, created_at timestamp",
    "document_versions": "version_id string, document_id string, edition_label string, source_status_raw string, status_normalized string, text_actualized_at date, published_at date, effective_from date, is_active boolean, is_outdated boolean, content_hash string, parse_confidence double, has_ocr boolean, processing_status string, created_at timestamp",
    "document_sources": "version_id string, document_id string, seed_url string, list_page_url string, card_url string, html_url string, pdf_url string, print_url string, source_type string, seen_at timestamp",
    "raw_artifacts": "version_id string, artifact_type string, relative_path string, mime_type string, file_size bigint, checksum_sha256 string",
    "document_nodes": "id string, version_id string, order_index int, parent_node_id string, node_type string, label string, title string, text string, locator_raw string, locator_normalized string, heading_path string, page_from int, page_to int, char_start bigint, char_end bigint, parse_confidence double, embedding array<float>, created_at timestamp",
    "document_references": "id string, version_id string, source_node_id string, source_order_index int, reference_text string, referenced_code_normalized string, matched_document_id string, match_confidence double, created_at timestamp",
    "document_aliases": "alias_id string, document_id string, alias_raw string, alias_normalized string, alias_type string, confidence double, created_at timestamp",
    "retrieval_units": "unit_id string, version_id string, unit_type string, anchor_order_index int, start_order_index int, end_order_index int, heading_path string, locator_primary string, text string, embedding array<float>, chunk_hash string, created_at timestamp",
    "ingestion_jobs": "job_id string, job_type string, payload string, status string, attempt_count int, max_attempts int, scheduled_at timestamp, started_at timestamp, finished_at timestamp, last_error string, created_at timestamp",
    "update_events": "document_id string, old_version_id string, new_version_id string, update_reason string, status string, details string, created_at timestamp",
    "eval_questions": "id string, query string, scenario string, expected_mode string, expected_documents array<string>, expected_locators array<string>, require_exact_edition boolean, must_not_use_documents array<string>",
}
