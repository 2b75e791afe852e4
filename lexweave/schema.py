"""Explicit schemas of the engine's tables and the closed domains of their fields (sections 1.2 and 1.3 of the survey)."""

from __future__ import annotations

SCHEMA_VERSION = 9

SCHEMAS = {
    "data_sources": "id string, provider string, name string, base_url string, enabled boolean, created_at timestamp",
    "sync_runs": "id string, source_id string, query string, status string, fetched_count int, changed_count int, error_code string, started_at timestamp, completed_at timestamp",
    "source_documents": "id string, source_id string, sync_run_id string, external_id string, raw_hash string, raw_payload string, fetched_at timestamp",
    "precedents": "id string, provider string, provider_record_id string, court string, case_number string, case_name string, decision_date date, official_url string, source_text string, "
    "source_hash string, collected_at timestamp, verified_at timestamp, link_checked_at timestamp, link_status int, searchable boolean, embedding array<float>, embedding_model string, "
    "embedding_input_hash string, embedding_source_hash string, embedded_at timestamp",
    "precedent_sources": "precedent_id string, source_document_id string, official_url string, is_primary boolean, verified_at timestamp",
    "precedent_paragraphs": "precedent_id string, paragraph_id string, ordinal int, body string",
    "source_rights": "provider string, storage_allowed boolean, indexing_allowed boolean, summary_allowed boolean, display_allowed boolean, redistribution_allowed boolean, terms_version string, "
    "evidence_document_id string, reviewed_at timestamp",
    "verification_reviews": "precedent_id string, status string, metadata_match boolean, content_match boolean, link_status int, error_code string, reviewed_at timestamp",
    "precedent_fact_tags": "precedent_id string, extraction_version string, medium string, message_form string, recipient_identification string, reached_recipient string, relationship string, "
    "context string, expression_type string, repetition string, additional_channels array<string>, issue_tags array<string>, evidence struct<method:string,knownFields:array<string>,paragraphIds:array<string>>, extracted_at timestamp",
    "precedent_summaries": "precedent_id string, source_hash string, summary_version string, model string, sentences array<struct<text:string,paragraphIds:array<string>>>, generated_at timestamp",
    "intake_sessions": "id string, role string, redacted_text string, facts string, questions array<struct<id:string,field:string,prompt:string>>, answers map<string,string>, created_at timestamp, expires_at timestamp",
    "precedent_dispositions": "precedent_id string, extraction_version string, order_text string, paragraph_ids array<string>, kind string, extracted_at timestamp",
    "statutes": "law_id string, article_no string, law_name string, article_title string, body string, enforced_on date, official_url string",
}

# The closed domains.
DOMAINS = {
    "medium": ["unknown", "bank_transfer", "kakao", "game_chat", "sns_mention", "direct_delivery", "digital_message"],
    "message_form": ["text", "image"],
    "recipient_identification": ["unknown", "mention", "bank_account", "public_post", "direct_account"],
    "reached_recipient": ["unknown", "yes", "no"],
    "relationship": ["unknown", "partner_or_ex", "game_user", "neighbor", "acquaintance", "online_user", "stranger"],
    "context": ["unknown", "conflict", "sexual_conversation", "one_sided"],
    "expression_type": ["other", "sexual_image", "insult_with_sexual_terms", "sexual_text"],
    "repetition": ["unknown", "once", "repeated"],
}
ORDER_KINDS = ["remand", "final_appeal_dismissed", "appeal_dismissed", "acquitted", "sentenced", "reversed_and_sentenced", "multiple", "civil", "other"]
KEYS = {
    "data_sources": [["id"], ["provider"]],
    "source_documents": [["source_id", "external_id", "raw_hash"]],
    "precedents": [["provider", "provider_record_id"], ["court", "case_number", "decision_date"]],
    "precedent_sources": [["precedent_id", "source_document_id"]],
    "precedent_paragraphs": [["precedent_id", "paragraph_id"], ["precedent_id", "ordinal"]],
    "precedent_fact_tags": [["precedent_id"]],
    "precedent_summaries": [["precedent_id"]],
    "precedent_dispositions": [["precedent_id"]],
    "source_rights": [["provider"]],
    "intake_sessions": [["id"]],
    "statutes": [["law_id", "article_no"]],
}
