"""The metrics that quality is declared by: thresholds, weights and what to do when they fail."""

from __future__ import annotations

#: metric, comparison, target, warning, failure, severity, least samples, repair; - for none. Fixed values.
METRICS = """
    analytics.reconciliation_errors eq 0 - 0 HARD_FAIL 0 manual_investigation
    analytics.tenant_contamination eq 0 - 0 CRITICAL 0 manual_investigation
    analytics.duplicate_events eq 0 - 0 HARD_FAIL 0 manual_investigation
    answer.citation_validity gte 1 - 1 HARD_FAIL 1 invalidate_retrieval_cache
    answer.quote_fidelity gte 1 - 1 HARD_FAIL 1 invalidate_retrieval_cache
    answer.numeric_consistency gte 1 - 1 HARD_FAIL 1 manual_investigation
    answer.unsupported_claim_rate lte 0 0.05 0.15 HARD_FAIL 5 manual_investigation
    answer.false_answer_rate lte 0 0.02 0.1 HARD_FAIL 5 manual_investigation
    answer.false_refusal_rate lte 0 0.05 0.15 WARNING 5 manual_investigation
    billing.quota_reconciliation_errors eq 0 - 0 HARD_FAIL 0 manual_investigation
    billing.historical_usage_mutations eq 0 - 0 CRITICAL 0 manual_investigation
    billing.stripe_discrepancies lte 0 0 3 WARNING 0 requeue_job
    billing.webhook_replay_side_effects eq 0 - 0 CRITICAL 0 manual_investigation
    billing.cost_reconciliation_error_usd lte 0 1e-06 0.01 HARD_FAIL 0 manual_investigation
    billing.cost_per_question_usd lte 0.00162 0.00243 0.00405 WARNING 20 manual_investigation
    ingestion.upload_hash_match eq 1 - 1 CRITICAL 0 restore_from_source
    ingestion.structural_fidelity gte 1 1 0.995 HARD_FAIL 1 retry_extraction
    ingestion.preview_page_parity gte 1 1 1 HARD_FAIL 1 regenerate_preview
    ingestion.index_coverage gte 1 0.999 0.995 HARD_FAIL 1 reindex_file
    ingestion.embedding_completeness gte 1 1 0.99 HARD_FAIL 1 reembed_missing
    ingestion.vision_read_confidence gte 0.9 0.75 0.55 WARNING 1 retry_vision_read
    ingestion.success_rate gte 1 0.98 0.95 WARNING 20 requeue_job
    performance.retrieval_latency_p95_ms lte 400 800 2000 WARNING 20 manual_investigation
    performance.answer_latency_p95_ms lte 4000 6000 12000 WARNING 20 manual_investigation
    performance.job_success_rate gte 1 0.98 0.9 WARNING 20 requeue_job
    performance.stuck_jobs lte 0 0 5 WARNING 0 requeue_job
    performance.worker_liveness eq 1 - 1 CRITICAL 0 manual_investigation
    retrieval.recall_at_5 gte 1 0.98 0.95 HARD_FAIL 10 manual_investigation
    retrieval.recall_at_1 gte 0.9 0.8 0.65 WARNING 10 manual_investigation
    retrieval.precision_at_5 gte 0.6 0.4 0.2 WARNING 10 manual_investigation
    retrieval.mrr gte 0.9 0.75 0.6 WARNING 10 manual_investigation
    retrieval.ndcg_at_5 gte 0.9 0.8 0.65 WARNING 10 manual_investigation
    retrieval.regression_delta_recall_at_5 gte 0 -0.01 -0.03 HARD_FAIL 10 manual_investigation
    security.cross_tenant_leaks eq 0 - 0 CRITICAL 0 manual_investigation
    security.idor_failures eq 0 - 0 CRITICAL 0 manual_investigation
    security.revocation_enforcement_ms lte 500 1000 2000 CRITICAL 0 manual_investigation
    security.expiration_enforcement_ms lte 250 500 1000 HARD_FAIL 0 manual_investigation
    security.download_disabled_exposure eq 0 - 0 CRITICAL 0 manual_investigation
    security.signed_url_lifetime_seconds lte 120 300 900 HARD_FAIL 0 regenerate_signed_url
    security.prompt_injection_success_rate lte 0 - 0 CRITICAL 1 manual_investigation
    security.source_reconstruction_ratio lte 0.02 0.05 0.15 HARD_FAIL 1 manual_investigation
    security.brute_force_blocked eq 1 - 1 HARD_FAIL 0 manual_investigation
    security.plaintext_secret_exposure eq 0 - 0 CRITICAL 0 manual_investigation
    security.response_header_violations eq 0 - 0 HARD_FAIL 0 manual_investigation
    security.share_link_indexable eq 0 - 0 HARD_FAIL 0 manual_investigation
    storage.missing_objects eq 0 - 0 CRITICAL 0 restore_from_source
    storage.size_mismatches eq 0 - 0 CRITICAL 0 restore_from_source
    storage.hash_mismatches eq 0 - 0 CRITICAL 0 manual_investigation
    storage.orphan_database_rows eq 0 - 0 HARD_FAIL 0 manual_investigation
    storage.orphan_objects lte 0 0 50 WARNING 0 requeue_job
    storage.durability_roundtrip eq 1 - 1 CRITICAL 0 manual_investigation
    viewer.preview_fidelity gte 0.99 0.95 0.9 HARD_FAIL 1 regenerate_preview
    viewer.preview_text_consistency gte 0.98 0.95 0.85 HARD_FAIL 1 alternate_conversion
    viewer.geometry_deviation lte 0.005 0.01 0.02 HARD_FAIL 1 regenerate_preview
    viewer.page_order_inversions eq 0 - 0 HARD_FAIL 1 regenerate_preview
    viewer.lcp_ms lte 2500 2500 4000 WARNING 20 manual_investigation
    viewer.inp_ms lte 200 200 500 WARNING 20 manual_investigation
    viewer.cls lte 0.1 0.1 0.25 WARNING 20 manual_investigation
    viewer.first_page_ms lte 1500 2500 5000 WARNING 10 manual_investigation
    viewer.accessibility_critical_violations eq 0 - 0 HARD_FAIL 0 manual_investigation
"""

Metric = tuple[str, str, float, float | None, float, str, int, str]


def metrics() -> list[Metric]:
    rows = (line.split() for line in METRICS.split("\n") if line.strip())
    return [(name, how, float(target), None if warning == "-" else float(warning), float(failure), severity, int(least), repair) for name, how, target, warning, failure, severity, least, repair in rows]
