"""Row types and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.budget import MAX_BUDGET
from tallyweave.functions.text import strip

_TEXTS = "ARRAY<STRING>"
AGENDA_ITEM = (
    f"id STRING, source_item_id STRING, title STRING, name STRING, description STRING, summary STRING, category STRING, priority STRING, timeline STRING, updatedOn STRING, language STRING, active BOOLEAN, "
    f"problem STRUCT<short: STRING, long: STRING>, solution STRUCT<short: {_TEXTS}, long: STRUCT<phases: ARRAY<STRUCT<phase: STRING, title: STRING, items: {_TEXTS}>>>>, "
    f"implementation STRUCT<short: {_TEXTS}, long: ARRAY<STRUCT<timeline: STRING, description: STRING, details: {_TEXTS}>>>, "
    f"realWorldEvidence STRUCT<short: {_TEXTS}, long: ARRAY<STRUCT<country: STRING, details: STRING, impact: STRING>>>, real_world_evidence STRUCT<short: {_TEXTS}, long: ARRAY<STRUCT<country: STRING, details: STRING, impact: STRING>>>, "
    f"performanceTargets {_TEXTS}, performance_targets {_TEXTS}, legalFoundation STRING, legal_foundation STRING"
)
AGENDA = (
    f"owner_name STRING, organization STRING, language STRING, version STRING, name STRING, effective_from STRING, published_at STRING, status STRING, source_reference STRING, "
    f"manifesto_document_id STRING, agenda_version_id STRING, items ARRAY<STRUCT<{AGENDA_ITEM}>>, agenda_items ARRAY<STRUCT<{AGENDA_ITEM}>>"
)
PROMISE_CSV = "Category STRING, Specific_Promise STRING, Target_Deadline STRING, Responsible_Entity STRING"
EVENT = "event_type STRING, title STRING, amount DOUBLE, currency STRING, event_date STRING, body_id STRING, body_name STRING, body_level STRING, reference_code STRING, notes STRING, reviewer_status STRING, placeholder BOOLEAN"
_FLOW = (
    "allocation_title STRING, amount DOUBLE, currency STRING, budget_class STRING, sector STRING, subsector STRING, fiscal_year STRING, source_page INT, source_excerpt STRING, extraction_confidence DOUBLE, "
    "reviewer_status STRING, placeholder BOOLEAN, project_id STRING, allocation_code STRING, allocation_type STRING, implementing_body_id STRING, implementing_body_name STRING, implementing_body_level STRING, source_reference_override STRING, "
    + ", ".join(f"{k}_events ARRAY<STRUCT<{EVENT}>>" for k in ("release", "transfer", "receipt"))
)
FLOW_BUNDLE = f"source_reference STRING, source_subtype STRING, extraction_mode STRING, reviewed_budget_flow_status STRING, reviewed_budget_flows ARRAY<STRUCT<{_FLOW}>>"
_PROMISE = "title STRING, summary STRING, category STRING, timeline STRING, responsible_entity STRING, language STRING, source_page INT, source_excerpt STRING, extraction_confidence DOUBLE, reviewer_status STRING, placeholder BOOLEAN"
PROMISE_BUNDLE = f"manifesto_document_id STRING, source_reference STRING, source_subtype STRING, extraction_mode STRING, ocr_artifact_reference STRING, ocr_text_review_status STRING, structured_promises_status STRING, reviewed_structured_promises ARRAY<STRUCT<{_PROMISE}>>"
_ALIGNMENT = "agenda_item_id STRING, political_promise_id STRING, relation_type STRING, confidence DOUBLE, approval_state STRING, notes STRING, reviewer_status STRING, placeholder BOOLEAN"
ALIGNMENT_BUNDLE = f"source_subtype STRING, extraction_mode STRING, reviewed_alignment_status STRING, reviewed_alignment_assessments ARRAY<STRUCT<{_ALIGNMENT}>>"
RELATION = "relation_type STRING, src_type STRING, src_key STRING, src_id STRING, dst_type STRING, dst_key STRING, dst_id STRING, dst_props MAP<STRING, STRING>, rel_props MAP<STRING, STRING>, require_existing BOOLEAN"
RECORD = (
    f"entity_type STRING, record_identity STRING, confidence DOUBLE, risk_flags {_TEXTS}, node_key STRING, node_id STRING, properties MAP<STRING, STRING>, relations ARRAY<STRUCT<{RELATION}>>, raw_payload STRING, review_context STRING, "
    "source_type STRING, source_subtype STRING, source_document STRING, source_path STRING, source_hash STRING"
)
NODES = "label STRING, key STRING, id STRING, props MAP<STRING, STRING>"
EDGES = "src_type STRING, src_key STRING, src_id STRING, rel_type STRING, dst_type STRING, dst_key STRING, dst_id STRING, props MAP<STRING, STRING>"
JOBS = "id STRING, name STRING, status STRING, priority INT, source_count LONG, processed_count LONG, published_count LONG, held_count LONG, failed_count LONG, options STRING, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP"
DOCUMENTS = (
    "id STRING, job_id STRING, source_path STRING, source_document STRING, source_hash STRING, source_type STRING, source_tier STRING, destination STRING, gov_level STRING, province_name STRING, fiscal_year STRING, status STRING, "
    "plan_strategy STRING, plan_confidence DOUBLE, requires_ocr BOOLEAN, requires_vision BOOLEAN, extracted_count LONG, published_count LONG, held_count LONG, attempt_count INT, extra_metadata STRING"
)
REVIEWS = "id STRING, job_id STRING, document_id STRING, status STRING, reason STRING, risk_level STRING, confidence DOUBLE, entity_type STRING, record_key STRING, fingerprint STRING, proposed_payload STRING, provenance STRING, reviewer STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
FAILED = "id STRING, source_type STRING, source_path STRING, source_hash STRING, stage STRING, failure_reason STRING, failure_detail STRING, status STRING, retry_count INT"


def _long(c: str, n: int) -> Column:
    return F.length(strip(F.coalesce(F.col(c), F.lit("")))) >= n


def _unit(c: str) -> Column:
    return F.coalesce(F.col(c).between(0, 1), F.lit(False))


def contracts() -> dict[str, dict[str, Column]]:
    """For each contract its rules, by the name of the error that a row gets that breaks one."""
    amount = F.coalesce(F.col("amount") >= 0, F.lit(False))
    page = F.coalesce(F.col("source_page") >= 1, F.lit(False))
    return {
        "raw_project": {"title_ne": _long("title_ne", 1)},
        "cleaned_project": {"title_ne": _long("title_ne", 5) & ~F.col("title_ne").rlike(r"(?U)^\d+$"), "budget": F.coalesce(F.col("budget").between(1, MAX_BUDGET), F.lit(False))},
        "translated_project": {"title_en": _long("title_en", 3), "translation_confidence": _unit("translation_confidence")},
        "agenda_item": {"title": _long("title", 3)},
        "political_promise": {"title": _long("title", 10)},
        "political_party": {"canonical_name": _long("canonical_name", 2)},
        "reviewed_promise": {"title": _long("title", 10), "source_page": page, "source_excerpt": _long("source_excerpt", 5), "extraction_confidence": _unit("extraction_confidence")},
        "reviewed_alignment": {"agenda_item_id": _long("agenda_item_id", 3), "political_promise_id": _long("political_promise_id", 3), "confidence": _unit("confidence")},
        "flow_event": {"event_type": F.lower(strip(F.coalesce(F.col("event_type"), F.lit("")))).isin("release", "transfer", "receipt"), "amount": amount},
        "budget_flow": {"allocation_title": _long("allocation_title", 3), "amount": amount, "fiscal_year": _long("fiscal_year", 3), "source_page": page, "source_excerpt": _long("source_excerpt", 5), "extraction_confidence": _unit("extraction_confidence")},
    }


def with_errors(rows: DataFrame, contract: str) -> DataFrame:
    """Adds _errors, the names of the broken rules."""
    rules = contracts()[contract]
    return rows.withColumn("_errors", F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])))


def property_text(value: Column, kind: str) -> Column:
    """A property as the graph keeps it: scalars as text, the rest as JSON with sorted keys."""
    if kind.startswith("map"):
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))
    return F.to_json(value) if kind.startswith(("struct", "array")) else value.cast("string")
