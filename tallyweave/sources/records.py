"""Source bundles to records: one row per entity, with its relations."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions.ids import amount_text, content_hash, padded_id, stable_id
from tallyweave.functions.routing import one_of, source_type
from tallyweave.functions.taxonomy import classify
from tallyweave.functions.text import strip, strip_fences
from tallyweave.sources import binary

#: The least confidence of a reviewed item, and lengths that make it whole.
REVIEWED_FROM = 0.70
APPROVED = "approved"
_NO_RELATIONS = f"array<struct<{schemas.RELATION}>>"


def read_agendas(spark: SparkSession, path: str) -> DataFrame:
    """A row per JSON file, with path and hash."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    return files.select(F.col("path").alias("source_path"), content_hash(F.col("content")).alias("source_hash"), F.from_json(text, schemas.AGENDA).alias("doc")).select("source_path", "source_hash", "doc.*")


def read_promise_csv(spark: SparkSession, path: str) -> DataFrame:
    """A row per CSV row with its number in the file (rows without a text count, blank lines don't), path and hash. Columns go by the header, quoted fields
    may hold line breaks and doubled quotes; a field that is missing is null. Numbers follow the file, so one task parses a file."""
    files = spark.read.format("binaryFile").load(path)
    names = [f.split()[0] for f in schemas.PROMISE_CSV.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                data = bytes(content)
                rows = csv.DictReader(io.StringIO(data.decode("utf-8-sig", "replace"), newline=""))
                found = [(source, hashlib.sha256(data).hexdigest(), i, *(r.get(n) for n in names)) for i, r in enumerate(rows, 1)]
                yield pd.DataFrame(found, columns=["source_path", "source_hash", "row", *names], dtype=object)

    return files.select("path", "content").mapInPandas(run, f"source_path string, source_hash string, row int, {schemas.PROMISE_CSV}")


def read_naive_csv(spark: SparkSession, path: str, prefix: str = "PR-") -> DataFrame:
    """The seed's reading of the same files: lines are cut at every comma, the first field is the category, the last two are deadline and responsible
    body, and all between belongs to the promise. Blank lines don't count; the first line is the header. Defaults stand for blank fields."""
    lines = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_path"), F.split(F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""), "\n").alias("l"))
    kept = F.filter(F.transform("l", strip), lambda x: x != "")
    x = lines.select("source_path", F.posexplode(kept).alias("n", "line")).filter("n > 0").withColumn("f", F.split("line", ","))
    n = F.size("f")
    field = lambda i: strip(F.coalesce(F.get("f", i), F.lit("")))
    middle = F.when(n > 2, strip(F.array_join(F.slice("f", 2, F.greatest(n - 3, F.lit(0))), ","))).otherwise("")
    return x.select(
        "source_path", padded_id(prefix, F.col("n")).alias("promise_id"), F.coalesce(_filled(field(F.lit(0))), F.lit("Governance")).alias("category"),
        F.coalesce(_filled(middle), field(F.lit(1))).alias("title"), F.coalesce(_filled(field(n - 2)), F.lit("Unspecified")).alias("deadline"), F.coalesce(_filled(field(n - 1)), F.lit("Government")).alias("responsible_entity"),
    )


def seed_agendas(agendas: DataFrame) -> DataFrame:
    """Items of agenda files as the seed takes them: those with identifier and title; category and priority have defaults."""
    x = agendas.select("source_path", F.explode(F.coalesce("items", F.array().cast(agendas.schema["items"].dataType))).alias("i")).filter("i.id <> '' AND i.title <> ''")
    return x.select(F.col("i.id").alias("agenda_id"), F.col("i.title").alias("title"), F.coalesce("i.description", F.lit("")).alias("description"), F.coalesce(_filled(F.col("i.priority")), F.lit("High")).alias("priority"), F.coalesce(_filled(F.col("i.category")), F.lit("General Governance")).alias("category"), F.coalesce("i.timeline", F.lit("")).alias("timeline"))


#: The places and years that a new graph starts with.
PROVINCES = ("Koshi Province", "Madhesh Province", "Bagmati Province", "Gandaki Province", "Lumbini Province", "Karnali Province", "Sudurpashchim Province")
FISCAL_YEARS = ("2079/80", "2080/81", "2081/82", "2082/83")


def seed_nodes(spark: SparkSession) -> DataFrame:
    """Nodes of a new graph: provinces, fiscal years and the federal level."""
    rows = [("Province", "name", p, {"id": str(i), "name": p}) for i, p in enumerate(PROVINCES, 1)]
    rows += [("FiscalYear", "year", y, {"year": y}) for y in FISCAL_YEARS]
    return spark.createDataFrame([*rows, ("GovernanceLevel", "name", "Federal", {"name": "Federal", "house_seats": "275"})], schemas.NODES)


def registry(lines: DataFrame) -> DataFrame:
    """lines: path, n, line of a Markdown list of sources. tier, section, name, status, url of each listed source; a tier's heading gives its letter."""
    w = W.partitionBy("path").orderBy("n")
    x = lines.withColumns({"tier": F.last(F.when(F.col("line").rlike(r"^## Tier [A-Z]"), F.regexp_extract("line", r"^## Tier ([A-Z])", 1)), True).over(w), "section": F.last(F.when(F.col("line").startswith("### "), strip(F.substring("line", 5, 10_000))), True).over(w)})
    item = F.regexp_extract("line", r"^- \*\*(.+?):?\*\*", 1)
    x = x.withColumn("name", F.last(F.when(item != "", item), True).over(w)).filter("tier IS NOT NULL AND name IS NOT NULL AND line NOT LIKE '#%'")
    url = F.regexp_extract("line", r"\]\((https?://[^)]+)\)", 1)
    status = F.regexp_extract("line", r"Status: \*\*(.+?)\*\*", 1)
    return x.groupBy("path", "tier", "section", "name").agg(F.max(status).alias("status"), F.max(url).alias("url")).drop("path")


def _props(**columns: Column) -> Column:
    """A property map without nulls, keys sorted."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(columns.items())]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def _relation(kind: str, label: str, key: str, target: Column, props: Column | None = None, when: Column | None = None, required: bool = False) -> Column:
    null = F.lit(None).cast("string")
    empty = F.create_map().cast("map<string,string>")
    r = F.struct(
        F.lit(kind).alias("relation_type"), null.alias("src_type"), null.alias("src_key"), null.alias("src_id"), F.lit(label).alias("dst_type"), F.lit(key).alias("dst_key"), target.alias("dst_id"),
        (empty if props is None else props).alias("dst_props"), empty.alias("rel_props"), F.lit(required).alias("require_existing"),
    ).cast(f"struct<{schemas.RELATION}>")
    return r if when is None else F.when(when, r)


def _named(kind: str, label: str, prefix: str, key: str, name: Column) -> Column:
    """A relation to a node that its name identifies; none without a name."""
    target = stable_id(prefix, name)
    return _relation(kind, label, key, target, _props(**{key: target, "name": name}), when=F.coalesce(strip(name), F.lit("")) != "")


def _relations(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(_NO_RELATIONS)


def _record(rows: DataFrame, label: str, key: str, node_id: Column, props: Column, relations: Column | None = None, subtype: str | Column = "", confidence: Column | float = 0.99, context: Column | None = None) -> DataFrame:
    has = lambda c: F.col(c) if c in rows.columns else F.lit("")
    document = F.regexp_extract(has("source_path"), r"([^/]*)$", 1)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        F.lit(label).alias("entity_type"), node_id.alias("record_identity"), lit(confidence).cast("double").alias("confidence"), F.array().cast("array<string>").alias("risk_flags"), F.lit(key).alias("node_key"), node_id.alias("node_id"),
        props.alias("properties"), (F.array().cast(_NO_RELATIONS) if relations is None else relations).alias("relations"), F.to_json(props).alias("raw_payload"), (F.lit(None).cast("string") if context is None else context).alias("review_context"),
        F.lit("manifesto").alias("source_type"), lit(subtype).alias("source_subtype"), document.alias("source_document"), has("source_path").alias("source_path"), has("source_hash").alias("source_hash"),
    )


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def agenda_records(agendas: DataFrame, owner: str = "Civic platform") -> DataFrame:
    """Documents, versions and items with up to eight kinds of relations."""
    subtype = "agenda_json"
    d = agendas.withColumns(
        {
            "_owner": F.coalesce(_filled(F.col("owner_name"), F.col("organization")), F.lit(owner)),
            "_language": F.coalesce(_filled(F.col("language")), F.lit("en")),
            "_version": F.coalesce(_filled(F.col("version"), F.col("name")), F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)),
            "_from": F.coalesce(_filled(F.col("effective_from"), F.col("published_at")), F.lit("")),
            "_reference": F.coalesce(_filled(F.col("source_reference")), F.col("source_path")),
            "_items": F.when(F.size(F.coalesce("items", F.array().cast(agendas.schema["items"].dataType))) > 0, F.col("items")).otherwise(F.col("agenda_items")),
        }
    )
    d = d.withColumn("_doc", F.coalesce(_filled(strip(F.col("manifesto_document_id"))), stable_id("manifesto_document", "civic_platform", F.col("_owner"), F.col("source_hash"), subtype)))
    d = d.withColumn("_ver", F.coalesce(_filled(strip(F.col("agenda_version_id"))), stable_id("agenda_version", F.col("_doc"), F.col("_version"), F.col("_from"))))
    document_props = _props(manifesto_document_id=F.col("_doc"), owner_type=F.lit("civic_platform"), owner_name=F.col("_owner"), language=F.col("_language"), source_reference=F.col("_reference"))
    documents = _record(d, "ManifestoDocument", "manifestoDocumentId", F.col("_doc"), document_props, subtype=subtype)
    n_items = F.coalesce(F.size("_items"), F.lit(0))
    version_props = _props(agenda_version_id=F.col("_ver"), name=F.col("_version"), baseline_count=F.greatest(n_items, F.lit(0)), effective_from=F.col("_from"), status=F.coalesce(_filled(F.col("status")), F.lit("baseline")), source_reference=F.col("_reference"))
    versions = _record(d, "AgendaVersion", "agendaVersionId", F.col("_ver"), version_props, _relations(_relation("DOCUMENTED_IN", "ManifestoDocument", "manifestoDocumentId", F.col("_doc"), document_props)), subtype=subtype)
    x = d.withColumn("_version_props", version_props).select("source_path", "source_hash", "_language", "_reference", "_ver", "_version_props", F.posexplode("_items").alias("_at", "i"))
    number = (F.col("_at") + 1).cast("string")
    x = x.withColumns({"_sid": F.coalesce(_filled(F.col("i.source_item_id"), F.col("i.id")), number), "_title": F.coalesce(_filled(F.col("i.title"), F.col("i.name")), F.concat(F.lit("Agenda Item "), number))})
    x = x.withColumns(
        {
            "_id": stable_id("agenda_item", F.col("_ver"), F.col("_sid"), F.col("_title")),
            "_category": F.when(F.coalesce(strip(F.col("i.category")), F.lit("")) != "", classify(F.coalesce("i.category", F.lit("")), F.col("_title"), F.coalesce("i.summary", F.lit("")), F.coalesce("i.description", F.lit("")))["display_name"]),
            "_legal": F.coalesce("i.legal_foundation", "i.legalFoundation"),
            "_targets": F.coalesce("i.performance_targets", "i.performanceTargets"),
            "_evidence": F.to_json(F.coalesce("i.real_world_evidence", "i.realWorldEvidence")),
            "_problem": F.to_json("i.problem"),
            "_solution": F.to_json("i.solution"),
            "_implementation": F.to_json("i.implementation"),
        }
    )
    common = {"agendaItemId": F.col("_id"), "sourceItemId": F.col("_sid"), "sourceReference": F.col("_reference")}

    def part(kind: str, label: str, prefix: str, key: str, text: Column) -> Column:
        target = stable_id(prefix, F.col("_ver"), F.col("_sid"), text)
        return _relation(kind, label, key, target, _props(**{key: target, "text": text}, **common), when=F.coalesce(strip(text), F.lit("")) != "")

    targets = F.transform(F.coalesce("_targets", F.array().cast("array<string>")), lambda t: part("HAS_PERFORMANCE_TARGET", "PerformanceTarget", "performance_target", "performanceTargetId", t))
    relations = F.concat(
        _relations(
            _relation("PART_OF_VERSION", "AgendaVersion", "agendaVersionId", F.col("_ver"), F.col("_version_props")),
            _named("IN_CATEGORY", "PolicyCategory", "policy_category", "policyCategoryId", F.col("_category")),
            _named("HAS_TIMELINE_TARGET", "TimelineTarget", "timeline_target", "timelineTargetId", F.col("i.timeline")),
            part("HAS_LEGAL_FOUNDATION", "LegalFoundation", "legal_foundation", "legalFoundationId", F.col("_legal")),
        ),
        F.array_compact(targets).cast(_NO_RELATIONS),
        _relations(
            part("HAS_PROBLEM_STATEMENT", "ProblemStatement", "problem_statement", "problemStatementId", F.col("_problem")),
            part("HAS_SOLUTION_PLAN", "SolutionPlan", "solution_plan", "solutionPlanId", F.col("_solution")),
            part("HAS_IMPLEMENTATION_PLAN", "ImplementationPlan", "implementation_plan", "implementationPlanId", F.col("_implementation")),
            part("HAS_REAL_WORLD_EVIDENCE_SUMMARY", "RealWorldEvidenceSummary", "real_world_evidence_summary", "realWorldEvidenceSummaryId", F.col("_evidence")),
        ),
    )
    props = _props(
        agenda_item_id=F.col("_id"), source_item_id=F.col("_sid"), title=F.col("_title"), description=F.coalesce("i.description", "i.summary"), language=F.coalesce("i.language", "_language"), active=F.col("i.active"), source_reference=F.col("_reference"),
        category=F.col("_category"), priority=F.col("i.priority"), timeline=F.col("i.timeline"), legal_foundation=F.col("_legal"), performance_targets=F.to_json("_targets"), problem=F.col("_problem"), solution=F.col("_solution"), implementation=F.col("_implementation"), real_world_evidence=F.col("_evidence"),
    )
    items = _record(x, "AgendaItem", "agendaItemId", F.col("_id"), props, relations, subtype=subtype)
    return documents.unionByName(versions).unionByName(items)


def promise_records(rows: DataFrame, party: str, short_name: str = "") -> DataFrame:
    """rows as read_promise_csv gives them. The party, a document per file, and a promise per line with a text."""
    subtype = "manifesto_csv"
    party_id = stable_id("political_party", party)
    party_props = _props(political_party_id=party_id, canonical_name=F.lit(party), short_name=F.lit(short_name))
    d = rows.select("source_path", "source_hash").distinct().withColumn("_doc", stable_id("manifesto_document", "political_party", party, F.col("source_hash"), subtype))
    document_props = _props(manifesto_document_id=F.col("_doc"), owner_type=F.lit("political_party"), owner_name=F.lit(party), language=F.lit("en"), source_reference=F.col("source_path"))
    parties = _record(d.limit(1), "PoliticalParty", "politicalPartyId", party_id, party_props, subtype=subtype)
    documents = _record(d, "ManifestoDocument", "manifestoDocumentId", F.col("_doc"), document_props, _relations(_relation("ISSUED_BY", "PoliticalParty", "politicalPartyId", party_id, party_props)), subtype=subtype)
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    x = rows.withColumns({"_title": text("Specific_Promise"), "_time": text("Target_Deadline"), "_who": text("Responsible_Entity"), "_doc": stable_id("manifesto_document", "political_party", party, F.col("source_hash"), subtype)}).filter("_title <> ''")
    x = x.withColumns({"_category": classify(text("Category"), F.col("_title"), F.col("_title"))["display_name"], "_id": stable_id("political_promise", F.col("_doc"), F.col("row"), F.col("_title"))})
    props = _props(political_promise_id=F.col("_id"), title=F.col("_title"), summary=F.col("_title"), language=F.lit("en"), promise_scope=F.lit("national"), source_reference=F.col("source_path"), category=F.col("_category"), timeline=F.col("_time"), responsible_entity=F.col("_who"))
    relations = _relations(
        _relation("PROMISED_IN", "ManifestoDocument", "manifestoDocumentId", F.col("_doc"), document_props),
        _relation("MADE_BY", "PoliticalParty", "politicalPartyId", party_id, party_props),
        _named("IN_CATEGORY", "PolicyCategory", "policy_category", "policyCategoryId", F.col("_category")),
        _named("HAS_TIMELINE_TARGET", "TimelineTarget", "timeline_target", "timelineTargetId", F.col("_time")),
        _named("ASSIGNED_TO", "ResponsibleEntity", "responsible_entity", "responsibleEntityId", F.col("_who")),
    )
    return parties.unionByName(documents).unionByName(_record(x, "PoliticalPromise", "politicalPromiseId", F.col("_id"), props, relations, subtype=subtype))


def _approved(item: str) -> Column:
    return (F.col(f"{item}.reviewer_status") == APPROVED) & ~F.coalesce(f"{item}.placeholder", F.lit(False))


def reviewed_promise_records(bundles: DataFrame) -> DataFrame:
    """Promises of bundles whose text and structure are approved; each item approved, no placeholder, and confident enough."""
    ok = (F.col("ocr_text_review_status") == APPROVED) & (F.col("structured_promises_status") == APPROVED)
    x = bundles.filter(ok).select("manifesto_document_id", "source_reference", "source_subtype", F.explode("reviewed_structured_promises").alias("i"))
    x = x.filter(_approved("i") & (F.col("i.extraction_confidence") >= REVIEWED_FROM)).withColumn("_id", stable_id("political_promise", F.col("manifesto_document_id"), F.col("i.source_page"), F.col("i.title")))
    category = classify(F.coalesce("i.category", F.lit("")), F.col("i.title"), F.coalesce("i.summary", F.lit("")))["display_name"]
    props = _props(political_promise_id=F.col("_id"), title=F.col("i.title"), summary=F.col("i.summary"), language=F.col("i.language"), category=category, timeline=F.col("i.timeline"), responsible_entity=F.col("i.responsible_entity"), source_reference=F.col("source_reference"), source_page=F.col("i.source_page"), source_excerpt=F.col("i.source_excerpt"))
    relations = _relations(_relation("PROMISED_IN", "ManifestoDocument", "manifestoDocumentId", F.col("manifesto_document_id")), _named("IN_CATEGORY", "PolicyCategory", "policy_category", "policyCategoryId", category), _named("HAS_TIMELINE_TARGET", "TimelineTarget", "timeline_target", "timelineTargetId", F.col("i.timeline")), _named("ASSIGNED_TO", "ResponsibleEntity", "responsible_entity", "responsibleEntityId", F.col("i.responsible_entity")))
    return _record(x, "PoliticalPromise", "politicalPromiseId", F.col("_id"), props, relations, subtype=F.col("source_subtype"), confidence=F.col("i.extraction_confidence"))


def reviewed_alignment_records(bundles: DataFrame) -> DataFrame:
    x = bundles.filter(F.col("reviewed_alignment_status") == APPROVED).select("source_subtype", F.explode("reviewed_alignment_assessments").alias("i")).filter(_approved("i") & (F.col("i.approval_state") == APPROVED))
    x = x.withColumn("_id", stable_id("alignment_assessment", F.col("i.agenda_item_id"), F.col("i.political_promise_id"), F.col("i.relation_type"), F.col("i.notes")))
    props = _props(alignment_assessment_id=F.col("_id"), agenda_item_id=F.col("i.agenda_item_id"), political_promise_id=F.col("i.political_promise_id"), relation_type=F.col("i.relation_type"), confidence=F.col("i.confidence"), approval_state=F.col("i.approval_state"), notes=F.col("i.notes"))
    relations = _relations(_relation("ASSESSES_AGENDA_ITEM", "AgendaItem", "agendaItemId", F.col("i.agenda_item_id"), required=True), _relation("ASSESSES_POLITICAL_PROMISE", "PoliticalPromise", "politicalPromiseId", F.col("i.political_promise_id"), required=True))
    return _record(x, "AlignmentAssessment", "alignmentAssessmentId", F.col("_id"), props, relations, subtype=F.col("source_subtype"), confidence=F.col("i.confidence"))


def linkage(flows: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds link, STRUCT<state, reason, resolved_id, candidates, review>, by the project that a flow names and the projects there are. flows: project_id, project_name, body_id, body_name; projects: project_id."""
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    known = projects.select(F.col("project_id").alias("_known")).distinct()
    x = flows.join(known, text("project_id") == F.col("_known"), "left")
    make = lambda state, reason, resolved, n, review: F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"), resolved.alias("resolved_id"), F.lit(n).alias("candidates"), F.lit(review).alias("review"))
    empty = F.lit("")
    link = (
        F.when((text("project_id") != "") & F.col("_known").isNotNull(), make("linked", "exact_existing_project_id", F.col("_known"), 1, False))
        .when(text("project_id") != "", make("unresolved_candidate", "project_id_not_found", empty, 0, True))
        .when(text("project_name") != "", make("unresolved_candidate", "project_name_observed_without_exact_project_id", empty, 0, True))
        .when((text("body_id") != "") | (text("body_name") != ""), make("unlinked_accountable_body", "no_project_reference_accountable_body_present", empty, 0, False))
        .otherwise(make("unresolved_candidate", "no_safe_project_reference", empty, 0, True))
    )
    return x.withColumn("link", link).drop("_known")


def budget_flow_records(bundles: DataFrame, projects: DataFrame) -> DataFrame:
    """Allocations and their three families of events."""
    x = bundles.filter(F.col("reviewed_budget_flow_status") == APPROVED).select("source_reference", "source_subtype", F.explode("reviewed_budget_flows").alias("i"))
    x = x.filter(_approved("i") & (F.col("i.extraction_confidence") >= REVIEWED_FROM))
    x = x.withColumns({"project_id": F.col("i.project_id"), "project_name": F.lit(""), "body_id": F.col("i.implementing_body_id"), "body_name": F.col("i.implementing_body_name"), "_ref": F.coalesce(_filled(F.col("i.source_reference_override")), F.col("source_reference"))})
    x = linkage(x, projects)
    body = F.coalesce(F.col("body_id"), F.lit(""))
    x = x.withColumn("_id", stable_id("budget_allocation", F.col("i.allocation_code"), F.col("i.allocation_title"), F.col("i.fiscal_year"), F.col("i.project_id"), F.col("i.implementing_body_id"), F.col("_ref"), F.col("i.source_page")))
    props = _props(
        budget_allocation_id=F.col("_id"), title=F.col("i.allocation_title"), amount=F.col("i.amount"), currency=F.col("i.currency"), fiscal_year=F.col("i.fiscal_year"), budget_class=F.col("i.budget_class"), sector=F.col("i.sector"), subsector=F.col("i.subsector"),
        source_page=F.col("i.source_page"), source_excerpt=F.col("i.source_excerpt"), project_linkage_state=F.col("link.state"), project_linkage_reason=F.col("link.reason"), resolved_project_id=F.col("link.resolved_id"), project_candidate_count=F.col("link.candidates"), project_requires_review=F.col("link.review"),
    )
    relations = _relations(
        _relation("IN_FISCAL_YEAR", "FiscalYear", "year", F.col("i.fiscal_year"), _props(year=F.col("i.fiscal_year"))),
        _relation("MANAGED_BY", "ImplementingBody", "implementingBodyId", body, _props(implementingBodyId=body, name=F.col("body_name"), level=F.col("i.implementing_body_level")), when=body != ""),
        _relation("FUNDS", "Project", "projectId", F.col("link.resolved_id"), when=F.col("link.state") == "linked", required=True),
    )
    out = _record(x, "BudgetAllocation", "budgetAllocationId", F.col("_id"), props, relations, subtype=F.col("source_subtype"), confidence=F.col("i.extraction_confidence"))
    for kind, label, key in (("release", "ReleaseEvent", "releaseEventId"), ("transfer", "TransferEvent", "transferEventId"), ("receipt", "ReceiptEvent", "receiptEventId")):
        e = x.select("source_subtype", "_id", F.col("i.extraction_confidence").alias("confidence"), F.posexplode(f"i.{kind}_events").alias("at", "e")).filter(_approved("e") & (F.lower(strip(F.col("e.event_type"))) == kind))
        own = stable_id(f"{kind}_event", F.col("_id"), F.col("e.reference_code"), F.col("e.title"), amount_text(F.col("e.amount")), F.col("e.event_date"), F.col("at") + 1)
        to = F.coalesce("e.body_id", F.lit(""))
        event = _props(**{key: own, "title": F.col("e.title"), "amount": F.col("e.amount"), "currency": F.col("e.currency"), "event_date": F.col("e.event_date"), "reference_code": F.col("e.reference_code"), "notes": F.col("e.notes")})
        edges = _relations(
            _relation("RELATES_TO", "BudgetAllocation", "budgetAllocationId", F.col("_id")),
            _relation("RECEIVED_BY" if kind == "receipt" else "TO_BODY", "ImplementingBody", "implementingBodyId", to, _props(implementingBodyId=to, name=F.col("e.body_name"), level=F.col("e.body_level")), when=to != ""),
        )
        out = out.unionByName(_record(e, label, key, own, event, edges, subtype=F.col("source_subtype"), confidence=F.col("confidence")))
    return out


def scanned_document_records(documents: DataFrame) -> DataFrame:
    """Provenance alone: chars (of embedded text in the first pages) decides the confidence."""
    own = stable_id("manifesto_document", "political_party", F.col("owner_name"), F.col("source_hash"), "scanned_manifesto_pdf")
    props = _props(manifesto_document_id=own, owner_type=F.lit("political_party"), owner_name=F.col("owner_name"), source_reference=F.col("source_path"))
    return _record(documents, "ManifestoDocument", "manifestoDocumentId", own, props, subtype="scanned_manifesto_pdf", confidence=F.when(F.coalesce("chars", F.lit(0)) == 0, 0.40).otherwise(0.55))


#: Fixed value: the confidence of a commitment that states none.
COMMITMENT_DEFAULT = 0.55
COMMITMENT = "promise_text STRING, category STRING, actor STRING, timeline STRING, confidence DOUBLE"


def manifesto_records(documents: DataFrame) -> DataFrame:
    """documents: source_path, source_hash, owner_name and answer, what a reader of the text gave: a JSON array of commitments, or an object with items, in a
    fence or not. A document record each, and a promise per commitment with a text of ten characters and a confidence from 0 to 1 (0.55 where there is none); numbers count all items."""
    json_text = strip_fences(F.col("answer"))
    items = F.when(F.startswith(json_text, F.lit("[")), F.from_json(json_text, f"array<struct<{COMMITMENT}>>")).otherwise(F.from_json(json_text, f"items array<struct<{COMMITMENT}>>")["items"])
    owner = F.col("owner_name")
    d = documents.withColumns({"_doc": stable_id("manifesto_document", "political_party", owner, F.col("source_hash"), "manifesto_pdf"), "_items": items})
    document_props = _props(manifesto_document_id=F.col("_doc"), owner_type=F.lit("political_party"), owner_name=owner, language=F.lit("en"), source_reference=F.col("source_path"))
    out = _record(d, "ManifestoDocument", "manifestoDocumentId", F.col("_doc"), document_props, subtype="manifesto_pdf")
    x = d.withColumn("_props", document_props).select("source_path", "source_hash", "_doc", "_props", F.posexplode("_items").alias("at", "i"))
    title = F.coalesce("i.promise_text", F.lit(""))
    x = x.withColumn("_score", F.coalesce("i.confidence", F.lit(COMMITMENT_DEFAULT)))
    x = x.filter((F.length(title) >= 10) & F.col("_score").between(0, 1)).withColumns({"_title": title, "_id": stable_id("political_promise", F.col("_doc"), F.col("at") + 1, title)})
    category = classify(strip(F.coalesce("i.category", F.lit(""))), F.col("_title"), F.col("_title"))["display_name"]
    props = _props(political_promise_id=F.col("_id"), title=F.col("_title"), summary=F.col("_title"), language=F.lit("en"), promise_scope=F.lit("national"), source_reference=F.col("source_path"), category=category, timeline=strip(F.coalesce("i.timeline", F.lit(""))), responsible_entity=strip(F.coalesce("i.actor", F.lit(""))))
    relations = _relations(_relation("PROMISED_IN", "ManifestoDocument", "manifestoDocumentId", F.col("_doc"), F.col("_props")), _named("IN_CATEGORY", "PolicyCategory", "policy_category", "policyCategoryId", category))
    score = F.col("_score")
    promises = _record(x, "PoliticalPromise", "politicalPromiseId", F.col("_id"), props, relations, subtype="manifesto_pdf", confidence=F.greatest(F.lit(0.05), F.least(F.lit(0.99), score)))
    low = x.filter(score < REVIEWED_FROM).select(F.col("_id").alias("_low")).distinct()
    flagged = promises.join(low, F.col("record_identity") == F.col("_low"), "left")
    flagged = flagged.withColumn("risk_flags", F.when(F.col("_low").isNull(), F.col("risk_flags")).otherwise(F.array(F.lit("low_confidence")))).drop("_low")
    return out.unionByName(flagged)


#: Which extractor a document's records come from; the first that holds.
EXTRACTORS = ("budget_table", "agenda_json", "manifesto_csv", "scanned_manifesto_pdf", "manifesto_text", "none")


def extractor(kind: Column, subtype: Column) -> Column:
    """The extractor of a document by its source type and subtype."""
    return (
        F.when(kind == "lal_kitab", "budget_table")
        .when(subtype.isin("agenda_json", "manifesto_csv", "scanned_manifesto_pdf"), subtype)
        .when((subtype == "manifesto_pdf") | kind.isin("manifesto", "media", "citizen", "other"), "manifesto_text")
        .otherwise("none")
    )


def extract(documents: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], bundles: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
    """documents: source_type, source_subtype. Each goes to its extractor's function, one plan for all of a kind; records of reviewed bundles are added whatever
    the kind. A scanned manifesto that has reviewed promises gives these instead of its provenance: pass ``reviewed_scanned`` for them."""
    routed = documents.withColumn("_route", extractor(F.col("source_type"), F.col("source_subtype")))
    out = None
    for name in EXTRACTORS:
        if name not in extractors:
            continue
        mine = routed.filter(F.col("_route") == name).drop("_route")
        found = extractors[name](mine)
        if name == "scanned_manifesto_pdf" and "reviewed_scanned" in extractors:
            reviewed = extractors["reviewed_scanned"](mine)
            found = reviewed.unionByName(found.join(reviewed.select("source_path").distinct(), "source_path", "left_anti").select(*found.columns))
        out = found if out is None else out.unionByName(found)
    for bundle in bundles:
        found = bundle(documents)
        out = found if out is None else out.unionByName(found)
    return out


def read_manifest(spark: SparkSession, text: str) -> DataFrame:
    """source_path, source_type, source_tier, destination of a manifest: a JSON list, or an object with sources or documents, of paths or objects."""
    found = json.loads(text)
    if isinstance(found, dict):
        found = found.get("sources") or found.get("documents") or []
    rows = [(x, None, None, None) if isinstance(x, str) else tuple(x.get(k) for k in ("source_path", "source_type", "source_tier", "destination")) for x in found]
    return manifest_rows(spark.createDataFrame(rows, "source_path string, source_type string, source_tier string, destination string"))


def manifest_rows(entries: DataFrame) -> DataFrame:
    """source_path, source_type, source_tier, destination of a manifest: blanks and unknown choices get their defaults."""
    path = strip(F.coalesce("source_path", F.lit("")))
    types = ("lal_kitab", "manifesto", "citizen", "media", "other")
    return entries.filter(path != "").select(path.alias("source_path"), one_of(F.col("source_type"), types, source_type(path)).alias("source_type"), one_of(F.col("source_tier"), ("A", "B", "C"), "A").alias("source_tier"), one_of(F.col("destination"), ("tracker",), "tracker").alias("destination"))


#: Titles that go to a translator at once.
BATCH = 25


def cached_translations(titles: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """titles with what the cache has, and the distinct ones that are missing."""
    x = titles.join(cache.select(F.col("source").alias("title_ne"), "title_en"), "title_ne", "left")
    return x, x.filter("title_en IS NULL").select("title_ne").distinct()


def translated(missing: DataFrame, forward: Callable[[list[str]], list[str]], back: Callable[[list[str]], list[str]]) -> DataFrame:
    """missing: title_ne. title_ne, title_en, back, confidence, flag: translated and translated back by what the cluster supplies, in batches; a title whose
    answer is missing stands for itself. The flag tells how alike the title and its back translation are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            titles = batch["title_ne"].tolist()
            for a in range(0, len(titles), BATCH):
                some = titles[a : a + BATCH]
                there = [x or t for x, t in zip([*forward(some), *[None] * len(some)], some)]
                again = [x or "" for x, _ in zip([*back(there), *[None] * len(some)], some)]
                yield pd.DataFrame({"title_ne": some, "title_en": there, "back": again})

    x = missing.select("title_ne").mapInPandas(run, "title_ne string, title_en string, back string")
    x = x.withColumn("confidence", F.round(binary.similarity(F.col("title_ne"), F.col("back")), 3))
    return x.withColumn("flag", F.when(F.col("confidence") >= binary.SIMILAR_FROM, "ok").otherwise("uncertain"))


def written_back(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new translations; what it has stays, and of two new ones of a title the smallest does."""
    new = fresh.groupBy(F.col("title_ne").alias("source")).agg(F.min(F.struct("title_en", F.concat(F.lit("back:"), F.substring("back", 1, 200)).alias("category"))).alias("n")).select("source", "n.*")
    return cache.unionByName(new.join(cache.select("source"), "source", "left_anti"), allowMissingColumns=True)


def report(**figures: DataFrame) -> DataFrame:
    """One row, report: a JSON object of one-row tables' values by name, as a command's last words."""
    out = None
    for name, df in figures.items():
        one = df.select(F.struct("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(*figures)).alias("report"))
