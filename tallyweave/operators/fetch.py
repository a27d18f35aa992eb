"""Reads of the graph and of the queue's tables: what matching, backfills and publishing start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.ids import stable_id
from tallyweave.operators import align
from tallyweave.operators.views import prop

#: Edge types of an agenda item, the label at their end, and the property that counts.
PARTS = {
    "problem": ("HAS_PROBLEM_STATEMENT", "ProblemStatement", "payload"),
    "solution": ("HAS_SOLUTION_PLAN", "SolutionPlan", "payload"),
    "implementation": ("HAS_IMPLEMENTATION_PLAN", "ImplementationPlan", "payload"),
    "legal_foundation": ("HAS_LEGAL_FOUNDATION", "LegalFoundation", "text"),
    "real_world_evidence": ("HAS_REAL_WORLD_EVIDENCE_SUMMARY", "RealWorldEvidenceSummary", "payload"),
    "categories": ("IN_CATEGORY", "PolicyCategory", "name"),
    "performance_targets": ("HAS_PERFORMANCE_TARGET", "PerformanceTarget", "text"),
}
ALIGNMENT_EVENTS = ("BudgetAllocation", "ReleaseEvent", "TransferEvent", "ReceiptEvent")


def _ends(nodes: DataFrame, edges: DataFrame, label: str, parts: dict[str, tuple[str, str, str]]) -> DataFrame:
    """id, part, value of what a label's nodes lead to; one join for all parts. Blank values don't count."""
    wanted = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for name, (rel, end, key) in parts.items():
        here = (F.col("rel_type") == rel) & (F.col("dst_type") == end)
        wanted = F.when(here, name).otherwise(wanted)
        value = F.when(F.col("part") == name, F.element_at("props", F.lit(key))).otherwise(value)
    e = edges.filter(F.col("src_type") == label).select(F.col("src_id").alias("id"), F.col("dst_type").alias("label"), F.col("dst_id").alias("end"), wanted.alias("part")).filter("part IS NOT NULL")
    n = nodes.filter(F.col("label").isin(*{end for _, end, _ in parts.values()})).select("label", F.col("id").alias("end"), "props")
    return e.join(n, ["label", "end"]).select("id", "part", value.alias("value")).filter("trim(value) <> ''")


def _gathered(nodes: DataFrame, edges: DataFrame, label: str, parts: dict[str, tuple[str, str, str]], lists: tuple[str, ...] = ()) -> DataFrame:
    """A row per node that leads anywhere: of each part its smallest value, of those in lists all, sorted. The reference order is open, so it is set here."""
    of = lambda p: F.when(F.col("part") == p, F.col("value"))
    return _ends(nodes, edges, label, parts).groupBy("id").agg(*[(F.sort_array(F.collect_set(of(p))) if p in lists else F.min(of(p))).alias(f"_{p}") for p in parts])


def agenda_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Agenda items as the matcher takes them, with what their optional edges lead to."""
    a = nodes.filter(F.col("label") == "AgendaItem").select("id", "props").join(_gathered(nodes, edges, "AgendaItem", PARTS, ("performance_targets",)), "id", "left")
    text = lambda *names: prop("props", *names)
    return a.select(
        F.col("id").alias("agenda_item_id"), text("title").alias("title"), text("description").alias("description"), text("summary").alias("summary"), F.coalesce(prop("props", "category", default=None), "_categories", F.lit("")).alias("category"),
        text("timeline").alias("timeline"), text("responsibleEntity").alias("responsible_entity"), F.col("_problem").alias("problem"), F.col("_solution").alias("solution"), F.col("_implementation").alias("implementation"),
        F.coalesce("_performance_targets", F.array().cast("array<string>")).alias("performance_targets"), F.coalesce("_legal_foundation", F.lit("")).alias("legal_foundation"), F.col("_real_world_evidence").alias("real_world_evidence"),
    )


def promise_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Promises as the matcher takes them."""
    parts = {"categories": PARTS["categories"], "responsible": ("ASSIGNED_TO", "ResponsibleEntity", "name")}
    p = nodes.filter(F.col("label") == "PoliticalPromise").select("id", "props").join(_gathered(nodes, edges, "PoliticalPromise", parts), "id", "left")
    text = lambda name: prop("props", name).alias(name)
    return p.select(
        F.col("id").alias("political_promise_id"), text("title"), text("summary"), text("description"), F.coalesce(prop("props", "category", default=None), "_categories", F.lit("")).alias("category"),
        text("timeline"), F.coalesce(prop("props", "responsible_entity", default=None), "_responsible", F.lit("")).alias("responsible_entity"),
    )


def approved_alignments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Approved assessments with their agenda item and promise, by two inner joins over edges whose ends are there; several of either give several rows."""
    aa = nodes.filter((F.col("label") == "AlignmentAssessment") & (prop("props", "approvalState", "approval_state") == "approved"))
    aa = aa.select(
        F.col("id").alias("assessment_id"), prop("props", "relationType", "relation_type", default="PARTIALLY_ALIGNS").alias("relation_type"),
        F.coalesce(prop("props", "confidence", default=None).try_cast("double"), F.lit(0.0)).alias("confidence"), prop("props", "approvalState", "approval_state", default="approved").alias("approval_state"),
    )
    out = aa
    for rel, label, name in (("ASSESSES_AGENDA_ITEM", "AgendaItem", "agenda_item_id"), ("ASSESSES_POLITICAL_PROMISE", "PoliticalPromise", "political_promise_id")):
        e = edges.filter((F.col("rel_type") == rel) & (F.col("src_type") == "AlignmentAssessment") & (F.col("dst_type") == label)).select(F.col("src_id").alias("assessment_id"), F.col("dst_id").alias(name)).distinct()
        out = out.join(e.join(nodes.filter(F.col("label") == label).select(F.col("id").alias(name)), name, "left_semi"), "assessment_id")
    return out


def candidate_id() -> Column:
    """The fingerprint of a proposed match in the queue."""
    return stable_id("alignment_review_candidate", F.col("agenda_item_id"), F.col("political_promise_id"))


def proposals(nodes: DataFrame, edges: DataFrame, reviews: DataFrame, limit: int = 100, **thresholds: float) -> DataFrame:
    """New queue items: the best matches of the graph's agenda items and promises, one of a pair, without those that wait or are approved already. The
    limit is taken before these go, as many at most come out."""
    best = align.top(align.candidates(agenda_rows(nodes, edges), promise_rows(nodes, edges), **thresholds), limit).withColumn("fingerprint", candidate_id())
    taken = reviews.filter((F.col("entity_type") == "AlignmentAssessment") & F.col("status").isin("pending_review", "approved")).select("fingerprint")
    return best.join(taken, "fingerprint", "left_anti").withColumns({"status": F.lit("pending_review"), "reason": F.lit("alignment_candidate_generated"), "risk_level": F.lit("medium"), "bucket": align.bucket(F.col("confidence"))})


def with_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with their job's name, status, priority and options."""
    return documents.join(jobs.select(F.col("id").alias("job_id"), *[F.col(c).alias(f"job_{c}") for c in ("name", "status", "priority", "options") if c in jobs.columns]), "job_id")


def verify_paths(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """party, promise, agenda_id, agenda_title along two edges, the first by identifiers."""
    committed = edges.filter("rel_type = 'COMMITTED_TO' AND src_type = 'PoliticalParty'").select(F.col("src_id").alias("party_id"), F.col("dst_id").alias("promise_id"))
    aligned = edges.filter("rel_type = 'ALIGNED_WITH' AND dst_type = 'AgendaItem'").select(F.col("src_id").alias("promise_id"), F.col("dst_id").alias("agenda_id"))
    of = lambda label, name, value: nodes.filter(F.col("label") == label).select(F.col("id").alias(name), value)
    x = committed.join(aligned, "promise_id").join(of("PoliticalParty", "party_id", prop("props", "code").alias("party")), "party_id")
    x = x.join(of("PoliticalPromise", "promise_id", prop("props", "title").alias("promise")), "promise_id").join(of("AgendaItem", "agenda_id", prop("props", "title").alias("agenda_title")), "agenda_id")
    return x.orderBy("party_id", "promise_id", "agenda_id").limit(limit).select("party", "promise", "agenda_id", "agenda_title")


def publish_queue(reviews: DataFrame, job: str | None = None, limit: int = 500) -> DataFrame:
    """Approved items, the oldest first, ties by identifier."""
    rows = reviews.filter(F.col("status") == "approved")
    rows = rows if job is None else rows.filter(F.col("job_id") == job)
    return rows.orderBy("created_at", "id").limit(limit)


#: The order in which each table is listed.
ORDER = {"jobs": "desc", "documents": "desc", "reviews": "asc", "failed": "desc"}


def listed(rows: DataFrame, table: str) -> DataFrame:
    """A table in its own order by creation, ties by identifier."""
    at = F.col("created_at")
    return rows.orderBy(at.desc() if ORDER[table] == "desc" else at.asc(), "id")


def record_counts(records: DataFrame, document: str = "source_path") -> DataFrame:
    """A row per document: extracted, alignments, budget_flows."""
    return records.groupBy(document).agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("entity_type") == "AlignmentAssessment").alias("alignments"), F.count_if(F.col("entity_type").isin(*ALIGNMENT_EVENTS)).alias("budget_flows"))
