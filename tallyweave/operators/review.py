"""The gate between publishing and review, the queue, and the states of documents and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import budget
from tallyweave.functions.ids import stable_id
from tallyweave.functions.text import strip, valid_email
from tallyweave.operators.graph import latest

#: Fixed values.
MAX_ATTEMPTS = 5
OPEN = ("pending_review", "approved")
DETAIL = 4000


def gate(records: DataFrame, threshold: float = budget.PUBLISH_FROM) -> tuple[DataFrame, DataFrame]:
    """Records to publish, and records to hold with reason and risk_level; together all of them."""
    flags = F.coalesce("risk_flags", F.array().cast("array<string>"))
    score = F.coalesce("confidence", F.lit(0.0))
    rows = records.withColumn("reason", budget.hold_reason(score, flags, threshold)).withColumn("risk_level", budget.risk_level(score, flags))
    return rows.filter("reason IS NULL").drop("reason", "risk_level"), rows.filter("reason IS NOT NULL")


def hold(queue: DataFrame, held: DataFrame, order: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """New rows for the queue, and all held rows with the status of the newest item of their key, if any (any status blocks a new item).
    The key is (entity_type, fingerprint), or (entity_type, record_key) where there is no fingerprint."""
    key = F.concat_ws("|", "entity_type", F.when(F.coalesce("fingerprint", F.lit("")) != "", F.concat(F.lit("f:"), "fingerprint")).otherwise(F.concat(F.lit("k:"), F.coalesce("record_key", F.lit("")))))
    known = latest(queue.withColumn("_key", key), ["_key"], [order]).select("_key", F.col("status").alias("open_status"))
    rows = held.withColumn("_key", key).join(known, "_key", "left")
    fresh = rows.filter("open_status IS NULL").dropDuplicates(["_key"]).drop("_key", "open_status")
    return fresh, rows.drop("_key")


def counts_as_held(open_status: Column) -> Column:
    """A held row counts where its item is new or still open."""
    return open_status.isNull() | open_status.isin(*OPEN)


def failure(source_type: Column, path: Column, source_hash: Column, stage: str, reason: str, detail: Column) -> Column:
    return F.struct(source_type.alias("source_type"), path.alias("source_path"), source_hash.alias("source_hash"), F.lit(stage).alias("stage"), F.lit(reason).alias("failure_reason"), F.substring(detail, 1, DETAIL).alias("failure_detail"))


def document_status(published: Column, held: Column) -> Column:
    return F.when((published > 0) & (held == 0), "published").when(held > 0, "review_hold").otherwise("failed")


def job_status(pending: Column, failed: Column, held: Column, published: Column) -> Column:
    """The first that holds."""
    return F.when(pending, "running").when(failed > 0, "failed").when(held > 0, "review_hold").when(published > 0, "completed").otherwise("dead_letter")


def rollup(documents: DataFrame, job: str = "job_id") -> DataFrame:
    """A row per job: source_count, processed_count, published_count, held_count, failed_count, status."""
    n = lambda when: F.count_if(when)
    waiting = F.col("status").isin("queued", "processing", "pending_retry")
    x = documents.groupBy(job).agg(
        F.count(F.lit(1)).alias("source_count"),
        n(F.col("status") != "queued").alias("processed_count"),
        F.coalesce(F.sum("published_count"), F.lit(0)).alias("published_count"),
        F.coalesce(F.sum("held_count"), F.lit(0)).alias("held_count"),
        n(F.col("status") == "failed").alias("failed_count"),
        F.max(waiting).alias("_pending"),
    )
    return x.withColumn("status", job_status(F.col("_pending"), F.col("failed_count"), F.col("held_count"), F.col("published_count"))).drop("_pending")


def metadata_counts(documents: DataFrame, column: str = "extra_metadata") -> DataFrame:
    """One row: how many documents' metadata tell of translation, its failure, ..., by conditional counts over JSON."""
    v = lambda path: F.get_json_object(column, path)
    return documents.agg(
        F.count_if(v("$.translation_applied") == "true").alias("translated"),
        F.count_if(v("$.translation_status") == "failed").alias("translation_failed"),
        F.count_if(v("$.source_language") == "ne").alias("native"),
        F.count_if(v("$.source_language") == "en").alias("english"),
    )


def sums_by_key(documents: DataFrame, column: str, path: str) -> DataFrame:
    """name, n: the sums of a JSON map's values over all documents."""
    entries = F.explode(F.from_json(F.get_json_object(column, path), "map<string,double>"))
    return documents.select(entries.alias("name", "value")).groupBy("name").agg(F.sum("value").alias("n"))


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def retry(documents: DataFrame, failed_only: bool = False, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Adds outcome to the documents that a retry looks at: queued, or exhausted after so many attempts."""
    states = ("failed",) if failed_only else ("failed", "review_hold")
    return documents.filter(F.col("status").isin(*states)).withColumn("outcome", F.when(F.col("attempt_count") >= max_attempts, "exhausted").otherwise("queued"))


def apply_decisions(reviews: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved items are resolved; their documents' counters move, and a document with nothing held is published."""
    done = reviews.withColumn("status", F.when(F.col("status") == "approved", "resolved").otherwise(F.col("status")))
    moved = reviews.filter("status = 'approved'").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    docs = documents.join(moved, "id", "left")
    held = F.greatest(F.col("held_count") - F.coalesce("_n", F.lit(0)), F.lit(0))
    status = F.when(F.col("_n").isNotNull() & (held == 0), "published").otherwise(F.col("status"))
    return done, docs.withColumns({"status": status, "published_count": F.col("published_count") + F.coalesce("_n", F.lit(0)), "held_count": held}).drop("_n")


def bulk_action(rows: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Sets the status of the rows whose id is among ids."""
    marked = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).drop("_hit").select(*rows.columns)


def merge_metadata(old: Column, new: Column) -> Column:
    """A shallow update: the new map's keys win."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(new, empty)
    return F.map_concat(F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(new, k)), new)


#: The edges that an approved assessment stands for, with the end that each goes to.
DIRECT = (
    ("ALIGNS_WITH_AGENDA_ITEM", "AgendaItem", "promise"),
    ("ASSESSES_SOLUTION_PLAN", "SolutionPlan", "assessment"),
    ("ASSESSES_IMPLEMENTATION_PLAN", "ImplementationPlan", "assessment"),
    ("ALIGNS_WITH_SOLUTION_PLAN", "SolutionPlan", "promise"),
    ("ALIGNS_WITH_IMPLEMENTATION_PLAN", "ImplementationPlan", "promise"),
)


def direct_links(assessments: DataFrame, plans: DataFrame) -> DataFrame:
    """assessments: assessment_id, agenda_item_id, political_promise_id; plans: agenda_item_id, label, id (the smallest of a label counts).
    Up to five edges each; src_id, rel_type, dst_id, assessment_id."""
    least = plans.groupBy("agenda_item_id", "label").agg(F.min("id").alias("plan_id"))
    ends = least.groupBy("agenda_item_id").agg(*[F.max(F.when(F.col("label") == label, F.col("plan_id"))).alias(label) for label in ("SolutionPlan", "ImplementationPlan")])
    x = assessments.join(ends, "agenda_item_id", "left")
    one = lambda rel, label, side: F.struct(F.col("political_promise_id" if side == "promise" else "assessment_id").alias("src_id"), F.lit(rel).alias("rel_type"), (F.col("agenda_item_id") if label == "AgendaItem" else F.col(label)).alias("dst_id"))
    return x.select("assessment_id", F.explode(F.array(*[one(*d) for d in DIRECT])).alias("e")).select("assessment_id", "e.*").filter("dst_id IS NOT NULL")


def backfill_links(links: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links that are missing, and counts by type of created and existing ones; a second run creates none."""
    keys = ["src_id", "rel_type", "dst_id", "assessment_id"]
    missing = links.join(existing.select(*keys).distinct(), keys, "left_anti")
    had = links.join(existing.select(*keys).distinct(), keys, "left_semi")
    count = lambda df, name: df.groupBy("rel_type").agg(F.count(F.lit(1)).alias(name))
    return missing, count(missing, "created").join(count(had, "existing"), "rel_type", "full").na.fill(0)


def publishable(reviews: DataFrame | None = None) -> Column:
    """Whether an item's payload may be published: provenance alone may not, a promise needs its evidence; an approved alignment has no floor."""
    v = lambda path: F.coalesce(F.get_json_object("proposed_payload", path), F.lit(""))
    provenance = (F.col("entity_type") == "ManifestoDocument") & (v("$.source_subtype") == "scanned_manifesto_pdf")
    promise = F.col("entity_type") == "PoliticalPromise"
    ready = (F.length(F.trim(v("$.title"))) >= 10) & (F.length(F.trim(v("$.source_excerpt"))) >= 5) & (F.coalesce(v("$.extraction_confidence").try_cast("double"), F.lit(0.0)) >= 0.70) & (v("$.source_page").try_cast("int") >= 1)
    alignment = F.col("entity_type") == "AlignmentAssessment"
    both = (v("$.agenda_item_id") != "") & (v("$.political_promise_id") != "") & (v("$.approval_state") == "approved")
    return F.when(provenance, False).when(promise, F.coalesce(ready, F.lit(False))).when(alignment, both).otherwise(True)


def category_backfill(rows: DataFrame, classified: Column) -> tuple[DataFrame, DataFrame]:
    """rows: id, category. Rows with their category normalised and its node's id; counts by category and source, with how many change."""
    x = rows.withColumn("c", classified)
    x = x.withColumns({"changed": ~F.col("category").eqNullSafe(F.col("c.display_name")), "category": F.col("c.display_name"), "policy_category_id": stable_id("policy_category", F.col("c.display_name"))})
    counts = x.groupBy("category", F.col("c.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"))
    return x.drop("c"), counts


def subscriptions(requests: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests: id, email, source, agenda_id; existing: email. New subscribers, and each request's outcome: invalid, already or added (the smallest id of an
    address; its other requests find it there)."""
    cleaned = F.lower(strip(F.coalesce("email", F.lit(""))))
    x = requests.withColumns({"email": F.when(F.coalesce(valid_email(F.col("email")), F.lit(False)), cleaned), "source": F.coalesce(strip(F.col("source")), F.lit("homepage")), "agenda_id": strip(F.col("agenda_id"))})
    firsts = x.filter("email IS NOT NULL").groupBy("email").agg(F.min("id").alias("_first")).join(existing.select("email").distinct(), "email", "left_anti")
    told = x.join(firsts, "email", "left")
    outcome = F.when(F.col("email").isNull(), "invalid").when(F.col("id") == F.col("_first"), "added").otherwise("already")
    told = told.withColumn("outcome", outcome)
    return told.filter("outcome = 'added'").select("email", "source", "agenda_id"), told.select("id", "outcome")
