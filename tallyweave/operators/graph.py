"""The property graph as node and edge tables: idempotent upserts by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ("label", "key", "id")
EDGE = ("src_type", "src_key", "src_id", "rel_type", "dst_type", "dst_key", "dst_id")


def latest(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The newest row of each key; a map-side combined maximum, so that a hot key is no one task's."""
    at = F.struct(*order)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns]), at).alias("_row"))
    return best.select("_row.*")


def overlay(rows: DataFrame, keys: list[str], order: Column | str, values: list[str]) -> DataFrame:
    """For each key and column the newest value that is not null."""
    at = order if isinstance(order, Column) else F.col(order)
    newest = [F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), at)).alias(v) for v in values]
    return rows.groupBy(*keys).agg(*newest)


def merge_props(old: Column, new: Column) -> Column:
    """Existing keys overwritten, absent ones kept, a null value removes its key."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(new, empty)
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.map_contains_key(new, k))
    return F.map_filter(F.map_concat(kept, new), lambda _, v: v.isNotNull())


def upsert_nodes(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """nodes, records: label, key, id, props; records also seq. Records of one key apply in order of seq."""
    entries = records.select(*NODE, "seq", F.explode_outer(F.map_entries("props")).alias("e")).select(*NODE, "seq", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    # the last writer of each property, by a combined maximum rather than a list of all changes
    last = entries.groupBy(*NODE, "name").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    new = last.groupBy(*NODE).agg(F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "v.value"))))).alias("new"))
    merged = nodes.join(new, list(NODE), "full")
    return merged.select(*NODE, merge_props(F.col("props"), F.col("new")).alias("props"))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by their ends and type; new ones win, and repeated ones count once."""
    rows = edges.withColumn("_new", F.lit(0)).unionByName(new.select(*edges.columns).withColumn("_new", F.lit(1)))
    best = rows.groupBy(*EDGE).agg(F.max_by(F.struct(*[c for c in edges.columns if c not in EDGE], F.lit(1).alias("_any")), "_new").alias("_row"))
    return best.select(*EDGE, *[F.col(f"_row.{c}").alias(c) for c in edges.columns if c not in EDGE])


def relations_of(records: DataFrame) -> DataFrame:
    """A row per relation of the records; a relation without its own source starts at its record's node. at: its place among the record's."""
    r = records.select("entity_type", "node_key", "node_id", F.posexplode("relations").alias("at", "r"))
    return r.select(
        F.coalesce("r.src_type", "entity_type").alias("src_type"), F.coalesce("r.src_key", "node_key").alias("src_key"), F.coalesce("r.src_id", "node_id").alias("src_id"),
        F.col("r.relation_type").alias("rel_type"), F.col("r.dst_type").alias("dst_type"), F.col("r.dst_key").alias("dst_key"), F.col("r.dst_id").alias("dst_id"),
        F.col("r.rel_props").alias("props"), F.col("r.dst_props").alias("dst_props"), F.coalesce("r.require_existing", F.lit(False)).alias("require_existing"),
        F.col("entity_type").alias("record_type"), F.col("node_key").alias("record_key"), F.col("node_id").alias("record_id"), "at",
    )


#: Where relations without a target look for it: from a node along an edge type to a label; the smallest identifier counts.
LOOKUP = "from_type STRING, from_id STRING, rel_type STRING, to_type STRING"


def resolve_targets(records: DataFrame, lookups: DataFrame, edges: DataFrame) -> DataFrame:
    """records whose relations without a target get the one that their lookup finds. lookups: entity_type, node_id, at (the relation's place from 0) and
    from_type, from_id, rel_type, to_type. What is not found stays empty, so that publishing refuses the record."""
    ends = edges.select(F.col("src_type").alias("from_type"), F.col("src_id").alias("from_id"), "rel_type", F.col("dst_type").alias("to_type"), "dst_id")
    found = lookups.join(ends, ["from_type", "from_id", "rel_type", "to_type"]).groupBy("entity_type", "node_id", "at").agg(F.min("dst_id").alias("target"))
    by_place = found.groupBy("entity_type", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "target"))).alias("_targets"))
    x = records.join(by_place, ["entity_type", "node_id"], "left")
    target = lambda r, i: F.when(F.coalesce(r["dst_id"], F.lit("")) != "", r["dst_id"]).otherwise(F.element_at("_targets", i))
    relations = F.transform("relations", lambda r, i: r.withField("dst_id", target(r, i)))
    return x.withColumn("relations", F.when(F.col("_targets").isNull(), F.col("relations")).otherwise(relations)).select(*records.columns)


#: Rounds that look for records without their target; each removes those that only an earlier one's fall leaves without.
_RECORD = ("record_type", "record_key", "record_id")


def publish(nodes: DataFrame, edges: DataFrame, records: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and failures (record_type, record_key, record_id, error) after the records. A record whose required target is missing fails whole, as
    does one without key or identity; a target counts only if its node is there before, or its record survives, or a surviving record makes it. order: a
    column by which records of one node apply; the later one wins."""
    seq = F.lit(1) if order is None else F.col(order)
    named = F.coalesce("node_key", F.lit("")).rlike(r"\S") & F.coalesce("node_id", F.lit("")).rlike(r"\S") & F.coalesce("entity_type", F.lit("")).rlike(r"\S")
    key = [F.col("entity_type").alias("record_type"), F.col("node_key").alias("record_key"), F.col("node_id").alias("record_id")]
    nameless = records.filter(~named).select(*key, F.lit("no key or identity").alias("error"))
    relations = relations_of(records.filter(named))
    blank = lambda c: ~F.coalesce(c, F.lit("")).rlike(r"\S")
    wrong = relations.filter(~F.coalesce(F.col("rel_type").rlike("^[A-Z][A-Z0-9_]*$"), F.lit(False)) | blank("dst_id") | blank("dst_type") | blank("dst_key")).select(*_RECORD, F.lit("invalid relation").alias("error"))
    failures = nameless.unionByName(wrong).distinct()
    target = lambda df, label, k, i: df.select(F.col(label).alias("dst_type"), F.col(k).alias("dst_key"), F.col(i).alias("dst_id"))
    required = relations.filter("require_existing").select(*_RECORD, "dst_type", "dst_key", "dst_id").distinct()
    while True:
        alive = relations.join(failures.select(*_RECORD).distinct(), list(_RECORD), "left_anti")
        standing = records.filter(named).select(*key).distinct().join(failures.select(*_RECORD).distinct(), list(_RECORD), "left_anti")
        known = target(nodes, "label", "key", "id").unionByName(target(standing, *_RECORD)).unionByName(target(alive.filter("NOT require_existing"), "dst_type", "dst_key", "dst_id")).distinct()
        fallen = required.join(failures.select(*_RECORD).distinct(), list(_RECORD), "left_anti").join(known, ["dst_type", "dst_key", "dst_id"], "left_anti")
        fallen = fallen.select(*_RECORD, F.lit("required target is missing").alias("error")).distinct()
        if fallen.isEmpty():
            break
        failures = failures.unionByName(fallen).checkpoint() if _checkpointed(records) else failures.unionByName(fallen)
    bad = failures.select(*[F.col(c).alias(k) for c, k in zip(_RECORD, ("entity_type", "node_key", "node_id"))]).distinct()
    good = records.filter(named).join(bad, ["entity_type", "node_key", "node_id"], "left_anti")
    relations = relations_of(good)
    own = good.select(F.col("entity_type").alias("label"), F.col("node_key").alias("key"), F.col("node_id").alias("id"), F.col("properties").alias("props"), F.struct(F.lit(1).alias("own"), seq.alias("at")).alias("seq"))
    at = F.lit(None).cast(dict(own.select("seq.at").dtypes)["at"])
    targets = relations.filter("NOT require_existing").select(F.col("dst_type").alias("label"), F.col("dst_key").alias("key"), F.col("dst_id").alias("id"), F.col("dst_props").alias("props"), F.struct(F.lit(0).alias("own"), at.alias("at")).alias("seq"))
    return upsert_nodes(nodes, own.unionByName(targets)), upsert_edges(edges, relations.select(*edges.columns)), failures


def _checkpointed(df: DataFrame) -> bool:
    return not df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty()


def outcome(records: DataFrame, failures: DataFrame) -> DataFrame:
    """A row per record: record_type, record_id, kind (projects go by batches, others one by one), ok, error (the first by name)."""
    first = failures.groupBy(*_RECORD).agg(F.min("error").alias("error"))
    key = [F.col("entity_type").alias("record_type"), F.col("node_key").alias("record_key"), F.col("node_id").alias("record_id")]
    x = records.select(*key).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in _RECORD]
    out = x.join(first.alias("f"), same[0] & same[1] & same[2], "left")
    return out.select("r.record_type", "r.record_id", F.when(F.col("r.record_type") == "Project", "project").otherwise("generic").alias("kind"), F.col("error").isNull().alias("ok"), "error")


#: Labels with the one property that identifies their nodes.
UNIQUE = {
    "Project": "fingerprint",
    "FiscalYear": "year",
    "Province": "name",
    "ManifestoDocument": "manifestoDocumentId",
    "AgendaVersion": "agendaVersionId",
    "AgendaItem": "agendaItemId",
    "PoliticalPromise": "politicalPromiseId",
    "PoliticalParty": "politicalPartyId",
    "PolicyCategory": "policyCategoryId",
    "ResponsibleEntity": "responsibleEntityId",
    "TimelineTarget": "timelineTargetId",
    "LegalFoundation": "legalFoundationId",
    "PerformanceTarget": "performanceTargetId",
    "ProblemStatement": "problemStatementId",
    "SolutionPlan": "solutionPlanId",
    "ImplementationPlan": "implementationPlanId",
    "RealWorldEvidenceSummary": "realWorldEvidenceSummaryId",
    "AlignmentAssessment": "alignmentAssessmentId",
}


def duplicates(nodes: DataFrame, unique: dict[str, str] = UNIQUE) -> DataFrame:
    """An audit of the unique constraints: label, property, value and n of values that stand for more than one node. A node's value is its property of
    that name; where it has none, its identifier if that is what its key names."""
    known = nodes.sparkSession.createDataFrame(list(unique.items()), "label string, property string")
    x = nodes.join(F.broadcast(known), "label")
    value = F.coalesce(F.element_at("props", F.col("property")), F.when(F.col("key") == F.col("property"), F.col("id")))
    return x.select("label", "property", value.alias("value")).filter("value IS NOT NULL").groupBy("label", "property", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: nodes by label and edges by type, most first."""
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("node"))
    e = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e).select("kind", "name", "n").orderBy("kind", F.desc("n"), "name")


#: Words of headings that are no projects; they count as written.
HEADINGS = ("Budget Head", "Section", "Sub-section", "Page Number", "Table of Contents", "Annex", "Schedule", "Summary", "Total", "Grand Total", "Sub Total", "Description")


def noise(title: Column) -> Column:
    """Titles that are no names: digits alone, marks alone, under three characters, or with a heading's words."""
    words = F.lit(False)
    for h in HEADINGS:
        words = words | F.contains(title, F.lit(h))
    return F.coalesce(title.rlike(r"^[0-9\s]*$") | title.rlike(r"^[*|\s]*$") | (F.length(title) < 3) | words, F.lit(False))
