"""Read views: each side is summed by entity before it is joined, so no join multiplies rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 10


def counted(edges: DataFrame, rel: str, name: str, incoming: bool = False) -> DataFrame:
    """id and the distinct ends of an edge type."""
    own, other = ("dst_id", "src_id") if incoming else ("src_id", "dst_id")
    e = edges.filter(F.col("rel_type") == rel).select(F.col(own).alias("id"), F.col(other).alias("other")).distinct()
    return e.groupBy("id").agg(F.count(F.lit(1)).alias(name))


def few(rows: DataFrame, value: str, name: str, most: int = MOST) -> DataFrame:
    """id and its smallest distinct values, at most that many; ranked before they are gathered, so a hot entity stays small."""
    ranked = rows.select("id", value).distinct().withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(value))).filter(F.col("r") <= most)
    return ranked.groupBy("id").agg(F.sort_array(F.collect_list(value)).alias(name))


#: A promise link's fields, in this order; all but the page are text.
LINK = ("promise_id", "promise_title", "relation_type", "assessment_id", "document_id", "document_name", "source_reference", "source_page", "source_excerpt")


def prop(props: str, *names: str, default: str | None = "") -> Column:
    """The first of these properties that a node or an edge has."""
    found = [F.element_at(props, F.lit(n)) for n in names]
    return F.coalesce(*found, *([] if default is None else [F.lit(default)]))


def normal_links(links: Column) -> Column:
    """Links with text trimmed and null as empty; those with neither identifier nor title go."""
    text = lambda x, c: F.trim(F.coalesce(x[c], F.lit("")))
    clean = F.transform(F.coalesce(links, F.array().cast(f"array<struct<{', '.join(f'{c}:string' for c in LINK)}>>")), lambda x: F.struct(*[(x[c] if c == "source_page" else text(x, c)).alias(c) for c in LINK]))
    return F.filter(clean, lambda x: (x["promise_id"] != "") | (x["promise_title"] != ""))


def links_of(edges: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """id and its first promise links: of each aligned promise with each document that it is promised in."""
    e = edges.filter((F.col("rel_type") == "ALIGNS_WITH_AGENDA_ITEM") & (F.col("src_type") == "PoliticalPromise")).select(F.col("dst_id").alias("id"), F.col("src_id").alias("promise"), F.col("props").alias("link"))
    promises = nodes.filter(F.col("label") == "PoliticalPromise").select(F.col("id").alias("promise"), F.col("props").alias("p"))
    promised = edges.filter((F.col("rel_type") == "PROMISED_IN") & (F.col("src_type") == "PoliticalPromise") & (F.col("dst_type") == "ManifestoDocument")).select(F.col("src_id").alias("promise"), F.col("dst_id").alias("document"), F.col("props").alias("pd"))
    documents = nodes.filter(F.col("label") == "ManifestoDocument").select(F.col("id").alias("document"), F.col("props").alias("d"))
    x = e.join(promises, "promise").join(promised.join(documents, "document"), "promise", "left")
    link = F.struct(
        F.coalesce("promise", F.lit("")).alias("promise_id"),
        prop("p", "title").alias("promise_title"),
        F.coalesce(prop("link", "relationType", "relation_type", default=None), F.lit("ALIGNS_WITH_AGENDA_ITEM")).alias("relation_type"),
        prop("link", "alignmentAssessmentId", "alignment_assessment_id").alias("assessment_id"),
        F.coalesce("document", F.lit("")).alias("document_id"),
        prop("d", "name", "title").alias("document_name"),
        F.coalesce(prop("d", "source_reference", default=None), prop("p", "source_reference")).alias("source_reference"),
        F.coalesce(prop("pd", "source_page", default=None), prop("p", "source_page", default=None)).alias("source_page"),
        F.coalesce(prop("pd", "source_excerpt", default=None), prop("p", "source_excerpt")).alias("source_excerpt"),
    )
    return few(x.select("id", link.alias("link")), "link", "promise_links", most)


def relation_types(edges: DataFrame, nodes: DataFrame, most: int = MOST) -> DataFrame:
    """id and the relation types of its first assessments, by the assessments' identifiers."""
    e = edges.filter(F.col("rel_type") == "ASSESSES_AGENDA_ITEM").select(F.col("dst_id").alias("id"), F.col("src_id").alias("other")).distinct()
    types = nodes.filter(F.col("label") == "AlignmentAssessment").select(F.col("id").alias("other"), prop("props", "relationType", "relation_type", default=None).alias("type")).filter("type IS NOT NULL")
    x = e.join(types, "other").select("id", F.struct("other", "type").alias("t"))
    return few(x, "t", "t", most).select("id", F.transform("t", lambda t: t["type"]).alias("relation_types"))


def graph_status(nodes: DataFrame, edges: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """A row per agenda item with a source identifier: its state, counts of plans, evidence, targets, assessments and links, and its first promise links;
    in the order asked for, else by that identifier as text."""
    a = nodes.filter(F.col("label") == "AgendaItem").select(
        F.trim(prop("props", "sourceItemId", "source_item_id")).alias("agenda_id"), "id", prop("props", "title").alias("title"), prop("props", "updatedAt", "updated_at", default=None).alias("updated_at"),
        F.coalesce(prop("props", "active", default=None) != "false", F.lit(True)).alias("active"), prop("props", "priority").alias("priority"), prop("props", "timeline").alias("timeline"),
    ).filter("agenda_id <> ''")
    if ids:
        a = a.filter(F.col("agenda_id").isin(*ids))
    out = a
    for rel, name, incoming in (
        ("HAS_SOLUTION_PLAN", "solution_plans", False),
        ("HAS_IMPLEMENTATION_PLAN", "implementation_plans", False),
        ("HAS_REAL_WORLD_EVIDENCE_SUMMARY", "evidence", False),
        ("HAS_PERFORMANCE_TARGET", "performance_targets", False),
        ("ASSESSES_AGENDA_ITEM", "assessments", True),
        ("ALIGNS_WITH_AGENDA_ITEM", "direct_links", True),
    ):
        out = out.join(counted(edges, rel, name, incoming), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    out = out.join(relation_types(edges, nodes), "id", "left").withColumn("relation_types", F.coalesce("relation_types", F.array().cast("array<string>")))
    out = out.join(links_of(edges, nodes), "id", "left").withColumn("promise_links", normal_links(F.col("promise_links")))
    out = out.withColumn("direct_links", F.when(F.col("direct_links") == 0, F.size("promise_links").cast("long")).otherwise(F.col("direct_links")))
    return out.orderBy(F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("agenda_id")), "agenda_id") if ids else out.orderBy("agenda_id")


#: Bands of a queue item's confidence.
BANDS = {"high": (0.85, None), "medium": (0.60, 0.85), "low": (None, 0.60)}


def in_band(score: Column, band: str) -> Column:
    """Whether a confidence is in a band; any is, where the band is none of these."""
    least, below = BANDS.get(band, (None, None))
    out = F.lit(True)
    out = out if least is None else out & (score >= least)
    return out if below is None else out & (score < below)


def dashboard(reviews: DataFrame, status: str = "", band: str = "", text: str = "") -> DataFrame:
    """The queue as a reviewer filters it: by status, band of confidence, and text in key or fingerprint."""
    rows = search(reviews, text, "record_key", "fingerprint", **({"status": status} if status else {}))
    return rows.filter(in_band(F.col("confidence"), band))


def search(rows: DataFrame, text: str, *columns: str, **equal: str) -> DataFrame:
    """Rows equal in some columns whose others hold the text, case aside."""
    hit: Column = F.lit(text == "")
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    out = rows.filter(F.coalesce(hit, F.lit(False)))
    for k, v in equal.items():
        out = out.filter(F.col(k) == v)
    return out


def page(rows: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(key).offset(offset).limit(limit)
