"""Integrity checks of the graph: each a DataFrame of violations (check_name, severity, id, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MOST_PROMISES = 5
EVENTS = ("ReleaseEvent", "TransferEvent", "ReceiptEvent")


def _of(nodes: DataFrame, *labels: str) -> DataFrame:
    return nodes.filter(F.col("label").isin(*labels))


def _without(rows: DataFrame, edges: DataFrame, rel: str, *targets: str, incoming: bool = False) -> DataFrame:
    """Nodes without an edge of that type."""
    e = edges.filter(F.col("rel_type") == rel)
    if targets:
        e = e.filter(F.col("src_type" if incoming else "dst_type").isin(*targets))
    ends = e.select(F.col("dst_id" if incoming else "src_id").alias("id")).distinct()
    return rows.join(ends, "id", "left_anti")


def _with(rows: DataFrame, edges: DataFrame, rel: str) -> DataFrame:
    return rows.join(edges.filter(F.col("rel_type") == rel).select(F.col("src_id").alias("id")).distinct(), "id", "left_semi")


def _found(rows: DataFrame, name: str, severity: str, message: str | Column) -> DataFrame:
    text = message if isinstance(message, Column) else F.lit(message)
    return rows.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), "id", text.alias("message"))


def projects_have_fiscal_year(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _found(_without(_of(nodes, "Project"), edges, "FUNDED_IN", "FiscalYear"), "projects_have_fiscal_year", "critical", "project without a fiscal year")


def projects_have_titles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    blank = lambda k: F.coalesce(F.col("props")[k], F.lit("")) == ""
    return _found(_of(nodes, "Project").filter(blank("title") | blank("title_ne")), "projects_have_titles", "warning", "project without a title")


def no_excessive_promise_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    links = edges.filter((F.col("rel_type") == "FULFILLED_BY") & (F.col("dst_type") == "Project")).groupBy(F.col("dst_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return _found(links.filter(F.col("n") > MOST_PROMISES), "no_excessive_promise_links", "warning", F.concat(F.lit("project with "), F.col("n").cast("string"), F.lit(" promises")))


def no_orphan_projects(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src_id").alias("id")).unionByName(edges.select(F.col("dst_id").alias("id"))).distinct()
    return _found(_of(nodes, "Project").join(ends, "id", "left_anti"), "no_orphan_projects", "warning", "project without any edge")


def no_orphan_promises(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = _without(_of(nodes, "ManifestoPromise"), edges, "FULFILLED_BY", "Project")
    return _found(rows, "no_orphan_promises", "info", F.substring(F.coalesce(F.col("props")["text"], F.lit("")), 1, 60))


def budget_positivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    budget = F.col("props")["budget"].try_cast("double")
    return _found(_of(nodes, "Project").filter(budget.isNull() | (budget <= 0)), "budget_positivity", "critical", "budget missing or not positive")


def allocations_have_fiscal_year(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _found(_without(_of(nodes, "BudgetAllocation"), edges, "IN_FISCAL_YEAR", "FiscalYear"), "budget_allocations_have_fiscal_year", "critical", "allocation without a fiscal year")


def allocations_have_project_or_body(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = _without(_without(_of(nodes, "BudgetAllocation"), edges, "FUNDS"), edges, "MANAGED_BY")
    return _found(rows, "budget_allocations_have_project_or_body", "warning", "allocation without project or body")


def allocation_linkage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Four rules of a linkage state and what it must and must not have."""
    rows = _of(nodes, "BudgetAllocation").withColumn("state", F.col("props")["project_linkage_state"])
    name = "budget_allocation_project_linkage_consistency"
    linked = rows.filter("state = 'linked'")
    open_ = rows.filter("state IS NULL OR state IN ('unresolved_candidate', 'unlinked_accountable_body', '')")
    return (
        _found(_without(linked, edges, "FUNDS"), name, "critical", "linked without a project")
        .unionByName(_found(_with(open_, edges, "FUNDS"), name, "critical", "a project without a linked state"))
        .unionByName(_found(linked.filter(F.coalesce(F.col("props")["resolved_project_id"], F.lit("")) == ""), name, "critical", "linked without a resolved identifier"))
        .unionByName(_found(_without(rows.filter("state = 'unlinked_accountable_body'"), edges, "MANAGED_BY"), name, "warning", "an accountable body without its edge"))
    )


def events_relate_to_allocations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _found(_without(_of(nodes, *EVENTS), edges, "RELATES_TO", "BudgetAllocation"), "budget_events_relate_to_allocations", "critical", "event without an allocation")


def receipts_have_body(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _found(_without(_of(nodes, "ReceiptEvent"), edges, "RECEIVED_BY"), "receipt_events_have_receiving_body", "critical", "receipt without a receiving body")


ALL = (
    projects_have_fiscal_year,
    projects_have_titles,
    no_excessive_promise_links,
    no_orphan_projects,
    no_orphan_promises,
    budget_positivity,
    allocations_have_fiscal_year,
    allocations_have_project_or_body,
    allocation_linkage,
    events_relate_to_allocations,
    receipts_have_body,
)


def run_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All violations. A check that cannot be planned is itself a critical one."""
    out = None
    for check in ALL:
        try:
            rows = check(nodes, edges)
        except Exception as error:  # noqa: BLE001
            rows = nodes.sparkSession.createDataFrame([(check.__name__, "critical", None, str(error)[:500])], "check_name string, severity string, id string, message string")
        out = rows if out is None else out.unionByName(rows)
    return out


def report(violations: DataFrame, samples: int = 3) -> DataFrame:
    """check_name, severity, exact count, and up to that many identifiers, the smallest."""
    from pyspark.sql import Window as W

    counts = violations.groupBy("check_name", "severity").agg(F.count(F.lit(1)).alias("n"))
    few = violations.withColumn("r", F.row_number().over(W.partitionBy("check_name", "severity").orderBy("id"))).filter(F.col("r") <= samples)
    few = few.groupBy("check_name", "severity").agg(F.sort_array(F.collect_list("id")).alias("samples"))
    return counts.join(few, ["check_name", "severity"])
