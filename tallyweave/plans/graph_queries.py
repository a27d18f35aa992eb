"""Queries of the graph's operators over the driver's tables by role: the same SELECTs make nodes and edges for Spark and for DuckDB, then the library's operators
run on the one and SQL on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import routing
from tallyweave.operators import checks, fetch, graph, review, views
from tallyweave.plans.catalogue import ORACLES, QUERIES, query, t
from tallyweave.sources import records

PROPS = ("title", "title_ne", "budget", "project_linkage_state", "resolved_project_id", "text")
_S = "CAST({} AS STRING)".format
_ALLOCATION = "concat('l', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING))"
_EVENT = "CASE event_type WHEN 'purchase' THEN 'ReceiptEvent' WHEN 'click' THEN 'TransferEvent' ELSE 'ReleaseEvent' END"


def _node(label: str, key: str, node_id: str, table: str, **props: str) -> str:
    return f"SELECT {label} AS label, '{key}' AS key, {node_id} AS id, " + ", ".join(f"CAST({props.get(p, 'NULL')} AS STRING) AS {p}" for p in PROPS) + f" FROM {{{table}}}"


#: Orders are projects, their lines allocations, parts promises, nations fiscal years, suppliers bodies, and events are events.
BUDGET_NODES = (
    _node("'Project'", "projectId", "concat('o', CAST(o_orderkey AS STRING))", "orders", title="CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Road' END", title_ne="CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'n' END", budget="CASE o_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '-5' WHEN 2 THEN 'abc' ELSE CAST(o_orderkey AS STRING) END"),
    _node("'BudgetAllocation'", "budgetAllocationId", _ALLOCATION, "lineitem", project_linkage_state="CASE l_returnflag WHEN 'R' THEN 'linked' WHEN 'A' THEN CASE WHEN l_partkey % 2 = 0 THEN 'unresolved_candidate' END ELSE 'unlinked_accountable_body' END", resolved_project_id="CASE WHEN l_partkey % 3 = 0 THEN CAST(l_orderkey AS STRING) END"),
    _node("'ManifestoPromise'", "manifestoPromiseId", "concat('p', CAST(p_partkey AS STRING))", "part", text="concat(p_name, ' ', p_type, ' ', p_name, ' ', p_brand, ' ', p_type)"),
    _node("'FiscalYear'", "year", "concat('f', CAST(n_nationkey AS STRING))", "nation"),
    _node("'Organization'", "organizationId", "concat('s', CAST(s_suppkey AS STRING))", "supplier"),
    _node(_EVENT, "eventId", "concat('e', CAST(event_id AS STRING))", "events"),
)


def _edge(src: str, src_id: str, rel: str, dst: str, dst_id: str, table: str, where: str = "true") -> str:
    return f"SELECT {src} AS src_type, {src_id} AS src_id, '{rel}' AS rel_type, '{dst}' AS dst_type, {dst_id} AS dst_id FROM {{{table}}} WHERE {where}"


BUDGET_EDGES = (
    _edge("'Project'", "concat('o', CAST(o_orderkey AS STRING))", "FUNDED_IN", "FiscalYear", "concat('f', CAST(o_custkey % 25 AS STRING))", "orders", "o_orderkey % 11 <> 0"),
    _edge("'ManifestoPromise'", "concat('p', CAST(l_partkey AS STRING))", "FULFILLED_BY", "Project", "concat('o', CAST(l_orderkey AS STRING))", "lineitem", "l_orderkey % 4 = 0 AND l_partkey % 5 <> 0"),
    _edge("'BudgetAllocation'", _ALLOCATION, "IN_FISCAL_YEAR", "FiscalYear", "concat('f', CAST(l_suppkey % 25 AS STRING))", "lineitem", "l_linenumber % 4 <> 0"),
    _edge("'BudgetAllocation'", _ALLOCATION, "FUNDS", "Project", "concat('o', CAST(l_orderkey AS STRING))", "lineitem", "(l_returnflag = 'R' AND l_partkey % 5 <> 0) OR (l_returnflag = 'A' AND l_partkey % 7 = 0)"),
    _edge("'BudgetAllocation'", _ALLOCATION, "MANAGED_BY", "Organization", "concat('s', CAST(l_suppkey AS STRING))", "lineitem", "l_returnflag = 'N' AND l_suppkey % 2 = 0"),
    _edge(_EVENT, "concat('e', CAST(event_id AS STRING))", "RELATES_TO", "BudgetAllocation", "concat('l', CAST(user_id AS STRING), '-1')", "events", "event_id % 9 <> 0"),
    _edge(_EVENT, "concat('e', CAST(event_id AS STRING))", "RECEIVED_BY", "Organization", "concat('s', CAST(user_id AS STRING))", "events", "event_id % 2 = 0"),
)

STATUS_PROPS = ("title", "sourceItemId", "source_item_id", "updatedAt", "active", "priority", "timeline", "relationType", "relation_type", "approvalState", "confidence", "name", "text", "payload", "source_reference", "source_page", "source_excerpt", "category", "code", "summary")


def _status_node(label: str, key: str, node_id: str, table: str, where: str = "true", **props: str) -> str:
    return f"SELECT '{label}' AS label, '{key}' AS key, {node_id} AS id, " + ", ".join(f"CAST({props.get(p, 'NULL')} AS STRING) AS {p}" for p in STATUS_PROPS) + f" FROM {{{table}}} WHERE {where}"


_DOC, _ITEM = "concat('a', CAST(doc_id AS STRING))", "concat('b', CAST(item_id AS STRING))"
#: Documents are agenda items with plans of their own, benchmark items promises, labels assessments, nations categories, suppliers responsible bodies and regions documents.
STATUS_NODES = (
    _status_node("AgendaItem", "agendaItemId", _DOC, "documents", title="CASE WHEN doc_id % 9 <> 0 THEN substr(text, 1, 30) END", sourceItemId="CASE WHEN doc_id % 3 = 0 THEN doc_id END", source_item_id="CASE WHEN doc_id % 3 = 1 THEN doc_id END", updatedAt="CASE WHEN doc_id % 5 = 0 THEN '2024' END", active="CASE doc_id % 4 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END", priority="lang", timeline="source", category="CASE WHEN doc_id % 6 = 0 THEN 'education' END"),
    _status_node("SolutionPlan", "solutionPlanId", "concat('sp', CAST(doc_id AS STRING))", "documents", "doc_id % 2 = 0", payload="concat('plan ', CAST(doc_id AS STRING))"),
    _status_node("PerformanceTarget", "performanceTargetId", "concat('pt', CAST(doc_id AS STRING))", "documents", "doc_id % 3 = 0", text="CASE WHEN doc_id % 12 = 0 THEN ' ' ELSE concat('target ', CAST(doc_id % 50 AS STRING)) END"),
    _status_node("PoliticalPromise", "politicalPromiseId", _ITEM, "benchmark", title="substr(text, 1, 20)", source_reference="'ref'", source_page="item_id", source_excerpt="CASE WHEN item_id % 2 = 0 THEN substr(text, 1, 9) END"),
    _status_node("AlignmentAssessment", "alignmentAssessmentId", "concat('x', CAST(doc_id AS STRING))", "labels", relationType="CASE WHEN toxic = 1 THEN 'STRONGLY_ALIGNS' END", relation_type="CASE WHEN quality = 1 THEN 'PARTIALLY_ALIGNS' END", approvalState="CASE WHEN quality = 1 THEN 'approved' ELSE 'pending' END", confidence="CASE WHEN toxic = 1 THEN '0.5' END"),
    _status_node("ManifestoDocument", "manifestoDocumentId", "concat('m', CAST(r_regionkey AS STRING))", "region", name="CASE WHEN r_regionkey > 0 THEN r_name END", title="'untitled'", source_reference="CASE WHEN r_regionkey = 2 THEN 'book' END"),
    _status_node("PolicyCategory", "policyCategoryId", "concat('c', CAST(n_nationkey AS STRING))", "nation", name="CASE WHEN n_nationkey % 8 = 0 THEN '' ELSE n_name END"),
    _status_node("ResponsibleEntity", "responsibleEntityId", "concat('r', CAST(s_suppkey AS STRING))", "supplier", name="s_name"),
    _status_node("PoliticalParty", "politicalPartyId", "concat('y', CAST(r_regionkey AS STRING))", "region", code="r_name"),
)


def _status_edge(src: str, src_id: str, rel: str, dst: str, dst_id: str, table: str, where: str = "true", **props: str) -> str:
    names = ("relationType", "alignmentAssessmentId", "source_page", "source_excerpt")
    return _edge(f"'{src}'", src_id, rel, dst, dst_id, table, where).replace(" FROM {", ", " + ", ".join(f"CAST({props.get(p, 'NULL')} AS STRING) AS {p}" for p in names) + " FROM {", 1)


STATUS_EDGES = (
    _status_edge("AgendaItem", _DOC, "HAS_SOLUTION_PLAN", "SolutionPlan", "concat('sp', CAST(doc_id AS STRING))", "documents", "doc_id % 4 = 0"),
    _status_edge("AgendaItem", _DOC, "HAS_SOLUTION_PLAN", "SolutionPlan", "concat('sp', CAST(doc_id + 2 AS STRING))", "documents", "doc_id % 8 = 0"),
    _status_edge("AgendaItem", _DOC, "HAS_PERFORMANCE_TARGET", "PerformanceTarget", "concat('pt', CAST(doc_id - doc_id % 3 AS STRING))", "documents"),
    _status_edge("AgendaItem", _DOC, "IN_CATEGORY", "PolicyCategory", "concat('c', CAST(doc_id % 25 AS STRING))", "documents"),
    _status_edge("AlignmentAssessment", "concat('x', CAST(doc_id AS STRING))", "ASSESSES_AGENDA_ITEM", "AgendaItem", "concat('a', CAST(doc_id % 40 AS STRING))", "labels"),
    _status_edge("AlignmentAssessment", "concat('x', CAST(doc_id AS STRING))", "ASSESSES_POLITICAL_PROMISE", "PoliticalPromise", "concat('b', CAST(doc_id % 41 AS STRING))", "labels", "doc_id % 3 <> 0"),
    _status_edge("PoliticalPromise", "concat('b', CAST(doc_id % 40 AS STRING))", "ALIGNS_WITH_AGENDA_ITEM", "AgendaItem", "concat('a', CAST(doc_id % 60 AS STRING))", "documents", relationType="CASE WHEN doc_id % 2 = 0 THEN 'DIRECT' END", alignmentAssessmentId="CASE WHEN doc_id % 3 = 0 THEN 'x' END"),
    _status_edge("PoliticalPromise", _ITEM, "PROMISED_IN", "ManifestoDocument", "concat('m', CAST(item_id % 5 AS STRING))", "benchmark", "item_id % 7 <> 0", source_page="CASE WHEN item_id % 3 = 0 THEN 7 END", source_excerpt="CASE WHEN item_id % 5 = 0 THEN ' quoted ' END"),
    _status_edge("PoliticalPromise", _ITEM, "ASSIGNED_TO", "ResponsibleEntity", "concat('r', CAST(item_id % 10 + 1 AS STRING))", "benchmark"),
    _status_edge("PoliticalParty", "concat('y', CAST(item_id % 5 AS STRING))", "COMMITTED_TO", "PoliticalPromise", _ITEM, "benchmark"),
    _status_edge("PoliticalPromise", _ITEM, "ALIGNED_WITH", "AgendaItem", "concat('a', CAST(item_id * 3 AS STRING))", "benchmark"),
)
_TABLES = ("orders", "lineitem", "part", "nation", "supplier", "events", "documents", "benchmark", "labels", "region")
_LINK_PROPS = ("relationType", "alignmentAssessmentId", "source_page", "source_excerpt")


def _union(spark: SparkSession, d: str, parts: tuple[str, ...]) -> DataFrame:
    out = None
    for part in parts:
        one = spark.sql(part, **{x: t(spark, d, x) for x in _TABLES if f"{{{x}}}" in part})
        out = one if out is None else out.unionByName(one)
    return out


def _with_props(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]), lambda e: e["value"].isNotNull())
    return rows.withColumn("props", F.map_from_entries(entries)).drop(*names)


def budget_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = _union(spark, d, BUDGET_EDGES).withColumns({"src_key": F.lit("k"), "dst_key": F.lit("k"), "props": F.create_map().cast("map<string,string>")})
    return _with_props(_union(spark, d, BUDGET_NODES), PROPS), edges


def status_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = _with_props(_union(spark, d, STATUS_EDGES), _LINK_PROPS).withColumns({"src_key": F.lit("k"), "dst_key": F.lit("k")})
    return _with_props(_union(spark, d, STATUS_NODES), STATUS_PROPS), edges


def _duck(parts: tuple[str, ...]) -> str:
    return " UNION ALL ".join("(" + p.replace("{", "").replace("}", "") + ")" for p in parts)


_GRAPH = f"WITH nodes AS ({_duck(BUDGET_NODES)}), edges AS ({_duck(BUDGET_EDGES)})"
_STATUS = f"WITH nodes AS ({_duck(STATUS_NODES)}), edges AS ({_duck(STATUS_EDGES)})"


def _no(rel: str, *targets: str) -> str:
    to = f" AND e.dst_type IN ({', '.join(repr(x) for x in targets)})" if targets else ""
    return f"id NOT IN (SELECT src_id FROM edges e WHERE e.rel_type = '{rel}'{to})"


def _violations(name: str, severity: str, message: str, source: str) -> str:
    return f"SELECT '{name}' AS check_name, '{severity}' AS severity, id, {message} AS message FROM {source}"


_LINK = "budget_allocation_project_linkage_consistency"
_OPEN = "(project_linkage_state IS NULL OR project_linkage_state IN ('unresolved_candidate', 'unlinked_accountable_body', ''))"
CHECKS_SQL = {
    "projects_have_fiscal_year": _violations("projects_have_fiscal_year", "critical", "'project without a fiscal year'", f"nodes WHERE label = 'Project' AND {_no('FUNDED_IN', 'FiscalYear')}"),
    "projects_have_titles": _violations("projects_have_titles", "warning", "'project without a title'", "nodes WHERE label = 'Project' AND (coalesce(title, '') = '' OR coalesce(title_ne, '') = '')"),
    "no_excessive_promise_links": _violations("no_excessive_promise_links", "warning", "'project with ' || n || ' promises'", "(SELECT dst_id AS id, count(*) AS n FROM edges WHERE rel_type = 'FULFILLED_BY' AND dst_type = 'Project' GROUP BY 1) WHERE n > 5"),
    "no_orphan_projects": _violations("no_orphan_projects", "warning", "'project without any edge'", "nodes WHERE label = 'Project' AND id NOT IN (SELECT src_id FROM edges) AND id NOT IN (SELECT dst_id FROM edges)"),
    "no_orphan_promises": _violations("no_orphan_promises", "info", "substr(coalesce(text, ''), 1, 60)", f"nodes WHERE label = 'ManifestoPromise' AND {_no('FULFILLED_BY', 'Project')}"),
    "budget_positivity": _violations("budget_positivity", "critical", "'budget missing or not positive'", "nodes WHERE label = 'Project' AND coalesce(TRY_CAST(budget AS DOUBLE), 0) <= 0"),
    "allocations_have_fiscal_year": _violations("budget_allocations_have_fiscal_year", "critical", "'allocation without a fiscal year'", f"nodes WHERE label = 'BudgetAllocation' AND {_no('IN_FISCAL_YEAR', 'FiscalYear')}"),
    "allocations_have_project_or_body": _violations("budget_allocations_have_project_or_body", "warning", "'allocation without project or body'", f"nodes WHERE label = 'BudgetAllocation' AND {_no('FUNDS')} AND {_no('MANAGED_BY')}"),
    "allocation_linkage": " UNION ALL ".join(
        (
            _violations(_LINK, "critical", "'linked without a project'", f"nodes WHERE label = 'BudgetAllocation' AND project_linkage_state = 'linked' AND {_no('FUNDS')}"),
            _violations(_LINK, "critical", "'a project without a linked state'", f"nodes WHERE label = 'BudgetAllocation' AND {_OPEN} AND NOT ({_no('FUNDS')})"),
            _violations(_LINK, "critical", "'linked without a resolved identifier'", "nodes WHERE label = 'BudgetAllocation' AND project_linkage_state = 'linked' AND coalesce(resolved_project_id, '') = ''"),
            _violations(_LINK, "warning", "'an accountable body without its edge'", f"nodes WHERE label = 'BudgetAllocation' AND project_linkage_state = 'unlinked_accountable_body' AND {_no('MANAGED_BY')}"),
        )
    ),
    "events_relate_to_allocations": _violations("budget_events_relate_to_allocations", "critical", "'event without an allocation'", f"nodes WHERE label IN ('ReleaseEvent', 'TransferEvent', 'ReceiptEvent') AND {_no('RELATES_TO', 'BudgetAllocation')}"),
    "receipts_have_body": _violations("receipt_events_have_receiving_body", "critical", "'receipt without a receiving body'", f"nodes WHERE label = 'ReceiptEvent' AND {_no('RECEIVED_BY')}"),
}


def _check_query(check):
    def run(spark, d):
        return check(*budget_graph(spark, d))

    return run


for _check in checks.ALL:
    QUERIES[f"check_{_check.__name__}"] = _check_query(_check)
    ORACLES[f"check_{_check.__name__}"] = f"{_GRAPH} {CHECKS_SQL[_check.__name__]}"

_ALL_CHECKS = f"{_GRAPH}, v AS ({' UNION ALL '.join(CHECKS_SQL.values())})"


@query(f"{_ALL_CHECKS} SELECT * FROM v")
def checks_all(spark, d):
    return checks.run_all(*budget_graph(spark, d))


@query(f"{_ALL_CHECKS} SELECT check_name, severity, count(*) AS n, array_to_string(list_sort(list(id))[1:3], ',') AS samples FROM v GROUP BY 1, 2")
def checks_report(spark, d):
    return checks.report(checks.run_all(*budget_graph(spark, d))).withColumn("samples", F.array_join("samples", ","))


@query(f"{_GRAPH} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type")
def graph_statistics(spark, d):
    return graph.statistics(*budget_graph(spark, d))


@query(f"{_GRAPH}, x AS (SELECT label, CASE label WHEN 'FiscalYear' THEN 'year' WHEN 'Project' THEN 'fingerprint' END AS property, CASE label WHEN 'FiscalYear' THEN id END AS value FROM nodes UNION ALL SELECT 'FiscalYear', 'year', id FROM nodes WHERE label = 'FiscalYear' AND id < 'f2') SELECT label, property, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def constraint_audit(spark, d):
    """Fiscal years of which some stand twice."""
    nodes, _ = budget_graph(spark, d)
    return graph.duplicates(nodes.unionByName(nodes.filter("label = 'FiscalYear' AND id < 'f2'")))


_LINK_SQL = """
links AS (
  SELECT DISTINCT e.dst_id AS id, p.id AS promise_id, coalesce(p.title, '') AS promise_title, coalesce(e.relationType, 'ALIGNS_WITH_AGENDA_ITEM') AS relation_type, coalesce(e.alignmentAssessmentId, '') AS assessment_id, coalesce(m.id, '') AS document_id,
    coalesce(m.name, m.title, '') AS document_name, coalesce(m.source_reference, p.source_reference, '') AS source_reference, coalesce(pd.source_page, p.source_page) AS source_page, coalesce(pd.source_excerpt, p.source_excerpt, '') AS source_excerpt
  FROM edges e JOIN nodes p ON p.label = 'PoliticalPromise' AND p.id = e.src_id LEFT JOIN (SELECT * FROM edges WHERE rel_type = 'PROMISED_IN') pd ON pd.src_id = p.id LEFT JOIN nodes m ON m.label = 'ManifestoDocument' AND m.id = pd.dst_id WHERE e.rel_type = 'ALIGNS_WITH_AGENDA_ITEM'),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY promise_id, promise_title, relation_type, assessment_id, document_id, document_name, source_reference, source_page NULLS FIRST, source_excerpt) AS r FROM links),
told AS (SELECT id, string_agg(concat_ws('~', trim(promise_id), trim(promise_title), trim(relation_type), trim(assessment_id), trim(document_id), trim(document_name), trim(source_reference), coalesce(source_page, ''), trim(source_excerpt)), '|' ORDER BY r) AS promise_links, count(*) AS n_links FROM placed WHERE r <= 10 GROUP BY id),
kinds AS (SELECT id, array_to_string(list(type ORDER BY other)[1:10], ',') AS relation_types FROM (SELECT DISTINCT e.dst_id AS id, e.src_id AS other, coalesce(n.relationType, n.relation_type) AS type FROM edges e JOIN nodes n ON n.label = 'AlignmentAssessment' AND n.id = e.src_id WHERE e.rel_type = 'ASSESSES_AGENDA_ITEM') WHERE type IS NOT NULL GROUP BY id),
out AS (SELECT src_id AS id, rel_type, count(DISTINCT dst_id) AS n FROM edges GROUP BY 1, 2), into_ AS (SELECT dst_id AS id, rel_type, count(DISTINCT src_id) AS n FROM edges GROUP BY 1, 2)
"""


def _n_of(side: str, rel: str) -> str:
    return f"coalesce((SELECT n FROM {side} s WHERE s.id = a.id AND s.rel_type = '{rel}'), 0)"


@query(f"""
{_STATUS}, {_LINK_SQL}
SELECT trim(coalesce(sourceItemId, source_item_id, '')) AS agenda_id, a.id, coalesce(title, '') AS title, updatedAt AS updated_at, coalesce(active <> 'false', true) AS active, coalesce(priority, '') AS priority, coalesce(timeline, '') AS timeline,
  {_n_of('out', 'HAS_SOLUTION_PLAN')} AS solution_plans, {_n_of('out', 'HAS_IMPLEMENTATION_PLAN')} AS implementation_plans, {_n_of('out', 'HAS_REAL_WORLD_EVIDENCE_SUMMARY')} AS evidence, {_n_of('out', 'HAS_PERFORMANCE_TARGET')} AS performance_targets,
  {_n_of('into_', 'ASSESSES_AGENDA_ITEM')} AS assessments, coalesce(nullif({_n_of('into_', 'ALIGNS_WITH_AGENDA_ITEM')}, 0), n_links, 0) AS direct_links, coalesce(relation_types, '') AS relation_types, coalesce(promise_links, '') AS promise_links
FROM nodes a LEFT JOIN told USING (id) LEFT JOIN kinds USING (id) WHERE label = 'AgendaItem' AND trim(coalesce(sourceItemId, source_item_id, '')) <> ''
""")
def graph_status(spark, d):
    """Every agenda item's state, with its first links in nine fields each."""
    out = views.graph_status(*status_graph(spark, d))
    told = F.array_join(F.transform("promise_links", lambda x: F.concat_ws("~", *[F.coalesce(x[c], F.lit("")) for c in views.LINK])), "|")
    return out.withColumns({"promise_links": told, "relation_types": F.array_join("relation_types", ",")})


def _least_sql(rel: str, label: str, prop: str) -> str:
    return f"(SELECT min(n.{prop}) FROM edges e JOIN nodes n ON n.label = '{label}' AND n.id = e.dst_id WHERE e.src_id = a.id AND e.rel_type = '{rel}' AND trim(n.{prop}) <> '')"


@query(f"""
{_STATUS} SELECT id AS agenda_item_id, coalesce(title, '') AS title, coalesce(a.category, {_least_sql('IN_CATEGORY', 'PolicyCategory', 'name')}, '') AS category, coalesce(timeline, '') AS timeline, {_least_sql('HAS_SOLUTION_PLAN', 'SolutionPlan', 'payload')} AS solution,
  coalesce((SELECT string_agg(DISTINCT n.text, '|' ORDER BY n.text) FROM edges e JOIN nodes n ON n.label = 'PerformanceTarget' AND n.id = e.dst_id WHERE e.src_id = a.id AND e.rel_type = 'HAS_PERFORMANCE_TARGET' AND trim(n.text) <> ''), '') AS performance_targets
FROM nodes a WHERE label = 'AgendaItem'
""")
def fetch_agenda(spark, d):
    """Agenda items with what their optional edges lead to."""
    return fetch.agenda_rows(*status_graph(spark, d)).select("agenda_item_id", "title", "category", "timeline", "solution", F.array_join("performance_targets", "|").alias("performance_targets"))


@query(f"{_STATUS} SELECT id AS political_promise_id, coalesce(title, '') AS title, coalesce(a.category, {_least_sql('IN_CATEGORY', 'PolicyCategory', 'name')}, '') AS category, coalesce({_least_sql('ASSIGNED_TO', 'ResponsibleEntity', 'name')}, '') AS responsible_entity FROM nodes a WHERE label = 'PoliticalPromise'")
def fetch_promises(spark, d):
    return fetch.promise_rows(*status_graph(spark, d)).select("political_promise_id", "title", "category", "responsible_entity")


@query(f"""
{_STATUS} SELECT x.id AS assessment_id, coalesce(x.relationType, x.relation_type, 'PARTIALLY_ALIGNS') AS relation_type, coalesce(TRY_CAST(confidence AS DOUBLE), 0.0) AS confidence, approvalState AS approval_state, e.dst_id AS agenda_item_id, f.dst_id AS political_promise_id
FROM nodes x JOIN edges e ON e.src_id = x.id AND e.rel_type = 'ASSESSES_AGENDA_ITEM' JOIN edges f ON f.src_id = x.id AND f.rel_type = 'ASSESSES_POLITICAL_PROMISE'
WHERE label = 'AlignmentAssessment' AND approvalState = 'approved' AND e.dst_id IN (SELECT id FROM nodes WHERE label = 'AgendaItem') AND f.dst_id IN (SELECT id FROM nodes WHERE label = 'PoliticalPromise')
""")
def approved_alignments(spark, d):
    return fetch.approved_alignments(*status_graph(spark, d))


@query(f"""
{_STATUS}, ap AS (SELECT x.id AS assessment_id, e.dst_id AS agenda, f.dst_id AS promise FROM nodes x JOIN edges e ON e.src_id = x.id AND e.rel_type = 'ASSESSES_AGENDA_ITEM' JOIN edges f ON f.src_id = x.id AND f.rel_type = 'ASSESSES_POLITICAL_PROMISE'
  WHERE label = 'AlignmentAssessment' AND approvalState = 'approved' AND e.dst_id IN (SELECT id FROM nodes WHERE label = 'AgendaItem') AND f.dst_id IN (SELECT id FROM nodes WHERE label = 'PoliticalPromise')),
pl AS (SELECT src_id AS agenda, min(dst_id) AS plan FROM edges WHERE rel_type = 'HAS_SOLUTION_PLAN' GROUP BY 1)
SELECT assessment_id, promise AS src_id, 'ALIGNS_WITH_AGENDA_ITEM' AS rel_type, agenda AS dst_id FROM ap UNION ALL SELECT assessment_id, assessment_id, 'ASSESSES_SOLUTION_PLAN', plan FROM ap JOIN pl USING (agenda) UNION ALL SELECT assessment_id, promise, 'ALIGNS_WITH_SOLUTION_PLAN', plan FROM ap JOIN pl USING (agenda)
""")
def direct_links(spark, d):
    """The edges that approved assessments stand for, from the graph."""
    nodes, edges = status_graph(spark, d)
    plans = edges.filter("rel_type IN ('HAS_SOLUTION_PLAN', 'HAS_IMPLEMENTATION_PLAN')").select(F.col("src_id").alias("agenda_item_id"), F.col("dst_type").alias("label"), F.col("dst_id").alias("id"))
    return review.direct_links(fetch.approved_alignments(nodes, edges), plans)


@query(f"{_STATUS} SELECT y.code AS party, b.title AS promise, a.id AS agenda_id, coalesce(a.title, '') AS agenda_title FROM edges c JOIN edges w ON w.src_id = c.dst_id AND w.rel_type = 'ALIGNED_WITH' JOIN nodes y ON y.label = 'PoliticalParty' AND y.id = c.src_id JOIN nodes b ON b.label = 'PoliticalPromise' AND b.id = c.dst_id JOIN nodes a ON a.label = 'AgendaItem' AND a.id = w.dst_id WHERE c.rel_type = 'COMMITTED_TO' ORDER BY c.src_id, c.dst_id, w.dst_id LIMIT 5")
def verify_paths(spark, d):
    return fetch.verify_paths(*status_graph(spark, d))


@query("SELECT o_orderkey AS id, o_custkey AS job_id, c_name AS job_name, c_mktsegment AS job_status FROM orders JOIN customer ON c_custkey = o_custkey")
def documents_with_jobs(spark, d):
    jobs = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))
    return fetch.with_jobs(t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id")), jobs).select("id", "job_id", "job_name", "job_status")


@query("SELECT event_id AS id, ts::VARCHAR AS created FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 500")
def publish_queue(spark, d):
    reviews = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", "approved").otherwise("pending_review").alias("status"))
    return fetch.publish_queue(reviews).select("id", F.col("created_at").cast("string").alias("created"))


@query("SELECT l_orderkey, count(*) AS extracted, count(*) FILTER (l_returnflag = 'R') AS alignments, count(*) FILTER (l_returnflag = 'A') AS budget_flows FROM lineitem GROUP BY 1")
def record_counts(spark, d):
    kinds = F.when(F.col("l_returnflag") == "R", "AlignmentAssessment").when(F.col("l_returnflag") == "A", "ReceiptEvent").otherwise("Project")
    return fetch.record_counts(t(spark, d, "lineitem").select("l_orderkey", kinds.alias("entity_type")), "l_orderkey")


_FLOW_ID = "'budget_allocation:' || substr(sha256(array_to_string([l_linenumber::VARCHAR, 'road', fy, project, body, 'ref', '3'], '|')), 1, 16)"


@query(f"""
WITH x AS (SELECT *, '20' || l_linenumber AS fy, CASE WHEN l_partkey % 3 = 0 THEN 'o' || l_orderkey WHEN l_partkey % 3 = 1 THEN 'zz' ELSE '' END AS project, CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_suppkey ELSE '' END AS body FROM lineitem WHERE l_returnflag <> 'N' AND l_discount >= 0.03),
a AS (SELECT *, {_FLOW_ID} AS id, CASE WHEN project LIKE 'o%' AND l_orderkey % 2 = 0 THEN 'linked' WHEN project <> '' THEN 'unresolved_candidate' WHEN body <> '' THEN 'unlinked_accountable_body' ELSE 'unresolved_candidate' END AS state FROM x)
SELECT 'BudgetAllocation' AS entity_type, id AS record_identity, state, (1 + CASE WHEN body <> '' THEN 1 ELSE 0 END + CASE WHEN state = 'linked' THEN 1 ELSE 0 END)::INTEGER AS n_relations FROM a
UNION ALL SELECT 'ReceiptEvent', 'receipt_event:' || substr(sha256(id || '|||' || l_linenumber || '.0||' || 2), 1, 16), NULL, 1 FROM a
""")
def budget_flows(spark, d):
    """Lines as reviewed flows of bundles, an order each: allocations with their linkage, and the receipts among their events."""
    line = t(spark, d, "lineitem")
    event = F.struct(F.lit(" Receipt").alias("event_type"), F.lit("").alias("title"), F.col("l_linenumber").cast("double").alias("amount"), F.lit("").alias("event_date"), F.lit("").alias("reference_code"), F.lit("approved").alias("reviewer_status"), F.lit(False).alias("placeholder"))
    other = event.withField("event_type", F.lit("release"))
    flow = F.struct(
        F.lit("Road").alias("allocation_title"), F.lit(1.0).alias("amount"), F.concat(F.lit("20"), F.col("l_linenumber").cast("string")).alias("fiscal_year"), F.lit(3).alias("source_page"), F.when(F.col("l_discount") >= 0.03, 0.9).otherwise(0.4).alias("extraction_confidence"),
        F.when(F.col("l_returnflag") == "N", "pending").otherwise("approved").alias("reviewer_status"), F.lit(False).alias("placeholder"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).when(F.col("l_partkey") % 3 == 1, "zz").otherwise("").alias("project_id"),
        F.col("l_linenumber").cast("string").alias("allocation_code"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise("").alias("implementing_body_id"), F.array(other, event).alias("receipt_events"),
    )
    from tallyweave import schemas

    bundles = line.groupBy("l_orderkey").agg(F.collect_list(flow).alias("flows")).select(F.lit("ref").alias("source_reference"), F.lit("s").alias("source_subtype"), F.lit("approved").alias("reviewed_budget_flow_status"), F.from_json(F.to_json("flows"), f"array<struct<{schemas._FLOW}>>").alias("reviewed_budget_flows"))
    projects = t(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("project_id"))
    out = records.budget_flow_records(bundles, projects)
    return out.select("entity_type", "record_identity", F.element_at("properties", F.lit("project_linkage_state")).alias("state"), F.size("relations").alias("n_relations"))


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN ' ' || o_orderkey ELSE '' END AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'Road' ELSE '' END AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE '' END AS body, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS known FROM orders)
SELECT o_orderkey, CASE WHEN project <> '' AND known THEN 'linked' WHEN project <> '' OR name <> '' THEN 'unresolved_candidate' WHEN body <> '' THEN 'unlinked_accountable_body' ELSE 'unresolved_candidate' END AS state,
  CASE WHEN project <> '' AND known THEN o_orderkey::VARCHAR ELSE '' END AS resolved_id, CASE WHEN project <> '' AND known THEN 1 ELSE 0 END::INTEGER AS candidates, NOT ((project <> '' AND known) OR (project = '' AND name = '' AND body <> '')) AS review FROM x
""")
def flow_linkage(spark, d):
    """The state of each flow by the project that it names."""
    k = F.col("o_orderkey")
    flows = t(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise("").alias("project_id"), F.when(k % 3 == 0, "Road").otherwise("").alias("project_name"), F.when(k % 5 == 0, "b").otherwise("").alias("body_id"), F.lit("").alias("body_name"))
    projects = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("project_id"))
    return records.linkage(flows, projects).select("o_orderkey", "link.state", "link.resolved_id", "link.candidates", "link.review")


@query("""
WITH r AS (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey + 1)::VARCHAR END AS needs, o_orderkey % 10 = 0 AS odd FROM orders),
f0 AS (SELECT id FROM r WHERE odd), p0 AS (SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 2 = 0),
f1 AS (SELECT id FROM f0 UNION SELECT id FROM r WHERE needs IS NOT NULL AND needs NOT IN (SELECT id FROM p0) AND needs NOT IN (SELECT id FROM r WHERE id NOT IN (SELECT id FROM f0))),
f2 AS (SELECT id FROM f1 UNION SELECT id FROM r WHERE needs IS NOT NULL AND needs NOT IN (SELECT id FROM p0) AND needs NOT IN (SELECT id FROM r WHERE id NOT IN (SELECT id FROM f1)))
SELECT 'Project' AS record_type, id AS record_id, 'project' AS kind, id NOT IN (SELECT id FROM f2) AS ok FROM r
""")
def publish_outcome(spark, d):
    """Orders as records; some require the next order's node, and some have a relation without a type: what depends on these fails as well."""
    from tallyweave import schemas

    k = F.col("o_orderkey").cast("string")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    rel = lambda kind, dst, must: F.struct(kind.alias("relation_type"), null.alias("src_type"), null.alias("src_key"), null.alias("src_id"), F.lit("Project").alias("dst_type"), F.lit("projectId").alias("dst_key"), dst.alias("dst_id"), none.alias("dst_props"), none.alias("rel_props"), F.lit(must).alias("require_existing"))
    relations = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 == 0, rel(F.lit("NEEDS"), (F.col("o_orderkey") + 1).cast("string"), True)), F.when(F.col("o_orderkey") % 10 == 0, rel(F.lit("no type"), F.lit("x"), False))))
    rows = t(spark, d, "orders").select(F.lit("Project").alias("entity_type"), F.lit("projectId").alias("node_key"), k.alias("node_id"), F.create_map(F.lit("n"), k).alias("properties"), relations.cast(f"array<struct<{schemas.RELATION}>>").alias("relations"))
    nodes = t(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.lit("Project").alias("label"), F.lit("projectId").alias("key"), F.col("c_custkey").cast("string").alias("id"), none.alias("props"))
    _, _, failures = graph.publish(nodes, spark.createDataFrame([], schemas.EDGES), rows)
    return graph.outcome(rows, failures).drop("error")


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'budget_table' WHEN 1 THEN 'agenda_json' WHEN 2 THEN 'manifesto_csv' WHEN 3 THEN 'scanned_manifesto_pdf' WHEN 4 THEN 'manifesto_text' WHEN 5 THEN 'manifesto_text' ELSE 'none' END AS extractor FROM part")
def extract_dispatch(spark, d):
    kinds = (("lal_kitab", "manifesto_pdf"), ("manifesto", "agenda_json"), ("manifesto", "manifesto_csv"), ("manifesto", "scanned_manifesto_pdf"), ("manifesto", "manifesto_pdf"), ("news", "manifesto_pdf"), ("unknown", "unknown"))
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", records.extractor(pick(0), pick(1)).alias("extractor"))


@query("""
SELECT l_orderkey, CASE sum(l_linenumber) % 5 WHEN 0 THEN 'deterministic' WHEN 1 THEN 'deterministic' ELSE 'hybrid' END AS strategy, CASE sum(l_linenumber) % 5 WHEN 0 THEN 0.98 WHEN 1 THEN 0.98 WHEN 2 THEN 0.45 WHEN 3 THEN 0.72 ELSE 0.55 END::DOUBLE AS confidence, sum(l_linenumber) % 5 > 1 AS requires_ocr FROM lineitem GROUP BY 1
""")
def plan_strategy_kinds(spark, d):
    """The plans of documents that are no budget books."""
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"), F.sum("l_linenumber").alias("n"))
    subtype = F.element_at(F.array(*[F.lit(k) for k in ("agenda_json", "manifesto_csv", "scanned_manifesto_pdf", "manifesto_pdf", "other")]), (F.col("n") % 5 + 1).cast("int"))
    s = routing.strategy(subtype, F.lit("manifesto"), F.col("pages"), F.col("n"), F.lit(0))
    return x.select("l_orderkey", s.alias("s")).select("l_orderkey", "s.strategy", "s.confidence", "s.requires_ocr")
