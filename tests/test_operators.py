"""Matching, graph, checks, review, views and sources on small rows."""

import contextlib
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.operators import align, checks, graph, review, views
from tallyweave.sources import records
from tallyweave.streaming.gate import demand, gated

AGENDA = "agenda_item_id string, title string, description string, category string, timeline string, responsible_entity string, solution string"
PROMISE = "political_promise_id string, title string, summary string, category string, timeline string, responsible_entity string"


def test_alignment(spark):
    agenda = spark.createDataFrame(
        [
            ("a1", "Digital procurement oversight board", "Procurement contracts published with bidder records", "Governance", "100 Days", "Procurement Office", None),
            ("a2", "Mountain trails", "Repair bridges", "Tourism", "", "", None),
            ("a3", "Learning", "", "Education", "", "", json.dumps({"short": ["teacher training colleges", "rural teacher incentives"]})),
        ],
        AGENDA,
    )
    promises = spark.createDataFrame(
        [
            ("p1", "Publish procurement contracts and bidder records", "Digital procurement oversight", "Governance", "100 days", "Public Procurement Office"),
            ("p2", "Free ambulance in each ward", "", "Tourism", "", ""),
            ("p3", "teacher training and rural incentives", "teacher colleges", "Education", "", ""),
        ],
        PROMISE,
    )
    every = align.scored(align.all_pairs(agenda, promises), review_from=0.05).collect()
    blocked = align.candidates(agenda, promises, review_from=0.05).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, blocked))
    got = {(r.agenda_item_id, r.political_promise_id): r for r in blocked}
    strong = got["a1", "p1"]
    assert strong.confidence >= 0.78 and strong.category_match and strong.time_match and strong.resp_match
    assert ("a2", "p2") not in got
    assert got["a3", "p3"].d_solution > 0 and "teacher" in got["a3", "p3"].notes
    assert [r.confidence for r in blocked] == sorted((r.confidence for r in blocked), reverse=True)
    reviews = spark.createDataFrame(align.candidates(agenda, promises).limit(1).select(align.assessment_id().alias("fingerprint"), F.lit("approved").alias("status")).collect(), "fingerprint string, status string")
    assert align.without_open(align.candidates(agenda, promises), reviews).count() == align.candidates(agenda, promises).count() - 1


def test_counted_matches(spark, tmp_path):
    """Pairs are counted from one reading of the texts, and are those of all pairs: repeated rows and identifiers, long promises, hints without words."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(24)] + ["policy", "public", "reform", "the"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    topic, time, body = (lambda: rng.choice(["Health", "Tourism", "", None])), (lambda: rng.choice(["2025", "next year", "next decade", "de", "", None])), (lambda: rng.choice(["Ministry of Roads", "roads board", "Army", "", None]))
    rows = [(f"a{i}", some(12), None, topic(), time(), body(), rng.choice([None, some(9), json.dumps({"teacher": [some(9), some(3)]})]), rng.choice(["", some(9)])) for i in range(40)]
    rows += rows[:3] + [(rows[4][0], *rows[5][1:]), ("a6", "w1x w2x", *rows[6][2:]), ("", *rows[7][1:])] + [("long", " ".join(f"v{i}y" for i in range(0, 150, 3)), "", "Health", "", "", " ".join(f"v{i}y" for i in range(20, 140)), "")]
    agenda = f"{tmp_path}/agenda"
    spark.createDataFrame(rows, AGENDA + ", legal_foundation string").write.parquet(agenda)
    promises = [(f"p{i}", some(10), some(4), topic(), time(), body()) for i in range(25)]
    promises += promises[:2] + [(promises[3][0], *promises[4][1:])]
    longer = ("p_long", " ".join(f"v{i}y" for i in range(130)), "w1x policy", "Health", "2025", "Army")
    longest = ("p_longest", " ".join(f"v{i}y" for i in range(500)), "", "Health", "2025", "Army")
    once = list({r[0]: r for r in promises}.values())
    for right, least in ((promises, 0.05), ([*promises, longer], 0.36), ([*promises, longer], 0.40), ([*once, longest], 0.40)):
        a, p = spark.read.parquet(agenda), spark.createDataFrame(right, PROMISE)
        every = sorted(map(tuple, align.scored(align.all_pairs(a, p), review_from=least).collect()))
        got = align.candidates(a, p, review_from=least).collect()
        assert every and sorted(map(tuple, got)) == every, (len(right), least)
        order = [(-r.confidence, r.agenda_item_id, r.political_promise_id) for r in got]
        assert order == sorted(order)
    found = align.candidates(spark.read.parquet(agenda), spark.createDataFrame(promises, PROMISE))
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain()
    assert len(re.findall(r"FileScan parquet.*ReadSchema: struct<[^>]*\btitle:", plan.getvalue())) == 1


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(a, "k", b, rel, c, "k", d, {}) for a, b, rel, c, d in rows], schemas.EDGES)


def test_upsert_nodes(spark):
    old = nodes(spark, ("A", "k", "1", {"x": "1", "y": "2"}), ("A", "k", "2", {"x": "9"}))
    new = spark.createDataFrame([("A", "k", "1", {"y": None, "z": "3"}, 1), ("A", "k", "1", {"z": "4"}, 2), ("A", "k", "3", {}, 1)], schemas.NODES + ", seq int")
    once = graph.upsert_nodes(old, new)
    got = {r.id: r.props for r in once.collect()}
    assert got == {"1": {"x": "1", "z": "4"}, "2": {"x": "9"}, "3": {}}
    assert {r.id: r.props for r in graph.upsert_nodes(once, new).collect()} == got


def test_publish(spark):
    rel = lambda dst, required: ("FUNDS", None, None, None, "Project", "projectId", dst, {"name": "n"}, {}, required)
    rec = lambda i, relations: ("Alloc", i, 0.9, [], "allocId", i, {"t": i}, relations, None, None, "m", "s", "d", "p", "h")
    rows = spark.createDataFrame([rec("r1", [rel("p1", False)]), rec("r2", [rel("p9", True)]), rec("", [])], schemas.RECORD)
    n, e, failures = graph.publish(nodes(spark), edges(spark), rows)
    assert {r.id for r in n.collect()} == {"r1", "p1"} and [(r.src_id, r.dst_id) for r in e.collect()] == [("r1", "p1")]
    assert {(r.record_id, r.error) for r in failures.collect()} == {("r2", "required target is missing"), ("", "no key or identity")}
    n2, e2, _ = graph.publish(n, e, rows)
    assert n2.count() == 2 and e2.count() == 1


def test_checks(spark):
    n = nodes(
        spark,
        ("Project", "k", "ok", {"title": "t", "title_ne": "t", "budget": "5"}), ("Project", "k", "bad", {"title": "t", "budget": "0"}), ("FiscalYear", "year", "2081/82", {}),
        ("BudgetAllocation", "k", "b1", {"project_linkage_state": "linked", "resolved_project_id": "ok"}), ("BudgetAllocation", "k", "b2", {"project_linkage_state": "linked"}), ("BudgetAllocation", "k", "b3", {}),
        ("BudgetAllocation", "k", "b4", {"project_linkage_state": "unlinked_accountable_body"}), ("ReceiptEvent", "k", "e1", {}), ("ManifestoPromise", "k", "m1", {"text": "x" * 99}), *[("ManifestoPromise", "k", f"q{i}", {}) for i in range(6)],
    )
    e = edges(
        spark, ("Project", "ok", "FUNDED_IN", "FiscalYear", "2081/82"), ("BudgetAllocation", "b1", "FUNDS", "Project", "ok"), ("BudgetAllocation", "b1", "IN_FISCAL_YEAR", "FiscalYear", "2081/82"),
        ("BudgetAllocation", "b3", "FUNDS", "Project", "ok"), *[("ManifestoPromise", f"q{i}", "FULFILLED_BY", "Project", "ok") for i in range(6)],
    )
    got = {(r.check_name, r.id, r.message) for r in checks.run_all(n, e).collect()}
    names = lambda c: {i for x, i, _ in got if x == c}
    assert names("projects_have_fiscal_year") == names("no_orphan_projects") == names("projects_have_titles") == names("budget_positivity") == {"bad"}
    assert names("no_excessive_promise_links") == {"ok"} and names("no_orphan_promises") == {"m1"} and ("no_orphan_promises", "m1", "x" * 60) in got
    assert names("budget_allocations_have_fiscal_year") == {"b2", "b3", "b4"} and names("budget_allocations_have_project_or_body") == {"b2", "b4"}
    link = {(i, m) for c, i, m in got if c.endswith("linkage_consistency")}
    assert link == {("b2", "linked without a project"), ("b2", "linked without a resolved identifier"), ("b3", "a project without a linked state"), ("b4", "an accountable body without its edge")}
    assert names("budget_events_relate_to_allocations") == names("receipt_events_have_receiving_body") == {"e1"}
    assert {r.n for r in checks.report(checks.run_all(n, e)).filter("check_name = 'budget_allocations_have_fiscal_year'").collect()} == {3}


def test_gate_and_hold(spark):
    rows = spark.createDataFrame([("Project", "k1", "f1", 0.9, []), ("Project", "k2", "f2", 0.5, []), ("Project", "k3", "f3", 0.9, ["budget_anomaly"]), ("Project", "k4", "", None, None)], "entity_type string, record_key string, fingerprint string, confidence double, risk_flags array<string>")
    go, wait = review.gate(rows)
    assert [r.record_key for r in go.collect()] == ["k1"]
    assert {(r.record_key, r.reason, r.risk_level) for r in wait.collect()} == {("k2", "low_confidence", "medium"), ("k3", "risk:budget_anomaly", "high"), ("k4", "low_confidence", "high")}
    queue = spark.createDataFrame([("Project", "x", "f2", "resolved", 1), ("Project", "x", "f2", "pending_review", 2), ("Project", "x", "f3", "rejected", 1)], "entity_type string, record_key string, fingerprint string, status string, updated_at int")
    fresh, known = review.hold(queue, wait)
    assert [r.record_key for r in fresh.collect()] == ["k4"]
    assert {r.record_key for r in known.filter(review.counts_as_held(F.col("open_status"))).collect()} == {"k2", "k4"}


def test_status(spark):
    rows = [("j1", "published", 2, 0), ("j1", "queued", 0, 0), ("j2", "failed", 0, 0), ("j2", "published", 1, 0), ("j3", "review_hold", 1, 2), ("j4", "published", 3, 0), ("j5", "skipped", 0, 0)]
    got = {r.job_id: r.status for r in review.rollup(spark.createDataFrame(rows, "job_id string, status string, published_count long, held_count long")).collect()}
    assert got == {"j1": "running", "j2": "failed", "j3": "review_hold", "j4": "completed", "j5": "dead_letter"}


def test_links(spark):
    a = spark.createDataFrame([("as1", "ag1", "pr1"), ("as2", "ag2", "pr2")], "assessment_id string, agenda_item_id string, political_promise_id string")
    plans = spark.createDataFrame([("ag1", "SolutionPlan", "s2"), ("ag1", "SolutionPlan", "s1"), ("ag1", "ImplementationPlan", "i1")], "agenda_item_id string, label string, id string")
    links = review.direct_links(a, plans)
    assert links.filter("assessment_id = 'as1'").count() == 5 and links.filter("assessment_id = 'as2'").count() == 1
    assert {r.dst_id for r in links.collect()} == {"ag1", "ag2", "s1", "i1"}
    missing, counts = review.backfill_links(links, links.limit(0))
    assert missing.count() == 6
    again, counts = review.backfill_links(links, missing)
    assert again.count() == 0 and sum(r.existing for r in counts.collect()) == 6


def test_graph_status(spark):
    n = nodes(spark, *[("AgendaItem", "k", str(i), {"title": f"t{i}", "sourceItemId": str(i)}) for i in (1, 2, 10)], *[("PoliticalPromise", "k", f"p{i}", {"title": "x"}) for i in range(12)])
    e = edges(spark, ("AgendaItem", "1", "HAS_SOLUTION_PLAN", "SolutionPlan", "s1"), ("AgendaItem", "1", "HAS_SOLUTION_PLAN", "SolutionPlan", "s2"), *[("PoliticalPromise", f"p{i}", "ALIGNS_WITH_AGENDA_ITEM", "AgendaItem", "2") for i in range(12)])
    got = views.graph_status(n, e).collect()
    assert [r.id for r in got] == ["1", "10", "2"]
    assert got[0].solution_plans == 2 and got[2].direct_links == 12 and len(got[2].promise_links) == 10 and got[1].promise_links == []
    assert [r.id for r in views.graph_status(n, e, ["2", "1"]).collect()] == ["2", "1"]
    assert views.search(n, "T1", "id", label="AgendaItem").count() == 0 and views.page(n, "id", 1, 2).count() == 2


@pytest.fixture
def agenda_file(tmp_path):
    item = {
        "id": "7", "title": "Open procurement", "description": "d", "category": "Governance", "priority": "High", "timeline": "100 Days", "problem": {"short": "s", "long": "l"},
        "solution": {"short": ["a"], "long": {"phases": [{"phase": "1", "title": "t", "items": ["x"]}]}}, "implementation": {"long": []}, "realWorldEvidence": {"short": ["e"], "long": []}, "performanceTargets": ["p1", " ", "p2"], "legalFoundation": "Act 1",
    }
    path = tmp_path / "agenda.json"
    path.write_text(json.dumps({"owner_name": "Owner", "version": "v1", "items": [item, {"title": "Second item"}]}, indent=1))
    return str(path)


def test_agenda_records(spark, agenda_file):
    got = records.agenda_records(records.read_agendas(spark, agenda_file)).collect()
    assert [r.entity_type for r in got] == ["ManifestoDocument", "AgendaVersion", "AgendaItem", "AgendaItem"]
    kinds = [x.relation_type for x in got[2].relations]
    assert kinds == ["PART_OF_VERSION", "IN_CATEGORY", "HAS_TIMELINE_TARGET", "HAS_LEGAL_FOUNDATION", "HAS_PERFORMANCE_TARGET", "HAS_PERFORMANCE_TARGET", "HAS_PROBLEM_STATEMENT", "HAS_SOLUTION_PLAN", "HAS_IMPLEMENTATION_PLAN", "HAS_REAL_WORLD_EVIDENCE_SUMMARY"]
    assert [x.relation_type for x in got[3].relations] == ["PART_OF_VERSION"] and "category" not in got[3].properties and got[3].properties["source_item_id"] == "2"


def test_promise_records(spark, tmp_path):
    path = tmp_path / "rsp.csv"
    path.write_text('﻿Category,Specific_Promise,Target_Deadline,Responsible_Entity\nGovernance,Publish all budget decisions within 48 hours,100 Days,"Office, Prime"\nX,,,\n,Irrigation for every farmer,,\n', encoding="utf-8")
    got = records.promise_records(records.read_promise_csv(spark, str(path)), "A Party").collect()
    assert [r.entity_type for r in got] == ["PoliticalParty", "ManifestoDocument", "PoliticalPromise", "PoliticalPromise"]
    assert [x.relation_type for x in got[2].relations] == ["PROMISED_IN", "MADE_BY", "IN_CATEGORY", "HAS_TIMELINE_TARGET", "ASSIGNED_TO"]
    assert got[2].properties["responsible_entity"] == "Office, Prime" and got[3].properties["category"] == "Agriculture"


def flow(**more):
    e = lambda kind: [{"event_type": kind, "title": "t", "amount": 1.5e7, "reviewer_status": "approved", "placeholder": False, "body_id": "x"}]
    return {"allocation_title": "Road", "amount": 10.0, "fiscal_year": "2081/82", "source_page": 3, "source_excerpt": "excerpt", "extraction_confidence": 0.9, "reviewer_status": "approved", "placeholder": False, "release_events": e("release"), "transfer_events": e("transfer"), "receipt_events": e("receipt"), **more}


def test_budget_flows(spark):
    bundle = {"source_reference": "ref", "source_subtype": "s", "reviewed_budget_flow_status": "approved", "reviewed_budget_flows": [flow(project_id="P1"), flow(project_id="P9", allocation_title="Other"), flow(implementing_body_id="B", allocation_title="Body"), flow(extraction_confidence=0.5)]}
    df = spark.createDataFrame([(json.dumps(bundle),)], "j string").select(F.from_json("j", schemas.FLOW_BUNDLE).alias("b")).select("b.*")
    got = records.budget_flow_records(df, spark.createDataFrame([("P1",)], "project_id string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.entity_type, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"BudgetAllocation": 3, "ReleaseEvent": 3, "TransferEvent": 3, "ReceiptEvent": 3}
    states = {r.properties["title"]: (r.properties["project_linkage_state"], [x.relation_type for x in r.relations]) for r in by["BudgetAllocation"]}
    assert states["Road"] == ("linked", ["IN_FISCAL_YEAR", "FUNDS"]) and states["Other"] == ("unresolved_candidate", ["IN_FISCAL_YEAR"]) and states["Body"] == ("unlinked_accountable_body", ["IN_FISCAL_YEAR", "MANAGED_BY"])


def test_streaming_gate(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.9, []), ("b", 0.1, [])], "record_key string, confidence double, risk_flags array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    gated(stream, str(tmp_path / "out"), str(tmp_path / "held"), str(tmp_path / "cp")).awaitTermination(60)
    assert [r.record_key for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"] and spark.read.parquet(str(tmp_path / "held")).count() == 1
    at = spark.createDataFrame([("2024-01-01 00:00:00", "x")] * 60 + [("2024-01-02 00:00:00", "y")], "t string, place string").select(F.col("t").cast("timestamp").alias("t"), "place")
    assert {(r.place, r.route) for r in demand(at, "t", "place").collect()} == {("x", "local"), ("y", "none")}
