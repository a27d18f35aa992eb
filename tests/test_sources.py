"""Readers, publishing, fetches and translation on small rows, against what each must give."""

import difflib
import hashlib
import json
import random

from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.operators import align, fetch, graph, oversight
from tallyweave.sources import binary, pacing, records


def test_promise_csv(spark, tmp_path):
    """Quoted line breaks and quotes, a turned header, blank lines, short rows and a mark at the start."""
    text = '\ufeffSpecific_Promise,Category,Extra,Responsible_Entity\r\n"Roads, and\nbridges ""now""",Infra,x,Office\n\n\n ,Infra,x,Office\nSchools for all\nNothing,,,"Ministry\n of it"\n'
    path = tmp_path / "p.csv"
    path.write_bytes(text.encode())
    got = sorted((r.row, r.Specific_Promise, r.Category, r.Target_Deadline, r.Responsible_Entity) for r in records.read_promise_csv(spark, str(path)).collect())
    assert got == [(1, 'Roads, and\nbridges "now"', "Infra", None, "Office"), (2, " ", "Infra", None, "Office"), (3, "Schools for all", None, None, None), (4, "Nothing", "", None, "Ministry\n of it")]
    made = records.promise_records(records.read_promise_csv(spark, str(path)), "Party")
    ids = {r.properties["title"]: r.record_identity for r in made.filter("entity_type = 'PoliticalPromise'").collect()}
    document = made.filter("entity_type = 'ManifestoDocument'").first().record_identity
    assert ids["Schools for all"] == "political_promise:" + hashlib.sha256(f"{document}|3|schools for all".encode()).hexdigest()[:16]


def test_naive_csv(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("Category,Specific_Promise,Target_Deadline,Responsible_Entity\n\nJobs,Work, for, all,Soon,Office\n,Only,,\nx,y\n")
    got = sorted(tuple(r)[1:] for r in records.read_naive_csv(spark, str(path)).collect())
    assert got[0] == ("PR-001", "Jobs", "Work, for, all", "Soon", "Office") and got[1] == ("PR-002", "Governance", "Only", "Unspecified", "Government") and got[2][:3] == ("PR-003", "x", "y")


def test_seeds_registry_and_manifest(spark, tmp_path):
    assert records.seed_nodes(spark).count() == 12
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"items": [{"id": "1", "title": "T"}, {"id": "", "title": "no"}, {"id": "2"}]}))
    assert [tuple(r) for r in records.seed_agendas(records.read_agendas(spark, str(path))).collect()] == [("1", "T", "", "High", "General Governance", "")]
    text = ["# List", "## Tier A: Official", "### Federal", "- **Book 1**", "  - Status: **Downloaded** (x.pdf)", "  - Direct URL: [u](https://a.b/c)", "- **North:** [u](https://n.o/)", "## Tier B: Parties", "- **Plan**"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "path string, n int, line string")
    assert sorted(tuple(r) for r in records.registry(lines).collect()) == [("A", "Federal", "Book 1", "Downloaded", "https://a.b/c"), ("A", "Federal", "North", "", "https://n.o/"), ("B", "Federal", "Plan", "", "")]
    got = records.read_manifest(spark, json.dumps({"sources": [{"source_path": "x/redbook.pdf", "source_tier": "B"}, "y/news.html", {"source_path": " "}]}))
    assert sorted(map(tuple, got.collect())) == [("x/redbook.pdf", "lal_kitab", "B", "tracker"), ("y/news.html", "media", "A", "tracker")]


def record(i, relations=(), kind="Alloc", props=None, **more):
    return (kind, i, 0.9, [], "allocId", i, props or {"t": i}, list(relations), None, None, "m", "s", "d", "p", "h")


def relation(dst, required, kind="FUNDS", label="Alloc"):
    return (kind, None, None, None, label, "allocId", dst, {"name": "n"}, {}, required)


def empty(spark):
    return spark.createDataFrame([], schemas.NODES), spark.createDataFrame([], schemas.EDGES)


def test_publish_fails_with_its_target(spark):
    """P has a bad relation, A requires P, B requires A: none is written; C requires D, which stands."""
    rows = spark.createDataFrame([record("P", [relation("x", False, "bad type")]), record("A", [relation("P", True)]), record("B", [relation("A", True)]), record("C", [relation("D", True)]), record("D")], schemas.RECORD)
    n, e, failures = graph.publish(*empty(spark), rows)
    assert {r.id for r in n.collect()} == {"C", "D"} and [(r.src_id, r.dst_id) for r in e.collect()] == [("C", "D")]
    assert {(r.record_id, r.error) for r in failures.collect()} == {("P", "invalid relation"), ("A", "required target is missing"), ("B", "required target is missing")}
    assert {(r.record_id, r.ok) for r in graph.outcome(rows, failures).collect()} == {("P", False), ("A", False), ("B", False), ("C", True), ("D", True)}


def test_publish_keeps_labels_apart(spark):
    """One identifier under two labels: only the label that fails falls."""
    rows = spark.createDataFrame([record("1", [relation("x", False, "bad type")]), record("1", kind="Other")], schemas.RECORD)
    n, _, _ = graph.publish(*empty(spark), rows)
    assert [(r.label, r.id) for r in n.collect()] == [("Other", "1")]


def test_publish_in_order(spark):
    rows = spark.createDataFrame([(*record("1", props={"a": "late", "b": "x"}), 2), (*record("1", props={"a": "early", "c": "y"}), 1)], schemas.RECORD + ", at int")
    n, _, _ = graph.publish(*empty(spark), rows, order="at")
    assert [r.props for r in n.collect()] == [{"a": "late", "b": "x", "c": "y"}]


def test_target_lookup(spark):
    rows = spark.createDataFrame([record("1", [relation("", True), relation("set", False)]), record("2", [relation(None, True)])], schemas.RECORD)
    edges = spark.createDataFrame([("Agenda", "k", "g", "HAS", "Alloc", "allocId", d, {}) for d in ("q", "p")], schemas.EDGES)
    lookups = spark.createDataFrame([("Alloc", "1", 0, "Agenda", "g", "HAS", "Alloc"), ("Alloc", "2", 0, "Agenda", "none", "HAS", "Alloc")], "entity_type string, node_id string, at int, " + graph.LOOKUP)
    found = graph.resolve_targets(rows, lookups, edges)
    assert {r.node_id: [x.dst_id for x in r.relations] for r in found.collect()} == {"1": ["p", "set"], "2": [None]}
    nodes = spark.createDataFrame([("Alloc", "allocId", "p", {})], schemas.NODES)
    _, e, failures = graph.publish(nodes, edges, found)
    assert ("1", "p") in {(r.src_id, r.dst_id) for r in e.collect()} and [r.record_id for r in failures.collect()] == ["2"]


def test_proposals_from_the_graph(spark):
    nodes = spark.createDataFrame(
        [("AgendaItem", "agendaItemId", "a1", {"title": "Digital procurement oversight board", "description": "Procurement contracts published with bidder records", "timeline": "100 Days"}), ("PolicyCategory", "k", "c", {"name": "Governance"}), ("SolutionPlan", "k", "s", {"payload": '{"short": ["bidder portal"]}'}), ("PoliticalPromise", "k", "p1", {"title": "Publish procurement contracts and bidder records", "summary": "Digital procurement oversight", "timeline": "100 days"}), ("ResponsibleEntity", "k", "r", {"name": "Office"})],
        schemas.NODES,
    )
    e = lambda *x: (x[0], "k", x[1], x[2], x[3], "k", x[4], {})
    edges = spark.createDataFrame([e("AgendaItem", "a1", "IN_CATEGORY", "PolicyCategory", "c"), e("AgendaItem", "a1", "HAS_SOLUTION_PLAN", "SolutionPlan", "s"), e("PoliticalPromise", "p1", "IN_CATEGORY", "PolicyCategory", "c"), e("PoliticalPromise", "p1", "ASSIGNED_TO", "ResponsibleEntity", "r")], schemas.EDGES)
    a, p = fetch.agenda_rows(nodes, edges).first(), fetch.promise_rows(nodes, edges).first()
    assert (a.category, a.solution, a.performance_targets) == ("Governance", '{"short": ["bidder portal"]}', []) and (p.category, p.responsible_entity) == ("Governance", "Office")
    reviews = spark.createDataFrame([], "entity_type string, status string, fingerprint string")
    found = fetch.proposals(nodes, edges, reviews)
    row = found.first()
    assert row.confidence >= 0.78 and row.d_solution > 0 and row.status == "pending_review"
    taken = spark.createDataFrame([("AlignmentAssessment", "approved", row.fingerprint)], reviews.schema)
    assert fetch.proposals(nodes, edges, taken).collect() == []


def test_translation(spark):
    titles = [f"title {i}" for i in range(60)]
    sizes = []

    def forward(batch):
        assert len(batch) <= 25
        return [x.upper() if x != "title 7" else "" for x in batch]

    back = lambda batch: [x.lower() if not x.endswith("9") else "zzz" for x in batch]
    got = {r.title_ne: r for r in records.translated(spark.createDataFrame([(x,) for x in titles], "title_ne string").coalesce(1), forward, back).collect()}
    assert sizes == [] and got["title 3"].title_en == "TITLE 3" and got["title 7"].title_en == "title 7" and got["title 3"].flag == "ok" and got["title 9"].flag == "uncertain"
    cache = spark.createDataFrame([("title 1", "one", "back:x")], "source string, title_en string, category string")
    fresh = spark.createDataFrame([("title 1", "b", "q"), ("title 2", "c", "q" * 300), ("title 2", "a", "r")], "title_ne string, title_en string, back string")
    assert sorted(map(tuple, records.written_back(cache, fresh).collect())) == [("title 1", "one", "back:x"), ("title 2", "a", "back:r")]


def test_similarity(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc ") for _ in range(r.randrange(12)))
    pairs = [(word(), word()) for _ in range(60)] + [(None, "a"), ("", ""), ("same text", "same text")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {x.i: x.s for x in df.select("i", binary.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.strip(), b.strip()).ratio() if a and b else 0.0
    assert got == {i: ratio(*p) for i, p in enumerate(pairs)}


def test_providers(spark):
    files = spark.createDataFrame([("a", b"123"), ("b", b"x")], "path string, content binary")
    assert {r.path: r.n_pages for r in binary.page_counts(files, lambda c: int(c) // 41).collect()} == {"a": 3, "b": 0}

    def broken(path, page):
        raise OSError(path)

    ask = binary.first_of(broken, lambda p, n: [], lambda p, n: [{"title_ne": p, "budget": str(n)}])
    wanted = spark.createDataFrame([("a", 1), ("a", 2)], "path string, page_num int")
    assert sorted((r.path, r.budget) for r in binary.seen(ask, wanted).collect()) == [("a", "1"), ("a", "2")]


def test_extract_by_kind(spark):
    rows = spark.createDataFrame([("manifesto", "manifesto_csv", "c"), ("manifesto", "scanned_manifesto_pdf", "s1"), ("manifesto", "scanned_manifesto_pdf", "s2"), ("news", "x", "n")], "source_type string, source_subtype string, source_path string")
    of = lambda name: lambda df: df.select("source_path", F.lit(name).alias("by"))
    extractors = {"manifesto_csv": of("csv"), "scanned_manifesto_pdf": of("scan"), "reviewed_scanned": lambda df: of("reviewed")(df.filter("source_path = 's1'"))}
    got = records.extract(rows, extractors, (lambda df: of("bundle")(df.filter("source_path = 'n'")),))
    assert sorted(map(tuple, got.collect())) == [("c", "csv"), ("n", "bundle"), ("s1", "reviewed"), ("s2", "scan")]
    figures = records.report(a=spark.range(1), b=spark.createDataFrame([(2, "x")], "n int, t string"))
    assert json.loads(figures.first().report) == {"a": {"id": 0}, "b": {"n": 2, "t": "x"}}


def test_overlap_topk(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    left = [(i, sorted(set(r.choices(words, k=r.randrange(1, 20))))) for i in range(60)]
    right = [(i, sorted(set(r.choices(words, k=r.randrange(1, 8))))) for i in range(20)] + [(20, [])]
    exp = sorted(((len(set(a) & set(b)), len(set(a) | set(b)), i, j) for i, a in left for j, b in right if set(a) & set(b)), key=lambda x: (-x[0] / x[1], x[2], x[3]))
    make = lambda rows, name: spark.createDataFrame(rows, f"{name} long, words array<string>")
    for k in (5, 50, 5000):
        got = [(x.shared, x.united, x.a, x.b) for x in align.overlap_topk(make(left, "a"), make(right, "b"), k).collect()]
        assert got == exp[:k]
    assert align.overlap_topk(make(left, "a").limit(0), make(right, "b"), 5).collect() == []


def test_page_images(spark):
    files = spark.createDataFrame([("a", b"xyz"), ("b", b"q")], "path string, content binary")
    wanted = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("c", 1)], "path string, page_num int")
    got = binary.page_images(files, wanted, lambda content, page, zoom: content * page + str(zoom).encode())
    assert sorted((r.path, r.page_num, bytes(r.image)) for r in got.collect()) == [("a", 1, b"xyz2.0"), ("a", 2, b"xyzxyz2.0")]


def test_pacer():
    now = [100.0]
    pacer = pacing.Pacer(600, clock=lambda: now[0])
    slept = []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pacer.acquire(600, sleep)
    assert slept == [] and pacer.left == 0
    pacer.acquire(50, sleep)
    assert abs(now[0] - 105) < 1e-6 and max(slept) <= 2
    pacer.settle(50, 20)
    assert abs(pacer.left - 30) < 1e-6
    pacer.settle(10, 1000)
    assert pacer.left == 0
    now[0] += 1000
    assert pacer.left == 600 and pacer.delay(10_000) == 0 and pacer.delay(1) > 0
    pacer.settle(10_000, 0)
    assert pacer.left == 600


def test_chain_and_trust_on_small_rows(spark):
    at = lambda i: f"2024-01-{i:02d} 00:00:00"
    rows = [("f", "federal_approval", at(1)), ("f", "federal_release", at(3)), ("f", "federal_release", at(2)), ("f", "province_release", at(9)), ("g", "no stage", at(1))]
    events = spark.createDataFrame(rows, "flow string, stage string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.flow: r for r in oversight.chain(events).collect()}
    assert (got["f"].reached, got["f"].n_missing, got["f"].first_missing) == ("province_release", 1, "province_receipt") and (got["g"].reached, got["g"].n_missing) == (None, 0)
    assert [(r.from_stage, r.seconds) for r in oversight.waits(oversight.chain(events)).collect()] == [("federal_approval", 86400.0)]
    nothing = oversight.bands(events.limit(0).withColumn("v", F.lit(1.0)), ["stage"], "v")
    assert {r.delay for r in oversight.against_bands(events.withColumn("v", F.lit(1.0)), nothing, ["stage"], "v").collect()} == {"unknown"}


def test_theta_contains(spark, monkeypatch):
    texts = spark.createDataFrame([("Abcd efg",), ("xy",), ("",), ("ABC",), (None,)], "t string")
    names = spark.createDataFrame([("bcd",), ("x",), ("Y",), ("ef",), ("abcd EFG",), ("zz",), (None,), ("",)], "n string")
    exp = sorted((t, n) for t in ("Abcd efg", "xy", "", "ABC") for n in ("bcd", "x", "Y", "ef", "abcd EFG", "zz", "") if n.lower() in t.lower())
    assert sorted(map(tuple, align.theta_contains(texts, names, "t", "n").collect())) == exp
    monkeypatch.setattr(align, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, align.theta_contains(texts, names, "t", "n").collect())) == exp
