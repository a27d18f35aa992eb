"""Column functions against plain values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions import budget, ids, routing, taxonomy, text
from tallyweave.sources import binary


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("c")).first()[0]


def stable(prefix, *parts):
    return f"{prefix}:" + hashlib.sha256("|".join(str(p or "").strip().lower() for p in parts).encode()).hexdigest()[:16]


def test_stable_id(spark):
    assert one(spark, ids.stable_id("agenda", F.col("a"), F.col("b"), 3), a=" Title\t ", b=None) == stable("agenda", " Title\t ", None, 3)
    assert one(spark, ids.stable_id("x", ids.falsy_empty(F.col("n"))), n=0) == stable("x", 0)
    assert one(spark, ids.amount_text(F.col("n")), n=15000000.0) == "15000000.0"


def test_budget_hash(spark):
    assert one(spark, ids.budget_hash(F.col("r"), F.col("p")), r=" 12,000 ", p=7) == hashlib.sha256(b"12,000|page:7").hexdigest()


def test_fingerprint_ignores_spelling(spark):
    f = ids.project_fingerprint(F.col("a"), F.col("b"))
    assert one(spark, f, a="A  Road ", b="2081/82") == one(spark, f, a="a road", b=" 2081/82")
    assert one(spark, f, a="a road", b="2081/82") != one(spark, f, a="a road", b="2082/83")


@pytest.mark.parametrize("raw,out", [("NPR 1,234.50", 1234), ("Rs. 1,234.50", 0), ("१२३", 123), ("1.2.3", 0), ("", 0), (None, 0), ("none", 0)])
def test_normalize_budget(spark, raw, out):
    assert one(spark, budget.normalize_budget(F.col("r")), r=raw) == out


def test_clean_drops_what_breaks_the_contract(spark):
    rows = [("(cid:12) Main   road works", "1,000", 1), ("1234567", "5", 1), ("abc", "5", 1), ("Free of charge", "0", 1), ("Too much money", "6000000000000", 1)]
    got = budget.clean(spark.createDataFrame(rows, "title_ne string, budget string, page_num int")).collect()
    assert [(r.title_ne, r.budget) for r in got] == [("Main road works", 1000)]
    assert got[0].budget_hash == hashlib.sha256(b"1,000|page:1").hexdigest()


def test_validate_batch(spark):
    rows = [("a", 100 + i) for i in range(20)] + [("a", 100_000), ("a", 0), ("a", -5), ("b", 1), ("b", 10**6), ("c", 7), ("c", 6 * 10**12)]
    df = spark.createDataFrame(rows, "doc string, budget long")
    for f in (budget.validate_batch, budget.validate_batch_by_window):
        got = {(r.doc, r.budget): r.check.reason for r in f(df, "doc").collect()}
        assert got["a", 100_000] == "outlier" and got["a", 0] == got["a", -5] == "not_positive" and got["a", 105] == "" and got["b", 10**6] == "" and got["c", 6 * 10**12] == "above_bound"


def test_gate_parts(spark):
    f = lambda t, a, s: (one(spark, F.round(budget.confidence(F.col("t"), F.col("a") == 1, F.col("s")), 4), t=t, a=a, s=s), one(spark, budget.risk_flags(F.col("t"), F.col("a") == 1, F.col("s")), t=t, a=a, s=s))
    assert f("ok", 0, "deterministic") == (0.90, [])
    assert f("failed", 1, "vision") == (0.08, ["translation_uncertain", "budget_anomaly", "vision_budget"])
    assert f("uncertain", 0, "x") == (0.65, ["translation_uncertain"])


@pytest.mark.parametrize(
    "raw,title,slug,source",
    [
        ("Federalism and Local Governance", "", "federalism_local_governance", "normalized"),
        ("", "Expand irrigation canals and fertilizer access", "agriculture", "inferred"),
        ("", "Build a future-ready nation", "other", "fallback"),
        ("", "the governance of the state", "technology", "inferred"),  # a phrase counts inside words
        ("", "schools and hospitals", "education", "inferred"),  # equal scores: the first
        ("Housing & Urban Development", "x", "housing_urban_development", "normalized"),
    ],
)
def test_classify(spark, raw, title, slug, source):
    got = one(spark, taxonomy.classify(F.col("r"), F.col("t")), r=raw, t=title)
    assert (got.slug, got.source) == (slug, source)


@pytest.mark.parametrize("value,code,confidence", [("यो नेपाली वाक्य हो र लामो छ", "ne", 0.98), ("This is an English policy summary.", "en", 0.85), ("12345", "unknown", 0.2), ("", "en", 1.0), (None, "en", 1.0), ("ab яяя", "unknown", 0.4)])
def test_language(spark, value, code, confidence):
    got = one(spark, text.language(F.col("t")), t=value)
    assert (got.code, got.confidence) == (code, confidence)


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="The Road, and road 2081 of school-99x in a b12") == ["road", "school", "99x", "b12"]
    assert one(spark, text.signals(text.tokens(F.col("t"))), t="public school reform") == ["school"]
    assert one(spark, text.numbered_lines(F.col("r"), F.col("o")), r="1. one\nnoise\n2.two", o=["a", "b", "c"]) == ["one", "two", "c"]
    assert one(spark, text.category_key(F.col("t")), t="Housing & Urban Development") == "infrastructure"


def test_garbled(spark):
    g = text.garbled(F.col("t"))
    assert [one(spark, g, t=x) for x in ("plain words, all.", "(cid:3) x", "%%%%ab", "", None)] == [False, True, True, True, True]


@pytest.mark.parametrize(
    "path,kind,subtype",
    [
        ("/d/federal/redbook_2081_82.pdf", "lal_kitab", "lal_kitab"),
        ("/d/agenda/1.json", "manifesto", "agenda_json"),
        ("/d/rsp/promises.csv", "manifesto", "manifesto_csv"),
        ("/d/bacha_patra.pdf", "manifesto", "scanned_manifesto_pdf"),
        ("/d/Manifesto.pdf", "manifesto", "manifesto_pdf"),
        ("/d/citizen.txt", "citizen", "citizen"),
        ("/d/news.txt", "media", "media"),
        ("/d/file", "other", "other"),
    ],
)
def test_routes(spark, path, kind, subtype):
    assert one(spark, routing.source_type(F.col("p")), p=path) == kind
    assert one(spark, routing.source_subtype(F.col("p"), F.lit(""), routing.source_type(F.col("p"))), p=path) == subtype


def test_scope_and_year(spark):
    assert tuple(one(spark, routing.scope(F.col("p")), p="/x/Province/Bagmati/file.pdf")) == ("provincial", "Bagmati")
    assert tuple(one(spark, routing.scope(F.col("p")), p="/x/federal/file.pdf")) == ("federal", "")
    assert one(spark, routing.fiscal_year(F.col("p")), p="book_2081-82.pdf") == "2081/82" and one(spark, routing.fiscal_year(F.col("p")), p=None) == "unknown"
    assert one(spark, routing.ids_of(F.col("p")), p=" 3, 1,,3 ,2") == ["3", "1", "2"]


@pytest.mark.parametrize("pages,rows,bad,out", [(10, 0, 0, "vision"), (10, 4, 0, "vision"), (10, 10, 0, "hybrid"), (10, 20, 2, "vision"), (100, 20, 1, "hybrid"), (10, 20, 1, "deterministic")])
def test_strategy(spark, pages, rows, bad, out):
    got = one(spark, routing.strategy(F.lit("lal_kitab"), F.lit("lal_kitab"), F.col("p"), F.col("r"), F.col("b")), p=pages, r=rows, b=bad)
    assert got.strategy == out


def test_similarity_and_misc(spark):
    from difflib import SequenceMatcher

    assert one(spark, binary.similarity(F.col("a"), F.col("b")), a="road works", b="road work") == SequenceMatcher(None, "road works", "road work").ratio()
    assert one(spark, binary.translation_flag(F.col("a"), F.col("b")), a="abc", b=None) == "uncertain"
    assert [one(spark, budget.workers(F.col("n"), F.lit(4)), n=n) for n in (2, 6, 12, 13)] == [1, 2, 3, 4]
    assert one(spark, text.transient_error(F.col("m")), m="HTTP 503 from service") and not one(spark, text.transient_error(F.col("m")), m="bad value")
    assert one(spark, text.strip_fences(F.col("m")), m='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, ids.padded_id("PR-", F.col("n")), n=7) == "PR-007"


def test_contracts(spark):
    df = spark.createDataFrame([("Release ", 5.0), ("refund", -1.0)], "event_type string, amount double")
    assert [r._errors for r in schemas.with_errors(df, "flow_event").collect()] == [[], ["event_type", "amount"]]
