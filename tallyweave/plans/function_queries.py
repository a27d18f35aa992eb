"""Queries of functions and of smaller operators, each through the library's own code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions import budget, ids, routing, text
from tallyweave.operators import align, fetch, graph, review, views
from tallyweave.plans.catalogue import _normal_sql, query, t
from tallyweave.sources import records



def _key() -> Column:
    return F.col("o_orderkey")


def _pick(values, column: str, n: int):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % n + 1).cast("int"))


def _pick_sql(values, column: str, n: int) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({column} % {n} + 1)::INTEGER]"


_YEARS = ("2081/82", " 2081/82 ", "2080 / 81", "", None)


@query(f"""
WITH x AS (SELECT o_orderkey, {_pick_sql(_YEARS, 'o_orderkey', 5)} AS y FROM orders), c AS (SELECT o_orderkey, regexp_replace(trim(coalesce(y, '')), '\\s+', ' ', 'g') AS y FROM x)
SELECT o_orderkey, 'fiscal_year:' || substr(sha256(CASE WHEN y = '' THEN 'unknown' ELSE lower(y) END), 1, 16) AS id FROM c
""")
def fiscal_year_ids(spark, d):
    return t(spark, d, "orders").select("o_orderkey", ids.canonical_fiscal_year_id(_pick(_YEARS, "o_orderkey", 5)).alias("id"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN '' ELSE sha256(text) END AS digest FROM documents")
def content_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", ids.content_hash(F.encode("text", "UTF-8")).alias("digest"))


@query("SELECT p_partkey, 'PR-' || CASE WHEN length(p_partkey::VARCHAR) >= 3 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 3, '0') END AS id FROM part")
def padded_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", ids.padded_id("PR-", F.col("p_partkey")).alias("id"))


_TITLES = ("Road to the hill (cid:4)", "(cid:12) Ab", "12345678", "Bridge  over river", None)


@query(f"""
WITH x AS (SELECT o_orderkey, {_pick_sql(_TITLES, 'o_orderkey', 5)} AS t, CASE o_orderkey % 4 WHEN 0 THEN 'Rs. ' || o_orderkey WHEN 1 THEN '0' WHEN 2 THEN '9000000000000' ELSE '१२' || o_orderkey END AS raw FROM orders),
c AS (SELECT o_orderkey, raw, trim(regexp_replace(regexp_replace(coalesce(t, ''), '\\(cid:\\d+\\)', '', 'g'), '\\s+', ' ', 'g')) AS title_ne, coalesce(trunc(TRY_CAST(regexp_replace(translate(raw, '०१२३४५६७८९', '0123456789'), '[^0-9.]', '', 'g') AS DOUBLE))::BIGINT, 0) AS budget FROM x)
SELECT o_orderkey, title_ne, budget, sha256(trim(raw) || '|page:' || o_orderkey) AS budget_hash FROM c WHERE length(title_ne) >= 5 AND budget BETWEEN 1 AND 5000000000000 AND NOT regexp_matches(title_ne, '^\\d+$')
""")
def cleaned_projects(spark, d):
    """Titles and figures cleaned; noise, zero figures and those above the bound go."""
    raw = F.when(_key() % 4 == 0, F.concat(F.lit("Rs. "), _key().cast("string"))).when(_key() % 4 == 1, "0").when(_key() % 4 == 2, "9000000000000").otherwise(F.concat(F.lit("१२"), _key().cast("string")))
    rows = t(spark, d, "orders").select("o_orderkey", _pick(_TITLES, "o_orderkey", 5).alias("title_ne"), raw.alias("budget"), _key().alias("page_num"))
    return budget.clean(rows).select("o_orderkey", "title_ne", "budget", "budget_hash")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'hash_mismatch' WHEN o_orderkey % 3 = 0 THEN 'vision_source' ELSE '' END AS reason, o_orderkey % 5 <> 0 AS valid FROM orders
""")
def budget_tampering(spark, d):
    """The branches of a figure whose hash doesn't fit, and of one that was read by sight."""
    raw = _key().cast("string")
    page = F.lit(3)
    stored = F.when(_key() % 5 == 0, ids.budget_hash(raw, F.lit(4))).otherwise(ids.budget_hash(raw, page))
    c = budget.validate(F.lit(10.0), F.lit(10.0), F.lit(0.0), F.lit(9), raw=raw, page=page, stored_hash=stored, source=F.when(_key() % 3 == 0, "vision").otherwise("deterministic"))
    return t(spark, d, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.reason", "c.valid")


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 0.55 ELSE 0.88 END::DOUBLE AS confidence, p_size % 3 = 0 AS ok FROM part")
def translation_outcomes(spark, d):
    return t(spark, d, "part").select("p_partkey", text.translation_outcome(F.col("p_size") % 3).alias("o")).select("p_partkey", F.col("o.confidence").cast("double").alias("confidence"), "o.ok")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END || '|' || CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'two' END || '|three' AS texts FROM part
""")
def numbered_answers(spark, d):
    """A translator's numbered answer against its questions; a missing or blank line leaves the question."""
    first = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("1. "), "p_name")).otherwise("1. ")
    second = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("2.  "), "p_brand")).otherwise("2.")
    answer = F.concat(first, F.lit("\nno number here\n"), second)
    return t(spark, d, "part").select("p_partkey", F.array_join(text.numbered_lines(answer, F.array("p_type", F.lit("two"), F.lit("three"))), "|").alias("texts"))


_FENCED = ("```json\n{\"a\": 1}\n```", "```\n[1]```", " {\"b\": 2} ", "x ```json y``` z", "`json`{}`", None)


@query(f"""
WITH x AS (SELECT p_partkey, trim(coalesce({_pick_sql(_FENCED, 'p_partkey', 6)}, ''), ' \n') AS f FROM part)
SELECT p_partkey, trim(regexp_replace(regexp_replace(f, '^(?:```json)?(?:```)?', ''), '```$', ''), ' \n') AS ends, trim(replace(replace(f, '```json', ''), '```', ''), ' \n') AS all_, trim(replace(replace(f, '`json', ''), '`', ''), ' \n') AS ticks FROM x
""")
def fences(spark, d):
    """The three ways to take a fence off."""
    f = _pick(_FENCED, "p_partkey", 6)
    return t(spark, d, "part").select("p_partkey", text.strip_fences(f).alias("ends"), text.strip_fences(f, "all").alias("all_"), text.strip_fences(f, "ticks").alias("ticks"))


_PAYLOADS = ('{"a": "x: \\"y\\": z", "b1": {"c": [1, true, "  two  words ", null, false, 0]}}', 'plain "quoted": text', '["one", "two"]', '"just"', "", None)
_PAYLOAD_TEXTS = ('x: "y": z 1 True two words', 'plain "quoted": text', "one two", "just", "", "")


@query(f"SELECT p_partkey, {_pick_sql(_PAYLOAD_TEXTS, 'p_partkey', 6)} AS words FROM part")
def payload_texts(spark, d):
    """The text of JSON by its values, keys left out."""
    return t(spark, d, "part").select("p_partkey", text.payload_text(_pick(_PAYLOADS, "p_partkey", 6)).alias("words"))


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ' ab ' ELSE 'A long enough title' END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 2 END AS source_page, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'excerpt' END AS source_excerpt, CASE WHEN o_orderkey % 7 = 0 THEN 1.5 ELSE 0.5 END AS c FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN length(trim(title)) < 10 THEN 'title' END, CASE WHEN source_page < 1 THEN 'source_page' END, CASE WHEN length(coalesce(source_excerpt, '')) < 5 THEN 'source_excerpt' END, CASE WHEN c NOT BETWEEN 0 AND 1 THEN 'extraction_confidence' END], lambda e: e IS NOT NULL), ',') AS errors FROM x
""")
def contract_errors(spark, d):
    """What breaks the contract of a reviewed promise."""
    rows = t(spark, d, "orders").select("o_orderkey", F.when(_key() % 3 == 0, " ab ").otherwise("A long enough title").alias("title"), F.when(_key() % 4 == 0, 0).otherwise(2).alias("source_page"), F.when(_key() % 5 != 0, "excerpt").alias("source_excerpt"), F.when(_key() % 7 == 0, 1.5).otherwise(0.5).alias("extraction_confidence"))
    return schemas.with_errors(rows, "reviewed_promise").select("o_orderkey", F.array_join("_errors", ",").alias("errors"))


@query("""
SELECT p_partkey, least(p_size, CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 6 THEN 2 WHEN p_size <= 12 THEN 3 ELSE 4 END)::BIGINT AS workers, least(12.0, 0.8 * pow(2.0, p_size % 7 - 1))::DOUBLE AS wait, (floor(p_partkey / 4.0) + p_size + 120)::BIGINT AS tokens, greatest(1800, floor(p_partkey * 5000 / 900.0))::BIGINT AS image_tokens FROM part
""")
def planning_figures(spark, d):
    """Workers for a batch, the wait before another try, and estimates of tokens."""
    size = F.col("p_size")
    return t(spark, d, "part").select("p_partkey", budget.workers(size, size).cast("long").alias("workers"), budget.backoff(size % 7).alias("wait"), budget.token_estimate(F.col("p_partkey"), size).alias("tokens"), budget.image_token_estimate(F.col("p_partkey") * 5000).alias("image_tokens"))


_MAILS = ("a@b.co", " A@B.CO ", "a b@c.d", "no.at", "x@y", None)


@query(f"SELECT p_partkey, regexp_matches(lower(trim({_pick_sql(_MAILS, 'p_partkey', 6)})), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS valid FROM part")
def valid_emails(spark, d):
    return t(spark, d, "part").select("p_partkey", text.valid_email(_pick(_MAILS, "p_partkey", 6)).alias("valid"))


_FAULTS = ("Read Timeout", "HTTP 503", "no such file", "Too Many Requests", "", None)


@query(f"SELECT p_partkey, coalesce(regexp_matches(lower({_pick_sql(_FAULTS, 'p_partkey', 6)}), 'timeout|503|too many requests'), false) AS transient_ FROM part")
def transient_errors(spark, d):
    return t(spark, d, "part").select("p_partkey", text.transient_error(_pick(_FAULTS, "p_partkey", 6)).alias("transient_"))


_LISTS = ("a, b ,a,,c", "", " x ", None)


@query(f"SELECT p_partkey, {_pick_sql(('a|b|c', '', 'x', ''), 'p_partkey', 4)} AS ids FROM part")
def id_lists(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(routing.ids_of(_pick(_LISTS, "p_partkey", 4)), "|").alias("ids"))


@query("""
SELECT 'p/' || o_orderkey || '/news.html' AS source_path, CASE o_orderkey % 3 WHEN 0 THEN 'citizen' ELSE 'media' END AS source_type, CASE o_orderkey % 4 WHEN 0 THEN 'B' ELSE 'A' END AS source_tier, 'tracker' AS destination FROM orders WHERE o_orderkey % 6 <> 0
""")
def manifest_rows(spark, d):
    """A manifest's entries: blank paths go, blank and unknown choices get their defaults."""
    e = t(spark, d, "orders").select(
        F.when(_key() % 6 == 0, "  ").otherwise(F.concat(F.lit(" p/"), _key().cast("string"), F.lit("/news.html"))).alias("source_path"), F.when(_key() % 3 == 0, " citizen").when(_key() % 3 == 1, "bogus").alias("source_type"),
        F.when(_key() % 4 == 0, "B").when(_key() % 4 == 1, "Z").alias("source_tier"), F.lit("elsewhere").alias("destination"),
    )
    return records.manifest_rows(e)


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 8 <> 0 WHEN 1 THEN o_orderkey % 3 = 0 WHEN 2 THEN o_orderkey % 3 = 0 ELSE true END AS publishable FROM orders
""")
def publishable(spark, d):
    """Whether an approved item's payload may be published."""
    third = _key() % 3 == 0
    kind = _pick(("ManifestoDocument", "PoliticalPromise", "AlignmentAssessment", "Project"), "o_orderkey", 4)
    payload = (
        F.when(_key() % 4 == 0, F.to_json(F.struct(F.when(_key() % 8 == 0, "scanned_manifesto_pdf").otherwise("agenda_json").alias("source_subtype"))))
        .when(_key() % 4 == 1, F.to_json(F.struct(F.lit("A long enough title").alias("title"), F.lit("excerpt").alias("source_excerpt"), F.when(third, 0.7).otherwise(0.69).alias("extraction_confidence"), F.lit(1).alias("source_page"))))
        .when(_key() % 4 == 2, F.to_json(F.struct(F.lit("a").alias("agenda_item_id"), F.lit("b").alias("political_promise_id"), F.when(third, "approved").otherwise("open").alias("approval_state"))))
        .otherwise("{}")
    )
    return t(spark, d, "orders").select("o_orderkey", kind.alias("entity_type"), payload.alias("proposed_payload")).select("o_orderkey", review.publishable().alias("publishable"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '7') ORDER BY 1")
def admin_search(spark, d):
    """Equality filters and a text search."""
    return views.search(t(spark, d, "customer"), "7", "c_name", c_mktsegment="BUILDING").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 100 / 100.0 >= 0.6 AND o_orderkey % 100 / 100.0 < 0.85 AND contains(o_orderpriority, '1')")
def review_dashboard(spark, d):
    """The queue by status, band and text."""
    rows = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (_key() % 100 / 100).alias("confidence"), F.col("o_orderpriority").alias("record_key"), F.lit("").alias("fingerprint"))
    return views.dashboard(rows, "O", "medium", "1").select("o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100 LIMIT 20")
def paged(spark, d):
    return views.page(t(spark, d, "customer").select("c_custkey"), "c_custkey", 100, 20)


@query("SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def counted_ends(spark, d):
    edges = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), F.col("l_returnflag").alias("rel_type"))
    return views.counted(edges, "R", "parts")


@query("SELECT l_suppkey AS id, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:10], ',') AS parts FROM lineitem GROUP BY 1")
def first_ends(spark, d):
    """The first ten of each supplier's parts."""
    out = views.few(t(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("v")), "v", "parts")
    return out.select("id", F.array_join("parts", ",").alias("parts"))


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_name ELSE p_type END AS title FROM part), c AS (SELECT min(p_partkey) AS k, p_name AS source FROM part WHERE p_size < 25 GROUP BY 2)
SELECT p_partkey, 'en ' || k AS title_en FROM x LEFT JOIN c ON title = source
""")
def cached_titles(spark, d):
    """What the translation cache has of titles."""
    part = t(spark, d, "part")
    titles = part.select("p_partkey", F.when(F.col("p_partkey") % 4 < 3, F.col("p_name")).otherwise(F.col("p_type")).alias("title_ne"))
    cache = part.filter("p_size < 25").groupBy(F.col("p_name").alias("source")).agg(F.concat(F.lit("en "), F.min("p_partkey").cast("string")).alias("title_en"))
    return records.cached_translations(titles, cache)[0].select("p_partkey", "title_en")


@query("""
WITH old AS (SELECT DISTINCT p_name AS source, 'old' AS title_en FROM part WHERE p_size < 25), new AS (SELECT p_name AS source, min('en ' || p_partkey) AS title_en FROM part GROUP BY 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE source NOT IN (SELECT source FROM old)
""")
def cache_written(spark, d):
    """The cache after a batch; what it had stays."""
    part = t(spark, d, "part")
    cache = part.filter("p_size < 25").select(F.col("p_name").alias("source"), F.lit("old").alias("title_en")).distinct()
    return records.written_back(cache, part.select(F.col("p_name").alias("title_ne"), F.concat(F.lit("en "), F.col("p_partkey").cast("string")).alias("title_en"), F.lit("").alias("back"))).select("source", "title_en")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'approved' ELSE o_orderstatus END AS status FROM orders")
def bulk_actions(spark, d):
    """Many rows set to a status by their identifiers, some of them given twice."""
    rows = t(spark, d, "orders").select(_key().alias("id"), F.col("o_orderstatus").alias("status"))
    return review.bulk_action(rows, t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")), "approved")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a=new,b=2' ELSE 'a=1,b=2' END || CASE WHEN o_orderkey % 3 = 1 THEN ',c=3' ELSE '' END AS meta FROM orders")
def merged_metadata(spark, d):
    """A shallow update of a document's metadata."""
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.when(_key() % 3 == 0, F.create_map(F.lit("a"), F.lit("new"))).when(_key() % 3 == 1, F.create_map(F.lit("c"), F.lit("3")))
    entries = F.transform(F.array_sort(F.map_entries(review.merge_metadata(old, new))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(entries, ",").alias("meta"))


@query("SELECT o_orderkey, 'publish' AS stage, length(repeat('x', (o_orderkey % 6000)::BIGINT)[1:4000])::INTEGER AS detail FROM orders")
def failures_recorded(spark, d):
    """Failed items with their detail cut."""
    f = review.failure(F.lit("t"), F.lit("p"), F.lit("h"), "publish", "reason", F.repeat(F.lit("x"), (_key() % 6000).cast("int")))
    return t(spark, d, "orders").select("o_orderkey", f.alias("f")).select("o_orderkey", "f.stage", F.length("f.failure_detail").alias("detail"))


@query("""
WITH r AS (SELECT event_id, event_id % 100 / 100.0 AS c, event_id % 9 = 0 AS flagged FROM events)
SELECT event_id, CASE WHEN flagged THEN 'risk:budget_anomaly' WHEN c < 0.75 THEN 'low_confidence' END AS reason FROM r
""")
def gated(spark, d):
    """Records to publish and to hold, together all of them."""
    rows = t(spark, d, "events").select("event_id", (F.col("event_id") % 100 / 100).alias("confidence"), F.when(F.col("event_id") % 9 == 0, F.array(F.lit("budget_anomaly"))).alias("risk_flags"))
    go, wait = review.gate(rows)
    return go.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(wait.select("event_id", "reason"))


@query("SELECT o_custkey AS job, o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0")
def listings(spark, d):
    """A table in its own order (the newest first, ties by identifier)."""
    rows = t(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("job"), _key().alias("id"), F.col("o_orderdate").alias("created_at"))
    return fetch.listed(rows, "jobs").select("job", "id")


_BUNDLE = "SELECT *, l_orderkey % 2 = 0 AS fine, l_linenumber % 2 = 1 AS ok, l_discount >= 0.05 AS sure FROM lineitem"


@query(f"""
WITH x AS ({_BUNDLE}) SELECT 'political_promise:' || substr(sha256('d' || l_orderkey || '|' || l_linenumber || '|' || 'a promise of roads ' || l_partkey), 1, 16) AS record_identity, count(*) AS n, 4::INTEGER AS n_relations FROM x WHERE fine AND ok AND sure GROUP BY 1
""")
def reviewed_promises(spark, d):
    """Promises of reviewed bundles: an order's lines a bundle."""
    i = F.struct(
        F.concat(F.lit("A promise of roads "), F.col("l_partkey").cast("string")).alias("title"), F.lit("s").alias("summary"), F.lit("Tourism").alias("category"), F.lit("100 days").alias("timeline"), F.lit("Office").alias("responsible_entity"), F.lit("en").alias("language"), F.col("l_linenumber").cast("int").alias("source_page"),
        F.lit("excerpt").alias("source_excerpt"), F.when(F.col("l_discount") >= 0.05, 0.7).otherwise(0.69).alias("extraction_confidence"), F.when(F.col("l_linenumber") % 4 == 3, "approved").when(F.col("l_linenumber") % 2 == 1, "approved").otherwise("pending").alias("reviewer_status"), F.lit(False).alias("placeholder"),
    )
    k = F.col("l_orderkey")
    b = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(i).alias("reviewed_structured_promises"))
    b = b.select(F.concat(F.lit("d"), k.cast("string")).alias("manifesto_document_id"), F.lit("r").alias("source_reference"), F.lit("s").alias("source_subtype"), F.when(k % 2 == 0, "approved").otherwise("draft").alias("ocr_text_review_status"), F.lit("approved").alias("structured_promises_status"), "reviewed_structured_promises")
    return records.reviewed_promise_records(b).groupBy("record_identity").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("relations")).alias("n_relations"))


@query(f"""
WITH x AS ({_BUNDLE}) SELECT 'a' || l_orderkey AS agenda, 'b' || l_partkey AS promise, count(*) AS n FROM x WHERE fine AND ok AND sure GROUP BY 1, 2
""")
def reviewed_alignments(spark, d):
    """Assessments of reviewed bundles; they need an approved state of their own, and no confidence."""
    k = F.col("l_orderkey")
    i = F.struct(
        F.concat(F.lit("a"), k.cast("string")).alias("agenda_item_id"), F.concat(F.lit("b"), F.col("l_partkey").cast("string")).alias("political_promise_id"), F.lit("PARTIALLY_ALIGNS").alias("relation_type"), F.lit(0.1).alias("confidence"),
        F.when(F.col("l_discount") >= 0.05, "approved").otherwise("open").alias("approval_state"), F.col("l_linenumber").cast("string").alias("notes"), F.lit("approved").alias("reviewer_status"), (F.col("l_linenumber") % 2 == 0).alias("placeholder"),
    )
    b = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(i).alias("reviewed_alignment_assessments")).select(F.lit("s").alias("source_subtype"), F.when(k % 2 == 0, "approved").otherwise("draft").alias("reviewed_alignment_status"), "reviewed_alignment_assessments")
    value = lambda name: F.element_at("properties", F.lit(name))
    return records.reviewed_alignment_records(b).groupBy(value("agenda_item_id").alias("agenda"), value("political_promise_id").alias("promise")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'manifesto_document:' || substr(sha256('political_party|owner|h' || doc_id || '|scanned_manifesto_pdf'), 1, 16) AS record_identity, CASE WHEN coalesce(length(text), 0) = 0 THEN 0.40 ELSE 0.55 END::DOUBLE AS confidence FROM documents")
def scanned_documents(spark, d):
    """Provenance alone of scanned manifestos."""
    rows = t(spark, d, "documents").select(F.lit("Owner").alias("owner_name"), F.concat(F.lit("H"), F.col("doc_id").cast("string")).alias("source_hash"), F.lit("x/y.pdf").alias("source_path"), F.length("text").alias("chars"))
    return records.scanned_document_records(rows).select("record_identity", "confidence")


@query("""
WITH x AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'short' ELSE 'we will build roads ' || p_partkey END AS title, CASE WHEN p_size % 3 = 0 THEN 0.6 WHEN p_size % 3 = 1 THEN 0.995 ELSE 0.55 END AS c FROM part)
SELECT 'PoliticalPromise' AS entity_type, least(0.99, c)::DOUBLE AS confidence, CASE WHEN c < 0.7 THEN 'low_confidence' ELSE '' END AS flags, count(*) AS n FROM x WHERE length(title) >= 10 GROUP BY 1, 2, 3 UNION ALL SELECT 'ManifestoDocument', 0.99, '', count(*) FROM part
""")
def manifesto_texts(spark, d):
    """Promises that a reader found in manifestos, an answer in a fence each."""
    title = F.when(F.col("p_size") % 4 == 0, "short").otherwise(F.concat(F.lit("We will build roads "), F.col("p_partkey").cast("string")))
    score = F.when(F.col("p_size") % 3 == 0, 0.6).when(F.col("p_size") % 3 == 1, 0.995)
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct(title.alias("promise_text"), F.lit("Tourism").alias("category"), F.lit("now").alias("timeline"), score.alias("confidence")))), F.lit("\n```"))
    docs = t(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("source_path"), F.col("p_partkey").cast("string").alias("source_hash"), F.lit("owner").alias("owner_name"), answer.alias("answer"))
    return records.manifesto_records(docs).groupBy("entity_type", "confidence", F.array_join("risk_flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, 'a=' || CASE WHEN o_orderkey % 4 = 1 THEN 'new' ELSE 'old' END || CASE WHEN o_orderkey % 4 <> 2 THEN ',b=1' ELSE '' END AS props FROM orders
""")
def upsert_properties(spark, d):
    """Nodes after records: keys overwritten, kept, and removed by a null."""
    none = F.create_map().cast("map<string,string>")
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("1"))
    own = [F.lit("N").alias("label"), F.lit("k").alias("key"), _key().cast("string").alias("id")]
    nodes = t(spark, d, "orders").select(*own, base.alias("props"))
    new = F.when(_key() % 4 == 1, F.create_map(F.lit("a"), F.lit("new"))).when(_key() % 4 == 2, F.create_map(F.lit("b"), F.lit(None).cast("string"))).otherwise(none)
    recs = t(spark, d, "orders").filter("o_orderkey % 4 > 0").select(*own, new.alias("props"), F.lit(1).alias("seq"))
    entries = F.transform(F.array_sort(F.map_entries("props")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return graph.upsert_nodes(nodes, recs).select(F.col("id").cast("long").alias("o_orderkey"), F.array_join(entries, ",").alias("props"))


@query("SELECT l_orderkey::VARCHAR AS src_id, l_partkey::VARCHAR AS dst_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1, 2")
def upsert_edges_twice(spark, d):
    """Edges written twice stay one."""
    none = F.create_map().cast("map<string,string>")
    e = t(spark, d, "lineitem").select(F.lit("O").alias("src_type"), F.lit("k").alias("src_key"), F.col("l_orderkey").cast("string").alias("src_id"), F.lit("HAS").alias("rel_type"), F.lit("P").alias("dst_type"), F.lit("k").alias("dst_key"), F.col("l_partkey").cast("string").alias("dst_id"), none.alias("props"))
    return graph.upsert_edges(e.filter("src_id % 2 = 0"), e).groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, len(string_split({_normal_sql('text')}, ' ')) AS n FROM documents")
def collapsed_words(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(F.split(text.normal(F.col("text")), " ")).cast("long").alias("n"))


@query("""
WITH x AS (SELECT o_orderkey::VARCHAR AS a, o_custkey::VARCHAR AS p FROM orders)
SELECT a AS agenda_item_id, p AS political_promise_id FROM x WHERE a::BIGINT % 3 <> 0
""")
def matches_not_open(spark, d):
    """Proposed matches without those whose review is pending or approved."""
    m = t(spark, d, "orders").select(_key().cast("string").alias("agenda_item_id"), F.col("o_custkey").cast("string").alias("political_promise_id"), F.lit("PARTIALLY_ALIGNS").alias("relation_type"), F.lit("n").alias("notes"))
    taken = m.withColumn("fingerprint", align.assessment_id()).select("fingerprint", F.when(F.col("agenda_item_id").cast("long") % 3 == 0, "approved").otherwise("rejected").alias("status"))
    return align.without_open(m, taken).select("agenda_item_id", "political_promise_id")


@query("""
WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE lower('User' || o_custkey % 700 || '@Mail.org') END AS email FROM orders), f AS (SELECT email, min(id) AS first FROM x WHERE email NOT IN (SELECT 'user' || c_custkey || '@mail.org' FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1)
SELECT id, CASE WHEN x.email IS NULL THEN 'invalid' WHEN id = first THEN 'added' ELSE 'already' END AS outcome FROM x LEFT JOIN f ON x.email = f.email
""")
def subscription_outcomes(spark, d):
    """Requests to be told of news: bad addresses, known ones, and new ones once each."""
    k = F.col("o_custkey")
    mail = F.when(k % 10 == 0, "no address").otherwise(F.concat(F.lit(" User"), (k % 700).cast("string"), F.lit("@Mail.org")))
    requests = t(spark, d, "orders").select(_key().alias("id"), mail.alias("email"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("agenda_id"))
    existing = t(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.org")).alias("email"))
    return review.subscriptions(requests, existing)[1]
