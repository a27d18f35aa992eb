"""The queries of the operators over the driver's tables, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import budget, ids, routing, taxonomy, text
from tallyweave.operators import align, graph, review
from tallyweave.sources import binary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def case(column: str, choices: dict, otherwise: str | None = None) -> Column:
    out = None
    for k, v in choices.items():
        out = F.when(F.col(column) == k, F.lit(v)) if out is None else out.when(F.col(column) == k, F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


def sql_case(column: str, choices: dict, otherwise: str = "NULL") -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in choices.items()) + f" ELSE {otherwise} END"


SEGMENTS = {
    "BUILDING": "Affordable housing and zoning for urban wards",
    "AUTOMOBILE": "Bus & railway transit, new roads",
    "MACHINERY": "Vocational skills training and jobs",
    "HOUSEHOLD": "Drinking water supply / sanitation",
    "FURNITURE": "Build a future-ready nation",
}
RAW = {"1-URGENT": "Federalism & Local Governance", "2-HIGH": "social_protection", "3-MEDIUM": "Agri", "4-NOT SPECIFIED": "General", "5-LOW": "unknown words"}


def _slugs_sql(expr: str) -> str:
    """Slug of a plain text's best category, or null."""
    scores = []
    for i, (slug, _, _, words) in enumerate(taxonomy.CATEGORIES):
        if words:
            total = " + ".join(f"(CASE WHEN contains({expr}, '{k}') THEN 3 ELSE 0 END)" if " " in k else f"(CASE WHEN regexp_matches({expr}, '\\b{k}(s|es)?\\b') THEN 1 ELSE 0 END)" for k in words)
            scores.append(f"struct_pack(s := {total}, o := {-i}, slug := '{slug}')")
    return f"list_max([{', '.join(scores)}])"


def _alias_sql(expr: str) -> str:
    return "CASE " + expr + "".join(f" WHEN '{a}' THEN '{s}'" for a, s in taxonomy.aliases().items()) + " END"


def _plain_sql(expr: str) -> str:
    return f"trim(regexp_replace(replace(lower(coalesce({expr}, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


_CLASSIFIED = f"""
WITH x AS (SELECT c_custkey, {_plain_sql(sql_case('c_mktsegment', SEGMENTS))} AS p FROM customer),
s AS (SELECT c_custkey, {_slugs_sql('p')} AS b FROM x)
SELECT c_custkey, CASE WHEN b.s > 0 THEN b.slug ELSE 'other' END AS slug, CASE WHEN b.s > 0 THEN 'inferred' ELSE 'fallback' END AS source FROM s
"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    c = taxonomy.classify(F.lit(""), case("c_mktsegment", SEGMENTS))
    return t(spark, d, "customer").select("c_custkey", c.alias("c")).select("c_custkey", "c.slug", "c.source")


@query(_CLASSIFIED)
def category_classify(spark, d):
    return _classified(spark, d)


@query(f"SELECT slug, source, count(*) AS n FROM ({_CLASSIFIED}) GROUP BY slug, source")
def category_counts(spark, d):
    return _classified(spark, d).groupBy("slug", "source").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, coalesce({_alias_sql(_plain_sql(sql_case('o_orderpriority', RAW)))}, 'none') AS slug, {_plain_sql(sql_case('o_orderpriority', RAW))} AS plain FROM orders")
def category_alias_norm(spark, d):
    raw = case("o_orderpriority", RAW)
    known = F.create_map(*[F.lit(x) for pair in taxonomy.aliases().items() for x in pair])
    return t(spark, d, "orders").select("o_orderkey", F.coalesce(F.element_at(known, text.plain(raw)), F.lit("none")).alias("slug"), text.plain(raw).alias("plain"))


@query("SELECT p_partkey, 'part:' || substr(sha256(lower(trim(p_brand)) || '|' || lower(trim(p_type)) || '|' || CASE WHEN p_partkey % 10 = 0 THEN '' ELSE (p_partkey % 10)::VARCHAR END), 1, 16) AS id FROM part")
def stable_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", ids.stable_id("part", F.col("p_brand"), F.col("p_type"), ids.falsy_empty(F.col("p_partkey") % 10)).alias("id"))


#: White space in the Unicode sense, as a class of DuckDB's expressions.
_WHITE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _normal_sql(expr: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({expr}, ''), '{_WHITE}', ' ', 'g')))"


@query(f"""
WITH n AS (SELECT doc_id, sha256({_normal_sql('source')} || '|' || {_normal_sql('text')}) AS fingerprint FROM documents)
SELECT fingerprint, max(doc_id) AS doc_id FROM n GROUP BY fingerprint
""")
def fingerprints_dedup(spark, d):
    rows = t(spark, d, "documents").select("doc_id", ids.project_fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))
    return graph.latest(rows, ["fingerprint"], ["doc_id"])


@query("""
WITH x AS (SELECT o_orderkey, o_custkey, sha256(o_orderkey::VARCHAR || '|page:' || CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END) AS stored FROM orders)
SELECT o_orderkey, stored, sha256(o_orderkey::VARCHAR || '|page:' || o_custkey) = stored AS verified FROM x
""")
def budget_hash_check(spark, d):
    page = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    x = t(spark, d, "orders").select("o_orderkey", "o_custkey", ids.budget_hash(F.col("o_orderkey"), page).alias("stored"))
    return x.select("o_orderkey", "stored", (ids.budget_hash(F.col("o_orderkey"), F.col("o_custkey")) == F.col("stored")).alias("verified"))


@query(f"SELECT doc_id, sha256({_normal_sql('text')}) AS digest FROM documents")
def norm_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(text.normal(F.col("text")), 256).alias("digest"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace('(cid:' || p_size || ')  ' || p_name || ' (cid:1)', '\(cid:\d+\)', '', 'g'), '\s+', ' ', 'g')) AS title FROM part")
def clean_cid(spark, d):
    return t(spark, d, "part").select("p_partkey", text.clean_cid(F.concat(F.lit("(cid:"), "p_size", F.lit(")  "), "p_name", F.lit(" (cid:1)"))).alias("title"))


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Rs. ' || o_orderkey || ',' || o_custkey WHEN 1 THEN o_orderkey || '.75' WHEN 2 THEN '1.2.' || o_orderkey ELSE 'none' END AS raw FROM orders)
SELECT o_orderkey, raw, coalesce(trunc(TRY_CAST(regexp_replace(raw, '[^0-9.]', '', 'g') AS DOUBLE))::BIGINT, 0) AS budget FROM x
""")
def clean_budget(spark, d):
    k = F.col("o_orderkey")
    s = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("Rs. "), s, F.lit(","), F.col("o_custkey").cast("string"))).when(k % 4 == 1, F.concat(s, F.lit(".75"))).when(k % 4 == 2, F.concat(F.lit("1.2."), s)).otherwise("none")
    return t(spark, d, "orders").select("o_orderkey", raw.alias("raw")).withColumn("budget", budget.normalize_budget(F.col("raw")))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_WEAK = ", ".join(f"'{w}'" for w in text.WEAK_SIGNALS)


def _tokens_sql(expr: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({expr}, '')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_STOP})))"


@query(f"SELECT item_id, array_to_string(list_sort({_tokens_sql('text')}), ' ') AS words, len(list_filter({_tokens_sql('text')}, lambda w: w NOT IN ({_WEAK}))) AS n_signals FROM benchmark")
def tokens_distinct(spark, d):
    words = text.tokens(F.col("text"))
    return t(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(words), " ").alias("words"), F.size(text.signals(words)).cast("long").alias("n_signals"))


@query(f"""
WITH d AS (SELECT doc_id, {_tokens_sql('text')} AS a FROM documents), b AS (SELECT item_id, {_tokens_sql('text')} AS p FROM benchmark),
x AS (SELECT doc_id, item_id, len(list_intersect(a, p)) AS shared, len(a) + len(p) - len(list_intersect(a, p)) AS all_ FROM d, b WHERE len(a) > 0 AND len(p) > 0)
SELECT doc_id, item_id, shared::BIGINT AS shared, all_::BIGINT AS united FROM x WHERE shared > 0 ORDER BY shared / all_::DOUBLE DESC, doc_id, item_id LIMIT 100
""")
def token_jaccard_topk(spark, d):
    """The 100 pairs of a document and an item that are most alike."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("a"), text.tokens(F.col("text")).alias("words"))
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("b"), text.tokens(F.col("text")).alias("words"))
    return align.overlap_topk(docs, items, 100).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "shared", "united")


TOPICS = ("education", "health", "energy", "transport", "tourism")


def _roles(spark: SparkSession, d: str, fields: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents as agenda items, benchmark items as promises. fields: with a solution in JSON and a legal foundation."""
    topic = lambda c: F.element_at(F.array(*[F.lit(x) for x in TOPICS]), (F.col(c) % 5 + 1).cast("int"))
    a = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("agenda_item_id"), F.col("text").alias("title"), topic("doc_id").alias("category"), F.col("source").alias("responsible_entity"), F.col("lang").alias("timeline"), "doc_id", "text")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " ")
    if fields:
        a = a.withColumns({"solution": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"short": ["one", "'), plain, F.lit('"], "teacher": 1}'))).otherwise(""), "legal_foundation": F.when(F.col("doc_id") % 2 == 0, plain).otherwise("")})
    a = a.drop("doc_id", "text")
    p = t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("political_promise_id"), F.col("text").alias("title"), topic("item_id").alias("category"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("responsible_entity"), F.lit("en").alias("timeline"))
    return a, p


_TOPIC_SQL = "['education', 'health', 'energy', 'transport', 'tourism']"


def _contribution_sql(words: str, most: float, cap: int) -> str:
    shared = f"len(list_intersect({words}, sp))"
    j = f"CASE WHEN len({words}) = 0 OR len(sp) = 0 THEN 0 ELSE {shared} / (len({words}) + len(sp) - {shared})::DOUBLE END"
    weight = f"greatest({j}, least(1.0, {shared} / {cap}::DOUBLE) * 0.18::DOUBLE)"
    return f"CASE WHEN {weight} > 0 THEN round_even(least({most}::DOUBLE, {weight} * ({most}::DOUBLE / 0.18::DOUBLE)), 3) ELSE 0.0 END::DOUBLE"


def _align_sql(select: str, fields: bool = False, least: float = 0.40) -> str:
    plain = "regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')"
    sol = _tokens_sql(f"CASE WHEN doc_id % 3 = 0 THEN 'one ' || {plain} || ' 1' ELSE '' END") if fields else "[]::VARCHAR[]"
    legal = _tokens_sql(f"CASE WHEN doc_id % 2 = 0 THEN {plain} ELSE '' END") if fields else "[]::VARCHAR[]"
    own = lambda x: f"list_filter({x}, lambda w: w NOT IN ({_WEAK}))"
    few = lambda x, n: f"list_sort({x})[1:{n}]"
    return f"""
WITH a AS (SELECT doc_id::VARCHAR AS a_id, {_TOPIC_SQL}[doc_id % 5 + 1] AS a_key, {_tokens_sql('text')} AS aw, {own(sol)} AS f1, {own(legal)} AS f2, lower(source) AS a_resp, lower(lang) AS a_time FROM documents),
p AS (SELECT item_id::VARCHAR AS p_id, {_TOPIC_SQL}[item_id % 5 + 1] AS p_key, {_tokens_sql('text')} AS pw, 'src' || (item_id % 20) AS p_resp FROM benchmark),
x AS (SELECT a_id, p_id, a_key, a_key = p_key AS cat, list_intersect(aw, pw) AS sh, len(aw) AS na, len(pw) AS np, {own('aw')} AS sa, {own('pw')} AS sp, f1, f2,
  coalesce(a_time = 'en', false) AS tm, coalesce(a_resp <> '' AND (a_resp = p_resp OR contains(a_resp, p_resp) OR contains(p_resp, a_resp)), false) AS rm FROM a, p),
y AS (SELECT *, len(sh) AS n_sh, list_intersect(sa, sp) AS sg, len(list_intersect(sa, sp)) AS n_sig, {_contribution_sql('f1', 0.08, 6)} AS d1, {_contribution_sql('f2', 0.03, 3)} AS d2 FROM x),
z AS (SELECT *, CASE WHEN na = 0 OR np = 0 THEN 0 ELSE n_sh / (na + np - n_sh)::DOUBLE END AS tj, round_even(least(0.0::DOUBLE + d1 + d2, 0.18::DOUBLE), 3) AS deco,
  CASE WHEN len(sa) = 0 OR len(sp) = 0 THEN 0 ELSE n_sig / (len(sa) + len(sp) - n_sig)::DOUBLE END AS sj,
  list_sort(list_distinct(list_concat(CASE WHEN d1 > 0 THEN {few('list_intersect(f1, sp)', 6)} ELSE []::VARCHAR[] END, CASE WHEN d2 > 0 THEN {few('list_intersect(f2, sp)', 6)} ELSE []::VARCHAR[] END))) AS dt FROM y),
u AS (SELECT *, len(list_distinct(list_concat(sg, dt))) AS total FROM z),
g AS (SELECT * FROM u WHERE CASE WHEN cat THEN total >= 2 OR sj >= 0.12 OR deco >= 0.05 OR tm OR rm ELSE (n_sh >= 3 OR deco >= 0.07) AND (total >= 2 OR deco >= 0.05) AND (sj >= 0.14 OR deco >= 0.05 OR tm OR rm) END),
s AS (SELECT *, round_even(least(CASE WHEN cat THEN 0.28::DOUBLE ELSE 0.0::DOUBLE END + least(tj, 0.16::DOUBLE) + least(sj, 0.22::DOUBLE) + CASE WHEN n_sig >= 2 THEN least(0.12::DOUBLE, 0.04::DOUBLE * n_sig) ELSE 0.0::DOUBLE END + deco
  + CASE WHEN tm THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN rm THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END, 0.99::DOUBLE), 3) AS confidence FROM g),
m AS (SELECT a_id AS agenda_item_id, p_id AS political_promise_id, CASE WHEN confidence >= 0.82 THEN 'STRONGLY_ALIGNS' ELSE 'PARTIALLY_ALIGNS' END AS relation_type, confidence,
  left(array_to_string(list_filter([CASE WHEN cat THEN 'shared category: ' || a_key END, CASE WHEN n_sig > 0 THEN 'shared signal tokens: ' || array_to_string({few('sg', 8)}, ', ') WHEN n_sh > 0 THEN 'shared tokens: ' || array_to_string({few('sh', 8)}, ', ') END,
    CASE WHEN len(dt) > 0 THEN 'agenda decomposition overlap: ' || array_to_string(dt[1:8], ', ') END, CASE WHEN tm THEN 'timeline hint matched' END, CASE WHEN rm THEN 'responsible entity hint matched' END], lambda t: t IS NOT NULL), '; '), 500) AS notes,
  deco AS decomposition, n_sh::BIGINT AS n_shared, n_sig::BIGINT AS n_signals, cat AS category_match, tm AS time_match, rm AS resp_match FROM s WHERE confidence >= {least})
{select}
"""


_ALIGNED = ("agenda_item_id", "political_promise_id", "relation_type", "confidence", "notes", "decomposition", "n_shared", "n_signals", "category_match", "time_match", "resp_match")
_ALIGN = _align_sql("SELECT * FROM m")


def _aligned(matches: DataFrame) -> DataFrame:
    return matches.withColumns({"n_shared": F.col("n_shared").cast("long"), "n_signals": F.col("n_signals").cast("long")}).select(*_ALIGNED)


@query(_ALIGN)
def align_candidates(spark, d):
    return _aligned(align.candidates(*_roles(spark, d)))


@query(_ALIGN)
def align_blocked(spark, d):
    return _aligned(align.scored(align.blocked_pairs(*_roles(spark, d))))


@query(_align_sql("SELECT * FROM m", fields=True))
def align_decomposed(spark, d):
    """With decomposition fields: a solution as JSON, whose keys don't count, and a legal foundation as text."""
    return _aligned(align.candidates(*_roles(spark, d, fields=True)))


@query(_align_sql("SELECT agenda_item_id, political_promise_id, confidence FROM m ORDER BY confidence DESC, agenda_item_id, political_promise_id LIMIT 100"))
def align_top(spark, d):
    """The best hundred, one of a pair."""
    return align.top(align.candidates(*_roles(spark, d)), 100).select("agenda_item_id", "political_promise_id", "confidence")


@query(_align_sql("SELECT CASE WHEN confidence >= 0.85 THEN '.85+' WHEN confidence >= 0.75 THEN '.75-.84' WHEN confidence >= 0.60 THEN '.60-.74' ELSE '.40-.59' END AS bucket, count(*) AS n FROM m GROUP BY 1"))
def score_buckets(spark, d):
    return align.candidates(*_roles(spark, d)).groupBy(align.bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, len(regexp_extract_all(t, '[\x{0900}-\x{097F}]')) AS ne, len(regexp_extract_all(t, '[A-Za-z]')) AS la, len(regexp_extract_all(t, '\p{L}')) AS le FROM x)
SELECT doc_id, CASE WHEN trim(t) = '' THEN 'en' WHEN ne >= 6 AND ne > la THEN 'ne' WHEN le = 0 THEN 'unknown' WHEN la / le::DOUBLE >= 0.85 THEN 'en' ELSE 'unknown' END AS code,
  CASE WHEN trim(t) = '' THEN 1.0 WHEN ne >= 6 AND ne > la THEN 0.98 WHEN le = 0 THEN 0.2 WHEN la / le::DOUBLE >= 0.85 THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence FROM n
""")
def lang_heuristic(spark, d):
    return t(spark, d, "documents").select("doc_id", text.language(F.col("text")).alias("l")).select("doc_id", "l.code", "l.confidence")


@query(r"SELECT page_id, coalesce(html, '') = '' OR contains(html, '(cid:') OR length(regexp_replace(html, '[\p{L}\p{N}\p{M}\p{Pc}\s,.]', '', 'g')) > 0.3 * length(html) AS garbled FROM pages")
def garbled_pages(spark, d):
    return t(spark, d, "pages").select("page_id", text.garbled(F.col("html")).alias("garbled"))


@query("""
WITH p AS (SELECT event_type, avg(value) FILTER (value > 0) AS m, stddev_samp(value) FILTER (value > 0) AS s, count(*) FILTER (value > 0) AS n FROM events GROUP BY event_type)
SELECT event_id, CASE WHEN value IS NULL OR value <= 0 THEN 'not_positive' WHEN value > 5000000000000 THEN 'above_bound' WHEN n >= 5 AND s > 0 AND abs(value - m) / s > 3 THEN 'outlier' ELSE '' END AS reason FROM events JOIN p USING (event_type)
""")
def budget_outliers(spark, d):
    return budget.validate_batch(t(spark, d, "events"), "event_type", "value").select("event_id", F.col("check.reason").alias("reason"))


def _event_state() -> tuple[Column, Column, Column]:
    k = F.col("event_id")
    return F.when(k % 11 == 0, "failed").when(k % 5 == 0, "uncertain").otherwise("ok"), k % 7 == 0, F.when(k % 3 == 0, "vision").otherwise("deterministic")


@query("""
WITH x AS (SELECT event_id, event_id % 11 = 0 AS fa, event_id % 11 <> 0 AND event_id % 5 = 0 AS un, event_id % 7 = 0 AS an, event_id % 3 = 0 AS vi FROM events),
y AS (SELECT *, greatest(0.05, least(0.99, 0.90 - (CASE WHEN vi THEN 0.12 ELSE 0 END + CASE WHEN un THEN 0.25 WHEN fa THEN 0.5 ELSE 0 END + CASE WHEN an THEN 0.2 ELSE 0 END)))::DOUBLE AS c FROM x)
SELECT event_id, round(c, 4) AS confidence, CASE WHEN fa OR un OR an THEN 'risk:' || array_to_string(list_filter([CASE WHEN fa OR un THEN 'translation_uncertain' END, CASE WHEN an THEN 'budget_anomaly' END, CASE WHEN vi THEN 'vision_budget' END], lambda s: s IS NOT NULL), ',')
  WHEN c < 0.75 THEN 'low_confidence' ELSE 'publish' END AS decision, CASE WHEN round(c, 4) < 0.45 OR fa OR un OR an THEN 'high' ELSE 'medium' END AS risk FROM y
""")
def confidence_gate(spark, d):
    state, anomaly, source = _event_state()
    x = t(spark, d, "events").select("event_id", budget.confidence(state, anomaly, source).alias("c"), budget.risk_flags(state, anomaly, source).alias("f"))
    score = F.round("c", 4)
    return x.select("event_id", score.alias("confidence"), F.coalesce(budget.hold_reason(F.col("c"), F.col("f")), F.lit("publish")).alias("decision"), budget.risk_level(score, F.col("f")).alias("risk"))


_STEMS = ("federal/redbook_2081_82.pdf", "province/x/agenda_2080-81.json", "docs/rsp_2079_80.csv", "docs/Manifesto.pdf", "citizen/notes.txt", "news/items.html", "plain/file", "docs/bacha_patra.pdf")


def _path() -> Column:
    return F.concat(F.lit("data/"), F.element_at(F.array(*[F.lit(s) for s in _STEMS]), (F.col("p_partkey") % len(_STEMS) + 1).cast("int")))


_PATH_SQL = f"'data/' || [{', '.join(repr(s) for s in _STEMS)}][p_partkey % {len(_STEMS)} + 1]"


@query(f"""
WITH x AS (SELECT p_partkey, lower({_PATH_SQL}) AS p FROM part), k AS (SELECT *, regexp_extract(p, '[^/]+(\\.[^./]+)$', 1) AS e,
  CASE WHEN contains(p, 'lalkitab') OR contains(p, 'redbook') THEN 'lal_kitab' WHEN contains(p, 'manifesto') OR contains(p, 'bacha_patra') OR (contains(p, 'rsp') AND p LIKE '%.csv') THEN 'manifesto'
  WHEN contains(p, 'agenda') AND p LIKE '%.json' THEN 'manifesto' WHEN contains(p, 'citizen') THEN 'citizen' WHEN contains(p, 'media') OR contains(p, 'news') THEN 'media' ELSE 'other' END AS kind FROM x)
SELECT p_partkey, kind, CASE WHEN e = '.json' AND (contains(p, 'agenda') OR kind = 'manifesto') THEN 'agenda_json' WHEN contains(p, 'rsp') AND e = '.csv' THEN 'manifesto_csv'
  WHEN e = '.pdf' AND kind = 'manifesto' THEN CASE WHEN contains(p, 'bacha_patra') THEN 'scanned_manifesto_pdf' ELSE 'manifesto_pdf' END ELSE kind END AS subtype FROM k
""")
def source_type_route(spark, d):
    x = t(spark, d, "part").select("p_partkey", _path().alias("p")).withColumn("kind", routing.source_type(F.col("p")))
    return x.select("p_partkey", "kind", routing.source_subtype(F.col("p"), F.lit(""), F.col("kind")).alias("subtype"))


@query(f"""
WITH x AS (SELECT p_partkey, {_PATH_SQL} AS p FROM part)
SELECT p_partkey, CASE WHEN contains(p, '/federal/') THEN 'federal' WHEN contains(p, '/province/') THEN 'provincial' ELSE 'unknown' END AS level, CASE WHEN contains(p, '/province/') THEN 'x' ELSE '' END AS province,
  CASE WHEN regexp_matches(p, '\\d{{4}}[_-]\\d{{2}}') THEN regexp_extract(p, '(\\d{{4}})[_-](\\d{{2}})', 1) || '/' || regexp_extract(p, '(\\d{{4}})[_-](\\d{{2}})', 2) ELSE 'unknown' END AS fiscal_year FROM x
""")
def scope_fiscal_year(spark, d):
    x = t(spark, d, "part").select("p_partkey", routing.scope(_path()).alias("s"), routing.fiscal_year(_path()).alias("fiscal_year"))
    return x.select("p_partkey", "s.level", "s.province", "fiscal_year")


@query("""
WITH x AS (SELECT l_orderkey, count(*) AS pages, count(*) FILTER (l_returnflag = 'R') AS bad, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, greatest(1, least(5, pages)) AS s FROM x), k AS (SELECT *, CASE WHEN n = 0 OR n / s::DOUBLE < 1 OR bad / s::DOUBLE >= 0.4 THEN 'vision' WHEN n / s::DOUBLE < 3 OR (pages > 80 AND bad / s::DOUBLE > 0.1) THEN 'hybrid' ELSE 'deterministic' END AS st FROM r)
SELECT l_orderkey, st AS strategy, st IN ('ocr', 'hybrid') AS requires_ocr, st IN ('vision', 'hybrid') AS requires_vision FROM k
""")
def plan_strategy(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.sum("l_linenumber").alias("n"))
    s = routing.strategy(F.lit("lal_kitab"), F.lit("lal_kitab"), F.col("pages"), F.col("n"), F.col("bad"))
    return x.select("l_orderkey", s.alias("s")).select("l_orderkey", "s.strategy", "s.requires_ocr", "s.requires_vision")


_DOC_STATES = {"F": "published", "O": "review_hold", "P": "failed"}


@query("""
WITH x AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'review_hold' ELSE 'failed' END AS st, CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END AS pub, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS held FROM orders),
y AS (SELECT o_custkey AS job_id, count(*) AS source_count, count(*) FILTER (st <> 'queued') AS processed_count, sum(pub)::BIGINT AS published_count, sum(held)::BIGINT AS held_count, count(*) FILTER (st = 'failed') AS failed_count FROM x GROUP BY 1)
SELECT *, CASE WHEN failed_count > 0 THEN 'failed' WHEN held_count > 0 THEN 'review_hold' WHEN published_count > 0 THEN 'completed' ELSE 'dead_letter' END AS status FROM y
""")
def ingest_status_rollup(spark, d):
    published, held = F.when(F.col("o_orderstatus") == "F", 3).otherwise(0), F.when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    docs = t(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), published.alias("published_count"), held.alias("held_count"))
    return review.rollup(docs.withColumn("status", review.document_status(F.col("published_count"), F.col("held_count"))))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return review.status_counts(t(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("""
SELECT count(*) FILTER (event_id % 3 = 0) AS translated, count(*) FILTER (event_id % 7 = 0) AS translation_failed, count(*) FILTER (event_id % 2 = 0) AS native, count(*) FILTER (event_id % 2 = 1) AS english FROM events
""")
def metadata_counts(spark, d):
    k = F.col("event_id")
    meta = F.to_json(F.struct((k % 3 == 0).alias("translation_applied"), F.when(k % 7 == 0, "failed").otherwise("done").alias("translation_status"), F.when(k % 2 == 0, "ne").otherwise("en").alias("source_language")))
    return review.metadata_counts(t(spark, d, "events").select(meta.alias("extra_metadata")))


@query("SELECT 'k' AS name, sum((props::JSON->>'$.k')::DOUBLE) AS n FROM events")
def json_meta_counts(spark, d):
    return review.sums_by_key(t(spark, d, "events").select(F.concat(F.lit('{"m":'), "props", F.lit("}")).alias("j")), "j", "$.m")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, d):
    return graph.latest(t(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, arg_max(CASE WHEN event_type = 'purchase' THEN event_id END, ts) AS last_purchase, arg_max(event_type, ts) AS last_type, arg_max(CASE WHEN event_id % 3 = 0 THEN event_id END, ts) AS last_third FROM events GROUP BY user_id")
def upsert_overlay(spark, d):
    e = t(spark, d, "events").select("user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("last_purchase"), F.col("event_type").alias("last_type"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("last_third"))
    return graph.overlay(e, ["user_id"], "ts", ["last_purchase", "last_type", "last_third"])


@query("SELECT event_type AS entity_type, user_id::VARCHAR AS record_key FROM events WHERE event_id % 10 <> 0 GROUP BY ALL HAVING (event_type, user_id::VARCHAR) NOT IN (SELECT (event_type, user_id::VARCHAR) FROM events WHERE event_id % 10 = 0)")
def hold_dedupe(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("record_key"), F.lit("").alias("fingerprint"), F.col("ts").alias("updated_at"))
    queue = e.filter("event_id % 10 = 0").withColumn("status", F.lit("resolved"))
    fresh, _ = review.hold(queue, e.filter("event_id % 10 <> 0"))
    return fresh.select("entity_type", "record_key")


def _lines(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))


@query("WITH a AS (SELECT DISTINCT p_type FROM part), b AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS mark FROM part) SELECT p_type, mark FROM a, b WHERE contains(lower(p_type), lower(mark)) UNION ALL SELECT p_name, q FROM (SELECT DISTINCT p_name FROM part), (SELECT DISTINCT p_name AS q FROM part) WHERE contains(lower(p_name), lower(q))")
def theta_contains(spark, d):
    """Types that hold a word of a part's name, and names that hold a whole name."""
    part = t(spark, d, "part")
    words = align.theta_contains(part.select("p_type").distinct(), part.select(F.explode(F.split("p_name", " ")).alias("mark")).distinct(), "p_type", "mark")
    names = align.theta_contains(part.select(F.col("p_name").alias("p_type")).distinct(), part.select(F.col("p_name").alias("mark")).distinct(), "p_type", "mark")
    return words.unionByName(names)


@query("""
WITH r AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS id, coalesce(n, 0)::BIGINT AS published_count, greatest(3 - coalesce(n, 0), 0)::BIGINT AS held_count, CASE WHEN n IS NOT NULL AND greatest(3 - n, 0) = 0 THEN 'published' ELSE 'review_hold' END AS status FROM orders LEFT JOIN r ON id = o_orderkey
""")
def review_apply(spark, d):
    reviews = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_returnflag") == "R", "approved").otherwise("pending_review").alias("status"))
    docs = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("published_count"), F.lit(3).cast("long").alias("held_count"), F.lit("review_hold").alias("status"))
    return review.apply_decisions(reviews, docs)[1]


@query("SELECT user_id, count(*) AS attempt_count, CASE WHEN count(*) >= 5 THEN 'exhausted' ELSE 'queued' END AS outcome FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def retry_select(spark, d):
    docs = t(spark, d, "events").filter("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempt_count")).withColumn("status", F.lit("failed"))
    return review.retry(docs).select("user_id", "attempt_count", "outcome")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark, d):
    return t(spark, d, "orders").select("o_orderkey").join(_lines(spark, d), "o_orderkey", "left_anti").distinct()


@query(r"""
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '** |' WHEN 2 THEN 'Total ' || p_name WHEN 3 THEN substr(p_name, 1, 2) ELSE p_name END AS title FROM part)
SELECT p_partkey, title FROM x WHERE NOT (regexp_matches(title, '^[0-9\s]*$') OR regexp_matches(title, '^[*|\s]*$') OR length(title) < 3 OR contains(title, 'Total'))
""")
def noise_scrub(spark, d):
    k = F.col("p_partkey")
    title = F.when(k % 5 == 0, F.col("p_size").cast("string")).when(k % 5 == 1, "** |").when(k % 5 == 2, F.concat(F.lit("Total "), "p_name")).when(k % 5 == 3, F.substring("p_name", 1, 2)).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", title.alias("title")).filter(~graph.noise(F.col("title")))


@query()
def similarity_ratio(spark, d):
    part = t(spark, d, "part")
    return part.select("p_partkey", binary.similarity(F.col("p_name"), F.col("p_type")).alias("ratio"))
