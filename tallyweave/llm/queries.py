"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import ann, bpe, chat, exact_dedup, jaccard, lm, mixing, pii, secrets, toxicity
from tallyweave.llm.common import table


def _written_spans(spans: Column, name) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _counts(spans: Column, kinds: dict) -> list[Column]:
    def of(k) -> Callable[[Column], Column]:
        return lambda x: x["kind"] == F.lit(k)

    return [F.size(F.filter(spans, of(k))).cast("long").alias(f"n_{name}") for name, k in kinds.items()]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    name = lambda k: F.element_at(pii.names(), k + 1)
    counts = _counts(F.col("base"), {kind: i for i, (kind, _, _) in enumerate(pii.KINDS)})
    return found.select("doc_id", *counts, F.sha2(_written_spans(F.col("base"), name), 256).alias("base_sha256"), _written_spans(F.col("spans"), name).alias("spans"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.with_copies(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP4_SQL = r"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::HUGEINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w, 3 * source_size AS cap FROM sources),
rest AS (SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS ws,
  sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS t_left, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / w::DOUBLE, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, cap * w_left <= w * t_left AS full_ FROM rest),
shares AS (SELECT *, t - coalesce(sum(cap) FILTER (full_) OVER (), 0) AS num, ws - coalesce(sum(w) FILTER (full_) OVER (), 0) AS den FROM filled),
plan AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE (num * w)::DOUBLE / den::DOUBLE END AS target FROM shares),
rated AS (SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(sha256('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS coin
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * least(floor(rate)::BIGINT + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS taken FROM rated
"""


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    kinds = {r.kind: r.kind for r in secrets.BASE}
    base = F.filter("spans", lambda x: x["kind"].isin(*kinds))
    same = lambda k: k
    return found.select("doc_id", *_counts(F.col("spans"), kinds), F.sha2(_written_spans(base, same), 256).alias("base_sha256"), _written_spans(F.col("spans"), same).alias("spans"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"), words=3, percent=90)


#: A conversation that says the template's own control strings.
HARD = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(spark.createDataFrame(HARD, turns.schema))))


OP7_SQL = r"""
WITH hard(conv_id, turn, role, text) AS (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL FROM hard))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') || ' </turn>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), offsets=False)
    rows = encoded.select("doc_id", "tokens", (F.length("tokens") / 4).cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"))
    return bpe.decode(rows).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_pii, op3_ann, op4_mixing, op5_secrets, op6_jaccard, op7_chat, op8_byte_bpe, op9_lm_scoring, op10_exact_dedup)}
ORACLES = {"op4_mixing": OP4_SQL, "op7_chat": OP7_SQL, "op10_exact_dedup": OP10_SQL}
