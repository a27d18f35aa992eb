"""Budget figures: cleaning, validation, confidence and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions.ids import budget_hash
from tallyweave.functions.text import clean_cid, strip

#: Fixed values.
MAX_BUDGET = 5_000_000_000_000
MIN_PEERS, MAX_Z = 5, 3.0
BASE, VISION, UNCERTAIN, FAILED, ANOMALY, LOWEST, HIGHEST = 0.90, 0.12, 0.25, 0.50, 0.20, 0.05, 0.99
PUBLISH_FROM, HIGH_RISK_BELOW = 0.75, 0.45
HIGH_RISK = ("translation_uncertain", "budget_anomaly")
NATIVE_DIGITS = "०१२३४५६७८९"


def normalize_budget(raw: Column) -> Column:
    """The digits and points of a figure as a whole number; 0 where they are none."""
    digits = F.regexp_replace(F.translate(F.coalesce(raw.cast("string"), F.lit("")), NATIVE_DIGITS, "0123456789"), r"[^0-9.]", "")
    return F.coalesce(digits.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def clean(rows: DataFrame) -> DataFrame:
    """title_ne, budget (raw), page_num. Titles and figures cleaned, hashes added; what breaks the contract is dropped."""
    out = rows.withColumns({"title_ne": clean_cid(F.col("title_ne")), "raw_budget": F.col("budget").cast("string"), "budget": normalize_budget(F.col("budget"))})
    out = out.withColumn("budget_hash", budget_hash(F.col("raw_budget"), F.col("page_num")))
    return out.filter((F.length(strip(F.col("title_ne"))) >= 5) & F.col("budget").between(1, MAX_BUDGET) & ~F.col("title_ne").rlike(r"(?U)^\d+$"))


def validate(budget: Column, mean: Column, deviation: Column, peers: Column, raw: Column | None = None, page: Column | None = None, stored_hash: Column | None = None, source: Column | None = None) -> Column:
    """STRUCT<valid, anomaly, reason>; the first rule that holds decides."""
    raw, page, stored_hash, source = (F.lit(None).cast("string") if c is None else c for c in (raw, page, stored_hash, source))
    tampered = (F.coalesce(stored_hash, F.lit("")) != "") & (F.coalesce(raw, F.lit("")) != "") & (budget_hash(raw, page) != stored_hash)
    outlier = (peers >= MIN_PEERS) & (deviation > 0) & (F.abs(budget - mean) / deviation > MAX_Z)
    one = lambda valid, anomaly, reason: F.struct(F.lit(valid).alias("valid"), F.lit(anomaly).alias("anomaly"), F.lit(reason).alias("reason"))
    return (
        F.when(budget.isNull() | (budget <= 0), one(False, True, "not_positive"))
        .when(budget > MAX_BUDGET, one(False, True, "above_bound"))
        .when(tampered, one(False, True, "hash_mismatch"))
        .when(F.coalesce(outlier, F.lit(False)), one(True, True, "outlier"))
        .when(source.eqNullSafe("vision"), one(True, True, "vision_source"))
        .otherwise(one(True, False, ""))
    )


def validate_batch(rows: DataFrame, batch: str, budget: str = "budget", **columns: Column) -> DataFrame:
    """Adds check, of each row against the positive peers of its batch. Peers are summed before the join, so a large batch is no one task's."""
    positive = F.when(F.col(budget) > 0, F.col(budget))
    peers = rows.groupBy(batch).agg(F.avg(positive).alias("_mean"), F.stddev_samp(positive).alias("_dev"), F.count(positive).alias("_peers"))
    out = rows.join(peers.withColumnRenamed(batch, "_batch"), F.col(batch).eqNullSafe(F.col("_batch")))
    return out.withColumn("check", validate(F.col(budget), F.col("_mean"), F.col("_dev"), F.col("_peers"), **columns)).drop("_mean", "_dev", "_peers", "_batch")


def validate_batch_by_window(rows: DataFrame, batch: str, budget: str = "budget", **columns: Column) -> DataFrame:
    """The same with a window, for batches known to be small."""
    w = W.partitionBy(batch)
    positive = F.when(F.col(budget) > 0, F.col(budget))
    return rows.withColumn("check", validate(F.col(budget), F.avg(positive).over(w), F.stddev_samp(positive).over(w), F.count(positive).over(w), **columns))


def risk_flags(translation: Column, anomaly: Column, source: Column) -> Column:
    flag = lambda when, name: F.when(when, F.lit(name))
    return F.array_compact(F.array(flag(translation.isin("failed", "uncertain"), "translation_uncertain"), flag(anomaly, "budget_anomaly"), flag(source == "vision", "vision_budget")))


def confidence(translation: Column, anomaly: Column, source: Column) -> Column:
    less = F.when(source == "vision", VISION).otherwise(0.0) + F.when(translation == "uncertain", UNCERTAIN).when(translation == "failed", FAILED).otherwise(0.0) + F.when(anomaly, ANOMALY).otherwise(0.0)
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.lit(BASE) - less))


def hold_reason(score: Column, flags: Column, threshold: float = PUBLISH_FROM) -> Column:
    """Why a record waits for review: its flags, or its low confidence; null if it may be published."""
    risky = F.array_intersect(flags, F.array(*[F.lit(x) for x in HIGH_RISK]))
    return F.when(F.size(risky) > 0, F.concat(F.lit("risk:"), F.array_join(flags, ","))).when(score < threshold, F.lit("low_confidence"))


def risk_level(score: Column, flags: Column) -> Column:
    return F.when((score < HIGH_RISK_BELOW) | F.arrays_overlap(flags, F.array(*[F.lit(x) for x in HIGH_RISK])), "high").otherwise("medium")


def workers(documents: Column, requested: Column) -> Column:
    """How many documents to handle at once."""
    return F.least(requested, F.when(documents <= 2, 1).when(documents <= 6, 2).when(documents <= 12, 3).otherwise(4))


def backoff(attempt: Column, base: float = 0.8, cap: float = 12.0) -> Column:
    """Seconds before the next try, without the random part."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt - 1))


def token_estimate(prompt_chars: Column, max_tokens: Column) -> Column:
    return (F.floor(prompt_chars / 4) + max_tokens + 120).cast("long")


def image_token_estimate(image_bytes: Column) -> Column:
    return F.greatest(F.lit(1800), F.floor(image_bytes / 900)).cast("long")
