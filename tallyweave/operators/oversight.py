"""Planned extensions: chains of budget movement and their delays, anomalies, paper against ground, credibility, trust, absence, reconciliation and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The stages of a budget's movement, in order, and the steps of a lead's credibility, the lowest first.
STAGES = ("federal_approval", "federal_release", "province_receipt", "province_release", "local_receipt", "ward_availability", "implementation_start", "implementation_completion", "utilization_evidence")
LADDER = ("raw", "clustered", "linked_to_project", "linked_to_release_chain", "documentary_anomaly", "field_worthy", "volunteer_verified", "editorially_approved", "graph_truth_eligible")
CORROBORATIONS = 2


def chain(events: DataFrame, flow: str = "flow", stage: str = "stage", at: str = "at") -> DataFrame:
    """A row per flow: the first time of each stage, the furthest stage that it reached, how many before that are missing, and the stage it was missing
    first. Times are combined before the shuffle, so a flow of any number of events is one row of nine."""
    first = events.groupBy(flow).agg(*[F.min(F.when(F.col(stage) == s, F.col(at))).alias(s) for s in STAGES])
    reached = F.coalesce(*[F.when(F.col(s).isNotNull(), F.lit(i)) for i, s in reversed(list(enumerate(STAGES)))], F.lit(-1))
    x = first.withColumn("_reached", reached)
    gap = lambda i, s: (F.col("_reached") > i) & F.col(s).isNull()
    missing = sum((gap(i, s).cast("int") for i, s in enumerate(STAGES)), F.lit(0))
    break_at = F.coalesce(*[F.when(gap(i, s), F.lit(s)) for i, s in enumerate(STAGES)])
    return x.withColumns({"reached": F.when(F.col("_reached") >= 0, F.get(F.array(*[F.lit(s) for s in STAGES]), F.greatest("_reached", F.lit(0)))), "n_missing": missing, "first_missing": break_at}).drop("_reached")


def waits(chains: DataFrame, flow: str = "flow") -> DataFrame:
    """flow, from_stage, to_stage, seconds between neighbouring stages that a flow has reached (negative where papers are out of order)."""
    steps = [F.struct(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"), (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))).alias("micros")) for a, b in zip(STAGES, STAGES[1:])]
    x = chains.select(flow, F.explode(F.array(*steps)).alias("s")).select(flow, "s.*").filter("micros IS NOT NULL")
    return x.withColumn("seconds", F.col("micros") / 1e6).drop("micros")


def bands(rows: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95, exact: bool = False) -> DataFrame:
    """What is normal in each class: its lower and upper percentile. Sketched, so that a class of any size fits; exact for classes known to be small."""
    if exact:
        pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
    else:
        pick = lambda p: F.percentile_approx(value, p, 10_000)
    return rows.groupBy(*by).agg(pick(low).alias("low"), pick(high).alias("high"), F.count(value).alias("known"))


def against_bands(rows: DataFrame, normal: DataFrame, by: list[str], value: str, least: int = 5) -> DataFrame:
    """Adds delay: below, above, normal, or unknown where a class has fewer than so many values. A class is one row of normal, so its rows are joined by
    broadcast while there are few classes."""
    few = normal.limit(10_001).count() <= 10_000
    x = rows.join(F.broadcast(normal) if few else normal, by, "left")
    v = F.col(value)
    delay = F.when(v.isNull() | F.col("known").isNull() | (F.col("known") < least), "unknown").when(v < F.col("low"), "below").when(v > F.col("high"), "above").otherwise("normal")
    return x.withColumn("delay", delay).drop("low", "high", "known")


def repeated(rows: DataFrame, keys: list[str], more_than: int = 1) -> DataFrame:
    """Keys that stand for more rows than they should, with n: releases that are there twice, contractors of many cases, complaints again and again."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def missing(rows: DataFrame, present: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """Rows whose key is not present; with by, counts of them by class."""
    gone = rows.join(present.select(key).distinct(), key, "left_anti")
    return gone if by is None else gone.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def utilization(received: DataFrame, used: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """key, received, used, state: over and under by more than the tolerance, unused, unexplained (nothing received), or consistent."""
    r = received.groupBy(key).agg(F.sum("amount").alias("received"))
    u = used.groupBy(key).agg(F.sum("amount").alias("used"))
    x = r.join(u, key, "full")
    state = (
        F.when(F.col("received").isNull(), "unexplained")
        .when(F.col("used").isNull(), "unused")
        .when(F.col("used") > F.col("received") * (1 + tolerance), "over")
        .when(F.col("used") < F.col("received") * (1 - tolerance), "under")
        .otherwise("consistent")
    )
    return x.withColumn("state", state)


def divergence(paper: DataFrame, ground: DataFrame, key: str) -> DataFrame:
    """paper: key, paper_status; ground: key, ground_status, a row per sighting. key, paper_status, ground_status (null where sightings differ), state, reason."""
    seen = ground.groupBy(key).agg(F.min("ground_status").alias("_lo"), F.max("ground_status").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    x = paper.select(key, "paper_status", F.lit(True).alias("_paper")).join(seen, key, "full")
    agreed = F.col("_lo") == F.col("_hi")
    state = F.when(F.col("_n").isNull(), "no_ground").when(F.col("_paper").isNull(), "no_paper").when(agreed & (F.col("_lo") == F.col("paper_status")), "agree").otherwise("diverge")
    reason = F.when(F.col("_n").isNull(), "nothing seen").when(F.col("_paper").isNull(), "nothing filed").when(~agreed, "sightings differ").when(F.col("_lo") != F.col("paper_status"), "status differs")
    return x.select(key, "paper_status", F.when(agreed, F.col("_lo")).alias("ground_status"), state.alias("state"), reason.alias("reason"))


def credibility(signals: Column, project: Column, release: Column, anomaly: Column, field: Column, volunteer: Column, editor: Column, eligible: Column) -> Column:
    """The highest step of the ladder that a lead has reached without leaving out one below it."""
    steps = [signals > 1, project, release, anomaly, field, volunteer, editor, eligible]
    out = F.lit(LADDER[-1])
    for i in range(len(steps) - 1, -1, -1):
        out = F.when(~F.coalesce(steps[i], F.lit(False)), F.lit(LADDER[i])).otherwise(out)
    return out


def trusted(evidence: DataFrame, item: str, tier: str = "tier", source: str = "source", approved: str = "approved", needed: int = CORROBORATIONS) -> DataFrame:
    """item and may_change: official papers count at once, media from so many sources on or with an approval, citizens' reports only once approved."""
    of = lambda t: F.col(tier) == t
    x = evidence.groupBy(item).agg(F.max(of("A")).alias("_a"), F.count_if(F.col(approved) & of("B")).alias("_b"), F.count_if(F.col(approved) & of("C")).alias("_c"))
    # distinct sources are counted by pair, so that an item with very many reports is combined before the shuffle
    media = evidence.filter(of("B")).select(item, source).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    x = x.join(media, item, "left")
    why = F.when(F.col("_a"), "official").when(F.col("_b") > 0, "approved").when(F.coalesce("_n", F.lit(0)) >= needed, "corroborated").when(F.col("_c") > 0, "verified").otherwise("staged")
    return x.select(item, why.alias("trust"), (why != "staged").alias("may_change"))


def reconciled(claims: DataFrame, item: str, source: str = "source", status: str = "status", at: str = "at") -> DataFrame:
    """claims: what each source says of an item, and when; its newest claim counts. item, outcome (agree, partially_agree, conflict, unresolved or superseded, where
    a source has since said otherwise and all now agree), status (what most sources say, the smallest of equals)."""
    per = claims.groupBy(item, source).agg(F.max_by(status, F.struct(at, status)).alias("now"), F.min(status).alias("_lo"), F.max(status).alias("_hi"))
    votes = per.groupBy(item, "now").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_lo") != F.col("_hi")).alias("moved"))
    x = votes.groupBy(item).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("kinds"), F.max("moved").alias("moved"), F.min_by("now", F.struct(-F.col("n"), F.col("now"))).alias("status"))
    outcome = F.when(F.col("all") < 2, "unresolved").when((F.col("kinds") == 1) & F.col("moved"), "superseded").when(F.col("kinds") == 1, "agree").when(F.col("most") * 2 > F.col("all"), "partially_agree").otherwise("conflict")
    return x.select(item, outcome.alias("outcome"), "status")


def history(changes: DataFrame, item: str, value: str, at: str) -> DataFrame:
    """item, value, valid_from, valid_to (null while it holds): the value's spells; repeated reports of a value are one spell, of one instant the largest counts."""
    one = changes.groupBy(item, at).agg(F.max(value).alias(value))
    w = W.partitionBy(item).orderBy(at)
    turns = one.withColumn("_last", F.lag(F.struct(value)).over(w)).filter(F.col("_last").isNull() | ~F.col(f"_last.{value}").eqNullSafe(F.col(value))).drop("_last")
    return turns.select(item, value, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def as_of(spells: DataFrame, moment: Column) -> DataFrame:
    """The values that held at a moment."""
    return spells.filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def adopted_with_budget(edges: DataFrame) -> DataFrame:
    """agenda, promise, project, allocation: which agenda items a promise took up, and which money went to their projects; null where the chain ends."""
    end = lambda rel, a, b: edges.filter(F.col("rel_type") == rel).select(F.col("src_id").alias(a), F.col("dst_id").alias(b)).distinct()
    x = end("ALIGNS_WITH_AGENDA_ITEM", "promise", "agenda").join(end("FULFILLED_BY", "promise", "project"), "promise", "left")
    return x.join(end("FUNDS", "allocation", "project"), "project", "left").select("agenda", "promise", "project", "allocation")
