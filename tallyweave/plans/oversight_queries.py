"""Queries of the planned extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.operators import oversight
from tallyweave.plans.catalogue import query, t

_STAGE_SQL = "[" + ", ".join(f"'{s}'" for s in oversight.STAGES) + "]"


def _stage(column: str):
    return F.element_at(F.array(*[F.lit(s) for s in oversight.STAGES]), (F.col(column) % len(oversight.STAGES) + 1).cast("int"))


def _flows(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("flow"), _stage("event_id").alias("stage"), F.col("ts").alias("at"))


_FIRST = f"SELECT user_id AS flow, event_id % 9 AS k, min(ts) AS at FROM events GROUP BY 1, 2"


@query(f"""
WITH f AS ({_FIRST}), r AS (SELECT flow, max(k) AS reached, list(k) AS have FROM f GROUP BY 1)
SELECT flow, {_STAGE_SQL}[reached + 1] AS reached, (reached + 1 - len(have))::INTEGER AS n_missing, {_STAGE_SQL}[list_min(list_filter(range(0, reached), lambda i: NOT list_contains(have, i))) + 1] AS first_missing FROM r
""")
def flow_chain(spark, d):
    """How far each flow went, and where it has a gap."""
    return oversight.chain(_flows(spark, d)).select("flow", "reached", "n_missing", "first_missing")


@query(f"""
WITH f AS ({_FIRST}) SELECT a.flow, {_STAGE_SQL}[a.k + 1] AS from_stage, {_STAGE_SQL}[b.k + 1] AS to_stage, (epoch_us(b.at) - epoch_us(a.at)) / 1000000.0::DOUBLE AS seconds FROM f a JOIN f b ON a.flow = b.flow AND b.k = a.k + 1
""")
def flow_waits(spark, d):
    """How long each step of a flow took."""
    return oversight.waits(oversight.chain(_flows(spark, d)))


@query("""
WITH q AS (SELECT event_type, quantile_disc(value, 0.05) AS lo, quantile_disc(value, 0.95) AS hi FROM events GROUP BY 1)
SELECT event_type, count(*) FILTER (value < lo) AS below, count(*) FILTER (value > hi) AS above FROM events JOIN q USING (event_type) GROUP BY event_type
""")
def delay_bands(spark, d):
    """What lies outside its class's expected range (exact discrete percentiles)."""
    e = t(spark, d, "events").select("event_type", "value")
    found = oversight.against_bands(e, oversight.bands(e, ["event_type"], "value", exact=True), ["event_type"], "value")
    return found.groupBy("event_type").agg(F.count_if(F.col("delay") == "below").alias("below"), F.count_if(F.col("delay") == "above").alias("above"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_releases(spark, d):
    return oversight.repeated(t(spark, d, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


@query("""
WITH r AS (SELECT o_custkey AS k, sum(o_totalprice) AS received FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), u AS (SELECT o_custkey AS k, sum(o_totalprice) AS used FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT coalesce(r.k, u.k) AS o_custkey, CASE WHEN received IS NULL THEN 'unexplained' WHEN used IS NULL THEN 'unused' WHEN used > received * (1 + 0.1::DOUBLE) THEN 'over' WHEN used < received * (1 - 0.1::DOUBLE) THEN 'under' ELSE 'consistent' END AS state FROM r FULL JOIN u ON r.k = u.k
""")
def utilization_mismatch(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("amount"), "o_orderstatus")
    return oversight.utilization(o.filter("o_orderstatus <> 'F'"), o.filter("o_orderstatus <> 'O'"), "o_custkey").select("o_custkey", "state")


@query("""
WITH l AS (SELECT l_orderkey AS k, min(l_linestatus) AS lo, max(l_linestatus) AS hi FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, k) AS id, CASE WHEN lo = hi THEN lo END AS ground_status, CASE WHEN k IS NULL THEN 'no_ground' WHEN o_orderkey IS NULL THEN 'no_paper' WHEN lo = hi AND lo = o_orderstatus THEN 'agree' ELSE 'diverge' END AS state,
  CASE WHEN k IS NULL THEN 'nothing seen' WHEN o_orderkey IS NULL THEN 'nothing filed' WHEN lo <> hi THEN 'sightings differ' WHEN lo <> o_orderstatus THEN 'status differs' END AS reason FROM orders FULL JOIN l ON k = o_orderkey
""")
def divergence(spark, d):
    """Paper state against what is seen on the ground."""
    paper = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("paper_status"))
    ground = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("ground_status"))
    return oversight.divergence(paper, ground, "id").drop("paper_status")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def missing_allocation(spark, d):
    """What is missing, by class."""
    return oversight.missing(t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "o_orderpriority")


_BITS = [f"(o_orderkey // {3**i}) % 3 > 0" for i in range(8)]


@query("SELECT o_orderkey, CASE " + " ".join(f"WHEN NOT ({b}) THEN '{oversight.LADDER[i]}'" for i, b in enumerate(_BITS)) + f" ELSE '{oversight.LADDER[-1]}' END AS step FROM orders")
def credibility_ladder(spark, d):
    """The step of each lead; a step that is missing holds back all above it."""
    bit = lambda i: F.floor(F.col("o_orderkey") / 3**i) % 3 > 0
    return t(spark, d, "orders").select("o_orderkey", oversight.credibility(F.when(bit(0), 2).otherwise(1), *[bit(i) for i in range(1, 8)]).alias("step"))


@query("""
WITH e AS (SELECT l_orderkey AS item, CASE WHEN l_linenumber = 7 THEN 'A' WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'C' END AS tier, l_suppkey % 5 AS source, l_partkey % 9 = 0 AS approved FROM lineitem),
g AS (SELECT item, count(*) FILTER (tier = 'A') AS a, count(*) FILTER (tier = 'B' AND approved) AS b, count(*) FILTER (tier = 'C' AND approved) AS c, count(DISTINCT source) FILTER (tier = 'B') AS n FROM e GROUP BY 1)
SELECT item, CASE WHEN a > 0 THEN 'official' WHEN b > 0 THEN 'approved' WHEN n >= 2 THEN 'corroborated' WHEN c > 0 THEN 'verified' ELSE 'staged' END AS trust, a > 0 OR b > 0 OR n >= 2 OR c > 0 AS may_change FROM g
""")
def trust_tiers(spark, d):
    """Which evidence may change a status."""
    n = F.col("l_linenumber")
    e = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.when(n == 7, "A").when(n % 2 == 0, "B").otherwise("C").alias("tier"), (F.col("l_suppkey") % 5).alias("source"), (F.col("l_partkey") % 9 == 0).alias("approved"))
    return oversight.trusted(e, "item")


@query("""
WITH p AS (SELECT user_id AS item, event_id % 4 AS source, arg_max(event_type, struct_pack(t := ts, e := event_type)) AS now, min(event_type) <> max(event_type) AS moved FROM events WHERE event_id % 7 < 2 GROUP BY 1, 2),
v AS (SELECT item, now, count(*) AS n, max(moved) AS moved FROM p GROUP BY 1, 2), g AS (SELECT item, sum(n) AS al, max(n) AS most, count(*) AS kinds, max(moved) AS moved, arg_min(now, struct_pack(n := -n, s := now)) AS status FROM v GROUP BY 1)
SELECT item, CASE WHEN al < 2 THEN 'unresolved' WHEN kinds = 1 AND moved THEN 'superseded' WHEN kinds = 1 THEN 'agree' WHEN most * 2 > al THEN 'partially_agree' ELSE 'conflict' END AS outcome, status FROM g
""")
def reconciliation(spark, d):
    """What several sources say of an item."""
    c = t(spark, d, "events").filter("event_id % 7 < 2").select(F.col("user_id").alias("item"), (F.col("event_id") % 4).alias("source"), F.col("event_type").alias("status"), F.col("ts").alias("at"))
    return oversight.reconciled(c, "item")


_SPELLS = """
WITH o AS (SELECT user_id AS item, ts, max(event_type) AS status FROM events GROUP BY 1, 2), l AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS r FROM o WINDOW w AS (PARTITION BY item ORDER BY ts)),
s AS (SELECT item, status, ts AS valid_from, lead(ts) OVER (PARTITION BY item ORDER BY ts) AS valid_to FROM l WHERE r = 1 OR before IS DISTINCT FROM status)
"""


@query(f"{_SPELLS} SELECT item, status, epoch_us(valid_from) AS valid_from, epoch_us(valid_to) AS valid_to FROM s")
def temporal_truth(spark, d):
    """When each state began and ended."""
    spells = oversight.history(t(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts")), "item", "status", "ts")
    return spells.select("item", "status", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"))


@query(f"{_SPELLS}, m AS (SELECT max(ts) - INTERVAL 3 DAY AS moment FROM events) SELECT status, count(*) AS n FROM s, m WHERE valid_from <= moment AND (valid_to IS NULL OR valid_to > moment) GROUP BY 1")
def states_as_of(spark, d):
    """The states of three days before the last event."""
    e = t(spark, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg((F.max("ts") - F.expr("INTERVAL 3 DAYS")).alias("at")).first()["at"]  # one row
    return oversight.as_of(oversight.history(e, "item", "status", "ts"), F.lit(last)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT DISTINCT 'p' || l_partkey AS promise, 'a' || (l_partkey % 100) AS agenda FROM lineitem WHERE l_linenumber = 1), f AS (SELECT DISTINCT 'p' || l_partkey AS promise, 'o' || l_orderkey AS project FROM lineitem WHERE l_linenumber = 2),
m AS (SELECT DISTINCT 'l' || l_orderkey || '-' || l_linenumber AS allocation, 'o' || l_orderkey AS project FROM lineitem WHERE l_returnflag = 'R')
SELECT agenda, count(DISTINCT promise) AS promises, count(DISTINCT project) AS projects, count(DISTINCT allocation) AS allocations FROM a LEFT JOIN f USING (promise) LEFT JOIN m USING (project) GROUP BY 1
""")
def adopted_agendas(spark, d):
    """Which agenda items were taken up, and which got money."""
    line = t(spark, d, "lineitem")
    name = lambda p, *c: F.concat(F.lit(p), F.concat_ws("-", *[F.col(x).cast("string") for x in c]))
    edge = lambda rel, a, b, when: line.filter(when).select(F.lit(rel).alias("rel_type"), a.alias("src_id"), b.alias("dst_id"))
    edges = edge("ALIGNS_WITH_AGENDA_ITEM", name("p", "l_partkey"), F.concat(F.lit("a"), (F.col("l_partkey") % 100).cast("string")), "l_linenumber = 1")
    edges = edges.unionByName(edge("FULFILLED_BY", name("p", "l_partkey"), name("o", "l_orderkey"), "l_linenumber = 2")).unionByName(edge("FUNDS", name("l", "l_orderkey", "l_linenumber"), name("o", "l_orderkey"), "l_returnflag = 'R'"))
    return oversight.adopted_with_budget(edges).groupBy("agenda").agg(*[F.countDistinct(c).alias(f"{c}s") for c in ("promise", "project", "allocation")])


@query("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, CASE WHEN count(*) >= 200 THEN 'national' WHEN count(*) >= 50 THEN 'local' ELSE 'none' END AS route FROM events GROUP BY 1, 2")
def demand_routing(spark, d):
    """Counts of intake by week and class, routed by threshold."""
    from tallyweave.streaming.gate import demand

    found = demand(t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type")
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "route")
