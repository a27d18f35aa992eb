"""Mixing sources to target weights.

Tokens are summed for each source; the sources, in code-point order with null last, get the weights in turn
and share the tokens of the whole corpus. A target stops at ``limit`` times its source's tokens, and what is
over goes to the other sources by weight until no target is above (water filling, solved exactly by a
running sum over sources ordered by limit x size / weight). A document is emitted floor(rate) times, and once more if its coin, seeded
by its identifier, falls below the fraction of the rate; rate = target / tokens of the source.

The sums are combined before they are shuffled. The table of sources has a row for each source; up to
BROADCAST_SOURCES rows it is broadcast, beyond that the join is by (source, salt) with the table repeated for each
salt, so that a hot source is spread either way.

Defined results:
- null text: size 0; null source: a source of its own, last; null identifier: the coin of the word "null"
- a source without tokens: target 0 and no copies; a document without tokens in a source with some: copies as any other
- repeated rows: the same coin, so the same number of copies each; empty table: no rows; extra columns: kept by ``mixed``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"
BROADCAST_SOURCES = 100_000
SALTS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sizes: source, source_size. Adds target, a double. A row for each source, so one task holds them all."""
    exact = "decimal(38,0)"
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", weight.cast(exact)).withColumn("cap", (F.col("source_size") * limit).cast(exact))
    every = W.partitionBy()
    x = x.withColumns({"t": F.sum("source_size").over(every).cast(exact), "ws": F.sum("w").over(every).cast(exact)})
    before = W.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = {"t_left": F.col("t") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_left": F.col("ws") - F.coalesce(F.sum("w").over(before), F.lit(0))}
    x = x.withColumns({k: v.cast(exact) for k, v in rest.items()})
    x = x.withColumn("full", F.col("cap") * F.col("w_left").cast("decimal(18,0)") <= F.col("w").cast("decimal(9,0)") * F.col("t_left"))
    x = x.withColumns(
        {
            "num": (F.col("t") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))).cast(exact),
            "den": (F.col("ws") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0))).cast(exact),
        }
    )
    share = (F.col("num") * F.col("w").cast("decimal(9,0)")).cast("double") / F.col("den").cast("double")
    return x.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def coin(identifier: Column, seed: str = SEED) -> Column:
    """In [0, 1), from 52 bits of a digest of the seed and the identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as a struct _row, with _size, _source_size, _target and _copies."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("_size"))
    sizes = written(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size")), "sources")
    plan = targets(sizes, weights, limit).withColumnRenamed("source", "_source")
    if sizes.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_source")), "left")
    else:
        plan = plan.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        rows = rows.withColumn("_s", F.pmod(F.xxhash64("_id", "_size"), F.lit(SALTS)).cast("int"))
        rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_salt")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = F.least(whole + F.when(coin(F.col("_id"), seed) < rate - whole, 1).otherwise(0), F.lit(limit)).cast("long")
    return rows.select("_row", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.alias("_copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    rows = with_copies(docs, **options).filter("_copies > 0")
    return rows.select("_row", F.explode(F.expr("sequence(1, _copies)"))).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
