"""Exact deduplication by content sort, in DataFrame functions alone.

Texts are normalised (A-Z lower-cased; null counts as empty) and written once with their leading characters. Splitters sampled from that table deal the rows
out by ranges of (leading characters, salt), so each partition holds a range of the sorted contents; the external sort inside a partition by the whole
normalised text places equal texts next to each other, and the window over it compares neighbours in full. Splitters carry LEAD characters, not whole
texts, which bounds what the sampling sends to the driver; texts that agree in these are parted by the sort.

Hot ranges: counts by hash tell where more rows than a quarter of a mean partition share their leading characters. There are fewer than 4 x partitions
of these, which bounds the broadcasts. Where they are different texts, the salt is a hash of the text. Where they are one text, its rows lie in
several runs by row number, and the runs meet by the whole text. Hashes only balance the work; texts that differ never count as equal.

Defined results:
- null text: as the empty text; null identifier: sorts last, kept only if the whole group has none
- ties (repeated rows with one identifier and text): exactly one of them is kept
- empty table: no rows; extra columns: ignored, or returned untouched by ``deduplicated``
- long texts: compared whole; the sort spills
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import ascii_lower, shuffle_partitions, written

LEAD = 256


def _normal(text: Column) -> Column:
    """A-Z lower-cased; a text of one byte a character takes the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def _runs(docs: DataFrame, keep: str, id_col: str, text_col: str, whole_rows: bool) -> DataFrame:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    columns = [F.col(id_col).alias("_id"), text.alias("_text")]
    if whole_rows:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("_was_null")).alias("_row"))
    rows = docs.select(*columns).withColumn("_norm", _normal(F.col("_text")))
    rows = rows.withColumns({"_lead": F.substring("_norm", 1, LEAD), "_hash": F.xxhash64("_norm"), "_n": F.monotonically_increasing_id()})
    rows = written(rows.drop("_norm" if whole_rows else "_text"), "texts")
    share = max(32, -(-rows.count() // (4 * shuffle_partitions(docs.sparkSession))))
    counts = written(rows.groupBy(F.xxhash64("_lead").alias("_range"), "_hash").agg(F.count(F.lit(1)).alias("_rows")), "counts")
    # more than share rows each, so fewer than 4 x partitions of either
    texts = counts.filter(F.col("_rows") > share).select("_hash", F.ceil(4 * F.col("_rows") / share).alias("_spread"))
    ranges = counts.groupBy("_range").agg(F.sum("_rows").alias("_rows")).filter(F.col("_rows") > share).select("_range", F.ceil(4 * F.col("_rows") / share).alias("_parts"))
    rows = rows.withColumn("_range", F.xxhash64("_lead")).join(F.broadcast(texts), "_hash", "left").join(F.broadcast(ranges), "_range", "left")
    by_text = F.pmod("_hash", F.col("_parts"))
    by_row = F.col("_parts") + F.pmod(F.xxhash64("_n"), F.col("_spread"))
    rows = rows.withColumn("_salt", F.when(F.col("_spread").isNotNull(), by_row).when(F.col("_parts").isNotNull(), by_text).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("_hot", F.col("_spread").isNotNull()).drop("_range", "_spread", "_parts", "_hash")
    rows = rows.repartitionByRange("_lead", "_salt")
    if whole_rows:
        rows = rows.withColumn("_norm", _normal(F.col("_text")))
    run = W.partitionBy("_lead", "_salt", "_norm")
    ends = run.orderBy(order, "_n")
    rows = rows.withColumns({"_place": F.row_number().over(ends), "_first": F.first(F.struct("_id", "_n")).over(ends), "_size": F.count(F.lit(1)).over(run)})
    if texts.isEmpty():
        return rows.withColumns({"_keep": F.col("_first._id"), "_group": F.col("_size"), "_kept": F.col("_place") == 1})
    # runs of one text, fewer than 16 for each quarter of a partition, meet by the whole text; the sorted rows are shuffled once for both uses
    known = F.col("_first._id").isNotNull()
    best = F.min(F.struct((~known).alias("none"), F.col("_first._id").alias("_id"), F.col("_first._n").alias("n")))
    if keep == "largest":
        best = F.max(F.struct(known.alias("known"), F.col("_first._id").alias("_id"), (-F.col("_first._n")).alias("n")))
    groups = rows.filter("_hot AND _place = 1").groupBy("_norm").agg(F.sum("_size").alias("_sum"), best.alias("_best"))
    groups = groups.select(F.col("_norm").alias("_whole"), "_sum", F.col("_best._id").alias("_best_id"), F.abs("_best.n").alias("_best_n"))
    rows = rows.join(F.broadcast(groups), F.when(F.col("_hot"), F.col("_norm")) == F.col("_whole"), "left")
    hot = F.col("_whole").isNotNull()
    return rows.withColumns({"_keep": F.when(hot, F.col("_best_id")).otherwise(F.col("_first._id")), "_group": F.when(hot, F.col("_sum")).otherwise(F.col("_size")), "_kept": F.when(hot, F.col("_n") == F.col("_best_n")).otherwise(F.col("_place") == 1)})


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its identifier, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return _runs(docs, keep, id_col, text_col, False).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_group").alias("group_size"), F.col("_kept").alias("kept"), F.sha2("_norm", 256).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies; all columns as they were."""
    rows = _runs(docs, keep, id_col, text_col, True).filter("_kept")
    text = F.when(~F.col("_row._was_null"), F.col("_text")).alias(text_col)
    return rows.select(*[text if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
