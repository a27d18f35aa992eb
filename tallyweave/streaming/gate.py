"""The publish gate over a stream: every micro-batch is gated, and both sides are appended; a batch that runs again writes the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.review import gate


def gated(records: DataFrame, published: str, held: str, checkpoint: str, threshold: float = 0.75) -> StreamingQuery:
    def write(batch: DataFrame, epoch: int) -> None:
        go, wait = gate(batch, threshold)
        go.write.mode("overwrite").parquet(f"{published}/epoch={epoch}")
        wait.write.mode("overwrite").parquet(f"{held}/epoch={epoch}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demand(intake: DataFrame, at: str, place: str, window: str = "7 days", late: str = "1 day", local_from: int = 50, national_from: int = 200) -> DataFrame:
    """Counts of intake by place and window, routed by threshold."""
    x = intake.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), place).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("route", F.when(F.col("n") >= national_from, "national").when(F.col("n") >= local_from, "local").otherwise("none"))
