"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word in a Java or DuckDB pattern: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at once; long texts make the default of 10,000 too many.
ROWS_AT_ONCE = 2_000
#: And bytes, for rows of sets and very long texts.
BYTES_AT_ONCE = 8_000_000


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A worker that waits for its next task gives back the memory of its last one."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_AT_ONCE))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. One of our own only where none is named and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not made.isEmpty():
        return made.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tallyweave-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a table that is broadcast, and hot keys at most.
BROADCAST_ROWS, HOT_KEYS = 50_000, 10_000


def spread_join(big: DataFrame, unique: DataFrame, on: list[str]) -> DataFrame:
    """big left join unique, which holds a key once at most and is a written table. Keys of many rows don't land in one task: their rows of unique,
    no more than HOT_KEYS, are broadcast. The others are shuffled."""
    if unique.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(unique), on, "left")
    sizes = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    # a key with more than a HOT_KEYS-th of all rows is hot, so there are fewer than HOT_KEYS
    limit = max(2000, big.count() // HOT_KEYS)
    hot = written(sizes.filter(F.col("_size") > limit).select(*on), "hot")
    if hot.isEmpty():
        return big.join(unique, on, "left")
    few = written(unique.join(F.broadcast(hot), on, "left_semi"), "hot_rows")
    cold = big.join(F.broadcast(hot), on, "left_anti").join(unique, on, "left")
    return cold.unionByName(big.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, "left"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more rows than that; reads no further than needed."""
    return df.limit(rows + 1).count() <= rows
