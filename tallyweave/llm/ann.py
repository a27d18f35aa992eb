"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to unit length; each of TABLES tables has HASHES functions floor((a . x + b) / WIDTH) with normal a. A query visits
the buckets of a table in the order of their estimated success: a perturbation of one function costs the squared
distance to that boundary, costs add up, and the PROBES cheapest sets of perturbations are visited. What the tables give is merged, and the best are
reranked by the exact cosine of the original vectors in double precision.

Equal vectors are indexed once, with their ``best + 1`` smallest identifiers: no query can need more of them. Every vector is
indexed. Inside a bucket the rows stream through numpy; a bucket of more than MOST rows is split by salt and the queries visit each part, so a hot
bucket is neither capped nor one task's. A query that finds too few candidates gets an exhaustive pass in blocks by the same route.

Defined results:
- vectors that are null, zero, of another length than most, or hold null or non-finite components take no part
- ties go to the smaller identifier, however many rows tie (parallel vectors); fewer candidates than asked for: all of them; empty table: no rows; extra columns: ignored
- repeated rows (one identifier and vector twice): count once
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import written

TABLES, HASHES, WIDTH, PROBES, SEED = 10, 4, 1.0, 30, 7
MOST = 20_000
BLOCK = 256
#: Pairs that are compared exactly at once.
PAIRS = 50_000
BROADCAST_BUCKETS = 100_000


class Hasher:
    def __init__(self, dims: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = SEED) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.normal(size=(tables, dims, hashes))
        self.b = rng.uniform(0, width, (tables, hashes))
        self.mult = rng.integers(1, 2**62, (tables, hashes)) * 2 + 1
        self.sets = np.array(list(product((-1, 0, 1), repeat=hashes)), np.int64)
        self.width, self.probes = width, min(probes, len(self.sets))

    def _cells(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = (x @ self.a[t] + self.b[t]) / self.width
        cells = np.floor(at)
        return cells.astype(np.int64), (at - cells) * self.width

    def _key(self, cells: np.ndarray, t: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = (cells * self.mult[t]).sum(-1)
            return (key ^ (key >> 29)) * 31 + t

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """A column for each table."""
        return np.stack([self._key(self._cells(x, t)[0], t) for t in range(len(self.a))], 1)

    def visits(self, x: np.ndarray) -> np.ndarray:
        """For each row the buckets to visit: tables x probes, each table's in order of estimated success."""
        out = []
        low, high = (self.sets == -1).astype(float).T, (self.sets == 1).astype(float).T
        for t in range(len(self.a)):
            cells, rest = self._cells(x, t)
            cost = rest**2 @ low + (self.width - rest) ** 2 @ high
            order = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            out.append(self._key(cells[:, None, :] + self.sets[order], t))
        return np.concatenate(out, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _packed(x: np.ndarray) -> pa.Array:
    """A binary column with a vector's doubles in each row: Spark moves it as it is, where an array would be taken apart number by number."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _hashed(vectors: DataFrame, hasher: Hasher | None, query: bool) -> DataFrame:
    """vectors: vid, vec. A row for each bucket that a vector is in, or that a query visits; without a hasher all share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                whole = _matrix(part.column(1))
                x = whole / np.linalg.norm(whole, axis=1)[:, None]
                keys = np.zeros((len(x), 1), np.int64) if hasher is None else hasher.visits(x) if query else hasher.buckets(x)
                for b in range(0, len(x), 32):  # a query goes to many buckets
                    n = len(x[b : b + 32])
                    take = np.repeat(np.arange(b, b + n), keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[b : b + 32].reshape(-1)), part.column(0).take(pa.array(take)), _packed(whole[take])], names=["bucket", "vid", "vec"])

    return vectors.select("vid", "vec").mapInArrow(run, "bucket long, vid long, vec binary").withColumn("query", F.lit(int(query)))


def _best_of(x: np.ndarray, vids: np.ndarray, q: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the best rows: the query's place, the row's, and their exact cosine. Rows whose rough score is within its rounding error of the
    best-th are all compared exactly, so ties of any number go to the smaller identifier."""
    nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    rough = (q / nq[:, None]) @ (x / nx[:, None]).T
    n = min(len(x), best)
    least = np.partition(rough, len(x) - n, axis=1)[:, len(x) - n]
    places, rows = np.nonzero(rough >= (least - 4e-16 * (x.shape[1] + 16))[:, None])
    exact = np.empty(len(rows))
    for a in range(0, len(rows), PAIRS):
        some, other = rows[a : a + PAIRS], places[a : a + PAIRS]
        exact[a : a + PAIRS] = (x[some] * q[other]).sum(1) / (nx[some] * nq[other])
    order = np.lexsort((vids[rows], -exact, places))
    places, rows, exact = places[order], rows[order], exact[order]
    kept = np.arange(len(places)) - np.searchsorted(places, places) < best
    return places[kept], rows[kept], exact[kept]


def _searched(index: DataFrame, queries: DataFrame, best: int) -> DataFrame:
    """qvid, vid, score: for each query and part of a bucket the best in it."""
    counts = index.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / MOST).alias("parts")).filter("parts > 1")
    counts = written(counts, "buckets")
    if counts.count() <= BROADCAST_BUCKETS:
        counts = F.broadcast(counts)
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(counts, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("vid"), parts))
    queries = queries.join(counts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    columns = ["bucket", "part", "query", "vid", "vec"]
    rows = index.select(*columns).unionByName(queries.select(*columns)).repartition("bucket", "part").sortWithinPartitions("bucket", "part", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], []
        stacked: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held and waiting:
                if not stacked:
                    stacked.extend((np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))
                vids, x = stacked
                qv, q = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                for a in range(0, len(q), BLOCK):
                    place, near, score = _best_of(x, vids, q[a : a + BLOCK], best)
                    yield pa.RecordBatch.from_arrays([pa.array(qv[a + place]), pa.array(vids[near]), pa.array(score)], names=["qvid", "vid", "score"])
            waiting.clear()

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)], 1)
            vids, x = batch.column(3).to_numpy(), _unpacked(batch.column(4))
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now != tuple(keys[a, :2]):
                    yield from flush()
                    held.clear()
                    stacked.clear()
                    now = tuple(keys[a, :2])
                if keys[a, 2] == 0:
                    held.append((vids[a:b], x[a:b]))
                else:
                    waiting.append((vids[a:b], x[a:b]))
                    if sum(len(w[0]) for w in waiting) >= 8 * BLOCK:
                        yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "qvid long, vid long, score double")


def usable(vec: Column) -> Column:
    """Whether a vector has length and only finite components."""
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, best: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", hasher: Hasher | None = None) -> DataFrame:
    """query_id, rank, the neighbour's id as vec_id, score. is_query: over a column ``id``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = common[0]["dims"] if common else 1
    rows = rows.filter(F.size("vec") == dims)
    few = rows.groupBy("vec", "id").agg(F.lit(1).alias("one")).withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= best + 1)
    kept = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("vid", F.element_at("ids", 1))
    kept = written(kept, "vectors")
    asked = written(rows.filter(is_query).select("id", "vec").distinct().join(kept.select("vec", "vid"), "vec").select(F.col("id").alias("query_id"), "vid"), "asked")
    queries = kept.join(asked.select("vid").distinct(), "vid", "left_semi")
    hasher = hasher or Hasher(dims)
    top = lambda df: df.dropDuplicates(["qvid", "vid"]).withColumn("r", F.row_number().over(W.partitionBy("qvid").orderBy(F.desc("score"), "vid"))).filter(F.col("r") <= best + 1).drop("r")
    found = written(top(_searched(_hashed(kept, hasher, False), _hashed(queries, hasher, True), best + 1)), "found")
    enough = min(best + 1, kept.limit(best + 1).count())
    short = queries.join(found.groupBy("qvid").count().filter(F.col("count") >= enough).select(F.col("qvid").alias("vid")), "vid", "left_anti")
    if not short.isEmpty():
        found = top(found.unionByName(_searched(_hashed(kept, None, False), _hashed(short, None, True), best + 1)))
    each = found.join(kept.select("vid", "ids"), "vid").select("qvid", "score", F.explode("ids").alias("vec_id"))
    each = each.join(asked, F.col("qvid") == F.col("vid")).filter("vec_id <> query_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", place).filter(F.col("rank") <= best).select("query_id", "rank", F.col("vec_id"), "score")
