"""Neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import ann, queries


def brute(rows, query, best=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for i, v in zip(ids, x):
        if query(i):
            s = (x * v).sum(1) / (n * np.sqrt((v * v).sum()))
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:best]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, exp):
    return sum(len({a for a, _ in got.get(q, [])} & {a for a, _ in e}) for q, e in exp.items()) / sum(map(len, exp.values()))


def test_query_recall(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    exp = brute(rows, lambda i: i % 50 == 0)
    got = got_of(queries.QUERIES["op3_ann"](spark, path))
    assert got.keys() == exp.keys() and recall(got, exp) >= 0.9
    scores = {(q, a): s for q, e in exp.items() for a, s in e}
    for q, e in got.items():
        assert len(e) == 5
        for a, s in e:
            assert abs(s - scores.get((q, a), s)) < 1e-12


def test_edges(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(6, 8)).astype("float32").tolist()
    rows = [(i * 10, base[0]) for i in range(1, 12)] + [(i, base[i % 6]) for i in range(1, 6)]
    bad = [(1000, None), (1010, [0.0] * 8), (1020, [1.0] * 7 + [None]), (1030, [1.0] * 7 + [float("nan")]), (1040, [float("inf")] * 8), (1050, [1.0])]
    df = spark.createDataFrame([(*x, 1) for x in rows + bad + rows[:2]], "vec_id long, embedding array<float>, id int")
    got = got_of(ann.nearest(df, F.col("id") % 10 == 0))
    exp = brute(rows, lambda i: i % 10 == 0)
    assert got.keys() == exp.keys()
    for q in exp:
        assert [a for a, _ in got[q]] == [a for a, _ in exp[q]]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [-1.0, 0.1])], "vec_id long, embedding array<float>")
    got = got_of(ann.nearest(df, F.col("id") % 50 == 0))
    assert [a for a, _ in got[0]] == [50, 7] and [a for a, _ in got[50]] == [7, 0]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).collect() == []


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST", 20)
    r = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + 0.01 * r.normal(size=8)).tolist()) for i in range(300)]
    got = got_of(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0))
    assert recall(got, brute(rows, lambda i: i % 50 == 0)) >= 0.9


def test_parallel_vectors(spark):
    """Two hundred multiples of one vector by powers of two tie exactly; the smallest identifiers win."""
    r = np.random.default_rng(9)
    for seed in range(3):
        v = r.normal(size=16)
        rows = [(int(i), (v * 2.0 ** int(r.integers(-8, 9))).tolist()) for i in range(200)] + [(200 + i, r.normal(size=16).tolist()) for i in range(30)]
        got = got_of(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0))
        exp = brute(rows, lambda i: i % 50 == 0)
        assert {q: [a for a, _ in g] for q, g in got.items() if q < 200} == {q: [a for a, _ in e] for q, e in exp.items() if q < 200}


def test_best_of_ties():
    x = np.concatenate([np.tile([[3.0, 4.0]], (100, 1)) * 2.0 ** np.arange(100)[:, None] / 2.0**50, [[1.0, 0.0]]])
    vids = np.random.default_rng(1).permutation(101)
    place, near, score = ann._best_of(x, vids, np.array([[3.0, 4.0], [1.0, 0.0]]), 6)
    assert [sorted(vids[near[place == 0]].tolist())] == [sorted(sorted(vids[:100].tolist())[:6])] and (score[place == 0] == 1.0).all()
    assert near[place == 1][0] == 100 and len(near) == 12
