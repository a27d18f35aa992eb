"""The Jaccard join against all pairs."""

import random
from itertools import combinations
from math import comb

import numpy as np
import pytest

from tallyweave.llm import jaccard, queries
from tallyweave.llm.shingles import shingle_sets


def sets_of(texts, words):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    return out


def brute(rows, words, percent):
    """rows: (id, text). Components by all pairs."""
    sets = sets_of([t for _, t in rows], words)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_element = {}
    for i, s in enumerate(sets):
        for e in s:
            by_element.setdefault(e, []).append(i)
    pairs = {p for found in by_element.values() for p in combinations(found, 2)}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def made(seed, n=120):
    """Bases with near copies of many sizes, a passage that many share, and copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(n):
        text = [word() for _ in range(r.choice([0, 1, 2, 3, 5, 9, 12, 20, 23, 40, 100, 300]))]
        if r.random() < 0.3:
            text += passage
        rows.append(" ".join(text))
        for _ in range(r.choice([0, 0, 1, 3])):
            near = list(text)
            for _ in range(r.choice([0, 1, 2, 3, 8])):
                if near:
                    near[r.randrange(len(near))] = word()
            if r.random() < 0.3:
                near = near[: max(1, len(near) * 9 // 10)]
            rows.append(" \n".join(near).upper() if r.random() < 0.2 else " ".join(near))
    return [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(0, None), (2, " \t")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, i, "clash") for i, t in rows], "doc_id long, text string, id long, sid string")


@pytest.mark.parametrize("words,percent,seed", [(3, 90, 1), (5, 80, 2), (1, 70, 3)])
def test_components(spark, words, percent, seed):
    rows = made(seed)
    got = jaccard.linked(frame(spark, rows), words, percent).collect()
    assert sorted(map(tuple, got)) == brute(rows, words, percent)


def test_large_group_of_near_copies(spark):
    r = random.Random(5)
    text = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*text[: (k := r.randrange(140))], f"x{i}", *text[k + 1 + r.randrange(3) :]])) for i in range(300)]
    got = jaccard.linked(frame(spark, rows), 3, 90).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 90)


def test_group_over_many_parts(spark, monkeypatch):
    """A key's parts each merge into one component before any two of them have met."""
    monkeypatch.setattr(jaccard, "MOST", 33)
    text = [f"w{i}" for i in range(250)]
    rows = [(i, " ".join([*text, f"x{i}"])) for i in range(400)]
    got = jaccard.linked(frame(spark, rows), 3, 99).collect()
    assert {(r.n_shingles, r.component_id) for r in got} == {(249, 0)} and len(got) == 400


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op6_jaccard"](spark, small)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 90)


def test_empty_and_repeated(spark):
    nothing = frame(spark, [(1, "a b c")]).limit(0)
    assert jaccard.linked(nothing).collect() == []
    got = jaccard.linked(frame(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e  f"), (11, "other words here")])).collect()
    assert sorted(map(tuple, got)) == [(4, 2, 4), (4, 2, 4), (9, 2, 4), (11, 1, 11)]


def test_representatives_keep_columns(spark):
    docs = frame(spark, [(4, "a b c d e f"), (9, "A b c d e  f"), (11, "other words here"), (12, None), (13, None)])
    got = jaccard.representatives(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [4, 11, 12, 13]


def test_sizes_cover_all_partners():
    for percent in (70, 80, 90, 95):
        sizes = jaccard.Sizes(percent)
        for a in range(1, 400):
            for b in range(a, a * 100 // percent + 1):
                least = -(-percent * (a + b) // (100 + percent))
                # the first common shingle leaves the others behind it
                assert a - least < sizes.own_prefix(a) or least > a
                assert b - least < sizes.prefix(b)
                if b < 60:
                    assert a - least <= sizes.left_out(a) and b - least <= sizes.left_out(b)


@pytest.mark.parametrize("seed,held,most", [(11, 1, 8192), (12, 4, 16), (13, 4096, 16)])
def test_long_lists(spark, monkeypatch, seed, held, most):
    """Lists that pass through, that are dealt out by salt and that are split in parts give the same."""
    monkeypatch.setattr(jaccard, "HELD", held)
    monkeypatch.setattr(jaccard, "MOST", most)
    rows = made(seed, 80)
    r = random.Random(seed)
    text = [f"w{i}" for i in range(60)]
    rows += [(10_000 + i, " ".join([*text[: (k := r.randrange(58))], f"x{i}", *text[k + 1 :]])) for i in range(90)]
    got = jaccard.linked(frame(spark, rows).repartition(4), 3, 90).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, 90)


def test_null_and_repeated_identifiers(spark):
    text = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join([*text, "x"])), (5, " ".join(text)), (None, "quite another text of words"), (7, " ".join(["y", *text])), (7, "a b c d e f g h"), (8, None), (None, None)]
    got = jaccard.linked(frame(spark, rows), 3, 90).collect()
    order = lambda x: [(v is None, v) for v in x]
    exp = [(None, 99, 5), (5, 98, 5), (None, 3, None), (7, 99, 5), (7, 6, 7), (8, 0, 8), (None, 0, None)]
    assert sorted(map(tuple, got), key=order) == sorted(exp, key=order)
    kept = jaccard.representatives(frame(spark, rows), 3, 90).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=order) == sorted(((d, t) for d, t in rows if (d, t) not in (rows[0], rows[3])), key=order)


def test_representatives_by_row(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(2, base), (4, base + " fourteen"), (4, "nothing of the kind is in this text"), (9, "t u v w x y z"), (9, "t u v w x y z"), (10, " "), (10, " ")]
    kept = jaccard.representatives(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[2], rows[3], rows[5], rows[6]])
    assert jaccard.representatives(frame(spark, rows).limit(0)).collect() == []


def test_very_long_text(spark):
    r = random.Random(3)
    text = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:-200])), (3, " ".join(text[::-1]))]
    got = jaccard.linked(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_links(spark, monkeypatch, seed):
    """Chains, a star, nulls, repeated and turned edges; small bounds make spread_join take all its ways."""
    from tallyweave.llm import common, components

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 201 + i) for i in range(40)] + [(201, 200), (7, 7), (None, 3), (3, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    exp = sorted((x, find(x)) for x in root)
    got = components.components(spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, node string"))
    known = sorted(map(tuple, got.collect()))
    assert [x for x in known if x[0] != x[1]] == [x for x in exp if x[0] != x[1]]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spread_join(spark, monkeypatch):
    from tallyweave.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    big = spark.range(9000).selectExpr("if(id < 6000, 7, id) k", "id v")
    unique = spark.range(0, 9000, 2).selectExpr("id + 1 k", "id w")
    got = common.spread_join(big, unique, ["k"])
    assert sorted(map(tuple, got.select("k", "v", "w").collect()), key=str) == sorted(map(tuple, big.join(unique, "k", "left").select("k", "v", "w").collect()), key=str)


def test_subset_keys():
    s = np.arange(1, 13, dtype=np.uint64)
    keys = np.concatenate(jaccard.subset_keys(s, 2))
    assert len(keys) == len(set(keys.tolist())) == 1 + 12 + comb(12, 2)
    part = np.concatenate(jaccard.subset_keys(s[:-1], 1))
    assert part[0] in keys.tolist()


def test_shingle_sets_agree():
    texts = ["A b  C\td", "a B c d", "a b", "A\nb", "a", "", None, "é a b c", "a b c a b c a b c"]
    got = shingle_sets(texts, 3)
    exp = sets_of(texts, 3)
    assert [len(x) for x in got] == [len(x) for x in exp]
    assert (got[0] == got[1]).all() and (got[2] == got[3]).all() and got[2][0] != got[4][0]
