"""Language-model scoring: the base exactly, the model by its gradient, its normalisation and held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import attention, bpe, lm, pieces, queries
from tallyweave.llm.pieces import Pieces


def brute(rows):
    docs = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for (_, d), h in zip(docs, held) if not h for w in d)
    n, v = sum(counts.values()), len(counts)
    out = {}
    for (i, d), h in zip(docs, held):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        out[i] = (h, len(d), sum(counts[w] > 0 for w in d), n, base)
    return out


def test_query(spark, small, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_CHARS", 60_000)  # several chunks
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    exp = brute(rows)
    got = queries.QUERIES["op9_lm_scoring"](spark, small).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == exp[r.doc_id][:4]
        assert r.base_score == pytest.approx(exp[r.doc_id][4], rel=1e-9)
        assert r.score < 0


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a\tb"), (4, "a " * 3000), (5, "ü \U0001f600 x")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, place int, id string")
    got = {r.doc_id: r for r in lm.scored(df).collect()}
    exp = brute(rows)
    for i, e in exp.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == e[1:4] and got[i].base_score == pytest.approx(e[4])
    assert lm.scored(df.limit(0)).collect() == []


def made_lexicon(seed=0, used=60, size=100):
    rng = np.random.default_rng(seed)
    ids = np.sort(rng.choice(size, used, replace=False))
    lex = attention.lexicon(ids, rng.integers(1, 50, used).astype(float), rng.normal(size=(used, 6)), rng.normal(size=(used, 6)), size)
    return attention.with_counts(lex, rng.integers(0, 9, (attention.STATES + 1, used + 1)).astype(float) * (np.arange(used + 1) < used))


@pytest.mark.parametrize("n", [3, 400])
def test_trains_on_every_token(spark, n):
    lex = made_lexicon()
    ids = (np.arange(1, n + 1) % 100).astype(np.uint16)
    rows = spark.createDataFrame([(False, bytearray(ids.tobytes()))], "held boolean, subwords binary").coalesce(1)
    trainer = attention.Trainer(attention.initial(), lex)
    made = attention.windows(lex.column[ids], lex.begin, attention.WINDOW)
    assert made[2].sum() == n
    for a in range(0, len(made[0]), attention.BATCH):
        trainer.step(*(m[a : a + attention.BATCH] for m in (made[0], made[1], made[2].astype(np.float32))))
    got = attention.pack(lm._trained(rows, lex, 100))
    assert np.allclose(got, attention.pack(trainer.p), atol=1e-5) and not np.allclose(got, attention.pack(attention.initial()), atol=1e-5)


def test_gradient():
    rng = np.random.default_rng(0)
    lex = made_lexicon()
    p = {k: v.astype(np.float64) for k, v in attention.initial().items()}
    inputs = rng.integers(0, 62, (3, attention.WINDOW))
    targets = lex.class_[rng.integers(0, 61, (3, attention.WINDOW))]
    weight = rng.integers(0, 2, (3, attention.WINDOW)).astype(float)

    def loss():
        logp, _ = attention.forward(p, lex, inputs)
        return -(np.take_along_axis(logp, targets[..., None], -1)[..., 0] * weight).sum() / weight.sum()

    logp, kept = attention.forward(p, lex, inputs)
    g = attention.gradient(p, kept, logp, targets, weight)
    for k in p:
        flat = p[k].reshape(-1)
        for i in rng.integers(0, len(flat), 3):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_scores_are_the_forward_pass():
    rng = np.random.default_rng(3)
    lex = made_lexicon()
    model = attention.Model(attention.initial(), lex)
    texts = [rng.integers(0, 100, n) for n in (1, 3, attention.WINDOW, attention.WINDOW + 1, 777)]
    for got, ids in zip(model.scores(texts), texts):
        inputs, targets, weight = attention.windows(lex.column[ids], lex.begin)
        logp, _ = attention.forward(model.params, lex, inputs)
        own = np.take_along_axis(logp, lex.class_[targets % 61][..., None], -1)[..., 0] + lex.weight[lex.state[inputs], targets % 61]
        assert got == pytest.approx(own[weight].sum() / np.log(10), rel=1e-4)


def test_windows_score_each_token_once():
    for n in (1, 5, attention.WINDOW, attention.WINDOW + 1, 100, 1000):
        for stride in (attention.STRIDE, attention.WINDOW):
            columns = np.arange(n) % 50
            inputs, targets, weight = attention.windows(columns, 99, stride)
            assert sorted(targets[weight].tolist()) == sorted(columns.tolist())
            assert inputs[0, 0] == 99


def test_causal_and_normalised():
    """Nothing after a place counts at it; every id's probability adds up to one, and ids of one class differ."""
    lex = made_lexicon()
    p = attention.initial()
    a = np.random.default_rng(1).integers(0, 9, (1, attention.WINDOW))
    b = a.copy()
    b[0, 10:] = 20
    x, y = attention.forward(p, lex, a)[0], attention.forward(p, lex, b)[0]
    assert np.allclose(x[0, :10], y[0, :10], atol=1e-5) and not np.allclose(x[0, 10], y[0, 10], atol=1e-5)
    ids = np.arange(100)
    for prefix in ([], [3], [5, 5, 77], list(range(30))):
        model = attention.Model(p, lex)
        whole = model.scores([np.array([*prefix, i]) for i in ids])
        first = model.scores([np.array(prefix)])[0] if prefix else 0.0
        assert np.sum(10.0 ** (whole - first)) == pytest.approx(1, rel=1e-3)
        assert len(set(np.round(whole, 9))) > attention.CLASSES


def test_words_in_context(spark):
    """On held-out sentences whose words depend on those before, the model beats the counts of words, and shuffled words score lower."""
    import random

    r = random.Random(3)
    follows = {w: r.sample(range(40), 2) for w in range(40)}
    names = ["".join(r.choice(["ba", "ke", "lo", "mi", "tu", "za", "re", "no"]) for _ in range(2)) + str(i) for i in range(40)]

    def sentence(n):
        out = [r.randrange(40)]
        while len(out) < n:
            out.append(r.choice(follows[out[-1]]))
        return [names[w] for w in out]

    texts = [sentence(60) for _ in range(900)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10_000 + i, " ".join(r.sample(t, len(t)))) for i, t in enumerate(texts[:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {x.doc_id: x for x in lm.scored(df.filter("doc_id < 10000 OR crc32(cast(doc_id as string)) % 5 = 1")).collect()}
    held = [x for i, x in got.items() if x.held_out and i < 10_000]
    mixed = [x for i, x in got.items() if i >= 10_000]
    assert sum(x.score for x in held) > 0.8 * sum(x.base_score for x in held)
    assert np.mean([x.score for x in held]) > np.mean([x.score for x in mixed]) + 5


def test_held_out_documents(spark):
    """On the driver's texts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [x for x in lm.scored(docs).collect() if x.held_out]
    score, base, n = (sum(x) for x in zip(*((x.score, x.base_score, x.n_tokens) for x in held)))
    print("per token", score / n, base / n)
    assert score > 1.25 * base


def test_pieces():
    import random

    v = bpe.vocabulary(bpe.default_path())
    known = {b: i for i, b in enumerate(v.bytes)}
    r = random.Random(1)
    words = ["".join(r.choice("abcdé th123.") for _ in range(r.randrange(14))).replace(" ", "").encode() for _ in range(500)] + [b"", b"x" * 5000, b"the", "😀".encode()]
    flat, many = Pieces(v).cut(words)
    at = 0
    for w, n in zip(words, many):
        got = flat[at : at + n].tolist()
        at += n
        assert b"".join(v.bytes[i] for i in got) == b" " + w
        if len(w) + 1 <= pieces.SPAN:
            exp, k, text = [], 0, b" " + w
            while k < len(text):
                m = next(m for m in range(pieces.LONGEST, 0, -1) if k + m <= len(text) and text[k : k + m] in known)
                exp.append(known[text[k : k + m]])
                k += m
            assert got == exp
    assert at == len(flat) and Pieces(v).cut([])[0].tolist() == []


def test_repeated_rows_and_null_identifiers(spark):
    rows = [(None, "a b c"), (None, "a b c"), (7, "x y"), (7, "x y"), (9, None)]
    got = sorted(((x.doc_id, x.n_tokens, round(x.score, 6)) for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [g[:2] for g in got] == [(7, 3), (7, 3), (9, 1), (None, 4), (None, 4)] and got[0] == got[1] and got[3] == got[4]


def test_vocabulary_fits_sixteen_bits():
    assert len(bpe.vocabulary(bpe.default_path()).bytes) < 2**16
