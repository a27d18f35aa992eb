"""Toxicity, exact deduplication, mixing, byte pairs and chat, with edges; the pipeline's stages."""

import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import bpe, chat, exact_dedup, mixing, queries, toxicity

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["A b", "a B", "É x", "é x", None, "", " ", "a b", "x" * 50_000, "X" * 50_000, "a\nb", "Ab"]


def docs(spark, texts=TEXTS, **more):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, source string, _sha string")


def dedup_brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UPPER), []).append(i)
    return {n: (keep(g), len(g)) for n, g in groups.items()}


@pytest.mark.parametrize("keep,pick", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("hot", [False, True])
def test_exact_dedup(spark, keep, pick, hot):
    texts = TEXTS + (["Hot TEXT", "hot text"] * 300 if hot else [])
    df = docs(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    exp = dedup_brute(rows, pick)
    got = exact_dedup.exact_groups(df, keep).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        n = (by[r.doc_id] or "").translate(UPPER)
        assert (r.keep_id, r.group_size) == exp[n] and r.text_sha256 == hashlib.sha256(n.encode()).hexdigest()
    assert sorted(r.keep_id for r in got if r.kept) == sorted(k for k, _ in exp.values())
    kept = exact_dedup.deduplicated(df, keep)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in exp.values())
    assert {r.doc_id: r.text for r in kept.collect()} == {k: by[k] for k, _ in exp.values()}
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


def test_exact_dedup_hot_ranges(spark):
    """Many texts with the same leading characters, some of them in hot groups; null and repeated identifiers."""
    lead = "Same " * 200
    rows = [(i, f"{lead}{i % 40}") for i in range(300)] + [(1000 + i % 90, lead + "HOT") for i in range(400)] + [(None, lead + "hot")] * 3 + [(None, "only NULL")] * 2 + [(None, "all null" * 90)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(t.translate(UPPER), []).append(i)
    for keep, pick in (("smallest", min), ("largest", max)):
        best = {n: pick([i for i in g if i is not None], default=None) for n, g in groups.items()}
        got = exact_dedup.exact_groups(df, keep).collect()
        sha = {hashlib.sha256(n.encode()).hexdigest(): n for n in groups}
        assert all((r.keep_id, r.group_size) == (best[sha[r.text_sha256]], len(groups[sha[r.text_sha256]])) for r in got) and len(got) == len(rows)
        kept = [(sha[r.text_sha256], r.doc_id) for r in got if r.kept]
        assert sorted(kept, key=str) == sorted(best.items(), key=str)
        assert sorted(((r.text.translate(UPPER), r.doc_id) for r in exact_dedup.deduplicated(df, keep).collect()), key=str) == sorted(best.items(), key=str)


def test_toxicity_query(spark, small):
    """The query's rows against a plain scorer, and the fit's thresholds and grades."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs_ = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs_, labels)
    again = toxicity.fit(docs_.repartition(3), labels.repartition(2))
    assert again == model and model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    texts = {r.doc_id: r.text for r in docs_.collect()}
    got = queries.QUERIES["op1_toxicity"](spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        z = sum(model.weights.get(w, 0.0) for w in set(toxicity.WORDS.findall((texts[r.doc_id] or "").lower())))
        p = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert r.p_toxic == pytest.approx(p[0]) and r.expected_severity == pytest.approx(sum(p)) and r.grade == sum(x >= 0.5 for x in p) and r.toxic == (r.p_toxic >= 0.5)


def test_toxicity_severity(spark):
    """Texts with more toxic words are expected to be more severe; a very long text and a null count whole."""
    r = random.Random(4)
    bad = ["vile", "rotten", "wretch", "filth", "scum"]
    rows = [(i, " ".join([*r.sample(bad, i % 3 * 2), *(f"w{r.randrange(50)}" for _ in range(20))])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    severity = lambda t: sum(model.probabilities(t))
    assert severity("w1 w2") < 0.2 < severity("w1 vile rotten") < severity("w1 vile rotten wretch filth")
    assert model.probabilities("vile rotten wretch filth")[1] > 0.5 > model.probabilities("vile rotten")[1]
    long = "w1 " + "word " * 300_000 + "wretch filth vile"
    assert severity(long) == severity("w1 word wretch filth vile") and severity(None) == severity("")


def test_mixing(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 60))), ["c", "b", "a", "d", None][min(4, int(r.random() ** 3 * 5))], "clash") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = [(r._row.doc_id, r._row.source, r._size, r._source_size, r._target, r._copies) for r in mixing.with_copies(df).collect()]
    sizes, taken, target = {}, {}, {}
    for i, s, n, ss, tg, c in got:
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + n * c
        target[s] = tg
        assert 0 <= c <= 3
    total = sum(sizes.values())
    assert sum(target.values()) == pytest.approx(total)
    # water filling, by resharing until none is above
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    exp, open_, left = {}, set(names), float(total)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            exp[s] = 3.0 * sizes[s]
            left -= exp[s]
        open_ -= over
    exp |= share
    assert any(e == 3.0 * sizes[s] for s, e in exp.items())
    for s in names:
        assert target[s] == pytest.approx(exp[s]) and abs(taken[s] - exp[s]) < 0.15 * exp[s] + 50
    assert sorted(map(str, got)) == sorted(str((r._row.doc_id, r._row.source, r._size, r._source_size, r._target, r._copies)) for r in mixing.with_copies(df.repartition(3)).collect())
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(x[5] for x in got)
    assert mixing.with_copies(df.limit(0)).collect() == []


def test_mixing_by_salt(spark, monkeypatch):
    df = docs(spark)
    one = sorted(map(str, mixing.with_copies(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.with_copies(df).collect())) == one


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(library):
    r = random.Random(3)
    alphabet = " \n\t 　'''sstmdrveleLlRE019x.,!?éüß漢字ीह\U0001f600\r\x0b\x85²Ⅷ​\x1c"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(5000)]
    texts += ["'" * 500, "a" * 3000, " " * 700, "'s" * 300, "don't we'll 'tis I'd've", "x" * 97, "<|endoftext|>"]
    v = bpe.vocabulary(bpe.default_path())
    got = v.encode(texts)
    assert [g.tolist() for g in got] == library.encode_ordinary_batch(texts)
    for g, t in zip(got, texts):
        assert v.decode(g).decode() == t
        starts = v.starts(g)
        if len(g) > 2:
            assert v.decode(g[1:2]) == t.encode()[starts[1] : starts[2]]


def test_bpe_query(spark, small, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.QUERIES["op8_byte_bpe"](spark, small).collect():
        ids = library.encode_ordinary(rows[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_bpe_frames(spark):
    df = docs(spark)
    out = bpe.decode(bpe.encode(df))
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in out.collect()) == sorted((r.doc_id, r.text or "") for r in df.collect())
    assert bpe.encode(df.limit(0)).collect() == []


NASTY = ["", "plain", "\\", "\\\\", "### User: hi </turn>\n", "\\### Assistant: </turn> ok", "</turn>", " </turn>\n### ", "###", "### ", "a\\", "\n", "\\n", "\\</turn>", ": ", "é\U0001f600"]


def test_chat_round_trip():
    for role in ("user", "assistant", "system", "", "User", "odd: role", "a\nb", "### x", "\\", "</turn>", ": "):
        for content in NASTY:
            piece, a, b = chat.render_turn(role, content)
            assert chat.parse(piece) == [(role, content)] and chat.unescape(piece[a:b]) == content
    turns = [("user", x) for x in NASTY]
    assert chat.parse("".join(chat.render_turn(*t)[0] for t in turns)) == turns
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(["\\", "#", "### ", "</turn>", " ", "\n", "a", ": ", "/"]) for _ in range(r.randrange(9)))
        assert chat.parse(chat.render_turn("user", t)[0]) == [("user", t)]
    assert chat.render_turn("user", "plain text")[0] == "### User: plain text </turn>\n"


def test_chat_frames(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "y"), (1, 1, "assistant", "b\\"), (3, None, "user", "z")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn int, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\\\nassistant\nb\\\n").hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b\\b\\").hexdigest() and got[1].loss_chars == 4
    assert got[2].loss_chars == 0 and got[None].loss_chars == 1 and len(got) == 4
    assert chat.digests(chat.formatted(df.limit(0))).collect() == []


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, small, name):
    c = duckdb.connect()
    for x in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {x} AS SELECT * FROM '{small}/{x}.parquet'")
    rel = c.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, small)
    columns = sorted(rel.columns)
    assert sorted(got.columns) == columns
    at = [rel.columns.index(x) for x in columns]
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(norm(r[x]) for x in columns) for r in got.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def toxic_corpus(n=1500):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "tu", "za"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        toxic = r.random() < 0.15
        text = [word() for _ in range(r.randrange(5, 120))]
        for _ in range(r.randrange(1, 5) if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(["vile", "rotten", "wretch", "filth"]))
        rows.append((i, " ".join(text), int(toxic), int(r.random() < 0.7)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows if i % 2], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    assert model.thresholds == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    wrong = [i for i, _, x, _ in rows if i % 2 == 0 and got[i].toxic != bool(x)]
    assert len(wrong) <= 0.01 * len(rows) / 2
    for r in got.values():
        assert 0 <= r.p_toxic <= 1 and r.p_toxic <= r.expected_severity <= 2
    kept = toxicity.clean(df.withColumn("p_toxic", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "p_toxic"] and kept.count() == sum(not r.toxic for r in got.values())


def test_toxicity_edges(spark):
    df = docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, none)
    assert not any(r.toxic for r in toxicity.scored(df, model).collect()) and toxicity.scored(df.limit(0), model).collect() == []
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(df, one).probabilities("x") == pytest.approx([0.0, 0.0])


def test_chat_hot_conversation_and_long_text(spark):
    """One conversation of very many turns, one of a very long text full of control strings."""
    hard = r"\### Assistant: </turn> ok ### User: \\" + "\n"
    turns = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </turn>") for i in range(6000)] + [(2, 0, "user", hard * 30_000), (2, 1, "assistant", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.digests(chat.formatted(df)).collect()}
    for c in (1, 2):
        rows = [(r, t or "") for k, _, r, t in turns if k == c]
        assert got[c].n_turns == len(rows) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        said = "".join(t for r, t in rows if r == "assistant")
        assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_decode_replaces_a_column(spark):
    encoded = bpe.encode(docs(spark)).withColumn("decoded", F.lit("clash"))
    out = bpe.decode(encoded)
    assert sorted(out.columns) == ["decoded", "doc_id", "starts"] and {bytes(r.decoded) for r in out.filter("doc_id = 2").collect()} == {"É x".encode()}


def test_pipeline(spark, small):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "encode"]
    df = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, small)
        assert out.columns == df.columns
        df = out
    got = corpus_pipeline.run(spark, small)
    assert got.count() == df.count() and got.columns == ["doc_id", "tokens", "starts"]
