"""The corpus pipeline against plain Python, stage by stage, with edges."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tallyweave.llm import mixing, toxicity
from tests.llm.test_jaccard import brute as near_brute

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mixed_brute(rows):
    """rows: (id, text, source). How often each row is taken."""
    size = [len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or " ").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("") if t else 0 for _, t, _ in rows]
    sizes = Counter()
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size))
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    out = []
    for i, _, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        coin = int(hashlib.sha256(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2.0**52
        out.append(min(3, int(rate) + (coin < rate - int(rate))))
    return out


def pipeline_brute(rows, model, library):
    """rows: (id, text, source). What is left after each stage, and the encoded rows."""
    after = []
    rows = [r for r in rows if model.probabilities(r[1])[0] < 0.5]
    after.append(rows)
    groups = {}
    for k, (i, t, _) in enumerate(rows):
        groups.setdefault((t or "").translate(UPPER), []).append((i is None, i or 0, k))
    keep = {min(g)[2] for g in groups.values()}
    rows = [r for k, r in enumerate(rows) if k in keep]
    after.append(rows)
    component = near_brute([(k, t) for k, t in enumerate(t for _, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))], 5, 80)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    rows = [r for k, r in enumerate(order) if component[k][1] == 0 or component[k][2] == k]
    after.append(rows)
    rows = [r for r, n in zip(rows, mixed_brute(rows)) for _ in range(n)]
    after.append(rows)
    return after, Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t, _ in rows)


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def run_and_compare(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    after, encoded = pipeline_brute(rows, model, library)
    now = docs
    for (name, stage), exp in zip(corpus_pipeline.STAGES, after):
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
        assert Counter((r.doc_id, r.text, r.source) for r in now.collect()) == Counter(exp), name
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.tokens, "<u4").tolist())) for r in got) == encoded
    return after


def test_driver_documents(spark, small, library):
    after = run_and_compare(spark, small, library)
    assert all(after)


def test_planted_cases(spark, tmp_path, library):
    """Toxic texts, copies, near copies, shared passages, nulls, repeated rows, a very long text, clashing columns."""
    r = random.Random(8)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "tu", "za"]) for _ in range(r.randrange(1, 4)))
    passage = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        words = [word() for _ in range(r.randrange(5, 90))]
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["vile", "rotten", "wretch"]))
        text = " ".join(words) + (" " + passage if i % 5 == 0 else "")
        rows.append((i * 4, text, f"s{zlib.crc32(str(i).encode()) % 4}"))
        labels.append((i * 4, 1, int(toxic)))
        if i % 3 == 0:
            rows.append((i * 4 + 1, text.upper() if i % 2 else text, "s9"))
        if i % 7 == 0 and len(words) > 60:
            rows.append((i * 4 + 2, text.replace(words[7], "other", 1), None))
    rows += [(None, "no identifier at all but a text", "s1"), (5000, None, "s1"), (5001, None, None), (5002, " \n", "s2"), (5003, "one row twice in here", "s2"), (5003, "one row twice in here", "s2"), (5004, "same identifier", "s3"), (5004, "another text entirely", "s3"), (5005, "w" * 100_000 + " x" * 100_000, "s0")]
    spark.createDataFrame([(*x, "clash", 1, "t") for x in rows], "doc_id long, text string, source string, id string, n int, _text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    after = run_and_compare(spark, str(tmp_path), library)
    assert len(after[0]) < len(rows) and len(after[1]) < len(after[0]) and len(after[2]) < len(after[1])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
