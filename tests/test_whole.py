"""Digests of texts in all scripts, against Python."""

import hashlib

import pytest

from tallyweave.plans import catalogue


TEXTS = ["Über  ÄRGER", "über\u00a0ärger", "\u3000नेपाल\u2003सरकार ", "नेपाल सरकार", "ΟΔΟΣ", "İstanbul", "Plain  Text", "plain text", "", None]


def normal(x):
    return " ".join((x or "").split()).lower()


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def documents(spark, folder):
    rows = [(i, x, "Quelle É" if i < 2 else None) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return rows


def test_norm_text_of_all_scripts(spark, tmp_path):
    rows = documents(spark, tmp_path)
    got = {r.doc_id: r.digest for r in catalogue.norm_text(spark, str(tmp_path)).collect()}
    assert got == {i: digest(normal(x)) for i, x, _ in rows}


def test_fingerprints_of_all_scripts(spark, tmp_path):
    rows = documents(spark, tmp_path)
    got = {r.fingerprint: r.doc_id for r in catalogue.fingerprints_dedup(spark, str(tmp_path)).collect()}
    assert got == {digest(normal(s) + "|" + normal(x)): i for i, x, s in rows}


@pytest.mark.parametrize("name", ["norm_text", "fingerprints_dedup"])
def test_all_documents_have_a_digest(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = catalogue.QUERIES[name](spark, small).collect()
    if name == "norm_text":
        assert {r.doc_id: r.digest for r in got} == {r.doc_id: digest(normal(r.text)) for r in docs}
    else:
        assert {r.fingerprint: r.doc_id for r in got} == {digest(normal(r.source) + "|" + normal(r.text)): r.doc_id for r in sorted(docs, key=lambda r: r.doc_id)}
