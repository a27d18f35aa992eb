"""The corpus pipeline: five stages over documents. Each is a function (spark, docs, sf_dir); its result is written and read again as the next one's docs.

Defined results, for every stage: an empty table gives no rows; extra columns, whatever their names, stay as they are until the last stage; rows with null
or repeated identifiers are decided one by one. What a null text, a tie, a repeated row or a very long text gives stands at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import bpe, exact_dedup, jaccard, mixing, toxicity
from tallyweave.llm.common import discard, table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject. A null text counts as empty; one probability of exactly a half is
    rejected; repeated rows fare alike; long texts count whole."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest identifier's stays, one row of it; a null text equals the empty one; null identifiers are the largest; long texts are
    compared whole."""
    return exact_dedup.deduplicated(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five words, similarity 0.8) the smallest identifier's stays, null identifiers being the largest; texts without words all
    stay; of repeated rows one stays; long texts are compared whole."""
    return jaccard.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, so many rows; a null text has no words, a null source is one of its own; repeated rows share
    their identifier's coin."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens and starts, a row per row; a null text has no tokens; long texts are encoded whole."""
    return bpe.encode(docs)


STAGES = [("toxicity", not_toxic), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("mixing", mix), ("encode", encode)]
#: The fitted classifier, the connected components and the byte pairs are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
