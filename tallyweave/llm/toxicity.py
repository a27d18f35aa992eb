"""Toxicity by cumulative-link ordinal regression over sparse word features.

Severity grades come from the labels, which tell toxic texts alone, and from how much of a lexicon of toxic words a text holds: 0 not toxic, 1 toxic, 2
toxic with more distinct words of it than half of the toxic texts. The labelled documents are cut in two folds, and each is graded by the lexicon of
the other, so that no document's own label or words decide which words grade it. The model is
P(grade >= k) = sigmoid(w . x - t_k) with one w for all ascending thresholds t_k; x has a 1 for each word of the vocabulary
that the text contains. The expected severity is the sum of P(grade >= k) over k; a text is rejected from P(grade >= 1) = 0.5 on.

The classifier is fitted on at most ``max_labelled`` labelled documents (those whose identifiers hash lowest; whole texts). Document frequencies
by class are counted over all of them in Spark; words that at least MIN_DOCS contain and whose association with toxicity
is significant (root of the likelihood ratio) make up the vocabulary, all of them; the sample bounds it. The sample's words are written once. Scoring covers every document in one pass without a shuffle.

Defined results:
- null text: as the empty text; null or missing labels: left out of the fit; several labels of a document: toxic if one says so
- no labelled document of one of both classes: every text gets the share of toxic ones (0 without labels) as its probability
- empty table: no rows; repeated rows: a row each, the same scores; extra columns: kept by ``clean``, ignored by ``scored``
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import discard, tidy, written

MAX_LABELLED = 20_000
MIN_DOCS, MIN_ROOT = 3, 4.0
RIDGE, STEPS = 0.01, 300
GRADES = 3
WORDS = re.compile(r"[^\W\d_]+")
PORTION = 500


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


@dataclass
class Model:
    """weights: by word; thresholds: ascending, of grades 1, 2, ..."""

    thresholds: list[float]
    weights: dict[str, float] = field(default_factory=dict)

    def probabilities(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        get = self.weights.get
        z = sum([w for x in words_of(text) if (w := get(x)) is not None])
        return [1 / (1 + np.exp(min(700.0, t - z))) for t in self.thresholds]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_words: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the whole sample. rows: the words of each document, as places in the vocabulary."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    n = len(rows)
    share = np.array([np.clip((grades >= k).mean(), 0.5 / n, 1 - 0.5 / n) for k in range(1, GRADES)])
    first = np.log((1 - share) / share)
    # t_1, and the logarithms of the steps between thresholds, so that they stay ascending
    params = np.concatenate([np.zeros(n_words), first[:1], np.log(np.maximum(np.diff(first), 0.05))])
    m, v = np.zeros_like(params), np.zeros_like(params)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    for i in range(1, steps + 1):
        w, t = params[:n_words], params[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_words + 1 :]))])
        z = np.bincount(owner, w[flat], n) if len(flat) else np.zeros(n)
        upper = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - t), np.zeros((n, 1))], 1)  # P(grade >= 0 .. GRADES)
        slope = upper * (1 - upper)
        own = np.maximum(upper[np.arange(n), grades] - upper[np.arange(n), grades + 1], 1e-12)
        down = -(slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / own
        by_threshold = np.zeros(GRADES + 1)
        np.add.at(by_threshold, grades, slope[np.arange(n), grades] / own)
        np.add.at(by_threshold, grades + 1, -slope[np.arange(n), grades + 1] / own)
        g_t = by_threshold[1:GRADES]
        g_steps = [g_t[k:].sum() * np.exp(params[n_words + k]) for k in range(1, GRADES - 1)]
        g = np.concatenate([np.bincount(flat, down[owner], n_words) if len(flat) else np.zeros(n_words), [g_t.sum()], g_steps]) / n
        g[:n_words] += ridge * w / np.sqrt(n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return params[:n_words], params[n_words] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_words + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """labels: identifier and toxic, 0 or 1."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, 1)
    known = labels.select(F.col(id_col).alias("id"), grade.alias("grade")).filter("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max("grade").alias("grade"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # at most max_labelled rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    texts = texts.select("grade", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(2)).cast("int").alias("fold"), "text")

    @tidy
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PORTION):
                part = batch.slice(a, PORTION)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sorted(words_of(t)) for t in part.column(2).to_pylist()], pa.list_(pa.string()))], names=["grade", "fold", "words"])

    counted = written(texts.mapInArrow(distinct, "grade int, fold int, words array<string>"), "labelled")
    seen = {(r["grade"], r["fold"]): r["count"] for r in counted.groupBy("grade", "fold").count().collect()}
    toxic_in, other_in = ([seen.get((g, f), 0) for f in (0, 1)] for g in (1, 0))
    toxic, total = sum(toxic_in), sum(toxic_in) + sum(other_in)
    if not 0 < toxic < total:
        share = toxic / total if total else 0.0
        edge = np.inf if share == 0 else -np.inf
        return Model([edge] * (GRADES - 1))
    with_word = [F.count_if((F.col("grade") == g) & (F.col("fold") == f)).alias(f"{'ba'[g]}{f}") for g in (1, 0) for f in (0, 1)]
    root = lambda a, b, toxic, other: _root(F.col(a).cast("double"), F.col(b).cast("double"), toxic, other)
    marks = [(F.col(f"a{f}") * other_in[f] > F.col(f"b{f}") * toxic_in[f]) & (root(f"a{f}", f"b{f}", toxic_in[f], other_in[f]) >= MIN_ROOT) for f in (0, 1)]
    words = (
        counted.select("grade", "fold", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(*with_word)
        .withColumns({"a": F.col("a0") + F.col("a1"), "b": F.col("b0") + F.col("b1")})
        .filter(F.col("a") + F.col("b") >= MIN_DOCS)
        .withColumn("root", root("a", "b", toxic, total - toxic))
        .filter(F.col("root") >= MIN_ROOT)
        .orderBy(F.desc("root"), "word")
        .select("word", F.coalesce(marks[0], F.lit(False)).alias("m0"), F.coalesce(marks[1], F.lit(False)).alias("m1"))
    )
    found = words.collect()  # words of max_labelled documents
    vocabulary, lexicon = [r["word"] for r in found], np.array([[r["m0"] for r in found], [r["m1"] for r in found]], bool)
    place = {w: i for i, w in enumerate(vocabulary)}

    @tidy
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PORTION):
                part = batch.slice(a, PORTION)
                found = [np.array(sorted(place[w] for w in x if w in place), np.int32).tobytes() for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["grade", "fold", "places"])

    # bounded by max_labelled documents
    rows = counted.mapInArrow(places, "grade int, fold int, places binary").collect()
    rows.sort(key=lambda r: (r["grade"], r["fold"], bytes(r["places"])))
    bags, grades = [np.frombuffer(r["places"], np.int32) for r in rows], np.array([r["grade"] for r in rows])
    held = np.array([lexicon[1 - r["fold"]][b].sum() for r, b in zip(rows, bags)])
    grades[(grades == 1) & (held > np.median(held[grades == 1]))] = 2
    discard(counted)
    weights, thresholds = fit_ordinal(bags, grades, len(vocabulary))
    return Model(thresholds.tolist(), dict(zip(vocabulary, weights.tolist())))


def _root(a: Column, b: Column, toxic: int, other: int) -> Column:
    """The root of the likelihood ratio of a word in a of the toxic and b of the other documents, against one share of both."""
    total = toxic + other

    def part(x: Column, row: Column, column: int) -> Column:
        return F.when((x > 0) & (row * column > 0), x * F.log(x * total / (row * column))).otherwise(0.0)

    without = F.lit(float(total)) - a - b
    ratio = part(a, a + b, toxic) + part(b, a + b, other) + part(toxic - a, without, toxic) + part(other - b, without, other)
    return F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def _score(model: Model, texts: DataFrame, rest: list[str]) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a in range(0, batch.num_rows, PORTION):
                p = [model.probabilities(t) for t in batch.column(at).slice(a, PORTION).to_pylist()]
                columns = [batch.column(batch.schema.get_field_index(c)).slice(a, PORTION) for c in rest]
                made = [pa.array([sum(x) for x in p], pa.float64()), pa.array([sum(y >= 0.5 for y in x) for x in p], pa.int32()), pa.array([x[0] for x in p], pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*rest, "expected_severity", "grade", "p_toxic"])

    made = [T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType())]
    return texts.mapInArrow(run, T.StructType([*(texts.schema[c] for c in rest), *made]))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: identifier, expected_severity, grade, p_toxic, toxic (rejected)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = _score(model, rows, ["id"])
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the documents that the model rejects; all columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    out = _score(model, rows, ["row"]).filter("p_toxic < 0.5")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
