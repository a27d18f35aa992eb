"""Language-model scoring: a causal self-attention model on subword ids, beside a smoothed unigram base.

Passes: (1) texts are tokenised once: words as places in a dictionary of their chunk, subwords by the pieces of a public byte-level BPE file, the
longest from the left. A chunk is a stretch of a partition; its dictionary goes out once per chunk, with counts of the training documents, so a word that
stands in every document costs a row per chunk. What was tokenised is written to the shared folder. (2) Word counts are summed over chunks and each chunk
gets its words' totals back. (3) What stands before and behind each subword id in all training documents gives the ids' embeddings, states and classes;
a second pass counts which ids follow which states. (4) Every token of every training document is a training target; each task trains from the common
start, and the parameters are averaged by windows seen. (5) Each text is scored whole in overlapping windows, each token once.

Documents whose crc32 of the identifier as text leaves HELD modulo FOLDS are held out: no count or window comes from them.

Defined results:
- null text: as the empty text, the end alone; null identifier: the crc32 of "null"; empty table: no rows; extra columns: ignored
- repeated rows: a row each; long texts: whole
- no training document: N = V = 0, and the base gives each token log10(0.5 / 0.5) = 0
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm import attention, bpe
from tallyweave.llm.common import tidy, written
from tallyweave.llm.pieces import Pieces
from tallyweave.llm.shingles import word_hashes

FOLDS, HELD = 5, 1
CHUNK_CHARS = 24_000_000
#: Numbers of an id's random vector; pairs of ids that a task holds at once.
DIMS, PAIRS = 24, 2_000_000
PART_CHARS = 2_000_000
PART_WORDS = 50_000
END_WORD = np.uint64(0x5BD1E995)
_ROW = "chunk long, place long, id long, held boolean, n long, words binary, subwords binary, hashes binary, counts binary, start long"
_NAMES = ("chunk", "place", "id", "held", "n", "words", "subwords", "hashes", "counts", "start")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, t in zip(_NAMES, _TYPES)], names=list(_NAMES))


def _id_type(size: int) -> type:
    """Of ids below size, the end and the beginning."""
    return np.uint16 if size < 2**16 else np.uint32


def _tokenised(docs: DataFrame, path: str) -> DataFrame:
    """docs: id, held, text. A row per document, and rows with each chunk's dictionary (hashes) and its training counts. Subwords are cut once for each
    distinct word of a chunk."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.vocabulary(path)
        pieces, end = Pieces(vocabulary), len(vocabulary.bytes)
        dtype = _id_type(end + 1)
        chunk, place = TaskContext.get().partitionId() << 24, 0
        waiting: list[tuple] = []  # place, identifier, held, words
        texts: list[bytes] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            lengths = np.array([len(w) for _, _, _, w in waiting])
            # in the order in which the words first stand
            at, hashes = pd.factorize(np.concatenate([w for _, _, _, w in waiting]))
            first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))
            trains = np.repeat([not held for _, _, held, _ in waiting], lengths)
            counts = np.bincount(at[trains], minlength=len(hashes)).astype(np.int32)
            cuts = np.cumsum(np.concatenate([[0], lengths]))
            # the bytes of each distinct word, where it stands first; each document's words end with the end, which has no bytes
            owner = np.searchsorted(cuts, first, side="right") - 1
            words: list[bytes] = [b""] * len(hashes)
            now, split = -1, []
            for i, (o, k) in enumerate(zip(owner.tolist(), (first - cuts[owner]).tolist())):
                if o != now:
                    now, split = o, texts[o].split()
                if k < len(split):
                    words[i] = split[k]
            ends = hashes == END_WORD
            flat, many = pieces.cut(words)
            starts = np.cumsum(many) - many
            if ends.any():  # the end's only piece
                flat[starts[ends]] = end
            for a in range(0, len(waiting), 200):
                part = waiting[a : a + 200]
                # the order of words doesn't matter to the base, and small steps take less room
                steps, subwords = [], []
                for i in range(a, a + len(part)):
                    own = at[cuts[i] : cuts[i + 1]]
                    steps.append(np.diff(np.sort(own), prepend=0).astype(np.int32).tobytes())
                    n = many[own]
                    total = np.cumsum(n)
                    subwords.append(flat[np.repeat(starts[own] - total + n, n) + np.arange(total[-1])].astype(dtype).tobytes())
                yield _rows(chunk=[chunk] * len(part), place=[x[0] for x in part], id=[x[1] for x in part], held=[x[2] for x in part], n=[len(x[3]) for x in part], words=steps, subwords=subwords)
            for a in range(0, len(hashes), PART_WORDS):
                yield _rows(chunk=[chunk], hashes=[hashes[a : a + PART_WORDS].tobytes()], counts=[counts[a : a + PART_WORDS].tobytes()], start=[a])
            chunk += 1
            waiting.clear()
            texts.clear()

        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in bpe._portions([len(t) if t else 0 for t in batch.column(2).to_pylist()], PART_CHARS):
                low = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column(2).slice(a, b - a).to_pylist()]
                hashes, cuts = word_hashes(low)
                for i, t in enumerate(low):
                    waiting.append((place, ids[a + i], held[a + i], np.append(hashes[cuts[i] : cuts[i + 1]], END_WORD)))
                    texts.append(t)
                    place += 1
                    size += len(t)
                    if size >= CHUNK_CHARS:
                        yield from close()
                        size = 0
        if waiting:
            yield from close()

    return docs.select("id", "held", "text").mapInArrow(run, _ROW)


def _words(tokens: DataFrame) -> DataFrame:
    """chunk, at (place in its dictionary), hash, c."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts, start in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h, c = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), chunk)), pa.array(np.arange(start, start + len(h), dtype=np.int32)), pa.array(h), pa.array(c)], names=["chunk", "at", "hash", "c"])

    return tokens.filter("hashes IS NOT NULL").select("chunk", "hashes", "counts", "start").mapInArrow(run, "chunk long, at int, hash long, c int")


def _training(tokens: DataFrame) -> DataFrame:
    return tokens.filter("NOT held AND subwords IS NOT NULL").select("subwords")


def _joined(column: pa.Array, dtype: type, begin: int, rows: int = 256) -> Iterator[np.ndarray]:
    """The ids of some rows at a time, each text with its beginning."""
    for a in range(0, len(column), rows):
        yield np.concatenate([x for t in column.slice(a, rows) for x in (np.array([begin], dtype), np.frombuffer(t.as_buffer(), dtype))])


def _contexts(tokens: DataFrame, size: int) -> attention.Lexicon:
    """From all training documents: how often each id is used, and the sums of the random vectors of what stands before and behind it. Summed by id, so
    the driver gets a row per id of the vocabulary at most."""
    dtype, dims = _id_type(size), DIMS
    names = [f"s{i}" for i in range(2 * dims)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = np.random.Generator(np.random.PCG64(5)).normal(size=(size + 1, dims))
        count, sums = np.zeros(size + 1, np.int64), np.zeros((size + 1, 2 * dims))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            """The pairs that are held, each once, into the sums."""
            pairs, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([h[1] for h in held]), len(pairs))
            last, following = pairs // (size + 1), pairs % (size + 1)
            for keys, others, a in ((following, last, 0), (last, following, dims)):
                order = np.argsort(keys, kind="stable")
                starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
                sums[keys[order][starts], a : a + dims] += np.add.reduceat(vectors[others[order]] * n[order][:, None], starts)
            held.clear()

        for batch in batches:
            for ids in _joined(batch.column(0), dtype, size):
                count += np.bincount(ids, minlength=size + 1)
                last, following = ids[:-1].astype(np.int64), ids[1:]
                inside = following != size
                held.append(np.unique(last[inside] * (size + 1) + following[inside], return_counts=True))
                if sum(len(h[0]) for h in held) > PAIRS:
                    close()
        if held:
            close()
        found = np.flatnonzero(count[:size])
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count[found]), *(pa.array(sums[found, i]) for i in range(2 * dims))], names=["sub", "c", *names])

    each = _training(tokens).mapInArrow(run, "sub long, c long, " + ", ".join(f"{n} double" for n in names))
    rows = each.groupBy("sub").agg(F.sum("c").alias("c"), *[F.sum(n).alias(n) for n in names]).orderBy("sub").toArrow()
    every = np.stack([rows.column(n).to_numpy() for n in names], 1) if rows.num_rows else np.zeros((0, 2 * dims))
    return attention.lexicon(rows.column("sub").to_numpy(), rows.column("c").to_numpy().astype(float), every[:, :dims], every[:, dims:], size)


def _followers(tokens: DataFrame, lex: attention.Lexicon, size: int) -> attention.Lexicon:
    """How often each id follows each state, in all training documents. The driver gets a row per pair of these at most."""
    dtype, columns = _id_type(size), lex.begin
    of = np.append(lex.column, columns)  # the beginning is no id's follower

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((attention.STATES + 1) * columns, np.int64)
        for batch in batches:
            for ids in _joined(batch.column(0), dtype, size):
                own = of[ids]
                last, following = own[:-1], own[1:]
                inside = following != columns
                keys, n = np.unique(lex.state[last[inside]] * columns + following[inside], return_counts=True)
                count[keys] += n
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count[found])], names=["at", "c"])

    rows = _training(tokens).mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros((attention.STATES + 1) * columns)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return attention.with_counts(lex, counts.reshape(attention.STATES + 1, columns))


def _trained(tokens: DataFrame, lex: attention.Lexicon, size: int) -> dict[str, np.ndarray]:
    """Each task's model from the common start, averaged by the windows that each has seen: every token of every training document is a target once."""
    dtype = _id_type(size)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = attention.Trainer(attention.initial(), lex)
        held: list[tuple] = []
        n = 0

        def learn() -> None:
            made = [np.concatenate([h[i] for h in held]) for i in range(3)]
            for a in range(0, len(made[0]), attention.BATCH):
                trainer.step(*(m[a : a + attention.BATCH] for m in made))
            held.clear()

        for batch in batches:
            for x in batch.column(0):
                inputs, targets, weight = attention.windows(lex.column[np.frombuffer(x.as_buffer(), dtype)], lex.begin, attention.WINDOW)
                held.append((inputs, targets, weight.astype(np.float32)))
                n += len(inputs)
                if n >= attention.BATCH:
                    learn()
                    n = 0
        if held:
            learn()
        flat = attention.pack(trainer.p).astype(np.float64) * trainer.windows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.append(flat, float(trainer.windows)))], names=["at", "x"])

    rows = _training(tokens).mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    flat = np.array([r["x"] for r in rows])  # as many as the model has parameters
    return attention.unpack(flat[:-1] / flat[-1]) if len(flat) and flat[-1] else attention.initial()


def _lm_scores(tokens: DataFrame, model: attention.Model, size: int) -> DataFrame:
    dtype = _id_type(size)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [np.frombuffer(x.as_buffer(), dtype) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.scores(texts))], names=["chunk", "place", "score"])

    return tokens.filter("subwords IS NOT NULL").select("chunk", "place", "subwords").mapInArrow(run, "chunk long, place long, score double")


def _base_scores(tokens: DataFrame, totals: DataFrame, n: int, v: int) -> DataFrame:
    """A chunk's rows meet in one task: first its dictionary's totals, then its documents, whose place and identifier stand in the same narrow columns."""
    documents = tokens.filter("words IS NOT NULL").select("chunk", F.when(F.col("held"), 2).otherwise(1).alias("kind"), F.col("place").alias("at"), F.col("id").alias("value"), "words")
    counts = totals.select("chunk", F.lit(0).alias("kind"), F.col("at").cast("long").alias("at"), F.col("total").alias("value"), F.lit(None).cast("binary").alias("words"))
    rows = counts.unionByName(documents).repartition("chunk").sortWithinPartitions("chunk", "kind", "at")
    whole = np.log10(n + 0.5 * (v + 1))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        logs, now = np.empty(0), None
        for batch in batches:
            chunk, kind, value = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).fill_null(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1, [len(chunk)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if chunk[a] != now:
                    held, logs, now = [], np.empty(0), chunk[a]
                if kind[a] == 0:
                    held.append(value[a:b])
                    continue
                if held:
                    every = np.concatenate(held)
                    # a word outside the training texts is marked by adding an imaginary part
                    logs = np.log10(every + 0.5) - whole + 1j * (every > 0)
                    held = []
                own = [np.cumsum(np.frombuffer(x.as_buffer(), np.int32)) for x in batch.column(4).slice(a, b - a)]
                sums = [logs[x].sum() for x in own]
                part = batch.slice(a, b - a)
                columns = [part.column(0), part.column(2), part.column(3), pa.array(np.full(b - a, kind[a] == 2)), pa.array([len(x) for x in own], pa.int64()), pa.array([int(round(s.imag)) for s in sums], pa.int64()), pa.array([float(s.real) for s in sums])]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "id", "held", "n", "n_known", "base"])

    return rows.mapInArrow(run, "chunk long, place long, id long, held boolean, n long, n_known long, base double")


def scored(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: identifier, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    path = path or bpe.default_path()
    text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.crc32(text) % FOLDS == HELD).alias("held"), F.col(text_col).cast("string").alias("text"))
    tokens = written(_tokenised(rows, path), "tokens")
    by_hash = W.partitionBy("hash")
    totals = _words(tokens).withColumns({"total": F.sum("c").over(by_hash), "first": F.row_number().over(by_hash.orderBy("chunk")) == 1})
    totals = written(totals.select("chunk", "at", "total", "first"), "totals")
    n = tokens.filter("NOT held").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    v = totals.filter("first AND total > 0").count()
    size = len(bpe.vocabulary(path).bytes) + 1
    lex = _followers(tokens, _contexts(tokens, size), size)
    model = attention.Model(_trained(tokens, lex, size), lex)
    both = _base_scores(tokens, totals, n, v).join(_lm_scores(tokens, model, size), ["chunk", "place"])
    return both.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
