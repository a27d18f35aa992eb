"""Byte-level BPE encoding and decoding.

Pre-tokenisation runs without a regular expression. Every code point has a class; a symbol is a code point's
class with the next one's, and an automaton of eight states reads symbols. A symbol is a function from state to state,
and functions compose associatively: the text is cut into blocks of equal length, the functions of all blocks are
composed side by side, a prefix scan over blocks gives the state before each, and a second pass writes down the
places where a piece begins. Pieces then go through a bounded cache of merged pairs; long pieces merge with a heap, in n log n.

Defined results:
- null text: as the empty text, no tokens; empty table: no rows; extra columns: ignored
- repeated rows: a row each; very long texts and pieces: whole
- ``tokens`` holds the ids as little-endian unsigned 32-bit integers, ``starts`` likewise the byte offset of each
  token in the text's UTF-8 form, so that any range of tokens can be decoded and placed
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import tidy

#: Classes of code points. The letters that can follow an apostrophe have their own.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, L, E, END = range(12)
#: States. FRESH: whatever comes begins a piece. SPACED: one space that the next character joins. QUOTED: an
#: apostrophe that began a piece. HALF: an apostrophe and the first of two letters. WHITE: inside white space.
FRESH, SPACED, WORD, DIGITS, MARKS, QUOTED, HALF, WHITE = range(8)
LETTERS = (LETTER, STMD, R, V, L, E)
#: Code points that are white space besides the categories Z*: tab to carriage return, and next line.
CONTROLS = (*range(0x09, 0x0E), 0x85)
BLOCK = 256
BATCH_CHARS = 1_000_000
CACHE = 400_000
#: Bytes up to which a list of pairs is searched; longer pieces use a heap.
SHORT = 96


def step(state: int, kind: int, following: int) -> tuple[int, bool]:
    """The state after a character, and whether a piece begins at it. following: the next character's class, or END."""
    white_next = following in (SPACE, BLANK)
    if kind in (SPACE, BLANK):
        if white_next or following == END:  # not the last of its run, or the run ends the text
            return WHITE, state != WHITE
        # the last before something visible: a space joins it, anything else stands alone
        return (SPACED, True) if kind == SPACE else (FRESH, True)
    if kind in LETTERS:
        if state == HALF:
            return FRESH, False
        if state == QUOTED:
            if kind == STMD:
                return FRESH, False
            if (kind, following) in ((R, E), (V, E), (L, L)):
                return HALF, False
        return WORD, state not in (SPACED, WORD)
    if kind == NUMBER:
        return DIGITS, state not in (SPACED, DIGITS)
    if state in (SPACED, MARKS, QUOTED):
        return MARKS, False
    return (QUOTED if kind == QUOTE else MARKS), True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * 8 + state] and begins[symbol * 8 + state]; a symbol is kind * 12 + following, plus 144 at the start of a text."""
    after, begins = np.zeros(288 * 8, np.uint8), np.zeros(288 * 8, bool)
    for kind in range(END):
        for following in range(END + 1):
            for state in range(8):
                for first in (0, 1):
                    at = ((kind * 12 + following) + 144 * first) * 8 + state
                    after[at], begins[at] = step(FRESH if first else state, kind, following)
                    begins[at] |= bool(first)
    return after, begins


def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    name = {"L": LETTER, "N": NUMBER, "Z": BLANK}
    category = unicodedata.category
    for i in range(0x110000):
        if (k := name.get(category(chr(i))[0])) is not None:
            kinds[i] = k
    kinds[list(CONTROLS)] = BLANK
    kinds[0x20], kinds[0x27] = SPACE, QUOTE
    for letters, k in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        kinds[[ord(c) for c in letters]] = k
    return kinds


_loaded: dict[str, tuple] = {}


def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "automaton" not in _loaded:
        _loaded["automaton"] = (*_tables(), _classes())
    return _loaded["automaton"]


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places where pieces begin in texts laid end to end. points: code points; firsts: where the texts begin (none empty)."""
    after, begins, classes = automaton()
    n = len(points)
    kinds = classes[points]
    following = np.empty(n, np.uint8)
    following[:-1], following[-1] = kinds[1:], END
    following[firsts[1:] - 1] = END
    symbols = kinds.astype(np.uint16) * 12 + following
    symbols[firsts] += 144
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint16)
    padded[:n] = symbols * 8
    by_place = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    # each block's function, for all eight states side by side
    functions = np.repeat(np.arange(8, dtype=np.uint8)[None, :], blocks, 0)
    for row in by_place:
        functions = after[row[:, None] + functions]
    # prefix scan by doubling: functions[b] becomes the composition of blocks 0..b
    reach = 1
    while reach < blocks:
        functions[reach:] = np.take_along_axis(functions[reach:], functions[:-reach].copy(), 1)
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = functions[:-1, FRESH]
    marks = np.empty((BLOCK, blocks), bool)
    for i, row in enumerate(by_place):
        at = row + state
        marks[i] = begins[at]
        state = after[at]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


class Vocabulary:
    """Ranks of a tiktoken file, and the merging by them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes[rank] = piece
        self.lengths = np.array([len(x) for x in self.bytes], np.uint32)
        # what was merged lately, and before that: half of the bound each, so that frequent pieces outlast a full cache
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The lowest rank first, the leftmost of equal ones."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > SHORT:
            return self._merge_long(piece)
        get, none = self.ranks.get, len(self.bytes)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return tuple([self.ranks[x] for x in parts])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """A linked list of parts and a heap of pairs."""
        n, ranks = len(piece), self.ranks
        ends, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = ends[i]
            if j >= n or (rank := ranks.get(piece[i : ends[j]])) is None:
                return None
            return rank, i, j, ends[j]

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if gone[i] or gone[j] or ends[i] != j or ends[j] != end:
                continue
            ends[i], gone[j] = end, True
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if text:
                group.append(i)
                size += len(text)
            if group and (size >= BATCH_CHARS or i == len(texts) - 1):
                self._encode(texts, group, out)
                group, size = [], 0
        if group:
            self._encode(texts, group, out)
        return out

    def _encode(self, texts: list[str], group: list[int], out: list[np.ndarray]) -> None:
        text = "".join([texts[i] for i in group])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        firsts = np.cumsum([0] + [len(texts[i]) for i in group])
        starts = piece_starts(points, firsts[:-1])
        cuts = np.searchsorted(starts, firsts).tolist()
        places = starts.tolist()
        places.append(len(text))
        cache, older, merge = self.cache, self.older, self.merge
        for k, i in enumerate(group):
            ids: list[int] = []
            own = places[cuts[k] : cuts[k + 1] + 1]
            for a, b in zip(own, own[1:]):
                piece = text[a:b]
                found = cache.get(piece)
                if found is None:
                    found = older.get(piece)
                    if found is None:
                        found = merge(piece.encode("utf-8", "surrogatepass"))
                    if len(cache) >= CACHE // 2:
                        cache, older = {}, cache
                    if b - a <= 64:
                        cache[piece] = found
                ids += found
            out[i] = np.array(ids, np.uint32)
        self.cache, self.older = cache, older

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset of each token."""
        ends = np.cumsum(self.lengths[ids], dtype=np.uint32)
        return ends - self.lengths[ids]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    if path not in _loaded:
        _loaded[path] = (Vocabulary(path),)
    return _loaded[path][0]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _portions(lengths: list[int], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are in Python at once: about so many characters, or one text."""
    a = size = 0
    for b, n in enumerate(lengths):
        size += n
        if size >= most:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(lengths):
        yield a, len(lengths)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """A row per document: its identifier, tokens and starts (both binary, four bytes a token)."""
    path = path or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _portions(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                ids = words.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                columns = [batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in ids], pa.binary())]
                if offsets:
                    columns.append(pa.array([words.starts(x).tobytes() for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "tokens", "starts"][: len(columns)])

    schema = f"id {id_type}, tokens binary" + ", starts binary" * offsets
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str | None = None, tokens_col: str = "tokens", out_col: str = "decoded") -> DataFrame:
    """encoded without its tokens and with the bytes that they stand for; a column that has the result's name already is replaced."""
    path = path or default_path()
    rest = [c for c in encoded.columns if c not in (tokens_col, out_col)]
    fields = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            tokens = batch.column(len(rest))
            for a in range(0, batch.num_rows, 500):
                n = min(500, batch.num_rows - a)
                out = [words.decode(np.frombuffer(x, np.uint32)) for x in tokens.slice(a, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, n) for i in range(len(rest))), pa.array(out, pa.binary())], names=[*rest, out_col])

    return encoded.select(*rest, tokens_col).mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in rest) + f", {out_col} binary")
