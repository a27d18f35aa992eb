"""Secret scans by a trigram index.

For each rule a Boolean query over trigrams is derived from its regular expression: what every match must
contain. For each portion of rows an inverted index is built over the trigrams that the queries name (the texts' bytes,
A-Z lower-cased, laid end to end and read as rolling three-byte codes), postings are intersected and united as the query says,
and only the candidates are verified with the expression itself. A rule without mandatory trigrams scans every text in full.

Defined results:
- null text: as the empty text, no spans; empty table: no rows; extra columns: ignored
- repeated rows: a row each; long texts: whole, matching is linear in them
- spans are in code points, the end exclusive; overlapping spans of different kinds all stay
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import tidy

PORTION = 4_000_000
#: A set of strings that a part of an expression can be is followed up to so many members.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that group (0: the whole match) has at least; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base rules, in the order of their kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Published formats of keys that the base rules miss.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

# A query is True (anything), a trigram, ("and", ...) or ("or", ...).
Query = object


def both(a: Query, b: Query, word: str = "and") -> Query:
    stop = True if word == "or" else None  # True swallows an "or" and drops out of an "and"
    if a is True or b is True:
        return stop or (b if a is True else a)
    parts = [x for q in (a, b) for x in (q[1:] if isinstance(q, tuple) and q[0] == word else (q,))]
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (word, *parts)


def of_string(text: str) -> Query:
    query: Query = True
    for i in range(len(text) - 2):
        query = both(query, text[i : i + 3])
    return query


def of_strings(strings: set[str]) -> Query:
    query: Query | None = None
    for x in sorted(strings):
        query = of_string(x) if query is None else both(query, of_string(x), "or")
    return True if query is None else query


def trigram_query(pattern: str) -> Query:
    """What a text must contain for the pattern to match; trigrams of lower-cased ASCII."""

    def exact(part: list) -> set[str] | None:
        """The strings that a sequence can be, if few."""
        found = {""}
        for item in part:
            if (one := strings(item)) is None or len(found) * len(one) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in one}
        return found

    def strings(item: tuple) -> set[str] | None:
        kind, value = item
        if kind is C.LITERAL:
            return {chr(value).lower()} if value < 128 else None
        if kind is C.IN:
            if all(k is C.LITERAL and v < 128 for k, v in value):
                return {chr(v).lower() for _, v in value}
            return None
        if kind is C.BRANCH:
            each = [exact(list(x)) for x in value[1]]
            return None if any(x is None for x in each) else set().union(*each)
        if kind is C.SUBPATTERN:
            return exact(list(value[3]))
        if kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            one = exact(list(inner))
            if one is None or high is C.MAXREPEAT or high > 3:
                return None
            found: set[str] = set()
            for n in range(low, high + 1):
                times = {""}
                for _ in range(n):
                    times = {a + b for a in times for b in one}
                    if len(times) > MOST_STRINGS:
                        return None
                found |= times
            return found
        return {""} if kind is C.AT else None

    def walk(part: list) -> Query:
        query: Query = True
        run = {""}
        for item in part:
            one = strings(item)
            if one is not None and len(run) * len(one) <= MOST_STRINGS:
                run = {a + b for a in run for b in one}
                continue
            query = both(query, of_strings(run))
            run = one if one is not None else {""}
            if one is None:
                query = both(query, inside(item))
        return both(query, of_strings(run))

    def inside(item: tuple) -> Query:
        kind, value = item
        if kind is C.SUBPATTERN:
            return walk(list(value[3]))
        if kind is C.BRANCH:
            query: Query | None = None
            for x in value[1]:
                query = walk(list(x)) if query is None else both(query, walk(list(x)), "or")
            return query
        if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            return walk(list(value[2]))
        return True

    return walk(list(parser.parse(pattern, re.ASCII)))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1:]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.names = sorted({t for _, _, q in self.rules for t in trigrams(q)})
        self.code = np.full(1 << 24, -1, np.int16)
        for i, t in enumerate(self.names):
            a, b, c = t.encode()
            self.code[a << 16 | b << 8 | c] = i

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """For each trigram the places of the texts that contain it, ascending."""
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        joined = np.frombuffer(b"\n\n".join(raw), np.uint8).astype(np.int32)  # no trigram reaches over two line ends
        if len(joined) < 3:
            return {t: np.empty(0, np.int64) for t in self.names}
        found = self.code[(joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]]
        at = np.flatnonzero(found >= 0)
        ends = np.cumsum([len(x) + 2 for x in raw])
        texts_at, which = np.searchsorted(ends, at, side="right"), found[at]
        return {t: np.unique(texts_at[which == i]) for i, t in enumerate(self.names)}

    def candidates(self, query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings[query]
        lists = sorted((self.candidates(q, postings, n) for q in query[1:]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, True) if query[0] == "and" else np.union1d(out, x)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, number of the rule, end), ascending."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(texts)
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, len(texts)).tolist():
                for m in expression.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for x in out:
            x.sort()
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its identifier and spans, an array of (kind, start, end) by start, then by the rules' order."""
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            a = size = 0
            for b, n in enumerate(lengths, 1):
                size += n
                if size >= PORTION or b == len(lengths):
                    texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                    spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scanner.scan(texts)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, pa.list_(span))], names=["id", "spans"])
                    a, size = b, 0

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)
