"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " content " </turn>" newline

Role and content may hold anything. A rendered turn is parsed again by a deterministic parser and compared with
its source; where they differ, the conflicting content is escaped once more, until they are identical. The
parser takes a backslash as a mark that the next character is ordinary, so what holds neither a backslash nor a control string is rendered as it is.

The turns of a conversation are one piece of the output each, with their place in it, so a conversation of any
length passes in bounded memory; the pieces in order are the formatted text. Loss spans cover the assistant's contents.

Defined results:
- null role or text: as the empty string; null turn: first; null conversation: one of its own
- ties (rows with one conversation and turn): ordered by role, then text, all kept; empty table: no rows
- extra columns: ignored
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
#: What may not stand in a text as it is: each gets a backslash before it.
CONTROL = ("\\", "### ", "</turn>")
ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
NAMES = {v: k for k, v in ROLES.items()}
LEARNED = "assistant"


class GrammarError(ValueError):
    pass


def escape(text: str, strings: tuple[str, ...] = CONTROL) -> str:
    for x in strings:
        text = text.replace(x, "\\" + x)
    return text


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        if j + 1 >= len(text):
            raise GrammarError("a lone backslash ends the content")
        out += (text[i:j], text[j + 1])
        i = j + 2
    out.append(text[i:])
    return "".join(out)


def _end(text: str, mark: str, at: int) -> int:
    """Where mark first stands from there on, not counting characters behind a backslash."""
    i = at
    while True:
        j = text.find(mark, i)
        if j < 0:
            raise GrammarError(f"no {mark!r}")
        k = text.find("\\", i, j)
        if k < 0:
            return j
        i = k + 2


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role, content, the span of the content as it is written, and where the turn ends."""
    if not text.startswith(HEAD, at):
        raise GrammarError("no turn begins here")
    middle = _end(text, MIDDLE, at + len(HEAD))
    a = middle + len(MIDDLE)
    b = _end(text, TAIL, a)
    shown, content = text[at + len(HEAD) : middle], text[a:b]
    if _raw_control(content):
        raise GrammarError("a control string inside a content")
    role = NAMES[shown] if shown in NAMES else unescape(shown)
    return role, unescape(content), a, b, b + len(TAIL)


def _raw_control(content: str) -> bool:
    i = 0
    while i <= len(content):
        j = content.find("\\", i)
        part = content[i : j if j >= 0 else len(content)]
        if any(x in part for x in CONTROL[1:]):
            return True
        if j < 0:
            return False
        i = j + 2
    return False


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(text):
        role, content, _, _, at = parse_turn(text, at)
        turns.append((role, content))
    return turns


def render_turn(role: str, content: str) -> tuple[str, int, int]:
    """A turn that parses back to its source, with the span of its content."""
    shown = ROLES.get(role, role)
    tries = ((shown, content), (shown, escape(content)), (escape(shown, (*CONTROL, ":", "\n")), escape(content)), (escape(shown, ("\\",) + tuple(dict.fromkeys(x for x in shown if x != "\\"))), escape(content)))
    for a, b in tries:
        text = f"{HEAD}{a}{MIDDLE}{b}{TAIL}"
        try:
            got = parse_turn(text)
        except GrammarError:
            continue
        if got[:2] == (role, content) and got[4] == len(text):
            return text, got[2], got[3]
    raise GrammarError("no escape makes this turn read back as it was")


def formatted(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per turn: the conversation, place (from 0), piece of the formatted text, and loss_start and loss_end in the piece (null: no loss)."""
    id_type = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = object(), 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids = batch.column(0).to_pylist()
            for i, role, text in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                place = place + 1 if i == last else 0
                last = i
                piece, a, b = render_turn(role, text)
                learned = role == LEARNED
                for column, x in zip(out, (place, piece, a if learned else None, b if learned else None)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["id", "place", "piece", "loss_start", "loss_end"])

    return rows.mapInArrow(run, f"id {id_type}, place long, piece string, loss_start int, loss_end int").withColumnRenamed("id", id_col)


def digests(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What is read back from formatted pieces, a row per conversation: its digests are fed turn by turn."""
    import hashlib

    id_type = pieces.schema[id_col].dataType.simpleString()
    rows = pieces.select(F.col(id_col).alias("id"), "place", "piece", "loss_start", "loss_end").repartition("id").sortWithinPartitions("id", "place")
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[list] = []

            def close() -> None:
                if state:
                    n, turns, chars, loss, size = state
                    done.append([last, n, turns.hexdigest(), chars, loss.hexdigest(), size])

            for i, piece, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if state is None or i != last:
                    close()
                    last, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    kept = unescape(piece[a:b])
                    state[2] += len(kept)
                    state[3].update(kept.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if done:
                yield out(done, batch.schema.field(0).type)
        if state:
            n, turns, chars, loss, size = state
            yield out([[last, n, turns.hexdigest(), chars, loss.hexdigest(), size]], batch.schema.field(0).type)

    def out(done: list[list], id_kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), [id_kind, *kinds])], names=names)

    return rows.mapInArrow(run, f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
