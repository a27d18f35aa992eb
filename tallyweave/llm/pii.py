"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are the spans of four base kinds. What stands beside a seed induces lexical patterns ("the word before is w", "the word after is w", "it is
glued to w", as in ip=1.2.3.4 or tel:+1); other words that hold a digit or @, or what they glue to such a w, are candidate instances of the same patterns. Patterns and instances form
a graph that is scored in rounds: a pattern's confidence is the share of its word's occurrences in the whole corpus that stand
beside an instance, each counted by its score; an instance's score is the noisy-or of its patterns' confidences. A pattern
that could not become confident even if all its candidates were true is dropped before the rounds, which removes the common words.
Instances above the threshold add spans of kind "context"; base spans always stay.

Positions come from two calls: the matches of an expression, and the text between them. Expressions are possessive
behind a boundary, so they are linear in the text and need no deep stack; they match what the plain forms in KINDS match.

Defined results:
- null text: as the empty text, no spans; empty table: no rows; extra columns: ignored
- repeated rows: a row each, told apart by a row number that is written before it is used twice
- long texts: whole, in time linear in their spans; an instance has six characters at least, and context words of any length count whole
- spans are in code points, the end exclusive, by start and then kind
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.common import ascii_lower, written

WHITE = r"\x20\x09-\x0D"
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: kind, expression, and what a text needs for it to match. Fixed values, with possessive forms.
KINDS = (
    ("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"[0-9](?:[\x20-]?+[0-9])++", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
CONTEXT = len(KINDS)
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})?"
CANDIDATE = rf"(?<![^{WHITE}])[^{WHITE}0-9@]*+[0-9@][^{WHITE}]*+"
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 3, 3, 0.8, 0.9
BROADCAST_WORDS = 100_000
CHUNK = 256
_FOUND = "array<struct<start:int,kind:int,end:int,word:string,left:string,right:string>>"
#: Marks what is glued to an instance, so that it is no word of its own; and what ends it.
GLUED = "\x01"
_GLUE = r"^([^=:]++[=:])(?=.)"
NEAR = 256
MIN_LENGTH = 6


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(hit, r"[\x20-]", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _spaced(text: Column) -> Column:
    return F.translate(text, "\t\n\x0b\x0c\r", "     ")


def _before(gap: Column) -> Column:
    """The word before a hit, or what the hit is glued to if that ends in = or : and has none before; else empty. Looks far only where it must."""
    opened = lambda x: F.rtrim(x, F.lit("\"'([<"))
    tail = _spaced(F.right(gap, F.lit(NEAR)))
    text = F.when((F.length(gap) <= NEAR) | F.contains(F.rtrim(opened(tail)), F.lit(" ")), opened(tail)).otherwise(opened(_spaced(gap)))
    last = F.substring_index(text, " ", -1)
    word = F.when(text.endswith(" "), F.substring_index(F.rtrim(text), " ", -1)).when(last.rlike("^[^=:]++[=:]$"), F.concat(F.lit(GLUED), last)).otherwise("")
    return ascii_lower(word)


def _located(kind: int, parts: str, starts: str) -> Column:
    """The hits of parts with their places and the words beside them; chunk by chunk, so that the work is linear in the hits."""
    after = rf"^[.,;:!?)\]\"']*[{WHITE}]+([^{WHITE}]+)"

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        glue = F.regexp_extract(x["hit"], _GLUE, 1) if kind == CONTEXT else F.lit("")
        left = F.when(glue != "", F.concat(F.lit(GLUED), ascii_lower(glue))).otherwise(_before(x["gap"])) if kind == CONTEXT else _before(x["gap"])
        word = F.when(glue != "", F.substr(x["hit"], F.length(glue) + 1)).otherwise(x["hit"]) if kind == CONTEXT else x["hit"]
        right = ascii_lower(F.regexp_extract(x["next"], after, 1))
        one = F.struct((start + F.length(glue)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), word.alias("word"), left.alias("left"), right.alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(i: Column) -> Column:
        start = F.struct(F.element_at(starts, i + 1).alias("at"), F.array().cast(_FOUND).alias("out"))
        return F.aggregate(F.slice(parts, i * CHUNK + 1, CHUNK), start, add, lambda acc: acc["out"])

    return F.when(F.size(parts) > 0, F.flatten(F.transform(_chunks(parts), chunk))).otherwise(F.array().cast(_FOUND))


def _chunks(parts: str) -> Column:
    return F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int"))


def _starts(parts: str) -> Column:
    """Where each chunk of parts begins in the text."""
    long = lambda i: F.aggregate(F.slice(parts, i * CHUNK + 1, CHUNK), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.when(F.size(parts) > 0, F.aggregate(F.transform(_chunks(parts), long), first, add, lambda acc: acc["out"])).otherwise(F.array().cast("array<int>"))


def _found(rows: DataFrame) -> DataFrame:
    """_row, id, base and candidates: arrays of found spans with the words beside them."""
    digits = F.col("text").rlike("[0-9]")
    for k, (name, expression, needs) in enumerate([*KINDS, ("candidate", CANDIDATE, "")]):
        has = F.contains(F.col("text"), F.lit(needs)) if needs else digits | (F.contains(F.col("text"), F.lit("@")) if name == "candidate" else F.lit(False))
        has = has & digits if name in ("ip", "phone") else has
        rows = rows.withColumn(f"_hits{k}", F.when(has, F.regexp_extract_all("text", F.lit(expression), F.lit(0))).otherwise(F.array().cast("array<string>")))
        # the texts before, between and behind the hits; each step is a column of its own, so that none is evaluated twice
        rows = rows.withColumn(f"_gaps{k}", F.when(F.size(f"_hits{k}") > 0, F.split("text", expression, -1)).otherwise(F.array().cast("array<string>")))
        n = F.size(f"_hits{k}")
        rows = rows.withColumn(f"_parts{k}", F.arrays_zip(F.col(f"_hits{k}").alias("hit"), F.slice(f"_gaps{k}", 1, n).alias("gap"), F.slice(f"_gaps{k}", 2, n).alias("next")))
        rows = rows.withColumn(f"_starts{k}", _starts(f"_parts{k}")).withColumn(f"_at{k}", _located(k, f"_parts{k}", f"_starts{k}"))

    def of(name: str) -> Callable[[Column], Column]:
        return lambda x: _valid(name, x["word"])

    base = F.concat(*[F.filter(f"_at{k}", of(name)) for k, (name, _, _) in enumerate(KINDS)])
    return rows.select("_row", "id", F.array_sort(base).alias("base"), F.filter(f"_at{CONTEXT}", lambda c: (F.length(c["word"]) >= MIN_LENGTH) & c["word"].rlike("[0-9@]")).alias("candidates"))


def _apart(found: DataFrame) -> DataFrame:
    """_row and the candidates that overlap no base span, a row each. Spans of a text are compared with their neighbours in order of start."""
    some = found.filter(F.size("candidates") > 0)
    alone = some.filter(F.size("base") == 0).select("_row", F.explode("candidates").alias("x")).select("_row", "x.*")
    both = some.filter(F.size("base") > 0)
    one = lambda column, flag: both.select("_row", F.explode(column).alias("x")).select("_row", "x.*", F.lit(flag).alias("flag"))
    in_order = W.partitionBy("_row").orderBy("start", "flag", "end")
    is_base = F.col("flag") == 0
    past = F.max(F.when(is_base, F.col("end"))).over(in_order.rowsBetween(W.unboundedPreceding, -1))
    # the frame behind a row is read backwards, so that it grows row by row as the one before does
    backwards = W.partitionBy("_row").orderBy(F.desc("start"), F.desc("flag"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    ahead = F.min(F.when(is_base, F.col("start"))).over(backwards)
    x = one("base", 0).unionByName(one("candidates", 1)).withColumns({"past": past, "ahead": ahead}).filter("flag = 1")
    x = x.filter((F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end")))
    return alone.unionByName(x.select(*alone.columns))


def _edges(x: DataFrame, seed: int) -> DataFrame:
    """side, word, instance, seed, n: how often the instance stands beside the word."""
    sides = F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("beside")), F.struct(F.lit("R").alias("side"), F.col("right").alias("beside"))))
    x = x.select(F.col("word").alias("instance"), sides.alias("s")).select("instance", "s.*").filter("beside != ''")
    return x.groupBy("side", "beside", "instance").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", F.lit(seed))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WORDS else df


def learned(docs: DataFrame, base: DataFrame, candidates: DataFrame, text_col: str = "text") -> DataFrame:
    """The instances that confident patterns discover: instance, score. base, candidates: a row per span."""
    edges = written(_edges(base, 1).unionByName(_edges(candidates, 0)), "edges")
    support = edges.groupBy("side", "beside").agg(F.sum("seed").alias("support"), F.sum("n").alias("reach")).filter(F.col("support") >= MIN_SUPPORT)
    support = written(support, "support")
    n = support.count()
    words = _small(support.select("beside").distinct(), n)
    every = F.split(ascii_lower(F.col(text_col)), f"[{WHITE}]+")
    if not support.filter(F.startswith("beside", F.lit(GLUED))).isEmpty():
        glue = F.transform(F.filter(every, lambda w: F.contains(w, F.lit("=")) | F.contains(w, F.lit(":"))), lambda w: F.concat(F.lit(GLUED), F.regexp_extract(w, _GLUE, 1)))
        every = F.concat(every, glue)
    counts = (
        docs.select(F.explode(every).alias("beside"))
        .join(words, "beside", "left_semi")
        .groupBy("beside")
        .agg(F.count(F.lit(1)).alias("total"))
    )
    # candidates count as true here, so this bound only drops patterns that no round could make confident
    hopeful = support.join(counts, "beside").filter(F.col("reach") >= MIN_CONFIDENCE * F.col("total")).select("side", "beside", "total")
    hopeful = written(hopeful, "hopeful")
    edges = written(edges.join(_small(hopeful, hopeful.count()), ["side", "beside"]).withColumn("score", F.col("seed").cast("double")), "graph")
    scored = edges.groupBy("instance").agg(F.max("score").alias("score"), F.max("seed").alias("seed"))
    if edges.filter("seed = 0").isEmpty():
        return scored.filter("seed = 0").select("instance", "score")
    for _ in range(ROUNDS):
        confidence = edges.groupBy("side", "beside").agg(F.least(F.sum(F.col("n") * F.col("score")) / F.max("total"), F.lit(0.999)).alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        doubt = F.exp(F.sum(F.log(1 - F.coalesce("confidence", F.lit(0.0)))))
        scored = edges.join(confidence, ["side", "beside"], "left").groupBy("instance").agg(F.max("seed").alias("seed"), (1 - doubt).alias("doubt"))
        scored = written(scored.select("instance", "seed", F.when(F.col("seed") == 1, F.lit(1.0)).otherwise(F.col("doubt")).alias("score")), "scores")
        edges = edges.drop("score").join(scored.select("instance", "score"), "instance")
    return scored.filter((F.col("seed") == 0) & (F.col("score") >= MIN_SCORE)).select("instance", "score")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its identifier; base and spans, arrays of (start, kind, end), kind a place in KINDS or CONTEXT."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = written(_found(rows.withColumn("_row", F.monotonically_increasing_id())), "found")
    candidates = written(_apart(found), "candidates")
    seeds = found.filter(F.size("base") > 0).select(F.explode("base").alias("x")).select("x.*")
    more = candidates.join(learned(rows, seeds, candidates, "text"), F.col("word") == F.col("instance"))
    # of one text's spans, which its own row holds anyway
    more = more.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    short = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.transform("base", short)
    rows = found.join(more, "_row", "left")
    return rows.select(F.col("id").alias(id_col), base.alias("base"), F.when(F.col("more").isNull(), base).otherwise(F.array_sort(F.concat(base, "more"))).alias("spans"))


def names() -> Column:
    """The kinds' names, by their number."""
    return F.array(*[F.lit(k) for k, _, _ in KINDS], F.lit("context"))
