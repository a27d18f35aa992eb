"""N-gram Jaccard join, size-aware: subsets of light sets, inverted lists for heavy ones.

Light sets (below the boundary) enumerate their subsets of fixed sizes: every subset that the intersection with a partner could be, that
is with 0 to n - ceil(t n) elements left out. Two light sets that link have their intersection among both's subsets.
Heavy sets are found by inverted lists of single shingles. All sets order their shingles alike, the rarest first, and enter the lists of a
prefix only: two sets that link share a shingle among the first n - ceil(t n) + 1 of each, and it is among the first n - ceil(2t/(1+t) n) + 1 of
the smaller one; a list without a member of the latter kind is not scanned, nor
is a member without another one of a size that could link. Sets just below the boundary have lists too, so a pair with one heavy
member is found there. The boundary is where the written subsets of the sizes below plus the scanned lists of the sizes above cost
least, by the sizes in the corpus.
The order only has to be the same for all: any order gives the same links. Frequencies come from all documents. Each task counts its
shingles and reports the most frequent, as many at most as a fixed number; the sums over tasks rank the shingles, and the rest count as rare.
A shingle that is frequent enough to have a long list is so in many tasks. Lists that may be longer than MOST are dealt out by salt.

Sets with the same contents count once throughout, by a 128-bit identifier; lists with the same members are one list. The members of a
list stream through numpy with a sketch each (counts of elements
by bin; the bins' distance never exceeds the number of differing elements, so pairs whose sketches differ by more than may be are
dropped for certain). In the first turn a member of a short list goes to its nearest one, then all pairs that are left are compared. In a longer list each member outside the largest component goes to
its nearest members of other components, a few at first and more in each turn; linked ones merge, and the list goes on until each member has
offered all there are. So no link between components is lost, and a group of n near copies costs about n comparisons a turn. A list of more than
MOST members is split in parts; its members outside the largest component visit each part, and the list goes on until such a visit offers
nothing more. While these are many, members first meet in parts that are dealt anew in each turn. Comparisons are exact.

Defined results:
- null text or no words: an empty set, linked with nothing; fewer words than a shingle: one shingle, the whole sequence
- repeated rows: the same component; empty table: no rows; extra columns: ignored by ``linked``, kept by ``representatives``
- null identifier: its row takes part like any other; a component is the smallest identifier in it, null if there is none
- repeated identifiers: each row by its own text; ``representatives`` decides by row, not by identifier
- long texts: whole; a set is held in memory by one task at a time
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import BROADCAST_ROWS, discard, spread_join, tidy, written
from tallyweave.llm.components import components
from tallyweave.llm.shingles import mix, shingle_sets

WORDS, PERCENT = 5, 80
PORTION = 1_000_000
#: A list's scan and its comparisons against the writing of a subset.
SCAN_COST = 4
LIGHTEST, HEAVIEST = 1, 64
BINS = 256
#: NEAREST partners in the first turn, GROWTH times as many in each further one.
FEW, NEAREST, GROWTH, MOST, BLOCK = 48, 2, 8, 8192, 128
BROADCAST_IDS = 200_000
#: Shingles that a task reports as frequent, and that all together give: both bound memory whatever the input; they change the order, never the links.
REPORTED, RANKED = 1 << 16, 1 << 18
#: Shingles that a task counts at once.
STRETCH = 1_500_000
#: Members of a list that a task holds at once; longer ones pass through.
HELD = 4096


class Sizes:
    """What the threshold says about sizes; all in whole numbers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def left_out(self, n: int) -> int:
        return n * (100 - self.percent) // 100

    def prefix(self, n: int) -> int:
        """The first shingles, of which a partner shares one."""
        return self.left_out(n) + 1

    def own_prefix(self, n: int) -> int:
        """The same for the smaller of two sets."""
        return n + -(2 * self.percent * n) // (100 + self.percent) + 1

    def subsets(self, n: int) -> int:
        return sum(comb(n, d) for d in range(self.left_out(n) + 1))

    def boundary(self, counts: dict[int, int]) -> int:
        """Sets of fewer elements are light. counts: sets by size, below HEAVIEST."""
        costs, light = [], 0
        heavy = sum(c * self.prefix(n) * SCAN_COST for n, c in counts.items() if n >= LIGHTEST)
        for b in range(LIGHTEST, HEAVIEST + 1):
            costs.append((light + heavy, b))
            light += counts.get(b, 0) * self.subsets(b)
            heavy -= counts.get(b, 0) * self.prefix(b) * SCAN_COST
        return min(costs)[1]


def subset_keys(elements: np.ndarray, left_out: int) -> list[np.ndarray]:
    """Keys of all subsets with up to left_out elements left out."""
    own = mix(elements, 11)
    whole, n = np.add.reduce(own, dtype=np.uint64), len(own)
    out = [np.array([whole], np.uint64)]
    sums, last = np.zeros(1, np.uint64), np.array([-1])
    for d in range(1, left_out + 1):
        grown = [(sums[last < i] + own[i], i) for i in range(n)]
        last = np.concatenate([np.full(len(s), i) for s, i in grown])
        sums = np.concatenate([s for s, _ in grown])
        out.append(mix(whole - sums, 100_000 + n - d))
    out[0] = mix(out[0], 100_000 + n)
    return out


def ranked(elements: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements from the rarest on, and how often each counts. frequent: ascending, with their counts; all others are rare."""
    n = np.zeros(len(elements), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        n = np.where(frequent[at] == elements, counts[at], 0)
    order = np.lexsort((mix(elements, 23), n))
    return elements[order], n[order]


def sketch(elements: np.ndarray) -> bytes:
    """How many elements fall in each bin, at most 255."""
    return np.minimum(np.bincount(mix(elements, 41) >> np.uint64(56), minlength=BINS), 255).astype(np.uint8).tobytes()


def wide_id(elements: np.ndarray) -> bytes:
    """128 bits of a set's contents."""
    sums = [np.add.reduce(mix(elements, salt), dtype=np.uint64, keepdims=True) for salt in (7, 17)]
    return mix(sums[0], len(elements)).tobytes() + mix(sums[1], 3).tobytes()


def _blobs(wide: np.ndarray) -> pa.Array:
    """A binary column of rows of equal width. wide: rows x bytes."""
    offsets = np.arange(len(wide) + 1, dtype=np.int32) * np.int32(wide.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(wide))])


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    a = size = 0
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
    for b, n in enumerate(lengths, 1):
        size += n
        if size >= PORTION or b == len(lengths):
            yield a, b
            a, size = b, 0


class Frequent:
    """The most frequent shingles of a task: counts of a stretch are merged, and the head is kept."""

    def __init__(self) -> None:
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, elements: np.ndarray) -> None:
        self.waiting.append(elements)
        self.size += len(elements)
        if self.size > STRETCH:
            self.merge(4 * REPORTED)

    def merge(self, keep: int) -> None:
        if not self.waiting:
            return
        fresh, n = np.unique(np.concatenate(self.waiting), return_counts=True)
        fresh, n = fresh[n > 1], n[n > 1]
        every, at = np.unique(np.concatenate([self.hashes, fresh]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, n]), len(every)).astype(np.int64)
        best = np.sort(np.lexsort((every, -total))[:keep])
        self.hashes, self.counts, self.waiting, self.size = every[best], total[best], [], 0


def _profile(rows: DataFrame, words: int) -> DataFrame:
    """rows: id, th, text. A row per document: id, th, n, sid (identifier of its set, null when empty) and sketch; and rows with the frequent shingles of each task."""
    id_type = rows.schema["id"].dataType.simpleString()
    kind = rows.select("id").limit(0).toArrow().schema.field(0).type

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = Frequent(), set()
        names = ["id", "th", "n", "sid", "sketch", "hashes", "counts"]
        for batch in batches:
            for a, b in _portions(batch, 2):
                sets = shingle_sets(batch.column(2).slice(a, b - a).to_pylist(), words)
                sids = [wide_id(s) if len(s) else None for s in sets]
                for s, sid in zip(sets, sids):
                    if sid and sid not in seen:
                        seen.add(sid)
                        frequent.add(s)
                n = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(sids, pa.binary()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)
        frequent.merge(REPORTED)
        if len(frequent.hashes):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([frequent.hashes.tobytes()], pa.binary()), pa.array([frequent.counts.tobytes()], pa.binary())], names=names)

    return rows.select("id", "th", "text").mapInArrow(run, f"id {id_type}, th long, n long, sid binary, sketch binary, hashes binary, counts binary")


def _ranks(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The RANKED most frequent shingles of all documents, ascending, and their counts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["hash", "c"])

    each = profile.filter("hashes IS NOT NULL").select("hashes", "counts").mapInArrow(run, "hash long, c long")
    best = each.groupBy("hash").agg(F.sum("c").alias("c")).filter("c > 3").orderBy(F.desc("c"), "hash").limit(RANKED).toArrow()  # a fixed number of rows at most
    hashes, counts = best.column(0).to_numpy().view(np.uint64), best.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _postings(rows: DataFrame, words: int, percent: int, boundary: int, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """key, salt, n (the set's size), own (among the first of a smaller set), sid: the subsets of light sets and the list entries of the others, each set once a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, seen = Sizes(percent), set()
        listed = boundary * percent // 100  # partners of heavy sets reach down to here
        for batch in batches:
            for a, b in _portions(batch, 0):
                keys, salts, own, sids, lengths, counted = [], [], [], [], [], []
                for s in shingle_sets(batch.column(0).slice(a, b - a).to_pylist(), words):
                    if not len(s) or (sid := wide_id(s)) in seen:
                        continue
                    seen.add(sid)
                    n, before = len(s), len(keys)
                    if n < boundary:
                        subsets = np.concatenate(subset_keys(s, sizes.left_out(n)))
                        keys.append(subsets)
                        salts.append(np.zeros(len(subsets), np.int64))
                        own.append(np.ones(len(subsets), bool))
                    if n >= listed:
                        first, often = ranked(s, frequent, counts)
                        first, often = first[: sizes.prefix(n)], often[: sizes.prefix(n)]
                        keys.append(mix(first, 31))
                        parts = -(-often // MOST)
                        salts.append(np.where(parts > 1, 1 + (mix(first + np.frombuffer(sid, np.uint64)[0], 43) >> np.uint64(16)).astype(np.int64) % np.maximum(parts, 1), 0))
                        own.append(np.arange(len(first)) < sizes.own_prefix(n))
                    sids.append(sid)
                    lengths.append(sum(map(len, keys[before:])))
                    counted.append(n)
                if not keys:
                    continue
                wide = np.repeat(np.frombuffer(b"".join(sids), np.uint8).reshape(-1, 16), lengths, axis=0)
                columns = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.repeat(counted, lengths)), pa.array(np.concatenate(own)), _blobs(wide)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "salt", "n", "own", "sid"])

    return rows.select("text").mapInArrow(run, "key long, salt long, n long, own boolean, sid binary")


def _members(postings: DataFrame, percent: int) -> DataFrame:
    """key, sid of the lists with several sets of sizes that may link, one of which may be the smaller. Lists with the same members get the same key."""
    rows = postings.repartition("key", "salt").sortWithinPartitions("key", "salt", "n")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last list of what came so far: it may go on
        passing = None

        def emit(keys: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), _blobs(sids.view(np.uint8).reshape(-1, 16))], names=["key", "sid"])

        def lists(key, salt, size, own, sid, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, passing
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1])
            if passing is not None:
                end = cuts[1] if len(cuts) > 1 else len(key)
                if (key[0], salt[0]) == passing:
                    yield emit(key[:end].copy(), sid[:end].copy())
                    key, salt, size, own, sid = key[end:], salt[end:], size[end:], own[end:], sid[end:]
                    cuts = cuts[1:] - end
                if len(key):
                    passing = None
            if not len(key):
                return
            ends = np.append(cuts[1:], len(key))
            whole = len(cuts) if last else len(cuts) - 1
            if whole:
                upto = ends[whole - 1]
                at = cuts[:whole]
                several = np.zeros(whole, bool)
                for half in (sid[:upto, 0], sid[:upto, 1]):
                    several |= np.minimum.reduceat(half, at) != np.maximum.reduceat(half, at)
                # a list dealt out by salt has its other members elsewhere
                several = (several & np.logical_or.reduceat(own[:upto], at)) | (salt[at] > 0)
                n = ends[:whole] - at
                # members are sorted by size, so the neighbours are the likeliest partners
                near = np.zeros(upto, bool)
                near[1:] = 100 * size[: upto - 1] >= percent * size[1:upto]
                near[at] = False
                keep = np.repeat(several, n) & (near | np.append(near[1:], False) | np.repeat(salt[at] > 0, n))
                print_ = mix(np.add.reduceat(np.where(keep, mix(sid[:upto, 0], 5), np.uint64(0)), at), 47)
                print_ = np.where(salt[at] > 0, key[at], print_)
                if keep.any():
                    yield emit(np.repeat(print_, n)[keep], sid[:upto][keep])
            if not last:
                a = cuts[-1]
                if len(key) - a > HELD:
                    passing = (key[a], salt[a])
                    yield emit(key[a:].copy(), sid[a:].copy())
                    held = []
                else:
                    held = [(key[a:], salt[a:], size[a:], own[a:], sid[a:])]

        for batch in batches:
            if not batch.num_rows:
                continue
            blob = batch.column(4)
            first = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset]
            sid = np.frombuffer(blob.buffers()[2], np.uint8)[first : first + 16 * len(blob)].view(np.uint64).reshape(-1, 2) if first % 8 == 0 else np.frombuffer(b"".join(blob.to_pylist()), np.uint64).reshape(-1, 2)
            now = (batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), sid)
            held.append(now)
            if sum(len(x[0]) for x in held) >= 2 * HELD:
                made = [np.concatenate([x[i] for x in held]) for i in range(5)]
                held = []
                yield from lists(*made, last=False)
        if held:
            yield from lists(*(np.concatenate([x[i] for x in held]) for i in range(5)), last=True)

    return rows.mapInArrow(run, "key long, sid binary").distinct()


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """sid and elements (binary, eight bytes each, ascending) of each text's set, once a task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for a, b in _portions(batch, 0):
                some = []
                for s in shingle_sets(batch.column(0).slice(a, b - a).to_pylist(), words):
                    if len(s) and (sid := wide_id(s)) not in seen:
                        seen.add(sid)
                        some.append((sid, s.tobytes()))
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*some)], names=["sid", "elements"])

    return texts.select("text").mapInArrow(run, "sid binary, elements binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. A set with very many pairs has its elements dealt out with them by salt."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    total = pairs.count()
    sides = {end: sets.select(F.col("node").alias(end), F.col("elements").alias(name)) for end, name in (("a", "x"), ("b", "y"))}
    if total <= BROADCAST_ROWS:  # the pairs go to the sets, so that only those of pairs are shuffled
        few = F.broadcast(pairs)
        both = sides["a"].join(few, "a").join(sides["b"].join(few, "b"), ["a", "b"])
        return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()
    for end, side in sides.items():
        # more than this share of all pairs: fewer than 10,000 sets
        hubs = written(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(500, total // 10_000)).select(end, F.ceil(F.col("_n") / max(250, total // 20_000)).alias("_parts")), "hubs")
        if hubs.isEmpty():
            pairs = pairs.join(side, end)
            continue
        other = "b" if end == "a" else "a"
        parts = F.coalesce("_parts", F.lit(1))
        dealt = pairs.join(F.broadcast(hubs), end, "left").withColumn("_salt", F.pmod(F.xxhash64(other), parts)).drop("_parts")
        spread = side.join(F.broadcast(hubs), end, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).drop("_parts")
        pairs = dealt.join(spread, [end, "_salt"]).drop("_salt")
    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _small(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: id, th (hash of its text), n, sid and label: the least sid of its component; null for an empty set."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), _text_key(text).alias("th"), text.alias("text"))
    profile = written(_profile(rows, words), "profile")
    documents = profile.filter("hashes IS NULL").select("id", "th", "n", "sid")
    counts = {r["n"]: r["count"] for r in documents.filter(F.col("n").between(1, HEAVIEST - 1)).groupBy("n").count().collect()}  # at most HEAVIEST rows
    boundary = Sizes(percent).boundary(counts)
    frequent, often = _ranks(profile)
    members = written(_members(_postings(rows, words, percent, boundary, frequent, often), percent), "members")
    found = written(members.select("sid").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    if found.isEmpty():
        return documents.withColumn("label", F.col("sid"))
    live = written(members.join(found, "sid").select("key", "node"), "live")
    discard(members)
    # one row stands for all of a set: the least identifier's
    of = spread_join(profile.filter("sid IS NOT NULL").select("id", "th", "n", "sid", "sketch"), found, ["sid"]).filter("node IS NOT NULL")
    marks = of.groupBy("node").agg(F.min_by(F.struct("id", "th", "n", "sketch", "sid"), F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("d"))
    marks = written(marks.select("node", "d.*"), "marks")
    roots = _linked_nodes(live, marks, rows, words, percent)
    by_node = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labels = by_node.groupBy("root").agg(F.min_by("sid", "node").alias("label"))
    labels = written(by_node.join(labels, "root").filter("sid <> label").select("sid", "label"), "labels")
    return spread_join(documents, labels, ["sid"]).select("id", "th", "n", "sid", F.coalesce("label", "sid").alias("label"))


def _wanted_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and elements of the sets in wanted (node, sid, id, th), each from the text of one document."""
    n = wanted.count()
    texts = wanted.select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    some = rows.join(_small(texts, n, BROADCAST_IDS), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_semi")
    # a row that stands twice gives its set twice, from two tasks at most as often as there are tasks
    return _sets(some, words).join(_small(wanted.select("sid", "node"), n, BROADCAST_IDS), "sid").select("node", "elements")


def _linked_nodes(live: DataFrame, marks: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """node and root (a node) of the nodes that link with others. live: the lists' members (key, node)."""
    tried = sets = None
    everywhere, turn = False, 0
    roots = live.sparkSession.createDataFrame([], "node long, root long")
    while True:
        labelled = live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn:
            mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
            labelled = written(labelled.join(mixed, "key", "left_semi"), "mixed")
            discard(live)
            if labelled.isEmpty():
                return roots
        everywhere = everywhere or turn > 3
        offered, waiting = _offered(labelled, marks.select("node", "n", "sketch"), percent, turn, everywhere)
        offered = written(offered, "offered")
        fresh = offered.select("a", "b").distinct()
        fresh = written(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
        none = fresh.isEmpty()
        if not none:
            wanted = fresh.select(F.col("a").alias("node")).unionByName(fresh.select(F.col("b").alias("node"))).distinct()
            wanted = wanted if sets is None else wanted.join(sets.select("node"), "node", "left_anti")
            more = written(_wanted_sets(rows, written(wanted.join(marks.drop("sketch", "n"), "node"), "wanted"), words), "sets")
            sets = more if sets is None else sets.unionByName(more)
            links = written(_verified(fresh, sets, percent), "verified")
            roots = _merged(roots, links)
            tried = fresh if tried is None else tried.unionByName(fresh)
        # lists whose members have offered all there are need no other turn; the others go on, split ones until their members have visited all parts
        more = offered.filter("NOT complete").select("key")
        more = more if waiting is None else more.unionByName(waiting)
        before = labelled
        live = written(labelled.select("key", "node").join(more.distinct(), "key", "left_semi"), "live")
        discard(before if turn else None)
        if live.isEmpty():
            return roots
        everywhere = everywhere or none
        turn += 1


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after more links: components of the roots that the links join."""
    edges = links
    for end in ("a", "b"):
        edges = spread_join(edges, roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), [end])
    edges = written(edges.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct(), "edges")
    moved = components(edges)
    known = spread_join(roots.select("node", F.col("root").alias("was")), moved.select(F.col("node").alias("was"), "root"), ["was"])
    fresh = moved.join(roots.select("node"), "node", "left_anti")
    return written(known.select("node", F.coalesce("root", "was").alias("root")).unionByName(fresh), "roots")


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its identifier, n_shingles, component_id."""
    grouped = _grouped(docs, words, percent, id_col, text_col)
    named = written(grouped.filter("n > 0").groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size"), "named")
    out = spread_join(grouped, named, ["label"])
    # alone, or in a group without identifiers: its own
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _offered(live: DataFrame, marks: DataFrame, percent: int, turn: int, everywhere: bool) -> tuple[DataFrame, DataFrame | None]:
    """live: key, node, root. Pairs to compare: key, a, b, complete (whether a member has no others to offer); and the split keys whose members met their own part only."""
    big = live.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > MOST)
    # the size and largest component of the keys that are split; there are fewer than members / MOST
    big = written(big, "big")
    rows, waiting = live, None
    if big.isEmpty():
        rows = rows.select("*", F.lit(0).cast("long").alias("part"), F.lit(2).alias("role"), F.lit(None).cast("long").alias("main"))
    else:
        heads = live.join(big, "key").groupBy("key", "root", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("key", "size").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"))
        heads = heads.select("key", "main", F.ceil(F.col("size") / MOST).alias("parts"), ((F.col("size") - F.col("n_main")) * F.ceil(F.col("size") / MOST) <= 4 * F.col("size")).alias("few"))
        heads = written(heads.withColumn("few", F.col("few") | F.lit(everywhere)), "heads")
        waiting = heads.filter("NOT few").select("key")
        rows = rows.join(heads, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("parts"))
        # in the first turns members meet their own part; then those outside the largest component visit all parts
        visits = F.col("main").isNotNull() & (F.col("root") != F.col("main")) & F.col("few")
        index = rows.select("key", "node", "root", own.alias("part"), F.when(F.col("parts") == 1, 2).when(visits, 0).when(F.col("few"), 0).otherwise(3).alias("role"), "main")
        guests = rows.filter((F.col("parts") > 1) & visits).select("key", "node", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.lit(1).alias("role"), "main")
        rows = index.unionByName(guests)
    rows = rows.join(marks, "node")
    rows = rows.select("key", "part", "role", "node", "root", "n", "main", "sketch").repartition("key", "part").sortWithinPartitions("key", "part", "node")

    nearest = NEAREST * GROWTH**turn

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        out: list[tuple] = []
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and now != tuple(keys[a]):
                    out += _pairs_of(now[0], held, percent, nearest, turn)
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
            if len(out) > 20_000:
                yield _pair_batch(out)
                out = []
        if held:
            out += _pairs_of(now[0], held, percent, nearest, turn)
        if out:
            yield _pair_batch(out)

    return rows.mapInArrow(run, "key long, a long, b long, complete boolean"), waiting


def _pair_batch(pairs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pairs), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["key", "a", "b", "complete"])


def _pairs_of(key: int, parts: list[pa.RecordBatch], percent: int, nearest: int, turn: int) -> list[tuple]:
    """The pairs that a key's members offer. Roles: 0 only visited, 1 only visiting, 2 both, 3 both in a part of a split key."""
    rows = pa.Table.from_batches(parts)
    role, node, root, n = (rows.column(i).to_numpy() for i in (2, 3, 4, 5))
    sketches = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(len(node), BINS).astype(np.int16)
    index = np.flatnonzero(role != 1)
    if len(node) <= FEW and (role == 2).all():
        x, y = np.triu_indices(len(node), 1)
        apart = np.abs(sketches[x] - sketches[y]).sum(1)
        keep = (root[x] != root[y]) & (apart <= (n[x] + n[y]) * (100 - percent) // (100 + percent))
        x, y, apart = x[keep], y[keep], apart[keep]
        complete = turn > 0 or len(x) < len(node)
        if not complete:  # each member's nearest
            order = np.argsort(apart, kind="stable")
            some = set()
            for ends in (x, y):
                some.update(order[np.unique(ends[order], return_index=True)[1]].tolist())
            some = sorted(some)
            complete, x, y = len(some) == len(x), x[some], y[some]
        return [(key, min(a, b), max(a, b), complete) for a, b in zip(node[x].tolist(), node[y].tolist())]
    main = rows.column(6)[0].as_py()
    if main is None:
        values, counts = np.unique(root, return_counts=True)
        main = values[counts.argmax()] if counts.max() > 1 else None
    visiting = [i for i in np.flatnonzero(role != 0) if root[i] != main]
    by_bin = np.ascontiguousarray(sketches[index].T)
    out = []
    for a in range(0, len(visiting), BLOCK):
        some = np.array(visiting[a : a + BLOCK])
        apart = np.zeros((len(some), len(index)), np.int32)
        for mine, bin_ in zip(sketches[some].T, by_bin):
            apart += np.abs(mine[:, None] - bin_[None, :])
        far = (n[some][:, None] + n[index][None, :]) * (100 - percent) // (100 + percent)
        apart[(apart > far) | (root[some][:, None] == root[index][None, :])] = 2**30
        for i, row in zip(some, apart):
            most = NEAREST if role[i] == 3 else nearest
            near = np.argsort(row, kind="stable")[: most + 1]
            near = node[index[near[row[near] < 2**30]]]
            complete, near = len(near) <= most, near[:most]
            own = np.full(len(near), node[i])
            out += zip([key] * len(near), np.minimum(own, near).tolist(), np.maximum(own, near).tolist(), [complete] * len(near))
    return out


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of linked ones, the smallest identifier's; all columns as they were. Decided by row: of rows with one
    identifier and different texts each has its own group; of rows equal in both one stays; nulls are the largest; rows without words all stay."""
    grouped = _grouped(docs, words, percent, id_col, text_col)
    each = written(grouped.filter("n > 0").groupBy("id", "th").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("times")), "rows")
    groups = each.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best"), F.sum("times").alias("size"))
    groups = written(groups.filter("size > 1").drop("size"), "groups")
    first = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("th") == F.col("best.th"))
    fates = spread_join(each, groups, ["label"]).filter("best IS NOT NULL").select("id", "th", F.when(~first, "gone").when(F.col("times") > 1, "one").alias("fate"))
    fates = written(fates.filter("fate IS NOT NULL").select(F.col("id").alias("_jaccard_id"), F.col("th").alias("_jaccard_th"), F.col("fate").alias("_jaccard_fate")), "fates")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_jaccard_id")) & (_text_key(F.col(f"`{text_col}`").cast("string")) == F.col("_jaccard_th"))
    told = lambda how: _small(fates.filter(F.col("_jaccard_fate") == how) if how else fates, fates.count(), BROADCAST_IDS)
    stay = docs.join(told(None), same, "left_anti")
    if fates.filter("_jaccard_fate = 'one'").isEmpty():
        return stay
    one = docs.join(told("one"), same).dropDuplicates(["_jaccard_id", "_jaccard_th"]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return stay.unionByName(one)
