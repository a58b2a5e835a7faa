"""N-gram Jaccard join: all pairs of texts whose word-shingle sets are similar, as classes.

Two texts link where ``100 * |A & B| >= threshold * |A | B|`` over distinct shingles; classes are the
connected components of all links. Equal sets are one text from the start: its smallest doc_id is the
node that stands for it. The rest is found by T-occurrence search inside bounded cells, and by arranging
that every pair that could link meets in some cell:

1. *Reduction.* A text goes to one cell for each of ``ROUNDS`` minimum hashes; cells of more than
   ``shard_shingles`` are dealt into several at random. Near copies mostly meet here, so that a third of
   all rows being near copies of one another becomes a few classes.
2. *Completion, exact.* Each set is ordered rarest first (frequent shingles, known from a bounded
   sketch, last; the order decides cost, never results) and its prefix is emitted, longer than the
   shortest possible one by ``EXTRA`` hundredths of the set: two sets that link then share at least
   ``least`` shingles of their prefixes. A shingle whose texts are already in one class is done, and so
   is a text with fewer than ``least`` undone shingles. A text leaves out its ``least - 1`` shingles
   with the most texts - with an order that all texts share, a linked pair still has one in common - so
   very common shingles fall away. What is left of a shingle's texts is split at gaps of their set sizes
   that no link can cross. First one member per class and shingle is searched, then all.
   Texts joined by shingles form blocks; a block within ``shard_shingles`` is one cell, a larger one is
   cut into pairs of parts, a very large one shingle by shingle.

A cell's search is DivideSkip: the inverted lists of a query's shingles are split into the longest
ones and the rest; the short lists are merged (through a heap; beyond ``HEAP_ENTRIES`` entries by
counting in one array, which gives the same counts) and candidates that reach ``T - L`` are looked up
in the long ones by binary search, one by one or, if many, all in one call. Lists hold class leaders only. A text linked to a leader joins its
star. A text that links to a member of a star shares with the leader at least what it must share with
the member less what the member has apart from the leader, and is within twice the threshold's distance
of it; T is the larger of the two bounds, and only members that can still reach are compared.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of
fewer words than ``k`` has its whole word sequence as its one shingle; a very long text is one query
like any other; repeated rows link through their equal sets; rows of one doc_id are one node; ties
have no effect, classes are named by their smallest doc_id; rows without doc_id get a null class; an
empty table gives an empty result; ``keep_one_of_each`` hands columns of any name through. Shingles are
compared by 64-bit hashes, whole sets by 128 bits.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import mix64, pieces, shingle_sets
from .common import components, drop, numbered, restored, scratch, table

SHINGLE = 5
THRESHOLD = 75
ROUNDS = 3
SHARD_SHINGLES = 300_000
PART_BYTES = 2_000_000
#: Blocks of up to this many cells' size are cut into parts, larger ones into their shingles' groups.
MOST_PARTS = 8
#: By how many hundredths of a set its prefix is longer than the least.
EXTRA = 10
#: Up to this many rows of ids (at most 32 bytes each) are broadcast to fetch or drop texts.
BROADCAST_IDS = 1_000_000
#: Frequent shingles: reported by a task from this count on, kept up to this many.
FREQUENT_IN_TASK, FREQUENT_KEPT = 4, 200_000
#: Up to this many entries of short lists go through a heap.
HEAP_ENTRIES = 64
#: More candidates than these are probed together.
FEW_CANDIDATES = 8
_SEEDS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1, 0xA54FF53A5F1D36F1], np.uint64)


class Shard:
    """Texts that meet, with their inverted index over leaders, and the links found."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        # a member m of a star has distance <= 1 - t to its leader, a partner q of m likewise to m
        self.near = max(0, 2 * threshold - 100)
        self.sets: list[np.ndarray] = []
        self.ids: list[int] = []
        self.up: list[int] = []
        self.lists: dict[int, array] = {}
        self.leaders: list[int] = []
        #: for each leader its members with the number of shingles each has apart from it
        self.members: list[list[tuple[int, int]]] = []
        self.apart: list[int] = []
        self.most_apart = 0
        self.by_id: dict[int, int] = {}
        self.by_class: dict[int, int] = {}
        self.seen: set[tuple[int, bytes]] = set()

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            first, second = (x, y) if self.ids[x] <= self.ids[y] else (y, x)
            self.up[second] = first

    def needed(self, n: int) -> int:
        """What a set of ``n`` shares with a partner at least."""
        return -(-self.threshold * n // 100)

    def linked(self, a: np.ndarray, b: np.ndarray, shared: int | None = None) -> bool:
        if shared is None:
            shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared * 100 >= self.threshold * (len(a) + len(b) - shared)

    def occurrences(self, shingles: list[int], least: int) -> list[tuple[int, int]]:
        """DivideSkip: leaders that share at least ``least`` of the shingles, and how many."""
        found = [x for s in shingles if (x := self.lists.get(s)) is not None]
        if len(found) < least:
            return []
        found.sort(key=len)
        longest = len(found[-1])
        n_long = min(least - 1, int(least / (0.0085 * np.log2(longest) + 1))) if longest > 1 else 0
        short, long = found[: len(found) - n_long], found[len(found) - n_long :]
        if sum(map(len, short)) <= HEAP_ENTRIES:
            merged = [(x, n) for x, run in groupby(heapq.merge(*short)) if (n := sum(1 for _ in run)) >= least - n_long]
        else:
            counts = np.bincount(np.frombuffer(b"".join(short), np.int32))
            reach = np.flatnonzero(counts >= max(1, least - n_long))
            if len(reach) > FEW_CANDIDATES:
                return self._probed(reach, counts[reach], long, least)
            merged = list(zip(reach.tolist(), counts[reach].tolist(), strict=True))
        out = []
        for leader, n in merged:
            for k, entries in enumerate(long):
                if n + n_long - k < least:
                    break
                at = bisect_left(entries, leader)
                n += at < len(entries) and entries[at] == leader
            else:
                if n >= least:
                    out.append((leader, n))
        return out

    @staticmethod
    def _probed(reach: np.ndarray, counts: np.ndarray, long: list[array], least: int) -> list[tuple[int, int]]:
        """Binary search of many candidates at once, list by list; who can no longer reach ``least`` goes."""
        for k, entries in enumerate(long):
            if k % 8 == 7:
                able = counts + (len(long) - k) >= least
                reach, counts = reach[able], counts[able]
            own = np.frombuffer(entries, np.int32)
            counts = counts + (own[np.minimum(own.searchsorted(reach), len(own) - 1)] == reach)
        able = counts >= least
        return list(zip(reach[able].tolist(), counts[able].tolist(), strict=True))

    def add(self, doc: int, group: int | None, own: np.ndarray) -> None:
        """One text; ``group`` is the class it is known to be in (texts of a class are united)."""
        if not len(own) or (key := (doc, own.tobytes())) in self.seen:
            return
        self.seen.add(key)
        me = len(self.sets)
        self.sets.append(own)
        self.ids.append(doc)
        self.up.append(me)
        for known, name in ((self.by_id, doc), (self.by_class, group)):
            if name is not None:
                self.union(known.setdefault(name, me), me)
        shingles = own.tolist()
        n, star = len(shingles), False
        need = self.needed(n)
        hits = self.occurrences(shingles, max(1, -(-self.near * n // 100), need - self.most_apart))
        near = []
        for leader, shared in hits:
            other = self.leaders[leader]
            if self.linked(own, self.sets[other], shared):
                self.union(other, me)
                if not star:
                    star = True
                    apart = n - shared
                    self.members[leader].append((me, apart))
                    self.apart[leader] = max(self.apart[leader], apart)
                    self.most_apart = max(self.most_apart, apart)
            elif shared + self.apart[leader] >= need:
                near.append((leader, shared))
        for leader, shared in near:  # a star is one class
            if self.find(self.leaders[leader]) == self.find(me):
                continue
            for m, apart in self.members[leader]:
                size = len(self.sets[m])
                if shared + apart >= max(need, self.needed(size)) and min(n, size) >= self.needed(max(n, size)) and self.linked(own, self.sets[m]):
                    self.union(m, me)
                    break
        if not star:
            leader = len(self.leaders)
            self.leaders.append(me)
            self.members.append([])
            self.apart.append(0)
            lists = self.lists
            for s in shingles:
                if s in lists:
                    lists[s].append(leader)
                else:
                    lists[s] = array("i", (leader,))

    def result(self) -> list[tuple[int, int]]:
        """(doc_id, smallest doc_id of its class in this cell)."""
        return [(doc, self.ids[self.find(k)]) for k, doc in enumerate(self.ids)]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def describe(docs: DataFrame, k: int) -> DataFrame:
    """From (doc_id, text): per row n, a 128-bit digest of the set (d1, d2), minimum hashes m0...;
    rows of kind 1 carry frequent shingles (d1) with their counts (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n", "d1", "d2", *[f"m{i}" for i in range(ROUNDS)]]
        counts: dict[int, int] = {}
        held: list[np.ndarray] = []

        def settle() -> None:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= FREQUENT_IN_TASK
            for v, c in zip(values[often].tolist(), n[often].tolist(), strict=True):
                counts[v] = counts.get(v, 0) + c
            held.clear()

        for batch in batches:
            for part in pieces(batch, "text", PART_BYTES):
                sets = shingle_sets(part.column(1), k)
                held.extend(sets)
                rows = np.zeros((len(sets), 3 + ROUNDS), np.uint64)
                for r, s in enumerate(sets):
                    rows[r, 0] = len(s)
                    if len(s):
                        a = mix64(s ^ _SEEDS[2])
                        rows[r, 1], rows[r, 2] = np.add.reduce(a), np.add.reduce(mix64(a ^ _SEEDS[3]))
                        for i in range(ROUNDS):
                            rows[r, 3 + i] = mix64(s ^ _SEEDS[i]).min()
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column(0), *[pa.array(_signed(np.ascontiguousarray(rows[:, c]))) for c in range(rows.shape[1])]], names=names)
                if sum(map(len, held)) > 2_000_000:
                    settle()
        if held:
            settle()
        if counts:
            top = sorted(counts.items(), key=lambda x: -x[1])[:FREQUENT_KEPT]
            zero = pa.array(np.zeros(len(top), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(top), np.int32)), pa.nulls(len(top), pa.int64()), pa.array([c for _, c in top], pa.int64()), pa.array(_signed(np.array([v for v, _ in top], np.uint64))), zero, *[zero] * ROUNDS], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, d1 long, d2 long, " + ", ".join(f"m{i} long" for i in range(ROUNDS)))


def prefixes(docs: DataFrame, frequent: np.ndarray, k: int, threshold: int) -> DataFrame:
    """Per text its prefix shingles, enough of the rarest that linked texts share one: ``tokens``,
    and apart from them those that are frequent (``often``); ``n``, the set's size."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_KEPT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in pieces(batch, "text", PART_BYTES):
                rare: list[np.ndarray] = []
                rest: list[np.ndarray] = []
                sizes_of = []
                for s in shingle_sets(part.column(1), k):
                    n = len(s)
                    # the first shared shingles, as many as both sets' extra, lie within both prefixes
                    most = min(n, n - -(-threshold * n // 100) + max(1, -(-EXTRA * n // 100))) if n else 0
                    sizes_of.append(n)
                    common = np.zeros(len(s), bool)
                    if len(often) and most:
                        common = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    rare.append(s[~common][:most])
                    rest.append(s[common][: most - len(rare[-1])])
                lists = []
                for found in (rare, rest):
                    sizes = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                    lists.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(_signed(np.concatenate(found)))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes_of, pa.int64()), *lists], names=["doc_id", "n", "tokens", "often"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, tokens array<long>, often array<long>")


def search(cells: DataFrame, k: int, threshold: int) -> DataFrame:
    """From (cell, doc_id, comp, text), dealt and sorted by cell: the links (doc_id, root) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, held = Shard(threshold), None, []

        def made() -> pa.RecordBatch:
            pairs = np.array(held, np.int64).reshape(-1, 2)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["doc_id", "root"])

        for batch in batches:
            for part in pieces(batch, "text", PART_BYTES):
                sets = shingle_sets(part.column(3), k)
                for c, doc, comp, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), sets, strict=True):
                    if c != number:
                        held.extend(x for x in shard.result() if x[0] != x[1])
                        shard, number = Shard(threshold), c
                        if len(held) > 50_000:
                            yield made()
                    shard.add(doc, comp, own)
        held.extend(x for x in shard.result() if x[0] != x[1])
        yield made()

    return cells.select("cell", "doc_id", "comp", "text").mapInArrow(run, "doc_id long, root long")


def _light(ids: DataFrame) -> DataFrame:
    """A written table of ids. A measured, small number of them goes to every task, which spares the
    shuffle of what they are joined with; more take part in a shuffled join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _searched(docs: DataFrame, cells: DataFrame, k: int, threshold: int, shard_shingles: int) -> DataFrame:
    """Links of a written table of cells (cell, doc_id, comp, n), written."""
    spark = docs.sparkSession
    # work follows shingles rather than bytes, so the number of tasks does too
    work = cells.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 2 * work // shard_shingles)
    rows = docs.select("doc_id", "text").join(_light(cells), "doc_id").repartition(tasks, "cell").sortWithinPartitions("cell", F.xxhash64("doc_id"), "doc_id")
    found = scratch(spark, search(rows, k, threshold), "found")
    drop(spark, cells)
    return found


def _reduced(docs: DataFrame, reps: DataFrame, k: int, threshold: int, shard_shingles: int) -> DataFrame:
    """Links between texts that share a minimum hash."""
    keyed = reps.select("doc_id", "n", F.posexplode(F.array(*[f"m{i}" for i in range(ROUNDS)])).alias("i", "m")).select("doc_id", "n", F.xxhash64("i", "m").alias("key"))
    size = keyed.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("s")).where("c > 1").select("key", F.ceil(F.col("s") / shard_shingles).alias("parts"))
    cell = F.xxhash64("key", F.pmod(F.xxhash64("doc_id", "key"), F.col("parts")))
    cells = scratch(docs.sparkSession, keyed.join(size, "key").select(cell.alias("cell"), "doc_id", F.col("doc_id").alias("comp"), "n"), "cells")
    return _searched(docs, cells, k, threshold, shard_shingles)


def _relabel(spark: SparkSession, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Apply links between classes (comp, root) to (doc_id, comp)."""
    roots = components(spark, links.select(F.col("comp").alias("a"), F.col("root").alias("b")))
    made = classes.join(roots, classes["comp"] == roots["node"], "left").select("doc_id", F.coalesce("root", "comp").alias("comp"))
    return scratch(spark, made, "labels")


def _size_runs(groups: DataFrame, threshold: int) -> DataFrame:
    """(token, doc_id, comp, n) with each token's texts split into runs of set sizes, a token of its
    own each, wherever the next size is too large for a link; runs of one class are left out.

    Sizes are aggregated before they are ordered: a token has no more of them than sizes occur.
    """
    sizes = groups.groupBy("token", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    rising = Window.partitionBy("token").orderBy("n")
    gap = F.coalesce((F.lag("n").over(rising) * 100 < F.col("n") * threshold).cast("int"), F.lit(0))
    runs = sizes.withColumn("gap", gap).withColumn("run", F.sum("gap").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("token", "run")
    kept = runs.select("token", "n", "run", F.min("lo").over(run).alias("lo"), F.max("hi").over(run).alias("hi")).where("lo <> hi")
    return groups.join(kept.select("token", "n", "run"), ["token", "n"]).select(F.xxhash64("token", "run").alias("token"), "doc_id", "comp", "n")


def _cells(spark: SparkSession, groups: DataFrame, shard_shingles: int) -> DataFrame:
    """(token, doc_id, comp, n) to cells in which all texts of a token meet.

    Texts joined by tokens, directly or through others, form blocks; a block within ``shard_shingles``
    is one cell, so each of its texts is sent once. A larger one is cut into pairs of parts. Of more
    than ``MOST_PARTS`` parts every token is a block of its own, cut likewise.
    """
    # a token joins its texts to the least of them: texts are far fewer than tokens, and so are their edges
    lowest = groups.groupBy("token").agg(F.min("doc_id").alias("low"))
    blocks = components(spark, groups.join(lowest, "token").select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    texts = groups.groupBy("doc_id", "comp").agg(F.max("n").alias("n"))
    placed = texts.join(blocks, texts["doc_id"] == blocks["node"], "left").select("doc_id", "comp", "n", F.coalesce("root", "doc_id").alias("key"))
    placed = scratch(spark, placed, "placed")

    def parts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.ceil(F.sum("n") / shard_shingles).cast("int").alias("parts"))

    def paired(rows: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
        other = rows.withColumn("b", part).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # a part meets itself wherever it meets another
        return other.where("parts = 1 OR b <> o").select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("cell"), "doc_id", "comp", "n")

    sized = placed.join(parts(placed), "key")
    whole = paired(sized.where(F.col("parts") <= MOST_PARTS))
    large = scratch(spark, sized.where(F.col("parts") > MOST_PARTS).select("doc_id").distinct(), "large")
    if large.isEmpty():
        return whole
    rest = groups.join(large, "doc_id").withColumnRenamed("token", "key")
    return whole.unionByName(paired(rest.join(parts(rest), "key")).distinct())


def classes_of(docs: DataFrame, *, k: int = SHINGLE, threshold: int = THRESHOLD, shard_shingles: int | None = None) -> DataFrame:
    """From (doc_id, text): a row per input row, doc_id, n_shingles, component_id."""
    spark, shard_shingles = docs.sparkSession, shard_shingles or SHARD_SHINGLES
    described = scratch(spark, describe(docs, k), "sets", partition_by="kind")
    rows = described.where("kind = 0")
    texts = rows.where("n > 0 AND doc_id IS NOT NULL")
    # equal sets once: the smallest doc_id of each is the node that is searched
    first = texts.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(ROUNDS)])
    first = scratch(spark, first, "first")
    reps = first.withColumnRenamed("rep", "doc_id")
    links = _reduced(docs, reps, k, threshold, shard_shingles).withColumnRenamed("doc_id", "comp")
    # one node per doc_id: where its rows have several sets, those are linked through it
    twice = texts.groupBy("doc_id").agg(F.min(F.struct("n", "d1", "d2")).alias("lo"), F.max(F.struct("n", "d1", "d2")).alias("hi")).where("lo <> hi")
    twice = scratch(spark, twice.select("doc_id"), "twice")
    if not twice.isEmpty():
        both = texts.join(twice, "doc_id").join(first, ["n", "d1", "d2"]).select(F.col("doc_id").alias("comp"), F.col("rep").alias("root"))
        links = links.unionByName(both)
    nodes = reps.select("doc_id", F.col("doc_id").alias("comp")).distinct()
    labels = _relabel(spark, nodes, links)
    labels = _complete(spark, docs, described, labels, k, threshold, shard_shingles)
    named = first.join(labels, first["rep"] == labels["doc_id"]).select("n", "d1", "d2", "comp")
    of = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("d1")).alias("d1"), "d2")
    return of.join(named, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def _undone(tokens: DataFrame) -> DataFrame:
    """(token, doc_id, comp, n, texts) of prefix shingles whose texts are in several classes."""
    # rare shingles: their texts, at most three of each task, meet in one shuffle; frequent ones are pre-aggregated by task
    rare = tokens.select(F.explode("tokens").alias("token"), "doc_id", "comp", "n")
    together = Window.partitionBy("token")
    rare = rare.select("*", F.min("comp").over(together).alias("lo"), F.max("comp").over(together).alias("hi"), F.count("*").over(together).alias("texts")).where("lo <> hi").drop("lo", "hi")
    often = tokens.where("size(often) > 0").select(F.explode("often").alias("token"), "doc_id", "comp", "n")
    mixed = often.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("texts")).where("lo <> hi").select("token", "texts")
    return rare.unionByName(often.join(mixed, "token"))


def _able(undone: DataFrame, threshold: int) -> DataFrame:
    """Texts with at least ``least`` undone shingles, without their ``least - 1`` commonest ones."""
    own = Window.partitionBy("doc_id")
    commonest = own.orderBy(F.desc("texts"), "token")
    # linked sets share the extra of the smaller one, and no partner is smaller than the threshold allows;
    # rows of one doc_id with different texts are one node: the least of their demands holds, a shingle counts once
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * threshold / 100) * EXTRA / 100))
    ranked = undone.select("token", "doc_id", "comp", "n", F.min(least).over(own).alias("least"), F.dense_rank().over(commonest).alias("place"))
    return ranked.where("place >= least").select("token", "doc_id", "comp", "n").distinct()


def _complete(spark: SparkSession, docs: DataFrame, described: DataFrame, labels: DataFrame, k: int, threshold: int, shard_shingles: int) -> DataFrame:
    """(doc_id, comp) with every link that the reduction has left."""
    often = described.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "d1").limit(FREQUENT_KEPT)
    frequent = np.sort(np.array([r.d1 for r in often.select("d1").collect()], np.int64).view(np.uint64))
    tokens = scratch(spark, prefixes(docs, frequent, k, threshold).where("doc_id IS NOT NULL AND n > 0").join(_light(labels), "doc_id"), "prefixes")
    undone = scratch(spark, _undone(tokens), "undone")
    groups = scratch(spark, _size_runs(_able(undone, threshold), threshold), "groups")
    drop(spark, tokens, undone)
    for step in ("one of each class", "all"):
        if groups.isEmpty():
            break
        part = groups
        if step != "all":
            part = groups.groupBy("token", "comp").agg(F.min(F.struct("doc_id", "n")).alias("x"), F.count("*").alias("members")).select("token", "comp", "x.doc_id", "x.n", "members")
            part = scratch(spark, part, "firsts")
            # where every class had one member here, all of the group is searched now
            later = part.groupBy("token").agg(F.max("members").alias("m")).where("m > 1").select("token")
        cells = scratch(spark, _cells(spark, part.select("token", "doc_id", "comp", "n"), shard_shingles), "cells")
        found = _searched(docs, cells, k, threshold, shard_shingles)
        # a root is a text; what links are its class and the root's class
        by = labels.select(F.col("doc_id").alias("root"), F.col("comp").alias("to"))
        links = found.distinct().join(labels, "doc_id").join(by, "root").where("comp <> to").select("comp", F.col("to").alias("root")).distinct()
        links = scratch(spark, links, "links")
        none = links.isEmpty()
        if not none:
            labels = _relabel(spark, labels, links)
        if step == "all":
            break
        rest = groups.join(later, "token")
        if not none:
            rest = rest.drop("comp").join(labels, "doc_id").select("token", "doc_id", "comp", "n")
        several = rest.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        groups = scratch(spark, rest.join(several, "token"), "groups")
    return labels


def _among(rows: DataFrame, id_: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join with a written table of ids, broadcast where their number has been measured as small."""
    return rows.join(_light(ids.select(F.col("doc_id").alias("_id"))), F.col(id_) == F.col("_id"), how)


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows whose doc_id names its class; of repeated rows of that doc_id one stays.

    Rows without doc_id or without words stay as they are. Texts are shuffled only where doc_ids repeat.
    """
    rows, names = numbered(docs)
    id_, text = names["doc_id"], names["text"]
    classes = scratch(docs.sparkSession, classes_of(docs.select("doc_id", "text"), **options).where("doc_id IS NOT NULL AND n_shingles > 0"), "classes")
    per = scratch(docs.sparkSession, classes.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("component_id").alias("component_id")).where("c > 1 OR component_id <> doc_id"), "going")
    worded = F.rlike(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) & F.col(id_).isNotNull()
    going = per.where("component_id <> doc_id")
    kept = _among(rows.where(worded), id_, going, "left_anti")
    repeated = per.where("component_id = doc_id")
    if not repeated.isEmpty():
        # rank the rows of a kept id by content
        again = _among(kept, id_, repeated, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(id_).orderBy(F.xxhash64(text)))).where("_n = 1").drop("_n")
        kept = _among(kept, id_, repeated, "left_anti").unionByName(again)
    return restored(kept.unionByName(rows.where(~worded)), docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
