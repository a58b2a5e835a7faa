"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents of one input partition. Its words become numbers; a suffix
array gives the Burrows-Wheeler transform, held in a wavelet tree whose levels answer rank. All
test phrases are searched backward at once, occurrences are located by walking back to sampled
suffix positions, and overlapping spans are merged by a difference array. No shuffle takes place.

Words unknown to the test set cannot take part in a match: they end a run, and runs shorter than
the shortest phrase are left out of the index, as they cannot hold any. A text of more words than
a shard is cut into pieces that overlap by the longest phrase, so nothing is lost at a cut.

The test set goes out in blocks of at most ``block_chars`` characters; one block is the usual case.
With more, each block is broadcast for one pass, written out, and the spans of the passes merge.

Defined results: null texts have no words; items without words have no phrase; null item_ids are
left out of the lists though their phrases count as hits; repeated items count once each by id and
repeated documents are answered row by row; an empty side gives zero hits or an empty result;
further columns pass through ``flag_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM, hashed_words, pieces, text_bytes
from .common import numbered, restored, scratch, table

PHRASE_WORDS = 13
SHARD_BYTES = 4_000_000
SHARD_WORDS = 1_000_000
BLOCK_CHARS = 2_000_000
SAMPLE = 8


class Phrases:
    """Windows of a block of test items as rows of word numbers; numbers from 1, 0 is no word."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        ids = [i for i, _ in items]
        data, off = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        words, at = hashed_words(data, off, ALNUM)
        self.words = np.unique(words)
        numbers = np.searchsorted(self.words, words).astype(np.int32) + 1
        seen: dict[bytes, int] = {}
        owners: list[set[int]] = []
        self.names = sorted({i for i in ids if i is not None})
        place = {n: k for k, n in enumerate(self.names)}
        for k, item in enumerate(ids):
            own = numbers[at[k] : at[k + 1]]
            size = min(width, len(own))
            for s in range(len(own) - size + 1 if size else 0):
                p = seen.setdefault(own[s : s + size].tobytes(), len(seen))
                if p == len(owners):
                    owners.append(set())
                if item is not None:
                    owners[p].add(place[item])
        found = [np.frombuffer(b, np.int32) for b in seen]
        self.length = np.array([len(f) for f in found], np.int64)
        self.table = np.zeros((len(found), width), np.int32)
        for k, f in enumerate(found):
            self.table[k, width - len(f) :] = f
        self.owner_off = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owners = np.array([x for o in owners for x in sorted(o)], np.int64)
        self.shortest = int(self.length.min()) if len(found) else 0
        self.longest = int(self.length.max()) if len(found) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes not yet told apart are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    heads = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank[order] = first
    width = 1
    while True:
        alone = heads & np.append(heads[1:], True)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            return order
        suffix = order[todo]
        after = suffix + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[suffix]))
        suffix, second = suffix[by], second[by]
        group = rank[suffix]
        order[todo] = suffix
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        heads[todo] = new
        lead = np.maximum.accumulate(np.where(new, todo, 0))
        rank[suffix] = lead
        width *= 2


class WaveletTree:
    """Levels of bits, most significant first, each with cumulative zeros (a wavelet matrix)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones_before, self.flags = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones_before.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.flags.append(bit.astype(np.int8))
            self.zeros.append(int(len(bit) - self.ones_before[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(upto), upto
        for k in range(self.bits):
            ones, bit = self.ones_before[k], (symbol >> (self.bits - 1 - k)) & 1
            low = np.where(bit, self.zeros[k] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[k] + ones[high], high - ones[high])
        return high - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.bits):
            ones, bit = self.ones_before[k], self.flags[k][at].astype(at.dtype)
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones[at], at - ones[at])
            low = np.where(bit, self.zeros[k] + ones[low], low - ones[low])
        return symbol, at - low


class FMIndex:
    """Over a sequence of positive numbers; 0 ends it (and separates runs within it)."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.append(text, 0).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))]).astype(np.int64)
        self.tree = WaveletTree(bwt, max(1, int(sigma).bit_length()))
        marked = (sa % sample == 0) | (bwt == 0)  # the start of a run too: no walk crosses an end
        self.marked = marked
        self.marks_before = np.concatenate([[0], np.cumsum(marked)]).astype(np.int64)
        self.samples = sa[marked]

    def ranges(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase (right-aligned rows of numbers), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(length[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -back].astype(np.int64)
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: walk back to a sampled suffix, counting steps."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.marked[rows])
        while len(todo):
            symbol, rank = self.tree.access_rank(rows[todo])
            rows[todo] = self.before[symbol] + rank
            steps[todo] += 1
            todo = todo[~self.marked[rows[todo]]]
        return self.samples[self.marks_before[rows]] + steps


def _kept_runs(numbers: np.ndarray, off: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions to index - runs of known words long enough - and which of them end a run."""
    known = numbers > 0
    start = known.copy()
    start[1:] &= ~known[:-1]
    heads = off[:-1][off[:-1] < len(numbers)]
    start[heads] |= known[heads]
    begin = np.flatnonzero(start)
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    tails = off[1:][off[1:] > 0] - 1
    stop[tails] |= known[tails]
    end = np.flatnonzero(stop) + 1
    keep = end - begin >= shortest
    begin, end = begin[keep], end[keep]
    size = end - begin
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    last = np.zeros(len(at), bool)
    last[np.cumsum(size) - 1] = True
    return at, last


def search_shard(hashes: np.ndarray, off: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Starts and phrase numbers of all occurrences within the rows' words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(hashes) or not len(phrases.length):
        return none
    place = np.minimum(np.searchsorted(phrases.words, hashes), len(phrases.words) - 1)
    numbers = np.where(phrases.words[place] == hashes, place + 1, 0)
    at, last = _kept_runs(numbers, off, phrases.shortest)
    if not len(at):
        return none
    # a zero after each run keeps matches within runs; source[] takes index positions to words
    slot = np.arange(len(at)) + np.concatenate([[0], np.cumsum(last)[:-1]])
    text = np.zeros(slot[-1] + 1, np.int64)
    text[slot] = numbers[at]
    source = np.zeros(len(text), np.int64)
    source[slot] = at
    index = FMIndex(text, len(phrases.words))
    low, high = index.ranges(phrases.table, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return source[index.locate(rows)], which


def _cut_long(hashes: np.ndarray, phrases: Phrases, most: int) -> tuple[np.ndarray, np.ndarray]:
    """search_shard over one long text, in pieces overlapping by the longest phrase."""
    starts, which = [], []
    step = max(1, most)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step + max(phrases.longest - 1, 0)]
        s, w = search_shard(part, np.array([0, len(part)]), phrases)
        own = s < step
        starts.append(s[own] + at)
        which.append(w[own])
    return np.concatenate(starts), np.concatenate(which)


def _hits(column: pa.Array, phrases: Phrases, most: int) -> Iterator[tuple[int, list[list[int]], list[str]]]:
    """For each text: number of words, merged spans of hit words, names of the items found."""
    data, at = text_bytes(column)
    hashes, off = hashed_words(data, at, ALNUM)
    if len(off) == 2 and len(hashes) > most:
        start, which = _cut_long(hashes, phrases, most)
    else:
        start, which = search_shard(hashes, off, phrases)
    step = np.zeros(len(hashes) + 1, np.int64)
    if len(start):
        np.add.at(step, start, 1)
        np.add.at(step, start + phrases.length[which], -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(step) > 0).astype(np.int8)]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row_of = np.searchsorted(off, start, "right") - 1
    owners = np.diff(phrases.owner_off)[which] if len(which) else np.zeros(0, np.int64)
    rows = np.repeat(row_of, owners)
    first = phrases.owner_off[:-1][which] if len(which) else owners
    item = phrases.owners[np.repeat(first - (np.cumsum(owners) - owners), owners) + np.arange(owners.sum())] if len(which) else owners
    pairs = np.unique(np.stack([rows, item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    at_row = np.searchsorted(pairs[:, 0], np.arange(len(off)))
    # spans of touching rows: a span never crosses rows, but two may meet at a row's edge
    for r in range(len(off) - 1):
        a, b = off[r], off[r + 1]
        lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(begin, b, "left")
        spans = [[int(max(x, a) - a), int(min(y, b) - a)] for x, y in zip(begin[lo:hi], end[lo:hi], strict=True) if min(y, b) > max(x, a)]
        yield int(b - a), spans, [phrases.names[i] for i in pairs[at_row[r] : at_row[r + 1], 1]]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """The test set in blocks whose size has been measured before it is fetched."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("id"), "text")
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = 1 + chars // most
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield [(r.id, r.text) for r in block.toLocalIterator()]


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", width: int = PHRASE_WORDS, block_chars: int = BLOCK_CHARS, shard_bytes: int = SHARD_BYTES, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Adds n_words, spans (word offsets) and items to each row."""
    spark = docs.sparkSession
    out, passes = docs, 0
    for items in _blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(Phrases(items, width))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
            for batch in batches:
                for part in pieces(batch, text, shard_bytes):
                    column = part.column(part.schema.get_field_index(text))
                    found = [{"n_words": n, "spans": [{"start": a, "stop": b} for a, b in spans], "items": names} for n, spans, names in _hits(column, phrases, shard_words)]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*part.schema.names, "_found"])

        if passes:
            out = scratch(spark, out, "leaks")
        out = out.mapInArrow(search, T.StructType([*out.schema.fields, T.StructField(f"_found{passes}", _FOUND)]))
        passes += 1
    each = [F.col(f"_found{k}") for k in range(passes)]
    rest = [F.col(f"`{c}`") for c in docs.columns]
    if passes == 1:
        return out.select(*rest, "_found0.n_words", "_found0.spans", "_found0.items")
    spans = F.array_sort(F.concat(*[e["spans"] for e in each]))
    return out.select(*rest, each[0]["n_words"].alias("n_words"), merge_spans(spans).alias("spans"), F.array_distinct(F.concat(*[e["items"] for e in each])).alias("items"))


def merge_spans(spans: Column) -> Column:
    """Union of sorted spans."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(done) > 0) & (s["start"] <= last["stop"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, empty, add)


def flag_documents(docs: DataFrame, benchmark: DataFrame, **options) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their columns renamed c0, c1, ... (second result: which is which) and
    n_words, n_hit, spans, items, contaminated."""
    rows, names = numbered(docs)
    found = find_leaks(rows, benchmark, text=names["text"], **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))), names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, any_hit: bool = False, **options) -> DataFrame:
    """Without contaminated documents, or with ``any_hit`` without all that hold a test phrase."""
    flagged, _ = flag_documents(docs, benchmark, **options)
    return restored(flagged.where(F.col("n_hit") == 0 if any_hit else ~F.col("contaminated")), docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged, names = flag_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return flagged.select(
        F.col(names["doc_id"]).alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, list_slice(w, i, i + least(13, len(w)) - 1) AS phrase
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), s AS (
  SELECT DISTINCT size FROM p
), o AS (
  SELECT rid, i, size, w FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), s WHERE i + size - 1 <= len(w)
), m AS (
  SELECT o.rid, o.i, o.size, p.item FROM o JOIN p ON p.phrase = list_slice(o.w, o.i, o.i + o.size - 1) AND p.size = o.size
), h AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS k FROM m) GROUP BY rid
), t AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
