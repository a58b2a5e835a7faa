"""Token-ID output: ids in blocks coded by an adaptive context-mixing range coder.

*Tokens.* Texts are cut as the tokenizer's own pattern cuts them, many at once over their code points;
the tokenizers library encodes every distinct piece once and a bounded cache keeps its ids. Pieces never
interact in byte-level BPE, so this is the library's encoding of the whole text. A text with characters
on which pattern engines might disagree (outside the plain ranges below), or with an added token's
string, goes to the library whole.

*Blocks.* Whole documents in ascending doc_id order fill a block. A block is coded alone: models
reset, a CRC-32 over its ids. Inside it, lanes of consecutive ids advance in lockstep, each with its
own range coder state, so that every step is a few numpy operations over all lanes. Three predictors
mix: order 2 (the id that last followed these two ids), order 1 (that last followed this id), each
with a confidence, and order 0 (adaptive counts). The mixture weights are counts learned for each
pair of confidences: first the predictor is coded with them, then, for order 0, the id itself.
All arithmetic is on integers, so a block decodes to the same ids on any machine.

*Files.* Blocks are binary rows that Spark's own writer commits (any store, task retries and lost
executors included), one range of doc_ids per file: shard, block, first id's offset in the shard,
number of ids, document table and payload.

Defined results: null text is the empty text (its end id alone); equal doc_ids are ordered by text,
null ones first; a text of any length is one document of one block; an empty table writes no
blocks; further columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import hash_pieces, pieces
from .common import shared_dir, table

END_ID = 0
BLOCK_IDS = 1 << 22
STEPS = 256
CACHE_PIECES = 1_500_000
#: The cache's table has so many bits of slots; a piece is in one of PROBES slots that follow one another.
SLOT_BITS, PROBES = 22, 4
TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"PTB1"
PIECES_AT_ONCE = 500
BATCH_BYTES = 1_500_000
#: Longer texts are cut between two words, where a match begins whatever stands before.
SLICE_CHARS = 1_000_000
_between = re.compile(r"[^\W\d_](?= [^\W\d_])")
#: Characters on which pattern engines agree what is a letter, a digit or white space.
_PLAIN = re.compile(r"[\t\n\r -~¡-©«¬®-±´¶-¸»¿-ȳΑ-ΡΣ-ώА-я‐-‧]*")

_HASH_BITS = 21
_CONF_BITS = 3
_CONF = 1 << _CONF_BITS
#: The next confidence after a miss (first half: half of it) and after a hit (second: one more).
_NEXT = np.concatenate([np.arange(_CONF, dtype=np.int32) >> 1, np.minimum(np.arange(_CONF, dtype=np.int32) + 1, _CONF - 1)])
_ONE = np.uint64(1)
_32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)


_LETTER, _DIGIT, _MARK, _BLANK, _NONE = range(5)


def _kinds() -> np.ndarray:
    """What each code point on which engines agree is to the pattern; others are ``_NONE``."""
    kinds = np.full(1 << 16, _NONE, np.uint8)
    for c in range(0x2030):
        if _PLAIN.fullmatch(x := chr(c)):
            kinds[c] = _BLANK if x.isspace() else _DIGIT if x.isdecimal() else _LETTER if x.isalpha() else _MARK
    return kinds


_KIND = _kinds()
_random = np.random.default_rng(50257)
_POINT = _random.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cut(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in texts of agreed code points, laid end to end.

    Runs of one kind are matches. A blank before another kind joins it if it is a space, a run of blanks
    before another kind gives up its last one, and a contraction ends after its letters.
    """
    n = len(points)
    kind = _KIND[points]
    head = np.zeros(n + 1, bool)
    head[off] = True
    tail, head = head[1:], head[:-1]
    before = np.concatenate([[_NONE], kind[:-1]])
    before[head] = _NONE
    begins = head | (kind != before)
    joined = np.zeros(n, bool)
    joined[1:] = points[:-1] == 32
    joined &= (kind != _BLANK) & (before == _BLANK)
    quote = np.flatnonzero((points == 39) & begins & ~joined)
    begins &= ~joined
    begins[:-1] |= (kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~tail[:-1]
    if len(quote):
        row_end = off[np.searchsorted(off, quote, "right")]
        after = [np.where(quote + k < row_end, points[np.minimum(quote + k, n - 1)], 0) for k in (1, 2)]
        short = np.isin(after[0], [ord(c) for c in "stmd"])
        long = np.isin(after[0] << 16 | after[1], [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])
        for found, size in ((quote[short], 2), (quote[long], 3)):
            begins[found + 1] = False
            stop = found + size
            stop = stop[stop < n]
            begins[stop[(kind[stop] == _LETTER) & ~head[stop]]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Texts to ids with one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.bytes_of = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # a character of a byte-level token stands for a byte
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self._reset()

    def _reset(self) -> None:
        # entry 0 is no piece: slots that hold nothing point to it
        self.slots = np.zeros((1 << SLOT_BITS) + PROBES, np.int32)
        self.keys, self.checks = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.first, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str], sizes: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces laid end to end, and where each piece's begin and how many they are. Lines of
        one text are matches of their own, so many pieces go as one text and its ids are cut by the bytes
        they stand for (``sizes``); ``blank`` pieces go one by one."""
        first, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat: list[np.ndarray] = []
        ahead = 0
        lines = np.flatnonzero(~blank)
        groups = [lines[i : i + PIECES_AT_ONCE] for i in range(0, len(lines), PIECES_AT_ONCE)]
        for group, made in zip(groups, self._whole(["\n".join([pieces[i] for i in g.tolist()]) for g in groups]), strict=True):
            ids = np.array(made, np.int32)
            ends = np.cumsum(self.bytes_of[ids])
            stop = np.cumsum(sizes[group] + 1) - 1
            start = stop - sizes[group]
            last = np.searchsorted(ends, stop)
            begin = np.searchsorted(ends, start, "right")
            if (ends[last] != stop).any() or (np.concatenate([[0], ends])[begin] != start).any():
                raise ValueError("the tokenizer does not cut lines as its pattern says")
            first[group], count[group] = ahead + begin, last + 1 - begin
            flat.append(ids)
            ahead += len(ids)
        spaces = np.flatnonzero(blank).tolist()
        for i, made in zip(spaces, self._whole([pieces[i] for i in spaces]), strict=True):
            first[i], count[i] = ahead, len(made)
            flat.append(np.array(made, np.int32))
            ahead += len(made)
        return np.concatenate(flat), first, count

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, 0 where there is none."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        entry = self.slots.take(slot)
        found = np.where(self.keys.take(entry) == keys, entry, 0)
        for probe in range(1, PROBES):
            left = np.flatnonzero(found == 0)
            if not len(left):
                break
            entry = self.slots.take(slot[left] + probe)
            found[left] = np.where(self.keys.take(entry) == keys[left], entry, 0)
        return found

    def _learn(self, keys: np.ndarray, checks: np.ndarray, pieces: list[str], sizes: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Enter pieces; their entries. One that finds its slots taken is not found again, but learned anew."""
        ids, first, count = self._pieces(pieces, sizes, blank)
        entry = len(self.keys) + np.arange(len(keys))
        self.first, self.size = np.concatenate([self.first, len(self.ids) + first]), np.concatenate([self.size, count])
        self.ids = np.concatenate([self.ids, ids])
        self.keys, self.checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        slot, left = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.arange(len(keys))
        for probe in range(PROBES):
            at = slot[left] + probe
            free = self.slots[at] == 0
            self.slots[at[free]] = entry[left[free]]
            left = left[self.slots[at] != entry[left]]
        return entry

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        if not len(points):
            return [np.zeros(0, np.int32)] * len(texts)
        begin = cut(points, off)
        key = hash_pieces(points, begin, _POINT)
        stop = np.append(begin[1:], len(points))
        check = np.add.reduceat(points, begin, dtype=np.uint64) << np.uint64(24) ^ (stop - begin).astype(np.uint64)
        if len(self.keys) > CACHE_PIECES:
            self._reset()
        slot = self._find(key)
        new = np.flatnonzero(slot == 0)
        if len(new):
            unique, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            at = new[at]
            a, b = begin[at], stop[at]
            sizes = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF))])
            entry = self._learn(unique, check[at], [whole[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], sizes[b] - sizes[a], _KIND[points[b - 1]] == _BLANK)
            slot[new] = entry[back]
        if (self.checks[slot] != check).any():  # two pieces of one 64-bit key
            return [np.array(x, np.int32) for x in self._whole(texts)]
        size = self.size[slot]
        total = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[slot] - (total - size), size) + np.arange(total[-1])]
        ends = np.concatenate([[0], total])[np.searchsorted(begin, off)]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _sliced(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SLICE_CHARS and (m := _between.search(text, at + SLICE_CHARS)):
            yield text[at : m.end()]
            at = m.end()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(texts) == 1 and len(texts[0]) > SLICE_CHARS and _PLAIN.fullmatch(texts[0]) and not self.added(texts[0]):
            return [np.concatenate([self._plain([part])[0] for part in self._sliced(texts[0])])]
        plain = [_PLAIN.fullmatch(t) is not None and not self.added(t) for t in texts]
        odd = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        cut_ = iter(self._plain([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(cut_) if p else np.array(next(odd), np.int32) for p in plain]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per worker process: tasks that reuse the worker find its cache filled."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _followed(ids: np.ndarray, hit: np.ndarray, guess: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """New entries: a hit is surer, a miss less sure, and replaces a guess that is hardly sure."""
    return (np.where(sure < 2, ids, guess) << _CONF_BITS) + _NEXT.take(sure + _CONF * hit)


class Model:
    """The three predictors of one block and their mixture weights, for all lanes of a step."""

    def __init__(self, symbols: int, lanes: int):
        self.counts = np.ones(symbols, np.int64)
        self.total = symbols
        self.edges = np.arange(symbols + 1, dtype=np.int64)
        # an entry is the id that last followed times _CONF plus its confidence
        self.after1 = np.zeros(symbols, np.int32)
        self.after2 = np.zeros(1 << _HASH_BITS, np.int32)
        self.weights = np.tile(np.array([1, 1, 2], np.int64), (2 * _CONF * _CONF, 1))
        self.one = np.zeros(lanes, np.int64)
        self.two = np.zeros(lanes, np.int64)

    def predict(self, lanes: int) -> None:
        """Candidates for the next ids, and the lane's mixture: edges of (order 2, order 1, order 0)."""
        self.one, self.two = self.one[:lanes], self.two[:lanes]
        self.slot = ((self.one * 0x9E3779B1 + self.two * 0x85EBCA6B) >> 7) & ((1 << _HASH_BITS) - 1)
        entry2, entry1 = self.after2.take(self.slot), self.after1.take(self.one)
        self.guess2, self.guess1 = entry2 >> _CONF_BITS, entry1 >> _CONF_BITS
        self.c2, self.c1 = entry2 & (_CONF - 1), entry1 & (_CONF - 1)
        self.state = (self.c2 * _CONF + self.c1) * 2 + (self.guess1 == self.guess2)
        edges = np.cumsum(self.weights, 1).astype(np.uint64)
        self.shares, self.starts, self.totals = self.weights.astype(np.uint64), edges - self.weights.astype(np.uint64), np.ascontiguousarray(edges[:, 2])

    def decide(self, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and total of the chosen predictor's share."""
        self.cell = self.state * 3 + choice
        return self.starts.take(self.cell), self.shares.take(self.cell), self.totals.take(self.state)

    def choice(self, ids: np.ndarray) -> np.ndarray:
        """Which predictor codes each id: 0 order 2, 1 order 1, 2 order 0."""
        return np.where(ids == self.guess2, 0, np.where(ids == self.guess1, 1, 2))

    def update(self, ids: np.ndarray, choice: np.ndarray) -> None:
        cells = np.bincount(self.cell, minlength=self.weights.size).reshape(self.weights.shape)
        self.weights += cells * 2
        big = self.weights.sum(1) > 1 << 15
        self.weights[big] = (self.weights[big] >> 1) + 1
        hit2, hit1 = ids == self.guess2, ids == self.guess1
        self.after2[self.slot] = _followed(ids, hit2, self.guess2, self.c2)
        self.after1[self.one] = _followed(ids, hit1, self.guess1, self.c1)
        rare = ids[choice == 2]
        if len(rare):
            np.add.at(self.counts, rare, 16)
            np.cumsum(self.counts, out=self.edges[1:])
            self.total = int(self.edges[-1])
        self.two, self.one = self.one, ids.astype(np.int64)


def _lanes(n: int) -> tuple[int, int]:
    """Steps, and lanes of the first step; lane i holds ids i*steps ... ; the last may be short."""
    steps = min(STEPS, max(1, n))
    return steps, -(-n // steps)


def compress(ids: np.ndarray, symbols: int) -> bytes:
    n = len(ids)
    steps, lanes = _lanes(n)
    model = Model(symbols, lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out_lane: list[np.ndarray] = []
    out_word: list[np.ndarray] = []

    def code(at: np.ndarray | slice, start: np.ndarray, size: np.ndarray, total: np.ndarray | np.uint64) -> None:
        unit = wide[at] // total
        a = low[at] + unit * start
        b = unit * size
        less = np.flatnonzero(b <= _LOW32)
        if len(less):
            la, lb = a[less], b[less]
            straddles = ((la ^ (la + lb)) >> _32) != 0
            lb = np.where(straddles, (~la + _ONE) & _LOW32, lb)
            lane = np.arange(lanes)[at][less]
            out_lane.append(lane)
            out_word.append((la >> _32).astype(np.uint32))
            a[less], b[less] = la << _32, lb << _32
        low[at], wide[at] = a, b

    grid = np.zeros(steps * lanes, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps
    for step in range(steps):
        active = lanes if step < last else lanes - 1
        if not active:
            break
        x = grid[step, :active]
        model.predict(active)
        choice = model.choice(x)
        code(slice(0, active), *model.decide(choice))
        rare = np.flatnonzero(choice == 2)
        if len(rare):
            r = x[rare]
            code(rare, model.edges[r].astype(np.uint64), model.counts[r].astype(np.uint64), np.uint64(model.total))
        model.update(x, choice)
    # one more word names a number inside each lane's final interval
    out_lane.append(np.arange(lanes))
    out_word.append(((low + _LOW32) >> _32).astype(np.uint32))
    lane = np.concatenate(out_lane)
    word = np.concatenate(out_word)[np.argsort(lane, kind="stable")]
    per = np.bincount(lane, minlength=lanes)
    head = struct.pack("<4sIIII", MAGIC, n, symbols, lanes, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + per.astype("<u2").tobytes() + word.astype("<u4").tobytes()


def decompress(data: bytes) -> np.ndarray:
    magic, n, symbols, lanes, check = struct.unpack_from("<4sIIII", data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    per = np.frombuffer(data, "<u2", lanes, 20).astype(np.int64)
    words = np.append(np.frombuffer(data, "<u4", int(per.sum()), 20 + 2 * lanes), [0, 0]).astype(np.uint64)
    ends = np.cumsum(per)
    at = ends - per

    def take(lane: np.ndarray) -> np.ndarray:
        got = np.where(at[lane] < ends[lane], words[np.minimum(at[lane], len(words) - 1)], np.uint64(0))
        at[lane] += 1
        return got

    every = np.arange(lanes)
    code = take(every) << _32
    code |= take(every)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    steps, _ = _lanes(n)
    model = Model(symbols, lanes)

    def narrow(where: np.ndarray | slice, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        a, b = low[where] + unit * start, unit * size
        less = np.flatnonzero(b <= _LOW32)
        if len(less):
            la, lb = a[less], b[less]
            straddles = ((la ^ (la + lb)) >> _32) != 0
            lb = np.where(straddles, (~la + _ONE) & _LOW32, lb)
            lane = every[where][less]
            code[lane] = (code[lane] << _32) | take(lane)
            a[less], b[less] = la << _32, lb << _32
        low[where], wide[where] = a, b

    grid = np.zeros((steps, lanes), np.int32)
    last = n - (lanes - 1) * steps
    for step in range(steps):
        active = lanes if step < last else lanes - 1
        if not active:
            break
        model.predict(active)
        part = slice(0, active)
        unit = wide[part] // model.totals.take(model.state)
        value = (code[part] - low[part]) // unit
        # starts of the second and third share
        choice = (value >= model.starts[:, 1].take(model.state)).astype(np.int64) + (value >= model.starts[:, 2].take(model.state))
        start, size, _ = model.decide(choice)
        narrow(part, unit, start, size)
        x = np.where(choice == 0, model.guess2, model.guess1)
        rare = np.flatnonzero(choice == 2)
        if len(rare):
            unit = wide[rare] // np.uint64(model.total)
            value = np.minimum((code[rare] - low[rare]) // unit, np.uint64(model.total - 1)).astype(np.int64)
            by = np.argsort(value)
            r = np.empty(len(rare), np.int64)
            r[by] = np.searchsorted(model.edges, value[by], "right") - 1
            x[rare] = r
            narrow(rare, unit, model.edges[r].astype(np.uint64), model.counts[r].astype(np.uint64))
        grid[step, :active] = x
        model.update(x, choice)
    ids = grid.T.reshape(-1)[:n].astype(np.int32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("checksum of a token block does not hold")
    return ids


_BLOCK = "shard int, block int, start long, n_ids long, doc_ids array<long>, doc_sizes array<long>, payload binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Encode (doc_id, text) and write blocks in doc_id order to ``path``."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer)
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        block, start, size = 0, 0, 0
        names = ["shard", "block", "start", "n_ids", "doc_ids", "doc_sizes", "payload"]

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [[shard], [block], [start], [len(ids)], [docs], [[len(h) for h in held]], [compress(ids, encoder.vocabulary)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=names)

        end = np.array([END_ID], np.int32)
        for batch in batches:
            for part in pieces(batch, "text", BATCH_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    held.append(np.concatenate([ids, end]))
                    docs.append(doc)
                    size += len(held[-1])
                    if size >= block_ids:
                        yield flush()
                        block, start, size = block + 1, start + size, 0
                        held.clear()
                        docs = []
        if held:
            yield flush()

    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, _BLOCK).write.parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """Shard totals summed up: (shard, ahead). A row per shard."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    ahead = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(ahead, F.lit(0)).alias("ahead"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode every block: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decompress(row["payload"]).astype("<u4")
                sizes = np.array(row["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - s : e].tobytes()) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(sizes), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64()),
                ], names=["shard", "doc_id", "rel", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(path)
    found = blocks.select("shard", "start", "doc_ids", "doc_sizes", "payload").mapInArrow(run, "shard int, doc_id long, rel long, n_tokens long, ids_crc32 long")
    return found.join(block_starts(blocks), "shard").select("doc_id", (F.col("ahead") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents"))
