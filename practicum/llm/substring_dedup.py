"""Substring dedup by hashing units of text: the earliest occurrence of a passage stays.

Units are lines, cut further at sentence ends (``. ! ?`` before white space, and their full-width forms
anywhere), so that a passage inside a long line is a run of units too. A unit is normalised (A-Z folded,
white space collapsed) and its words are hashed to 128 bits, over the bytes of many texts at once.

Digests are grouped globally; the map-side aggregate reduces a line that a third of all documents share
to one row per task. A digest that occurs twice or more is joined back to the units (a unique table
against all units, so a hot digest's partition can be split by adaptive execution). Of a repeated unit
the occurrence in the smallest doc_id, and there the earliest, stays; the others go where they lie in a
run of adjacent such units of at least ``min_words`` words or ``CHARS_PER_WORD * min_words`` code points: shorter
runs are ordinary sentences that happen to recur. Whatever goes is kept at its first occurrence.

A passage that begins or ends inside a sentence keeps those edges. Defined results: null, empty and
blank texts have no units; a text of any length is cut as a whole; rows of one doc_id, repeated or with
different texts, are one rank, so none of them loses a unit to another of them, but each has its own
spans; rows without doc_id rank last, among themselves by a hash of the text (equal texts are one
occurrence); an empty table gives an empty result; columns of any name pass through ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import NOT_SPACE, hash_runs, hash_words, mix64, pieces, text_bytes, word_starts
from .common import numbered, scratch, table

MIN_WORDS = 20
CHARS_PER_WORD = 10
PIECE_BYTES = 2_000_000
_SEED = np.uint64(0x6A09E667F3BCC909)
_UNITS = "doc_id long, tie long, unit int, start int, stop int, word_from int, word_to int, d1 long, d2 long, again boolean"


def _ends(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a unit: after a line or sentence end, and each row's first."""
    begins = np.zeros(len(data) + 3, bool)
    begins[off[:-1]] = True
    begins[1 : len(data) + 1] |= data == 10
    last = np.zeros(len(data), bool)
    last[off[1:][off[1:] > 0] - 1] = True
    stops = np.flatnonzero((data == 46) | (data == 33) | (data == 63))
    after = data[np.minimum(stops + 1, len(data) - 1)]
    begins[stops[last[stops] | ~NOT_SPACE[after]] + 1] = True
    # full-width full stop, exclamation and question mark in UTF-8
    lead = np.flatnonzero((data[:-2] == 0xE3) | (data[:-2] == 0xEF)) if len(data) > 2 else np.zeros(0, np.int64)
    code = data[lead].astype(np.int64) << 16 | data[lead + 1].astype(np.int64) << 8 | data[lead + 2] if len(lead) else lead
    begins[lead[np.isin(code, (0xE38082, 0xEFBC81, 0xEFBC9F))] + 3] = True
    return begins[: len(data)]


def units(column: pa.Array) -> dict[str, np.ndarray]:
    """The units of all texts of a column: row, unit, start, stop (code points), word_from, word_to,
    d1, d2, and whether the row has the unit earlier (again)."""
    data, off = text_bytes(column)
    inside = NOT_SPACE[data]
    begins = _ends(data, off) if len(data) else np.zeros(0, bool)
    first_byte = begins & inside
    first_byte[word_starts(inside, off)] = True
    starts = np.flatnonzero(first_byte)
    if not len(starts):
        return {k: np.zeros(0, np.int64) for k in ("row", "unit", "start", "stop", "word_from", "word_to", "d1", "d2", "again")}
    words = hash_words(data, inside, starts)
    of = np.cumsum(begins, dtype=np.int32)[starts]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    last = np.append(first[1:], len(starts)) - 1
    begin = starts[first]
    # a word ends where the next byte is white space or begins a word
    final = inside.copy()
    final[:-1] &= ~inside[1:] | first_byte[1:]
    end = np.flatnonzero(final)[last] + 1
    points = np.concatenate([np.zeros(1, np.int32), np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
    row = np.searchsorted(off, begin, "right") - 1
    heads = np.searchsorted(row, np.arange(len(off) - 1))
    word0 = np.searchsorted(starts, off)
    d1, d2 = hash_runs(words, first), hash_runs(mix64(words ^ _SEED), first)
    _, seen = np.unique(d1 ^ mix64(d2 + row.astype(np.uint64)), return_index=True)
    again = np.ones(len(first), bool)
    again[seen] = False
    return {
        "row": row, "unit": np.arange(len(first)) - heads[row], "start": points[begin] - points[off[row]], "stop": points[end] - points[off[row]],
        "word_from": first - word0[row], "word_to": last + 1 - word0[row], "d1": d1.view(np.int64), "d2": d2.view(np.int64), "again": again,
    }


def _cut(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found = units(part.column(2))
                row = pa.array(found.pop("row"), pa.int64())
                small = [pa.array(found[k], pa.int32()) for k in ("unit", "start", "stop", "word_from", "word_to")]
                rest = [pa.array(found["d1"], pa.int64()), pa.array(found["d2"], pa.int64()), pa.array(found["again"], pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *small, *rest], names=["doc_id", "tie", *found])

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(run, _UNITS)


def repeats(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """Every run to remove: doc_id, tie (a hash of the text), start, stop, n_words, first_doc_id (null
    where the first occurrence has none)."""
    spark = docs.sparkSession
    cut = scratch(spark, _cut(docs), "units")
    nameless = F.when(F.col("doc_id").isNull(), F.col("tie"))
    seen = cut.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(nameless).alias("tie_lo"), F.max(nameless).alias("tie_hi"), F.max(F.col("again").cast("int")).alias("within")
    )
    several = F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)) | (F.col("lo").isNotNull() & F.col("tie_lo").isNotNull()) | F.coalesce(F.col("tie_lo") < F.col("tie_hi"), F.lit(False)) | (F.col("within") == 1)
    several = seen.where(several).select("d1", "d2", F.col("lo").alias("first_doc_id"), F.when(F.col("lo").isNull(), F.col("tie_lo")).alias("first_tie"))
    # written, so that both sides of the join are plain shuffles, of which adaptive execution splits a hot digest's
    several = scratch(spark, several, "repeated")
    stays = ~F.col("again") & (F.coalesce(F.col("doc_id") == F.col("first_doc_id"), F.lit(False)) | (F.col("first_doc_id").isNull() & (F.col("tie") == F.col("first_tie"))))
    going = cut.join(several, ["d1", "d2"]).where(~stays)
    # adjacent units have the same difference of number and rank; repeated rows have equal ranks
    own = Window.partitionBy("doc_id", "tie").orderBy("unit")
    runs = going.withColumn("run", F.col("unit") - F.dense_rank().over(own)).groupBy("doc_id", "tie", "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("word_to") - F.min("word_from")).alias("n_words"), F.min_by("first_doc_id", "unit").alias("first_doc_id")
    )
    long = (F.col("n_words") >= min_words) | (F.col("stop") - F.col("start") >= CHARS_PER_WORD * min_words)
    return runs.where(long).select("doc_id", "tie", "start", "stop", "n_words", "first_doc_id")


def remove_repeats(docs: DataFrame, *, removed: str = "removed", **options) -> DataFrame:
    """The documents with repeated runs cut out of their texts, and a column ``removed`` with the spans
    (start, stop) in offsets of the original text; an input column of that name must be told apart
    by naming the new one otherwise (else ValueError)."""
    if removed in docs.columns:
        raise ValueError(f"the input has a column {removed!r}; name the column of spans otherwise")
    rows, names = numbered(docs)
    id_, text = names["doc_id"], names["text"]
    cut = repeats(docs.select("doc_id", "text"), **options)
    spans = cut.groupBy(F.col("doc_id").alias("_d"), F.col("tie").alias("_t")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_removed"))
    joined = rows.join(spans, F.col(id_).eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_t")), "left")
    before = "coalesce(get(_removed, i - 1).stop, 0)"
    kept = F.expr(
        f"CASE WHEN _removed IS NULL THEN {text} ELSE concat(array_join(transform(_removed, (s, i) -> substring({text}, {before} + 1, s.start - {before})), ''), substring({text}, element_at(_removed, -1).stop + 1)) END"
    )
    whole = joined.withColumn(text, kept)
    return whole.select(*[F.col(f"c{i}") for i in range(len(docs.columns))], "_removed").toDF(*docs.columns, removed)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("tie")
