"""Language identification: averaged hashed subword embeddings and a linear softmax.

Features are the byte n-grams of a text (A-Z folded, other ASCII non-letters as word breaks), hashed
to ``BUCKETS`` embedding rows. Embeddings and output weights are trained together by stochastic
gradient descent in numpy on a bounded, stratified sample of labelled rows: of each of the ``LANGUAGES``
commonest languages the ``SAMPLE_PER_LANGUAGE`` rows with the smallest hashes, among texts of at most
``SAMPLE_CHARS`` code points. A held-back fifth of the sample sets the softmax temperature and the
score below which an answer counts as rejected. For prediction embeddings times weights are folded
to one row of logits per bucket, so a text costs a gather and a segment sum; the model goes out as
one broadcast of fixed size.

Defined results: null and empty texts and texts without a letter are ``und`` with score 0; a very long text is
read as a whole, its n-grams summed slice by slice; of equal scores the first language in code point order wins; without labelled
rows everything is ``und``; rows without doc_id are predicted but neither learned from nor held
out; repeated rows are predicted each on its own; an empty table gives an empty result; further
columns, whatever their names, pass through ``identify`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import pieces, text_bytes
from .common import numbered, table

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
DIMENSION = 16
SAMPLE_PER_LANGUAGE = 1500
SAMPLE_CHARS = 200_000
LANGUAGES = 1000
#: A text's bytes are looked up so many at a time.
SLICE_BYTES = 1_000_000
EPOCHS = 4
REJECT_ACCURACY = 0.99
UNKNOWN = "und"
_letter = re.compile(r"[^\W\d_]").search

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _ngrams(data: np.ndarray, off: np.ndarray, orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams and the row offsets among them."""
    folded = _FOLD[data].astype(np.uint32)
    for n in orders:
        if len(folded) < n:
            yield np.zeros(0, np.int64), np.zeros(len(off), np.int64)
            continue
        code = np.full(len(folded) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ folded[k : k + len(code)]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        bucket = (code >> np.uint32(16)).astype(np.int64) % BUCKETS
        size = np.maximum(np.diff(off) - n + 1, 0)
        ends = np.cumsum(size)
        at = np.repeat(off[:-1] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        yield bucket[at], np.concatenate([[0], ends])


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def _summed(self, data: np.ndarray) -> np.ndarray:
        """Mean logits of one long text; a slice's n-grams are those that begin in it."""
        total, count = np.zeros(len(self.languages)), 0
        for at in range(0, len(data), SLICE_BYTES):
            for n in ORDERS:
                part = data[at : at + SLICE_BYTES + n - 1]
                for bucket, _ in _ngrams(part, np.array([0, len(part)]), (n,)):
                    total += np.bincount(bucket, minlength=BUCKETS) @ self.logits
                    count += len(bucket)
        return total / max(count, 1)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Softmax scores, a row per text."""
        data, off = text_bytes(column)
        if len(off) == 2 and len(data) > SLICE_BYTES:
            z = self._summed(data) / self.temperature
            e = np.exp(z - z.max())
            return (e / e.sum())[None, :]
        total, count = np.zeros((len(off) - 1, len(self.languages))), np.zeros(len(off) - 1)
        for bucket, at in _ngrams(data, off):
            some = np.flatnonzero(np.diff(at))
            if len(some):
                total[some] += np.add.reduceat(self.logits[bucket], at[:-1][some], axis=0)
            count += np.diff(at)
        z = total / np.maximum(count, 1)[:, None] / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], *, seed: int = 5) -> Model:
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    emb = (rng.random((BUCKETS, DIMENSION)) - 0.5).astype(np.float32) / DIMENSION
    out = np.zeros((DIMENSION, len(languages)), np.float32)
    y = np.array([languages.index(x) for x in labels])
    bags = []
    for t in texts:
        data, off = text_bytes(pa.array([t], pa.large_string()))
        found, n = np.unique(np.concatenate([b for b, _ in _ngrams(data, off)]), return_counts=True)
        bags.append((found, (n / max(1, n.sum())).astype(np.float32)))
    order = rng.permutation(len(texts))
    held = order[: len(order) // 5]
    fit = order[len(order) // 5 :] if len(order) >= 5 else order
    steps, done = max(1, EPOCHS * len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = np.float32(0.5 * (1 - done / steps) + 0.01)
            done += 1
            found, share = bags[i]
            if not len(found):
                continue
            h = share @ emb[found]
            z = h @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            emb[found] -= (rate * len(found) ** 0.5) * share[:, None] * back[None, :]
    model = Model(languages, emb @ out)
    return _calibrate(model, [texts[i] for i in held], y[held]) if len(held) else model


def _calibrate(model: Model, texts: list[str], y: np.ndarray) -> Model:
    """Temperature by likelihood, then the rejection score: above it the wanted share is right."""
    column = pa.array(texts, pa.large_string())
    best = np.inf
    for t in np.geomspace(0.02, 5, 40):
        p = Model(model.languages, model.logits, t).scores(column)[np.arange(len(y)), y]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best:
            best, model.temperature = loss, float(t)
    p = model.scores(column)
    top, right = p.max(1), p.argmax(1) == y
    by = np.argsort(-top)
    share = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    good = np.flatnonzero(share >= REJECT_ACCURACY)
    model.reject_below = float(top[by][good[-1]]) if len(good) else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``per_language`` rows of each language, never of the held-out third."""
    may = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.char_length("text") <= SAMPLE_CHARS) & ~held_out(F.col("doc_id")))
    may = may.select("doc_id", "lang", F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("tie"), "text")
    commonest = may.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # the filter on row_number keeps the smallest of each task before the shuffle; the texts of what is left are fetched
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "tie"))
    chosen = may.drop("text").join(F.broadcast(commonest.select("lang")), "lang").withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = chosen.select("doc_id", "tie", "lang").distinct()  # at most LANGUAGES * per_language rows of a few bytes
    rows = may.select("doc_id", "tie", "lang", "text").join(F.broadcast(chosen), ["doc_id", "tie", "lang"]).distinct().collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.lang))
    return [r.text for r in rows], [r.lang for r in rows]


def identify(docs: DataFrame, model: Model | None) -> tuple[DataFrame, dict[str, str]]:
    """The rows, columns renamed c0, c1, ... (second result), with lang_pred, score, rejected."""
    rows, names = numbered(docs)
    text = names["text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, text, 2_000_000):
                column = part.column(part.schema.get_field_index(text))
                known = np.array([model is not None and t is not None and _letter(t) is not None for t in column.to_pylist()])
                lang, score = [UNKNOWN] * len(known), np.zeros(len(known))
                if known.any():
                    p = model.scores(column)
                    best = p.argmax(1)
                    score = np.where(known, p.max(1), 0.0)
                    lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                rejected = score < (model.reject_below if model else 1.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score), pa.array(rejected)], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added])), names


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts, labels = sample(docs)
    found, names = identify(docs.select("doc_id", "text"), train(texts, labels) if texts else None)
    doc_id = F.col(names["doc_id"])
    return found.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "lang_pred", "score", "rejected")
