"""Quality rules with adaptive thresholds (DataFrame functions only).

Fixed base rules come first (too few words, too many words in repeated five-word windows). What
passes is held against fences that each (language, source) group sets for itself: its values go
into an integer quantile sketch - a bucket keeps the leading ``SIGNIFICANT_BITS`` binary digits of
a value, so sketches of any parts merge by adding counts, in any order, with a relative error below
2**(1 - SIGNIFICANT_BITS) - and a document fails where a value exceeds
``q75 + SPREAD * (q75 - q25) + q75 / 4 + step``, where ``step`` is what a rate that is nought for most of a group
may still reach. Groups of fewer than ``min_group`` documents use the merged sketch of all groups. Metrics
are computed once and written; the fence table is broadcast where its size has been measured as small.

Defined results: null, empty or blank texts have no words and fail the base rule; a very long text is measured
as a whole within its row; a value equal to its fence passes; null lang and source form groups of
their own; repeated rows are judged each on its own; an empty table gives an empty result; further
columns, whatever their names, pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, numbered, scratch, table, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SIGNIFICANT_BITS = 6
SPREAD = 6
#: metric: step in thousandths.
FENCES = {"symbol_rate": 50, "word_length": 0, "dup_line_rate": 350}
MIN_GROUP = 100
#: Up to this many groups their fences are broadcast.
BROADCAST_GROUPS = 100_000


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.floor(a * 1000 / b)).otherwise(0).cast("long")


def cheap_metrics(rows: DataFrame) -> DataFrame:
    """Adds to ``_row, text``: word and symbol counts, line counts and the three rates."""
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE[1:-1]}]")))
    first = rows.withColumns({"_lines": lines}).select(
        "_row", "text", "lang", "source",
        F.inline_outer(F.array(F.struct(words_of(F.col("text")).alias("words"), F.col("_lines").alias("lines")))),
    )
    word_chars = _without(body, SPACE_CHARS).cast("long")
    counted = first.select(
        "_row", "lang", "source", "words",
        F.inline_outer(F.array(F.struct(
            F.size("words").cast("long").alias("n_words"),
            word_chars.alias("word_chars"),
            (F.char_length(body) - _without(body, SYMBOLS)).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        ))),
    )
    return counted.withColumns({
        "symbol_rate": _rate(F.col("n_symbols"), F.col("word_chars")),
        "word_length": _rate(F.col("word_chars"), F.col("n_words")),
        "dup_line_rate": _rate(F.col("n_dup_lines"), F.col("n_lines")),
    })


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside five-word windows that a text holds twice or more."""
    cols = [c for c in rows.columns if c != "words"]
    hashed = F.expr(f"transform(sequence(0, n_words - {WINDOW}), i -> xxhash64({', '.join(f'words[cast(i as int) + {k}]' for k in range(WINDOW))}))")
    none = F.array().cast("array<bigint>")
    wins = rows.select(*cols, F.inline_outer(F.array(F.struct(F.when(F.col("n_words") >= WINDOW, hashed).otherwise(none).alias("_w")))))
    some = F.size(F.array_distinct("_w")) < F.size("_w")
    ranked = F.when(some, F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    sorted_ = wins.select(*cols, F.inline_outer(F.array(F.struct(ranked.alias("_s")))))
    twin = F.expr("filter(transform(_s, (x, k) -> CASE WHEN x.h = get(_s, k - 1).h OR x.h = get(_s, k + 1).h THEN x.i END), p -> p IS NOT NULL)")
    placed = sorted_.select(*cols, F.inline_outer(F.array(F.struct(F.sort_array(twin).alias("_p")))))
    covered = F.expr(f"aggregate(transform(_p, (p, k) -> least({WINDOW}, coalesce(get(_p, k + 1), p + {WINDOW}) - p)), 0L, (a, x) -> a + x)")
    return placed.select(*cols, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def sketch_bucket(v: Column) -> Column:
    """The value with all but its leading binary digits cleared: the sketch's bucket."""
    shift = F.greatest(F.length(F.bin(v)) - SIGNIFICANT_BITS, F.lit(0))
    scale = F.pow(F.lit(2.0), shift).cast("long")
    return v - F.pmod(v, scale)


def fences(metrics: DataFrame, *, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source): the largest value that each metric may have."""
    counted = metrics.where("n_words > 0")
    long = counted.select("lang", "source", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bucket(F.col(m)).alias("bucket")) for m in FENCES])))
    sketches = long.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))

    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "metric")
        at = s.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
        return at.groupBy(*keys, "metric").agg(
            F.min(F.when(F.col("upto") * 4 >= F.col("all"), F.col("bucket"))).alias("q1"),
            F.min(F.when(F.col("upto") * 4 >= F.col("all") * 3, F.col("bucket"))).alias("q3"),
            F.max("all").alias("docs"),
        )

    merged = quartiles(sketches.groupBy("metric", "bucket").agg(F.sum("n").alias("n")), [])
    merged = merged.select("metric", F.col("q1").alias("m1"), F.col("q3").alias("m3"))
    own = quartiles(sketches, ["lang", "source"]).join(F.broadcast(merged), "metric")  # a row per metric
    small = F.col("docs") < min_group
    q1, q3 = F.when(small, F.col("m1")).otherwise(F.col("q1")), F.when(small, F.col("m3")).otherwise(F.col("q3"))
    limit = F.lit(None).cast("long")
    for m, step in FENCES.items():
        limit = F.when(F.col("metric") == m, q3 + SPREAD * (q3 - q1) + F.floor(q3 / 4) + step).otherwise(limit)
    flat = own.select("lang", "source", "metric", limit.alias("limit"))
    return flat.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"max_{m}") for m in FENCES])


def judge(docs: DataFrame, *, carry: list[str] | None = None, min_group: int = MIN_GROUP) -> DataFrame:
    """Rows ``_row`` (a struct of c0, c1, ...: the input's columns, or those named in ``carry``), counts,
    ``base_failed`` and ``kept``."""
    spark = docs.sparkSession
    rows, names = numbered(docs)
    kept = [F.col(names[c]).alias(f"c{i}") for i, c in enumerate(carry)] if carry else [F.col(c) for c in rows.columns]
    rows = rows.select(F.struct(*kept).alias("_row"), *[F.col(names[c]).alias(c) for c in ("text", "lang", "source")])
    full = scratch(spark, with_repeats(cheap_metrics(rows)), "quality")
    limits = scratch(spark, fences(full, min_group=min_group), "fences")
    limits = limits.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[f"max_{m}" for m in FENCES])
    few = limits.count() <= BROADCAST_GROUPS
    joined = full.join(F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    within = F.lit(True)
    for m in FENCES:
        within &= F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def filter_documents(docs: DataFrame, *, min_group: int = MIN_GROUP) -> DataFrame:
    return judge(docs, min_group=min_group).where("kept").select("_row.*").toDF(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs, carry=["doc_id"]).select(
        F.col("_row.c0").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), m AS (
  SELECT rid, doc_id, lang, source, words, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w
), v AS (
  SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_rate,
    CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_rate FROM m
), g AS (
  SELECT rid, unnest(range(1, n_words - 3)) AS i, words FROM v WHERE n_words >= 5
), h AS (
  SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS win FROM g
), t AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM h) WHERE c > 1
), r AS (
  SELECT rid, sum(least(5, nxt - i)) AS n_repeat_words
  FROM (SELECT rid, i, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i), i + 5) AS nxt FROM t) GROUP BY rid
), l AS (
  SELECT lang, source, 'symbol_rate' AS metric, symbol_rate AS x FROM v WHERE n_words > 0
  UNION ALL SELECT lang, source, 'word_length', word_length FROM v WHERE n_words > 0
  UNION ALL SELECT lang, source, 'dup_line_rate', dup_line_rate FROM v WHERE n_words > 0
), k AS (
  SELECT lang, source, metric, x - x % CAST(pow(2, greatest(length(bin(x)) - 6, 0)) AS BIGINT) AS bucket, count(*) AS n FROM l GROUP BY ALL
), q AS (
  SELECT lang, source, metric, min(bucket) FILTER (upto * 4 >= docs) AS q1, min(bucket) FILTER (upto * 4 >= docs * 3) AS q3, max(docs) AS docs
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS docs FROM k)
  GROUP BY ALL
), a AS (
  SELECT metric, min(bucket) FILTER (upto * 4 >= docs) AS m1, min(bucket) FILTER (upto * 4 >= docs * 3) AS m3
  FROM (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY metric) AS docs
        FROM (SELECT metric, bucket, sum(n) AS n FROM k GROUP BY ALL)) GROUP BY metric
), f AS (
  SELECT lang, source, metric,
    CASE WHEN docs < 100 THEN m3 + 6 * (m3 - m1) + m3 // 4 ELSE q3 + 6 * (q3 - q1) + q3 // 4 END
    + CASE metric WHEN 'symbol_rate' THEN 50 WHEN 'word_length' THEN 0 ELSE 350 END AS top FROM q JOIN a USING (metric)
), p AS (
  SELECT lang, source, max(top) FILTER (metric = 'symbol_rate') AS s, max(top) FILTER (metric = 'word_length') AS wl,
    max(top) FILTER (metric = 'dup_line_rate') AS dl FROM f GROUP BY lang, source
), j AS (
  SELECT v.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, s, wl, dl FROM v LEFT JOIN r USING (rid)
  LEFT JOIN p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 10 OR n_repeat_words * 100 > n_words * 20) AS base_failed,
  NOT (n_words < 10 OR n_repeat_words * 100 > n_words * 20)
    AND coalesce(symbol_rate <= s, true) AND coalesce(word_length <= wl, true) AND coalesce(dup_line_rate <= dl, true) AS kept
FROM j
"""
