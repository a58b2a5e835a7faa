"""Mixing sources to target weights (DataFrame functions only).

Each source gets a budget of words: sources in code point order (null last) weigh ``weights`` in
turn and share the total; a budget stops at ``max_epochs`` times the source's size and the excess
goes to the others by weight. That fixed point is a water level, found from running sums over the
sources sorted by cap / weight - no iteration. A document's hash-random key places it within its
source; leading key digits split each source into ranges of bounded size, range totals are summed
into offsets, and a running sum within a range completes the distributed prefix sum. Whole epochs
are taken first, then the prefix up to the exact budget, cutting one document.

The sources themselves (a row each) are ranked and summed in one task.

Defined results: null and empty texts have size 0 and take nothing; a text of any length counts as a whole; null
source is a source of its own; rows without doc_id get their key from the text; equal keys are ordered by
doc_id and a hash of the text, so reruns agree; repeated rows are taken each on its own by ``mix``, and
alike by ``mix_documents``; an empty table gives an empty result; ``mix_documents`` hands further columns,
whatever their names, through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, restored, scratch, table, word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
RANGE_ROWS = 50_000
#: Up to this many sources their cuts are broadcast.
BROADCAST_SOURCES = 100_000


def _key(doc_id: Column, text: Column, seed: str) -> Column:
    """A document's hash-random place among its source's."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def budgets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """From rows (source, size): source, source_size, target. Works on one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = per.withColumn("weight", F.get(cycle, F.pmod(place, F.lit(len(weights))))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = w.withColumn("level", left / share)
    capped = F.col("cap") < F.col("level") * F.col("weight")
    # the first source that stays below its cap sets the level for all after it
    final = F.first(F.when(~capped, F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    return level.withColumn("final", final).select(
        "source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target")
    )


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows doc_id, source, key, text_key, size, source_size, target, taken, epochs, copies (whole ones)."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text"), seed).alias("key"), F.xxhash64("text").alias("text_key"))
    sized = scratch(spark, sized, "mix-sizes")
    digits = 1
    while 16**digits * range_rows < sized.count() and digits < 7:
        digits += 1
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    target = budgets(sized, weights=weights, max_epochs=max_epochs)
    totals = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("_s"), F.col("range").alias("_r"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    target = target.select(F.col("source").alias("_t"), "source_size", "target")
    plan = starts.join(target, F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("within", F.sum("size").over(inside))
    placed = run.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("range") == F.col("_r")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    placed = placed.withColumn("upto", F.col("ahead") + F.col("within")).withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - (F.col("upto") - F.col("size"))))
    return placed.select(
        "doc_id", "source", "key", "text_key", "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
        (F.col("epochs") + F.when((F.col("upto") - F.col("size") < F.col("rest")) & (part * 2 >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )


def mix_documents(docs: DataFrame, *, seed: str = SEED, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it as a whole.

    The one document that a budget cuts is taken whole if at least half of it is within. What a source
    takes is its epochs and the place of its last document taken once more: a row per source, broadcast
    where their number has been measured as small, so texts stay where they are.
    """
    rows, names = numbered(docs)
    id_, text, source = names["doc_id"], names["text"], names["source"]
    decided = mix(docs.select("doc_id", "text", "source"), seed=seed, **options)
    place = F.struct("key", "doc_id", "text_key")
    cuts = decided.groupBy("source").agg(F.max("epochs").alias("_epochs"), F.max(F.when(F.col("copies") > F.col("epochs"), place)).alias("_cut"))
    cuts = scratch(docs.sparkSession, cuts.withColumnRenamed("source", "_source"), "mix-cuts")
    few = cuts.count() <= BROADCAST_SOURCES
    own = F.struct(_key(F.col(id_), F.col(text), seed).alias("key"), F.col(id_).alias("doc_id"), F.xxhash64(text).alias("text_key"))
    joined = rows.join(F.broadcast(cuts) if few else cuts, F.col(source).eqNullSafe(F.col("_source")))
    copies = F.col("_epochs") + F.coalesce((own <= F.col("_cut")).cast("int"), F.lit(0))
    taken = joined.withColumn("_copies", copies).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))))
    return restored(taken, docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CAST(list_value(5, 2, 1)[place % 3 + 1] AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM p
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT min_by(level, cap / weight) FROM l WHERE cap >= level * weight), 1e300)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto,
    CAST(floor(t.target) AS BIGINT) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - (upto - size))) AS BIGINT) AS taken
FROM e
"""
