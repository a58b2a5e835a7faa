"""Practice histories: running counts per student and KC, in practice order.

Order is (time text, row) within a student, or the row alone where there is no time. One shuffle by
(student, kc) serves all counters of that pair. ``running`` keeps to bounded groups even if one key
holds a large part of all rows: with ``ranges`` given, rows are range-partitioned by key and order,
summed within ranges, and range totals are added up - two shuffles, no task with a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

ORDER = ("time", "obs_id")


def exploded(obs: DataFrame) -> DataFrame:
    """A row per observation and KC: obs_id, y, student, item, time, pos, kc, opp."""
    return obs.select("obs_id", "y", "student", "item", "time", F.posexplode("kcs").alias("pos", "k")).select("obs_id", "y", "student", "item", "time", "pos", "k.kc", "k.opp")


def practice_order(obs: DataFrame) -> DataFrame:
    """obs_id and its place (from 0) in the student's practice."""
    place = F.row_number().over(Window.partitionBy("student").orderBy(*ORDER)) - 1
    return obs.select("student", "obs_id", place.cast("long").alias("place"))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], *, ranges: int | None = None) -> DataFrame:
    """Adds for each name the sum of its column over strictly earlier rows of the same keys."""
    if not ranges:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long") for n, c in sums.items()})
    valued = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    part = written(valued.repartitionByRange(ranges, *keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = part.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) for n in sums})
    totals = part.groupBy(*keys, "_p").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*keys, "_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_a_{n}") for n in sums])
    joined = inner.join(ahead, [*keys, "_p"])
    return joined.select(*df.columns, *[(F.col(n) + F.col(f"_a_{n}")).cast("long").alias(n) for n in sums])


def counters(obs: DataFrame, *, inclusive: bool = False, ranges: int | None = None) -> DataFrame:
    """exploded(obs) with ``seen`` (earlier attempts), ``s`` and ``f`` (earlier successes, failures).

    ``inclusive`` adds the current response to s and f: then a row's own label is among its
    predictors.
    """
    rows = exploded(obs)
    out = running(rows, ["student", "kc"], list(ORDER), {"seen": F.lit(1), "s": F.col("y"), "f": 1 - F.col("y")}, ranges=ranges)
    return out.withColumns({"s": F.col("s") + F.col("y"), "f": F.col("f") + 1 - F.col("y")}) if inclusive else out


def recomputed_opportunities(obs: DataFrame, **options) -> DataFrame:
    """Observations with ``kcs`` renumbered: a KC's count of strictly earlier attempts."""
    rows = counters(obs, **options)
    again = F.transform(F.sort_array(F.collect_list(F.struct("pos", "kc", "seen"))), lambda x: F.struct(x["kc"].alias("kc"), x["seen"].alias("opp")))
    made = rows.groupBy("obs_id").agg(again.alias("_kcs"))
    return obs.join(made, "obs_id").withColumn("kcs", F.col("_kcs")).select(*obs.columns)


def opportunity_disagreements(obs: DataFrame) -> DataFrame:
    """obs_id of observations whose counts in the file differ from the recomputed ones."""
    rows = counters(obs)
    return rows.where("opp <> seen").select("obs_id").distinct()


def success_failure_counts(obs: DataFrame, *, inclusive: bool = False) -> DataFrame:
    return counters(obs, inclusive=inclusive).select("obs_id", "pos", "kc", "s", "f")


def pooled_history(obs: DataFrame, *, inclusive: bool = False) -> DataFrame:
    """Per observation the totals of s and f over its KCs."""
    return success_failure_counts(obs, inclusive=inclusive).groupBy("obs_id").agg(F.sum("s").alias("s"), F.sum("f").alias("f"))


def learning_curve(obs: DataFrame) -> DataFrame:
    """Success rate by KC and recomputed opportunity."""
    return counters(obs).groupBy("kc", F.col("seen").alias("opportunity")).agg(F.count("*").alias("n"), F.sum("y").alias("successes"), F.avg("y").alias("success_rate"))
