"""A seeded synthetic student-step table: attempts drawn from an additive-factors model.

Every number is a function of the seed and of a row's own place, through a hash, so the table is the
same on any cluster and grows by ``spark.range`` without a driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from .steps import TIME


def _uniform(*key: Column) -> Column:
    """A number within [0, 1) that the key decides."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / 4294967296.0


def synthetic_steps(spark: SparkSession, *, students: int = 12, steps: int = 40, topics: int = 4, skills: int = 12, seed: int = 7) -> DataFrame:
    """``students * steps`` rows under the KC models Topics and Skills (skills are parts of topics).

    Step t practises skill ``t % skills`` of topic ``t % topics``, so an opportunity is a quotient.
    Students' abilities lie within (-1, 1), topics' ease within (-1, 1), slopes within (0, 0.3).
    """
    if skills % topics:
        raise ValueError("every skill belongs to one topic: skills must be a multiple of topics")
    at = spark.range(students * steps).select(F.col("id").alias("row_id"), F.floor(F.col("id") / steps).alias("s"), (F.col("id") % steps).alias("t"))
    k, n = F.col("t") % topics, F.floor(F.col("t") / topics)
    tag = F.lit(str(seed))
    z = (2 * _uniform(tag, F.lit("student"), F.col("s")) - 1) + (2 * _uniform(tag, F.lit("ease"), k) - 1) + 0.3 * _uniform(tag, F.lit("slope"), k) * n
    right = _uniform(tag, F.lit("attempt"), F.col("row_id")) < sigmoid(z)
    return at.select(
        "row_id", F.format_string("S%03d", F.col("s")).alias("Anon Student Id"), F.format_string("P%02d", F.floor(F.col("t") / 5)).alias("Problem Name"), F.format_string("step%d", F.col("t") % 5).alias("Step Name"),
        F.when(right, "correct").otherwise("incorrect").alias("First Attempt"), F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("row_id")), "yyyy-MM-dd HH:mm:ss").alias(TIME),
        F.concat(F.lit("topic"), k.cast("string")).alias("KC (Topics)"), (n + 1).cast("string").alias("Opportunity (Topics)"),
        F.concat(F.lit("skill"), (F.col("t") % skills).cast("string")).alias("KC (Skills)"), (F.floor(F.col("t") / skills) + 1).cast("string").alias("Opportunity (Skills)"),
    )
