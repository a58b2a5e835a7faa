"""Connected components of the student-KC graph by hash-to-minimum over distinct edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def student_components(edges: DataFrame) -> DataFrame:
    """(student, label) from edges (student, kc): the smallest student of the component.

    Every round sends each KC the smallest label of its students and back, and also jumps to the
    label's own label, so long chains halve; a round is written out before the next.
    """
    edges = written(edges.distinct(), "edges")
    labels = written(edges.select("student", F.col("student").alias("label")).distinct(), "labels")
    while True:
        by_kc = edges.join(labels, "student").groupBy("kc").agg(F.min("label").alias("label"))
        near = edges.join(by_kc, "kc").groupBy("student").agg(F.min("label").alias("label"))
        jump = near.alias("a").join(near.select(F.col("student").alias("s2"), F.col("label").alias("l2")), F.col("a.label") == F.col("s2"), "left")
        new = written(jump.select("a.student", F.least("a.label", F.coalesce("l2", "a.label")).alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "student").where("label <> old").isEmpty()
        labels = new
        if changed:
            return labels
