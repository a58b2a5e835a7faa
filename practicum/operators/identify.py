"""Which columns cannot be estimated: dead, duplicate, redundant per component, separated."""

from __future__ import annotations

from collections import Counter

import warnings  # noqa: F401
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.design import ALIASED, Design
from .graph import student_components
from .packed import packed_of
from .solver import fits_one_process

#: The reasons in reports.
DEAD = "column is identically zero (not estimable)"
REDUNDANT = "reference level (student/KC sum redundancy)"


def dead_columns(d: Design) -> DataFrame:
    return d.columns.join(d.cells.select("block", "col").distinct(), ["block", "col"], "left_anti").select("block_no", "block", "col")


def duplicate_columns(d: Design) -> DataFrame:
    """Columns equal to an earlier one of their block: block_no, block, col, first.

    Pre-filter by (count, sum, two hashes of all cells), all mergeable; candidates alone are then
    compared cell by cell, by an anti join in either direction against the first of their group.
    """
    order = d.columns.select("block_no", "block", "col")
    mark = d.cells.groupBy("block", "col").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("obs_id", "value").cast("decimal(38,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(7), "obs_id", "value").cast("decimal(38,0)")).alias("h2")
    )
    w = Window.partitionBy("block", "n", "h1", "h2").orderBy("col")
    pairs = mark.withColumn("first", F.first("col").over(w)).where("col <> first").select("block", "col", "first")
    mine = pairs.join(d.cells, ["block", "col"])
    theirs = d.cells.select("block", F.col("col").alias("first"), "obs_id", "value")
    differ = mine.join(theirs.hint("merge"), ["block", "first", "obs_id", "value"], "left_anti").select("block", "col").distinct()
    return pairs.join(differ, ["block", "col"], "left_anti").join(order, ["block", "col"]).select("block_no", "block", "col", "first")


def labelled_students(d: Design) -> DataFrame | None:
    """(student, component): components of the student-KC graph, numbered by their first student; None without students or KCs."""
    student = d.cells.where("block = 'student'").select("obs_id", F.col("col").alias("student"))
    kc = d.cells.where("block = 'kc_intercept'").select("obs_id", F.col("col").alias("kc"))
    if student.isEmpty() or kc.isEmpty():
        return None
    labels = student_components(student.join(kc.hint("merge"), "obs_id").select("student", "kc"))
    numbered = labels.select("label").distinct().withColumn("component", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))
    return labels.join(numbered, "label").select("student", "component")


def row_components(d: Design) -> DataFrame:
    """(obs_id, component)."""
    labels = labelled_students(d)
    if labels is None:
        return d.obs.select("obs_id", F.lit(0).cast("long").alias("component"))
    student = d.cells.where("block = 'student'").select("obs_id", F.col("col").alias("student"))
    return student.join(labels, "student").select("obs_id", "component")


def reference_levels(d: Design) -> DataFrame:
    """Per redundant component the last live student: component, col, n_components (redundant ones).

    A component is redundant where student columns sum to one and KC columns to the same positive
    number in each of its rows. Rows are summed up by student before components come in.
    """
    labels = labelled_students(d)
    if labels is None:
        return d.obs.sparkSession.createDataFrame([], "component long, col string, n_components long")
    of = lambda block: F.coalesce(F.sum(F.when(F.col("block") == block, F.col("value"))), F.lit(0.0))
    sums = d.cells.where("block IN ('student', 'kc_intercept')").groupBy("obs_id").agg(of("kc_intercept").alias("k"), of("student").alias("s"))
    rows = d.cells.where("block = 'student'").select("obs_id", F.col("col").alias("student")).join(sums.hint("merge"), "obs_id")
    per = rows.groupBy("student").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("s").alias("slo"), F.max("s").alias("shi")).join(labels, "student")
    ok = per.groupBy("component").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("slo").alias("slo"), F.max("shi").alias("shi"), F.max("student").alias("col"))
    last = ok.where("lo > 0 AND abs(hi - lo) <= 1e-9 AND abs(slo - 1) <= 1e-9 AND abs(shi - 1) <= 1e-9")
    n = labels.agg(F.countDistinct("component").alias("n_components"))
    return last.join(F.broadcast(n)).select("component", "col", "n_components")  # one number


def identify(d: Design, *, check: bool = True) -> Design:
    """Drop what cannot be estimated, in the order dead, duplicate, reference; then check the rank."""
    dead = [(r.block_no, r.block, r.col, DEAD) for r in dead_columns(d).orderBy("block_no", "col").collect()]
    same = [(r.block_no, r.block, r.col, f"duplicate of {r.block}:{r.first}") for r in duplicate_columns(d).orderBy("block_no", "col").collect()]
    spark = d.obs.sparkSession
    kept = d.without(spark.createDataFrame([(b, c) for _, b, c, _ in dead + same], "block string, col string"))
    refs = reference_levels(kept).orderBy("component").collect()
    several = bool(refs) and refs[0].n_components > 1
    last = [(0, "student", r.col, REDUNDANT + (f", component {r.component + 1} of {r.n_components}" if several else "")) for r in refs]
    kept = kept.without(spark.createDataFrame([(b, c) for _, b, c, _ in last], "block string, col string"))
    rows = [(i, f"{b}:{c}", why) for i, (_, b, c, why) in enumerate(dead + same + last)]
    old = d.aliased_rows()
    rows = [(i, c, w) for i, (c, w) in enumerate(old + [(c, w) for _, c, w in rows])]
    out = replace(kept, aliased=spark.createDataFrame(rows, ALIASED))
    if check and (r := rank(out)) < (p := out.n_params):
        raise ValueError(f"design is rank-deficient after identification: rank {r} of {p} columns")
    return out


def gram(d: Design, weights: DataFrame | None = None) -> DataFrame:
    """Cells (i, j, value) of X'X, upper triangle; ``weights`` (obs_id, weight) gives X'WX."""
    cells = d.cells.join(d.indexed().select("block", "col", "col_idx"), ["block", "col"]).select("obs_id", "col_idx", "value")
    left = cells.select("obs_id", F.col("col_idx").alias("i"), F.col("value").alias("a"))
    right = cells.select("obs_id", F.col("col_idx").alias("j"), F.col("value").alias("b"))
    pairs = left.join(right.hint("merge"), "obs_id").where("i <= j")
    if weights is not None:
        return pairs.join(weights, "obs_id").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b") * F.col("weight")).alias("value"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def symmetric(rows: list, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def rank(d: Design) -> int:
    """Rank by the eigenvalues of the Gram matrix of unit-length columns.

    Beyond one process the columns of the wide block are taken out first, which leaves the narrow ones' matrix.
    """
    p, n = d.n_params, d.n_obs
    if not p:
        return 0
    if not fits_one_process(d):
        return packed_of(d).rank()
    g = symmetric(gram(d).collect(), p)
    size = np.sqrt(np.diag(g))
    size[size == 0] = 1.0
    values = np.linalg.eigvalsh(g / np.outer(size, size))
    return int((values > max(n, p) * np.finfo(float).eps * values[-1]).sum())


def separated(d: Design) -> DataFrame:
    """block_no, block, col, direction (+1, -1) of columns without a finite estimate.

    Unpenalised, of one sign, touching successes only or failures only, and not held by a bound in
    the direction of divergence. One grouped aggregate.
    """
    y = d.obs.select("obs_id", "y")
    per = d.cells.join(y.hint("merge"), "obs_id").groupBy("block", "col").agg(F.count("*").alias("n"), F.sum("y").alias("ok"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    side = F.when(F.col("ok") == F.col("n"), 1).when(F.col("ok") == 0, -1).otherwise(0)
    sign = F.when(F.col("lo") > 0, 1).when(F.col("hi") < 0, -1).otherwise(0)
    out = d.columns.join(per, ["block", "col"]).withColumn("direction", (side * sign).cast("int"))
    free = ((F.col("direction") > 0) & (F.col("upper") == float("inf"))) | ((F.col("direction") < 0) & (F.col("lower") == float("-inf")))
    return out.where((F.col("l2") <= 0) & free).select("block_no", "block", "col", "direction")


def tally(columns: list[str]) -> str:
    """``block:col`` names as counts of their blocks, in order of the blocks' names."""
    return listed(Counter(c.split(":", 1)[0] for c in columns))


def listed(found: dict[str, int]) -> str:
    return ", ".join(f"{block} {found[block]}" for block in sorted(found))
