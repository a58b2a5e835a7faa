"""Blocked, seeded folds. Labels are shuffled on the driver; rows are ranked by a seeded hash where they are."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: The names of the schemes.
SCHEMES = ("item_blocked", "student_blocked", "unstratified", "response_stratified")
CONVENTIONS = ("per_fold", "pooled")
LABEL = {"item_blocked": "item", "student_blocked": "student"}


def label_kfold(counts: list[tuple[str, int]], n_folds: int) -> dict[str, int]:
    """Labels by falling count (ties by name), each to the emptiest fold (ties: the lowest)."""
    heap = [(0, f) for f in range(n_folds)]
    out = {}
    for label, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        size, fold = heapq.heappop(heap)
        out[label] = fold
        heapq.heappush(heap, (size + n, fold))
    return out


def shuffled_labels(labels: list[str], n_folds: int, rng: np.random.Generator) -> dict[str, int]:
    """Labels in order of first appearance, shuffled, cut into spans; the last takes the rest."""
    span = len(labels) // n_folds
    if not span:
        raise ValueError(f"{len(labels)} labels cannot fill {n_folds} folds")
    place = np.arange(len(labels))
    rng.shuffle(place)
    return {labels[at]: min(k // span, n_folds - 1) for k, at in enumerate(place)}


def row_folds(obs: DataFrame, n_folds: int, seed: int, *, stratified: bool) -> DataFrame:
    """(obs_id, fold): rows, or the rows of each class, in the order of a seeded hash and split evenly.

    Ranks are sums over the hash's leading digits (at most 4096 for a class) and counts within them, so no
    task holds more than a 4096th of a class.
    """
    hashed = obs.select("obs_id", (F.col("y") if stratified else F.lit(0)).alias("class"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("obs_id").cast("string"))).alias("h"))
    rows = hashed.withColumn("lead", F.substring("h", 1, 3))
    sizes = rows.groupBy("class", "lead").agg(F.count("*").alias("n"))
    own = Window.partitionBy("class")
    ahead = F.coalesce(F.sum("n").over(own.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("class", "lead", ahead.alias("ahead"), F.sum("n").over(own).alias("all"))
    within = F.row_number().over(Window.partitionBy("class", "lead").orderBy("h", "obs_id"))
    ranked = rows.withColumn("within", within).join(sizes, ["class", "lead"]).withColumn("rank", F.col("ahead") + F.col("within") - 1)
    # the first all % n_folds folds are one larger
    size, larger = F.floor(F.col("all") / n_folds), F.col("all") % n_folds
    early = F.floor(F.col("rank") / (size + 1))
    late = larger + F.floor((F.col("rank") - larger * (size + 1)) / F.greatest(size, F.lit(1)))
    return ranked.select("obs_id", F.when(early < larger, early).otherwise(late).cast("int").alias("fold"))


def make_folds(obs: DataFrame, scheme: str, n_folds: int = 3, seed: int | None = None, convention: str = "per_fold") -> DataFrame:
    """(obs_id, fold). Label schemes join a table of labels; row schemes number the rows."""
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}, got {scheme!r}")
    if convention not in CONVENTIONS:
        raise ValueError(f"convention must be one of {CONVENTIONS}, got {convention!r}")
    spark = obs.sparkSession
    if scheme in LABEL:
        label = LABEL[scheme]
        seen = obs.groupBy(label).agg(F.count("*").alias("n"), F.min("obs_id").alias("first")).toArrow()
        if convention == "per_fold" and seed is None:
            of = label_kfold(list(zip(seen[label].to_pylist(), seen["n"].to_pylist(), strict=True)), n_folds)
        else:
            of = shuffled_labels(seen.sort_by("first")[label].to_pylist(), n_folds, np.random.default_rng(seed or 0))
        table = spark.createDataFrame(pa.table({label: pa.array(of, pa.string()), "fold": pa.array(of.values(), pa.int32())}))
        out = obs.select("obs_id", label).join(table, label).select("obs_id", "fold")
    else:
        # written: ranks are found once for the check and for who asked
        out = written(row_folds(obs, n_folds, seed or 0, stratified=scheme == "response_stratified"), "folds")
    check_folds(out, n_folds)
    return out


def check_folds(folds: DataFrame, n_folds: int) -> None:
    size = {r.fold: r.n for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(size.values())
    for f in range(n_folds):
        test = size.get(f, 0)
        if not test or test == total:
            raise ValueError(f"Fold {f} is degenerate: {total - test} train / {test} test")


def unseen_rows(d, folds: DataFrame) -> DataFrame:
    """(fold, n_test, unseen): test rows that touch a column without a nonzero training cell."""
    cells = d.cells.join(folds, "obs_id").select("obs_id", "block", "col", "fold")
    per = cells.groupBy("block", "col", "fold").agg(F.count("*").alias("n"))
    total = per.groupBy("block", "col").agg(F.sum("n").alias("all"))
    untrained = per.join(total, ["block", "col"]).where("n = all").select("block", "col", "fold")
    hit = cells.join(untrained, ["block", "col", "fold"]).select("obs_id").distinct().withColumn("hit", F.lit(1))
    return folds.join(hit, "obs_id", "left").groupBy("fold").agg(F.count("*").alias("n_test"), F.sum(F.coalesce("hit", F.lit(0))).alias("unseen"))


def same_coverage(a: DataFrame, b: DataFrame) -> bool:
    """Whether two models' observations are the same rows of the export."""
    x, y = a.select("obs_id"), b.select("obs_id")
    return x.join(y.hint("merge"), "obs_id", "left_anti").isEmpty() and y.join(x.hint("merge"), "obs_id", "left_anti").isEmpty()
