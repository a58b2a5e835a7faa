"""Cross-validation: one Spark job over all (model, seed, fold), scored and contrasted in SQL."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import solver
from ..operators.folds import CONVENTIONS, make_folds, same_coverage
from ..operators.packed import Job, Packed
from ..session import written
from .design import Design

RESULT = "model string, seed long, fold int, n_train long, n_test long, rmse double, sse double, unseen_column_fraction double, converged boolean, is_optimal boolean"


def score_fold(local: solver.Local, l2: np.ndarray, lower: np.ndarray, upper: np.ndarray, test: np.ndarray, max_iter: int) -> dict:
    """Fit on the complement of ``test`` (row numbers), score on it."""
    rest = np.ones(local.n, bool)
    rest[test] = False
    train, held = local.subset(np.flatnonzero(rest)), local.subset(test)
    seen = np.bincount(train.col, minlength=local.p) > 0
    s = solver.solve(train, l2, lower, upper, max_iter=max_iter)
    w = np.where(seen | (l2 > 0), s.weights, 0.0)
    sse = float(((held.y - solver.expit(held.predict(w))) ** 2).sum())
    unseen = np.bincount(held.row, ~seen[held.col], minlength=held.n) > 0
    inside = (w > lower + 1e-9) & (w < upper - 1e-9) & seen
    worst = float(np.abs(s.gradient[inside]).max()) if inside.any() else 0.0
    return {"n_train": train.n, "n_test": held.n, "rmse": float(np.sqrt(sse / held.n)), "sse": sse, "unseen_column_fraction": float(unseen.mean()), "converged": s.converged, "is_optimal": worst < 3e-3 * np.sqrt(train.n)}


def _packed(designs: dict[str, Design], scheme: str, n_folds: int, seeds: list, convention: str, max_iter: int) -> DataFrame:
    """All fits of a design in step with one another: a pass over its packed rows serves them all."""
    first, out = next(iter(designs.values())), {}
    for d in designs.values():
        if not same_coverage(first.obs, d.obs):
            raise ValueError(f"paired folds need the same rows in all designs; found {first.obs.count()} and {d.obs.count()}")
    folds = tuple(written(make_folds(first.obs, scheme, n_folds, seed, convention), "folds") for seed in seeds)
    fits = [(k, f) for k in range(len(seeds)) for f in range(n_folds)]
    for m, d in designs.items():
        for (k, f), scores in zip(fits, Packed(d, folds).scored([Job(k, f) for k, f in fits], max_iter), strict=True):
            out[k, f, m] = scores
    return first.obs.sparkSession.createDataFrame([(m, seeds[k], f, *out[k, f, m].values()) for k, f in fits for m in designs], RESULT)


def paired_cross_validate(designs: dict[str, Design], *, scheme: str = "item_blocked", n_folds: int = 3, seeds: Iterable[int | None] = (0,), convention: str = "pooled", max_iter: int = 100, n_jobs: int | None = None) -> DataFrame:
    """A row per (seed, fold, model); all models are scored on the same folds.

    Designs that fit one process go out once, as broadcast arrays, and the fits are tasks. Where one
    does not, all fits of a design take their steps together, over its packed rows.
    ``n_jobs`` is the number of partitions: None or 0 one, -1 as many as there are fits.
    """
    if convention not in CONVENTIONS:
        raise ValueError(f"unknown convention {convention!r}; there are {CONVENTIONS}")
    seeds, designs = list(seeds), {name: d.kept() for name, d in designs.items()}
    first = next(iter(designs.values()))
    spark, arrays, ids = first.obs.sparkSession, {}, None
    if not all(solver.fits_one_process(d) for d in designs.values()):
        return _packed(designs, scheme, n_folds, seeds, convention, max_iter)
    for name, d in designs.items():
        local, rows = solver.local_of(d)
        if ids is not None and not np.array_equal(rows, ids):
            raise ValueError(f"paired folds need the same rows in all designs; found {len(ids)} and {len(rows)}")
        ids = rows
        c = d.indexed().orderBy("col_idx").collect()
        arrays[name] = (local, *(np.array([r[k] for r in c], float) for k in ("l2", "lower", "upper")))
    shared = spark.sparkContext.broadcast(arrays)
    place = ids

    def fold_of_rows(seed: int | None) -> np.ndarray:
        """Folds in row order, as one Arrow table of at most as many rows as the designs' arrays have."""
        found = make_folds(first.obs, scheme, n_folds, seed, convention).toArrow()
        out = np.empty(len(place), np.int32)
        out[np.searchsorted(place, found["obs_id"].to_numpy())] = found["fold"].to_numpy()
        return out

    table = spark.sparkContext.broadcast({s: fold_of_rows(s) for s in seeds})
    jobs = [(k, m, s, f) for k, (s, f, m) in enumerate((s, f, m) for s in seeds for f in range(n_folds) for m in designs)]
    tasks = spark.createDataFrame(jobs, "job int, model string, seed long, fold int")
    parts = 1 if not n_jobs else len(jobs) if n_jobs < 0 else min(n_jobs, len(jobs))

    def run(job: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in job.itertuples(index=False):
            seed = None if pd.isna(r.seed) else int(r.seed)
            local, l2, lower, upper = shared.value[r.model]
            test = np.flatnonzero(table.value[seed] == r.fold)
            out.append({"model": r.model, "seed": seed, "fold": r.fold, **score_fold(local, l2, lower, upper, test, max_iter)})
        return pd.DataFrame(out).astype({"seed": "Int64"})

    return tasks.repartition(parts, "job").groupBy("job").applyInPandas(run, RESULT)


@dataclass
class CVResult:
    frame: DataFrame
    rmse: float
    scheme: str
    convention: str

    def summary(self) -> str:
        r = self.frame.agg(F.avg("unseen_column_fraction").alias("u"), F.count_if(~F.col("converged")).alias("bad"), F.count("*").alias("n")).first()
        return f"{r.n}-fold {self.scheme} ({self.convention}) RMSE = {self.rmse:.4f} | {r.u:.1%} of held-out rows hit an unseen column" + (f" | {r.bad} fold(s) did not converge" if r.bad else "")


def combined_rmse(convention: str):
    return F.avg("rmse") if convention == "per_fold" else F.sqrt(F.sum("sse") / F.sum("n_test"))


def cross_validate(design: Design, *, scheme: str = "item_blocked", n_folds: int = 3, seed: int | None = None, convention: str = "per_fold", **options) -> CVResult:
    rows = paired_cross_validate({"model": design}, scheme=scheme, n_folds=n_folds, seeds=(seed,), convention=convention, **options).drop("model")
    kept = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    return CVResult(kept.orderBy("fold"), kept.agg(combined_rmse(convention).alias("r")).first().r, scheme, convention)


def repeated_cross_validate(design: Design, *, seeds: Iterable[int], convention: str = "per_fold", **options) -> DataFrame:
    """One row per seed."""
    rows = paired_cross_validate({"model": design}, seeds=seeds, convention=convention, **options)
    return rows.groupBy("seed").agg(combined_rmse(convention).alias("rmse"), F.avg("unseen_column_fraction").alias("unseen_column_fraction"), F.bool_and("converged").alias("all_converged"))


def paired_scores(folds: DataFrame, convention: str = "pooled") -> DataFrame:
    if convention not in CONVENTIONS:
        raise ValueError(f"unknown convention {convention!r}; there are {CONVENTIONS}")
    return folds.groupBy("model", "seed").agg(combined_rmse(convention).alias("rmse"), F.avg("unseen_column_fraction").alias("unseen_column_fraction"), F.bool_and("converged").alias("all_converged"))


def paired_contrasts(folds: DataFrame, baseline: str) -> DataFrame:
    """Per model the mean within-fold difference in rmse to the baseline, sd, folds, folds better."""
    models = [r.model for r in folds.select("model").distinct().orderBy("model").collect()]
    if baseline not in models:
        raise KeyError(f"baseline {baseline!r} not among {models}")
    base = folds.where(F.col("model") == baseline).select("seed", "fold", F.col("rmse").alias("base"))
    both = folds.where(F.col("model") != baseline).join(base, (folds["seed"].eqNullSafe(base["seed"])) & (folds["fold"] == base["fold"])).select("model", (F.col("rmse") - F.col("base")).alias("diff"))
    return both.groupBy("model").agg(F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd_diff"), F.count("diff").alias("n_folds"), F.count_if(F.col("diff") < 0).alias("folds_better")).withColumn("baseline", F.lit(baseline)).orderBy("mean_diff")


def default_baseline(scores: DataFrame) -> str:
    best = scores.groupBy("model").agg(F.avg("rmse").alias("rmse")).orderBy("rmse", "model").first()
    return best.model
