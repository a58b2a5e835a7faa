"""Fits of designs beyond one process, from blocks of whole observations.

The design's cells are dealt out once as Parquet rows that hold some ten thousand observations each, as
arrays; a pass over them sums for any number of fits. The block with the most columns (students, say) is
``wide`` if no observation has two of its cells: given the other weights, each of its columns is then a
problem of one number, solved where its rows are. So Newton steps are taken over the narrow columns
alone, with the Schur complement of the wide ones as Hessian, and neither a wide column's weight nor a cell
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import solver

#: Columns up to which a block is never wide; observations of a packed row; numbers of its table of groups by columns.
NARROW, ROWS, TABLE = 300, 50_000, 4_000_000
#: Bytes of sums that tasks may send to the driver in one pass; above, they are added up first.
SENT = 64 << 20
#: Shares of a column's own curvature below which a direction counts as flat.
FLAT = 1e-11
ARRAYS = (("y", np.uint8), ("size", np.int32), ("idx", np.int32), ("value", np.float64), ("grp", np.int32), ("gvalue", np.float64), ("folds", np.int16))
BLOCKS = ", ".join(f"{name} binary" for name, _ in ARRAYS) + ", names array<string>"
SUMS = "job int, numbers binary"


@dataclass
class Block:
    """Some observations with all their cells; ``grp`` is the place of the wide column, -1 for none."""

    local: solver.Local
    grp: np.ndarray
    gvalue: np.ndarray
    folds: np.ndarray
    groups: int
    names: list[str] | None


def packed_rows(batches: Iterator[pa.RecordBatch], k: int, n_seeds: int) -> Iterator[pa.RecordBatch]:
    """Observations in the order of their groups, as rows of whole groups."""
    schema = pa.schema([*(pa.field(name, pa.binary()) for name, _ in ARRAYS), pa.field("names", pa.list_(pa.string()))])
    most = max(1, TABLE // max(k, 1))

    def row(t: pa.Table) -> pa.RecordBatch:
        lists, grp = t["cells"].combine_chunks(), t["grp"].combine_chunks().dictionary_encode()
        if isinstance(lists, pa.ChunkedArray):
            lists, grp = lists.chunk(0), grp.chunk(0)
        cells = lists.flatten()
        arrays = {
            "y": t["y"].to_numpy(), "size": lists.value_lengths().to_numpy(zero_copy_only=False), "idx": cells.field("idx").to_numpy(zero_copy_only=False), "value": cells.field("value").to_numpy(zero_copy_only=False),
            "grp": grp.indices.fill_null(-1).to_numpy(zero_copy_only=False), "gvalue": t["gvalue"].to_numpy(),
            "folds": np.array([t[f"fold{s}"].to_numpy() for s in range(n_seeds)]),
        }
        return pa.RecordBatch.from_arrays([*(pa.array([arrays[name].astype(kind).tobytes()], pa.binary()) for name, kind in ARRAYS), pa.array([grp.dictionary.to_pylist()], pa.list_(pa.string()))], schema=schema)

    kept: list[pa.Table] = []
    held = 0

    def cut(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal kept, held
        t = pa.concat_tables(kept).combine_chunks()
        names = t["grp"].to_numpy()
        change = np.flatnonzero(names[1:] != names[:-1]) + 1 if len(names) else np.zeros(0, int)
        ends, start = [*change.tolist(), *([t.num_rows] if last else [])], 0
        n_groups, at = 0, 0
        # rows without a group may part anywhere
        loose = [i for i in range(ROWS, int(change[0]) if len(change) else t.num_rows, ROWS)] if t.num_rows and names[0] is None else []
        for end in [*loose, *ends]:
            n_groups += 1
            if end - start >= ROWS or n_groups >= most:
                yield row(t.slice(start, end - start))
                start, n_groups = end, 0
            at = end
        if last and at > start:
            yield row(t.slice(start, at - start))
            start = at
        kept, held = ([t.slice(start)], t.num_rows - start) if start < t.num_rows else ([], 0)

    goal = ROWS
    for batch in batches:
        kept.append(pa.Table.from_batches([batch]))
        held += batch.num_rows
        if held >= goal:
            yield from cut(False)
            goal = ROWS + 2 * held  # a long group is not gone through again for every batch
    if held:
        yield from cut(True)


def blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Block]:
    for batch in batches:
        names = batch.column("names") if "names" in batch.schema.names else None
        for i in range(batch.num_rows):
            a = {name: np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in ARRAYS}
            n = len(a["y"])
            local = solver.Local(n, k, np.repeat(np.arange(n), a["size"]), a["idx"].astype(np.int64), a["value"], a["y"].astype(float))
            grp = a["grp"].astype(np.int64)
            yield Block(local, grp, a["gvalue"], a["folds"].reshape(-1, n), int(grp.max(initial=-1)) + 1, names[i].as_py() if names is not None else None)


def roots(z: np.ndarray, y: np.ndarray, v: np.ndarray, g: np.ndarray, groups: int, l2: float) -> np.ndarray:
    """For each group the t that minimises the sum of losses at z + v t, plus l2 / 2 t**2; 0 without rows.

    Newton steps that never leave the bracket which the slopes' signs have shown. Where all outcomes of a group
    agree, t runs off until the slope is below 1e-9.
    """
    t, low, high = np.zeros(groups), np.full(groups, -np.inf), np.full(groups, np.inf)
    enough = np.maximum(1e-9, 1e-13 * np.bincount(g, minlength=groups))
    done = np.bincount(g, minlength=groups) == 0
    for _ in range(200):
        prob = solver.expit(z + v * t[g])
        slope = np.bincount(g, v * (prob - y), groups) + l2 * t
        done |= np.abs(slope) <= enough
        if done.all():
            break
        bend = np.bincount(g, v * v * prob * (1 - prob), groups) + l2
        low, high = np.where(slope < 0, t, low), np.where(slope > 0, t, high)
        with np.errstate(all="ignore"):
            new = t + np.clip(np.nan_to_num(-slope / bend, posinf=4.0, neginf=-4.0), -4, 4)
            new = np.where((new <= low) | (new >= high), (low + high) / 2, new)
        moved = ~done & np.isfinite(new) & (new != t)
        t = np.where(moved, new, t)
        done |= ~moved
        left = ~done[g]
        if left.sum() < 0.6 * len(g):
            z, y, v, g = z[left], y[left], v[left], g[left]
    return t


@dataclass
class At:
    """A block at given weights, over its training rows."""

    b: Block
    train: np.ndarray
    own: np.ndarray
    t: np.ndarray
    z: np.ndarray

    @property
    def prob(self) -> np.ndarray:
        return solver.expit(self.z)

    def table(self, curve: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the wide columns, with weights of rows: their curvature, and that with the narrow ones."""
        b, x = self.b, self.b.local
        d = np.bincount(b.grp[self.own], (curve * b.gvalue * b.gvalue)[self.own], b.groups) + l2
        grouped = self.own[x.row]
        row = x.row[grouped]
        both = np.bincount(b.grp[row] * x.p + x.col[grouped], x.value[grouped] * (curve * b.gvalue)[row], b.groups * x.p).reshape(b.groups, x.p)
        return d, both


def at(b: Block, w: np.ndarray, l2: float, train: np.ndarray) -> At:
    own = train & (b.grp >= 0)
    z = b.local.predict(w)
    t = roots(z[own], b.local.y[own], b.gvalue[own], b.grp[own], b.groups, l2)
    if b.groups:
        z = z + np.where(b.grp >= 0, b.gvalue * t[b.grp], 0.0)
    return At(b, train, own, t, z)


def reduced(a: At, curve: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hessian of the narrow columns less what the wide ones take up, its diagonal before, and ``At.table``."""
    h = a.b.local.curvature(curve)
    size = np.diag(h).copy()
    d, both = a.table(curve, l2)
    live = d > 0
    return h - (both[live] / d[live, None]).T @ both[live], size, d, both


def _sums(a: At, l2: float) -> np.ndarray:
    x, p = a.b.local, a.prob
    r = np.where(a.train, p - x.y, 0.0)
    loss = float(np.where(a.train, np.logaddexp(0, a.z) - x.y * a.z, 0.0).sum()) + l2 / 2 * float((a.t**2).sum())
    h, size, _, _ = reduced(a, np.where(a.train, p * (1 - p), 0.0), l2)
    return np.concatenate([[loss], np.bincount(x.col, x.value * r[x.row], x.p), size, h.ravel()])


def _gram(a: At, l2: float) -> np.ndarray:
    h, size, d, _ = reduced(a, a.train.astype(float), l2)
    live = int((np.bincount(a.b.grp[a.own], minlength=a.b.groups) > 0).sum()) if a.b.groups else 0
    return np.concatenate([[a.train.sum(), live], size, h.ravel()])


def _along(a: At, l2: float, flat: np.ndarray) -> np.ndarray:
    """Of the flat directions (columns of ``flat``): their wide parts' products, and those with the wide weights."""
    _, _, d, both = reduced(a, a.train.astype(float), l2)
    live = d > 0
    u = -(both[live] @ flat) / d[live, None]
    return np.concatenate([(u.T @ u).ravel(), u.T @ a.t[live]])


def _steepest(a: At, l2: float) -> float:
    """The largest slope along a wide column that has training rows."""
    g = np.bincount(a.b.grp[a.own], (a.b.gvalue * (a.prob - a.b.local.y))[a.own], a.b.groups) + l2 * a.t
    return float(np.abs(g).max(initial=0.0))


def _score(a: At, l2: float, seen: np.ndarray) -> np.ndarray:
    x, test = a.b.local, ~a.train
    sse = float(((x.y - a.prob) ** 2)[test].sum())
    unseen = np.bincount(x.row, ~seen[x.col], minlength=x.n) > 0
    if a.b.groups:
        known = np.bincount(a.b.grp[a.own], minlength=a.b.groups) > 0
        unseen |= (a.b.grp >= 0) & ~known[a.b.grp]
    return np.array([a.train.sum(), test.sum(), sse, (unseen & test).sum(), _steepest(a, l2)])


@dataclass
class Job:
    """A fit: all observations, or those outside a fold of a seed (by its place)."""

    seed: int | None = None
    fold: int = 0

    def train(self, b: Block) -> np.ndarray:
        return np.ones(b.local.n, bool) if self.seed is None else b.folds[self.seed] != self.fold


class Packed:
    def __init__(self, design, folds: tuple[DataFrame, ...] = ()) -> None:
        self.design, self.spark = design, design.obs.sparkSession
        kinds = design.columns.groupBy("block_no", "block").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in ("l2", "lower", "upper") for n, f in (("min", F.min), ("max", F.max))]).orderBy("block_no").collect()
        self.n_params = sum(r.n for r in kinds)
        free = [r for r in kinds if r.n > NARROW and r.l2_min == r.l2_max and r.lower_max == -math.inf and r.upper_min == math.inf]
        self.wide, self.wide_l2 = None, 0.0
        for r in sorted(free, key=lambda r: -r.n):
            if design.cells.where(F.col("block") == r.block).groupBy("obs_id").count().where("count > 1").isEmpty():
                self.wide, self.wide_l2 = r.block, float(r.l2_min)
                break
        self.narrow = [r for r in design.columns.where(~F.col("block").eqNullSafe(F.lit(self.wide))).orderBy("block_no", "col").collect()]
        self.k = len(self.narrow)
        self.l2, self.lower, self.upper = (np.array([r[c] for r in self.narrow], float) for c in ("l2", "lower", "upper"))
        self.rows = written(self._dealt(folds), "packed")
        self.tasks = max(1, len(self.rows.inputFiles()))

    def _dealt(self, folds: tuple[DataFrame, ...]) -> DataFrame:
        d, k, n_seeds = self.design, self.k, len(folds)
        index = self.spark.createDataFrame([(r.block, r.col, i) for i, r in enumerate(self.narrow)], "block string, col string, idx int")
        parts = [
            d.obs.select("obs_id", F.col("y").cast("int").alias("y")),
            d.cells.join(F.broadcast(index), ["block", "col"]).select("obs_id", F.struct("idx", "value").alias("cell")),
            *[f.select("obs_id", F.col("fold").alias(f"fold{s}")) for s, f in enumerate(folds)],
        ]
        if self.wide is not None:
            named = d.columns.where(F.col("block") == self.wide).select("col").distinct()
            parts.append(d.cells.where(F.col("block") == self.wide).join(named, "col", "left_semi").select("obs_id", F.col("col").alias("grp"), F.col("value").alias("gvalue")))
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part, allowMissingColumns=True)
        wide = [F.max("grp").alias("grp"), F.max("gvalue").alias("gvalue")] if self.wide is not None else [F.max(F.lit(None).cast("string")).alias("grp"), F.max(F.lit(None).cast("double")).alias("gvalue")]
        rows = both.groupBy("obs_id").agg(F.max("y").alias("y"), F.collect_list("cell").alias("cells"), *wide, *[F.max(f"fold{s}").alias(f"fold{s}") for s in range(n_seeds)])
        rows = rows.where("y IS NOT NULL").withColumns({"gvalue": F.coalesce("gvalue", F.lit(0.0)), **{f"fold{s}": F.coalesce(f"fold{s}", F.lit(-1)) for s in range(n_seeds)}})
        if self.wide is not None:
            # groups stay whole; rows without one go anywhere
            place = F.when(F.col("grp").isNull(), F.xxhash64("obs_id")).otherwise(F.xxhash64("grp"))
            n = min(2 * self.spark.sparkContext.defaultParallelism, d.n_obs // 5000 + 1)
            rows = rows.repartition(max(n, d.n_obs // (4 * ROWS) + 1), place).sortWithinPartitions("grp")
        return rows.drop("obs_id").mapInArrow(lambda batches: packed_rows(batches, k, n_seeds), BLOCKS)

    def passed(self, jobs: list[Job], weights: list[np.ndarray], each: Callable[..., np.ndarray], *given: list, most: frozenset | set = frozenset()) -> list[np.ndarray]:
        """For each job the sum over all blocks of ``each(at, l2, *given of the job)``; places ``most`` are maxima."""
        k, l2, top = self.k, self.wide_l2, sorted(most)
        args = list(zip(jobs, weights, *given, strict=True))

        def add(total: np.ndarray | None, x: np.ndarray) -> np.ndarray:
            if total is None:
                return x.copy()
            out = total + x
            out[top] = np.maximum(total[top], x[top])
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray | None] = [None] * len(args)
            for b in blocks(batches, k):
                for i, (job, w, *more) in enumerate(args):
                    total[i] = add(total[i], each(at(b, w, l2, job.train(b)), l2, *more))
            for i, x in enumerate(total):
                if x is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["job", "numbers"])

        def together(t: pa.Table) -> pa.Table:
            total = None
            for x in t["numbers"].to_pylist():
                total = add(total, np.frombuffer(x))
            return pa.table({"job": t["job"].slice(0, 1), "numbers": pa.array([total.tobytes()], pa.binary())})

        found = self.rows.drop("names").mapInArrow(run, SUMS)
        if 8 * k * k * len(args) * self.tasks > SENT:
            found = found.groupBy("job").applyInArrow(together, SUMS)
        out: list[np.ndarray | None] = [None] * len(args)
        for r in found.collect():
            out[r.job] = add(out[r.job], np.frombuffer(r.numbers))
        return out

    def grams(self, jobs: list[Job]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Per job: rows, wide columns with rows, the narrow columns' squares, and X'X reduced by the wide columns."""
        k = self.k
        got = self.passed(jobs, [np.zeros(k)] * len(jobs), _gram)
        return [(int(x[0]), int(x[1]), x[2 : 2 + k], x[2 + k :].reshape(k, k)) if x is not None else (0, 0, np.zeros(k), np.zeros((k, k))) for x in got]

    def rank(self) -> int:
        n, live, size, h = self.grams([Job()])[0]
        return live + self.k - self.flat(n, size, h, ridge=False).shape[1]

    def flat(self, n: int, size: np.ndarray, h: np.ndarray, *, ridge: bool = True) -> np.ndarray:
        """Directions of the narrow weights along which no prediction moves (wide weights following)."""
        l2 = self.l2 if ridge else 0 * self.l2
        scale = 1 / np.sqrt(np.where(size + l2 > 0, size + l2, 1.0))
        values, vectors = np.linalg.eigh((h + np.diag(l2)) * np.outer(scale, scale))
        near = max(max(n, self.n_params) * np.finfo(float).eps, FLAT) * max(values[-1] if self.k else 0.0, 1e-300)
        return scale[:, None] * vectors[:, values <= near]

    def solve(self, jobs: list[Job], *, max_iter: int = 100, tol: float = 1e-10) -> list[solver.Solution]:
        """All fits together: a pass over the blocks takes a step in each that is not done."""
        runs = [solver.steps(self.k, self.l2, self.lower, self.upper, max_iter=max_iter, tol=tol) for _ in jobs]
        asked = {i: next(r) for i, r in enumerate(runs)}
        out: list[solver.Solution | None] = [None] * len(jobs)
        k, none = self.k, np.zeros(1 + 2 * self.k + self.k**2)
        while asked:
            going = list(asked)
            for i, x in zip(going, self.passed([jobs[i] for i in going], [asked[i] for i in going], _sums), strict=True):
                x = none if x is None else x
                own = (x[1 + k : 1 + 2 * k],) if self.wide is not None else ()
                try:
                    asked[i] = runs[i].send((float(x[0]), x[1 : 1 + k], x[1 + 2 * k :].reshape(k, k), *own))
                except StopIteration as end:
                    out[i] = end.value
                    del asked[i]
        return self._shortest(jobs, out)

    def _shortest(self, jobs: list[Job], found: list[solver.Solution]) -> list[solver.Solution]:
        """Of equally good weights the shortest, wide ones included, as Newton steps over all columns would find."""
        if self.wide is None or np.isfinite(self.lower).any() or np.isfinite(self.upper).any():
            return found
        flats = [self.flat(n, size, h) for n, _, size, h in self.grams(jobs)]
        at_, bent = [i for i, v in enumerate(flats) if v.shape[1]], {}
        if at_:
            got = self.passed([jobs[i] for i in at_], [found[i].weights for i in at_], _along, [flats[i] for i in at_])
            bent = dict(zip(at_, got, strict=True))
        for i, x in bent.items():
            v, m = flats[i], flats[i].shape[1]
            if x is not None:
                found[i].weights = found[i].weights - v @ np.linalg.lstsq(v.T @ v + x[: m * m].reshape(m, m), v.T @ found[i].weights + x[m * m :], rcond=None)[0]
        return found

    def finished(self, w: np.ndarray) -> tuple[dict, DataFrame]:
        """Facts of a fit and the wide columns' weights (col, estimate)."""
        k, l2 = self.k, self.wide_l2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("col", pa.string()), ("estimate", pa.float64()), ("n", pa.int64()), ("squares", pa.float64()), ("ridge", pa.float64()), ("steepest", pa.float64())])
            for b in blocks(batches, k):
                a = at(b, w, l2, np.ones(b.local.n, bool))
                fact = (b.local.n, float(((b.local.y - a.prob) ** 2).sum()), l2 / 2 * float((a.t**2).sum()), _steepest(a, l2))
                nulls = [None] * b.groups
                yield pa.RecordBatch.from_arrays([pa.array([*b.names, None], pa.string()), pa.array([*a.t, None], pa.float64()), *[pa.array([*nulls, x], t.type) for x, t in zip(fact, list(schema)[2:], strict=True)]], schema=schema)

        both = written(self.rows.mapInArrow(run, "col string, estimate double, n long, squares double, ridge double, steepest double"), "weights")
        facts = both.where("col IS NULL").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.sum("ridge").alias("ridge"), F.max("steepest").alias("steepest")).first().asDict()
        return facts, both.where("col IS NOT NULL").select("col", "estimate")

    def coefficients(self, w: np.ndarray, wide: DataFrame) -> DataFrame:
        """(block, col, estimate)."""
        table = self.spark.createDataFrame([(r.block, r.col, float(x)) for r, x in zip(self.narrow, w, strict=True)], "block string, col string, estimate double")
        if self.wide is None:
            return table
        every = self.design.columns.where(F.col("block") == self.wide).select("block", "col").join(wide, "col", "left")
        return every.select("block", "col", F.coalesce("estimate", F.lit(0.0)).alias("estimate")).unionByName(table)

    def scored(self, jobs: list[Job], max_iter: int) -> list[dict]:
        """Fits of the jobs, each scored on the rows it was not fitted to."""
        found = self.solve(jobs, max_iter=max_iter)
        seen = [size > 0 for _, _, size, _ in self.grams(jobs)]
        weights = [np.where(s | (self.l2 > 0), f.weights, 0.0) for s, f in zip(seen, found, strict=True)]
        out = []
        for f, s, w, x in zip(found, seen, weights, self.passed(jobs, weights, _score, seen, most={4}), strict=True):
            inside = (w > self.lower + 1e-9) & (w < self.upper - 1e-9) & s
            worst = max(float(np.abs(f.gradient[inside]).max()) if inside.any() else 0.0, float(x[4]))
            n, m, sse = int(x[0]), int(x[1]), float(x[2])
            out.append({"n_train": n, "n_test": m, "rmse": float(np.sqrt(sse / m)), "sse": sse, "unseen_column_fraction": float(x[3] / m), "converged": f.converged, "is_optimal": bool(worst < 3e-3 * np.sqrt(n))})
        return out


def packed_of(design) -> Packed:
    """The design's blocks, dealt out once."""
    if "packed" not in design.found:
        design.found["packed"] = Packed(design)
    return design.found["packed"]
