"""Penalised, box-bounded logistic regression: Newton steps on the driver or in a task.

The problem is convex, so the optimum does not depend on the method. Steps start at zero and use the
pseudo-inverse of the Hessian over the free coefficients: along flat directions the solution keeps
minimum length and columns without data stay at zero. Bounds are handled by an active set whose
multipliers' signs are checked. Two sources of the same sums: cells in arrays (``Local``), and passes
over packed rows (``packed.Packed``) where cells or columns do not fit one process.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np

#: Cells (about 24 bytes each, some copies of them) and columns (squared) up to which a design goes to one process.
LOCAL_CELLS, LOCAL_COLUMNS = 1_000_000, 600
#: Shares of a column's own curvature below which a reduced Hessian counts as flat.
FLAT = 1e-10


def expit(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1, e) / (1 + e)


@dataclass
class Local:
    """Cells sorted by row; rows are 0..n-1."""

    n: int
    p: int
    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    y: np.ndarray

    def __post_init__(self) -> None:
        by = np.lexsort((self.col, self.row))
        self.row, self.col, self.value = self.row[by], self.col[by], self.value[by]
        size = np.bincount(self.row, minlength=self.n)
        first = np.cumsum(size) - size
        most = int(size.max()) if len(size) else 0
        left, right = [], []
        for k in range(most):
            # cells k apart within one row
            at = np.arange(len(self.row) - k)
            same = at[self.row[at] == self.row[at + k]]
            left.append(same)
            right.append(same + k)
        self.left = np.concatenate(left) if left else np.zeros(0, np.int64)
        self.right = np.concatenate(right) if right else np.zeros(0, np.int64)
        self.first = first

    def subset(self, rows: np.ndarray) -> Local:
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        own = place[self.row] >= 0
        return Local(len(rows), self.p, place[self.row[own]], self.col[own], self.value[own], self.y[rows])

    def predict(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n)

    def sums(self, w: np.ndarray, *, hessian: bool = True) -> tuple[float, np.ndarray, np.ndarray | None]:
        z = self.predict(w)
        loss = float((np.logaddexp(0, z) - self.y * z).sum())
        prob = expit(z)
        grad = np.bincount(self.col, self.value * (prob - self.y)[self.row], minlength=self.p)
        if not hessian:
            return loss, grad, None
        return loss, grad, self.curvature(prob * (1 - prob))

    def curvature(self, weight: np.ndarray) -> np.ndarray:
        """X'WX for weights of rows."""
        v = self.value[self.left] * self.value[self.right] * weight[self.row[self.left]]
        i, j = self.col[self.left], self.col[self.right]
        h = np.bincount(i * self.p + j, v, minlength=self.p * self.p).reshape(self.p, self.p)
        return h + h.T - np.diag(np.diag(h))


def fits_one_process(design) -> bool:
    return design.n_params <= LOCAL_COLUMNS and design.cells.count() <= LOCAL_CELLS


def local_of(design) -> tuple[Local, np.ndarray]:
    """Arrays of a design that fits one process, and its obs_id in row order."""
    obs = design.obs.select("obs_id", "y").orderBy("obs_id").toArrow()
    cells = design.cells.join(design.indexed().select("block", "col", "col_idx"), ["block", "col"]).select("obs_id", "col_idx", "value").toArrow()
    ids = obs["obs_id"].to_numpy()
    row = np.searchsorted(ids, cells["obs_id"].to_numpy())
    return Local(len(ids), design.n_params, row, cells["col_idx"].to_numpy().astype(np.int64), cells["value"].to_numpy().astype(float), obs["y"].to_numpy().astype(float)), ids


@dataclass
class Solution:
    weights: np.ndarray
    loss: float
    gradient: np.ndarray
    n_iter: int
    converged: bool
    message: str


def _solve_step(h: np.ndarray, g: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """-pinv(h) g, scaled by the diagonal; Cholesky where the matrix allows it.

    ``size`` is the diagonal that a reduced Hessian had before: rounding leaves that share of it in flat directions.
    """
    diagonal = np.diag(h) if size is None else size
    scale = 1 / np.sqrt(np.maximum(diagonal, 1e-300))
    scale[diagonal <= 0] = 0.0
    a, b = h * np.outer(scale, scale), g * scale
    if (scale > 0).all():
        try:
            low = np.linalg.cholesky(a)
            if np.diag(low).min() > 1e-4:
                return -scale * np.linalg.solve(low.T, np.linalg.solve(low, b))
        except np.linalg.LinAlgError:
            pass
    if size is not None:
        values, vectors = np.linalg.eigh(a)
        keep = values > FLAT
        return -scale * ((vectors[:, keep] / values[keep]) @ (vectors[:, keep].T @ b))
    values, vectors = np.linalg.eigh(h)
    keep = values > max(len(g), 1) * np.finfo(float).eps * max(values[-1], 1e-300)
    return -(vectors[:, keep] / values[keep]) @ (vectors[:, keep].T @ g)


def solve(source, l2: np.ndarray, lower: np.ndarray, upper: np.ndarray, *, max_iter: int = 100, tol: float = 1e-10) -> Solution:
    run = steps(source.p, l2, lower, upper, max_iter=max_iter, tol=tol)
    w = next(run)
    while True:
        try:
            w = run.send(source.sums(w))
        except StopIteration as end:
            return end.value


def steps(p: int, l2: np.ndarray, lower: np.ndarray, upper: np.ndarray, *, max_iter: int = 100, tol: float = 1e-10) -> Generator[np.ndarray, tuple, Solution]:
    """Asks for the sums at weights (loss, gradient, Hessian, and its diagonal before it was reduced, if it was)."""
    w = np.clip(np.zeros(p), lower, upper)
    loss, grad, hess, *size = yield w
    value, g = loss + 0.5 * (l2 * w * w).sum(), grad + l2 * w
    trained = ((size[0] if size else np.diag(hess)) > 0) | (l2 > 0)
    message, done, it = "iteration limit", False, 0
    for it in range(1, max_iter + 1):
        at_low, at_high = w <= lower, w >= upper
        free = trained & ~(at_low & (g > 0)) & ~(at_high & (g < 0))
        if not free.any() or np.abs(g[free]).max() < 1e-9:
            message, done = "stationary", True
            break
        step = np.zeros(p)
        step[free] = _solve_step((hess + np.diag(l2))[np.ix_(free, free)], g[free], *[(s + l2)[free] for s in size])
        largest = np.abs(step).max()
        step *= min(1.0, 5.0 / largest) if largest > 0 else 1.0
        length, better = 1.0, False
        while length > 1e-8:
            new = np.clip(w + length * step, lower, upper)
            loss, grad, hess_new, *size_new = yield new
            f = loss + 0.5 * (l2 * new * new).sum()
            if f <= value + 1e-4 * float(g @ (new - w)) or f < value:
                better = True
                break
            length /= 2
        if not better:
            message, done = "no further decrease", True
            break
        drop, value, w, hess, g, size = value - f, f, new, hess_new, grad + l2 * new, size_new
        if drop < tol * max(1.0, abs(value)) and np.abs(g[free]).max() < 1e-6:
            message, done = "converged", True
            break
    return Solution(w, float(value - 0.5 * (l2 * w * w).sum()), g, it, done, message)
