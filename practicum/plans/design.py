"""Designs as long tables: cells (obs_id, block, col, value) and columns with penalties and bounds.

A design never exists as a matrix on the driver: structural zeros are left out of ``cells``, and
every matrix operation is a join or an aggregate on ``obs_id`` or ``col``. Joins on ``obs_id`` have the hint
"merge": files are so much smaller than their rows that Spark would broadcast whole tables otherwise.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.history import counters, exploded
from ..operators.parse import Steps
from ..session import written

STUDENT_L2 = 1.0
CELLS = "obs_id long, block string, col string, value double"
ALIASED = "ord long, column string, reason string"


def block_columns(names: DataFrame, block: str, order: int, *, l2: float = 0.0, lower: float = float("-inf"), upper: float = float("inf")) -> DataFrame:
    """Columns of one block from distinct names (column ``col``)."""
    return names.select(F.lit(order).alias("block_no"), F.lit(block).alias("block"), "col", F.lit(float(l2)).alias("l2"), F.lit(float(lower)).alias("lower"), F.lit(float(upper)).alias("upper"))


@dataclass(frozen=True)
class Design:
    obs: DataFrame
    cells: DataFrame
    columns: DataFrame
    aliased: DataFrame | None = None
    #: What has been found out about this design: its size, its tables written out, its packed rows.
    found: dict = field(default_factory=dict, init=False, compare=False, repr=False)

    def indexed(self) -> DataFrame:
        """Columns with ``col_idx`` (block order, then name). Their number is that of parameters."""
        place = F.row_number().over(Window.orderBy("block_no", "col")) - 1
        return self.columns.withColumn("col_idx", place.cast("long"))

    @property
    def n_obs(self) -> int:
        return self._once("n_obs", self.obs.count)

    @property
    def n_params(self) -> int:
        return self._once("n_params", self.columns.count)

    def _once(self, name: str, make: Callable):
        if name not in self.found:
            self.found[name] = make()
        return self.found[name]

    def kept(self) -> Design:
        """The design with its tables written out, once: for what passes over them several times."""
        return self._once("kept", lambda: _written(self))

    def blocks(self) -> list[str]:
        return [r.block for r in self.columns.select("block_no", "block").distinct().orderBy("block_no").collect()]

    def aliased_rows(self) -> list[tuple[str, str]]:
        return [] if self.aliased is None else [(r.column, r.reason) for r in self.aliased.orderBy("ord").collect()]

    def take(self, rows: DataFrame) -> Design:
        """The design of some observations (column obs_id); columns and identification stay."""
        ids = rows.select("obs_id").distinct().hint("merge")
        return replace(self, obs=self.obs.join(ids, "obs_id", "left_semi"), cells=self.cells.join(ids, "obs_id", "left_semi"))

    def without(self, dropped: DataFrame) -> Design:
        """The design less some columns (block, col)."""
        keys = dropped.select("block", "col").distinct()
        return replace(self, cells=self.cells.join(keys, ["block", "col"], "left_anti").select("obs_id", "block", "col", "value"), columns=self.columns.join(keys, ["block", "col"], "left_anti").select(*self.columns.columns))

    def with_blocks(self, cells: DataFrame, columns: DataFrame) -> Design:
        """More blocks after those present; identify again afterwards."""
        mine, theirs = set(self.blocks()), {r.block for r in columns.select("block").distinct().collect()}
        if clash := mine & theirs:
            raise ValueError(f"block names must be unique, repeated: {sorted(clash)}")
        later = columns.withColumn("block_no", F.col("block_no") + len(mine))
        return replace(self, cells=self.cells.unionByName(cells), columns=self.columns.unionByName(later))

    def kc_sums(self) -> DataFrame:
        """Sum of the kc_intercept cells per observation, 0 where there is none."""
        own = self.cells.where("block = 'kc_intercept'").groupBy("obs_id").agg(F.sum("value").alias("kc_sum"))
        return self.obs.select("obs_id").join(own.hint("merge"), "obs_id", "left").select("obs_id", F.coalesce("kc_sum", F.lit(0.0)).alias("kc_sum"))

    def kc_per_row(self) -> float | None:
        r = self._once("kc_range", self.kc_sums().agg(F.min("kc_sum").alias("lo"), F.max("kc_sum").alias("hi")).first)
        return r.lo if r.lo is not None and abs(r.hi - r.lo) <= 1e-8 + 1e-5 * abs(r.hi) else None

    def recentring_is_valid(self) -> bool:
        return self.kc_per_row() == 1.0


def _cells(rows: DataFrame, block: str, col: Column, value: Column) -> DataFrame:
    return rows.select("obs_id", F.lit(block).alias("block"), col.alias("col"), value.cast("double").alias("value")).where("value <> 0")


def _kc_cells(rows: DataFrame, **blocks: Column) -> DataFrame:
    """Cells of several blocks by KC from one pass over rows of an observation and a KC."""
    made = F.array(*[F.struct(F.lit(b).alias("block"), value.cast("double").alias("value")) for b, value in blocks.items()])
    return rows.select("obs_id", F.col("kc").alias("col"), F.inline(made)).select("obs_id", "block", "col", "value").where("value <> 0")


def _obs(steps: Steps | DataFrame, identify: bool) -> DataFrame:
    """Observations; where passes over them follow, written out, so that their source is read once."""
    obs = steps.obs if isinstance(steps, Steps) else steps
    return written(obs, "obs") if identify else obs


def _named(cells: DataFrame, rows: DataFrame, identify: bool) -> tuple[DataFrame, DataFrame]:
    """The cells, written out where passes over them follow, and the KCs' names: each has an intercept's cell."""
    if not identify:
        return cells, rows.select(F.col("kc").alias("col")).distinct()
    cells = written(cells, "cells")
    return cells, written(cells.where("block = 'kc_intercept'").select("col").distinct(), "names")


def _written(design: Design) -> Design:
    out = replace(design, obs=written(design.obs, "obs"), cells=written(design.cells, "cells"), columns=written(design.columns, "columns"))
    out.found["kept"] = out
    return out


def _finish(design: Design, identify: bool) -> Design:
    if not identify:
        return design
    from ..operators.identify import identify as run

    # identification passes over the cells several times: derive them once
    out = run(replace(design, columns=written(design.columns, "columns")))
    out.found["kept"] = out
    return out


def build_afm_design(steps: Steps | DataFrame, *, learnsphere_compat: bool = False, student_l2: float | None = None, bound_slopes: bool = False, identify: bool | None = None, recompute_opportunities: bool = False) -> Design:
    """Blocks student, kc_intercept and kc_slope (value: prior opportunities)."""
    identify = not learnsphere_compat if identify is None else identify
    obs = _obs(steps, identify)
    l2 = student_l2 if student_l2 is not None else (STUDENT_L2 if learnsphere_compat else 0.0)
    kcs = counters(obs).withColumn("opp", F.col("seen")) if recompute_opportunities else exploded(obs)
    cells = _cells(obs, "student", F.col("student"), F.lit(1.0)).unionByName(_kc_cells(kcs, kc_intercept=F.lit(1.0), kc_slope=F.col("opp")))
    cells, names = _named(cells, kcs, identify)
    columns = (
        block_columns(obs.select(F.col("student").alias("col")).distinct(), "student", 0, l2=l2)
        .unionByName(block_columns(names, "kc_intercept", 1))
        .unionByName(block_columns(names, "kc_slope", 2, lower=0.0 if bound_slopes else float("-inf")))
    )
    return _finish(Design(obs, cells, columns), identify)


def build_pfa_design(steps: Steps | DataFrame, *, slopes: str = "per_kc", student_intercepts: bool = False, student_l2: float = 0.0, counts: str = "prior", identify: bool = True) -> Design:
    """Blocks [student], kc_intercept, then success and failure counts per KC or pooled."""
    if slopes not in ("per_kc", "pooled"):
        raise ValueError(f"unknown kind of slopes: {slopes!r}; there are per_kc and pooled")
    if counts not in ("prior", "inclusive"):
        raise ValueError(f"unknown kind of counts: {counts!r}; there are prior and inclusive")
    if counts == "inclusive":
        warnings.warn("inclusive counts contain the outcome they are to predict, so the fit looks better than any forecast would be", UserWarning, stacklevel=2)
    obs = _obs(steps, identify)
    rows = counters(obs, inclusive=counts == "inclusive")
    parts, kinds, at = [], [], 0
    if student_intercepts:
        parts.append(_cells(obs, "student", F.col("student"), F.lit(1.0)))
        kinds.append(lambda names: block_columns(obs.select(F.col("student").alias("col")).distinct(), "student", 0, l2=student_l2))
        at = 1
    kinds.append(lambda names: block_columns(names, "kc_intercept", at))
    if slopes == "per_kc":
        parts.append(_kc_cells(rows, kc_intercept=F.lit(1.0), kc_success=F.col("s"), kc_failure=F.col("f")))
        kinds += [lambda names, b=b, k=k: block_columns(names, b, at + 1 + k) for k, b in enumerate(("kc_success", "kc_failure"))]
    else:
        parts.append(_kc_cells(rows, kc_intercept=F.lit(1.0)))
        totals = rows.groupBy("obs_id").agg(F.sum("s").alias("success"), F.sum("f").alias("failure"))
        for k, b in enumerate(("success", "failure")):
            parts.append(_cells(totals, b, F.lit(b), F.col(b)))
            kinds.append(lambda names, b=b, k=k: block_columns(names.select(F.lit(b).alias("col")).distinct(), b, at + 1 + k))
    cells, names = _named(reduce(DataFrame.unionByName, parts), rows, identify)
    return _finish(Design(obs, cells, reduce(DataFrame.unionByName, [kind(names) for kind in kinds])), identify)


def accumulator_block(obs: DataFrame, values: DataFrame, name: str, columns: list[str] | None = None, *, l2: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Cells and columns of user-made counters: ``values`` has obs_id and one or more numbers."""
    given = [c for c in values.columns if c != "obs_id"]
    labels = columns or ([name] if len(given) == 1 else [f"{name}_{i}" for i in range(len(given))])
    if len(labels) != len(given):
        raise ValueError(f"{len(given)} value columns but {len(labels)} labels")
    counted = values.agg(F.count("*").alias("n"), F.countDistinct("obs_id").alias("d")).first()
    if counted.n != counted.d or counted.n != obs.count() or not values.join(obs, "obs_id", "left_anti").isEmpty():
        raise ValueError(f"{counted.n} value rows but {obs.count()} observations")
    stacked = values.select("obs_id", F.inline(F.array(*[F.struct(F.lit(label).alias("col"), F.col(f"`{c}`").cast("double").alias("value")) for label, c in zip(labels, given, strict=True)])))
    cells = stacked.where("value <> 0").select("obs_id", F.lit(name).alias("block"), "col", "value")
    names = obs.sparkSession.createDataFrame([(label,) for label in labels], "col string")
    return cells, block_columns(names, name, 0, l2=l2)
