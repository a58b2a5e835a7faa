"""From a student-step table to observations: splitting, pairing, classifying, validating."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import strip_lower
from ..session import written
from ..sources.steps import TIME, check_columns, read_export, with_row_ids

SEPARATOR, ITEM_SEPARATOR = "~~", "##"
#: The outcome vocabulary.
SUCCESS = ("correct",)
FAILURE = ("correct", "incorrect", "hint", "unknown")


def _split(cell: Column) -> Column:
    return F.filter(F.split(F.coalesce(cell, F.lit("")), SEPARATOR), lambda x: x != "")


def parsed_rows(df: DataFrame, kc_model: str, *, success_values: tuple[str, ...] = SUCCESS) -> DataFrame:
    """Every row with its parsed parts and nothing rejected: labels, counts, numbers, kcs, outcome.

    A repeated label keeps its first position and its last count. One projection, no shuffle.
    """
    check_columns(df, kc_model)
    success = [v.strip().lower() for v in success_values]
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = df.select(
        "row_id", text("Anon Student Id").alias("student"), F.concat(text("Problem Name"), F.lit(ITEM_SEPARATOR), text("Step Name")).alias("item"),
        (text(TIME) if TIME in df.columns else F.lit(None).cast("string")).alias("time"),
        strip_lower(text("First Attempt")).alias("outcome"), _split(F.col(f"`KC ({kc_model})`")).alias("labels"),
        _split(F.col(f"`Opportunity ({kc_model})`")).alias("counts"), text(f"Opportunity ({kc_model})").alias("cell"),
    )
    rows = rows.withColumn("numbers", F.transform("counts", lambda c: c.try_cast("bigint") - 1))
    value = lambda k: F.get("numbers", F.size("labels") - F.array_position(F.reverse("labels"), k))
    kcs = F.transform(F.array_distinct("labels"), lambda k: F.struct(k.alias("kc"), value(k).cast("long").alias("opp")))
    return rows.withColumns({"kcs": kcs, "y": F.col("outcome").isin(success).cast("int")})


def observations(df: DataFrame, kc_model: str, **options) -> DataFrame:
    """Rows with a KC: obs_id (the row's position), y, student, item, time, kcs."""
    rows = parsed_rows(df, kc_model, **options).where(F.size("labels") > 0)
    return rows.select(F.col("row_id").alias("obs_id"), "y", "student", "item", "time", "kcs")


@dataclass(frozen=True)
class Steps:
    """Observations of one KC model with what has been found out about their source."""

    obs: DataFrame
    kc_model: str
    source: DataFrame | None = field(default=None, repr=False)
    skipped_no_kc: int = 0
    duplicate_kc_rows: int = 0
    n_obs: int = 0

    def summary(self) -> str:
        """Sizes of the table, a fact a line."""
        size = self.obs.agg(F.count("*").alias("observations"), F.countDistinct("student").alias("students"), F.countDistinct("item").alias("items"), F.round(F.avg("y"), 4).alias("success rate")).first()
        kcs = self.obs.select(F.explode("kcs.kc").alias("kc")).distinct().count()
        facts = {"KC model": self.kc_model, **size.asDict(), "KCs": kcs, "rows without KC": self.skipped_no_kc}
        return "\n".join(f"  {name:<24}{value}" for name, value in facts.items())


def row_problem(kc_model: str) -> Column:
    """Why a parsed row cannot be used, as text; null where it can."""
    lengths = F.format_string(f"%d labels against %d opportunities under '{kc_model}': %s, %s", F.size("labels"), F.size("counts"), F.to_json("labels"), F.to_json("counts"))
    number = F.format_string(f"not a whole number in the opportunities under '{kc_model}': '%s' for %s", F.col("cell"), F.to_json("labels"))
    return F.when(F.size("labels") != F.size("counts"), lengths).when(F.exists("numbers", lambda n: n.isNull()), number)


def validation(rows: DataFrame, kc_model: str) -> DataFrame:
    """One row of findings from parsed rows: a single aggregate over the table."""
    own = F.size("labels") > 0
    bad = F.when(own, row_problem(kc_model))
    return rows.agg(
        F.min_by(F.struct("row_id", bad.alias("why")), F.when(bad.isNotNull(), F.col("row_id"))).alias("first_bad"),
        F.count_if(own).alias("n_obs"),
        F.count_if(~own).alias("skipped_no_kc"),
        F.count_if(own & (F.size("labels") != F.size("kcs"))).alias("duplicate_kc_rows"),
        F.count_if(own & F.exists("numbers", lambda n: n < 0)).alias("negative_rows"),
        F.min(F.when(own, F.col("y"))).alias("y_min"),
        F.max(F.when(own, F.col("y"))).alias("y_max"),
    )


def vocabulary(rows: DataFrame) -> DataFrame:
    """Outcomes of the rows that have a KC and how often they occur."""
    return rows.where(F.size("labels") > 0).groupBy("outcome").agg(F.count("*").alias("n"))


def from_frame(df: DataFrame, kc_model: str, *, success_values: tuple[str, ...] = SUCCESS, failure_values: tuple[str, ...] = FAILURE) -> Steps:
    """Parse and validate; errors come in the order a reader of the file would meet them."""
    if "row_id" not in df.columns:
        df = with_row_ids(df)
    # validation, vocabulary and observations pass over them: the source is read and parsed once
    rows = written(parsed_rows(df, kc_model, success_values=success_values), "parsed")
    found = validation(rows, kc_model).first()
    if found.first_bad is not None and found.first_bad.why is not None:
        raise ValueError(f"Row {found.first_bad.row_id + 2}: {found.first_bad.why}")
    if not found.n_obs:
        raise ValueError(f"every row is without a KC under '{kc_model}'")
    success = sorted({v.strip().lower() for v in success_values})
    failure = sorted({v.strip().lower() for v in failure_values})
    strange = vocabulary(rows).where(~F.col("outcome").isin([*success, *failure])).orderBy("outcome").limit(50).collect()
    if strange:
        listed = ", ".join(f"{r.outcome!r} ({r.n:,} rows)" for r in strange)
        raise ValueError(f"outcomes outside the vocabulary: {listed}; {success} succeed, {failure} fail")
    if found.y_min == found.y_max:
        warnings.warn(f"all rows end in {'success' if found.y_min else 'failure'} ({success} succeed); no model can be told from another by them", RuntimeWarning, stacklevel=2)
    if found.negative_rows:
        raise ValueError("an opportunity is below 1; they are numbered from 1")
    obs = rows.where(F.size("labels") > 0).select(F.col("row_id").alias("obs_id"), "y", "student", "item", "time", "kcs")
    return Steps(obs, kc_model, df, found.skipped_no_kc, found.duplicate_kc_rows, found.n_obs)


def load_student_step(spark, path: str, kc_model: str, **options) -> Steps:
    return from_frame(read_export(spark, path), kc_model, **options)
