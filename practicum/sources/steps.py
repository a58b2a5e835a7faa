"""Sources of student-step tables: tab-separated exports, any DataFrame, and a derivation from events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KC_COLUMN = re.compile(r"^KC \((?P<name>.+)\)$")
#: The required columns beside the pair that names a KC model, and the optional one.
REQUIRED = ("Anon Student Id", "Problem Name", "Step Name", "First Attempt")
TIME = "First Transaction Time"


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings (empty, never null) and ``row_id``, the 0-based position in the file."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True).na.fill("")
    return with_row_ids(raw)


def with_row_ids(df: DataFrame) -> DataFrame:
    """Dense positions without sorting: a count per partition gives each its offset."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = sorted((r.p, r.n) for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    ahead, total = [], 0
    for p, n in counts:
        ahead += [F.lit(p), F.lit(total)]
        total += n
    offset = F.create_map(*ahead)[part] if ahead else F.lit(0)
    return marked.withColumn("row_id", (offset + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_m")


def kc_models(df: DataFrame) -> list[str]:
    """Names of the KC models whose label column is present."""
    return sorted(m["name"] for c in df.columns if (m := KC_COLUMN.match(c)))


def list_kc_models(spark: SparkSession, path: str) -> list[str]:
    """The models of a file, from its header alone."""
    return kc_models(spark.read.csv(path, sep="\t", header=True, quote='"', escape='"'))


def check_columns(df: DataFrame, kc_model: str) -> None:
    wanted = [f"KC ({kc_model})", f"Opportunity ({kc_model})", *REQUIRED]
    if missing := [c for c in wanted if c not in df.columns]:
        raise KeyError(f"Missing column(s) {missing}. KC models present: {kc_models(df) or 'none'}")


#: The derived table in SQL: both Spark and DuckDB run it (dialect differences are parameters).
EVENT_STEPS_SQL = """
SELECT event_id AS row_id, concat('u', CAST(user_id AS {text})) AS student, k, ts, user_id,
  concat('p', CAST({div} AS {text}), '##s', CAST(k AS {text})) AS item,
  CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'click' THEN 'Correct ' WHEN 'error' THEN 'incorrect' WHEN 'view' THEN 'hint' ELSE 'unknown' END AS attempt,
  CASE WHEN k % 17 = 0 THEN '' ELSE concat('d', CAST({div} AS {text})) END AS kc_coarse,
  concat('k', CAST(k AS {text})) AS kc_fine,
  concat('d', CAST({div} AS {text}), '~~m', CAST(k % 3 AS {text})) AS kc_multi,
  CASE WHEN k % 17 = 0 THEN '' ELSE concat('g', CAST(user_id % 3 AS {text}), 'd', CAST({div} AS {text})) END AS kc_cohort
FROM (SELECT *, CAST({json} AS INT) AS k FROM events) e
"""


def steps_from_events(spark: SparkSession, sf_dir: str, *, time_shift: bool = False) -> DataFrame:
    """A student-step table derived from ``events``: users practise 100 items under four KC models.

    ``time_shift`` moves times back by k % 3 hours, so that time order differs from row order.
    Opportunities are running counts in row order, as an export would number them.
    """
    from pyspark.sql import Window

    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    base = spark.sql(EVENT_STEPS_SQL.format(text="STRING", div="k div 10", json="get_json_object(props, '$.k')"))
    when = F.col("ts") - F.make_dt_interval(hours=F.col("k") % 3) if time_shift else F.col("ts")
    out = base.select(
        "row_id", F.col("student").alias("Anon Student Id"), F.split("item", "##")[0].alias("Problem Name"), F.split("item", "##")[1].alias("Step Name"),
        F.col("attempt").alias("First Attempt"), F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias(TIME), "kc_coarse", "kc_fine", "kc_multi", "kc_cohort",
    )

    def count(key: str) -> F.Column:
        w = Window.partitionBy("Anon Student Id", key).orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
        return F.count("*").over(w).cast("string")

    out = out.withColumns({"_a": F.split("kc_multi", "~~")[0], "_b": F.split("kc_multi", "~~")[1]})
    out = out.withColumns({
        "Opportunity (Coarse)": F.when(F.col("kc_coarse") == "", "").otherwise(count("kc_coarse")),
        "Opportunity (Fine)": count("kc_fine"),
        "Opportunity (Multi)": F.concat_ws("~~", count("_a"), count("_b")),
        "Opportunity (Cohort)": F.when(F.col("kc_cohort") == "", "").otherwise(count("kc_cohort")),
    })
    return out.drop("_a", "_b").withColumnsRenamed({f"kc_{m.lower()}": f"KC ({m})" for m in ("Coarse", "Fine", "Multi", "Cohort")})


def write_table(df: DataFrame, path: str) -> None:
    """One tab-separated file in row order; added numbers with six decimals, missing ones blank."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    cells = [F.coalesce(F.format_string("%.6f", F.col(f"`{c}`")), F.lit("")).alias(c) if c in doubles else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c != "row_id"]
    ordered = df.orderBy("row_id").select(*cells)
    names = ordered.columns
    with open(path, "w", encoding="utf-8", newline="") as out:
        import csv

        writer = csv.writer(out, delimiter="\t", lineterminator="\n")
        writer.writerow(names)
        for row in ordered.toLocalIterator():  # partition by partition, never the whole table
            writer.writerow(["" if v is None else v for v in row])
