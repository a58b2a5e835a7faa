"""One query per operator of the analytics engine, over student steps derived from ``events``."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import folds, history, identify, parse
from .plans import crossval, fit
from .plans.design import Design, accumulator_block, build_afm_design, build_pfa_design
from .session import written
from .sources.steps import EVENT_STEPS_SQL, steps_from_events
from .sources.synthetic import synthetic_steps as make_steps

MODELS = ("Coarse", "Fine", "Multi", "Cohort")


def _obs(spark: SparkSession, sf: str, model: str = "Coarse", *, time_shift: bool = False) -> DataFrame:
    return parse.observations(steps_from_events(spark, sf, time_shift=time_shift), model)


def _rows(spark: SparkSession, sf: str, model: str) -> DataFrame:
    return parse.parsed_rows(steps_from_events(spark, sf), model)


# ---- SQL: the derived table and the observations of each KC model -----------------------------

_BASE = "WITH e AS (" + EVENT_STEPS_SQL.format(text="VARCHAR", div="k // 10", json="json_extract_string(props, '$.k')") + "), "
_Y = "CASE WHEN lower(trim(attempt)) = 'correct' THEN 1 ELSE 0 END"


def _o(model: str, shift: bool = False) -> str:
    """CTEs o (an observation each) and x (an observation and KC each, with running counts)."""
    col = f"kc_{model.lower()}"
    when = "ts - to_hours(k % 3)" if shift else "ts"
    return (
        _BASE
        + f"o AS (SELECT row_id AS obs_id, student, item, strftime({when}, '%Y-%m-%d %H:%M:%S') AS time, {_Y} AS y, {col} AS cell FROM e WHERE {col} <> ''), "
        + "x0 AS (SELECT obs_id, student, item, time, y, generate_subscripts(string_split(cell, '~~'), 1) - 1 AS pos, unnest(string_split(cell, '~~')) AS kc FROM o), "
        + "x AS (SELECT *, count(*) OVER f AS opp, count(*) OVER w AS seen, coalesce(sum(y) OVER w, 0) AS s, coalesce(sum(1 - y) OVER w, 0) AS f FROM x0 "
        + "WINDOW f AS (PARTITION BY student, kc ORDER BY obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY student, kc ORDER BY time, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
    )


_AFM_CELLS = (
    "c AS (SELECT obs_id, 'student' AS block, student AS col, 1.0::DOUBLE AS value FROM o UNION ALL SELECT obs_id, 'kc_intercept', kc, 1.0 FROM x UNION ALL SELECT obs_id, 'kc_slope', kc, opp FROM x WHERE opp <> 0) "
)
_PFA_CELLS = (
    "c AS (SELECT obs_id, 'kc_intercept' AS block, kc AS col, 1.0::DOUBLE AS value FROM x UNION ALL SELECT obs_id, 'kc_success', kc, s FROM x WHERE s <> 0 UNION ALL SELECT obs_id, 'kc_failure', kc, f FROM x WHERE f <> 0) "
)
_COLUMNS = (
    "l AS (SELECT DISTINCT 0 AS block_no, 'student' AS block, student AS col FROM o UNION ALL SELECT DISTINCT 1, 'kc_intercept', kc FROM x UNION ALL SELECT DISTINCT 2, 'kc_slope', kc FROM x) "
)
#: A fixed rule for weights, so that statistics of given weights can be compared with SQL.
_WEIGHTS = "wt AS (SELECT block, col, ((ascii(right(col, 1)) + length(col)) % 7 - 3) * CASE block WHEN 'kc_slope' THEN 0.01 ELSE 0.1 END AS estimate FROM l) "
_PRED = (
    "z AS (SELECT o.obs_id, o.y, coalesce(sum(c.value * wt.estimate), 0) AS z FROM o LEFT JOIN c ON o.obs_id = c.obs_id LEFT JOIN wt ON c.block = wt.block AND c.col = wt.col GROUP BY ALL), "
    "p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM z) "
)


def _weights(d: Design) -> DataFrame:
    scale = F.when(F.col("block") == "kc_slope", 0.01).otherwise(0.1)
    return d.columns.select("block", "col", (((F.ascii(F.right("col", F.lit(1))) + F.length("col")) % 7 - 3) * scale).alias("estimate"))


def _round(c, n: int = 6):
    return F.round(c, n)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- parsing ----------------------------------------------------------------------------------


@query(_o("Coarse") + "SELECT obs_id, y, student, item, kc, CAST(opp AS BIGINT) AS opp FROM x")
def parse_steps(spark, sf):
    return history.exploded(_obs(spark, sf)).select("obs_id", "y", "student", "item", "kc", "opp")


@query(_o("Multi") + "SELECT obs_id, CAST(pos AS INT) AS pos, kc, CAST(opp AS BIGINT) AS opp FROM x")
def parse_multi_kc(spark, sf):
    return history.exploded(_obs(spark, sf, "Multi")).select("obs_id", "pos", "kc", "opp")


@query(_BASE + "m AS (SELECT 'Coarse' AS model, kc_coarse AS c FROM e UNION ALL SELECT 'Fine', kc_fine FROM e UNION ALL SELECT 'Multi', kc_multi FROM e UNION ALL SELECT 'Cohort', kc_cohort FROM e) SELECT model, count(*) FILTER (c = '') AS skipped, count(*) FILTER (c <> '') AS n_obs FROM m GROUP BY model")
def skip_no_kc_counts(spark, sf):
    out = None
    for m in MODELS:
        one = parse.validation(_rows(spark, sf, m), m).select(F.lit(m).alias("model"), F.col("skipped_no_kc").alias("skipped"), "n_obs")
        out = one if out is None else out.unionByName(one)
    return out


@query(_BASE + "v AS (SELECT lower(trim(attempt)) AS outcome FROM e WHERE kc_coarse <> '') SELECT outcome, count(*) AS n FROM v GROUP BY outcome")
def outcome_vocabulary(spark, sf):
    return parse.vocabulary(_rows(spark, sf, "Coarse"))


@query(_BASE + "d AS (SELECT row_id, k FROM e) SELECT row_id, 'd' || CAST(k // 10 AS VARCHAR) AS first_kc, CAST(2 AS BIGINT) AS last_opp, CAST(1 AS INT) AS n_kcs FROM d WHERE k % 5 = 0")
def duplicate_kc_rows(spark, sf):
    kc = F.col("KC (Fine)")
    table, fifth = steps_from_events(spark, sf), F.substring(kc, 2, 9).cast("int") % 5 == 0
    name = F.concat(F.lit("d"), F.floor(F.substring(kc, 2, 9).cast("int") / 10).cast("string"))
    doubled = table.withColumns({"KC (Fine)": F.when(fifth, F.concat(name, F.lit("~~"), name)).otherwise(kc), "Opportunity (Fine)": F.when(fifth, F.lit("1~~3")).otherwise(F.col("Opportunity (Fine)"))})
    rows = parse.parsed_rows(doubled, "Fine").where("size(labels) <> size(kcs)")
    return rows.select("row_id", F.col("kcs")[0]["kc"].alias("first_kc"), F.col("kcs")[0]["opp"].alias("last_opp"), F.size("kcs").alias("n_kcs"))


@query(_BASE + "v AS (SELECT count(*) AS n, min(row_id) AS first_bad FROM e WHERE k = 13) SELECT first_bad AS row_id, CAST((SELECT count(*) FROM e) AS BIGINT) AS n_obs FROM v")
def validation_first_bad_row(spark, sf):
    table = steps_from_events(spark, sf).withColumn("Opportunity (Fine)", F.when(F.col("KC (Fine)") == "k13", "1.5").otherwise(F.col("Opportunity (Fine)")))
    return parse.validation(parse.parsed_rows(table, "Fine"), "Fine").select(F.col("first_bad.row_id").alias("row_id"), "n_obs")


# ---- histories --------------------------------------------------------------------------------


@query(_o("Coarse", True) + "SELECT student, obs_id, CAST(row_number() OVER (PARTITION BY student ORDER BY time, obs_id) - 1 AS BIGINT) AS place FROM o")
def practice_order(spark, sf):
    return history.practice_order(_obs(spark, sf, time_shift=True))


@query(_o("Multi", True) + "SELECT obs_id, kc, CAST(seen AS BIGINT) AS opp FROM x")
def recomputed_opportunity(spark, sf):
    return history.exploded(history.recomputed_opportunities(_obs(spark, sf, "Multi", time_shift=True))).select("obs_id", "kc", "opp")


@query(_o("Coarse", True) + "SELECT DISTINCT obs_id FROM x WHERE opp <> seen")
def opportunity_disagreement(spark, sf):
    return history.opportunity_disagreements(_obs(spark, sf, time_shift=True))


@query(_o("Multi", True) + "SELECT obs_id, CAST(pos AS INT) AS pos, kc, CAST(s AS BIGINT) AS s, CAST(f AS BIGINT) AS f FROM x")
def prior_success_failure(spark, sf):
    return history.success_failure_counts(_obs(spark, sf, "Multi", time_shift=True))


@query(_o("Multi", True) + "SELECT obs_id, CAST(pos AS INT) AS pos, kc, CAST(s AS BIGINT) AS s, CAST(f AS BIGINT) AS f FROM x")
def prior_success_failure_by_ranges(spark, sf):
    """The same counts by range-partitioned prefix sums, for keys that hold much of all rows."""
    rows = history.counters(_obs(spark, sf, "Multi", time_shift=True), ranges=16)
    return rows.select("obs_id", "pos", "kc", "s", "f")


@query(_o("Coarse") + "SELECT obs_id, CAST(pos AS INT) AS pos, kc, CAST(s + y AS BIGINT) AS s, CAST(f + 1 - y AS BIGINT) AS f FROM x")
def inclusive_success_failure(spark, sf):
    return history.success_failure_counts(_obs(spark, sf), inclusive=True)


@query(_o("Multi") + "SELECT obs_id, CAST(sum(s) AS BIGINT) AS s, CAST(sum(f) AS BIGINT) AS f FROM x GROUP BY obs_id")
def pooled_history(spark, sf):
    return history.pooled_history(_obs(spark, sf, "Multi"))


@query(_o("Multi", True) + "SELECT count(*) FILTER (s + f <> seen) AS broken, count(*) AS n FROM x")
def history_invariants(spark, sf):
    """s + f = prior attempts, and inclusive counts add the row's own response: no row breaks it."""
    a = history.counters(_obs(spark, sf, "Multi", time_shift=True))
    b = history.counters(_obs(spark, sf, "Multi", time_shift=True), inclusive=True).select("obs_id", "pos", F.col("s").alias("s1"), F.col("f").alias("f1"))
    broken = (F.col("s") + F.col("f") != F.col("seen")) | (F.col("s1") != F.col("s") + F.col("y")) | (F.col("f1") != F.col("f") + 1 - F.col("y"))
    return a.join(b, ["obs_id", "pos"]).agg(F.count_if(broken).alias("broken"), F.count("*").alias("n"))


@query(_o("Coarse") + "SELECT kc, CAST(seen AS BIGINT) AS opportunity, count(*) AS n, CAST(sum(y) AS BIGINT) AS successes, round(avg(y), 9) AS success_rate FROM x GROUP BY kc, seen")
def learning_curve(spark, sf):
    return history.learning_curve(_obs(spark, sf)).withColumn("success_rate", _round("success_rate", 9))


# ---- designs ----------------------------------------------------------------------------------


@query(_o("Coarse") + ", " + _AFM_CELLS + "SELECT * FROM c")
def afm_compat_cells(spark, sf):
    return build_afm_design(_obs(spark, sf), learnsphere_compat=True).cells


@query(_o("Coarse") + ", " + _AFM_CELLS + "SELECT * FROM c WHERE NOT (block = 'student' AND col = (SELECT max(student) FROM o))")
def afm_cells(spark, sf):
    return build_afm_design(_obs(spark, sf)).cells


@query(_o("Multi", True) + ", " + _PFA_CELLS + "SELECT * FROM c")
def pfa_cells(spark, sf):
    return build_pfa_design(_obs(spark, sf, "Multi", time_shift=True), identify=False).cells


@query(_o("Coarse") + ", h AS (SELECT obs_id, sum(s) AS s, sum(f) AS f FROM x GROUP BY obs_id) SELECT obs_id, 'kc_intercept' AS block, kc AS col, 1.0::DOUBLE AS value FROM x UNION ALL SELECT obs_id, 'success', 'success', CAST(s AS DOUBLE) FROM h WHERE s <> 0 UNION ALL SELECT obs_id, 'failure', 'failure', CAST(f AS DOUBLE) FROM h WHERE f <> 0")
def pfa_pooled_cells(spark, sf):
    return build_pfa_design(_obs(spark, sf), slopes="pooled", identify=False).cells


@query(_o("Coarse") + ", " + _COLUMNS + "SELECT CAST(row_number() OVER (ORDER BY block_no, col) - 1 AS BIGINT) AS col_idx, block, col, CASE WHEN block = 'student' THEN 1.0 ELSE 0.0 END::DOUBLE AS l2, CASE WHEN block = 'kc_slope' THEN 0 END::DOUBLE AS lower FROM l")
def design_columns(spark, sf):
    d = build_afm_design(_obs(spark, sf), learnsphere_compat=True, bound_slopes=True)
    return d.indexed().select("col_idx", "block", "col", "l2", F.when(F.col("lower") > float("-inf"), F.col("lower")).alias("lower"))


@query(_o("Multi") + "SELECT obs_id, CAST(count(*) AS DOUBLE) AS kc_sum FROM x GROUP BY obs_id")
def kc_per_row(spark, sf):
    return build_afm_design(_obs(spark, sf, "Multi"), identify=False).kc_sums()


@query(_o("Fine") + ", " + _AFM_CELLS + "SELECT block, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM c WHERE obs_id % 3 = 0 GROUP BY block")
def design_subset(spark, sf):
    d = build_afm_design(_obs(spark, sf, "Fine"), identify=False)
    return d.take(d.obs.where("obs_id % 3 = 0")).cells.groupBy("block").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(_o("Coarse") + ", " + _AFM_CELLS + "SELECT block, col, count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT * FROM c UNION ALL SELECT obs_id, 'late', 'late', CAST(obs_id % 2 AS DOUBLE) FROM o WHERE obs_id % 2 <> 0) GROUP BY block, col")
def user_accumulator(spark, sf):
    d = build_afm_design(_obs(spark, sf), identify=False)
    d = d.with_blocks(*accumulator_block(d.obs, d.obs.select("obs_id", (F.col("obs_id") % 2).alias("late")), "late"))
    return d.cells.groupBy("block", "col").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# ---- identification ---------------------------------------------------------------------------


@query(_o("Fine") + ", " + _AFM_CELLS + ", " + _COLUMNS + ", r AS (SELECT DISTINCT obs_id FROM x WHERE opp = 0 OR kc < 'k5'), h AS (SELECT DISTINCT block, col FROM c JOIN r USING (obs_id)) SELECT block, col FROM l WHERE (block, col) NOT IN (SELECT (block, col) FROM h)")
def dead_columns(spark, sf):
    """Among first practices of the later KCs, whose slopes have no cell there."""
    obs = _obs(spark, sf, "Fine")
    first = history.exploded(obs).where("opp = 0 OR kc < 'k5'").select("obs_id")
    return identify.dead_columns(build_afm_design(obs, identify=False).take(first)).select("block", "col")


_TWIN = _BASE + "o AS (SELECT row_id AS obs_id FROM e WHERE kc_coarse <> ''), t AS (SELECT row_id AS obs_id, kc_coarse AS kc FROM e WHERE kc_coarse <> '') "


@query(_TWIN + "SELECT DISTINCT 'kc_intercept' AS block, kc || 'twin' AS col, kc AS first FROM t UNION ALL SELECT DISTINCT 'kc_slope', kc || 'twin', kc FROM t WHERE kc IN (SELECT kc FROM (SELECT student, kc_coarse AS kc, count(*) AS n FROM e WHERE kc_coarse <> '' GROUP BY ALL) WHERE n > 1)")
def duplicate_columns(spark, sf):
    """Every KC comes with a twin that always occurs together with it."""
    table = steps_from_events(spark, sf)
    kc, opp = F.col("KC (Coarse)"), F.col("Opportunity (Coarse)")
    twin = table.withColumn("KC (Coarse)", F.when(kc != "", F.concat(kc, F.lit("~~"), kc, F.lit("twin"))).otherwise("")).withColumn("Opportunity (Coarse)", F.when(kc != "", F.concat(opp, F.lit("~~"), opp)).otherwise(""))
    return identify.duplicate_columns(build_afm_design(parse.observations(twin, "Coarse"), identify=False)).select("block", "col", "first")


_COMPONENTS = (
    ", g AS (SELECT DISTINCT student, kc FROM x), n AS (SELECT DISTINCT a.student AS a, b.student AS b FROM g a JOIN g b USING (kc)), "
    "r AS (SELECT student AS a, student AS b FROM g UNION SELECT r.a, n.b FROM r JOIN n ON r.b = n.a), m AS (SELECT a AS student, min(b) AS label FROM r GROUP BY a) "
)


@query(_o("Cohort").replace("WITH e AS", "WITH RECURSIVE e AS", 1) + _COMPONENTS + "SELECT component, count(*) AS students FROM (SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS component FROM m) GROUP BY component")
def components(spark, sf):
    d = build_afm_design(_obs(spark, sf, "Cohort"), identify=False)
    return identify.row_components(d).join(d.obs.select("obs_id", "student"), "obs_id").groupBy("component").agg(F.countDistinct("student").alias("students"))


@query(_o("Cohort").replace("WITH e AS", "WITH RECURSIVE e AS", 1) + _COMPONENTS + "SELECT CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS component, max(student) AS col FROM m GROUP BY label")
def reference_levels(spark, sf):
    return identify.reference_levels(build_afm_design(written(_obs(spark, sf, "Cohort"), "obs"), identify=False).kept()).select("component", "col")


@query(_o("Cohort").replace("WITH e AS", "WITH RECURSIVE e AS", 1) + _COMPONENTS + ", q AS (SELECT dense_rank() OVER (ORDER BY label) AS k, max(student) AS col FROM m GROUP BY label) SELECT CAST(k - 1 AS BIGINT) AS ord, 'student:' || col AS column, 'reference level (student/KC sum redundancy), component ' || k || ' of ' || (SELECT count(*) FROM q) AS reason FROM q")
def aliased(spark, sf):
    return build_afm_design(_obs(spark, sf, "Cohort")).aliased


_SEP = _o("Fine") + ", " + _PFA_CELLS + ", q AS (SELECT c.block, c.col, count(*) AS n, sum(o.y) AS ok FROM c JOIN o USING (obs_id) GROUP BY ALL) SELECT block, col, CAST(CASE WHEN ok = n THEN 1 ELSE -1 END AS INT) AS direction FROM q WHERE ok = n OR ok = 0"


@query(_SEP)
def separated(spark, sf):
    return identify.separated(build_pfa_design(_obs(spark, sf, "Fine"), identify=False)).select("block", "col", "direction")


@query(_o("Coarse") + ", " + _PFA_CELLS + ", l AS (SELECT DISTINCT CASE block WHEN 'kc_intercept' THEN 0 WHEN 'kc_success' THEN 1 ELSE 2 END AS b, block, col FROM c), i AS (SELECT block, col, row_number() OVER (ORDER BY b, col) - 1 AS k FROM l), d AS (SELECT obs_id, k, value FROM c JOIN i USING (block, col)) SELECT a.k AS i, b.k AS j, CAST(sum(a.value * b.value) AS DOUBLE) AS value FROM d a JOIN d b ON a.obs_id = b.obs_id AND a.k <= b.k GROUP BY ALL")
def gram_matrix(spark, sf):
    return identify.gram(build_pfa_design(_obs(spark, sf), identify=False))


@query()
def design_rank(spark, sf):
    d = build_pfa_design(_obs(spark, sf), identify=False)
    return spark.createDataFrame([(identify.rank(d), d.n_params)], "rank int, n_params int")


# ---- statistics of given weights --------------------------------------------------------------

_STAT = _o("Coarse") + ", " + _AFM_CELLS + ", " + _COLUMNS + ", " + _WEIGHTS + ", " + _PRED


@query(_o("Coarse") + "SELECT count(*) AS n, round(count(*) * ln(2), 6) AS loss FROM o")
def objective_at_zero(spark, sf):
    d = build_afm_design(_obs(spark, sf), identify=False)
    o = fit.objective(d, d.columns.select("block", "col", F.lit(0.0).alias("estimate")))
    return o.select(F.col("n_obs").alias("n"), _round("loss").alias("loss"))


@query(_o("Coarse") + ", " + _AFM_CELLS + ", " + _COLUMNS + "SELECT l.block, l.col, round(coalesce(sum(c.value * (0.5 - o.y)), 0), 6)::DOUBLE AS gradient FROM l LEFT JOIN c ON l.block = c.block AND l.col = c.col LEFT JOIN o ON c.obs_id = o.obs_id GROUP BY l.block, l.col")
def gradient_at_zero(spark, sf):
    d = build_afm_design(_obs(spark, sf), identify=False)
    return fit.gradient(d, d.columns.select("block", "col", F.lit(0.0).alias("estimate"))).select("block", "col", _round("gradient").alias("gradient"))


@query(_o("Coarse") + ", " + _AFM_CELLS + ", g AS (SELECT abs(sum(c.value * (0.5 - o.y))) AS g FROM c JOIN o USING (obs_id) GROUP BY c.block, c.col) SELECT round(max(g), 6)::DOUBLE AS max_free_gradient, round(3e-3 * sqrt((SELECT count(*) FROM o)), 6) AS tolerance, max(g) < 3e-3 * sqrt((SELECT count(*) FROM o)) AS is_optimal FROM g")
def certificate_at_zero(spark, sf):
    d = build_afm_design(_obs(spark, sf), identify=False)
    c = fit.certificate(d, d.columns.select("block", "col", F.lit(0.0).alias("estimate")))
    return c.select(_round("max_free_gradient").alias("max_free_gradient"), _round("tolerance").alias("tolerance"), "is_optimal")


@query(_STAT + "SELECT obs_id, round(p, 6) AS p FROM p")
def predict_fixed_weights(spark, sf):
    d = build_afm_design(_obs(spark, sf), learnsphere_compat=True)
    return fit.predictions(d, _weights(d)).select("obs_id", _round("p").alias("p"))


@query(_STAT + "SELECT round(avg((y - p) ** 2), 9) AS brier, round(sqrt(avg((y - p) ** 2)), 9) AS rmse FROM p")
def brier_fixed_weights(spark, sf):
    d = build_afm_design(_obs(spark, sf), learnsphere_compat=True)
    return fit.statistics(d, _weights(d)).select(_round("brier", 9).alias("brier"), _round("rmse", 9).alias("rmse"))


@query(_STAT + ", q AS (SELECT sum(ln(1 + exp(z)) - y * z) AS loss, count(*) AS n FROM p), r AS (SELECT sum(CASE WHEN block = 'student' THEN estimate ** 2 / 2 ELSE 0 END) AS pen, count(*) AS k FROM wt) SELECT n AS n_obs, k AS n_params, round(-(loss + pen), 5) AS ll, round(-loss, 5) AS ll_unpenalized, round(pen, 5) AS penalty, round(2 * (loss + pen) + 2 * k, 5) AS aic, round(2 * (loss + pen) + k * ln(n), 5) AS bic, round(2 * loss + 2 * k, 5) AS aic_unpenalized, round(2 * loss + k * ln(n), 5) AS bic_unpenalized FROM q, r")
def aic_bic_fixed_weights(spark, sf):
    d = build_afm_design(_obs(spark, sf), learnsphere_compat=True)
    s = fit.statistics(d, _weights(d))
    return s.select("n_obs", "n_params", *[_round(c, 5).alias(c) for c in ("ll", "ll_unpenalized", "penalty", "aic", "bic", "aic_unpenalized", "bic_unpenalized")])


@query(_STAT + ", q AS (SELECT col AS student, estimate FROM wt WHERE block = 'student') SELECT student, round(estimate - (SELECT avg(estimate) FROM q), 9) AS estimate, round((SELECT avg(estimate) FROM q), 9) AS shift FROM q")
def centred_students_fixed_weights(spark, sf):
    d = build_afm_design(_obs(spark, sf), learnsphere_compat=True)
    return fit.centred_students(d, _weights(d)).select("student", _round("estimate", 9).alias("estimate"), _round("shift", 9).alias("shift"))


@query(_o("Multi") + "SELECT kc, count(DISTINCT item) AS steps FROM x GROUP BY kc")
def kc_unique_steps(spark, sf):
    return _obs(spark, sf, "Multi").select("item", F.explode("kcs.kc").alias("kc")).groupBy("kc").agg(F.countDistinct("item").alias("steps"))


@query(_STAT + "SELECT e.row_id, round(1 - p.p, 6) AS error_rate FROM e LEFT JOIN p ON e.row_id = p.obs_id")
def annotate_blank_rows(spark, sf):
    table = steps_from_events(spark, sf)
    d = build_afm_design(parse.observations(table, "Coarse"), learnsphere_compat=True)
    p = fit.predictions(d, _weights(d)).select(F.col("obs_id").alias("row_id"), "p")
    return table.join(p, "row_id", "left").select("row_id", _round(1 - F.col("p")).alias("error_rate"))


# ---- folds and scores -------------------------------------------------------------------------

_KFOLD = _o("Coarse").replace("WITH e AS", "WITH RECURSIVE e AS", 1) + (
    ", q AS (SELECT item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, item) AS k FROM o GROUP BY item), "
    "a AS (SELECT CAST(0 AS BIGINT) AS k, '' AS item, 0 AS fold, CAST(0 AS BIGINT) AS w0, CAST(0 AS BIGINT) AS w1, CAST(0 AS BIGINT) AS w2 "
    "UNION ALL SELECT q.k, q.item, CASE WHEN w0 <= w1 AND w0 <= w2 THEN 0 WHEN w1 <= w2 THEN 1 ELSE 2 END, "
    "w0 + CASE WHEN w0 <= w1 AND w0 <= w2 THEN q.n ELSE 0 END, w1 + CASE WHEN w1 < w0 AND w1 <= w2 THEN q.n ELSE 0 END, "
    "w2 + CASE WHEN w2 < w0 AND w2 < w1 THEN q.n ELSE 0 END FROM a JOIN q ON q.k = a.k + 1), "
    "fo AS (SELECT o.obs_id, CAST(a.fold AS INT) AS fold FROM o JOIN a ON o.item = a.item) "
)


@query(_KFOLD + "SELECT * FROM fo")
def label_kfold(spark, sf):
    return folds.make_folds(_obs(spark, sf), "item_blocked")


@query(_o("Coarse") + ", s AS (SELECT unnest(['item_blocked', 'student_blocked', 'unstratified', 'response_stratified']) AS scheme) SELECT scheme, (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM o) AS n_distinct, CAST(0 AS BIGINT) AS straddling FROM s")
def fold_partition_invariants(spark, sf):
    obs = written(_obs(spark, sf).select("obs_id", "y", "student", "item"), "obs")
    out = None
    for scheme in folds.SCHEMES:
        f = folds.make_folds(obs, scheme, seed=3)
        label = folds.LABEL.get(scheme)
        cut = f.join(obs, "obs_id").groupBy(label).agg(F.countDistinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1).alias("straddling")) if label else spark.createDataFrame([(0,)], "straddling long")
        one = f.agg(F.lit(scheme).alias("scheme"), F.count("*").alias("n"), F.countDistinct("obs_id").alias("n_distinct")).crossJoin(cut)  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(_KFOLD + ", " + _AFM_CELLS.replace("'kc_slope', kc, opp", "'kc_slope', kc, CAST(opp AS DOUBLE)") + ", cf AS (SELECT c.*, fold FROM c JOIN fo USING (obs_id)), t AS (SELECT block, col, fold, count(*) AS n FROM cf GROUP BY ALL), u AS (SELECT block, col, fold FROM (SELECT *, sum(n) OVER (PARTITION BY block, col) AS a FROM t) WHERE n = a), h AS (SELECT DISTINCT obs_id FROM cf JOIN u USING (block, col, fold)) SELECT fold, count(*) AS n_test, count(h.obs_id) AS unseen FROM fo LEFT JOIN h USING (obs_id) GROUP BY fold")
def unseen_columns(spark, sf):
    obs = _obs(spark, sf)
    return folds.unseen_rows(build_afm_design(obs, identify=False), folds.make_folds(obs, "item_blocked"))


@query(_BASE + "n AS (SELECT count(*) FILTER ((kc_coarse = '') <> (kc_cohort = '')) AS ab, count(*) FILTER ((kc_coarse = '') <> (kc_fine = '')) AS ac, count(*) FILTER ((kc_fine = '') <> (kc_multi = '')) AS cd FROM e) SELECT 'Coarse' AS a, 'Cohort' AS b, ab = 0 AS same FROM n UNION ALL SELECT 'Coarse', 'Fine', ac = 0 FROM n UNION ALL SELECT 'Fine', 'Multi', cd = 0 FROM n")
def coverage_equality(spark, sf):
    pairs = (("Coarse", "Cohort"), ("Coarse", "Fine"), ("Fine", "Multi"))
    return spark.createDataFrame([(a, b, folds.same_coverage(_obs(spark, sf, a), _obs(spark, sf, b))) for a, b in pairs], "a string, b string, same boolean")


def _kc_mean_folds(spark, sf) -> DataFrame:
    """Held-out scores of a simple predictor: the training mean of a row's first KC, per model."""
    out = None
    fold = written(folds.make_folds(written(_obs(spark, sf).select("obs_id", "item"), "obs"), "item_blocked"), "folds")
    for m in ("Coarse", "Cohort"):
        x = written(_obs(spark, sf, m).select("obs_id", "y", F.col("kcs")[0]["kc"].alias("kc")).join(fold.hint("merge"), "obs_id"), "rows")
        per = x.groupBy("kc", "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
        every = per.groupBy("kc").agg(F.sum("s").alias("sa"), F.sum("n").alias("na"))
        mean = per.join(every, "kc").select("kc", "fold", ((F.col("sa") - F.col("s") + 1) / (F.col("na") - F.col("n") + 2)).alias("p"))
        sq = F.pow(F.col("y") - F.col("p"), 2)
        one = x.join(mean, ["kc", "fold"]).groupBy("fold").agg(F.count("*").alias("n_test"), F.sum(sq).alias("sse"), F.sqrt(F.avg(sq)).alias("rmse"))
        one = one.select(F.lit(m).alias("model"), F.lit(0).cast("long").alias("seed"), "fold", "n_test", "sse", "rmse", F.lit(0.0).alias("unseen_column_fraction"), F.lit(True).alias("converged"))
        out = one if out is None else out.unionByName(one)
    return written(out, "scores")


_SCORES = _KFOLD + (
    ", b AS (SELECT 'Coarse' AS model, obs_id, y, cell AS kc FROM o UNION ALL SELECT 'Cohort', o.obs_id, o.y, e.kc_cohort FROM o JOIN e ON e.row_id = o.obs_id), bf AS (SELECT b.*, fold FROM b JOIN fo USING (obs_id)), "
    "t AS (SELECT model, kc, fold, sum(y) AS s, count(*) AS n FROM bf GROUP BY ALL), tt AS (SELECT model, kc, fold, (sum(s) OVER w - s + 1.0) / (sum(n) OVER w - n + 2) AS p FROM t WINDOW w AS (PARTITION BY model, kc)), "
    "sc AS (SELECT model, fold, count(*) AS n_test, sum((y - p) ** 2) AS sse, sqrt(avg((y - p) ** 2)) AS rmse FROM bf JOIN tt USING (model, kc, fold) GROUP BY model, fold) "
)


@query(_SCORES + "SELECT 'per_fold' AS convention, model, round(avg(rmse), 9) AS rmse FROM sc GROUP BY model UNION ALL SELECT 'pooled', model, round(sqrt(sum(sse) / sum(n_test)), 9) FROM sc GROUP BY model")
def paired_scores(spark, sf):
    f = _kc_mean_folds(spark, sf)
    one = lambda c: crossval.paired_scores(f, c).select(F.lit(c).alias("convention"), "model", _round("rmse", 9).alias("rmse"))
    return one("per_fold").unionByName(one("pooled"))


@query(_SCORES + ", d AS (SELECT a.model, a.rmse - b.rmse AS diff FROM sc a JOIN sc b USING (fold) WHERE a.model <> 'Coarse' AND b.model = 'Coarse') SELECT model, round(avg(diff), 9) AS mean_diff, round(stddev_samp(diff), 9) AS sd_diff, count(diff) AS n_folds, count(*) FILTER (diff < 0) AS folds_better, 'Coarse' AS baseline FROM d GROUP BY model")
def paired_contrasts(spark, sf):
    c = crossval.paired_contrasts(_kc_mean_folds(spark, sf), "Coarse")
    return c.withColumns({"mean_diff": _round("mean_diff", 9), "sd_diff": _round("sd_diff", 9)})


@query(_SCORES + "SELECT min_by(model, rmse) AS baseline FROM (SELECT model, sqrt(sum(sse) / sum(n_test)) AS rmse FROM sc GROUP BY model)")
def default_baseline(spark, sf):
    return spark.createDataFrame([(crossval.default_baseline(crossval.paired_scores(_kc_mean_folds(spark, sf))),)], "baseline string")


# ---- fits (no SQL: iterative) -----------------------------------------------------------------


def _stats(spark: SparkSession, f: fit.Fit) -> DataFrame:
    row = (f.label, f.n_obs, f.n_params, round(f.ll, 4), round(f.aic, 4), round(f.bic, 4), round(f.rmse, 6), bool(f.is_optimal), sum(f.separated_blocks().values()))
    return spark.createDataFrame([row], "label string, n_obs long, n_params int, ll double, aic double, bic double, rmse double, is_optimal boolean, n_separated int")


def _steps(spark: SparkSession, sf: str, model: str = "Coarse") -> parse.Steps:
    return parse.from_frame(steps_from_events(spark, sf), model)


@query()
def afm_fit(spark, sf):
    return _stats(spark, fit.fit_afm(_steps(spark, sf)))


@query()
def afm_bounded_fit(spark, sf):
    return _stats(spark, fit.fit_afm(_steps(spark, sf), bound_slopes=True, learnsphere_compat=True))


@query()
def pfa_fit(spark, sf):
    return _stats(spark, fit.fit_pfa(_steps(spark, sf)))


@query()
def pfa_pooled_inclusive_fit(spark, sf):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _stats(spark, fit.fit_pfa(_steps(spark, sf), slopes="pooled", counts="inclusive"))


@query()
def pfa_distributed_fit(spark, sf):
    return _stats(spark, fit.fit_pfa(_steps(spark, sf), slopes="pooled", fit_options={"mode": "distributed"}))


@query()
def afm_kc_values(spark, sf):
    steps = _steps(spark, sf)
    return fit.fit_afm(steps).kc_values(steps)


@query()
def pfa_kc_values(spark, sf):
    steps = _steps(spark, sf)
    return fit.fit_pfa(steps, student_intercepts=True).kc_values(steps)


@query()
def annotate_fit(spark, sf):
    steps = _steps(spark, sf)
    return fit.fit_pfa(steps).annotate(steps).select("row_id", F.col("`Predicted Error Rate (Coarse)`").alias("error_rate"))


@query()
def coefficient_frame(spark, sf):
    return fit.coefficient_frame(fit.fit_pfa(_steps(spark, sf)))


@query()
def cross_validate(spark, sf):
    return crossval.cross_validate(build_pfa_design(_obs(spark, sf)), n_jobs=-1).frame


@query()
def repeated_cross_validate(spark, sf):
    return crossval.repeated_cross_validate(build_pfa_design(_obs(spark, sf)), seeds=[0, 1, 2], n_jobs=-1)


@query()
def paired_cross_validate(spark, sf):
    designs = {"AFM": build_afm_design(_obs(spark, sf)), "PFA": build_pfa_design(_obs(spark, sf))}
    return crossval.paired_cross_validate(designs, seeds=[0, 1], n_jobs=-1)


# ---- fits with a closed form: KC intercepts alone give each KC's success rate -------------------


def _intercepts(obs: DataFrame) -> Design:
    d = build_pfa_design(written(obs, "obs"), identify=False)
    return d.without(d.columns.where("block <> 'kc_intercept'"))


_RATE = _o("Coarse") + ", r AS (SELECT cell AS kc, sum(y) AS s, count(*) AS n FROM o GROUP BY cell), q AS (SELECT kc, s, n, CAST(s AS DOUBLE) / n AS p FROM r WHERE s > 0 AND s < n) "


@query(_RATE + "SELECT 'kc_intercept' AS block, kc AS col, round(ln(s / (n - s)), 5) AS estimate FROM q")
def intercept_fit(spark, sf):
    f = fit.fit_logistic(_intercepts(_obs(spark, sf)))
    return f.coefficients.select("block", "col", _round("estimate", 5).alias("estimate"))


@query(_RATE + ", t AS (SELECT sum(s * ln(p) + (n - s) * ln(1 - p)) AS ll, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS INT) AS k, sum(s * (1 - p) ** 2 + (n - s) * p ** 2) / sum(n) AS brier FROM q) SELECT n AS n_obs, k AS n_params, round(ll, 4) AS ll, round(2 * k - 2 * ll, 4) AS aic, round(k * ln(n) - 2 * ll, 4) AS bic, round(sqrt(brier), 6) AS rmse FROM t")
def intercept_fit_statistics(spark, sf):
    f = fit.fit_logistic(_intercepts(_obs(spark, sf)))
    row = (f.n_obs, f.n_params, round(f.ll, 4), round(f.aic, 4), round(f.bic, 4), round(f.rmse, 6))
    return spark.createDataFrame([row], "n_obs long, n_params int, ll double, aic double, bic double, rmse double")


_HELD = _KFOLD + (
    ", b AS (SELECT 'Coarse' AS model, obs_id, y, cell AS kc FROM o UNION ALL SELECT 'Cohort', o.obs_id, o.y, e.kc_cohort FROM o JOIN e ON e.row_id = o.obs_id), bf AS (SELECT b.*, fold FROM b JOIN fo USING (obs_id)), "
    "t AS (SELECT model, kc, fold, sum(y) AS s, count(*) AS n FROM bf GROUP BY ALL), tt AS (SELECT model, kc, fold, sum(s) OVER w - s AS st, sum(n) OVER w - n AS nt FROM t WINDOW w AS (PARTITION BY model, kc)), "
    "sc AS (SELECT model, fold, count(*) AS n_test, sum((y - CASE WHEN nt = 0 THEN 0.5 ELSE CAST(st AS DOUBLE) / nt END) ** 2) AS sse, avg(CASE WHEN nt = 0 THEN 1.0 ELSE 0.0 END) AS unseen FROM bf JOIN tt USING (model, kc, fold) GROUP BY model, fold) "
)


@query(_HELD + "SELECT fold, (SELECT count(*) FROM fo) - n_test AS n_train, n_test, round(sqrt(sse / n_test), 5) AS rmse, round(unseen, 6) AS unseen_column_fraction FROM sc WHERE model = 'Coarse'")
def intercept_cross_validate(spark, sf):
    f = crossval.cross_validate(_intercepts(_obs(spark, sf)), n_jobs=-1).frame
    return f.select("fold", "n_train", "n_test", _round("rmse", 5).alias("rmse"), _round("unseen_column_fraction").alias("unseen_column_fraction"))


@query(_HELD + ", d AS (SELECT sqrt(a.sse / a.n_test) - sqrt(b.sse / b.n_test) AS diff FROM sc a JOIN sc b USING (fold) WHERE a.model = 'Cohort' AND b.model = 'Coarse') SELECT 'Cohort' AS model, round(avg(diff), 5) AS mean_diff, round(stddev_samp(diff), 5) AS sd_diff, count(*) AS n_folds, 'Coarse' AS baseline FROM d")
def intercept_paired_contrasts(spark, sf):
    designs = {m: _intercepts(_obs(spark, sf, m)) for m in ("Coarse", "Cohort")}
    folds_ = crossval.paired_cross_validate(designs, seeds=(None,), convention="per_fold", n_jobs=-1)
    c = crossval.paired_contrasts(spark.createDataFrame(folds_.toArrow()), "Coarse")
    return c.select("model", _round("mean_diff", 5).alias("mean_diff"), _round("sd_diff", 5).alias("sd_diff"), "n_folds", "baseline")


_SHARES = _o("Coarse") + ", h AS (SELECT obs_id, y, md5('3:' || obs_id) AS h FROM o), r AS (SELECT obs_id, 0 AS c, row_number() OVER (ORDER BY h, obs_id) - 1 AS k, count(*) OVER () AS n, 'unstratified' AS scheme FROM h UNION ALL SELECT obs_id, y, row_number() OVER (PARTITION BY y ORDER BY h, obs_id) - 1, count(*) OVER (PARTITION BY y), 'response_stratified' FROM h) "


@query(_SHARES + "SELECT scheme, obs_id, CAST(CASE WHEN k < (n % 3) * (n // 3 + 1) THEN k // (n // 3 + 1) ELSE n % 3 + (k - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INT) AS fold FROM r")
def row_kfold(spark, sf):
    obs, out = _obs(spark, sf), None
    for scheme in ("unstratified", "response_stratified"):
        one = folds.make_folds(obs, scheme, seed=3).select(F.lit(scheme).alias("scheme"), "obs_id", "fold")
        out = one if out is None else out.unionByName(one)
    return out


def _u(*key: str) -> str:
    return "CAST(('0x' || substr(md5(concat_ws(':', '7', " + ", ".join(key) + ")), 1, 8)) AS BIGINT) / 4294967296.0"


@query(
    "WITH a AS (SELECT range AS row_id, range // 40 AS s, range % 40 AS t FROM range(480)), z AS (SELECT *, (2 * " + _u("'student'", "s") + " - 1) + (2 * " + _u("'ease'", "t % 4") + " - 1) + 0.3 * " + _u("'slope'", "t % 4") + " * (t // 4) AS z FROM a) "
    "SELECT row_id, printf('S%03d', s) AS student, CASE WHEN " + _u("'attempt'", "row_id") + " < 1 / (1 + exp(-z)) THEN 'correct' ELSE 'incorrect' END AS attempt, 'topic' || (t % 4) AS topic, CAST(t // 4 + 1 AS VARCHAR) AS topic_opportunity, 'skill' || (t % 12) AS skill, CAST(t // 12 + 1 AS VARCHAR) AS skill_opportunity FROM z"
)
def synthetic_steps(spark, sf):
    names = {"Anon Student Id": "student", "First Attempt": "attempt", "KC (Topics)": "topic", "Opportunity (Topics)": "topic_opportunity", "KC (Skills)": "skill", "Opportunity (Skills)": "skill_opportunity"}
    return make_steps(spark).select("row_id", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])
