"""The analytics engine on small literal tables: parsing, histories, designs, fits, folds, programs."""

from __future__ import annotations

import itertools
import math
import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from practicum import cli
from practicum.functions.numeric import parse_seeds, sigmoid
from practicum.operators import folds, history, identify, parse, solver
from practicum.operators.graph import student_components
from practicum.plans import crossval, fit
from practicum.plans.design import accumulator_block, build_afm_design, build_pfa_design
from practicum.sources.steps import kc_models, list_kc_models, read_export, with_row_ids, write_table

COLUMNS = ["Anon Student Id", "Problem Name", "Step Name", "First Attempt", "KC (M)", "Opportunity (M)"]


def frame(spark, rows, columns=COLUMNS):
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id long, {schema}")


def minimal(students=6, reps=4, steps=3):
    count, out = {}, []
    for s, r, k in itertools.product(range(students), range(reps), range(steps)):
        kc = f"kc{k % 2}"
        count[s, kc] = count.get((s, kc), 0) + 1
        out.append((f"s{s}", f"p{k}", f"st{k}", "correct" if (s + k + r) % 3 else "incorrect", kc, str(count[s, kc])))
    return out


@pytest.fixture(scope="module")
def steps(spark):
    return parse.from_frame(frame(spark, minimal()), "M")


def kcs(obs):
    return {r.obs_id: [(k.kc, k.opp) for k in r.kcs] for r in obs.collect()}


def test_parse_rules(spark):
    rows = [("a", "p", "s", " Correct ", "A~~B~~A", "1~~2~~5"), ("a", "p", "s", "hint", "", "9"), ("b", "p", "t", "UNKNOWN", "~~A~~", " 3 "), ("b", "p", "t", "x", None, None)]
    s = parse.from_frame(frame(spark, rows), "M")
    assert kcs(s.obs) == {0: [("A", 4), ("B", 1)], 2: [("A", 2)]}
    assert (s.skipped_no_kc, s.duplicate_kc_rows, s.n_obs) == (2, 1, 2)
    got = {r.obs_id: (r.y, r.item) for r in s.obs.collect()}
    assert got == {0: (1, "p##s"), 2: (0, "p##t")}
    assert ["rows", "without", "KC", "2"] in [line.split() for line in s.summary().splitlines()]


@pytest.mark.parametrize(
    "rows,message",
    [
        ([("a", "p", "s", "correct", "A~~B", "1")], "Row 2: 2 labels against 1"),
        ([("a", "p", "s", "correct", "A", "1"), ("a", "p", "s", "correct", "A", "1.5")], "Row 3: not a whole number"),
        ([("a", "p", "s", "correct", "", "")], "every row is without a KC"),
        ([("a", "p", "s", "right", "A", "1"), ("a", "p", "s", "right", "A", "2")], r"'right' \(2 rows\)"),
        ([("a", "p", "s", "correct", "A", "0"), ("a", "p", "s", "hint", "A", "1")], "below 1"),
    ],
)
def test_parse_errors(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        parse.from_frame(frame(spark, rows), "M")


def test_missing_columns_and_constant_response(spark):
    with pytest.raises(KeyError, match="M"):
        parse.from_frame(frame(spark, minimal()), "Other")
    with pytest.warns(RuntimeWarning, match="success"):
        parse.from_frame(frame(spark, [("a", "p", "s", "correct", "A", "1")]), "M")


def test_row_ids_follow_the_file(spark, tmp_path):
    lines = ["\t".join(COLUMNS + ["KC (N)", "First Transaction Time"])] + ["\t".join([*r, "", "t"]) for r in minimal()]
    path = tmp_path / "steps.txt"
    path.write_text("\n".join(lines) + "\n")
    table = read_export(spark, str(path))
    assert [r.row_id for r in table.orderBy("row_id").collect()] == list(range(72))
    assert list_kc_models(spark, str(path)) == kc_models(table) == ["M", "N"]
    again = with_row_ids(spark.range(100).repartition(7).drop("id").withColumn("x", F.lit(1)))
    assert sorted(r.row_id for r in again.collect()) == list(range(100))
    write_table(table, str(tmp_path / "back.txt"))
    assert (tmp_path / "back.txt").read_text() == path.read_text()


def test_time_beats_row_order(spark):
    rows = [("a", "p", "s", "correct", "A", "1", "2020-02"), ("a", "p", "t", "hint", "A", "2", "2020-01"), ("b", "p", "t", "hint", "A", "1", "2020-01")]
    obs = parse.observations(frame(spark, rows, [*COLUMNS, "First Transaction Time"]), "M")
    assert {r.obs_id: r.place for r in history.practice_order(obs).collect()} == {1: 0, 0: 1, 2: 0}
    assert kcs(history.recomputed_opportunities(obs)) == {0: [("A", 1)], 1: [("A", 0)], 2: [("A", 0)]}
    assert {r.obs_id for r in history.opportunity_disagreements(obs).collect()} == {0, 1}
    counted = {r.obs_id: (r.s, r.f) for r in history.success_failure_counts(obs).collect()}
    assert counted == {1: (0, 0), 0: (0, 1), 2: (0, 0)}


def test_range_partitioned_counts_equal_window_counts(steps):
    key = lambda d: sorted((r.obs_id, r.pos, r.seen, r.s, r.f) for r in d.collect())
    assert key(history.counters(steps.obs)) == key(history.counters(steps.obs, ranges=5))


def test_components(spark):
    edges = spark.createDataFrame([(f"s{i:02}", f"k{i}") for i in range(20)] + [(f"s{i + 1:02}", f"k{i}") for i in range(19)] + [("z", "q")], "student string, kc string")
    got = {r.student: r.label for r in student_components(edges).collect()}
    assert set(got.values()) == {"s00", "z"} and got["z"] == "z"


def test_identification_cases(spark):
    pairs = [(f"s{s}", "p", f"i{k}", "correct" if (s * 7 + k * 3) % 4 else "hint", "A~~B" if k < 3 else "C", f"{k + 1}~~{k + 1}" if k < 3 else str(k - 2)) for s in range(6) for k in range(6)]
    d = build_afm_design(parse.observations(frame(spark, pairs), "M"))
    assert [c for c, _ in d.aliased_rows()] == ["kc_intercept:B", "kc_slope:B", "student:s5"]
    assert d.aliased_rows()[0][1] == "duplicate of kc_intercept:A" and d.recentring_is_valid()
    cohorts = [(f"c{c}s{s}", "p", f"c{c}i{k}", "correct" if (s + k) % 3 else "hint", f"c{c}k{k % 2}", str(1 + k // 2)) for c in range(2) for s in range(4) for k in range(4)]
    d = build_afm_design(parse.observations(frame(spark, cohorts), "M"))
    assert d.aliased_rows() == [(f"student:c{c}s3", f"reference level (student/KC sum redundancy), component {c + 1} of 2") for c in range(2)]
    assert identify.rank(d) == d.n_params
    assert identify.tally([c for c, _ in d.aliased_rows()]) == "student 2"
    multi = [(f"s{s}", "p", f"i{k}", "correct" if (s + k) % 2 else "hint", "C" if k % 3 else "C~~D", "1" if k % 3 else "1~~1") for s in range(4) for k in range(6)]
    assert build_afm_design(parse.observations(frame(spark, multi), "M"), identify=False).kc_per_row() is None


def test_separation_flags_and_bounds(spark):
    rows = [(f"s{s}", "p", f"i{k}", "correct" if k == 0 or (s + r) % 2 else "incorrect", f"kc{k}", str(r + 1)) for s in range(10) for r in range(4) for k in range(4)]
    obs = parse.observations(frame(spark, rows), "M")
    found = {(r.block, r.col, r.direction) for r in identify.separated(build_afm_design(obs)).collect()}
    assert found == {("kc_intercept", "kc0", 1), ("kc_slope", "kc0", 1)}
    flipped = obs.withColumn("y", 1 - F.col("y"))
    bounded = identify.separated(build_afm_design(flipped, bound_slopes=True))
    assert {(r.block, r.direction) for r in bounded.collect()} == {("kc_intercept", -1)}


def dense(d):
    local, _ = solver.local_of(d)
    x = np.zeros((local.n, local.p))
    x[local.row, local.col] = local.value
    return local, x


def test_local_sums_equal_dense_algebra(steps):
    local, x = dense(build_afm_design(steps, identify=False))
    w = np.random.default_rng(0).normal(0, 0.3, local.p)
    loss, grad, hess = local.sums(w)
    p = 1 / (1 + np.exp(-x @ w))
    assert math.isclose(loss, -(local.y * np.log(p) + (1 - local.y) * np.log(1 - p)).sum())
    assert np.allclose(grad, x.T @ (p - local.y)) and np.allclose(hess, x.T @ (x * (p * (1 - p))[:, None]))
    for i in range(local.p):
        e = np.eye(local.p)[i] * 1e-6
        assert abs((local.sums(w + e, hessian=False)[0] - local.sums(w - e, hessian=False)[0]) / 2e-6 - grad[i]) < 1e-4


def test_fit_properties(steps):
    f = fit.fit_afm(steps)
    assert f.is_optimal and f.converged
    assert math.isclose(f.bic - f.aic, f.n_params * (math.log(f.n_obs) - 2))
    full = fit.fit_afm(steps, identify=False)
    assert abs(full.ll - f.ll) < 1e-6
    far = fit.fit_logistic(f.design, mode="distributed")
    assert abs(far.ll - f.ll) < 1e-7 and np.allclose(far.weights, f.weights, atol=1e-5)
    row = fit.statistics(f.design, f.coefficients).first()
    assert abs(row.ll - f.ll) < 1e-8 and abs(row.rmse - f.rmse) < 1e-10
    assert fit.certificate(f.design, f.coefficients).first().is_optimal
    pfa = fit.fit_pfa(steps, student_intercepts=True)
    assert pfa.ll >= fit.fit_afm(steps, recompute_opportunities=True).ll - 1e-6
    assert "log-likelihood" in f.summary()


def test_bounds_hold_with_the_right_sign(steps):
    f = fit.fit_afm(steps, bound_slopes=True, learnsphere_compat=True)
    columns = f.design.indexed().orderBy("col_idx").collect()
    local, _ = solver.local_of(f.design)
    grad = local.sums(f.weights, hessian=False)[1]
    for r, w, g in zip(columns, f.weights, grad, strict=True):
        if r.block == "kc_slope":
            assert w >= 0 and (w > 1e-9 or g >= -1e-6)


def test_reports(steps):
    f = fit.fit_afm(steps)
    table = f.kc_values(steps).toPandas()
    assert list(table["KC Name"]) == ["kc0", "kc1"] and list(table["Number of Unique Steps"]) == [2, 1]
    out = f.annotate(steps)
    name = "Predicted Error Rate (M)"
    assert out.columns[-1] == name and out.count() == 72
    assert f.annotate(steps, into=out).columns == out.columns
    mean = out.agg(F.avg(f"`{name}`").alias("m")).first().m
    assert abs(mean - (1 - steps.obs.agg(F.avg("y").alias("m")).first().m)) < 1e-6
    centred = f.centred_students()
    assert centred.count() == 6 and abs(centred.agg(F.sum("estimate").alias("s")).first().s) < 1e-9
    assert fit.coefficient_frame(f).count() == f.n_params
    with pytest.raises(ValueError):
        f.predict_proba(build_pfa_design(steps))


def test_pfa_report_marks_what_cannot_be_estimated(spark):
    rows = [(f"s{s}", "p", f"z{k}", "incorrect", "Z", str(k + 1)) for s in range(6) for k in range(3)]
    rows += [(f"s{s}", "p", f"a{k}", "correct" if k % 2 else "hint", "A", str(k + 1)) for s in range(6) for k in range(4)]
    s = parse.from_frame(frame(spark, rows), "M")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        table = fit.fit_pfa(s).kc_values(s).toPandas().set_index("KC Name")
    assert math.isnan(table.loc["Z", "Success Slope"]) and bool(table.loc["Z", "Separated"])


def test_accumulators(steps):
    d = build_afm_design(steps)
    cells, columns = accumulator_block(d.obs, d.obs.select("obs_id", (F.col("obs_id") % 5).alias("x"), F.lit(1).alias("y")), "extra")
    wide = d.with_blocks(cells, columns)
    assert wide.blocks()[-1] == "extra" and wide.n_params == d.n_params + 2
    with pytest.raises(ValueError):
        accumulator_block(d.obs, d.obs.limit(3).select("obs_id", F.lit(1).alias("x")), "short")
    with pytest.raises(ValueError):
        d.with_blocks(d.cells, d.columns)
    with pytest.warns(UserWarning):
        build_pfa_design(steps, counts="inclusive")
    with pytest.raises(ValueError):
        build_pfa_design(steps, slopes="x")


@pytest.mark.parametrize("scheme", folds.SCHEMES)
def test_folds_partition_and_repeat(steps, scheme):
    a = {r.obs_id: r.fold for r in folds.make_folds(steps.obs, scheme, seed=5, convention="pooled").collect()}
    assert a == {r.obs_id: r.fold for r in folds.make_folds(steps.obs, scheme, seed=5, convention="pooled").collect()}
    assert len(a) == 72 and set(a.values()) == {0, 1, 2}
    if scheme in folds.LABEL:
        label = {r.obs_id: r[folds.LABEL[scheme]] for r in steps.obs.collect()}
        assert len({(label[i], f) for i, f in a.items()}) == len(set(label.values()))


def test_fold_rules():
    assert folds.label_kfold([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert parse_seeds("0:3") == [0, 1, 2] and parse_seeds(" 4,,7, ") == [4, 7] and parse_seeds("0:2,9") == [0, 1, 9] and parse_seeds("") is parse_seeds("0:0") is parse_seeds(None) is None
    with pytest.raises(ValueError, match="cannot fill"):
        folds.shuffled_labels(["a"], 3, np.random.default_rng(0))


def test_paired_cross_validation(spark, steps):
    designs = {"AFM": build_afm_design(steps), "PFA": build_pfa_design(steps)}
    one = crossval.paired_cross_validate(designs, seeds=[0, 1], n_folds=2, scheme="student_blocked").toPandas()
    many = crossval.paired_cross_validate(designs, seeds=[0, 1], n_folds=2, scheme="student_blocked", n_jobs=-1).toPandas()
    key = ["seed", "fold", "model"]
    pd.testing.assert_frame_equal(one.sort_values(key, ignore_index=True), many.sort_values(key, ignore_index=True))
    table = spark.createDataFrame(one.astype({"seed": "int64"}))
    contrasts = crossval.paired_contrasts(table, "AFM").toPandas()
    wide = one.pivot(index=["seed", "fold"], columns="model", values="rmse")
    assert math.isclose(contrasts["mean_diff"][0], (wide["PFA"] - wide["AFM"]).mean())
    assert crossval.paired_contrasts(table.where("model = 'AFM'"), "AFM").count() == 0
    with pytest.raises(KeyError):
        crossval.paired_contrasts(table, "none")
    rest = crossval.repeated_cross_validate(designs["PFA"], seeds=[0, 1], n_folds=2, scheme="student_blocked", convention="pooled").toPandas()
    pooled = crossval.paired_scores(table.where("model = 'PFA'"), "pooled").toPandas()
    assert np.allclose(sorted(rest["rmse"]), sorted(pooled["rmse"]))


def test_sigmoid_is_stable(spark):
    row = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "z double").select(sigmoid(F.col("z")).alias("p")).collect()
    assert [r.p for r in row] == [0.0, 0.5, 1.0]


def export_of(tmp_path, blank=False):
    lines = ["\t".join([*COLUMNS, "KC (N/2)", "Opportunity (N/2)"])]
    for i, r in enumerate(minimal()):
        lines.append("\t".join([*r, *(("", "") if blank and i == 4 else (r[4] + "x", r[5]))]))
    path = tmp_path / "export.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_program_writes_everything(spark, tmp_path, capsys):
    path = export_of(tmp_path)
    out = {k: str(tmp_path / k) for k in ("out", "contrasts", "cv-folds", "identification", "kc-values", "predictions")}
    assert cli.main([path, "--seeds", "0:2", "--folds", "2", "--cv", "student_blocked", *itertools.chain(*((f"--{k}", v) for k, v in out.items()))]) == 0
    table = pd.read_csv(out["out"])
    assert list(table["kc_model"]) == ["M", "N/2"] and {"cv_rmse", "cv_rmse_sd", "n_aliased", "bic"} <= set(table.columns)
    assert len(pd.read_csv(out["contrasts"])) == 1 and len(pd.read_csv(out["cv-folds"])) == 8
    assert list(pd.read_csv(out["identification"]).columns) == ["kc_model", "column", "reason"]
    assert (tmp_path / "kc-values" / "N_2_kc-values.csv").exists()
    back = pd.read_csv(out["predictions"], sep="\t", dtype=str)
    assert len(back) == 72 and {"Predicted Error Rate (M)", "Predicted Error Rate (N/2)"} <= set(back.columns)
    assert "paired contrasts" in capsys.readouterr().out


def test_program_falls_back_and_refuses(spark, tmp_path, capsys):
    path = export_of(tmp_path, blank=True)
    missing = tmp_path / "contrasts.csv"
    assert cli.main_pfa([path, "--folds", "2", "--cv", "item_blocked", "--convention", "per_fold", "--contrasts", str(missing)]) == 0
    assert not missing.exists() and "independent" in capsys.readouterr().err
    assert cli.main([path, "--list-models"]) == 0 and capsys.readouterr().out.split() == ["M", "N/2"]
    assert cli.main([path, "--kc-model", "Q"]) == 1
    assert cli.main([path, "--baseline", "Q"]) == 1
    assert cli.main([path, "--cv", "none", "--cv", "item_blocked"]) == 1


def test_list_models_of_a_plain_file_and_parity_of_defaults(spark, tmp_path, capsys):
    plain = tmp_path / "plain.txt"
    plain.write_text("a\tb\n1\t2\n")
    assert cli.main([str(plain), "--list-models"]) == 0 and "no KC models" in capsys.readouterr().out
    assert cli.main([str(plain)]) == 1
    args = cli.build_parser("pfa").parse_args(["x", "--method", "TNC"])
    assert (args.convention, args.jobs, args.folds, args.max_fun) == ("per_fold", 1, 3, 100)


def test_synthetic_table_is_seeded_and_fits(spark):
    from practicum.sources.synthetic import synthetic_steps

    table = synthetic_steps(spark)
    assert table.count() == 480 and table.exceptAll(synthetic_steps(spark).repartition(3)).isEmpty()
    assert not table.exceptAll(synthetic_steps(spark, seed=8)).isEmpty()
    steps = parse.from_frame(table, "Skills")
    assert steps.n_obs == 480 and steps.obs.select("student").distinct().count() == 12


def test_two_hundred_folds(spark, steps):
    kept = folds.row_folds(spark.range(2000).selectExpr("id AS obs_id", "CAST(id % 3 = 0 AS INT) AS y"), 200, 1, stratified=True).toPandas()
    assert kept["fold"].nunique() == 200 and kept.groupby("fold").size().between(9, 11).all()


def test_streamed_counters_equal_batch(spark, tmp_path, steps):
    from practicum.streaming.history import OUT, stream_counters

    rows = history.counters(steps.obs).orderBy("obs_id").collect()
    source = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame([(r.obs_id, r.student, r.kc, r.y, (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=r.obs_id)).to_pydatetime()) for r in rows[part * 24 : part * 24 + 24]], "obs_id long, student string, kc string, y int, at timestamp").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("obs_id long, student string, kc string, y int, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = stream_counters(stream, watermark="1 day").writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.obs_id, r.kc): (r.seen, r.s, r.f) for r in spark.table("counted").select(*[c.split()[0] for c in OUT.split(", ")]).collect()}
    assert got == {(r.obs_id, r.kc): (r.seen, r.s, r.f) for r in rows}


def test_shared_modules_do_not_import_the_text_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "practicum"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert ".llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_cross_validation_of_designs_beyond_one_process(spark, steps, monkeypatch):
    design, options = {"PFA": build_pfa_design(steps)}, {"n_folds": 2, "scheme": "student_blocked", "max_iter": 2}
    local = crossval.paired_cross_validate(design, **options).toPandas()
    monkeypatch.setattr(crossval.solver, "LOCAL_CELLS", 10)
    spread = crossval.paired_cross_validate(design, **options).toPandas()
    key = ["seed", "fold", "model"]
    pd.testing.assert_frame_equal(local.sort_values(key, ignore_index=True), spread.sort_values(key, ignore_index=True))


def test_duplicate_labels_are_found_among_all_rows(spark, monkeypatch):
    from practicum import queries

    sf, real, given = "/root/testdata/sf0.001", queries.parse.parsed_rows, []
    monkeypatch.setattr(queries.parse, "parsed_rows", lambda table, model: (given.append(table), real(table, model))[1])
    got = queries.duplicate_kc_rows(spark, sf).collect()
    rows = queries.steps_from_events(spark, sf).select("row_id", F.substring("KC (Fine)", 2, 9).cast("int").alias("k")).collect()
    assert given[0].count() == len(rows)
    assert {tuple(r) for r in got} == {(r.row_id, f"d{r.k // 10}", 2, 1) for r in rows if r.k % 5 == 0}


@pytest.fixture
def beyond_one_process(monkeypatch):
    """Every design is packed, and blocks of more than three columns may be wide; gives the sizes of the systems solved."""
    from practicum.operators import packed

    sizes, step = [], solver._solve_step
    monkeypatch.setattr(solver, "LOCAL_CELLS", 10)
    monkeypatch.setattr(packed, "NARROW", 3)
    monkeypatch.setattr(solver, "_solve_step", lambda h, *more: (sizes.append(len(h)), step(h, *more))[1])
    return sizes


@pytest.mark.parametrize("options", [{}, {"identify": False}, {"learnsphere_compat": True, "bound_slopes": True}])
def test_students_are_solved_for_outside_the_driver(steps, options, beyond_one_process):
    near = fit.fit_logistic(build_afm_design(steps, **options), mode="local")
    beyond_one_process.clear()
    far = fit.fit_logistic(build_afm_design(steps, **options))
    assert max(beyond_one_process, default=0) <= 4  # two KCs' intercepts and slopes, no students
    for fact in ("ll", "ll_unpenalized", "penalty", "brier", "n_obs", "n_params"):
        assert math.isclose(getattr(near, fact), getattr(far, fact), rel_tol=1e-9, abs_tol=1e-9), fact
    assert far.is_optimal and np.allclose(near.weights, far.weights, atol=1e-5)


def test_rank_and_scores_without_a_matrix_of_all_columns(steps, beyond_one_process, monkeypatch):
    d = build_afm_design(steps, identify=False)
    assert identify.rank(d) == d.n_params - 1 and identify.rank(build_afm_design(steps)) == d.n_params - 1
    options, key = {"n_folds": 2, "scheme": "student_blocked", "seeds": [0, 1]}, ["seed", "fold", "model"]
    far = crossval.paired_cross_validate({"AFM": build_afm_design(steps)}, **options).toPandas()
    monkeypatch.setattr(solver, "LOCAL_CELLS", 1000)
    near = crossval.paired_cross_validate({"AFM": build_afm_design(steps)}, **options).toPandas()
    pd.testing.assert_frame_equal(near.sort_values(key, ignore_index=True), far.sort_values(key, ignore_index=True), rtol=1e-6)
    assert near["unseen_column_fraction"].max() == 1


def test_packed_rows_hold_whole_groups(monkeypatch):
    import pyarrow as pa

    from practicum.operators import packed

    monkeypatch.setattr(packed, "ROWS", 10)
    size = {"a": 3, "b": 25, "c": 1, "d": 8, "e": 8}
    grp = [None] * 13 + [g for g, n in size.items() for _ in range(n)]
    n = len(grp)
    cells = [[{"idx": i % 4, "value": float(i)}] * (i % 3) for i in range(n)]
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("value", pa.float64())]))
    t = pa.table({"y": pa.array([i % 2 for i in range(n)], pa.int32()), "cells": pa.array(cells, kind), "grp": pa.array(grp, pa.string()), "gvalue": pa.array([1.0] * n), "fold0": pa.array(range(n), pa.int32())})
    out = list(packed.packed_rows(iter(t.to_batches(max_chunksize=4)), 4, 1))
    found, seen = [b for x in out for b in packed.blocks([x], 4)], []
    assert [f for b in found for f in b.folds[0]] == list(range(n))
    for b in found:
        assert b.local.row.tolist() == [i for i, f in enumerate(b.folds[0]) for _ in cells[f]]
        assert b.local.value.tolist() == [x["value"] for f in b.folds[0] for x in cells[f]]
        assert [b.names[g] if g >= 0 else None for g in b.grp] == [grp[f] for f in b.folds[0]]
        seen += b.names
    assert sorted(seen) == sorted(size)


def test_lone_outcomes_and_steep_offsets_have_roots():
    from practicum.operators.packed import roots

    z, y, g = np.array([0.0, 1, 40, -35, 2, 3, -60, 0.5]), np.array([1.0, 0, 0, 1, 1, 1, 0, 0]), np.array([0, 0, 1, 1, 2, 2, 3, 3])
    t = roots(z, y, np.ones(8), g, 5, 0.0)
    slope = np.bincount(g, solver.expit(z + t[g]) - y, 5)
    assert np.abs(slope).max() < 2e-9 and t[2] > 15 and t[3] < -15 and t[4] == 0


def test_folds_and_scores_are_found_once(spark, steps, monkeypatch):
    from practicum import queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(folds.make_folds(steps.obs, "response_stratified", seed=1))
    assert "Join" not in plan(queries._kc_mean_folds(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(identify, "row_components", None)  # a row per observation is not needed
    got = identify.reference_levels(build_afm_design(steps, identify=False)).collect()
    assert [(r.component, r.col, r.n_components) for r in got] == [(0, "s5", 1)]
