import numpy as np
import pytest
from pyspark.sql import functions as F

import textbook
from conftest import RATINGS
from lacuna import BiScale, CompletionModel, SoftImpute, SoftImputeALS
from lacuna.operators import split
from lacuna.plans import tuning
from lacuna.plans.estimators import multiple_imputations
from lacuna.sources import ratings as R
from lacuna.streaming.scoring import score_stream

PAIRS = "row_id bigint, col_id bigint"


@pytest.fixture(scope="module")
def model(vignette):
    return SoftImputeALS(max_rank=2, shrinkage_value=0.3, max_iters=2, center_max_iter=2, init="integer").fit(vignette)


def test_sources_of_a_score(spark, model):
    pairs = spark.createDataFrame([(0, 0), (1, 1), (6, 0), (0, 5), (-1, 2), (0, 0)], PAIRS)
    got = sorted((r["row_id"], r["col_id"], r["source"]) for r in model.transform(pairs).collect())
    assert got == [(-1, 2, "out_of_range"), (0, 0, "observed"), (0, 0, "observed"), (0, 5, "out_of_range"),
                   (1, 1, "model"), (6, 0, "out_of_range")]
    assert model.predict(0, 0) == 0.86548894
    by_model = model.copy({model.getParam("observed"): "model"})
    assert by_model.predict(0, 0) != 0.86548894
    strict = model.copy({model.getParam("strict"): True})
    with pytest.raises(Exception, match="out_of_range"):
        strict.transform(pairs).collect()
    clipped = by_model.copy({model.getParam("max_value"): -5.0})
    assert clipped.predict(0, 0) == -5.0


def test_fitted_and_low_rank(model, vignette):
    fitted = model.fitted().join(model.low_rank(vignette.drop("value")), ["row_id", "col_id"])
    stats = fitted.join(model.row_stats.withColumnRenamed("center", "a"), "row_id").join(
        model.col_stats.withColumnRenamed("center", "b"), "col_id")
    gap = stats.agg(F.max(F.abs(F.expr("prediction - xhat - a - b")))).first()[0]
    assert gap < 1e-12
    assert [r["d"] for r in model.singular_values.orderBy("k").collect()] == model.d.tolist()


def test_save_and_load(spark, model, tmp_path):
    path = str(tmp_path / "model")
    model.save(path)
    again = CompletionModel.load(path, spark)
    pairs = ([0, 1, 2, 5], [0, 1, 1, 3])
    assert again.predict(*pairs).tolist() == model.predict(*pairs).tolist()
    assert again.getOrDefault(again.getParam("shrinkage_value")) == 0.3
    with pytest.raises(Exception):
        model.save(path)
    model.save(path, overwrite=True)


def test_other_column_names(vignette, model):
    renamed = vignette.withColumnsRenamed({"row_id": "user", "col_id": "item", "value": "stars"})
    other = SoftImputeALS(max_rank=2, shrinkage_value=0.3, max_iters=2, center_max_iter=2, init="integer",
                          row_col="user", col_col="item", value_col="stars").fit(renamed)
    assert other.d == pytest.approx(model.d)
    assert set(other.transform(renamed.select("user", "item")).columns) == {"user", "item", "prediction", "source"}


def test_cold_pairs_score_by_centers(vignette):
    model = SoftImpute(max_rank=1, max_iters=1, max_inner_iters=1, n_rows=9, n_cols=9).fit(vignette)
    centers = {r["row_id"]: r["center"] for r in model.row_stats.collect()}
    assert model.predict(3, 8) == pytest.approx(centers[3])
    assert model.predict(8, 8) == 0.0


def test_several_settings_share_the_preparation(vignette):
    estimator = SoftImputeALS(max_iters=1, center_max_iter=2, init="integer", max_rank=2)
    maps = [{estimator.shrinkage_value: x} for x in (0.1, 5.0)]
    together = dict(estimator.fitMultiple(vignette, maps))
    assert together[0].cells is together[1].cells
    for k, settings in enumerate(maps):
        assert together[k].d == pytest.approx(estimator.fit(vignette, settings).d)


def test_grid_search_equals_dense_cross_validation(planted):
    """Half of the observed cells is too little here: the strongest shrinkage has the smaller error."""
    cells = planted.filter("observed").selectExpr("row_id", "col_id", "truth AS value")
    estimator = SoftImputeALS(max_iters=3, center=False, init="integer", max_rank=2, convergence_threshold=0.0)
    found, scores = tuning.grid_search(estimator, cells, {"shrinkage_value": [0.02, 1000.0]}, folds=2, kind="hash")
    x = np.full((200, 100), np.nan)
    for r in cells.collect():
        x[r["row_id"], r["col_id"]] = r["value"]
    fold = (np.arange(200)[:, None] * 7919 + np.arange(100) * 104729) % 2
    for row in scores.collect():
        errors = []
        for k in (0, 1):
            u, d, v = textbook.als(np.where(fold != k, x, np.nan), 2, row["shrinkage_value"], 3)
            errors.append(np.nanmean(np.where(fold == k, x - (u * d) @ v.T, np.nan) ** 2))
        assert row["mse"] == pytest.approx(np.mean(errors), rel=1e-9)
    best = min(scores.collect(), key=lambda r: r["mse"])["shrinkage_value"]
    assert found.bestModel.scalars["shrinkage"] == best == 1000.0


def test_comparison_with_the_ridge_method(planted):
    cells = planted.filter("observed").selectExpr("row_id", "col_id", "truth AS value")
    table = tuning.comparison_run(lambda trial: split.leave_n_out(cells, 50, 5, seed=trial), budgets=(1,), rank=2,
                                  shrinkage=0.02)
    rows = table.collect()
    assert {r["model"] for r in rows} == {"soft_impute_als", "ridge_als"}
    assert all(r["mse"] > 0 and r["train_rmse"] > 0 and r["seconds"] > 0 for r in rows)


def test_comparator_checkpoints_every_iteration(spark):
    """With ten iterations between checkpoints the shuffle files of ten lie on the disk for every fit that runs."""
    for settings in ({}, {"rank": 20, "max_iter": 30, "reg": 10.0}):
        als = tuning.comparator(**settings)
        assert als.getCheckpointInterval() == als.copy({als.rank: 4}).getCheckpointInterval() == 1


def test_comparator_refuses_long_ids(spark):
    cells = spark.createDataFrame([(2 ** 40, 1, 1.0)], RATINGS)
    with pytest.raises(Exception, match="32 bits"):
        tuning.comparator_input(cells).collect()


def test_several_imputations_are_averaged(spark, vignette):
    estimator = SoftImputeALS(max_rank=1, max_iters=1, center=False)
    pairs = spark.createDataFrame([(1, 1), (2, 1)], PAIRS)
    mean = {(r["row_id"], r["col_id"]): r["prediction"]
            for r in multiple_imputations(estimator, vignette, pairs, [1, 2]).collect()}
    single = [estimator.fit(vignette, {estimator.seed: s}).predict([1, 2], [1, 1]) for s in (1, 2)]
    assert [mean[1, 1], mean[2, 1]] == pytest.approx(np.mean(single, axis=0).tolist())
    assert single[0] != pytest.approx(single[1])


def test_scoring_a_stream(spark, model, tmp_path):
    folder = str(tmp_path / "pairs")
    spark.createDataFrame([(0, 0), (1, 1), (9, 9)], PAIRS).write.parquet(folder)
    stream = spark.readStream.schema(PAIRS).parquet(folder)
    query = score_stream(model, stream, str(tmp_path / "check")).format("memory").queryName("scored").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["row_id"], r["source"]) for r in spark.table("scored").collect()}
    assert got == {(0, "observed"), (1, "model"), (9, "out_of_range")}
    with pytest.raises(ValueError):
        score_stream(model, spark.range(1), "x")


def test_defects_are_refused_or_left_out(spark):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (None, 1, 1.0), (1, 2, None), (2, 2, float("nan"))]
    df = spark.createDataFrame(rows, "row_id bigint, col_id bigint, value double")
    with pytest.raises(ValueError, match="3 rows have a null"):
        BiScale().fit(df)
    assert BiScale(nulls="drop").fit(df) is not None


def test_csv_lines_that_do_not_fit_are_errors(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating\n1,2,3.5\n1,x,2\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_ratings_csv(spark, str(tmp_path / "r.csv")).collect()


def test_few_pairs_score_alike_and_do_not_shuffle_cells(spark, unit_matrix):
    model = SoftImputeALS(max_rank=2, shrinkage_value=1.0, max_iters=3).fit(unit_matrix)
    pairs = spark.createDataFrame([(0, 0, 9.0), (0, 1, 9.0), (2, 4, 9.0), (9, 9, 9.0)], "row_id bigint, col_id bigint, u double")
    few, many = (sorted(map(tuple, model._score(pairs, "passthrough", False, f).collect())) for f in (True, False))
    assert few == many and {r[-1] for r in few} == {"observed", "model", "out_of_range"}


def test_registered_fits_have_the_full_budget(monkeypatch):
    """Rank 8 and 50 iterations, as the benchmark of the reference, with the stop test on."""
    from lacuna.plans import queries as Q

    seen = {}
    monkeypatch.setattr(Q, "_split", lambda spark, folder: (None, None))
    monkeypatch.setattr(tuning, "fit_and_score", lambda estimator, parts: seen.update(ours=estimator) or 1 / 0)
    monkeypatch.setattr(tuning, "comparator_fit", lambda parts, **budget: seen.update(baseline=budget) or 1 / 0)
    for name in ("fit_and_score_full", "mllib_als_baseline"):
        with pytest.raises(ZeroDivisionError):
            Q.REGISTRY[name](None, "")
    value = {p.name: v for p, v in seen["ours"].extractParamMap().items()}
    assert (value["max_rank"], value["max_iters"], value["shrinkage_value"], value["convergence_threshold"]) == (8, 50, 0.02, 1e-5)
    assert seen["baseline"] == {"rank": 8, "max_iter": 50}


def test_fit_and_score_has_the_full_budget(monkeypatch):
    """As ``fit_and_score_full``, and centers until they stand; only the start vectors are the ones that SQL can follow."""
    from lacuna.plans import queries as Q

    seen = {}
    monkeypatch.setattr(Q, "_split", lambda spark, folder: (None, None))
    monkeypatch.setattr(tuning, "fit_and_score", lambda estimator, parts: seen.setdefault(len(seen), estimator) and 1 / 0)
    for name in ("fit_and_score", "fit_and_score_full"):
        with pytest.raises(ZeroDivisionError):
            Q.REGISTRY[name](None, "")
    small, full = ({p.name: v for p, v in e.extractParamMap().items()} for e in seen.values())
    assert {k for k in full if full[k] != small[k]} == {"init"}


def test_sql_of_the_whole_fit_stops_as_the_estimator_does(spark, vignette):
    """Where the stop test holds early, the SQL ends with the iteration that the fit ends with."""
    import duckdb

    from lacuna.plans import oracles

    con = duckdb.connect()
    con.execute("CREATE TABLE rated AS SELECT * FROM (VALUES " + ", ".join(
        f"({r[0]}::BIGINT, {r[1]}::BIGINT, {r[2]!r}::DOUBLE)" for r in vignette.collect()) + ") t(row_id, col_id, value)")
    fit = oracles.Polar("x", 2, "5e-1").als(50)
    found = con.sql("WITH RECURSIVE " + oracles.sql(
        *oracles.converged_centers("rated"), oracles.residual("x", "a", "b", "rated"), *fit.ctes,
        select=f"SELECT (SELECT max(it) FROM fit), (SELECT max(pass) FROM centers), m FROM {fit.m}").removeprefix("WITH ")).fetchall()[0]
    model = SoftImputeALS(max_rank=2, shrinkage_value=0.5, max_iters=50, init="integer").fit(vignette)
    assert (model.n_iterations, len(model.scalars["trace"])) == found[:2] and found[0] < 50
    assert np.allclose(np.linalg.eigvalsh(np.array(found[2]))[::-1], model.d, atol=1e-8)
