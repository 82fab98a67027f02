"""Fits side by side, centers as fixed components, and inputs without a usable cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import BiScale, SoftImpute, SoftImputeALS
from lacuna.operators import layout as layouts
from lacuna.operators import metrics
from lacuna.plans import solvers
from lacuna.plans.estimators import multiple_imputations

FIXED = dict(convergence_threshold=0.0, init="integer")


def values(model):
    cells = model.fitted().orderBy("row_id", "col_id").collect()
    return np.array([r["prediction"] for r in cells])


@pytest.mark.parametrize("center", [True, False])
@pytest.mark.parametrize("form", ["residual", "gram"])
def test_fits_side_by_side_equal_fits_alone(vignette, center, form):
    shared = dict(init="integer", center=center, center_max_iter=5, form=form)
    settings = [dict(max_rank=1, shrinkage_value=0.0, max_iters=2, convergence_threshold=0.0),
                dict(max_rank=3, shrinkage_value=0.3, max_iters=4, convergence_threshold=0.0),
                dict(max_rank=2, shrinkage_value=0.3, max_iters=50, convergence_threshold=1e-2),
                dict(max_rank=2, shrinkage_value=9.0, max_iters=4, convergence_threshold=0.0, criterion="column_sum")]
    one = SoftImputeALS(**shared)
    together = one.fit_many(vignette, [{one.getParam(k): v for k, v in s.items()} for s in settings])
    for model, s in zip(together, settings):
        alone = SoftImputeALS(**shared, **s).fit(vignette)
        assert model.d == pytest.approx(alone.d, abs=1e-9)
        assert model.scalars["changes"] == pytest.approx(alone.scalars["changes"], abs=1e-9)
        assert values(model) == pytest.approx(values(alone), abs=1e-9)
        assert model.getOrDefault("max_rank") == s["max_rank"]


def test_wide_batches_multiply_in_numpy(vignette):
    one = SoftImputeALS(max_iters=2, max_rank=3, shrinkage_value=0.3, **FIXED)
    maps = [{one.getParam("shrinkage_value"): 0.1 * k} for k in range(9)]  # 81 products a row
    for model, settings in zip(one.fit_many(vignette, maps), maps):
        assert values(model) == pytest.approx(values(one.fit(vignette, settings)), abs=1e-9)


def test_a_batch_passes_over_the_cells_once_per_half_step(vignette, monkeypatch):
    passes = []
    real = solvers.half_steps
    monkeypatch.setattr(solvers, "half_steps", lambda *args: (passes.append(len(args[3])), real(*args))[1])
    one = SoftImputeALS(max_iters=3, max_rank=1, shrinkage_value=0.3, **FIXED)
    one.fit_many(vignette, [{one.getParam("shrinkage_value"): x} for x in (0.1, 0.2, 0.3, 0.4)])
    assert passes == [4] * 7  # three iterations and the last step


def test_centered_fit_places_the_cells_once_per_side(vignette, monkeypatch):
    placed, real = [], layouts.Layout._salted
    monkeypatch.setattr(layouts.Layout, "_salted", lambda self: (placed.append(1), real(self))[1])
    model = SoftImputeALS(max_rank=2, max_iters=2, broadcast_bytes=0).fit(vignette)
    assert len(placed) <= 2
    assert "residuals" not in model.rows.inputFiles()[0]


@pytest.mark.parametrize("kind", [SoftImpute, SoftImputeALS])
@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_training_error_of_the_fit_equals_that_of_its_scores(vignette, kind, broadcast):
    model = kind(max_rank=2, shrinkage_value=0.1, max_iters=3, max_inner_iters=2, hot_cells=3, broadcast_bytes=broadcast, **FIXED).fit(vignette)
    scored = metrics.root_mean_squared_error(model.fitted(), "value", "prediction").first()["rmse"]
    assert model.train_rmse() == pytest.approx(scored, rel=1e-9)
    model.set(model.getParam("max_value"), 0.5)
    clipped = metrics.root_mean_squared_error(model.fitted(), "value", "prediction").first()["rmse"]
    assert model.train_rmse() == pytest.approx(clipped) and clipped > scored


def test_training_error_needs_no_job(vignette, spark):
    model = SoftImputeALS(max_rank=1, max_iters=1).fit(vignette)
    spark.sparkContext.setJobGroup("rmse", "rmse")
    model.train_rmse()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rmse")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_imputations_from_seeds_share_one_fit(vignette, monkeypatch):
    pairs = vignette.select("row_id", "col_id")
    estimator = SoftImputeALS(max_rank=2, max_iters=2, shrinkage_value=0.1, convergence_threshold=0.0, observed="model")
    prepared, real = [], SoftImputeALS._prepare
    monkeypatch.setattr(SoftImputeALS, "_prepare", lambda self, df: (prepared.append(1), real(self, df))[1])
    got = {(r["row_id"], r["col_id"]): r["prediction"] for r in multiple_imputations(estimator, vignette, pairs, [1, 2, 3]).collect()}
    assert len(prepared) == 1
    runs = [estimator.fit(vignette, {estimator.getParam("seed"): s}).transform(pairs).collect() for s in (1, 2, 3)]
    for r in zip(*[sorted(run, key=lambda x: (x["row_id"], x["col_id"])) for run in runs]):
        assert got[r[0]["row_id"], r[0]["col_id"]] == pytest.approx(np.mean([x["prediction"] for x in r]))


BAD = {
    "empty": (lambda df: df.where("value > 1e9"), {}, "no observed"),
    "null": (lambda df: df.withColumn("value", F.lit(None).cast("double")), {}, r"\d+ rows have a null"),
    "nan": (lambda df: df.withColumn("value", F.lit(float("nan"))), {}, r"\d+ rows have a null"),
    "dropped": (lambda df: df.withColumn("value", F.lit(None).cast("double")), {"nulls": "drop"}, "no observed"),
    "zero": (lambda df: df.withColumn("value", F.lit(0.0)), {"zeros": "drop"}, "no observed"),
}


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("case", BAD)
@pytest.mark.parametrize("kind", [BiScale, SoftImputeALS])
def test_input_without_a_cell_is_a_value_error(spark, vignette, kind, case, adaptive):
    change, settings, text = BAD[case]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        with pytest.raises(ValueError, match=text) as error:
            kind(**settings).fit(change(vignette))
        if "rows" in text:
            assert str(error.value).startswith(str(vignette.count()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
