import numpy as np
import pytest
from pyspark.sql import functions as F

import textbook
from lacuna import BiScale, SoftImpute, SoftImputeALS
from lacuna.operators import factors
from lacuna.plans.estimators import _Completion

FIXED = dict(init="integer", convergence_threshold=0.0)


def dense_fit(model, n, m):
    u, v = np.zeros((n, len(model.d))), np.zeros((m, len(model.d)))
    for r in model.row_factors.collect():
        u[r["row_id"]] = r["u"]
    for r in model.col_factors.collect():
        v[r["col_id"]] = r["v"]
    return u, v, (u * model.d) @ v.T


@pytest.fixture(scope="module")
def unit_model(unit_matrix):
    return SoftImpute(n_rows=5, n_cols=6).fit(unit_matrix)


def test_unit_matrix_shape_and_rank(unit_matrix, unit_model):
    assert len(unit_model.d) == 2
    assert SoftImpute(n_rows=5, n_cols=6, max_rank=10, max_iters=1).fit(unit_matrix).d.shape == (5,)


def test_unit_matrix_residuals_vanish(unit_model):
    # Every non-empty column has one cell, so column centers explain everything.
    assert unit_model.d.tolist() == [0.0, 0.0]
    assert unit_model.scalars["trace"] == [(1, 175.0), (2, 0.0)]
    assert unit_model.scalars["changes"][0] == pytest.approx(1.0, abs=5e-3)
    assert unit_model.scalars["effective_rank"] == 0


def test_unit_matrix_predictions(unit_model):
    assert unit_model.predict(1, 1) == 7
    assert unit_model.predict(0, 1) == 7  # column center alone
    assert unit_model.predict([0, 3, 4, 0], [0, 3, 5, 2]).tolist() == [4, -5, 2, -9]
    assert unit_model.predict(2, 4) == 0  # empty row and column, inside the shape
    for row, col in ((5, 0), (0, 6), (-1, 0), (0, -1)):
        with pytest.raises(ValueError):
            unit_model.predict(row, col)
    with pytest.raises(ValueError):
        unit_model.predict([0, 1], [0])
    with pytest.raises(ValueError):
        unit_model.predict([0.5], [0])


def test_centers_of_vignette(vignette, vignette_dense):
    model = BiScale().fit(vignette)
    rows = [r["center"] for r in model.row_stats.orderBy("row_id").collect()]
    cols = [r["center"] for r in model.col_stats.orderBy("col_id").collect()]
    assert rows == pytest.approx([0.3862391, -0.4937124, -0.2318925, 0.5545016, -0.0753221, -0.4390035], abs=1e-6)
    assert cols == pytest.approx([0.3402487, -0.2778848, -0.1651501, 0.1802582, -0.5749265], abs=1e-6)
    levels = [level for _, level in model.trace_levels]
    assert len(levels) == 9
    assert [levels[0], levels[1], levels[4]] == pytest.approx([1.6627586, 0.0734851, 1.0828766e-05], rel=1e-6)
    residuals = model.residuals
    for key in ("row_id", "col_id"):
        assert all(abs(r["m"]) < 1e-4 for r in residuals.groupBy(key).agg(F.avg("value").alias("m")).collect())
    same = model.transform(vignette).join(residuals.withColumnRenamed("value", "r"), ["row_id", "col_id"])
    assert same.agg(F.max(F.abs(F.col("value") - F.col("r")))).first()[0] < 1e-12
    assert model.inverse_transform(
        residuals.withColumnRenamed("value", "prediction")).count() == vignette.count()


def test_one_centering_pass(vignette, vignette_dense):
    model = BiScale(max_iter=1).fit(vignette)
    a, b = textbook.bicenter(vignette_dense, 1)
    assert [r["center"] for r in model.row_stats.orderBy("row_id").collect()] == pytest.approx(a.tolist())
    assert [r["center"] for r in model.col_stats.orderBy("col_id").collect()] == pytest.approx(b.tolist())


def test_single_sided_centering(vignette, vignette_dense):
    model = BiScale(row_center=False).fit(vignette)
    assert [r["center"] for r in model.row_stats.collect()] == [0.0] * 6
    cols = [r["center"] for r in model.col_stats.orderBy("col_id").collect()]
    assert cols == pytest.approx(np.nanmean(vignette_dense, axis=0).tolist())
    assert len(model.trace_levels) == 2
    with pytest.raises(ValueError):
        BiScale(row_scale=True)


@pytest.mark.parametrize("lam, d, rmse, scores", [
    (1.0, [1.0962, 0.6463, 0.0], 0.373302, [-0.858868, -0.786915]),
    (8.0, [0.0, 0.0, 0.0], 0.621341, [-0.771597, -0.509777]),
])
def test_vignette_optimum(vignette, lam, d, rmse, scores):
    model = SoftImputeALS(max_rank=3, shrinkage_value=lam, max_iters=40).fit(vignette)
    assert model.d == pytest.approx(d, abs=5e-3)
    assert model.eval() == pytest.approx(rmse, abs=1e-3)
    assert model.predict([1, 2], [1, 1]) == pytest.approx(scores, abs=5e-3)


@pytest.mark.parametrize("rank", [1, 3])
def test_als_steps_equal_textbook(vignette, vignette_dense, rank):
    model = SoftImputeALS(max_rank=rank, shrinkage_value=0.3, max_iters=3, center_max_iter=2,
                          center_threshold=0.0, **FIXED).fit(vignette)
    a, b = textbook.bicenter(vignette_dense, 2)
    u, d, v = textbook.als(vignette_dense - a[:, None] - b, rank, 0.3, 3)
    assert model.d == pytest.approx(d, abs=1e-8)
    assert dense_fit(model, 6, 5)[2] == pytest.approx((u * d) @ v.T, abs=1e-8)


@pytest.mark.parametrize("inner", [1, 3])
def test_nested_steps_equal_textbook(vignette, vignette_dense, inner):
    model = SoftImpute(max_rank=2, shrinkage_value=0.3, max_iters=3, max_inner_iters=inner, center_max_iter=2,
                       center_threshold=0.0, **FIXED).fit(vignette)
    a, b = textbook.bicenter(vignette_dense, 2)
    u, d, v = textbook.nested(vignette_dense - a[:, None] - b, 2, 0.3, 3, inner)
    assert model.d == pytest.approx(d, abs=1e-8)
    assert dense_fit(model, 6, 5)[2] == pytest.approx((u * d) @ v.T, abs=1e-8)


LAYOUT_FIT = dict(max_rank=3, shrinkage_value=0.3, max_iters=2, center_max_iter=2, **FIXED)
FORMS = [
    dict(broadcast_bytes=0),
    dict(broadcast_bytes=0, hot_cells=2, cells_per_partition=5),
    dict(broadcast_bytes=0, hot_cells=2, form="gram"),
    dict(hot_cells=3, cells_per_partition=4),
]


@pytest.fixture(scope="module")
def plain_fit(vignette):
    return SoftImputeALS(**LAYOUT_FIT).fit(vignette)


@pytest.mark.parametrize("how", FORMS, ids=str)
def test_every_layout_gives_the_same_fit(spark, vignette, plain_fit, how):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = SoftImputeALS(**LAYOUT_FIT, **how).fit(vignette)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert model.d == pytest.approx(plain_fit.d, abs=1e-9)
    assert dense_fit(model, 6, 5)[2] == pytest.approx(dense_fit(plain_fit, 6, 5)[2], abs=1e-9)


def test_nested_without_broadcast(vignette):
    settings = dict(max_rank=2, shrinkage_value=0.3, max_iters=2, max_inner_iters=1, center_max_iter=2, **FIXED)
    one, other = (SoftImpute(**settings, **how).fit(vignette)
                  for how in ({}, dict(broadcast_bytes=0, hot_cells=2)))
    assert dense_fit(one, 6, 5)[2] == pytest.approx(dense_fit(other, 6, 5)[2], abs=1e-9)


@pytest.mark.parametrize("kind", [SoftImpute, SoftImputeALS])
def test_numpy_products_equal_unrolled_ones(monkeypatch, vignette, kind):
    # Centering leaves a matrix with a nearly empty direction, so this also needs the refined SVD.
    settings = dict(max_rank=3, shrinkage_value=0.3, max_iters=2, max_inner_iters=1, center_max_iter=6, **FIXED)
    one = kind(**settings).fit(vignette)
    monkeypatch.setattr(factors, "UNROLLED_RANK", 0)
    other = kind(**settings).fit(vignette)
    assert other.d == pytest.approx(one.d, abs=1e-9)
    assert other.scalars["changes"] == pytest.approx(one.scalars["changes"], abs=1e-9)
    assert dense_fit(one, 6, 5)[2] == pytest.approx(dense_fit(other, 6, 5)[2], abs=1e-9)


def test_change_measure_equals_definition(vignette, vignette_dense):
    """The stop criterion is |M_new - M_old|^2 / |M_old|^2, here of steps 2 and 3."""
    x = vignette_dense
    model = SoftImputeALS(max_rank=2, shrinkage_value=0.3, max_iters=3, center=False, **FIXED).fit(vignette)
    u, d = textbook.integer_start(6, 2), np.ones(2)
    v, fits = np.zeros((5, 2)), []
    for _ in range(3):
        for side in (0, 1):
            full = textbook.filled(x, (u * d) @ v.T)
            if side == 0:
                v, d, w = np.linalg.svd((full.T @ u) * (d / (d + 0.3)), full_matrices=False)
                u = u @ w.T
            else:
                u, d, w = np.linalg.svd((full @ v) * (d / (d + 0.3)), full_matrices=False)
                v = v @ w.T
        fits.append((u * d) @ v.T)
    expected = [((fits[k] - fits[k - 1]) ** 2).sum() / (fits[k - 1] ** 2).sum() for k in (1, 2)]
    assert model.scalars["changes"][1:] == pytest.approx(expected, rel=1e-6)
    loose = SoftImputeALS(max_rank=2, shrinkage_value=0.3, max_iters=3, center=False, criterion="column_sum",
                          **FIXED).fit(vignette)
    assert loose.d == pytest.approx(model.d)


def test_thin_svd_of_a_poorly_conditioned_table(spark):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(50, 3)))
    w, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    b = (q * [5.0, 1.0, 1e-5]) @ w.T
    table = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(b)],
                                  "row_id bigint, f0 double, f1 double, f2 double")
    raw = factors.Factor(table, "row_id", "f", np.eye(3))
    s, right, over = factors.thin_svd(raw, factors.table_gram(table, ["f0", "f1", "f2"]))
    assert s == pytest.approx([5.0, 1.0, 1e-5], rel=1e-9)
    assert (b @ over).T @ (b @ over) == pytest.approx(np.eye(3), abs=1e-9)
    assert (b @ over * s) @ right.T == pytest.approx(b, abs=1e-12)


def test_vanished_components_become_zero():
    s, w, over = factors.thin_svd_from_gram(np.diag([4.0, 0.0]))
    assert s.tolist() == [2.0, 0.0] and over[:, 1].tolist() == [0.0, 0.0]
    assert w.T @ w == pytest.approx(np.eye(2))


def test_objective_does_not_increase(vignette, vignette_dense):
    values = []
    for steps in (1, 3):
        u, d, v = textbook.als(vignette_dense, 3, 0.5, steps)
        model = SoftImputeALS(max_rank=3, shrinkage_value=0.5, max_iters=steps, center=False, **FIXED).fit(vignette)
        mu, mv, _ = dense_fit(model, 6, 5)
        values.append(textbook.objective(vignette_dense, mu, model.d, mv, 0.5))
        live = model.d > 0
        assert mu[:, live].T @ mu[:, live] == pytest.approx(np.eye(live.sum()), abs=1e-8)
    assert values[0] >= values[1]


def test_planted_low_rank_is_recovered(planted):
    train = planted.filter("observed").selectExpr("row_id", "col_id", "truth AS value")
    model = SoftImputeALS(max_rank=2, shrinkage_value=0.02, max_iters=30, center=False, convergence_threshold=1e-9)
    scored = model.fit(train).transform(planted.filter("NOT observed"))
    rmse = scored.agg(F.sqrt(F.avg(F.pow(F.col("truth") - F.col("prediction"), 2)))).first()[0]
    assert rmse < 0.005


def test_default_shrinkage_and_zero(vignette):
    settings = dict(max_rank=2, max_iters=1, center=False, init="integer")
    assert SoftImputeALS(**settings).fit(vignette).scalars["shrinkage"] == pytest.approx(0.02)
    model = SoftImputeALS(**settings, shrinkage_value=0.0).fit(vignette)
    assert model.scalars["shrinkage"] == 0.0 and model.d[1] > 0


def test_bad_input_is_refused(spark, vignette):
    full = spark.range(6).selectExpr("id div 2 AS row_id", "id % 2 AS col_id", "1.0D AS value")
    with pytest.raises(ValueError, match="no missing"):
        SoftImputeALS().fit(full)
    with pytest.raises(ValueError, match="no observed"):
        SoftImputeALS().fit(vignette.filter("value > 100"))
    with pytest.raises(ValueError, match="missing"):
        SoftImputeALS().fit(vignette.drop("value"))
    with pytest.raises(ValueError, match="integers"):
        SoftImputeALS().fit(vignette.withColumn("row_id", F.col("row_id").cast("string")))
    with pytest.raises(ValueError, match="negative"):
        SoftImputeALS().fit(vignette.withColumn("row_id", F.col("row_id") - 1))
    with pytest.raises(ValueError, match="does not fit"):
        SoftImputeALS(n_rows=3).fit(vignette)
    with pytest.raises(NotImplementedError):
        _Completion(max_rank=2, center=False).fit(vignette)


def test_repeated_cells_add_up_and_zeros(spark, vignette):
    halves = vignette.withColumn("value", F.col("value") / 2)
    one, two = (SoftImputeALS(max_rank=1, max_iters=1, center=False, init="integer").fit(x)
                for x in (vignette, halves.unionByName(halves)))
    assert two.d == pytest.approx(one.d)
    zeros = vignette.unionByName(spark.createDataFrame([(1, 1, 0.0)], vignette.schema))
    assert SoftImputeALS(max_rank=1, max_iters=1).fit(zeros).scalars["nnz"] == 21
    assert SoftImputeALS(max_rank=1, max_iters=1, zeros="drop").fit(zeros).scalars["nnz"] == 20
