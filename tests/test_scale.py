"""Steps that must not put more into a task, a broadcast or a shuffle as the input grows."""

import pytest
from pyspark.sql import functions as F

from lacuna import SoftImputeALS
from lacuna.operators import layout, lookup, metrics, products, scaling
from lacuna.plans import estimators
from lacuna.session import Scratch
from lacuna.sources import ratings as R


@pytest.fixture(scope="module")
def cells(spark):
    return Scratch(spark, "scale").write(
        spark.range(900).selectExpr("id % 30 AS row_id", "id div 30 AS col_id", "cast(id * 7 % 11 AS double) AS value"), "cells")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_triples_are_dealt_to_a_given_number_of_tasks(spark, cells):
    twice = cells.unionByName(cells)
    dealt = R.assemble(twice, parts=7)
    assert rows(dealt) == rows(R.assemble(twice)) and dealt.rdd.getNumPartitions() == 7
    assert R.parts_for(spark, 36_000_000) == 36 and R.parts_for(spark, 100) == 1


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_means_of_all_folds_in_one_pass(spark, cells, broadcast):
    scratch, folds = Scratch(spark, "folds"), 3
    marked = cells.withColumn("fold", F.expr("cast(pmod(row_id + 2 * col_id, 3) AS int)"))
    placed = layout.Layout(marked, scratch, 30, 30, 900, broadcast)
    cols = scaling.fold_means(placed.cells_for("col_id", None), "col_id", None, folds, placed.attach)
    cols = scratch.write(cols, "cols")
    both = scaling.fold_means(placed.cells_for("row_id", cols), "row_id", cols, folds, placed.attach)
    for fold in range(folds):
        train = marked.where(f"fold != {fold}")
        first = scaling.mean_residual(train, "col_id", None)
        second = scaling.mean_residual(train, "row_id", first)
        for got, want, key in ((cols, first, "col_id"), (both, second, "row_id")):
            got = {r[key]: r[f"center{fold}"] for r in got.collect()}
            assert got == pytest.approx({r[key]: r["center"] for r in want.collect()})
    placed.release()


def test_imputation_mean_does_not_leave_the_number_of_tasks_to_the_size(spark, cells):
    runs = cells.withColumnRenamed("value", "prediction").select("row_id", "col_id", "prediction")
    found = metrics.imputation_mean(runs.unionByName(runs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert rows(found) == [(*r, 2) for r in rows(runs)]


def test_fitted_cells_move_no_cell_if_the_vectors_are_small(spark, cells):
    placed = layout.Layout(cells, Scratch(spark, "fitted"), 30, 30, 900)
    u = cells.select("row_id").distinct().selectExpr("row_id", "array(row_id * 0.5D, 1D) AS u").where("row_id > 0")
    v = cells.select("col_id").distinct().selectExpr("col_id", "array(2D, col_id * 0.25D) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = products.fitted_cells(cells, u, v, 2, [3.0, 2.0], placed.attach)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
        assert rows(near) == rows(products.fitted_cells(cells, u, v, 2, [3.0, 2.0]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_broadcast_limit_follows_the_memory(spark, monkeypatch):
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    assert layout.broadcast_share(spark) == max(layout.BROADCAST_BYTES, heap // 16)
    assert SoftImputeALS()._value("broadcast_bytes") == layout.broadcast_share(spark)
    assert SoftImputeALS(broadcast_bytes=7)._value("broadcast_bytes") == 7


def test_a_request_is_counted_without_a_limit(spark, cells, monkeypatch):
    model = SoftImputeALS(max_rank=1, max_iters=1, shrinkage_value=1.0).fit(cells.where("(row_id + col_id) % 4 != 0"))
    plans, real = [], Scratch.write_observed
    monkeypatch.setattr(estimators.Scratch, "write_observed", lambda self, df, *a, **k: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(self, df, *a, **k))[1])
    monkeypatch.setattr(lookup, "BROADCAST_PAIRS", 10)
    request = cells.select("row_id", "col_id")
    # A limit would send the request through one task.
    assert rows(model.predict_few(request)) == rows(model.transform(request))
    assert plans and not any("GlobalLimit" in p for p in plans)


def test_imputations_compute_their_pairs_once(spark, cells):
    model = SoftImputeALS(max_rank=1, max_iters=1, shrinkage_value=1.0, observed="model")
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    pairs = cells.select("row_id", "col_id").mapInArrow(counted, "row_id bigint, col_id bigint")
    found = estimators.multiple_imputations(model, cells.where("(row_id + col_id) % 4 != 0"), pairs, [0, 1, 2])
    assert {r["runs"] for r in found.collect()} == {3} and computed.value == 900
