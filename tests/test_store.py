"""Products that check their vectors, saved models that share their cells, comparisons that can be restarted."""

import os

import pytest
from pyspark.sql import functions as F

from lacuna import CompletionModel, SoftImputeALS
from lacuna.operators import products, split
from lacuna.operators.layout import Layout
from lacuna.plans import tuning
from lacuna.session import Scratch
from lacuna.sources.models import content_hash


@pytest.fixture(scope="module")
def cells(spark):
    return Scratch(spark, "store").write(spark.range(400).selectExpr("id % 23 AS row_id", "id AS col_id", "id * 0.5D AS value"), "cells")


def test_products_refuse_cells_without_a_vector(spark, cells):
    vectors = cells.select("col_id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert products.right_multiply(cells, vectors, 2).count() == 23
    with pytest.raises(Exception, match="no vector of width 2 for col_id 7"):
        products.right_multiply(cells, vectors.where("col_id <> 7"), 2).collect()
    short = vectors.withColumn("v", F.expr("CASE WHEN col_id = 9 THEN array(1D) ELSE v END"))
    with pytest.raises(Exception, match="no vector of width 2 for col_id 9"):
        products.right_multiply(cells, short, 2).collect()
    rows = cells.select("row_id").distinct().where("row_id <> 5").select("row_id", F.array(F.lit(1.0)).alias("u"))
    with pytest.raises(Exception, match="no vector of width 1 for row_id 5"):
        products.left_multiply(cells, rows, 1).collect()


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_counted_product_counts_in_its_own_job(spark, cells, broadcast):
    scratch = Scratch(spark, "counted")
    layout = Layout(cells, scratch, 23, 400, 400, broadcast_bytes=broadcast, hot_cells=10)
    vectors = cells.select("col_id", F.array(F.lit(1.0)).alias("v")).where("col_id % 10 <> 3")
    table, seen = products.counted_product(layout.placed_by("col_id"), "row_id", vectors, "v", 1, scratch, layout.attach)
    assert seen == {"unmatched": 40, "cells": 400}
    want = {r["row_id"]: r["s"] for r in cells.where("col_id % 10 <> 3").groupBy("row_id").agg(F.sum("value").alias("s")).collect()}
    assert {r["row_id"]: r["product"][0] for r in table.collect()} == pytest.approx(want)
    layout.release()
    empty = products.counted_product(cells.where("row_id > 99"), "row_id", vectors, "v", 1, Scratch(spark, "none"))
    assert empty[0].count() == 0 and empty[1] == {"unmatched": 0, "cells": 0}


def test_models_of_a_store_share_one_copy_of_the_cells(spark, cells, tmp_path):
    store, places = str(tmp_path / "store"), [str(tmp_path / name) for name in "abc"]
    models = [SoftImputeALS(max_rank=1, max_iters=1, shrinkage_value=x).fit(cells) for x in (0.1, 1.0)]
    models[0].save(places[0], store=store)
    models[1].save(places[1], store=store)
    other = SoftImputeALS(max_rank=1, max_iters=1).fit(cells.where("col_id < 300"))
    other.save(places[2], store=store)
    snapshots = lambda: sorted(n for n in os.listdir(store) if not n.endswith(".refs") and not n.startswith("."))
    assert len(snapshots()) == 2 and not os.path.exists(f"{places[0]}/cells")
    CompletionModel.remove(places[0], spark)
    loaded = CompletionModel.load(places[1], spark)
    assert sorted(map(tuple, loaded.cells.collect())) == sorted(map(tuple, models[1].cells.collect()))
    assert loaded.predict([3, 3], [3, 4]).tolist() == models[1].predict([3, 3], [3, 4]).tolist()
    loaded.save(places[1] + "2", store=store)
    assert len(snapshots()) == 2
    for place in (places[1], places[2]):
        CompletionModel.remove(place, spark)
    assert len(snapshots()) == 1 and CompletionModel.load(places[1] + "2", spark).cells.count() == 400
    models[0].save(places[1] + "2", overwrite=True, store=store)
    assert CompletionModel.load(places[1] + "2", spark).scalars["shrinkage"] == pytest.approx(0.1)
    CompletionModel.remove(places[1] + "2", spark)
    assert snapshots() == []


def test_content_hash_ignores_order_and_sees_every_value(spark, cells):
    same = content_hash(cells.repartition(5).orderBy(F.desc("value")))
    assert content_hash(cells) == same
    assert content_hash(cells.withColumn("value", F.expr("value + int(col_id = 17)"))) != same
    assert content_hash(cells.where("false")) == content_hash(cells.limit(0))


def test_a_comparison_goes_on_where_it_stopped(cells, tmp_path):
    asked = []

    def trial(k):
        asked.append(k)
        return split.leave_n_out(cells, 5, 1, seed=k)

    path = str(tmp_path / "trials")
    first = tuning.comparison_run(trial, trials=1, budgets=(1,), rank=1, path=path).collect()
    both = tuning.comparison_run(trial, trials=2, budgets=(1,), rank=1, path=path, contestants=tuning.CONTESTANTS)
    rows = {(r["model"], r["trial"]): r for r in both.collect()}
    assert set(rows) == {("soft_impute_als", 0), ("ridge_als", 0), *((m, 1) for m in tuning.CONTESTANTS)}
    assert {rows[r["model"], 0]["seconds"] for r in first} == {r["seconds"] for r in first}  # the first trial is not run again
    assert all(r["n_test"] == 5 and r["n_train"] + 5 + int(r["trial"] < 0) in (399, 400) for r in rows.values())


def test_tuning_picks_the_best_point_of_both_grids(cells):
    chosen = tuning.tuned(cells, iterations=1, ranks=(1, 2), penalties=(0.1, 5.0), folds=2)
    assert set(chosen) == set(tuning.CONTESTANTS) and chosen["soft_impute"] == chosen["soft_impute_als"]
    assert all(rank in (1, 2) and penalty in (0.1, 5.0) for rank, penalty in chosen.values())
