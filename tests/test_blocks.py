"""Passes over blocks of cells, and what keeps grids within the driver's memory and the disk."""

import os

import numpy as np
import pytest

from lacuna import BiScale, SoftImputeALS
from lacuna.operators import blocks, layout
from lacuna.plans import solvers, tuning
from lacuna.session import checkpoint_root


@pytest.fixture(scope="module")
def scattered(spark):
    """50 x 40, a third of the cells, ids far apart."""
    pairs = spark.range(2000).selectExpr("id div 40 * 1000003 AS row_id", "id % 40 * 7 AS col_id", "xxhash64(id) AS h")
    return pairs.where("pmod(h, 3) = 0").selectExpr("row_id", "col_id", "pmod(h, 101) / 10D AS value").localCheckpoint()


def fitted(model):
    return np.array([r[0] for r in model.fitted().orderBy("row_id", "col_id").select("prediction").collect()])


@pytest.mark.parametrize("center", [True, False])
def test_fits_by_blocks_equal_fits_by_joins(scattered, center, monkeypatch):
    one = SoftImputeALS(max_iters=4, init="integer", center=center, center_max_iter=5, convergence_threshold=1e-3)
    maps = [{one.getParam("max_rank"): r, one.getParam("shrinkage_value"): s, one.getParam("max_iters"): n}
            for r, s, n in ((3, 0.3, 4), (2, 0.0, 2), (3, 30.0, 4))]
    want = one.fit_many(scattered, maps)
    passes, real = [], blocks.steps
    monkeypatch.setattr(layout, "BLOCKS_FROM", 1)
    monkeypatch.setattr(blocks, "BLOCK_CELLS", 100)  # many blocks a task
    monkeypatch.setattr(blocks, "steps", lambda *args: (passes.append(args[2]), real(*args))[1])
    for model, right in zip(one.fit_many(scattered, maps), want):
        assert model.d == pytest.approx(right.d, abs=1e-8)
        assert model.scalars["changes"] == pytest.approx(right.scalars["changes"], abs=1e-8)
        assert model.train_rmse() == pytest.approx(right.train_rmse(), abs=1e-8)
        assert fitted(model) == pytest.approx(fitted(right), abs=1e-8)
    assert passes[0] == [0, 3, 5, 8]


def test_centers_by_blocks_equal_centers_by_joins(scattered, monkeypatch):
    def found(**settings):
        model = BiScale(max_iter=6, threshold=1e-3, **settings).fit(scattered)
        return model.trace_levels, [np.array(sorted(map(tuple, t.collect()))) for t in (model.row_stats, model.col_stats)]

    trace, tables = found()
    monkeypatch.setattr(layout, "BLOCKS_FROM", 1)
    called, real = [], blocks.Blocks.means
    monkeypatch.setattr(blocks.Blocks, "means", lambda *args: (called.append(args[1]), real(*args))[1])
    again, others = found()
    assert called[:2] == ["col_id", "row_id"] and np.array(again) == pytest.approx(np.array(trace), abs=1e-8)
    assert all(a == pytest.approx(b, abs=1e-8) for a, b in zip(others, tables))
    called.clear()
    found(broadcast_bytes=0)  # no room for an array of one side
    assert not called


def test_hot_ids_and_wide_fits_do_not_go_by_blocks(spark, scattered, monkeypatch):
    monkeypatch.setattr(layout, "BLOCKS_FROM", 1)
    kept = SoftImputeALS()._layout(scattered, layout.Scratch(spark, "some"))
    assert kept.by_blocks(8) and not layout.replace(kept, broadcast_bytes=50 * 8 * 4 - 1).by_blocks(8)
    hot = SoftImputeALS(hot_cells=10, cells_per_partition=40)._layout(scattered, layout.Scratch(spark, "hot"))
    assert hot.hot and not hot.by_blocks(1)


def test_a_small_heap_fits_one_fold_at_a_time_and_its_tables_go(spark, scattered, monkeypatch):
    one = SoftImputeALS(max_iters=1, init="integer", center=False)
    running, most, real = [], [], SoftImputeALS.fit_many

    def counted(self, *args):
        running.append(1)
        most.append(len(running))
        try:
            return real(self, *args)
        finally:
            running.pop()

    monkeypatch.setattr(SoftImputeALS, "fit_many", counted)
    monkeypatch.setattr(tuning, "FIT_HEAP", 1 << 60)
    root = f"{checkpoint_root(spark)}/lacuna"
    before = set(os.listdir(root))
    best, _ = tuning.grid_search(one, scattered, {"max_rank": [1], "shrinkage_value": [0.1, 1.0]})
    assert max(most) == 1
    left = [x for x in set(os.listdir(root)) - before if x.startswith("softimputeals") and os.listdir(f"{root}/{x}")]
    assert len(left) == 2  # the best model's cells and vectors
    assert best.bestModel.fitted().count() == scattered.count()


def test_folds_that_fill_the_cores_go_one_by_one(spark, scattered, monkeypatch):
    monkeypatch.setattr(tuning, "FIT_HEAP", 1)
    assert tuning.folds_at_a_time(spark, scattered, 3) == 3
    monkeypatch.setattr(tuning, "CELLS_PER_PARTITION", 10)
    assert tuning.folds_at_a_time(spark, scattered, 3) == 1


def test_the_comparators_blocks_grow_with_the_cells(spark, scattered, monkeypatch):
    """Ten blocks whatever the input: a block of 20 million cells did not fit a task's memory."""
    cells = tuning.comparator_input(scattered.withColumn("row_id", scattered.row_id / 1000003))
    assert tuning.comparator(2, 1).fit(cells).model.userFactors.rdd.getNumPartitions() == 10
    monkeypatch.setattr(tuning, "COMPARATOR_BLOCK_CELLS", 50)
    found, n = tuning.comparator(2, 1).fit(cells).model, cells.count()
    assert found.userFactors.rdd.getNumPartitions() == found.itemFactors.rdd.getNumPartitions() == -(-n // 50) > 10
    assert found.userFactors.count() == cells.select("row_id").distinct().count()
