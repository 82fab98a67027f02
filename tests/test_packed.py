"""Cells of an id side by side, and half steps with packed vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import SoftImputeALS
from lacuna.operators import layout, products
from lacuna.plans import solvers
from lacuna.session import Scratch

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(scope="module")
def scattered(spark):
    """50 x 40, a third of the cells."""
    pairs = spark.range(2000).selectExpr("id div 40 AS row_id", "id % 40 AS col_id", "xxhash64(id) AS h")
    return pairs.where("pmod(h, 3) = 0").selectExpr("row_id", "col_id", "pmod(h, 101) / 10D AS value").localCheckpoint()


@pytest.mark.parametrize("key", ["row_id", "col_id"])
def test_cells_of_an_id_lie_side_by_side(spark, scattered, key):
    kept = layout.Layout(scattered, Scratch(spark, "beside"), 50, 40, scattered.count())
    placed = kept.placed_by(key).select(F.spark_partition_id().alias("part"), key, "opens").collect()
    kept.release()
    opens = [r["opens"] for r in placed if r["opens"] is not None]
    assert sorted(opens) == sorted({r[key] for r in placed})
    before = None
    for r in placed:
        assert (r["opens"] == r[key]) == ((r["part"], r[key]) != before)
        before = r["part"], r[key]


@pytest.mark.parametrize("center", [True, False])
@pytest.mark.parametrize("records", [7, 10_000])
def test_packed_fits_equal_fits_by_columns(spark, scattered, center, records, monkeypatch):
    one = SoftImputeALS(max_iters=4, init="integer", center=center, center_max_iter=5, convergence_threshold=1e-3)
    maps = [{one.getParam("max_rank"): r, one.getParam("shrinkage_value"): s} for r, s in ((6, 0.3), (4, 0.0), (6, 30.0))]
    calls, real = [], solvers.packed_steps
    monkeypatch.setattr(solvers, "PACKED_COLUMNS", 8)
    monkeypatch.setattr(solvers, "packed_steps", lambda *args: (calls.append(args[2]), real(*args))[1])
    given = spark.conf.get(RECORDS)
    spark.conf.set(RECORDS, records)
    try:
        found = one.fit_many(scattered, maps)
    finally:
        spark.conf.set(RECORDS, given)
    assert calls and calls[0] == [6, 4, 6]
    monkeypatch.setattr(solvers, "PACKED_COLUMNS", 10 ** 6)
    done = len(calls)
    for model, want in zip(found, one.fit_many(scattered, maps)):
        assert model.d == pytest.approx(want.d, abs=1e-8)
        assert model.scalars["changes"] == pytest.approx(want.scalars["changes"], abs=1e-8)
        got, right = ([r[0] for r in m.fitted().orderBy("row_id", "col_id").select("prediction").collect()] for m in (model, want))
        assert np.array(got) == pytest.approx(np.array(right), abs=1e-8)
    assert len(calls) == done


def test_a_wide_pass_has_few_columns(spark, scattered):
    """60 vector entries a side went as 120 columns, above what Spark generates code for."""
    kept = layout.Layout(scattered, Scratch(spark, "wide"), 50, 40, scattered.count())
    ids = scattered.select("row_id").distinct()
    vectors = ids.selectExpr("row_id", *[f"cast(row_id + {k} AS double) AS f{k}" for k in range(60)])
    job = solvers.Job(solvers.Factor(vectors, "row_id", "f", np.eye(60)), None, None, np.ones(60))
    step = solvers.half_step(kept, "wide", "col_id", 60, job.multiply, None, None, job.weights)
    assert step.raw.table.columns == ["col_id", "f"]
    want = products.residual_sums(scattered, "col_id", 60, vectors.selectExpr("row_id", *[f"f{k} AS p{k}" for k in range(60)]), None)
    got = {r["col_id"]: np.frombuffer(r["f"], np.float64) for r in step.raw.table.collect()}
    rows = want.collect()
    assert len(got) == len(rows) == 40
    assert all(got[r["col_id"]] == pytest.approx(np.array(r[1:]), rel=1e-12) for r in rows)
    total = np.array([r[1:] for r in rows])
    assert step.gram == pytest.approx(total.T @ total, rel=1e-9)
    kept.release()


def test_hot_or_large_sides_go_by_columns(spark, scattered, monkeypatch):
    monkeypatch.setattr(solvers, "PACKED_COLUMNS", 8)
    rows = scattered.select("row_id").distinct().selectExpr("row_id", *[f"1.0D AS f{k}" for k in range(8)])
    job = solvers.Job(solvers.Factor(rows, "row_id", "f", np.eye(8)), None, None, np.ones(8))
    for settings in (dict(broadcast_bytes=0), dict(hot_cells=10, cells_per_partition=40)):
        kept = layout.Layout(scattered, Scratch(spark, "other"), 50, 40, scattered.count(), **settings)
        assert not solvers._packs(kept, "col_id", [job])
        step = solvers.half_step(kept, "cols", "col_id", 8, job.multiply, None, None, job.weights)
        assert step.raw.packed is None and step.raw.table.count() == 40
        kept.release()
