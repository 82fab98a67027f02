"""Lookups in the bucketed cells: same rows as the join, with the cells neither shuffled nor read whole."""

import re

import pytest
from pyspark.sql import functions as F

from lacuna import SoftImputeALS
from lacuna.operators.lookup import CellIndex, find_by_scan
from lacuna.operators import lookup
from lacuna.session import Scratch


@pytest.fixture(scope="module")
def skewed(spark):
    """Row 3 has 4,000 of 6,000 cells."""
    cells = spark.range(6000).selectExpr("CASE WHEN id < 4000 THEN 3 ELSE id % 100 END AS row_id", "id AS col_id", "id * 0.5D AS value")
    return Scratch(spark, "skewed").write(cells, "cells")


@pytest.fixture(scope="module")
def index(spark, skewed):
    return CellIndex.build(skewed, Scratch(spark, "index"), n_buckets=8, hot_cells=500)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_finds_what_a_join_finds(spark, skewed, index):
    asked = spark.createDataFrame([(3, 0), (3, 3999), (3, 4003), (17, 4017), (17, 4018), (99, 5999), (500, 1), (None, 1), (3, None), (3, 0)],
                                  "row_id bigint, col_id bigint")
    want = [(3, 0, 0.0), (3, 3999, 1999.5), (3, 4003, 2001.5), (17, 4017, 2008.5), (99, 5999, 2999.5)]
    assert rows(index.find(asked)) == rows(find_by_scan(skewed, asked)) == want
    assert rows(index.find(asked.where("row_id > 1000"))) == []


def test_every_cell_is_in_the_index_once(skewed, index):
    assert rows(index.cells.select("row_id", "col_id", "value")) == rows(skewed)


def test_a_hot_row_is_spread(index):
    sizes = [r["count"] for r in index.cells.where("row_id = 3").groupBy("place").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 700  # 4,020 cells, 500 a place
    assert index.cells.where("row_id = 4").select("place").distinct().count() == 1


@pytest.fixture
def a_partition_per_file(spark):
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    yield
    spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_reads_only_the_buckets_asked_for_and_moves_no_cell(spark, index, a_partition_per_file):
    found = index.find(spark.createDataFrame([(17, 4017)], "row_id bigint, col_id bigint"))
    assert index.cells.rdd.getNumPartitions() == 8 and found.rdd.getNumPartitions() == 1
    plan = plan_of(found)
    assert re.search(r"PushedFilters: \[.*EqualTo\(place", plan)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_many_places_are_joined_without_a_list(spark, skewed, index, monkeypatch, a_partition_per_file):
    monkeypatch.setattr(lookup, "MOST_PLACES", 3)
    found = index.find(skewed.select("row_id", "col_id").where("col_id % 2 = 0"))
    assert found.rdd.getNumPartitions() == 8
    assert rows(found) == rows(skewed.where("col_id % 2 = 0"))


@pytest.fixture(scope="module")
def model(skewed):
    return SoftImputeALS(max_rank=1, max_iters=1, shrinkage_value=1.0).fit(skewed)


@pytest.mark.parametrize("indexed", [False, True])
def test_predict_few_equals_transform(spark, model, indexed):
    model.index = model.index_cells(n_buckets=8, hot_cells=500) if indexed else None
    request = spark.createDataFrame([(3, 7, "x"), (3, 7, "y"), (5, 4005, "z"), (5, 0, "cold"), (-1, 0, "out"), (0, 6000, "out")],
                                    "row_id bigint, col_id bigint, note string")
    few = model.predict_few(request)
    assert few.columns == model.transform(request).columns
    assert rows(few) == rows(model.transform(request))
    assert {r["note"]: r["source"] for r in few.collect()}["x"] == "observed"
    assert model.predict([3, 5], [7, 0]).tolist() == [
        r["prediction"] for r in model.transform(request.where("note IN ('x', 'cold')")).orderBy(F.desc("note")).collect()]
    model.index = None


def test_predict_few_moves_no_cell(spark, model):
    model.index_cells(n_buckets=8)
    plan = plan_of(model.predict_few(spark.createDataFrame([(17, 4017)], "row_id bigint, col_id bigint")))
    assert "EqualTo(place" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    model.index.drop()
    model.index = None


def test_a_large_request_takes_the_join(spark, skewed, model):
    request = skewed.select("row_id", "col_id")
    model.set(model.getParam("broadcast_bytes"), 16 * 100)
    asked, real = [], model._found
    model._found = lambda df: (asked.append(1), real(df))[1]
    assert rows(model.predict_few(request)) == rows(model.transform(request))
    assert not asked
    del model._found
    model.set(model.getParam("broadcast_bytes"), 1 << 26)
    assert rows(model.predict_few(request.withColumnsRenamed({})).select("row_id", "col_id", "prediction")) == rows(skewed)


def test_many_pairs_are_not_broadcast(spark, skewed, index, monkeypatch, a_partition_per_file):
    asked = skewed.select("row_id", "col_id").where("col_id % 2 = 0")
    asked = asked.unionByName(asked).unionByName(skewed.selectExpr("row_id", "col_id + 6000 AS col_id"))
    want = rows(index.find(asked))
    monkeypatch.setattr(lookup, "BROADCAST_PAIRS", 100)
    found = index.find(asked)
    plan = plan_of(found)
    assert "BroadcastHashJoin LeftSemi" not in plan and "SortMergeJoin LeftSemi" in plan
    assert rows(found) == want == rows(skewed.where("col_id % 2 = 0"))


def test_a_given_number_of_buckets_is_the_least(spark, skewed, monkeypatch):
    monkeypatch.setattr(lookup, "CELLS_PER_BUCKET", 500)
    built = CellIndex.build(skewed, Scratch(spark, "index"), n_buckets=2, hot_cells=500)
    assert built.n_buckets == 12
    built.drop()
