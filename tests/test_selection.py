"""Boundaries, samples and splits against sorting everything."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.operators import index, sampling, split
from lacuna.session import Scratch

KEYS = "row_id bigint, col_id bigint"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("ranges", [2, 7, 4096])
def test_keys_at_positions_equal_those_of_a_sort(spark, monkeypatch, ranges):
    monkeypatch.setattr(index, "RANGES", ranges)
    rng = random.Random(ranges)
    cells = {(rng.choice([-(1 << 40), -5, 0, 3, 3, 3, 10 ** 12]), rng.randrange(-50, 10 ** 9)) for _ in range(80)}
    cells |= {(3, c) for c in range(60)}
    df, order = spark.createDataFrame(list(cells), KEYS), sorted(cells)
    wanted = [0, 1, 17, len(order) // 2, len(order) - 1]
    assert index.keys_at(df, wanted) == [order[p] for p in wanted]
    with pytest.raises(ValueError, match="beyond"):
        index.keys_at(df, [len(order)])


@pytest.mark.parametrize("folds", [1, 2, 3, 7, 40])
def test_contiguous_folds_cut_the_order_evenly(spark, folds):
    cells = [(r, c) for r in range(5) for c in range(r * 3)]
    df = Scratch(spark, "folds").write(spark.createDataFrame(cells, KEYS), "cells")
    got = index.contiguous_folds(df, folds, len(cells))
    assert "Exchange" not in plan_of(got)
    found = {(r["row_id"], r["col_id"]): r["fold"] for r in got.collect()}
    size, extra = divmod(len(cells), folds)
    want = [f for f in range(folds) for _ in range(size + (f < extra))]
    assert [found[k] for k in sorted(cells)] == want


def plain_sample(df, size, seed):
    return sorted(map(tuple, df.withColumn("h", F.md5(F.concat_ws(":", "row_id", "col_id", F.lit(seed)))).orderBy(
        "h", "row_id", "col_id").limit(size).drop("h").collect()))


@pytest.mark.parametrize("size", [0, 1, 50, 999, 1000, 5000])
@pytest.mark.parametrize("ordered", [0, 1 << 21])
def test_sample_equals_a_sort(spark, monkeypatch, size, ordered):
    monkeypatch.setattr(sampling, "ORDERED", ordered)
    df = spark.range(1000).selectExpr("id % 37 AS row_id", "id AS col_id", "id * 1D AS value")
    assert sorted(map(tuple, sampling.exact_sample(df, size, 5).collect())) == plain_sample(df, size, 5)


def test_sample_of_repeated_keys_has_its_size(spark):
    df = spark.range(2000).selectExpr("1L AS row_id", "1L AS col_id", "id * 1D AS value")
    assert sampling.exact_sample(df, 5, 1).count() == 5


def test_sample_reads_the_cells_once_and_keeps_few(spark, monkeypatch):
    kept, real = [], Scratch.write_observed
    monkeypatch.setattr(Scratch, "write_observed", lambda self, df, name, *a, **k: (lambda out: (kept.append(out[1]["n"]), out)[1])(real(self, df, name, *a, **k)))
    cells = Scratch(spark, "cells").write(spark.range(200_000).selectExpr("id % 777 AS row_id", "id AS col_id"), "cells")
    assert sampling.exact_sample(cells, 300, 1).count() == 300
    assert len(kept) == 1 and 300 <= kept[0] < 1000


def test_large_sample(spark):
    cells = Scratch(spark, "cells").write(spark.range(3_000_000).selectExpr("id % 777 AS row_id", "id AS col_id"), "cells")
    found = sampling.exact_sample(cells, 1_000_000, 1)
    assert found.count() == 1_000_000 and found.distinct().count() == 1_000_000


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 30), st.integers(0, 3))
def test_split_is_a_partition(spark, size, minimum):
    df = spark.range(120).selectExpr("id % 11 AS row_id", "id AS col_id", "1D + id AS value")
    parts = split.leave_n_out(df, size, minimum)
    train, test = set(map(tuple, parts.train.collect())), set(map(tuple, parts.test.collect()))
    assert not train & test and train | test == set(map(tuple, df.collect()))
    assert len(test) == (size if minimum <= 1 else 0)


def test_support_is_clipped_once(spark, monkeypatch):
    seen, real = [], split.support_clip
    monkeypatch.setattr(split, "support_clip", lambda *a: (seen.append(1), real(*a))[1])
    split.leave_n_out(spark.range(50).selectExpr("id % 5 AS row_id", "id AS col_id", "1D AS value"), 3, 1)
    assert len(seen) == 1
