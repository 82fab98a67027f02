import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import RATINGS, VIGNETTE
from lacuna.operators import factors, index, layout, metrics, products, sampling, scoring, split, validate
from lacuna.session import Scratch
from lacuna.sources import ratings as R


@pytest.fixture(scope="module")
def skewed(spark):
    """Row 0 holds a third of all cells."""
    wide = spark.range(300).selectExpr("0L AS row_id", "id AS col_id", "cast(id % 7 + 1 AS double) AS value")
    rest = spark.range(600).selectExpr("1 + id % 50 AS row_id", "(id * 37) % 300 AS col_id",
                                       "cast(id % 5 + 1 AS double) AS value")
    return R.assemble(wide.unionByName(rest)).cache()


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_csv_source(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text("userId,movieId,rating,timestamp\n1,10,3.5,9\n1,12,4.0,9\n7,10,1.0,9\n")
    schema = R.CSV_SCHEMA.add("timestamp", T.LongType())
    got = R.read_ratings_csv(spark, str(path), schema)
    assert got.columns == ["row_id", "col_id", "value"]
    assert as_set(got) == {(1, 10, 3.5), (1, 12, 4.0), (7, 10, 1.0)}
    assert R.profile(got, rank=50).first().asDict() == {
        "n_rows": 8, "n_cols": 13, "nnz": 3, "density": 3 / 104, "rank": 8}


def test_packed_columns(spark, vignette, vignette_packed):
    assert as_set(R.unpack_columns(vignette_packed)) == as_set(vignette)
    packed = R.pack_columns(vignette, segment=4)
    assert max(len(r["row_ids"]) for r in packed.collect()) <= 4
    assert as_set(R.unpack_columns(packed)) == as_set(vignette)
    first = R.pack_columns(vignette).filter("col_id = 1").first()
    assert (first["row_ids"], first["values"]) == VIGNETTE[1]
    bad = spark.createDataFrame([(0, [1, 2], [1.0])], vignette_packed.schema)
    with pytest.raises(Exception, match="differ in length"):
        R.unpack_columns(bad).collect()


def test_assemble_adds_repeated_cells(spark):
    df = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 1, 1.0)], RATINGS)
    assert as_set(R.assemble(df)) == {(0, 1, 5.0), (1, 1, 1.0)}
    assert as_set(R.transpose(df)) == {(1, 0, 2.0), (1, 0, 3.0), (1, 1, 1.0)}


def smallest(rows, size, seed):
    return set(sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}:{r[1]}:{seed}".encode()).hexdigest(), r[0], r[1]))[:size])


@pytest.mark.parametrize("size", [1, 40, 333, 10_000])
def test_exact_sample_equals_top_k(skewed, size):
    rows = as_set(skewed)
    assert as_set(sampling.exact_sample(skewed, size, 5)) == smallest(rows, size, 5)


def test_exact_sample_of_repeated_keys_ignores_partitions(spark):
    rows = [(i % 7, i % 5, float(i % 11)) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id bigint, col_id bigint, value double")
    one, many = (sorted(map(tuple, sampling.exact_sample(df.repartition(n), 57, 5).collect())) for n in (1, 8))
    assert one == many and len(one) == 57


def test_dense_position_and_folds(skewed):
    cells = sorted(as_set(skewed))
    got = {(r["row_id"], r["col_id"]): r["position"]
           for r in index.dense_position(skewed, ["row_id", "col_id"]).collect()}
    assert got == {(r, c): k for k, (r, c, _) in enumerate(cells)}
    folds = {(r["row_id"], r["col_id"]): r["fold"]
             for r in index.contiguous_folds(skewed, 7, len(cells)).collect()}
    expected = np.repeat(np.arange(7), [len(x) for x in np.array_split(np.arange(len(cells)), 7)])
    assert [folds[r, c] for r, c, _ in cells] == expected.tolist()
    names = skewed.select(F.concat(F.lit("n"), "row_id").alias("name"))
    keys = sorted({r["name"] for r in names.collect()})
    assert as_set(index.id_dictionary(names, "name")) == {(k, i) for i, k in enumerate(keys)}


def test_support_clip_is_one_pass(spark):
    # Column 9 falls below 2 only because row 3 is dropped; row 2 then has one cell and stays.
    cells = spark.createDataFrame(
        [(1, 1, 1.0), (1, 2, 1.0), (4, 1, 1.0), (4, 2, 1.0), (2, 1, 1.0), (2, 9, 1.0), (3, 9, 1.0)], RATINGS)
    assert as_set(split.support_clip(cells, 2).select("row_id", "col_id")) == {(1, 1), (1, 2), (4, 1), (4, 2), (2, 1)}


def test_leave_n_out_partitions_the_cells(skewed):
    cells = skewed.withColumn("value", F.col("value") - 1)
    parts = split.leave_n_out(cells, 20, min_support=2)
    train, test, everything = as_set(parts.train), as_set(parts.test), as_set(cells)
    assert len(test) == 20 and not train & test
    assert train | test == {c for c in everything if c[2] != 0 or c in test}
    assert as_set(split.leave_n_out(cells, 20, 2).test) == test
    assert as_set(split.leave_n_out(cells, 20, 2, seed=1).test) != test


def test_hot_rows_are_spread_and_results_stay(spark, skewed):
    scratch = Scratch(spark, "skew")
    settings = dict(n_rows=51, n_cols=300, nnz=skewed.count(), cells_per_partition=40)
    spread = layout.Layout(skewed, scratch, **settings, broadcast_bytes=0, hot_cells=30)
    assert spread.hot["row_id"].collect() == [(0, 10)]
    placed = spread.placed_by("row_id")
    per_salt = placed.filter("row_id = 0").groupBy("row_id_salt").count().collect()
    assert len(per_salt) == 10 and max(r["count"] for r in per_salt) < 60
    side = skewed.select("row_id").distinct().selectExpr("row_id", "cast(row_id + 1 AS double) AS p0")
    joined = spread.attach(placed, side, "row_id")
    assert joined.count() == skewed.count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
    got = as_set(products.residual_sums(placed, "col_id", 1, side, None, spread.attach))
    want = as_set(products.residual_sums(skewed, "col_id", 1, side, None))
    assert {(k, round(x, 9)) for k, x in got} == {(k, round(x, 9)) for k, x in want}
    spread.release()


def test_placed_cells_are_not_shuffled_again(spark, skewed):
    scratch = Scratch(spark, "placed")
    kept = layout.Layout(skewed, scratch, 51, 300, skewed.count(), broadcast_bytes=0)
    placed = kept.placed_by("row_id")
    placed.count()
    side = skewed.select("row_id").distinct().selectExpr("row_id", "1.0D AS p0")
    plan = kept.attach(placed, side, "row_id")._jdf.queryExecution().executedPlan().toString()
    cells_side = plan[plan.index("ShuffledHashJoin"):].split("InMemoryTableScan")[0]
    assert "Exchange" not in cells_side
    kept.release()


def test_request_checks(spark):
    pairs = spark.createDataFrame(
        [(0, 0, 0), (1, 9, 0), (2, 0, 9), (3, 9, 9), (4, -1, 0), (5, 0, -1)], "pos int, row_id bigint, col_id bigint")
    got = {r["pos"]: r["s"] for r in pairs.select("pos", validate.request_status(5, 5).alias("s")).collect()}
    assert got == {0: "ok", 1: "row_out_of_range", 2: "col_out_of_range", 3: "col_out_of_range",
                   4: "row_out_of_range", 5: "col_out_of_range"}
    with pytest.raises(ValueError):
        validate.check_requests(pairs.withColumn("row_id", F.lit(0.5)))


def test_pairs_from_arrays(spark):
    good = spark.createDataFrame([([0, 3], [1, 2])], "row_ids array<bigint>, col_ids array<bigint>")
    assert as_set(scoring.pairs_from_arrays(good)) == {(0, 0, 1), (1, 3, 2)}
    bad = spark.createDataFrame([([0, 3], [1])], good.schema)
    with pytest.raises(Exception, match="differ in length"):
        scoring.pairs_from_arrays(bad).collect()


def test_sparse_plus_low_rank_products(spark, vignette, vignette_dense):
    rng = np.random.default_rng(1)
    a, b, u, v = (rng.normal(size=(n, 2)) for n in (6, 5, 6, 5))

    def table(key, name, x):
        return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], f"{key} bigint, {name} array<double>")

    def collect(df, key, n):
        out = np.zeros((n, 2))
        for r in df.collect():
            out[r[key]] = r["product"]
        return out

    x = np.nan_to_num(vignette_dense)
    args = dict(a=table("row_id", "a", a), b=table("col_id", "b", b))
    right = products.right_multiply(vignette, table("col_id", "v", v), 2)
    assert collect(right, "row_id", 6) == pytest.approx(x @ v)
    right = products.right_multiply(vignette, table("col_id", "v", v), 2, **args)
    assert collect(right, "row_id", 6) == pytest.approx((x + a @ b.T) @ v)
    left = products.left_multiply(vignette, table("row_id", "u", u), 2, **args)
    assert collect(left, "col_id", 5) == pytest.approx((u.T @ (x + a @ b.T)).T)
    factors.check_conformance(vignette, table("row_id", "u", u), table("col_id", "v", v))
    with pytest.raises(ValueError, match="2 rows"):
        factors.check_conformance(vignette, table("row_id", "u", u[:4]), table("col_id", "v", v))
    with pytest.raises(ValueError, match="width"):
        factors.check_conformance(vignette, table("row_id", "u", u), table("col_id", "v", v[:, :1]))


def test_change_criteria_agree_on_diagonal_products():
    d_old, d_new = np.array([2.0, 1.0]), np.array([1.5, 0.5])
    cross = np.diag([0.9, 0.8])
    by = [factors.relative_change(d_old, d_new, cross, cross, c) for c in ("trace", "column_sum")]
    assert by[0] == pytest.approx(by[1])
    assert factors.relative_change(np.ones(2), np.zeros(2), np.zeros((2, 2)), np.zeros((2, 2))) == 1.0


def test_comparison_tables(spark):
    results = spark.createDataFrame(
        [("a", 1, 0, 1.0, 4.0, 1.0), ("a", 1, 1, 3.0, 16.0, 3.0), ("a", 2, 0, 5.0, 1.0, 1.0)],
        "model string, max_iter int, trial int, seconds double, mse double, train_rmse double")
    averages = metrics.result_averages(results)
    assert as_set(averages) == {("a", 1, 3.0, 2.0, 2.0), ("a", 2, 1.0, 5.0, 1.0)}
    assert as_set(metrics.iteration_delta(averages, ["rmse", "seconds"])) == {("a", 1, 3.0, 2.0), ("a", 2, 2.0, 3.0)}
    scores = spark.createDataFrame(
        [(10, 0.02, 0, 2.0), (10, 0.02, 1, 4.0), (10, 10.0, 0, 3.0), (10, 10.0, 1, 3.0), (20, 0.02, 0, 9.0)],
        "max_rank int, shrinkage double, fold int, mse double")
    assert metrics.grid_best(scores).collect() == [(10, 0.02, 3.0)]
