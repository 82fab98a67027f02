"""Registered queries. Each reads the given tables and returns a DataFrame.

Values are rounded so that they can be compared with another engine's sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.vectors import array_scale, pack
from lacuna.operators import factors, index, lookup, metrics, products, sampling, scaling, scoring, split, validate
from lacuna.operators.layout import Layout, broadcast_share
from lacuna.plans import tuning
from lacuna.plans.estimators import BiScale, CompletionModel, SoftImpute, SoftImputeALS, multiple_imputations
from lacuna.plans.solvers import LowRank, Settings, half_step, start
from lacuna.session import Scratch
from lacuna.sources import ratings as R

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SUPPORT = 25
HOLDOUT = 300
SHRINKAGE = 9.0


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def cells_of(spark: SparkSession, folder: str, row: str = "customer", col: str = "part") -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    return R.assemble(R.sales_ratings(spark, folder, row, col), parts=R.parts_for(spark, lines))


def event_cells(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_type", "value")
    types = index.id_dictionary(events, "event_type")
    return R.assemble(events.join(types, "event_type").select(
        F.col("user_id").alias("row_id"), F.col("id").alias("col_id"), "value"))


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    wanted = names or tuple(f.name for f in df.schema.fields if f.dataType.typeName() == "double")
    return df.select(*[F.round(c, digits).alias(c) if c in wanted else F.col(c) for c in df.columns])


def both_sides(row_table: DataFrame, col_table: DataFrame) -> DataFrame:
    """Row and column tables under one key column."""
    return row_table.withColumnRenamed("row_id", "id").withColumn("side", F.lit("row")).unionByName(
        col_table.withColumnRenamed("col_id", "id").withColumn("side", F.lit("col")))


def given_factors(cells: DataFrame, key: str, name: str, rank: int = 2, first: int = 0) -> DataFrame:
    """Vectors by integer arithmetic for every id of the cells."""
    entries = factors.integer_start(first + rank, key)[first:]
    names = [e.split(" AS ")[1] for e in entries]
    return cells.select(key).distinct().selectExpr(key, *entries).selectExpr(key, pack(names, name))


def _placed(cells: DataFrame, scratch: Scratch) -> Layout:
    """The cells, written once, and their sizes."""
    table, seen = scratch.write_observed(cells, "cells", nnz="count(*)", rows="max(row_id) + 1", cols="max(col_id) + 1")
    return Layout(table, scratch, seen["rows"], seen["cols"], seen["nnz"], broadcast_share(table.sparkSession))


def _given_fit(layout: Layout, rank: int, first: int, d: list[float]) -> DataFrame:
    """``products.fitted_cells`` of the written cells with given vectors, which are sent to them if they are small."""
    u, v = (given_factors(layout.cells, key, name, rank, first) for key, name in (("row_id", "u"), ("col_id", "v")))
    return products.fitted_cells(layout.cells, u, v, rank, d, layout.attach)


def first_pass(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row and column centers after one pass."""
    cols = scaling.mean_residual(cells, "col_id", None)
    return scaling.mean_residual(cells, "row_id", cols), cols


# Sources


@query
def ratings_coo(spark, folder):
    return cells_of(spark, folder)


@query
def ratings_csv(spark, folder):
    """The ratings written as a CSV file and read back."""
    path = Scratch(spark, "csv").path("ratings")
    R.sales_ratings(spark, folder).select(
        F.col("row_id").alias("userId"), F.col("col_id").alias("movieId"),
        F.col("value").cast("double").alias("rating")).write.option("header", True).csv(path)
    return R.assemble(R.read_ratings_csv(spark, path))


@query
def transpose(spark, folder):
    return R.transpose(cells_of(spark, folder))


@query
def adjacency_pack(spark, folder):
    packed = R.pack_columns(cells_of(spark, folder), segment=512)
    return packed.select(
        "col_id", "segment", F.size("row_ids").cast("bigint").alias("n"),
        F.expr("array_join(row_ids, ',')").alias("row_ids"),
        F.expr("array_join(transform(values, x -> cast(x AS bigint)), ',')").alias("vals"))


@query
def adjacency_unpack(spark, folder):
    return R.unpack_columns(R.pack_columns(cells_of(spark, folder)))


def _profiles(spark, folder, rank=None):
    views = {"cp": cells_of(spark, folder), "cs": cells_of(spark, folder, "customer", "supplier"),
             "ps": cells_of(spark, folder, "supplier", "part"), "ue": event_cells(spark, folder)}
    out = None
    for name, cells in views.items():
        one = R.profile(cells, rank).withColumn("view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def matrix_profile(spark, folder):
    return rounded(_profiles(spark, folder, 50))


@query
def mask_validity(spark, folder):
    flags = validate.mask_flags(_profiles(spark, folder))
    return flags.select("view", *[F.col(c).cast("int").alias(c) for c in ("is_full", "is_empty", "is_valid")])


@query
def id_dictionary(spark, folder):
    return index.id_dictionary(spark.read.parquet(f"{folder}/part.parquet").select("p_name"), "p_name")


@query
def pairs_from_arrays(spark, folder):
    requests = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber",
        F.expr("array(l_orderkey, l_partkey)").alias("row_ids"),
        F.expr("array(l_suppkey, cast(l_linenumber AS bigint))").alias("col_ids"))
    return scoring.pairs_from_arrays(requests)


# Centering


@query
def center_weights(spark, folder):
    cells = cells_of(spark, folder).withColumn("value", F.expr("value - 10"))
    return both_sides(scaling.center_weights(cells, "row_id"), scaling.center_weights(cells, "col_id"))


@query
def center_pass1(spark, folder):
    return rounded(both_sides(*first_pass(cells_of(spark, folder))))


@query
def center_residual(spark, folder):
    cells = cells_of(spark, folder)
    return rounded(scaling.residual_cells(cells, *first_pass(cells)))


@query
def center_trace(spark, folder):
    return rounded(BiScale(max_iter=2, threshold=0.0).fit(cells_of(spark, folder)).trace, 4)


@query
def bicenter_2pass(spark, folder):
    model = BiScale(max_iter=2, threshold=0.0).fit(cells_of(spark, folder))
    return rounded(both_sides(model.row_stats, model.col_stats))


@query
def bicenter_residual(spark, folder):
    return rounded(BiScale(max_iter=2, threshold=0.0).fit(cells_of(spark, folder)).residuals)


@query
def inverse_transform(spark, folder):
    cells = cells_of(spark, folder)
    rows, cols = first_pass(cells)
    fitted = products.fitted_cells(cells, given_factors(cells, "row_id", "u"), given_factors(cells, "col_id", "v"), 2)
    predictions = fitted.select("row_id", "col_id", F.col("xhat").alias("prediction"))
    return rounded(scaling.inverse_transform(
        predictions, scaling.stats_table(rows, "row_id"), scaling.stats_table(cols, "col_id")))


# Splits and samples


@query
def ratings_sample(spark, folder):
    return sampling.exact_sample(Scratch(spark, "cells").write(cells_of(spark, folder), "cells"), 5000, 2)


def planted_defects(spark, folder):
    """Ratings of the sales tables, some with a null id, a null value or NaN."""
    raw = R.sales_ratings(spark, folder, "supplier", "part")
    return raw.select(
        F.expr("nullif(row_id, 7)").alias("row_id"), F.expr("nullif(col_id, 11)").alias("col_id"),
        F.expr("CASE WHEN value = 13 THEN NULL WHEN value = 17 THEN double('NaN') ELSE double(value) END").alias("value"))


@query
def input_defects(spark, folder):
    return validate.defect_counts(planted_defects(spark, folder))


@query
def support_rows(spark, folder):
    return split.support_filter(cells_of(spark, folder), "row_id", SUPPORT).select(*R.KEYS, "value")


@query
def support_clip(spark, folder):
    return split.support_clip(cells_of(spark, folder), SUPPORT).select(*R.KEYS, "value")


def _split(spark, folder, offset=0):
    cells = cells_of(spark, folder).withColumn("value", F.col("value") - offset)
    return cells, split.leave_n_out(cells, HOLDOUT, SUPPORT)


@query
def lno_test(spark, folder):
    return _split(spark, folder)[1].test


@query
def lno_train(spark, folder):
    return _split(spark, folder)[1].train


@query
def lno_train_zeros(spark, folder):
    return _split(spark, folder, 10)[1].train


@query
def lno_partition_check(spark, folder):
    cells, parts = _split(spark, folder, 10)
    tagged = (cells.select(*R.KEYS, F.lit(1).alias("c"), F.lit(0).alias("tr"), F.lit(0).alias("te"),
                           F.expr("int(value = 0)").alias("z"))
              .unionByName(parts.train.select(*R.KEYS, F.lit(0).alias("c"), F.lit(1).alias("tr"), F.lit(0).alias("te"),
                                              F.lit(0).alias("z")))
              .unionByName(parts.test.select(*R.KEYS, F.lit(0).alias("c"), F.lit(0).alias("tr"), F.lit(1).alias("te"),
                                             F.lit(0).alias("z"))))
    per_cell = tagged.groupBy(*R.KEYS).agg(*[F.sum(c).alias(c) for c in ("c", "tr", "te", "z")])
    return per_cell.agg(
        F.sum("c").alias("cells"), F.sum("tr").alias("train"), F.sum("te").alias("test"),
        F.sum(F.expr("int(tr > 0 AND te > 0)")).cast("bigint").alias("overlap"),
        F.sum(F.expr("int(tr = 0 AND te = 0 AND z = 0)")).cast("bigint").alias("lost"),
        F.sum(F.expr("int(tr = 0 AND te = 0 AND z = 1)")).cast("bigint").alias("zeros_dropped"))


@query
def kfold_assign(spark, folder):
    cells, seen = Scratch(spark, "kfold").write_observed(cells_of(spark, folder).select(*R.KEYS), "cells", n="count(*)")
    return index.hash_folds(index.contiguous_folds(cells, 3, seen["n"], "fold_contiguous"), 3, "fold_hash")


@query
def load_and_split(spark, folder):
    parts = tuning.load_and_split(cells_of(spark, folder), 10_000, leave_n=3, seed=2)
    return parts.train.withColumn("part", F.lit("train")).unionByName(parts.test.withColumn("part", F.lit("test")))


# Factor algebra on given vectors


@query
def factor_scale(spark, folder):
    scaled = factors.scale_columns(given_factors(cells_of(spark, folder), "row_id", "u"), "u", [2.5, 0.75])
    return rounded(scaled.select("row_id", F.expr("u[0] AS u0"), F.expr("u[1] AS u1")))


def _row_svd(spark, folder):
    table = given_factors(cells_of(spark, folder), "row_id", "u")
    return (table, *factors.table_svd(table, "row_id", "u", 2))


@query
def factor_shrink(spark, folder):
    table, _, d, _ = _row_svd(spark, folder)
    shrunk = table.withColumn("u", array_scale("u", factors.shrink_weights(d, 5.0)))
    return rounded(shrunk.select("row_id", F.expr("u[0] AS u0"), F.expr("u[1] AS u1")))


@query
def soft_threshold(spark, folder):
    _, _, d, _ = _row_svd(spark, folder)
    values = factors.soft_threshold(d, 5.0)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(d, values))]
    out = spark.createDataFrame(rows, "k bigint, d double, thresholded double")
    return rounded(out.withColumn("effective_rank", F.lit(int((values > 0).sum())).cast("bigint")))


@query
def factor_gram(spark, folder):
    table = given_factors(cells_of(spark, folder), "row_id", "u", 3)
    return rounded(factors.array_gram(table, "u", 3).select(
        F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "g"))


@query
def factor_svd(spark, folder):
    _, ortho, s, _ = _row_svd(spark, folder)
    return rounded(ortho.select(
        "row_id", F.expr("u[0] * u[0] + u[1] * u[1]").alias("leverage"),
        F.lit(float(s[0])).alias("s0"), F.lit(float(s[1])).alias("s1")), 8)


@query
def factor_change(spark, folder):
    cells = cells_of(spark, folder)
    u_old, u_new = (given_factors(cells, "row_id", "u", 2, k) for k in (0, 2))
    v_old, v_new = (given_factors(cells, "col_id", "v", 2, k) for k in (0, 2))
    cross_u = factors.cross_gram(u_new, u_old, "row_id", "u", "u", 2)
    cross_v = factors.cross_gram(v_new, v_old, "col_id", "v", "v", 2)
    d_old, d_new = np.array([2.0, 1.0]), np.array([1.5, 0.5])
    row = tuple(factors.relative_change(d_old, d_new, cross_u, cross_v, c) for c in ("trace", "column_sum"))
    return rounded(spark.createDataFrame([row], "by_trace double, by_column_sum double"), 4)


@query
def factor_conformance(spark, folder):
    cells = cells_of(spark, folder)
    supported = split.support_filter(cells, "col_id", SUPPORT)
    found = factors.conformance(
        cells, given_factors(cells, "row_id", "u"), given_factors(supported, "col_id", "v"))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns])


@query
def sddmm(spark, folder):
    cells = cells_of(spark, folder)
    return rounded(products.fitted_cells(
        cells, given_factors(cells, "row_id", "u"), given_factors(cells, "col_id", "v"), 2, [3.0, 2.0]))


@query
def splr_r_mult(spark, folder):
    cells = cells_of(spark, folder)
    out = products.right_multiply(
        cells, given_factors(cells, "col_id", "v"), 2,
        given_factors(cells, "row_id", "a", 2, 1), given_factors(cells, "col_id", "b", 2, 2))
    return rounded(out.select("row_id", F.expr("product[0] AS p0"), F.expr("product[1] AS p1")), 9)


@query
def splr_l_mult(spark, folder):
    cells = cells_of(spark, folder)
    out = products.left_multiply(
        cells, given_factors(cells, "row_id", "u"), 2,
        given_factors(cells, "row_id", "a", 2, 1), given_factors(cells, "col_id", "b", 2, 2))
    return rounded(out.select("col_id", F.expr("product[0] AS p0"), F.expr("product[1] AS p1")), 9)


@query
def product_orphans(spark, folder):
    """Products with vectors for the well-supported ids only: per group the product, and how many cells had no vector."""
    cells, out = cells_of(spark, folder), None
    scratch = Scratch(spark, "orphans")
    for key, group, letter in (("col_id", "row_id", "v"), ("row_id", "col_id", "u")):
        supported = split.support_filter(cells, key, SUPPORT)
        table, seen = products.counted_product(cells, group, given_factors(supported, key, letter), letter, 2, scratch)
        one = table.select(F.lit(group).alias("side"), F.col(group).alias("id"), F.expr("product[0] AS p0"),
                           F.expr("product[1] AS p1"), F.lit(seen["unmatched"]).alias("unmatched"), F.lit(seen["cells"]).alias("cells"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 9)


# Scoring and errors


def _requests(spark, folder):
    """Observed, unobserved, negative and too large pairs."""
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.expr("l_suppkey * 16 - 50").alias("row_id"),
        F.expr("l_partkey + l_linenumber - 3").alias("col_id"))


@query
def request_status(spark, folder):
    n_rows, n_cols = tuning.shape_of(cells_of(spark, folder))
    return _requests(spark, folder).withColumn("status", validate.request_status(n_rows, n_cols))


@query
def predict_pairs(spark, folder):
    cells = cells_of(spark, folder)
    n_rows, n_cols = tuning.shape_of(cells)
    rows, cols = first_pass(cells)
    rows = scaling.stats_table(rows, "row_id").join(given_factors(cells, "row_id", "u"), "row_id")
    cols = scaling.stats_table(cols, "col_id").join(given_factors(cells, "col_id", "v"), "col_id")
    return rounded(scoring.score_pairs(_requests(spark, folder), rows, cols, [3.0, 2.0], n_rows, n_cols, cells))


@query
def predict_few(spark, folder):
    """Scores of the requests by a saved-cells lookup instead of a join with all cells; the fit of ``model_roundtrip``."""
    model = _rank1_estimator(SoftImputeALS, max_iters=3).fit(cells_of(spark, folder))
    model.index_cells(n_buckets=16, hot_cells=200)
    return rounded(model.predict_few(_requests(spark, folder)), 4)


@query
def cell_lookup(spark, folder):
    """The observed cells among the requests, by the bucketed and sorted table."""
    scratch = Scratch(spark, "lookup")
    cells = scratch.write(cells_of(spark, folder), "cells")
    found = lookup.CellIndex.build(cells, scratch, n_buckets=16, hot_cells=200)
    return found.find(scratch.write(_requests(spark, folder).select(*R.KEYS), "requests"))


@query
def train_rmse(spark, folder):
    layout = _placed(cells_of(spark, folder), Scratch(spark, "train_rmse"))
    fitted = _given_fit(layout, 2, 0, [3.0, 2.0])
    return rounded(metrics.root_mean_squared_error(fitted, "value", "xhat"))


@query
def heldout_mse(spark, folder):
    parts = _split(spark, folder)[1]
    scratch = Scratch(spark, "heldout")
    train, test = scratch.write(parts.train, "train"), scratch.write(parts.test, "test")
    rows, cols = first_pass(train)
    zero = test.withColumn("prediction", F.lit(0.0))
    scored = scaling.inverse_transform(
        zero, scaling.stats_table(rows, "row_id"), scaling.stats_table(cols, "col_id"))
    return rounded(metrics.mean_squared_error(scored, "value", "prediction"))


@query
def imputation_mean(spark, folder):
    layout = _placed(cells_of(spark, folder), Scratch(spark, "imputation"))
    runs = None
    for first in range(3):
        run = _given_fit(layout, 1, first, [10.0])
        run = run.select(*R.KEYS, F.col("xhat").alias("prediction"))
        runs = run if runs is None else runs.unionByName(run)
    return rounded(metrics.imputation_mean(runs))


def center_results(spark, folder, trials: int = 3, budgets: int = 3) -> DataFrame:
    """A results table from the data: two ways of centering, three budgets, three held-out folds.

    All trials run at once, with the centers of a trial as one more column; the cells are placed once by row and once by column.
    """
    scratch = Scratch(spark, "results")
    layout = _placed(index.hash_folds(cells_of(spark, folder), trials), scratch)
    out, first, centers = None, None, {"row_id": None, "col_id": None}
    for budget in range(1, budgets + 1):
        for key, other in (("col_id", "row_id"), ("row_id", "col_id")):
            means = scaling.fold_means(layout.cells_for(key, centers[other]), key, centers[other], trials, layout.attach)
            centers[key] = scratch.write(means, f"{key}_{budget}")
        # Column centers alone do not change after the first budget.
        models = {"bi_center": "value - r{t} - c{t}"} | ({"col_center": "value - c{t}"} if budget == 1 else {})
        sides = {key: table.withColumnsRenamed({f"center{t}": f"{key[0]}{t}" for t in range(trials)}) for key, table in centers.items()}
        cells = layout.cells_for("row_id", sides["col_id"])
        scored = layout.attach(layout.attach(cells, sides["col_id"], "col_id"), sides["row_id"], "row_id")
        rows = []
        for model, residual in models.items():
            for t in range(trials):
                error = f"power({residual.format(t=t)}, 2)"
                rows.append(f"named_struct('model', '{model}', 'max_iter', {budget}, 'trial', {t}, "
                            f"'mse', avg(CASE WHEN fold = {t} THEN {error} END), "
                            f"'train_rmse', sqrt(avg(CASE WHEN fold != {t} THEN {error} END)))")
        errors = scratch.write(scored.agg(F.expr(f"array({', '.join(rows)})").alias("rows")).select(F.inline("rows")), f"errors{budget}")
        first = errors if first is None else first
        again = first.where("model = 'col_center'").withColumn("max_iter", F.lit(budget))
        one = errors.where("model = 'bi_center'").unionByName(again)
        out = one if out is None else out.unionByName(one)
    layout.release()
    return out


@query
def result_averages(spark, folder):
    return rounded(metrics.result_averages(center_results(spark, folder), ["train_rmse"]))


@query
def iteration_delta(spark, folder):
    averages = metrics.result_averages(center_results(spark, folder), ["train_rmse"])
    return rounded(metrics.iteration_delta(averages, ["rmse", "train_rmse"]))


@query
def grid_best(spark, folder):
    estimator = SoftImputeALS(max_iters=1, convergence_threshold=0.0, init="integer", center=False)
    _, scores = tuning.grid_search(estimator, cells_of(spark, folder),
                                   {"max_rank": [1], "shrinkage_value": [0.02, 10.0, 400.0]}, kind="hash")
    return rounded(metrics.grid_best(scores, ["max_rank", "shrinkage_value"]), 4)


@query
def grid_scores(spark, folder):
    """The whole grid at rank 1 with the reference's 30 iterations and contiguous folds."""
    estimator = SoftImputeALS(max_iters=30, convergence_threshold=0.0, init="integer", center=False)
    _, scores = tuning.grid_search(estimator, cells_of(spark, folder), {"max_rank": [1], "shrinkage_value": [0.02, 10.0, 400.0]})
    return rounded(scores, 4)


@query
def imputations_of_fits(spark, folder):
    """The mean of three fits from different starts, made side by side, for every request inside the shape."""
    asked = _requests(spark, folder).select(*R.KEYS)
    # As in ``cells_of``: pairs hardly repeat, and a task gets a million of them.
    pairs = asked.repartition(R.parts_for(spark, asked.count()), *R.KEYS).distinct()
    found = multiple_imputations(_rank1_estimator(SoftImputeALS, max_iters=3, observed="model"), cells_of(spark, folder), pairs, [0, 1, 2])
    return rounded(found, 4)


# Half steps and fits at rank 1


def _started(spark, folder, label):
    settings = Settings(rank=1, shrinkage=SHRINKAGE, init="integer")
    layout = SoftImputeALS()._layout(cells_of(spark, folder), Scratch(spark, label))
    return layout, *start(layout, settings)


@query
def init_factors(spark, folder):
    _, u, _, _ = _started(spark, folder, "init")
    return rounded(u.select("u"), 8)


def _first_step(layout, u, d, lam):
    """Columns from rows, before any low-rank part exists; the same in both methods."""
    step = half_step(layout, "cols", "col_id", 1, u, None, None, factors.shrink_weights(d, lam))
    d, w, over = factors.thin_svd(step.raw, step.gram)
    return step.raw.times(over), d, u.times(w)


@query
def als_a_step(spark, folder):
    layout, u, d, lam = _started(spark, folder, "a_step")
    v, d, _ = _first_step(layout, u, d, lam)
    layout.release()
    return rounded(v.select("v").withColumn("d", F.lit(float(d[0]))))


@query
def als_b_step(spark, folder):
    layout, u, d, lam = _started(spark, folder, "b_step")
    v, d, u = _first_step(layout, u, d, lam)
    step = half_step(layout, "rows", "row_id", 1, v, LowRank(v, d, u), u, factors.shrink_weights(d, lam))
    d, _, over = factors.thin_svd(step.raw, step.gram)
    layout.release()
    return rounded(step.raw.times(over).select("u").withColumn("d", F.lit(float(d[0]))))


def _filled(spark, folder, label):
    """A matrix filled in by given rank-1 vectors with singular value 100."""
    layout, u, _, lam = _started(spark, folder, label)
    ids = layout.cells.select("col_id").distinct()
    return layout, u, factors.orthonormal_start(ids, "col_id", 1, "integer"), np.array([100.0]), lam


@query
def si_u_step(spark, folder):
    layout, u, v, d, lam = _filled(spark, folder, "u_step")
    step = half_step(layout, "cols", "col_id", 1, u, LowRank(u, d, v, np.eye(1)), v, factors.shrink_weights(d, lam))
    d, _, over = factors.thin_svd(step.raw, step.gram)
    layout.release()
    return rounded(step.raw.times(over).select("v").withColumn("d", F.lit(float(d[0]))))


@query
def si_v_step(spark, folder):
    layout, u, v, d, lam = _filled(spark, folder, "v_step")
    step = half_step(layout, "rows", "row_id", 1, v, LowRank(v, d, u, np.eye(1)), u, factors.shrink_weights(d, lam))
    d, _, over = factors.thin_svd(step.raw, step.gram)
    layout.release()
    return rounded(step.raw.times(over).select("u").withColumn("d", F.lit(float(d[0]))))


def _fitted_cells(model: CompletionModel, digits: int = 4) -> DataFrame:
    fitted = model.fitted().select(*R.KEYS, "prediction").withColumn("d", F.lit(float(model.d[0])))
    return rounded(fitted, digits)


def _rank1_estimator(kind, shrinkage=SHRINKAGE, **settings):
    return kind(max_rank=1, shrinkage_value=shrinkage, convergence_threshold=0.0, init="integer",
                center_max_iter=2, center_threshold=0.0, **settings)


def _rank1(kind, spark, folder, **settings):
    return _fitted_cells(_rank1_estimator(kind, **settings).fit(cells_of(spark, folder)))


@query
def si_inner(spark, folder):
    return _rank1(SoftImpute, spark, folder, max_iters=1, max_inner_iters=2, center=False)


@query
def soft_impute_rank1(spark, folder):
    return _rank1(SoftImpute, spark, folder, max_iters=2, max_inner_iters=2)


@query
def als_rank1(spark, folder):
    return _rank1(SoftImputeALS, spark, folder, max_iters=3)


@query
def als_rank1_raw(spark, folder):
    return _rank1(SoftImputeALS, spark, folder, max_iters=3, center=False)


@query
def als_rank1_default(spark, folder):
    """No shrinkage given: the default."""
    return _rank1(SoftImputeALS, spark, folder, shrinkage=None, max_iters=3)


@query
def model_roundtrip(spark, folder):
    model = _rank1_estimator(SoftImputeALS, max_iters=3).fit(cells_of(spark, folder))
    path = Scratch(spark, "saved").path("model")
    model.save(path)
    return rounded(CompletionModel.load(path, spark).transform(_requests(spark, folder)), 4)


@query
def model_store(spark, folder):
    """Two models saved with one store of cells; the second is read after the first is removed."""
    scratch, estimator = Scratch(spark, "store"), _rank1_estimator(SoftImputeALS, max_iters=3)
    one, two = estimator.fit_many(cells_of(spark, folder), [{estimator.getParam("shrinkage_value"): x} for x in (1.0, SHRINKAGE)])
    for name, model in (("one", one), ("two", two)):
        model.save(scratch.path(name), store=scratch.path("cells"))
    CompletionModel.remove(scratch.path("one"), spark)
    return rounded(CompletionModel.load(scratch.path("two"), spark).transform(_requests(spark, folder)), 4)


@query
def fit_and_score(spark, folder):
    """The budget of ``fit_and_score_full``, from start vectors that SQL can follow."""
    parts = _split(spark, folder)[1]
    estimator = SoftImputeALS(max_rank=8, shrinkage_value=0.02, max_iters=50, init="integer")
    _, scored, mse, rmse = tuning.fit_and_score(estimator, parts)
    return rounded(scored.withColumn("mse", F.lit(mse)).withColumn("train_rmse", F.lit(rmse)), 4,
                   "prediction", "mse", "train_rmse")


# Fits at higher rank, tuning and comparison


@query
def fit_and_score_full(spark, folder):
    """Rank 8, up to 50 iterations, ended by the stop test, from random start vectors; see ``fit_and_score``."""
    parts = _split(spark, folder)[1]
    estimator = SoftImputeALS(max_rank=8, shrinkage_value=0.02, max_iters=50)
    _, scored, mse, rmse = tuning.fit_and_score(estimator, parts)
    return scored.withColumn("mse", F.lit(mse)).withColumn("train_rmse", F.lit(rmse))


@query
def als_fit(spark, folder):
    model = SoftImputeALS(max_rank=10, shrinkage_value=SHRINKAGE, max_iters=50).fit(cells_of(spark, folder))
    return model.fitted()


@query
def soft_impute_fit(spark, folder):
    model = SoftImpute(max_rank=2, shrinkage_value=SHRINKAGE, max_iters=5, max_inner_iters=5).fit(
        cells_of(spark, folder))
    return model.fitted()


@query
def grid_search(spark, folder):
    estimator = SoftImputeALS(max_iters=30)
    _, scores = tuning.grid_search(estimator, cells_of(spark, folder),
                                   {"max_rank": [10, 20], "shrinkage_value": [0.02, 10.0]})
    return scores


@query
def mllib_als_baseline(spark, folder):
    parts = _split(spark, folder)[1]
    scored, mse, rmse = tuning.comparator_fit(parts, rank=8, max_iter=50)
    return scored.withColumn("mse", F.lit(mse)).withColumn("train_rmse", F.lit(rmse))


@query
def mllib_als_grid(spark, folder):
    return tuning.comparator_grid(cells_of(spark, folder))[1]


@query
def comparator_error(spark, folder):
    """The comparator's scores of the held-out cells and their error."""
    parts = _split(spark, folder)[1]
    scored, mse, _ = tuning.comparator_fit(parts, rank=8, max_iter=50)
    scratch = Scratch(spark, "scored")
    scored = scratch.write(scored.select(*R.KEYS, "value", "prediction"), "cells")
    again = metrics.mean_squared_error(scored, "value", "prediction").first()["mse"]
    finite = F.expr("int(prediction IS NOT NULL AND NOT isnan(prediction))")
    return scored.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("col_id").cast("bigint").alias("col_id"), "value",
                         finite.alias("scored"), F.lit(int(abs(mse - again) < 1e-9 * again)).alias("error_agrees"))


def _trial(spark, folder, sample, label):
    cells = Scratch(spark, label).write(cells_of(spark, folder), "cells")
    return lambda trial: tuning.load_and_split(cells, sample, leave_n=3, seed=trial)


@query
def comparison_run(spark, folder):
    """Seconds and errors of three methods for budgets of 1 to 5 iterations on 1,000 ratings, rank 10 and penalty 9."""
    return tuning.comparison_run(_trial(spark, folder, 1_000, "compare"), contestants=tuning.CONTESTANTS)


@query
def comparison_tuned(spark, folder):
    """One trial of the tuned comparison on 10,000 ratings, 8 iterations: what was run, without the errors and seconds."""
    found = tuning.comparison_run(_trial(spark, folder, 10_000, "tuned"), budgets=(8,), tune=True, iterations=8)
    return found.select("model", "max_iter", "trial", "n_train", "n_test",
                        F.expr("int(rank IN (10, 20) AND penalty IN (0.02, 10.0) AND mse > 0 AND train_rmse > 0)").alias("complete"))


@query
def load_and_split_csv(spark, folder):
    """``load_and_split`` from a written CSV file."""
    path = Scratch(spark, "csv").path("ratings")
    cells_of(spark, folder).select(F.col("row_id").alias("userId"), F.col("col_id").alias("movieId"),
                                   F.col("value").cast("double").alias("rating")).write.option("header", True).csv(path)
    parts = tuning.load_and_split_file(spark, path, 10_000, leave_n=3, seed=2)
    return parts.train.withColumn("part", F.lit("train")).unionByName(parts.test.withColumn("part", F.lit("test")))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Split the ratings, fit a centered rank-2 model, and score the held-out cells."""
    parts = split.leave_n_out(cells_of(spark, folder), HOLDOUT, SUPPORT)
    model = SoftImputeALS(max_rank=2, shrinkage_value=SHRINKAGE, max_iters=10).fit(parts.train)
    return model.transform(parts.test)
