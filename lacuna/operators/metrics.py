"""Errors of predictions, and tables that compare settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def mean_squared_error(scored: DataFrame, truth: str, estimate: str, by: Sequence[str] = (),
                       alias: str = "mse") -> DataFrame:
    return scored.groupBy(*by).agg(F.expr(f"avg(power({truth} - {estimate}, 2))").alias(alias))


def root_mean_squared_error(scored: DataFrame, truth: str, estimate: str, by: Sequence[str] = (),
                            alias: str = "rmse") -> DataFrame:
    return mean_squared_error(scored, truth, estimate, by, alias).withColumn(alias, F.sqrt(alias))


def result_averages(results: DataFrame, measures: Sequence[str] = ("seconds", "train_rmse")) -> DataFrame:
    """Per model and iteration budget over trials: the mean of the RMSEs, and of other measures."""
    return results.groupBy("model", "max_iter").agg(
        F.avg(F.sqrt("mse")).alias("rmse"), *[F.avg(m).alias(m) for m in measures])


def iteration_delta(averages: DataFrame, measures: Sequence[str] = ("rmse",)) -> DataFrame:
    """Absolute change from one iteration budget to the next; the first value is kept as it is."""
    order = Window.partitionBy("model").orderBy("max_iter")
    return averages.select("model", "max_iter", *[
        F.coalesce(F.abs(F.col(m) - F.lag(m).over(order)), F.col(m)).alias(f"{m}_change") for m in measures])


def grid_best(scores: DataFrame, settings: Sequence[str] = ("max_rank", "shrinkage")) -> DataFrame:
    """The grid point with the smallest mean error over folds; ties go to the smaller setting."""
    return (scores.groupBy(*settings).agg(F.avg("mse").alias("mse"))
            .orderBy("mse", *settings).limit(1))


def imputation_mean(runs: DataFrame, keys: Sequence[str] = ("row_id", "col_id")) -> DataFrame:
    """Average prediction per pair over several runs; averaging factors would be meaningless.

    No task holds a pair twice before the shuffle, so nothing is summed there. The number of partitions is given: adaptive
    execution would put as many pairs into a task as their compressed size allows, and its hash table holds them plain.
    """
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.select(*keys, "prediction").repartition(parts, *keys)
    return runs.groupBy(*keys).agg(F.avg("prediction").alias("prediction"), F.count("*").alias("runs"))
