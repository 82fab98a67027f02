"""Splitting, tuning and comparing on ratings."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import metrics
from lacuna.operators.index import contiguous_folds, hash_folds
from lacuna.operators.sampling import exact_sample
from lacuna.operators.split import Split, leave_n_out
from lacuna.plans.estimators import CompletionModel, SoftImpute, SoftImputeALS
from lacuna.operators.layout import CELLS_PER_PARTITION
from lacuna.session import Scratch, free
from lacuna.sources.ratings import KEYS, assemble, read_ratings_csv

MAX_COMPARATOR_ID = 2 ** 31 - 1
#: Cells in a block of the comparator, at most.
COMPARATOR_BLOCK_CELLS = 3_000_000
#: Heap of the driver that the plans, broadcasts and garbage of one running fit take.
FIT_HEAP = 512 << 20


def load_and_split(triples: DataFrame, sample: int, leave_n: int = 3, seed: int = 0,
                   min_support: int | None = None) -> Split:
    """Rating rows to a training matrix and held-out cells: sample, assemble, split."""
    return leave_n_out(assemble(exact_sample(triples, sample, seed)), leave_n, min_support)


def fit_and_score(estimator: SoftImputeALS, split: Split) -> tuple[CompletionModel, DataFrame, float, float]:
    """Model, scored held-out cells, their error, and the training error."""
    model = estimator.fit(split.train)
    # Held-out cells are no training cells, so none has a stored value to look up.
    scored = model.transform(split.test, {model.getParam("observed"): "model"})
    mse = metrics.mean_squared_error(scored, "value", "prediction").first()["mse"]
    return model, scored, mse, model.train_rmse()


def with_folds(cells: DataFrame, folds: int, kind: str = "contiguous", scratch: Scratch | None = None) -> DataFrame:
    """Cells with a ``fold`` column. They are written once because every fold reads them; the fold is a projection."""
    scratch = scratch or Scratch(cells.sparkSession, "folds")
    table, seen = scratch.write_observed(cells.select(*KEYS, "value"), "folds", n="count(*)")
    return contiguous_folds(table, folds, seen["n"]) if kind == "contiguous" else hash_folds(table, folds)


def shape_of(cells: DataFrame) -> tuple[int, int]:
    return tuple(cells.agg(F.max("row_id") + 1, F.max("col_id") + 1).first())


def grid_search(estimator: SoftImputeALS, cells: DataFrame, grid: dict[str, Sequence], folds: int = 3,
                kind: str = "contiguous", parallelism: int = 4) -> tuple[CrossValidatorModel, DataFrame]:
    """Cross-validated mean squared error per grid point; the smallest wins.

    Every fold sees the full shape, so that a row or column missing from the training part is
    scored by its centers and not refused. The grid points of a fold share one centered matrix, and ``SoftImputeALS`` fits
    them side by side: an iteration passes over the cells of the fold twice, whatever the number of points. Up to
    ``parallelism`` folds are fitted at a time, see ``folds_at_a_time``; the tables of a fold go when it is scored.
    """
    scratch = Scratch(cells.sparkSession, "grid")
    data = with_folds(cells, folds, kind, scratch)
    n_rows, n_cols = shape_of(data)  # of the written cells: else they are assembled once more
    shown = estimator.getOrDefault("observed")
    # The cells of a fold are not in its training part, so there is no stored value to look up.
    estimator = estimator.copy({estimator.getParam("n_rows"): n_rows, estimator.getParam("n_cols"): n_cols,
                                estimator.getParam("observed"): "model"})
    maps = _maps(estimator, grid)

    def errors(fold: int) -> list[float]:
        held, out = data.where(F.col("fold") == fold), None
        models = estimator.fit_many(data.where(F.col("fold") != fold).select(*KEYS, "value"), maps)
        for g, model in enumerate(models):
            one = metrics.mean_squared_error(model.transform(held), "value", "prediction").withColumn("point", F.lit(g))
            out = one if out is None else out.unionByName(one)
        found = [r["mse"] for r in sorted(out.collect(), key=lambda r: r["point"])]
        for model in models:
            model.discard()
        del out, models, model, one
        free(cells.sparkSession)
        return found

    with ThreadPoolExecutor(folds_at_a_time(cells.sparkSession, data, min(parallelism, folds))) as pool:
        found = list(pool.map(inheritable_thread_target(cells.sparkSession)(errors), range(folds)))
    averages = [sum(column) / folds for column in zip(*found)]
    best = estimator.fit(data.select(*KEYS, "value"), maps[averages.index(min(averages))])
    scratch.drop("folds")
    best.set(best.getParam("observed"), shown)
    return CrossValidatorModel(best, averages), _scores(cells.sparkSession, estimator, grid, maps, averages)


def folds_at_a_time(spark: SparkSession, cells: DataFrame, most: int) -> int:
    """Folds beside each other use idle cores. Folds that fill all cores, or more of them than the driver's heap holds, go one by one."""
    context = spark.sparkContext
    room = context._jvm.java.lang.Runtime.getRuntime().maxMemory() // FIT_HEAP
    if cells.count() >= CELLS_PER_PARTITION * context.defaultParallelism:
        return 1
    return max(1, min(most, room))


def _maps(estimator: Estimator, grid: dict[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def _scores(spark: SparkSession, estimator: Estimator, grid: dict[str, Sequence], maps: list[dict], averages: list[float]) -> DataFrame:
    rows = [tuple(float(settings[estimator.getParam(name)]) for name in grid) + (float(score),)
            for settings, score in zip(maps, averages)]
    return spark.createDataFrame(rows, ", ".join(f"{name} double" for name in grid) + ", mse double")


def _cross_validate(estimator: Estimator, data: DataFrame, grid: dict[str, Sequence], folds: int,
                    parallelism: int) -> tuple[CrossValidatorModel, DataFrame]:
    maps = _maps(estimator, grid)
    evaluator = RegressionEvaluator(metricName="mse", labelCol="value", predictionCol="prediction")
    search = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds,
                            foldCol="fold", parallelism=parallelism)
    found = search.fit(data)
    return found, _scores(data.sparkSession, estimator, grid, maps, found.avgMetrics)


class MeanFilledALS(ALS):
    """Spark's own alternating least squares; a pair without a factor is scored by the mean rating, not dropped.

    A task holds one block of cells, several times over while it is built, and all vectors that they meet. The number of blocks
    therefore grows with the cells, from Spark's own ten on.
    """

    def sized(self, cells: int) -> MeanFilledALS:
        blocks = max(self.getNumUserBlocks(), -(-cells // COMPARATOR_BLOCK_CELLS))
        return self.copy({self.numUserBlocks: blocks, self.numItemBlocks: blocks})

    def _fit(self, dataset: DataFrame) -> Model:
        mean, cells = dataset.agg(F.avg(self.getRatingCol()), F.count("*")).first()
        return MeanFilledModel(super(MeanFilledALS, self.sized(cells))._fit(dataset), mean)


class MeanFilledModel(Model):
    def __init__(self, model: ALSModel, mean: float):
        super().__init__()
        self.model, self.mean = model, mean

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name = self.model.getPredictionCol()
        return self.model.transform(dataset).withColumn(name, F.nanvl(F.col(name).cast("double"), F.lit(self.mean)))

    def copy(self, extra=None) -> MeanFilledModel:
        return MeanFilledModel(self.model.copy(extra), self.mean)


def comparator(rank: int = 8, max_iter: int = 50, reg: float = 0.1, seed: int = 0) -> MeanFilledALS:
    """Plain ridge, no nuclear norm, no centers.

    Each iteration's factors are checkpointed: Spark then deletes the shuffle files they came from, which else pile up over
    ten iterations of every fit that runs.
    """
    return MeanFilledALS(rank=rank, maxIter=max_iter, regParam=reg, seed=seed, userCol="row_id", itemCol="col_id",
               ratingCol="value", coldStartStrategy="nan", checkpointInterval=1)


def comparator_input(cells: DataFrame) -> DataFrame:
    """The comparator takes 32-bit ids only; larger ones need an id dictionary first."""
    def fits(key: str):
        too_large = F.raise_error(F.lit(f"{key} exceeds 32 bits; map it with id_dictionary")).cast("int")
        return F.when(F.col(key) <= MAX_COMPARATOR_ID, F.col(key).cast("int")).otherwise(too_large).alias(key)
    return cells.select(fits("row_id"), fits("col_id"), *[c for c in cells.columns if c not in KEYS])


def comparator_fit(split: Split, rank: int = 8, max_iter: int = 50, reg: float = 0.1) -> tuple[DataFrame, float, float]:
    """Scored held-out cells, their error, and the training error of the comparator."""
    train, test = comparator_input(split.train), comparator_input(split.test)
    model = comparator(rank, max_iter, reg).fit(train)
    scored, fitted = model.transform(test), model.transform(train)
    errors = [metrics.mean_squared_error(x, "value", "prediction").first()["mse"] for x in (scored, fitted)]
    return scored, errors[0], errors[1] ** 0.5


def comparator_grid(cells: DataFrame, ranks: Sequence[int] = (10, 20), regs: Sequence[float] = (0.02, 10.0),
                    max_iter: int = 30, folds: int = 3, parallelism: int = 4,
                    kind: str = "contiguous") -> tuple[CrossValidatorModel, DataFrame]:
    """The comparator's grid on the same folds as ``grid_search``, scored on every held-out cell."""
    data = comparator_input(with_folds(cells, folds, kind))
    return _cross_validate(comparator(max_iter=max_iter), data, {"rank": ranks, "regParam": regs}, folds, parallelism)


#: The contestants of ``comparison_run``.
CONTESTANTS = ("soft_impute_als", "soft_impute", "ridge_als")


def tuned(train: DataFrame, iterations: int = 30, ranks: Sequence[int] = (10, 20), penalties: Sequence[float] = (0.02, 10.0),
          folds: int = 3) -> dict[str, tuple[int, float]]:
    """Rank and penalty of each method with the smallest cross-validated error on the training cells."""
    own = grid_search(SoftImputeALS(max_iters=iterations), train, {"max_rank": ranks, "shrinkage_value": penalties}, folds)[1]
    plain = comparator_grid(train, ranks, penalties, iterations, folds)[1]
    best = {}
    for name, scores in (("soft_impute", own), ("ridge_als", plain)):
        rank, penalty, _ = metrics.grid_best(scores, scores.columns[:2]).first()
        best[name] = int(rank), float(penalty)
    return {"soft_impute_als": best["soft_impute"], **best}


def comparison_run(split_for_trial: Callable[[int], Split], trials: int = 1, budgets: Sequence[int] = (1, 2, 3, 4, 5),
                   rank: int = 10, shrinkage: float = 9.0, contestants: Sequence[str] = ("soft_impute_als", "ridge_als"),
                   path: str | None = None, tune: bool = False, **tuning: object) -> DataFrame:
    """One row per trial, iteration budget and model: seconds, held-out MSE, training RMSE, and the sizes and settings.

    With ``tune`` each trial first tunes both methods on its own training cells, see ``tuned``; without, all have ``rank``,
    and ``shrinkage`` or the comparator's own penalty. The rows of a trial are written below ``path`` when it is done; a run
    that is started again on the same path goes on with the trials that are missing.
    """
    schema = ("model string, max_iter int, trial int, rank int, penalty double, n_train bigint, n_test bigint, seconds double, "
              "mse double, train_rmse double")
    spark, done = None, set()
    for trial in range(trials):
        split = split_for_trial(trial)
        spark = split.train.sparkSession
        if trial == 0:
            path = path or Scratch(spark, "comparison").path("trials")
            done = _trials_done(spark, path)
        if trial in done:
            continue
        sizes = split.train.count(), split.test.count()
        chosen = tuned(split.train, **tuning) if tune else {
            name: (rank, 0.1 if name == "ridge_als" else shrinkage) for name in CONTESTANTS}
        rows = []
        for budget in budgets:
            for name in contestants:
                rank, penalty = chosen[name]
                begin = time.perf_counter()
                if name == "ridge_als":
                    mse, rmse = comparator_fit(split, rank, budget, penalty)[1:]
                else:
                    kind = SoftImpute if name == "soft_impute" else SoftImputeALS
                    mse, rmse = fit_and_score(kind(max_rank=rank, shrinkage_value=penalty, max_iters=budget), split)[2:]
                rows.append((name, budget, trial, rank, penalty, *sizes, time.perf_counter() - begin, mse, rmse))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/done={trial}")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path).where(F.col("trial") < trials)


def _trials_done(spark: SparkSession, path: str) -> set[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return set()
    found = {int(f.getPath().getName().removeprefix("done=")) for f in files.listStatus(root)
             if f.getPath().getName().startswith("done=")}
    # A trial counts once its job has committed.
    return {t for t in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done={t}/_SUCCESS"))}


def load_and_split_file(spark: SparkSession, path: str, sample: int, leave_n: int = 3, seed: int = 0,
                        min_support: int | None = None) -> Split:
    """A CSV file of ratings (userId, movieId, rating) to a training matrix and held-out cells in one call."""
    triples = Scratch(spark, "ratings").write(read_ratings_csv(spark, path), "triples")
    return load_and_split(triples, sample, leave_n, seed, min_support)
