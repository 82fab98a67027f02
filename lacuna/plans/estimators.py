"""``pyspark.ml`` estimators for centering and for low-rank completion."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass
from numbers import Integral

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.vectors import columns, pack
from lacuna.operators import lookup, metrics, products, scaling, scoring, validate
from lacuna.operators.factors import select_vectors
from lacuna.operators.layout import CELLS_PER_PARTITION, Layout, broadcast_share, table_bytes
from lacuna.plans.solvers import Settings, Solution, solve_als, solve_nested, squared_errors
from lacuna.session import Scratch, read
from lacuna.sources.models import load_tables, remove_tables, save_tables
from lacuna.sources.ratings import KEYS, assemble, drop_zeros


def _optional(convert):
    return lambda value: None if value is None else convert(value)


def _choice(*allowed: str):
    def convert(value):
        if value not in allowed:
            raise TypeError(f"expected one of {allowed}, got {value!r}")
        return value
    return convert


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class _InputParams(Params):
    """Names of the input columns, the shape, and how the work is laid out."""

    row_col = _param("row_col", "row id column", TypeConverters.toString)
    col_col = _param("col_col", "column id column", TypeConverters.toString)
    value_col = _param("value_col", "rating column", TypeConverters.toString)
    n_rows = _param("n_rows", "number of rows; largest row id + 1 if not given", _optional(TypeConverters.toInt))
    n_cols = _param("n_cols", "number of columns; largest column id + 1 if not given",
                    _optional(TypeConverters.toInt))
    zeros = _param("zeros", "explicit zeros are 'observed' cells, or 'drop' them", _choice("observed", "drop"))
    broadcast_bytes = _param("broadcast_bytes", "largest per-key table to broadcast; a share of the memory if None",
                             _optional(TypeConverters.toInt))
    cells_per_partition = _param("cells_per_partition", "target partition size of the cells", TypeConverters.toInt)
    nulls = _param("nulls", "rows with a null id, a null value or NaN are an 'error', or 'drop' leaves them out",
                   _choice("error", "drop"))
    hot_cells = _param("hot_cells", "cells above which a key is spread over salts", _optional(TypeConverters.toInt))

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(row_col="row_id", col_col="col_id", value_col="value", n_rows=None, n_cols=None,
                         zeros="observed", nulls="error", broadcast_bytes=None,
                         cells_per_partition=CELLS_PER_PARTITION, hot_cells=None)

    def _value(self, name: str):
        value = self.getOrDefault(self.getParam(name))
        if value is None and name == "broadcast_bytes":
            return broadcast_share(SparkSession.active())
        return value

    def _layout(self, dataset: DataFrame, scratch: Scratch) -> Layout:
        """Check, assemble and write the cells once, and learn their shape in the same job."""
        names = [self._value(c) for c in ("row_col", "col_col", "value_col")]
        validate.check_ratings(dataset, *names)
        triples = dataset.select(
            F.col(names[0]).cast("bigint").alias("row_id"), F.col(names[1]).cast("bigint").alias("col_id"),
            F.col(names[2]).cast("double").alias("value"))
        # Defects are counted by the job that assembles the cells, before it drops them.
        defects = Observation()
        counted = [F.count_if(validate.defect()).alias("defects")]
        cells = assemble(triples.observe(defects, *counted).where(~validate.defect()))
        if self._value("zeros") == "drop":
            cells = drop_zeros(cells)
        cells, seen = scratch.write_observed(
            cells, "cells", nnz="count(*)", last_row="max(row_id)", last_col="max(col_id)",
            first="least(min(row_id), min(col_id))")
        lost = read(defects, triples, counted)["defects"]
        if lost and self._value("nulls") == "error":
            raise ValueError(f"{lost} rows have a null id, a null value or NaN; nulls='drop' leaves them out")
        if not seen.get("nnz"):
            raise ValueError("The matrix has no observed cell")
        if seen["first"] < 0:
            raise ValueError("row and column ids must not be negative")
        shape = []
        for name, last in (("n_rows", seen["last_row"]), ("n_cols", seen["last_col"])):
            given = self._value(name)
            if given is not None and last >= given:
                raise ValueError(f"an id of {last} does not fit {name}={given}")
            shape.append(last + 1 if given is None else given)
        return Layout(cells, scratch, *shape, seen["nnz"], self._value("broadcast_bytes"),
                      self._value("cells_per_partition"), self._value("hot_cells"))


class BiScale(Estimator, _InputParams):
    """Centers rows and columns over the observed cells only."""

    max_iter = _param("max_iter", "largest number of passes", TypeConverters.toInt)
    threshold = _param("threshold", "stop when the squared change of all centers is below", TypeConverters.toFloat)
    row_center = _param("row_center", "center the rows", TypeConverters.toBoolean)
    col_center = _param("col_center", "center the columns", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, max_iter=20, threshold=1e-9, row_center=True, col_center=True, row_scale=False,
                 col_scale=False, row_col="row_id", col_col="col_id", value_col="value", n_rows=None, n_cols=None,
                 zeros="observed", nulls="error", broadcast_bytes=None, cells_per_partition=CELLS_PER_PARTITION,
                 hot_cells=None):
        super().__init__()
        given = dict(self._input_kwargs)
        if given.pop("row_scale", False) or given.pop("col_scale", False):
            raise ValueError("scaling is not supported, only centering")
        self._setDefault(max_iter=20, threshold=1e-9, row_center=True, col_center=True)
        self._set(**given)

    def _fit(self, dataset: DataFrame) -> BiScaleModel:
        scratch = Scratch(dataset.sparkSession, "biscale")
        layout = self._layout(dataset, scratch)
        rows, cols, trace = scaling.bicenter(
            layout, self._value("max_iter"), self._value("threshold"),
            self._value("row_center"), self._value("col_center"))
        layout.release()
        return BiScaleModel(layout.cells, rows, cols, trace)


class BiScaleModel(Model):
    """Centers and scales per row and column, the residual cells, and the convergence trace."""

    def __init__(self, cells: DataFrame, rows: DataFrame | None, cols: DataFrame | None,
                 trace: list[tuple[int, float]]):
        super().__init__()
        self.cells = cells
        self._rows, self._cols = rows, cols
        self.trace_levels = trace

    def _stats(self, key: str, centers: DataFrame | None) -> DataFrame:
        if centers is None:
            centers = self.cells.select(key).distinct().withColumn("center", F.lit(0.0))
        return scaling.stats_table(centers, key)

    @property
    def row_stats(self) -> DataFrame:
        return self._stats("row_id", self._rows)

    @property
    def col_stats(self) -> DataFrame:
        return self._stats("col_id", self._cols)

    @property
    def trace(self) -> DataFrame:
        return self.cells.sparkSession.createDataFrame(self.trace_levels, "iter int, level double")

    @property
    def residuals(self) -> DataFrame:
        return scaling.residual_cells(self.cells, self._rows, self._cols)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Centers taken off any cells; an unknown row or column counts as center 0."""
        joined = scaling.attach_stats(dataset, self.row_stats, self.col_stats)
        value = F.expr("value - coalesce(row_center, 0D) - coalesce(col_center, 0D)")
        return joined.select(*[value.alias(c) if c == "value" else F.col(c) for c in dataset.columns])

    def inverse_transform(self, predictions: DataFrame) -> DataFrame:
        return scaling.inverse_transform(predictions, self.row_stats, self.col_stats)


class _CompletionParams(_InputParams):
    max_rank = _param("max_rank", "largest rank; clamped to the shape", TypeConverters.toInt)
    shrinkage_value = _param("shrinkage_value", "nuclear norm penalty; None is the default 1/50",
                             _optional(TypeConverters.toFloat))
    convergence_threshold = _param("convergence_threshold", "stop when the relative change is below",
                                   TypeConverters.toFloat)
    max_iters = _param("max_iters", "largest number of (outer) iterations", TypeConverters.toInt)
    max_inner_iters = _param("max_inner_iters", "largest number of inner iterations; max_iters if None",
                             _optional(TypeConverters.toInt))
    center = _param("center", "center rows and columns first", TypeConverters.toBoolean)
    center_max_iter = _param("center_max_iter", "largest number of centering passes", TypeConverters.toInt)
    center_threshold = _param("center_threshold", "stop centering below this change", TypeConverters.toFloat)
    init = _param("init", "start vectors: 'gaussian' or 'integer'", _choice("gaussian", "integer"))
    seed = _param("seed", "seed of the gaussian start", TypeConverters.toInt)
    criterion = _param("criterion", "change measure: 'trace' or 'column_sum'", _choice("trace", "column_sum"))
    form = _param("form", "half step by 'residual', by 'gram' sums, or 'auto'", _choice("auto", "residual", "gram"))
    observed = _param("observed", "observed pairs score as stored ('passthrough') or by the 'model'",
                      _choice("passthrough", "model"))
    strict = _param("strict", "a pair out of range is an error", TypeConverters.toBoolean)
    min_value = _param("min_value", "lower clip of model scores", _optional(TypeConverters.toFloat))
    max_value = _param("max_value", "upper clip of model scores", _optional(TypeConverters.toFloat))

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(max_rank=2, shrinkage_value=None, convergence_threshold=1e-5, max_iters=100,
                         max_inner_iters=None, center=True, center_max_iter=20, center_threshold=1e-9,
                         init="gaussian", seed=0, criterion="trace", form="auto", observed="passthrough",
                         strict=False, min_value=None, max_value=None)


@dataclass
class _Prepared:
    """What fits with different settings of the method have in common."""

    layout: Layout
    cells: DataFrame
    trace: list[tuple[int, float]]

    def release(self) -> None:
        """Free what only the fits needed; the assembled cells belong to the models."""
        self.layout.release()


class _Completion(Estimator, _CompletionParams):
    """Fit pipeline shared by the methods; a subclass supplies ``_solve``, for any number of settings at once."""

    @keyword_only
    def __init__(self, *, max_rank=2, shrinkage_value=None, convergence_threshold=1e-5, max_iters=100,
                 max_inner_iters=None, center=True, center_max_iter=20, center_threshold=1e-9, init="gaussian",
                 seed=0, criterion="trace", form="auto", observed="passthrough", strict=False, min_value=None,
                 max_value=None, row_col="row_id", col_col="col_id", value_col="value", n_rows=None, n_cols=None,
                 zeros="observed", nulls="error", broadcast_bytes=None, cells_per_partition=CELLS_PER_PARTITION,
                 hot_cells=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _solve(self, layout: Layout, settings: list[Settings]) -> list[Solution]:
        raise NotImplementedError(f"{type(self).__name__} has no _solve")

    def complete(self, ratings: DataFrame) -> CompletionModel:
        return self.fit(ratings)

    def _prepare(self, dataset: DataFrame) -> _Prepared:
        scratch = Scratch(dataset.sparkSession, type(self).__name__.lower())
        layout = self._layout(dataset, scratch)
        cells = layout.cells
        layout.sweep()
        validate.check_mask(layout.n_rows, layout.n_cols, layout.nnz)
        trace: list[tuple[int, float]] = []
        if self._value("center"):
            row_centers, col_centers, trace = scaling.bicenter(
                layout, self._value("center_max_iter"), self._value("center_threshold"))
            if row_centers is not None and col_centers is not None:
                # The centers go on as two fixed components of the vectors, so the placed cells serve the fit as well.
                layout.centers = {"row_id": row_centers, "col_id": col_centers}
        return _Prepared(layout, cells, trace)

    def _settings(self, layout: Layout) -> Settings:
        inner, max_iters = self._value("max_inner_iters"), self._value("max_iters")
        return Settings(
            validate.clamp_rank(self._value("max_rank"), layout.n_rows, layout.n_cols), self._value("shrinkage_value"),
            self._value("convergence_threshold"), max_iters, max_iters if inner is None else inner,
            self._value("init"), self._value("seed"), self._value("criterion"), self._value("form"))

    def _complete(self, prepared: _Prepared, estimators: Sequence[_Completion]) -> list[CompletionModel]:
        """A model for each of the estimators, which differ in the settings of the method only."""
        scratch = Scratch(prepared.cells.sparkSession, type(self).__name__.lower())
        layout = prepared.layout.writing_to(scratch)
        solutions = self._solve(layout, [e._settings(layout) for e in estimators])
        errors = squared_errors(layout, solutions)
        models = []
        for g, (estimator, solution, error) in enumerate(zip(estimators, solutions, errors)):
            def side(factor, key, name):
                keep = ["center"] if layout.centers else []
                table = select_vectors({"o": factor}, keep)
                center = "center" if keep else "0D AS center"
                return scratch.write(table.selectExpr(key, center, "1D AS scale", pack(columns("o", len(solution.d)), name)),
                                     f"model_{g}_{key}")

            model = CompletionModel(
                side(solution.u, "row_id", "u"), side(solution.v, "col_id", "v"), prepared.cells,
                dict(d=[float(x) for x in solution.d], n_rows=layout.n_rows, n_cols=layout.n_cols, nnz=layout.nnz,
                     row_ids=layout.ids["row_id"], col_ids=layout.ids["col_id"], shrinkage=float(solution.shrinkage),
                     changes=solution.changes, trace=prepared.trace, effective_rank=solution.effective_rank,
                     squared_error=float(error or 0.0)))
            model.scratches = [prepared.layout.scratch, scratch]
            models.append(estimator._copyValues(model))
        return models

    def _fit(self, dataset: DataFrame) -> CompletionModel:
        return self.fit_many(dataset, [{}])[0]

    def fit_many(self, dataset: DataFrame, param_maps: Sequence[dict]) -> list[CompletionModel]:
        """Models for several settings of the method on one assembled, centered and placed matrix.

        ``SoftImputeALS`` fits them side by side: every half step passes over the cells once for all of them.
        """
        shared = {"center", "center_max_iter", "center_threshold", "form", *(p.name for p in _InputParams().params)}
        if any(p.name in shared for settings in param_maps for p in settings):
            return [self.fit(dataset, settings) for settings in param_maps]
        prepared = self._prepare(dataset)
        try:
            return self._complete(prepared, [self.copy(settings) for settings in param_maps])
        finally:
            prepared.release()

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]):
        """``fit_many`` behind the iterator that cross-validation asks for; the first model asked for fits all."""
        models: list[CompletionModel] = []
        lock = threading.Lock()

        def fit_one(index: int) -> CompletionModel:
            with lock:
                if not models:
                    models.extend(self.fit_many(dataset, paramMaps))
            return models[index]

        return _FitMultipleIterator(fit_one, len(paramMaps))


class SoftImpute(_Completion):
    """Outer fill-in loop around an inner alternating loop on the filled, sparse-plus-low-rank matrix."""

    def _solve(self, layout: Layout, settings: list[Settings]) -> list[Solution]:
        return [solve_nested(layout.writing_to(Scratch(layout.scratch.spark, "nested")), s) for s in settings]


class SoftImputeALS(_Completion):
    """One loop that refreshes the residuals after every half step; needs fewer jobs."""

    def _solve(self, layout: Layout, settings: list[Settings]) -> list[Solution]:
        return solve_als(layout, settings)


class CompletionModel(Model, _CompletionParams):
    """Vectors and centers per row and column, singular values, and the training cells."""

    def __init__(self, rows: DataFrame, cols: DataFrame, cells: DataFrame, scalars: dict):
        super().__init__()
        self.rows, self.cols, self.cells = rows, cols, cells
        self.scalars = scalars
        self.d = np.array(scalars["d"], dtype=float)
        self.n_iterations = len(scalars["changes"])
        self.index: lookup.CellIndex | None = None
        self.scratches: list[Scratch] = []

    def discard(self) -> None:
        """Delete the tables of the fit, which models of one ``fit_many`` share; none of them can score after that."""
        for scratch in self.scratches:
            scratch.drop("")

    @property
    def row_factors(self) -> DataFrame:
        return self.rows.select("row_id", "u")

    @property
    def col_factors(self) -> DataFrame:
        return self.cols.select("col_id", "v")

    @property
    def singular_values(self) -> DataFrame:
        data = [(k, float(x)) for k, x in enumerate(self.d)]
        return self.rows.sparkSession.createDataFrame(data, "k int, d double")

    @property
    def row_stats(self) -> DataFrame:
        return self.rows.select("row_id", "center", "scale")

    @property
    def col_stats(self) -> DataFrame:
        return self.cols.select("col_id", "center", "scale")

    def _small(self, table: DataFrame, ids: int) -> bool:
        return table_bytes(table, ids) + ids * 8 * len(self.d) <= self._value("broadcast_bytes")

    def _score(self, pairs: DataFrame, observed: str, strict: bool, few: bool = False, asked: DataFrame | None = None) -> DataFrame:
        """``few`` says that the keys of ``asked``, or of the pairs themselves, have been found small enough for a broadcast."""
        stored = None
        if observed == "passthrough":
            stored = self._found(pairs if asked is None else asked) if few else self.cells
        return scoring.score_pairs(
            pairs, self.rows, self.cols, self.scalars["d"], self.scalars["n_rows"], self.scalars["n_cols"], stored, strict,
            self._value("min_value"), self._value("max_value"),
            self._small(self.rows, self.scalars["row_ids"]), self._small(self.cols, self.scalars["col_ids"]), few)

    def index_cells(self, n_buckets: int | None = None, hot_cells: int = lookup.HOT_CELLS) -> lookup.CellIndex:
        """Write the observed cells once more, bucketed by row and sorted; ``predict_few`` and ``predict`` then use that."""
        scratch = Scratch(self.cells.sparkSession, "index")
        self.index = lookup.CellIndex.build(self.cells, scratch, self.scalars["nnz"], n_buckets, hot_cells)
        return self.index

    def predict_few(self, pairs: DataFrame) -> DataFrame:
        """``transform`` for a request that is small beside the cells: none of them is shuffled.

        The request's keys are written once and counted. If they can be broadcast (``lookup.PAIR_BYTES`` a pair within
        ``broadcast_bytes``), the observed ones among them are looked up in the index (see ``index_cells``), or by one scan
        of the cells if there is none, and broadcast; a larger request takes the join of ``transform``. The rows
        are the same either way.
        """
        names = {self._value("row_col"): "row_id", self._value("col_col"): "col_id"}
        renamed = pairs.withColumnsRenamed(names)
        validate.check_requests(renamed)
        most = min(self._value("broadcast_bytes") // lookup.PAIR_BYTES, lookup.BROADCAST_PAIRS)
        if self._value("observed") != "passthrough":
            return self.transform(pairs)
        scratch = Scratch(pairs.sparkSession, "request")
        asked, seen = scratch.write_observed(renamed.select(*KEYS), "keys", n="count(1)")
        if seen["n"] > most:
            scratch.drop("keys")
            return self.transform(pairs)
        scored = self._score(renamed, self._value("observed"), self._value("strict"), True, asked)
        return scored.withColumnsRenamed({new: old for old, new in names.items()})

    def _found(self, asked: DataFrame) -> DataFrame:
        return self.index.find(asked) if self.index else lookup.find_by_scan(self.cells, asked)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = {self._value("row_col"): "row_id", self._value("col_col"): "col_id"}
        pairs = dataset.withColumnsRenamed(names)
        validate.check_requests(pairs)
        scored = self._score(pairs, self._value("observed"), self._value("strict"))
        return scored.withColumnsRenamed({new: old for old, new in names.items()})

    def predict(self, row_ids: int | Sequence[int], col_ids: int | Sequence[int]) -> float | np.ndarray:
        """Scores for a list of pairs held by the caller; use ``transform`` for a DataFrame."""
        single = isinstance(row_ids, Integral) and isinstance(col_ids, Integral)
        if not single and (isinstance(row_ids, Integral) or isinstance(col_ids, Integral)):
            raise ValueError("a single id and a list of ids do not make pairs")
        rows, cols = ([row_ids], [col_ids]) if single else (list(row_ids), list(col_ids))
        if len(rows) != len(cols):
            raise ValueError(f"{len(rows)} rows and {len(cols)} columns do not make pairs")
        if not all(isinstance(x, Integral) for x in (*rows, *cols)):
            raise ValueError("ids are whole numbers")
        for row, col in zip(rows, cols):
            if not 0 <= col < self.scalars["n_cols"]:
                raise ValueError(f"no column {col} in {self.scalars['n_cols']} columns")
            if not 0 <= row < self.scalars["n_rows"]:
                raise ValueError(f"no row {row} in {self.scalars['n_rows']} rows")
        if not rows:
            return np.empty(0)
        data = [(pos, int(r), int(c)) for pos, (r, c) in enumerate(zip(rows, cols))]
        pairs = self.rows.sparkSession.createDataFrame(data, "pos bigint, row_id bigint, col_id bigint")
        few = lookup.PAIR_BYTES * len(data) <= self._value("broadcast_bytes")
        scored = self._score(pairs, self._value("observed"), False, few).orderBy("pos").collect()
        out = np.array([r["prediction"] for r in scored])
        return float(out[0]) if single else out

    def fitted(self) -> DataFrame:
        """Training cells with the model's own value for each, never the stored one."""
        return self._score(self.cells, "model", False).drop("source")

    def train_rmse(self) -> float:
        """Over the observed cells; the same in centered and in rating units, since scales are 1.

        The fit has summed the squared errors over its placed cells; only clipped scores have to be computed.
        """
        if "squared_error" in self.scalars and self._value("min_value") is None and self._value("max_value") is None:
            return (self.scalars["squared_error"] / self.scalars["nnz"]) ** 0.5
        return metrics.root_mean_squared_error(self.fitted(), "value", "prediction").first()["rmse"]

    eval = train_rmse

    def low_rank(self, pairs: DataFrame) -> DataFrame:
        """The low-rank part alone, in centered units, for pairs with known row and column."""
        d = self.scalars["d"]
        return products.fitted_cells(pairs, self.row_factors, self.col_factors, len(d), d)

    def save(self, path: str, overwrite: bool = False, store: str | None = None) -> None:
        """Write the model. Models saved with one ``store`` folder share one copy of equal training cells."""
        settings = {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}
        save_tables(path, {"rows": self.rows, "cols": self.cols, "cells": self.cells},
                    {**self.scalars, "params": settings}, overwrite, store)

    @staticmethod
    def remove(path: str, spark: SparkSession | None = None) -> None:
        """Delete a saved model; shared cells go with the last model that refers to them."""
        remove_tables(spark or SparkSession.getActiveSession(), path)

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> CompletionModel:
        tables, scalars = load_tables(spark or SparkSession.getActiveSession(), path)
        settings = scalars.pop("params")
        model = cls(tables["rows"], tables["cols"], tables["cells"], scalars)
        model._set(**{k: v for k, v in settings.items() if v is not None})
        return model


def multiple_imputations(estimator: _Completion, ratings: DataFrame, pairs: DataFrame,
                         seeds: Sequence[int]) -> DataFrame:
    """Score the pairs by fits from several start seeds, made side by side, and average the predictions."""
    # Written once, because every run reads them.
    pairs = Scratch(pairs.sparkSession, "imputations").write(pairs.select(*KEYS), "pairs")
    runs = None
    for model in estimator.fit_many(ratings, [{estimator.getParam("seed"): seed} for seed in seeds]):
        run = model.transform(pairs)
        runs = run if runs is None else runs.unionByName(run)
    return metrics.imputation_mean(runs)
