"""Centers of rows and columns over the observed cells."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.vectors import ratio_or_zero
from lacuna.operators.layout import OTHER, Attach, Layout, plain_attach

ONE_PASS_CHANGE = "coalesce(sum(power(center - coalesce(old, 0D), 2)), 0D)"


def center_weights(cells: DataFrame, key: str, other_scales: DataFrame | None = None,
                   attach: Attach = plain_attach) -> DataFrame:
    """Per key: the number of nonzero cells, or their sum of 1/scale of the other side."""
    weight = "1D"
    if other_scales is not None:
        cells = attach(cells, other_scales.select(OTHER[key], "scale"), OTHER[key])
        weight = "1D / scale"
    return cells.groupBy(key).agg(
        F.expr(f"coalesce(sum(CASE WHEN value != 0 THEN {weight} END), 0D)").alias("weight"))


def mean_residual(cells: DataFrame, key: str, other_centers: DataFrame | None,
                  attach: Attach = plain_attach, by: Sequence[str] = ()) -> DataFrame:
    """Per key: the mean of ``value - center of the other side``.

    A full update of the centers of one side needs only the centers of the other: adding the mean
    residual to the old center gives exactly this mean, whatever the old center was.
    """
    total = "value"
    if other_centers is not None:
        cells = attach(cells, other_centers.withColumnRenamed("center", "other_center"), OTHER[key])
        total = "value - other_center"
    return (cells.groupBy(*by, key)
            .agg(F.expr(f"sum({total})").alias("total"), F.count("*").alias("weight"))
            .select(*by, key, ratio_or_zero("total", "weight").alias("center")))


def fold_means(cells: DataFrame, key: str, other_centers: DataFrame | None, folds: int, attach: Attach = plain_attach) -> DataFrame:
    """``mean_residual`` of the training part of every fold from one pass: ``center<f>`` over the cells outside fold f.

    A key that has no cell outside a fold has the center 0 there.
    """
    totals = ["value"] * folds
    if other_centers is not None:
        cells = attach(cells, other_centers.withColumnsRenamed({f"center{f}": f"other{f}" for f in range(folds)}), OTHER[key])
        totals = [f"value - other{f}" for f in range(folds)]
    sums = cells.groupBy(key).agg(
        *[F.expr(f"sum(CASE WHEN fold != {f} THEN {t} END)").alias(f"total{f}") for f, t in enumerate(totals)],
        *[F.expr(f"count_if(fold != {f})").alias(f"weight{f}") for f in range(folds)])
    return sums.select(key, *[ratio_or_zero(f"total{f}", f"weight{f}").alias(f"center{f}") for f in range(folds)])


def residual_cells(cells: DataFrame, row_centers: DataFrame | None, col_centers: DataFrame | None,
                   attach: Attach = plain_attach) -> DataFrame:
    """Cells with both centers taken off."""
    value = "value"
    for key, centers, name in (("row_id", row_centers, "row_center"), ("col_id", col_centers, "col_center")):
        if centers is not None:
            cells = attach(cells, centers.select(key, F.col("center").alias(name)), key)
            value += f" - {name}"
    return cells.select("row_id", "col_id", F.expr(value).alias("value"))


def back_transform(name: str = "prediction", prefix: str = "") -> Column:
    """A value in centered units, mapped back to rating units; absent stats mean center 0, scale 1."""
    return F.expr(
        f"{name} * coalesce({prefix}row_scale, 1D) * coalesce({prefix}col_scale, 1D)"
        f" + coalesce({prefix}row_center, 0D) + coalesce({prefix}col_center, 0D)")


def stats_table(centers: DataFrame, key: str) -> DataFrame:
    """Centers with the scale column, which is 1 throughout."""
    return centers.select(key, "center", F.lit(1.0).alias("scale"))


def attach_stats(pairs: DataFrame, row_stats: DataFrame, col_stats: DataFrame) -> DataFrame:
    """Centers and scales of a pair's row and column; a cold row or column has none."""
    rows = row_stats.select("row_id", F.col("center").alias("row_center"), F.col("scale").alias("row_scale"))
    cols = col_stats.select("col_id", F.col("center").alias("col_center"), F.col("scale").alias("col_scale"))
    return pairs.join(rows, "row_id", "left").join(cols, "col_id", "left")


def inverse_transform(predictions: DataFrame, row_stats: DataFrame, col_stats: DataFrame) -> DataFrame:
    joined = attach_stats(predictions, row_stats, col_stats)
    return joined.select(*[back_transform().alias(c) if c == "prediction" else F.col(c) for c in predictions.columns])


def bicenter(layout: Layout, max_iter: int = 20, threshold: float = 1e-9,
             row_center: bool = True, col_center: bool = True,
             ) -> tuple[DataFrame | None, DataFrame | None, list[tuple[int, float]]]:
    """Alternate column and row means until the squared change of all centers is below a threshold.

    One job per half pass; the change is summed while the new centers are written.
    """
    scratch = layout.scratch
    if row_center and col_center and max_iter > 0 and layout.by_blocks(3):  # ids, old and new centers
        return _bicenter_blocks(layout, max_iter, threshold)
    sides = [key for key, wanted in (("col_id", col_center), ("row_id", row_center)) if wanted]
    centers: dict[str, DataFrame | None] = {"row_id": None, "col_id": None}
    trace: list[tuple[int, float]] = []
    for step in range(1, max_iter + 1 if sides else 1):
        level = 0.0
        for key in sides:
            other, old = centers[OTHER[key]], centers[key]
            fresh = mean_residual(layout.cells_for(key, other), key, other, layout.attach)
            if old is None:
                fresh = fresh.withColumn("old", F.lit(0.0))
            else:
                fresh = layout.attach_grouped(fresh, old.withColumnRenamed("center", "old"), key)
            name = f"center_{key}_{step}"
            table, seen = scratch.write_observed(fresh, name, change=ONE_PASS_CHANGE)
            centers[key] = table.select(key, "center")
            level += seen["change"]
            if step > 2:
                scratch.drop(f"center_{key}_{step - 2}")
            layout.sweep()
        trace.append((step, level))
        if level < threshold:
            break
    return centers["row_id"], centers["col_id"], trace


def _bicenter_blocks(layout: Layout, max_iter: int, threshold: float) -> tuple[DataFrame, DataFrame, list[tuple[int, float]]]:
    """``bicenter`` of both sides over blocks of cells; the centers of a side are one array on the way."""
    blocks, trace = layout.blocks, []
    centers: dict[str, np.ndarray | None] = {"row_id": None, "col_id": None}
    for step in range(1, max_iter + 1):
        level = 0.0
        for key in ("col_id", "row_id"):
            fresh, old = blocks.means(key, centers[OTHER[key]]), centers[key]
            level += float(np.square(fresh if old is None else fresh - old).sum())
            centers[key] = fresh
        trace.append((step, level))
        if level < threshold:
            break
    rows, cols = (layout.scratch.write(blocks.center(key, centers[key]), f"center_{key}") for key in ("row_id", "col_id"))
    return rows, cols, trace
