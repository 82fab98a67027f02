"""Dense positions in key order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lacuna.session import Scratch

#: Parts that a range of keys is cut into in one pass of ``keys_at``.
RANGES = 4096


def dense_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0, 1, 2, ... in the order of ``order``, which must be unique.

    Rows are range partitioned, numbered inside each range, and shifted by the number of rows in
    the ranges before. Only the range sizes, one row per partition, meet in one place. The ranges
    are written first, because Spark draws their bounds by sampling.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("range_id", F.spark_partition_id())
    ranged = Scratch(spark, "position").write(ranged, "ranges")
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("range_id").count().select(
        "range_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("range_id").orderBy(*order))
    return (ranged.withColumn("inside", inside)
            .join(F.broadcast(shifts), "range_id")
            .withColumn(name, F.expr("shift + inside - 1"))
            .drop("range_id", "inside", "shift"))


def id_dictionary(df: DataFrame, key: str) -> DataFrame:
    """``(key, id)`` with ids 0, 1, 2, ... in key order."""
    return dense_position(df.select(key).distinct(), [key], "id")


def keys_at(cells: DataFrame, positions: Sequence[int], keys: tuple[str, str] = ("row_id", "col_id")) -> list[tuple[int, int]]:
    """The keys at these positions (from 0) of all cells in key order, without sorting or moving a cell.

    Rank selection by counting: the range of the first key is cut into ``RANGES`` equal parts, whose counts tell the
    part that holds each position; that is cut again, down to a single row, and then the second key within that row.
    A pass serves all positions and sends on at most ``RANGES`` counts for each, so rows of any size will do.
    """
    first = cells.agg(*[F.expr(f"{f}({k})").alias(f"{f}_{k}") for k in keys for f in ("min", "max")]).first()
    # Per position: the rank left within the ranges of both keys that are still possible.
    left = [[p, [[first[f"min_{k}"], first[f"max_{k}"]] for k in keys]] for p in positions]
    while True:
        todo = [(t, next(k for k in (0, 1) if ranges[k][0] < ranges[k][1]))
                for t, (_, ranges) in enumerate(left) if any(lo < hi for lo, hi in ranges)]
        if not todo:
            return [(ranges[0][0], ranges[1][0]) for _, ranges in left]
        parts, widths = [], {}
        for t, k in todo:
            ranges = left[t][1]
            lo, hi = ranges[k]
            widths[t] = -(-(hi - lo + 1) // RANGES)
            inside = f"{keys[0]} BETWEEN {ranges[0][0]} AND {ranges[0][1]}"
            if k:
                inside += f" AND {keys[1]} BETWEEN {lo} AND {hi}"
            parts.append(f"CASE WHEN {inside} THEN named_struct('t', {t}, 'part', ({keys[k]} - {lo}) div {widths[t]}) END")
        found = cells.select(F.explode(F.expr(f"array_compact(array({', '.join(parts)}))")).alias("x")).groupBy(
            "x.t", "x.part").count().collect()
        for t, k in todo:
            for part, count in sorted((r["part"], r["count"]) for r in found if r["t"] == t):
                if left[t][0] < count:
                    lo, hi = left[t][1][k]
                    left[t][1][k] = [lo + part * widths[t], min(lo + (part + 1) * widths[t] - 1, hi)]
                    break
                left[t][0] -= count
            else:
                raise ValueError(f"position {positions[t]} is beyond the cells")


def contiguous_folds(cells: DataFrame, folds: int, n_cells: int, name: str = "fold") -> DataFrame:
    """Folds of consecutive cells in key order; the first ``n_cells % folds`` hold one more.

    Only the first keys of the folds are sought; the fold of a cell is then a comparison with them, so the cells are neither
    shuffled nor copied. Keys must be whole numbers and not repeat.
    """
    size, extra = divmod(n_cells, folds)
    positions = [p for p in (f * size + min(f, extra) for f in range(1, folds)) if p < n_cells]
    starts = keys_at(cells.select("row_id", "col_id"), positions) if positions else []
    fold = " + ".join(f"int(row_id > {r} OR (row_id = {r} AND col_id >= {c}))" for r, c in starts) or "0"
    return cells.withColumn(name, F.expr(fold).cast("int"))


def hash_folds(cells: DataFrame, folds: int, name: str = "fold") -> DataFrame:
    """Folds computed from the key alone: no shuffle, any number of cells."""
    return cells.withColumn(name, F.expr(f"cast(pmod(row_id * 7919 + col_id * 104729, {folds}) AS int)"))
