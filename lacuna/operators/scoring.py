"""Scores for (row, column) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.vectors import dot, number
from lacuna.operators.scaling import back_transform
from lacuna.operators.validate import request_status
from lacuna.sources.ratings import KEYS


def pairs_from_arrays(requests: DataFrame, row_ids: str = "row_ids", col_ids: str = "col_ids") -> DataFrame:
    """``(pos, row_id, col_id)`` from parallel id arrays; unequal lengths are an error."""
    rest = [c for c in requests.columns if c not in (row_ids, col_ids)]
    zipped = F.when(
        F.size(row_ids) == F.size(col_ids), F.arrays_zip(row_ids, col_ids)
    ).otherwise(F.raise_error(F.lit("row and column lists differ in length")))
    return (requests.select(*rest, F.posexplode(zipped).alias("pos", "pair"))
            .select(*rest, F.col("pos").cast("bigint").alias("pos"),
                    F.col(f"pair.{row_ids}").cast("bigint").alias("row_id"),
                    F.col(f"pair.{col_ids}").cast("bigint").alias("col_id")))


def score_pairs(pairs: DataFrame, rows: DataFrame, cols: DataFrame, d: Sequence[float],
                n_rows: int, n_cols: int, observed: DataFrame | None = None, strict: bool = False,
                min_value: float | None = None, max_value: float | None = None,
                small_rows: bool = False, small_cols: bool = False, small_observed: bool = False) -> DataFrame:
    """Adds ``prediction`` and ``source`` to every pair.

    ``rows`` is ``(row_id, center, scale, u)`` and ``cols`` is ``(col_id, center, scale, v)``. A pair
    found in ``observed`` gets its stored rating; any other pair inside the shape gets the low-rank
    value, where a row or column without a vector counts as zero; both in rating units. The plan is
    lazy. ``small_rows``, ``small_cols`` and ``small_observed`` say that the caller has checked the table's size for a
    broadcast; otherwise the optimizer plans shuffles and splits skewed pairs at run time.
    """
    def side(table: DataFrame, key: str, name: str, vector: str, small: bool) -> DataFrame:
        out = table.select(F.col(key).alias(f"_{key}"), F.col("center").alias(f"_{name}_center"),
                           F.col("scale").alias(f"_{name}_scale"), F.col(vector).alias(f"_{vector}"))
        return F.broadcast(out) if small else out

    rank = len(d)
    sides = (side(cols, "col_id", "col", "v", small_cols), side(rows, "row_id", "row", "u", small_rows))
    joined = pairs
    for key, table in zip(("col_id", "row_id"), sides):
        joined = joined.join(table, F.col(key) == F.col(f"_{key}"), "left")
    if observed is not None:
        stored = observed.select(F.col("row_id").alias("_at_row"), F.col("col_id").alias("_at_col"),
                                 F.col("value").alias("_stored"))
        stored = F.broadcast(stored) if small_observed else stored
        joined = joined.join(stored, (F.col("row_id") == F.col("_at_row")) & (F.col("col_id") == F.col("_at_col")), "left")
    else:
        joined = joined.withColumn("_stored", F.lit(None).cast("double"))

    low_rank = dot([f"_u[{k}] * {number(w)}" for k, w in enumerate(d)], [f"_v[{k}]" for k in range(rank)])
    joined = joined.withColumn("_low_rank", F.expr(f"coalesce({low_rank}, 0D)"))
    estimate = back_transform("_low_rank", prefix="_")
    if min_value is not None:
        estimate = F.greatest(estimate, F.lit(float(min_value)))
    if max_value is not None:
        estimate = F.least(estimate, F.lit(float(max_value)))

    status = request_status(n_rows, n_cols)
    refused = (F.raise_error(F.concat_ws(" ", F.lit("pair"), "row_id", "col_id", status)).cast("double")
               if strict else F.lit(None).cast("double"))
    keep = [c for c in pairs.columns if c not in ("prediction", "source")]
    return joined.select(
        *keep,
        F.when(status != "ok", refused).otherwise(F.coalesce("_stored", estimate)).alias("prediction"),
        F.when(status != "ok", "out_of_range").when(F.col("_stored").isNotNull(), "observed")
        .otherwise("model").alias("source"))
