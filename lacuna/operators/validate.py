"""Checks on ratings and on scoring requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_ratings(df: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "value") -> None:
    """A matrix is two integer key columns and one numeric value column."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = [name for name in (row, col, value) if name not in fields]
    if missing:
        raise ValueError(f"Expected a two-dimensional matrix with columns {row}, {col}, {value}; missing {missing}")
    for name in (row, col):
        if not isinstance(fields[name], T.IntegralType):
            raise ValueError(f"Column {name} must hold integers, got {fields[name].simpleString()}")
    if not isinstance(fields[value], T.NumericType):
        raise ValueError(f"Column {value} must be numeric, got {fields[value].simpleString()}")


def defect(row: str = "row_id", col: str = "col_id", value: str = "value") -> Column:
    """Whether a rating cannot be a cell: a null id, a null value or NaN."""
    return F.col(row).isNull() | F.col(col).isNull() | F.col(value).isNull() | F.isnan(value)


def defect_counts(df: DataFrame, row: str = "row_id", col: str = "col_id", value: str = "value") -> DataFrame:
    """One row: rows in all, and those with a null id, a null value, NaN, or any of these."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.col(row).isNull() | F.col(col).isNull()).alias("null_ids"),
                  F.count_if(F.col(value).isNull()).alias("null_values"),
                  F.count_if(F.isnan(value)).alias("nan_values"), F.count_if(defect(row, col, value)).alias("defects"))


def check_mask(n_rows: int, n_cols: int, nnz: int) -> None:
    """There must be something to learn from and something to complete."""
    if nnz == 0:
        raise ValueError("The matrix has no observed cell")
    if nnz == n_rows * n_cols:
        raise ValueError("The matrix has no missing cell")


def clamp_rank(rank: int, n_rows: int, n_cols: int) -> int:
    return min(rank, n_rows, n_cols)


def mask_flags(profiles: DataFrame) -> DataFrame:
    """The two conditions of ``check_mask`` as columns, for many matrices at once."""
    return profiles.withColumn("is_full", F.expr("nnz = n_rows * n_cols")).withColumn(
        "is_empty", F.expr("nnz = 0")).withColumn("is_valid", F.expr("NOT is_full AND NOT is_empty"))


def check_requests(pairs: DataFrame) -> None:
    fields = {f.name: f.dataType for f in pairs.schema.fields}
    for name in ("row_id", "col_id"):
        if name not in fields or not isinstance(fields[name], T.IntegralType):
            raise ValueError("row_id and col_id must be integers")


def request_status(n_rows: int, n_cols: int) -> Column:
    """``ok``, ``col_out_of_range`` or ``row_out_of_range``; the column is checked first."""
    return (F.when(F.expr(f"col_id IS NULL OR col_id < 0 OR col_id >= {n_cols}"), "col_out_of_range")
            .when(F.expr(f"row_id IS NULL OR row_id < 0 OR row_id >= {n_rows}"), "row_out_of_range")
            .otherwise("ok"))
