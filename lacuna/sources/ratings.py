"""Ratings as a long DataFrame ``(row_id BIGINT, col_id BIGINT, value DOUBLE)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["row_id", "col_id"]
CSV_SCHEMA = T.StructType([
    T.StructField("userId", T.LongType()),
    T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()),
])
SEGMENT = 65_536
TRIPLES_PER_TASK = 1_000_000


def read_ratings_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     row: str = "userId", col: str = "movieId", value: str = "rating") -> DataFrame:
    """Ratings from a CSV with a header. Columns beyond the three named ones are not kept.

    Spark applies ``schema`` by position, so it lists the columns in the order of the file. A line
    that does not fit it is an error, not a null.
    """
    raw = spark.read.schema(schema or CSV_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path)
    return raw.select(
        F.col(row).cast("bigint").alias("row_id"),
        F.col(col).cast("bigint").alias("col_id"),
        F.col(value).cast("double").alias("value"))


def assemble(triples: DataFrame, by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """One cell per ``(row_id, col_id)``; repeated cells add up.

    The partial sums run before the shuffle, so many copies of one cell cost one row per task. For triples that hardly
    repeat a cell ``parts`` is the number of tasks that they are dealt to as they are: adaptive execution would give a task
    all that is small when compressed, and its hash tables hold the cells plain.
    """
    if parts:
        triples = triples.repartition(parts, *by, *KEYS)
    return triples.groupBy(*by, *KEYS).agg(F.sum(F.col("value").cast("double")).alias("value"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "value")


def drop_zeros(cells: DataFrame) -> DataFrame:
    return cells.filter("value != 0")


def pack_columns(cells: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Compressed columns: parallel arrays of row ids and values, ordered by row id.

    A column is cut into segments of ``segment`` consecutive row ids, so that no array, and no
    group collected in a task, is longer than that, however many cells a column holds.
    """
    entries = F.array_sort(F.collect_list(F.struct("row_id", "value")))
    return (cells
            .groupBy("col_id", F.expr(f"row_id div {segment}").alias("segment"))
            .agg(entries.alias("entries"))
            .select("col_id", "segment",
                    F.col("entries.row_id").alias("row_ids"),
                    F.col("entries.value").alias("values")))


def unpack_columns(packed: DataFrame) -> DataFrame:
    """Triples from compressed columns. Arrays of unequal length are an error."""
    pairs = F.when(
        F.expr("size(row_ids) = size(`values`)"), F.arrays_zip("row_ids", "values")
    ).otherwise(F.raise_error(F.lit("row_ids and values differ in length")))
    return (packed.select("col_id", F.inline(pairs))
            .select(F.col("row_ids").cast("bigint").alias("row_id"), "col_id",
                    F.col("values").cast("double").alias("value")))


def profile(cells: DataFrame, rank: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Shape, number of cells and density; ``rank`` adds the rank clamped to the shape."""
    out = cells.groupBy(*by).agg(
        F.expr("max(row_id) + 1").alias("n_rows"),
        F.expr("max(col_id) + 1").alias("n_cols"),
        F.count("*").alias("nnz"),
    ).withColumn("density", F.expr("nnz / (cast(n_rows AS double) * n_cols)"))
    if rank is not None:
        out = out.withColumn("rank", F.expr(f"least({rank}L, n_rows, n_cols)"))
    return out


def parts_for(spark: SparkSession, rows: int) -> int:
    """Tasks for so many triples: one per million, and all cores if there is work for them."""
    return max(1, -(-rows // TRIPLES_PER_TASK), min(spark.sparkContext.defaultParallelism, rows // 20_000))


def sales_ratings(spark: SparkSession, folder: str, row: str = "customer", col: str = "part") -> DataFrame:
    """Raw rating triples out of the sales tables: who bought how much of what.

    ``row`` and ``col`` are ``customer``, ``part`` or ``supplier``. Only the needed columns are
    read, and the orders table only if customers are asked for.
    """
    names = {"customer": "o_custkey", "part": "l_partkey", "supplier": "l_suppkey"}
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    if "customer" in (row, col):
        orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col(names[row]).alias("row_id"), F.col(names[col]).alias("col_id"),
        F.col("l_quantity").alias("value"))
