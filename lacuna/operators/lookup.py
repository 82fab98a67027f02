"""Observed cells kept for lookups: bucketed by row and sorted, so that a request reads only what it asks for."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.session import Scratch
from lacuna.sources.ratings import KEYS

#: So many different places are sought by value, which prunes buckets and row groups; more by a broadcast join alone.
MOST_PLACES = 10_000
#: Cells of a bucket, and cells of a row above which it is spread over several places.
CELLS_PER_BUCKET, HOT_CELLS = 1_000_000, 250_000
MOST_HOT_ROWS = 100_000
#: Bytes of a pair in a broadcast, and pairs that are sent to every executor; more are joined by a shuffle.
PAIR_BYTES = 80
BROADCAST_PAIRS = (64 << 20) // PAIR_BYTES


class CellIndex:
    """A bucketed table of cells ``(place, row_id, col_id, value)``, sorted by place within each bucket.

    The place of a cell is a hash of its row. A row of more than ``hot_cells`` cells has several places, by the hash of
    the column, so that no bucket holds more than its share. A lookup hashes the pairs to their places; Spark
    reads the buckets of those places alone and skips the row groups whose range of places has none of them. The cells
    are never shuffled again.
    """

    def __init__(self, cells: DataFrame, name: str, hot: DataFrame | None, n_buckets: int):
        self.cells, self.name, self.hot, self.n_buckets = cells, name, hot, n_buckets

    @classmethod
    def build(cls, cells: DataFrame, scratch: Scratch, n_cells: int | None = None, n_buckets: int | None = None,
              hot_cells: int = HOT_CELLS) -> CellIndex:
        """Write the index below the scratch folder: one shuffle of the cells.

        ``cells`` must have each (row_id, col_id) once. ``n_buckets`` is the least number of buckets; there are more if they
        would hold over ``CELLS_PER_BUCKET`` cells each. Rows above ``hot_cells``, or above n_cells / 100,000 if that is
        more, are counted first; there are at most 100,000 of them, so their table can be broadcast.
        """
        spark = cells.sparkSession
        if n_cells is None:
            n_cells = cells.count()
        hot_cells = max(hot_cells, -(-n_cells // MOST_HOT_ROWS))
        hot = None
        if n_cells > hot_cells:
            hot, seen = scratch.write_observed(
                cells.groupBy("row_id").count().where(F.col("count") > hot_cells).select(
                    F.col("row_id").alias("_hot"), F.ceil(F.col("count") / hot_cells).cast("int").alias("_salts")),
                "hot_rows", n="count(1)")
            hot = hot if seen["n"] else None
        n_buckets = max(n_buckets or 1, -(-n_cells // CELLS_PER_BUCKET))
        name = f"lacuna_cells_{uuid.uuid4().hex}"
        placed = _placed(cells.select(*KEYS, "value"), hot).select("place", *KEYS, "value")
        (placed.repartition(n_buckets, "place").write.format("parquet").bucketBy(n_buckets, "place")
         .sortBy("place", *KEYS).option("path", scratch.path("index")).saveAsTable(name))
        return cls(spark.table(name), name, hot, n_buckets)

    def find(self, asked: DataFrame) -> DataFrame:
        """``(row_id, col_id, value)`` of those asked pairs that are cells.

        Up to ``BROADCAST_PAIRS`` pairs are sent to every executor and no cell is moved. With more of them both sides are
        shuffled and merged, the cells of the buckets that are left. Only the different places, up to ``MOST_PLACES``, reach
        the driver. Null ids match nothing.
        """
        rows = _placed(asked.select(*KEYS).where("row_id IS NOT NULL AND col_id IS NOT NULL"), self.hot)
        places = [r["place"] for r in rows.select("place").distinct().limit(MOST_PLACES + 1).collect()]
        cells = self.cells.where(F.col("place").isin(places)) if len(places) <= MOST_PLACES else self.cells
        if rows.count() <= BROADCAST_PAIRS:
            return cells.join(F.broadcast(rows), ["place", *KEYS], "left_semi").select(*KEYS, "value")
        # Each pair once, so that one asked for very often does not all go to one task.
        return cells.join(rows.distinct().hint("merge"), ["place", *KEYS], "left_semi").select(*KEYS, "value")

    def drop(self) -> None:
        """Forget the table; its files lie below the scratch folder."""
        self.cells.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def _placed(pairs: DataFrame, hot: DataFrame | None) -> DataFrame:
    if hot is None:
        return pairs.withColumn("place", F.xxhash64("row_id", F.lit(0)))
    salt: Column = F.coalesce(F.pmod(F.xxhash64("col_id"), F.col("_salts")).cast("int"), F.lit(0))
    return pairs.join(F.broadcast(hot), F.col("row_id") == F.col("_hot"), "left").withColumn(
        "place", F.xxhash64("row_id", salt)).drop("_hot", "_salts")


def find_by_scan(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """The same from cells that have no index: all are read, none is shuffled."""
    return cells.join(F.broadcast(asked.select(*KEYS)), KEYS, "left_semi").select(*KEYS, "value")
