"""How the cells lie in the cluster, and how small per-key tables are joined to them.

A fit passes over the same cells many times. They are therefore hash partitioned once by row and
once by column and kept, so that later passes shuffle only per-key tables, never the cells.

A row or column may hold a large part of all cells. Its cells are spread over several salts, by
the hash of the other key, and the per-key tables are repeated for those salts only.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators.blocks import SHUFFLED_FROM, Blocks
from lacuna.session import Scratch, free

Attach = Callable[..., DataFrame]

BROADCAST_BYTES = 64 << 20
#: Without a given limit a broadcast table may take this part of the smaller of an executor's and the driver's heap.
BROADCAST_SHARE = 1 / 16
CELLS_PER_PARTITION = 1_000_000
CELLS_WORTH_A_TASK = 20_000
WIDE_ROW_BYTES = 304
MAX_HOT_KEYS = 100_000
#: From so many cells on passes go by blocks, if their dense matrix of 8 bytes an entry takes at most this many times ``broadcast_bytes``.
BLOCKS_FROM, DENSE_SHARE = 250_000, 1.6
OTHER = {"row_id": "col_id", "col_id": "row_id"}


def plain_attach(cells: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a per-key table and leave the strategy to the optimizer."""
    return cells.join(side, key, how)


def broadcast_share(spark: SparkSession) -> int:
    """The largest per-key table to broadcast if no limit is given: a share of the memory, ``BROADCAST_BYTES`` at least."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime().maxMemory()
    if not spark.sparkContext.master.startswith("local["):
        given = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.sparkContext.getConf().get("spark.executor.memory", "1g").strip().lower())
        # A bare number is in MiB.
        heap = min(heap, int(given[1]) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(given[2], 20)) if given else 0
    return max(BROADCAST_BYTES, int(heap * BROADCAST_SHARE))


def table_bytes(side: DataFrame, rows: int) -> int:
    """Upper estimate of a per-key table of 8-byte columns inside a broadcast hash map."""
    return rows * (8 * len(side.columns) + 48)


@dataclass
class Layout:
    """Cells in one or two partitionings, with what is known about their size.

    ``centers`` are ``(key, center)`` of both sides once the cells are centered; the cells stay as they are, and a pass
    takes the centers off as it joins the vectors.
    """

    cells: DataFrame
    scratch: Scratch
    n_rows: int
    n_cols: int
    nnz: int
    broadcast_bytes: int = BROADCAST_BYTES
    cells_per_partition: int = CELLS_PER_PARTITION
    hot_cells: int | None = None
    ids: dict[str, int] = field(default_factory=dict)
    hot: dict[str, DataFrame] = field(default_factory=dict)
    centers: dict[str, DataFrame] = field(default_factory=dict)
    blocks: Blocks | None = None
    _placed: dict[str, DataFrame] = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __post_init__(self) -> None:
        spark = self.scratch.spark
        least = spark.sparkContext.defaultParallelism
        self.partitions = max(min(least, -(-self.nnz // CELLS_WORTH_A_TASK)), -(-self.nnz // self.cells_per_partition))
        # A key is hot above this many cells, so there are fewer than nnz / hot_cells of them: never
        # more than MAX_HOT_KEYS, and their table is always small enough to broadcast.
        self.hot_cells = max(self.hot_cells or self.cells_per_partition // 4, -(-self.nnz // MAX_HOT_KEYS))
        for key, bound in (("row_id", self.n_rows), ("col_id", self.n_cols)):
            if key not in self.ids:
                self.ids[key] = min(bound, self.nnz)
                if self.nnz > self.hot_cells:
                    self._find_hot(key)
        if max(self.ids.values()) * WIDE_ROW_BYTES > self.broadcast_bytes:
            # Per-key tables may have to be shuffled to the cells. With fewer partitions than
            # Spark's own shuffles use, the planner would rather shuffle the cells again.
            self.partitions = max(self.partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if self.blocks is None and self.nnz >= BLOCKS_FROM and not self.hot:
            self.blocks = Blocks(self)

    def by_blocks(self, columns: int) -> bool:
        """Whether a pass with so many columns goes by blocks."""
        return self.blocks is not None and max(self.ids.values()) * 8 * columns <= DENSE_SHARE * self.broadcast_bytes

    def _find_hot(self, key: str) -> None:
        counts = self.cells.groupBy(key).count()
        seen = counts.agg(F.count("*").alias("ids"), F.expr(f"count_if(count > {self.hot_cells})").alias("hot")).first()
        self.ids[key] = seen["ids"]
        if seen["hot"]:
            hot = counts.filter(F.col("count") > self.hot_cells).select(
                key, F.expr(f"cast(ceil(count / {self.hot_cells}) AS int)").alias("salts"))
            self.hot[key] = self.scratch.write(hot, f"hot_{key}")

    def writing_to(self, scratch: Scratch) -> Layout:
        """The same placed cells for another run, which writes its tables elsewhere."""
        return replace(self, scratch=scratch)

    def fits(self, side: DataFrame, key: str) -> bool:
        return table_bytes(side, self.ids[key]) <= self.broadcast_bytes

    def _keys(self, key: str) -> list[str]:
        return [key, f"{key}_salt"] if key in self.hot else [key]

    def _salted(self) -> DataFrame:
        cells = self.cells
        for key, hot in self.hot.items():
            salt = f"cast(pmod(xxhash64({OTHER[key]}), coalesce(salts, 1)) AS int)"
            cells = (cells.join(F.broadcast(hot), key, "left")
                     .withColumn(f"{key}_salt", F.expr(salt)).drop("salts"))
        return cells

    def placed_by(self, key: str) -> DataFrame:
        """All cells, hash partitioned by a key and its salt, and kept.

        Without hot ids the cells of an id lie side by side, and ``opens`` is the id at the first of them, null at the others.
        """
        with self._lock:
            if key not in self._placed:
                placed = self._salted().repartition(self.partitions, *self._keys(key))
                if key not in self.hot:
                    place = F.row_number().over(Window.partitionBy(key).orderBy(OTHER[key]))
                    placed = placed.withColumn("opens", F.when(place == 1, F.col(key)))
                self._placed[key] = placed.persist(StorageLevel.MEMORY_AND_DISK)
            return self._placed[key]

    def cells_for(self, group: str, side: DataFrame | None) -> DataFrame:
        """The placement that suits a pass which joins ``side`` on the other key, then groups.

        If the side can be broadcast, the cells of a group should be together; if not, the cells
        should already lie where the side has to be sent.
        """
        if side is None or self.fits(side, OTHER[group]):
            return self.placed_by(group)
        return self.placed_by(OTHER[group])

    def attach(self, cells: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
        """Join a per-key table to cells: broadcast if small, else hash join on key and salt."""
        if self.fits(side, key):
            return cells.join(F.broadcast(side), key, how)
        keys = self._keys(key)
        if len(keys) > 1 and keys[1] in cells.columns:
            copies = F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)")).alias(keys[1])
            side = side.join(F.broadcast(self.hot[key]), key, "left").select(*side.columns, copies)
            return cells.join(side.hint("shuffle_hash"), keys, how)
        return cells.join(side.hint("shuffle_hash"), key, how)

    def attach_grouped(self, groups: DataFrame, side: DataFrame, key: str) -> DataFrame:
        """Join two per-key tables, one row per key on both sides."""
        return groups.join(F.broadcast(side) if self.fits(side, key) else side, key)

    def sweep(self) -> None:
        """After a pass over many cells: its shuffle files go before the next pass writes others."""
        if self.nnz > SHUFFLED_FROM:
            free(self.scratch.spark)

    def release(self) -> None:
        for placed in self._placed.values():
            placed.unpersist()
        self._placed.clear()
        if self.blocks is not None:
            self.blocks.release()
