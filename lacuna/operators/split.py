"""Leave-N-out splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.sampling import exact_sample
from lacuna.session import Scratch
from lacuna.sources.ratings import KEYS, drop_zeros

#: So many held-out keys (16 bytes each) are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def support_filter(cells: DataFrame, key: str, minimum: int) -> DataFrame:
    """Cells whose row (or column) holds at least ``minimum`` cells."""
    kept = cells.groupBy(key).count().filter(F.col("count") >= minimum).select(key)
    return cells.join(kept, key, "left_semi")


def support_clip(cells: DataFrame, minimum: int) -> DataFrame:
    """Rows first, then columns counted on the surviving rows; one pass, not to a fixed point."""
    return support_filter(support_filter(cells, "row_id", minimum), "col_id", minimum)


@dataclass
class Split:
    train: DataFrame
    test: DataFrame


def leave_n_out(cells: DataFrame, n_holdout: int, min_support: int | None = None, seed: int = 31) -> Split:
    """Hold out ``n_holdout`` cells in total, drawn from the well-supported part of the matrix.

    ``min_support`` defaults to ``n_holdout``. Held-out cells keep their true value; explicit
    zeros are removed from the training side.
    """
    minimum = n_holdout if min_support is None else min_support
    scratch = Scratch(cells.sparkSession, "split")
    # Cells, clipped and held-out ones are written once each: what follows reads them several times.
    cells = scratch.write(cells.select(*KEYS, "value"), "cells")
    clipped, seen = scratch.write_observed(support_clip(cells, minimum).select(*KEYS, "value"), "clipped", n="count(1)")
    test = scratch.write(exact_sample(clipped, n_holdout, seed, n_cells=seen["n"]).select(*KEYS, "value"), "test")
    scratch.drop("clipped")
    held = test.select(*KEYS)
    if n_holdout <= BROADCAST_ROWS:
        held = F.broadcast(held)
    return Split(drop_zeros(cells.join(held, KEYS, "left_anti")).select(*KEYS, "value"), test)
