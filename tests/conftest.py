import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RATINGS = "row_id bigint, col_id bigint, value double"


@pytest.fixture(scope="session")
def spark():
    from lacuna.session import session

    spark = session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def unit_matrix(spark):
    """5 x 6, one cell in every column but one; row 2 and column 4 are empty."""
    return spark.createDataFrame(
        [(0, 0, 4.0), (3, 3, -5.0), (1, 1, 7.0), (0, 2, -9.0), (4, 5, 2.0)], RATINGS)


# The published 6 x 5 example, one entry per column (row ids, values).
VIGNETTE = {
    0: ([0, 1, 2, 3, 4, 5], [0.86548894, -0.60041722, -0.71692924, 0.69655580, 1.23116102, 0.26644155]),
    1: ([0, 3, 4, 5], [0.01565179, -0.50331812, -0.34232368, 0.14486388]),
    2: ([0, 1, 3, 4], [0.17479031, -0.21190900, 0.55848392, -0.81026875]),
    3: ([2, 3, 4], [0.06437356, 1.54375663, -0.82006429]),
    4: ([2, 4, 5], [-0.09754133, -0.13256942, -2.24087863]),
}


@pytest.fixture(scope="session")
def vignette_packed(spark):
    return spark.createDataFrame(
        [(c, rows, values) for c, (rows, values) in VIGNETTE.items()],
        "col_id bigint, row_ids array<bigint>, `values` array<double>")


@pytest.fixture(scope="session")
def vignette(spark):
    return spark.createDataFrame(
        [(r, c, x) for c, (rows, values) in VIGNETTE.items() for r, x in zip(rows, values)], RATINGS)


@pytest.fixture(scope="session")
def vignette_dense():
    import numpy as np

    out = np.full((6, 5), np.nan)
    for c, (rows, values) in VIGNETTE.items():
        out[rows, c] = values
    return out


@pytest.fixture(scope="session")
def planted(spark):
    """200 x 100, exactly rank 2, 40 % observed; integer arithmetic only."""
    def f(z, a, c, q):
        return f"(cast(({z} * {a} + {c}) % {q} AS double) / {q} - 0.5)"

    truth = (f"10 * ({f('row_id', 7919, 17, 1009)} * {f('col_id', 5477, 29, 1013)} + "
             f"{f('row_id', 6101, 17, 1009)} * {f('col_id', 3571, 29, 1013)})")
    grid = spark.range(200 * 100).selectExpr("id div 100 AS row_id", "id % 100 AS col_id")
    seen = "(3*row_id*row_id + 5*col_id*col_id + 7*row_id*col_id + row_id + 2*col_id) % 101 < 40"
    return grid.selectExpr("row_id", "col_id", f"{truth} AS truth", f"{seen} AS observed").cache()
