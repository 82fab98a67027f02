"""Factor tables: one short vector per row or column id, and small matrices between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.vectors import (
    array_scale, columns, cross_matrix, cross_sql, gram_matrix, gram_sql, pack, rotated, unpack,
)

# Floor of the change measure's denominator; limits of the Gram route.
NORM_FLOOR = 1e-9
RANK_TOLERANCE = 1e-7
REFINE_BELOW = 1e-3
UNROLLED_RANK = 8


@dataclass(frozen=True)
class Factor:
    """The vectors ``row(table) @ matrix``, keyed by ``key``.

    Rotations and rescalings change only the small matrix; the table stays where it is. With ``packed`` (first entry,
    width) the vectors are those entries of the doubles in the binary column ``prefix``, and ``blocks`` the table of blocks that
    ``table`` comes from, if it comes from one.
    """

    table: DataFrame
    key: str
    prefix: str
    matrix: np.ndarray
    packed: tuple[int, int] | None = None
    blocks: DataFrame | None = None

    def times(self, matrix: np.ndarray) -> Factor:
        return replace(self, matrix=self.matrix @ matrix)

    def select(self, out: str) -> DataFrame:
        return select_vectors({out: self})


def unrolled(ranks: Sequence[int]) -> bool:
    """Whether products of vectors of these ranks are few enough to be written out as column arithmetic."""
    return sum(r * r for r in ranks) <= UNROLLED_RANK ** 2


def select_vectors(wanted: dict[str, Factor], keep: Sequence[str] = ()) -> DataFrame:
    """Vectors of one or more factors that share a table, as columns ``<name>0, <name>1, ...``; ``keep`` stays as it is.

    Few products are written out as column arithmetic. More of them, rank squared terms per row, are
    one NumPy product per Arrow batch.
    """
    first = next(iter(wanted.values()))
    table, key = first.table, first.key
    if first.packed is None and unrolled([len(f.matrix) for f in wanted.values()]):
        return table.selectExpr(key, *[c for name, f in wanted.items()
                                       for c in rotated(columns(f.prefix, len(f.matrix)), f.matrix, name)], *keep)
    outputs = [c for name, f in wanted.items() for c in columns(name, f.matrix.shape[1])]
    return _multiplied(wanted, keep, outputs, lambda right: [pa.array(np.ascontiguousarray(x)) for x in right.T],
                       ", ".join(f"{c} double" for c in outputs))


def pack_vectors(wanted: Sequence[Factor], name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Vectors of factors that share a table, side by side as the doubles of one binary column ``name``."""
    return _multiplied(dict(enumerate(wanted)), keep, [name], lambda right: [packed(right)], f"{name} binary")


def _multiplied(wanted: dict, keep: Sequence[str], outputs: list[str], send: Callable[[np.ndarray], list[pa.Array]],
                types: str) -> DataFrame:
    """The wanted vectors as one NumPy product per Arrow batch, in the columns that ``send`` makes of them."""
    first = next(iter(wanted.values()))
    table, key = first.table, first.key
    sources = {f.prefix: len(f.matrix) if f.packed is None else f.packed[1] for f in wanted.values()}
    tops = dict(zip(sources, np.cumsum([0, *sources.values()])))
    inputs = [c for prefix, width in sources.items() for c in ([prefix] if first.packed else columns(prefix, width))]
    blocks = np.zeros((sum(sources.values()), sum(f.matrix.shape[1] for f in wanted.values())))
    done = 0
    for factor in wanted.values():
        top, (rank, width) = tops[factor.prefix] + (factor.packed or (0,))[0], factor.matrix.shape
        blocks[top:top + rank, done:done + width] = factor.matrix
        done += width
    rest, binary = len(inputs) + 1, first.packed is not None

    def multiply(batches):
        for batch in batches:
            if batch.num_rows:
                read = [batch.column(k + 1) for k in range(len(inputs))]
                left = np.column_stack([unpacked(c) if binary else c.to_numpy() for c in read])
                yield pa.RecordBatch.from_arrays([batch.column(0), *send(left @ blocks), *batch.columns[rest:]],
                                                 [key, *outputs, *keep])

    schema = f"{key} bigint, {types}" + "".join(f", {c} double" for c in keep)
    return table.select(key, *inputs, *keep).mapInArrow(multiply, schema)


def _packing() -> tuple[Callable[[np.ndarray], pa.Array], Callable[[pa.Array], np.ndarray]]:
    # Inner functions travel to the tasks by value, so the workers need not have this module.
    def packed(matrix: np.ndarray) -> pa.Array:
        """The rows of a matrix as binary values."""
        rows, width = matrix.shape
        ends = np.arange(rows + 1, dtype=np.int64) * (8 * width)
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix))]).cast(pa.binary())

    def unpacked(values: pa.Array) -> np.ndarray:
        """The binary values, one at least, as rows of a matrix; nulls are left out."""
        ends = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_binary(values.type) else np.int32)
        begin, stop = int(ends[values.offset]), int(ends[values.offset + len(values)])
        rows = len(values) - values.null_count
        return np.frombuffer(values.buffers()[2], np.float64, (stop - begin) // 8, begin).reshape(rows, -1)

    return packed, unpacked


packed, unpacked = _packing()


def table_products(table: DataFrame, pairs: Sequence[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    """``left^T right`` for pairs of column lists of a table, by NumPy products per Arrow batch.

    A task sends on small matrices only, and those are added up in a shuffle, not on the driver.
    """
    names = list(dict.fromkeys(c for pair in pairs for side in pair for c in side))
    return _products(table, names, [tuple([names.index(c) for c in side] for side in pair) for pair in pairs])


def packed_products(table: DataFrame, names: list[str], pairs: Sequence[tuple[list[int], list[int]]]) -> list[np.ndarray]:
    """The same of binary columns: ``pairs`` are places in the vectors of all of them, one after the other."""
    return _products(table, names, pairs, binary=True)


def _products(table: DataFrame, names: list[str], at: Sequence[tuple[list[int], list[int]]], binary: bool = False) -> list[np.ndarray]:
    shapes = [(len(left), len(right)) for left, right in at]

    def partial(batches):
        total = [np.zeros(shape) for shape in shapes]
        for batch in batches:
            if batch.num_rows:
                block = np.column_stack([unpacked(c) if binary else c.to_numpy() for c in batch.columns])
                for (left, right), out in zip(at, total):
                    out += block[:, left].T @ block[:, right]
        flat = np.concatenate([x.ravel() for x in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "g"])

    sums = table.select(*names).mapInArrow(partial, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    flat = np.zeros(sum(a * b for a, b in shapes))
    for i, g in sums:
        flat[i] = g
    cuts = np.cumsum([a * b for a, b in shapes])[:-1]
    return [x.reshape(shape) for x, shape in zip(np.split(flat, cuts), shapes)]


def thin_svd_from_gram(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a tall table B with this Gram matrix: singular values, right vectors W, and W/s.

    ``B @ (W/s)`` has orthonormal columns. Values below 1e-7 of the largest are beyond what the
    squared matrix can tell from zero; they become 0 with a zero vector. Each column of W is signed
    so that its largest entry is positive.
    """
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    s = np.sqrt(np.clip(values[order], 0.0, None))
    w = vectors[:, order]
    w = w * np.where(w[np.abs(w).argmax(axis=0), np.arange(len(s))] < 0, -1.0, 1.0)
    s = np.where(s > RANK_TOLERANCE * s[0], s, 0.0)
    inverse = np.divide(1.0, s, out=np.zeros_like(s), where=s > 0)
    return s, w, w * inverse


def thin_svd(raw: Factor, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for ``raw`` with that Gram matrix, made accurate when its condition is poor.

    The Gram matrix squares the condition number. If small singular values have lost digits, the
    nearly orthonormal vectors are formed, and their own Gram matrix, one more aggregation, gives
    the correction.
    """
    s, w, over = thin_svd_from_gram(gram)
    live = s > 0
    if not live.any() or s[live].min() > REFINE_BELOW * s[0]:
        return s, w, over
    near = replace(raw, matrix=raw.matrix @ over[:, live])
    upper = np.linalg.cholesky(table_gram(near.select("z"), columns("z", int(live.sum())))).T
    left, values, right = np.linalg.svd(upper @ (s[live, None] * w[:, live].T), full_matrices=False)
    flip = np.where(np.take_along_axis(right, np.abs(right).argmax(axis=1)[:, None], 1) < 0, -1.0, 1.0)
    s, w, over = s.copy(), w.copy(), over.copy()
    s[live], w[:, live] = values, (right * flip).T
    over[:, live] = over[:, live] @ np.linalg.solve(upper, left) * flip.T
    return s, w, over


def shrink_weights(d: np.ndarray, shrinkage: float) -> np.ndarray:
    """``d / (d + shrinkage)``, with 0 for a vanished component."""
    return np.divide(d, d + shrinkage, out=np.zeros_like(d), where=d + shrinkage > 0)


def soft_threshold(d: np.ndarray, shrinkage: float) -> np.ndarray:
    return np.maximum(d - shrinkage, 0.0)


def relative_change(d_old: np.ndarray, d_new: np.ndarray, cross_u: np.ndarray, cross_v: np.ndarray,
                    criterion: str = "trace") -> float:
    """Squared distance of two factor triples relative to the old one.

    ``cross_u`` is new-by-old for U, ``cross_v`` likewise for V. ``trace`` is the Frobenius norm;
    ``column_sum`` multiplies column sums instead and agrees where both matrices are diagonal.
    """
    if criterion == "trace":
        shared = np.trace((d_new[:, None] * cross_u * d_old) @ cross_v.T)
    elif criterion == "column_sum":
        shared = (d_new @ cross_u) @ (cross_v @ d_old)
    else:
        raise ValueError(f"unknown criterion {criterion}")
    old, new = (d_old ** 2).sum(), (d_new ** 2).sum()
    return float((old + new - 2 * shared) / max(old, NORM_FLOOR))


def table_gram(table: DataFrame, names: list[str]) -> np.ndarray:
    """Gram matrix of a factor table by one aggregation."""
    if len(names) > UNROLLED_RANK:
        return table_products(table, [(names, names)])[0]
    return gram_matrix(table.agg(F.expr(gram_sql(names)).alias("g")).first()["g"], len(names))


def array_gram(table: DataFrame, name: str, rank: int) -> DataFrame:
    """The same for an array column, as rows ``(i, j, g)`` with ``i <= j``."""
    entries = [f"named_struct('i', {i}, 'j', {j}, 'g', sum({name}[{i}] * {name}[{j}]))"
               for i in range(rank) for j in range(i, rank)]
    return table.agg(F.expr(f"array({', '.join(entries)})").alias("entries")).select(F.inline("entries"))


def table_svd(table: DataFrame, key: str, name: str, rank: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Thin SVD of a factor table with an array column: orthonormal table, values, right vectors."""
    flat = table.selectExpr(key, *unpack(name, "f", rank))
    raw = Factor(flat, key, "f", np.eye(rank))
    s, w, over = thin_svd(raw, table_gram(flat, columns("f", rank)))
    ortho = raw.times(over).select("o").selectExpr(key, pack(columns("o", rank), name))
    return ortho, s, w


def cross_gram(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str, rank: int) -> np.ndarray:
    """``left^T right`` of two array-valued factor tables joined on their key."""
    joined = left.selectExpr(key, *unpack(left_name, "a", rank)).join(
        right.selectExpr(key, *unpack(right_name, "b", rank)), key)
    flat = joined.agg(F.expr(cross_sql(columns("a", rank), columns("b", rank))).alias("c")).first()["c"]
    return cross_matrix(flat, rank, rank)


def scale_columns(table: DataFrame, name: str, weights: list[float]) -> DataFrame:
    """Factor vectors with each component times its weight."""
    return table.withColumn(name, array_scale(name, weights))


def gaussian_start(rank: int, seed: int, key: str = "row_id", prefix: str = "f") -> list[str]:
    """Independent normal draws computed from the key, so that they do not depend on partitions."""
    def uniform(k: int, stream: int) -> str:
        return f"((shiftrightunsigned(xxhash64({key}, {k}, {stream}, {seed}L), 11) + 0.5D) / 9007199254740992D)"
    return [f"sqrt(-2 * ln({uniform(k, 0)})) * cos(2 * pi() * {uniform(k, 1)}) AS {prefix}{k}" for k in range(rank)]


def integer_start(rank: int, key: str = "row_id", prefix: str = "f", seed: int = 0) -> list[str]:
    """Start entries by integer arithmetic, the same in every SQL engine."""
    return [f"(({key} * 7919 + {k * 104729 + 31 + seed * 3571}) % 1000) / 1000D - 0.5D AS {prefix}{k}" for k in range(rank)]


def start_entries(init: str, rank: int, seed: int, key: str = "row_id", prefix: str = "f") -> list[str]:
    if init == "gaussian":
        return gaussian_start(rank, seed, key, prefix)
    if init == "integer":
        return integer_start(rank, key, prefix, seed)
    raise ValueError(f"unknown start {init}")


def orthonormal_start(ids: DataFrame, key: str, rank: int, init: str = "gaussian", seed: int = 0) -> Factor:
    """An orthonormal basis of the start entries, for the given ids."""
    raw = Factor(ids.selectExpr(key, *start_entries(init, rank, seed, key)), key, "f", np.eye(rank))
    return raw.times(thin_svd(raw, table_gram(raw.table, columns("f", rank)))[2])


def conformance(cells: DataFrame, row_factors: DataFrame, col_factors: DataFrame) -> DataFrame:
    """One row: vector widths on both sides and the number of ids that lack a vector."""
    def widths(table: DataFrame, name: str, side: str) -> DataFrame:
        return table.agg(F.min(F.size(name)).alias(f"min_{side}"), F.max(F.size(name)).alias(f"max_{side}"))

    def orphans(key: str, table: DataFrame, side: str) -> DataFrame:
        ids = cells.select(key).distinct()
        return ids.join(table.select(key), key, "left_anti").agg(F.count("*").alias(f"missing_{side}"))

    parts = [widths(row_factors, "u", "u"), widths(col_factors, "v", "v"),
             orphans("row_id", row_factors, "rows"), orphans("col_id", col_factors, "cols")]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    return out.drop("one").withColumn("conforms", F.expr(
        "min_u = max_u AND min_v = max_v AND min_u = min_v AND missing_rows = 0 AND missing_cols = 0"))


def check_conformance(cells: DataFrame, row_factors: DataFrame, col_factors: DataFrame) -> None:
    found = conformance(cells, row_factors, col_factors).first()
    if found["missing_rows"]:
        raise ValueError(f"{found['missing_rows']} rows of the matrix have no row factor")
    if found["missing_cols"]:
        raise ValueError(f"{found['missing_cols']} columns of the matrix have no column factor")
    if not found["conforms"]:
        raise ValueError("row and column factors differ in width")
