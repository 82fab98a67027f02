"""Products of a sparse matrix, or a sparse-plus-low-rank one, with tall thin matrices.

Every product is an equi-join of the cells with per-key vectors and a grouped sum. Nothing is
densified, and the partial sums of a group are formed before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lacuna.functions.vectors import columns, combine, dot, number, pack, unpack
from lacuna.operators.factors import cross_gram, packed, unpacked
from lacuna.operators.layout import OTHER, Attach, plain_attach
from lacuna.session import Scratch, read


def grouped_sums(cells: DataFrame, group: str, value: str, names: list[str]) -> DataFrame:
    """``s0, s1, ...``: per group the sums of ``value`` times each named column."""
    return cells.selectExpr(group, f"{value} AS r", *names).groupBy(group).agg(
        *[F.expr(f"sum(r * {m}) AS s{k}") for k, m in enumerate(names)])


def residual_sums(cells: DataFrame, group: str, rank: int, other: DataFrame, own: DataFrame | None,
                  attach: Attach = plain_attach, multiply: str = "p") -> DataFrame:
    """Per group key: sum over its cells of (value - p.q) times a vector of the other side.

    ``other`` holds ``p`` columns (and the columns to multiply by, if they differ), ``own`` the
    ``q`` columns of the grouped side; without ``own`` the value itself is multiplied.
    """
    joined = attach(cells, other, OTHER[group])
    value = "value"
    if own is not None:
        joined = attach(joined, own, group)
        value = f"value - ({dot(columns('p', rank), columns('q', rank))})"
    return grouped_sums(joined, group, value, columns(multiply, rank))


def block_residuals(blocks: Sequence[int], filled: bool, centered: bool) -> list[str]:
    """For each block the value less its centers and, if ``filled``, less its low-rank value p.q."""
    value = "value - other_center - own_center" if centered else "value"
    return [f"{value} - ({dot(columns(f'p{g}_', rank), columns(f'q{g}_', rank))})" if filled else value
            for g, rank in enumerate(blocks)]


def block_sums(cells: DataFrame, group: str, blocks: Sequence[int], other: DataFrame, own: DataFrame | None,
               filled: bool, centered: bool, attach: Attach = plain_attach, multiply: str = "p") -> DataFrame:
    """``residual_sums`` of several fits at once: ``s<g>_<k>`` per group key, from one pass over the cells.

    ``blocks`` are the ranks of the fits. ``other`` holds the vectors ``p<g>_<k>`` (and those to multiply by, if they
    differ), ``own`` the vectors ``q<g>_<k>`` of the grouped side if the fits are ``filled``; with ``centered`` they
    hold ``other_center`` and ``own_center`` too, two more fixed components of every vector.
    """
    joined = attach(cells, other, OTHER[group])
    if own is not None:
        joined = attach(joined, own, group)
    values = block_residuals(blocks, filled, centered)
    names = [columns(f"{multiply}{g}_", rank) for g, rank in enumerate(blocks)]
    shared = len(set(values)) == 1
    used = values[:1] if shared else values
    inner = joined.selectExpr(group, *[f"{v} AS r{g}" for g, v in enumerate(used)], *[c for n in names for c in n])
    return inner.groupBy(group).agg(*[F.expr(f"sum(r{0 if shared else g} * {m}) AS s{g}_{k}")
                                      for g, n in enumerate(names) for k, m in enumerate(n)])


def packed_steps(cells: DataFrame, group: str, blocks: Sequence[int], other: DataFrame, own: DataFrame | None,
                 filled: bool, centered: bool) -> DataFrame:
    """``f``, the sums of ``block_sums`` with vectors p that are multiplied by and ``own``'s q added, ``q`` and ``center`` per id.

    For many columns: a vector is one binary value, and the sums are NumPy sums per Arrow batch. ``cells`` are placed by the
    group, those of an id side by side, and both tables are broadcast; q meets the first cell of an id only.
    """
    joined = cells.join(F.broadcast(other), OTHER[group])
    wanted = ["opens", "value", "p", *(["other_center"] if centered else [])]
    if own is not None:
        joined = joined.join(F.broadcast(own.withColumnRenamed(group, "opens")), "opens", "left")
        wanted += [*(["q"] if filled else []), *(["own_center"] if centered else [])]
    names = [group, "f", *(["q"] if filled else []), *(["center"] if centered else [])]
    cuts = np.cumsum([0, *blocks])

    def run(batches):
        # The last id of a batch goes on in the next one: its name, q, center and sums so far.
        name, q, center, total = np.zeros(0, np.int64), np.zeros((0, cuts[-1])), np.zeros(0), np.zeros((0, cuts[-1]))

        def done(stop: int | None) -> pa.RecordBatch:
            out = [pa.array(name[:stop]), packed((total + q)[:stop] if filled else total[:stop])]
            out += [packed(q[:stop])] if filled else []
            return pa.RecordBatch.from_arrays(out + ([pa.array(center[:stop])] if centered else []), names)

        for batch in batches:
            if not batch.num_rows:
                continue
            get = {n: batch.column(n) for n in wanted}
            p, value = unpacked(get["p"]), get["value"].to_numpy()
            first = np.flatnonzero(get["opens"].is_valid().to_numpy(zero_copy_only=False))
            going = len(first) == 0 or first[0] > 0
            heads = np.r_[np.zeros(int(going), np.int64), first]
            name = np.r_[name, get["opens"].drop_null().to_numpy()]
            if filled and len(first):
                q = np.concatenate([q, unpacked(get["q"])])
            if centered:
                center = np.r_[center, get["own_center"].to_numpy(zero_copy_only=False)[first]]
            row = np.repeat(np.arange(len(name) - len(heads), len(name)), np.diff(np.r_[heads, len(value)]))
            if centered:
                value = value - get["other_center"].to_numpy() - center[row]
            parts = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                own_p = p[:, x:y]
                rest = value - np.einsum("ij,ij->i", own_p, q[row, x:y]) if filled else value
                parts.append(own_p * rest[:, None])
            sums = np.add.reduceat(parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1), heads, axis=0)
            if going:
                total[-1] += sums[0]
            total = np.concatenate([total, sums[int(going):]])
            if len(name) > 1:
                yield done(-1)
                name, q, center, total = name[-1:], q[-1:], center[-1:], total[-1:].copy()
        if len(name):
            yield done(None)

    types = f"{group} bigint, f binary" + ", q binary" * filled + ", center double" * centered
    return joined.select(*wanted).mapInArrow(run, types)


def block_gram_sums(cells: DataFrame, group: str, blocks: Sequence[int], other: DataFrame, own: DataFrame,
                    centered: bool, attach: Attach = plain_attach) -> DataFrame:
    """The same sums of filled fits from ``sum value * p`` and ``sum p p^T`` per group, with one join of the cells.

    Because q and the own center are constant in a group, the cells need not meet them: they are applied after grouping.
    """
    joined = attach(cells, other, OTHER[group])
    value = "value - other_center" if centered else "value"
    entries, out = [], []
    for g, rank in enumerate(blocks):
        p, q = columns(f"p{g}_", rank), columns(f"q{g}_", rank)
        entries += [F.expr(f"sum(({value}) * {p[k]}) AS c{g}_{k}") for k in range(rank)]
        entries += [F.expr(f"sum({p[k]}) AS t{g}_{k}") for k in range(rank) if centered]
        entries += [F.expr(f"sum({p[i]} * {p[j]}) AS g{g}_{i}_{j}") for i in range(rank) for j in range(i, rank)]
        for k in range(rank):
            held = " + ".join(f"g{g}_{min(k, l)}_{max(k, l)} * {q[l]}" for l in range(rank))
            out.append(f"c{g}_{k} - ({held})" + (f" - own_center * t{g}_{k}" if centered else "") + f" AS s{g}_{k}")
    return joined.groupBy(group).agg(*entries).join(own, group).selectExpr(group, *out)


def fitted_cells(cells: DataFrame, row_factors: DataFrame, col_factors: DataFrame, rank: int,
                 d: list[float] | None = None, attach: Attach = plain_attach) -> DataFrame:
    """Low-rank value ``xhat`` at every observed cell (sampled dense-dense product).

    ``attach`` may be a layout's, for its placed cells.
    """
    weights = [""] * rank if d is None else [f" * {number(w)}" for w in d]
    left = row_factors.selectExpr("row_id", *[f"u[{k}]{w} AS _u{k}" for k, w in enumerate(weights)])
    right = col_factors.selectExpr("col_id", *unpack("v", "_v", rank))
    u, v = columns("_u", rank), columns("_v", rank)
    # A row or column without a vector counts as a zero vector; its cells stay.
    joined = attach(attach(cells, left, "row_id", "left"), right, "col_id", "left")
    return joined.withColumn("xhat", F.expr(f"coalesce({dot(u, v)}, 0D)")).drop(*u, *v)


def _checked(cells: DataFrame, other: DataFrame, name: str, key: str, rank: int) -> DataFrame:
    """Cells with the vector of their ``key`` as ``p0, p1, ...``; one without a vector of that width fails the job."""
    refused = f"raise_error(concat('no vector of width {rank} for {key} ', {key}))"
    vector = f"CASE WHEN size(_vector) = {rank} THEN _vector ELSE {refused} END"
    joined = plain_attach(cells, other.selectExpr(key, f"{name} AS _vector"), key, "left")
    return joined.withColumn("_vector", F.expr(vector)).selectExpr("*", *unpack("_vector", "p", rank))


def counted_product(cells: DataFrame, group: str, other: DataFrame, name: str, rank: int, scratch: Scratch,
                    attach: Attach = plain_attach, out: str = "product") -> tuple[DataFrame, dict]:
    """``sum value * vector`` per group, written, and how many cells had a vector or not, counted in the same job.

    For callers that go on without the cells whose key has no vector and want to know what is missing; ``attach`` may be a
    layout's, so that placed and salted cells stay where they are.
    """
    key, p = OTHER[group], columns("p", rank)
    joined = attach(cells, other.selectExpr(key, *unpack(name, "p", rank)), key, "left")
    seen, wanted = Observation(), [F.expr(f"count_if({p[0]} IS NULL)").alias("unmatched"), F.count("*").alias("cells")]
    sums = grouped_sums(joined.observe(seen, *wanted).where(f"{p[0]} IS NOT NULL"), group, "value", p)
    table = scratch.write(sums.selectExpr(group, pack(columns("s", rank), out)), f"product_{group}")
    return table, read(seen, joined, wanted)


def _sparse_plus_low_rank(cells: DataFrame, group: str, low: DataFrame | None, low_name: str,
                          small: np.ndarray | None, other: DataFrame, other_name: str, out: str,
                          rank: int) -> DataFrame:
    sparse = grouped_sums(_checked(cells, other, other_name, OTHER[group], rank), group, "value", columns("p", rank))
    names = columns("s", rank)
    if low is None:
        return sparse.selectExpr(group, pack(names, out))
    a = columns("a", rank)
    dense = low.selectExpr(group, *unpack(low_name, "a", rank))
    sums = [f"coalesce(s{k}, 0D) + coalesce({combine(a, small[:, k])}, 0D)" for k in range(rank)]
    return sparse.join(dense, group, "full_outer").selectExpr(group, pack(sums, out))


def right_multiply(cells: DataFrame, other: DataFrame, rank: int, a: DataFrame | None = None,
                   b: DataFrame | None = None) -> DataFrame:
    """``(x + a b^T) V`` per row: the sparse product plus ``a (b^T V)``.

    ``other`` is ``(col_id, v)``, ``a`` is ``(row_id, a)``, ``b`` is ``(col_id, b)``; only the
    rank-by-rank matrix ``b^T V`` reaches the driver. A cell whose column has no vector, or one of another width, is an
    error of the job that computes the product.
    """
    small = None if a is None else cross_gram(b, other, "col_id", "b", "v", rank)
    return _sparse_plus_low_rank(cells, "row_id", a, "a", small, other, "v", "product", rank)


def left_multiply(cells: DataFrame, other: DataFrame, rank: int, a: DataFrame | None = None,
                  b: DataFrame | None = None) -> DataFrame:
    """``(U^T (x + a b^T))^T`` per column: the sparse product plus ``b (a^T U)``."""
    small = None if a is None else cross_gram(a, other, "row_id", "a", "u", rank)
    return _sparse_plus_low_rank(cells, "col_id", b, "b", small, other, "u", "product", rank)
