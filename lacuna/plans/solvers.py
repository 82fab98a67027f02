"""The two alternating methods for nuclear-norm regularized completion.

Each half step is one job: join the cells with the vectors of one side, sum per id of the other
side, add the low-rank part, write the new vectors, and collect the rank-by-rank products needed
for the SVD and the convergence test while writing. The driver only sees rank-by-rank matrices, unless the fit goes by blocks: then the
vectors of one side pass through it as a dense matrix of limited size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.vectors import columns, cross_matrix, cross_sql, gram_matrix, gram_sql
from lacuna.operators.factors import (
    Factor, pack_vectors, packed_products, relative_change, select_vectors, shrink_weights, soft_threshold, start_entries,
    table_products, thin_svd, unrolled,
)
from lacuna.operators import blocks as B
from lacuna.operators.layout import OTHER, Layout
from lacuna.operators.products import block_gram_sums, block_residuals, block_sums, packed_steps

# Fixed value: the default penalty is the first start singular value, which is 1, over 50.
DEFAULT_SHRINKAGE_DIVISOR = 50.0
#: From so many columns on, the vectors of a half step are packed: twice as many pass the 100 for which Spark generates code.
PACKED_COLUMNS = 48


@dataclass
class Settings:
    rank: int
    shrinkage: float | None = None
    threshold: float = 1e-5
    max_iters: int = 100
    max_inner_iters: int = 100
    init: str = "gaussian"
    seed: int = 0
    criterion: str = "trace"
    form: str = "auto"


@dataclass
class Solution:
    u: Factor
    d: np.ndarray
    v: Factor
    shrinkage: float
    changes: list[float] = field(default_factory=list)

    @property
    def effective_rank(self) -> int:
        return min(int((self.d > 0).sum()), len(self.d))


@dataclass
class LowRank:
    """``other @ diag(d) @ own^T``, seen from a step that groups by the ``own`` side.

    ``small`` is ``other^T m`` for the vectors m that the step multiplies by; None stands for the
    identity, when m is ``other`` itself.
    """

    other: Factor
    d: np.ndarray
    own: Factor
    small: np.ndarray | None = None


@dataclass
class Step:
    """Raw result of a half step: new vectors before orthonormalization, and their products."""

    raw: Factor
    old: Factor | None
    gram: np.ndarray
    with_previous: np.ndarray
    with_old: np.ndarray


def prefers_gram_form(layout: Layout, group: str, rank: int, sides_fit: bool) -> bool:
    """Whether to shuffle per-group Gram sums instead of the cells with their vectors.

    Only a choice when neither side can be broadcast. A task emits at most one partial row per
    group id, so the Gram sums win when groups hold many cells per task.
    """
    if sides_fit:
        return False
    partial_rows = min(layout.nnz, layout.partitions * layout.ids[group])
    return partial_rows * (1 + rank + rank * (rank + 1) // 2) < layout.nnz * (3 + rank)


@dataclass
class Job:
    """What one fit asks of a half step: the vectors to multiply by, its low-rank part, and those to compare with."""

    multiply: Factor
    low: LowRank | None
    previous: Factor | None
    weights: np.ndarray


def half_step(layout: Layout, name: str, group: str, rank: int, multiply: Factor, low: LowRank | None,
              previous: Factor | None, weights: np.ndarray, form: str = "auto") -> Step:
    """``half_steps`` for one fit."""
    return half_steps(layout, name, group, [Job(multiply, low, previous, weights)], form)[0]


def half_steps(layout: Layout, name: str, group: str, jobs: list[Job], form: str = "auto") -> list[Step]:
    """``(residual^T m + low-rank part) * weights`` for every id of the grouped side, for several fits at once.

    The fits' vectors lie side by side in one table per side, so however many there are, the cells are passed over
    once. All fits have a low-rank part or none has. ``previous`` are the vectors to compare the new ones with; with
    ``low.small`` left out they are ``low.own``. If the layout has centers, the tables carry one per id, and
    residuals are those of the centered cells.
    """
    other_side, centered = OTHER[group], bool(layout.centers)
    keep = ["center"] if centered else []
    blocks = [len(j.weights) for j in jobs]
    filled = jobs[0].low is not None
    same = filled and all(j.multiply is j.low.other for j in jobs)
    if form == "auto" and _blocked(layout, jobs):
        return _block_steps(layout, name, group, jobs)
    if form != "gram" and _packs(layout, group, jobs):
        return _packed_steps(layout, name, group, jobs)
    wanted = {}
    for g, j in enumerate(jobs):
        if filled and not same:
            wanted[f"m{g}_"] = j.multiply
        wanted[f"p{g}_"] = j.low.other if filled else j.multiply
    other, own = select_vectors(wanted, keep), None
    if filled:
        own = select_vectors({f"q{g}_": j.low.own.times(np.diag(j.low.d)) for g, j in enumerate(jobs)}, keep)
    elif centered:
        own = layout.centers[group].select(group, "center")
    if centered:
        other, own = other.withColumnRenamed("center", "other_center"), own.withColumnRenamed("center", "own_center")

    sides_fit = layout.fits(other, other_side) or own is None or layout.fits(own, group)
    cells = layout.cells_for(group, other)
    if form == "gram" and filled and not same:
        raise ValueError("the Gram form needs the multiplying vectors to be the low-rank ones")
    if same and (form == "gram" or (form == "auto" and prefers_gram_form(layout, group, sum(blocks), sides_fit))):
        sums = block_gram_sums(cells, group, blocks, other, own, centered, layout.attach)
    else:
        sums = block_sums(cells, group, blocks, other, own, filled, centered, layout.attach,
                          "m" if filled and not same else "p")

    # The per-iteration numbers stay out of this stage: they enter through the small side tables
    # above, and the weights are applied to the rank-by-rank results. Its generated code is then
    # the same in every iteration and stays compiled.
    alone = filled and jobs[0].low.small is None
    dense, old, last = "q" if alone else "t", [], []
    if alone:
        sums, last = layout.attach_grouped(sums, own, group), [f"q{g}_" for g in range(len(jobs))]
        sums = sums.withColumnRenamed("own_center", "center")
    elif filled:
        held = {}
        for g, j in enumerate(jobs):
            held |= {f"t{g}_": j.low.own.times(j.low.d[:, None] * j.low.small), f"o{g}_": j.low.own, f"v{g}_": j.previous}
            old.append(f"o{g}_")
            last.append(f"v{g}_")
        sums = layout.attach_grouped(sums, select_vectors(held, keep), group)
    elif jobs[0].previous is not None:
        last = [f"v{g}_" for g in range(len(jobs))]
        sums = layout.attach_grouped(sums, select_vectors({x: j.previous for x, j in zip(last, jobs)}, keep), group)
    elif centered:
        sums = layout.attach_grouped(sums, layout.centers[group].select(group, "center"), group)
    names = [columns(f"f{g}_", rank) for g, rank in enumerate(blocks)]
    fresh = [f"s{g}_{k} + {dense}{g}_{k} AS {c}" if filled else f"s{g}_{k} AS {c}"
             for g, n in enumerate(names) for k, c in enumerate(n)]
    others = [{w: columns(prefix[g], rank) for w, prefix in (("old", old), ("previous", last)) if prefix}
              for g, rank in enumerate(blocks)]
    kept = [c for o in others for c in o.get("old", [])]
    used = list(dict.fromkeys(c for o in others for cols in o.values() for c in cols))
    table, products = _write_products(layout, sums.selectExpr(group, *fresh, *used, *keep), name,
                                      [group, *[c for n in names for c in n], *kept, *keep], names, others)

    steps = []
    for g, (j, rank, (gram, crosses)) in enumerate(zip(jobs, blocks, products)):
        found = {which: j.weights[:, None] * crosses.get(which, np.zeros((rank, rank))) for which in ("previous", "old")}
        if alone:
            found["previous"] = np.divide(found["previous"], j.low.d, out=np.zeros_like(found["previous"]),
                                          where=np.broadcast_to(j.low.d > 0, (rank, rank)))
        steps.append(Step(
            raw=Factor(table, group, f"f{g}_", np.diag(j.weights)),
            old=Factor(table, group, f"o{g}_", np.eye(rank)) if old else None,
            gram=j.weights[:, None] * gram * j.weights, with_previous=found["previous"], with_old=found["old"]))
    return steps


def _plain(jobs: list[Job]) -> bool:
    """Whether the low-rank vectors of all jobs are those multiplied by and compared with."""
    return all(j.previous is None if j.low is None else j.multiply is j.low.other and j.low.small is None for j in jobs)


def _blocked(layout: Layout, jobs: list[Job]) -> bool:
    return _plain(jobs) and layout.by_blocks(sum(len(j.weights) for j in jobs)) and bool(layout.centers) == bool(layout.blocks.centers)


def _side(blocks: B.Blocks, factors: list[Factor], cuts: list[int]) -> tuple[DataFrame | None, np.ndarray]:
    """The table of blocks that holds the factors and the matrix that turns it, or None and the vectors themselves."""
    first = factors[0]
    if first.blocks is None:
        return None, blocks.dense_rows(pack_vectors(factors, "p"), first.key, cuts[-1])
    matrix = np.zeros((first.packed[1], cuts[-1]))
    for f, x, y in zip(factors, cuts[:-1], cuts[1:]):
        matrix[f.packed[0]:f.packed[0] + y - x, x:y] = f.matrix
    return first.blocks, matrix


def _sides(blocks: B.Blocks, others: list[Factor], owns: list[Factor] | None, cuts: list[int]) -> tuple:
    """What ``blocks.steps`` asks for: vectors of the other side by position, and those of the own side."""
    table, p = _side(blocks, others, cuts)
    if table is not None:
        p = B.turned(blocks.dense(table, others[0].key, others[0].packed[1]), p)
    if owns is None:
        return p, None, None, None
    own, matrix = _side(blocks, owns, cuts)
    return (p, own, None, matrix) if own is not None else (p, None, blocks.send(matrix), None)


def _block_steps(layout: Layout, name: str, group: str, jobs: list[Job]) -> list[Step]:
    """``half_steps`` over blocks of cells."""
    blocks, filled = layout.blocks, jobs[0].low is not None
    cuts = np.cumsum([0, *[len(j.weights) for j in jobs]]).tolist()
    blocks.by(group)
    p, own, q, turn = _sides(blocks, [j.low.other if filled else j.multiply for j in jobs],
                             [j.low.own.times(np.diag(j.low.d)) for j in jobs] if filled else None, cuts)
    found, sent = B.steps(blocks, group, cuts, p, own, q, turn)
    del p
    table = layout.scratch.write(found, name)
    for b in (sent, q):
        if b is not None:
            b.destroy()
    products = blocks.learn(table, group, cuts[-1]).reshape(cuts[-1], -1)
    rows, out = blocks.rows(table, group), []
    for j, x, y in zip(jobs, cuts[:-1], cuts[1:]):
        rank = y - x
        previous = np.zeros((rank, rank))
        if filled:
            np.divide(j.weights[:, None] * products[x:y, cuts[-1] + x:cuts[-1] + y], j.low.d, out=previous,
                      where=np.broadcast_to(j.low.d > 0, (rank, rank)))
        out.append(Step(
            raw=Factor(rows, group, "f", np.diag(j.weights), (x, cuts[-1]), table), old=None,
            gram=j.weights[:, None] * products[x:y, x:y] * j.weights, with_previous=previous, with_old=np.zeros((rank, rank))))
    return out


def _packs(layout: Layout, group: str, jobs: list[Job]) -> bool:
    """Whether the vectors go as packed ones: many columns, both sides broadcast, no hot id, low-rank vectors those multiplied by."""
    columns_ = sum(len(j.weights) for j in jobs)
    return columns_ >= PACKED_COLUMNS and _plain(jobs) and group not in layout.hot and all(
        layout.ids[key] * (8 * columns_ + 72) <= layout.broadcast_bytes for key in OTHER)


def _packed_steps(layout: Layout, name: str, group: str, jobs: list[Job]) -> list[Step]:
    """``half_steps`` with the vectors of all fits as one binary value per id."""
    centered, filled = bool(layout.centers), jobs[0].low is not None
    keep, blocks = ["center"] if centered else [], [len(j.weights) for j in jobs]
    other = pack_vectors([j.low.other if filled else j.multiply for j in jobs], "p", keep)
    own = None
    if filled:
        own = pack_vectors([j.low.own.times(np.diag(j.low.d)) for j in jobs], "q", keep)
    elif centered:
        own = layout.centers[group].select(group, "center")
    if centered:
        other, own = other.withColumnRenamed("center", "other_center"), own.withColumnRenamed("center", "own_center")
    table = layout.scratch.write(
        packed_steps(layout.placed_by(group), group, blocks, other, own, filled, centered), name)
    cuts = np.cumsum([0, *blocks]).tolist()
    places = [list(range(x, y)) for x, y in zip(cuts[:-1], cuts[1:])]
    found = packed_products(table, ["f", "q"] if filled else ["f"], [
        (p, p + [cuts[-1] + k for k in p] * filled) for p in places])
    steps = []
    for j, rank, place, flat in zip(jobs, blocks, places, found):
        previous = j.weights[:, None] * flat[:, rank:] if filled else np.zeros((rank, rank))
        if filled:
            previous = np.divide(previous, j.low.d, out=np.zeros_like(previous), where=np.broadcast_to(j.low.d > 0, (rank, rank)))
        steps.append(Step(
            raw=Factor(table.select(group, "f", *keep), group, "f", np.diag(j.weights), (place[0], cuts[-1])), old=None,
            gram=j.weights[:, None] * flat[:, :rank] * j.weights, with_previous=previous, with_old=np.zeros((rank, rank))))
    return steps


def _write_products(layout: Layout, df: DataFrame, name: str, keep: list[str], vectors: list[list[str]],
                    others: list[dict[str, list[str]]]) -> tuple[DataFrame, list[tuple[np.ndarray, dict[str, np.ndarray]]]]:
    """Write new vectors; for each fit their Gram matrix and their products with other columns.

    At low rank these are aggregates of the writing job. Beyond, there would be too many of them,
    and they are taken from the written table.
    """
    ranks = [len(v) for v in vectors]
    if unrolled(ranks):
        wanted = {f"gram_{g}": gram_sql(v) for g, v in enumerate(vectors)}
        wanted |= {f"{which}_{g}": cross_sql(v, names) for g, v in enumerate(vectors) for which, names in others[g].items()}
        table, seen = layout.scratch.write_observed(df, name, keep, **wanted)
        return table, [(gram_matrix(seen[f"gram_{g}"], r),
                        {which: cross_matrix(seen[f"{which}_{g}"], r, r) for which in others[g]})
                       for g, r in enumerate(ranks)]
    table = layout.scratch.write(df, name)
    pairs = [(v, v + [c for names in o.values() for c in names]) for v, o in zip(vectors, others)]
    out = []
    for flat, o in zip(table_products(table, pairs), others):
        parts = np.split(flat, 1 + len(o), axis=1)
        out.append((parts[0], dict(zip(o, parts[1:]))))
    return table.select(*keep), out


def starts(layout: Layout, settings: list[Settings]) -> list[tuple[Factor, np.ndarray, float]]:
    """For each fit orthonormal row vectors, unit singular values and the shrinkage; one table, no column vectors."""
    ids = layout.centers["row_id"].select("row_id", "center") if layout.centers else layout.cells.select("row_id").distinct()
    names = [columns(f"f{g}_", s.rank) for g, s in enumerate(settings)]
    entries = ids.selectExpr("row_id", *[e for g, s in enumerate(settings)
                                         for e in start_entries(s.init, s.rank, s.seed, prefix=f"f{g}_")], *ids.columns[1:])
    table, products = _write_products(layout, entries, "start", entries.columns, names, [{} for _ in settings])
    out = []
    for g, (s, (gram, _)) in enumerate(zip(settings, products)):
        raw = Factor(table, "row_id", f"f{g}_", np.eye(s.rank))
        d = np.ones(s.rank)
        shrinkage = d[0] / DEFAULT_SHRINKAGE_DIVISOR if s.shrinkage is None else s.shrinkage
        out.append((raw.times(thin_svd(raw, gram)[2]), d, shrinkage))
    return out


def start(layout: Layout, settings: Settings) -> tuple[Factor, np.ndarray, float]:
    """``starts`` for one fit."""
    return starts(layout, [settings])[0]


def squared_errors(layout: Layout, solutions: list[Solution]) -> list[float]:
    """Sum of squared residuals of each fit over the placed cells: one pass, no shuffle of cells, one row to the driver."""
    keep = ["center"] if layout.centers else []
    # Fits that ended in different rounds have their vectors in different tables.
    tables: dict[int, list[int]] = {}
    for g, x in enumerate(solutions):
        tables.setdefault(id(x.u.table), []).append(g)
    out = [0.0] * len(solutions)
    for some in tables.values():
        chosen = [solutions[g] for g in some]
        if any(x.v.table is not chosen[0].v.table for x in chosen):
            for g in some:
                out[g] = _squared_errors(layout, [solutions[g]], keep)[0]
        else:
            for g, error in zip(some, _squared_errors(layout, chosen, keep)):
                out[g] = error
    return out


def _squared_errors(layout: Layout, solutions: list[Solution], keep: list[str]) -> list[float]:
    if layout.by_blocks(sum(len(x.d) for x in solutions)) and bool(keep) == bool(layout.blocks.centers):
        cuts = np.cumsum([0, *[len(x.d) for x in solutions]]).tolist()
        layout.blocks.by("row_id")
        return B.squares(layout.blocks, "row_id", cuts, *_sides(
            layout.blocks, [x.v for x in solutions], [x.u.times(np.diag(x.d)) for x in solutions], cuts))
    other = select_vectors({f"p{g}_": x.v for g, x in enumerate(solutions)}, keep)
    own = select_vectors({f"q{g}_": x.u.times(np.diag(x.d)) for g, x in enumerate(solutions)}, keep)
    if keep:
        other, own = other.withColumnRenamed("center", "other_center"), own.withColumnRenamed("center", "own_center")
    joined = layout.attach(layout.attach(layout.cells_for("row_id", other), other, "col_id"), own, "row_id")
    values = block_residuals([len(x.d) for x in solutions], True, bool(keep))
    return list(joined.agg(*[F.expr(f"sum(power({v}, 2)) AS e{g}") for g, v in enumerate(values)]).first())


class _Tables:
    """Names of the current row and column tables; a replaced table is dropped unless a finished fit still needs it."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.current = {"row_id": "start", "col_id": None}
        self.pinned: set[str] = set()
        self.count = 0

    def name(self, group: str) -> str:
        self.count += 1
        return f"{group}_{self.count}"

    def next(self, group: str) -> tuple[str, Callable[[], None]]:
        name, stale = self.name(group), self.current[group]
        self.current[group] = name
        return name, lambda: self.layout.scratch.drop(stale) if stale and stale not in self.pinned else None


@dataclass
class _Fit:
    settings: Settings
    u: Factor
    d: np.ndarray
    lam: float
    v: Factor | None = None
    changes: list[float] = field(default_factory=list)

    def solution(self) -> Solution:
        return Solution(self.u, self.d, self.v or self.u, self.lam, self.changes)


def solve_als(layout: Layout, settings: list[Settings]) -> list[Solution]:
    """Residuals are refreshed in every half step: one loop, for several fits side by side.

    A fit that has converged or used up its iterations leaves the batch; the others go on.
    """
    fits = [_Fit(s, *x) for s, x in zip(settings, starts(layout, settings))]
    tables, live = _Tables(layout), [f for f in fits if f.settings.max_iters > 0]

    def half(group: str, some: list[_Fit], weights: list[np.ndarray], apart: bool = False) -> list[Step]:
        name, drop_stale = (tables.name(group), lambda: None) if apart else tables.next(group)
        jobs = []
        for f, w in zip(some, weights):
            other, own = (f.u, f.v) if group == "col_id" else (f.v, f.u)
            jobs.append(Job(other, None if f.v is None else LowRank(other, f.d, own), own, w))
        steps = half_steps(layout, name, group, jobs, settings[0].form)
        drop_stale()
        layout.sweep()
        return steps

    while live:
        before = [f.d for f in live]
        turned, crosses = [], []
        for f, step in zip(live, half("col_id", live, [shrink_weights(f.d, f.lam) for f in live])):
            f.d, w, over = thin_svd(step.raw, step.gram)
            f.v, f.u = step.raw.times(over), f.u.times(w)
            turned.append(w)
            crosses.append(over.T @ step.with_previous)
        done = []
        steps = half("row_id", live, [shrink_weights(f.d, f.lam) for f in live])
        for f, step, w_col, cross_v, d_old in zip(live, steps, turned, crosses, before):
            f.d, w, over = thin_svd(step.raw, step.gram)
            cross_u = over.T @ step.with_previous @ w_col.T
            f.u, f.v = step.raw.times(over), f.v.times(w)
            f.changes.append(relative_change(d_old, f.d, cross_u, w.T @ cross_v, f.settings.criterion))
            if f.changes[-1] < f.settings.threshold or len(f.changes) == f.settings.max_iters:
                done.append(f)
        live = [f for f in live if f not in done]
        if done:
            tables.pinned |= {tables.current["col_id"], tables.current["row_id"]}
        last = [f for f in done if f.lam > 0]
        if last:
            for f, step in zip(last, half("row_id", last, [np.ones(len(f.d)) for f in last], apart=True)):
                f.d, w, over = thin_svd(step.raw, step.gram)
                f.u, f.v = step.raw.times(over), f.v.times(w)
                f.d = soft_threshold(f.d, f.lam)
    return [f.solution() for f in fits]


def solve_nested(layout: Layout, settings: Settings) -> Solution:
    """An outer loop fills in with the last solution, an inner loop solves for the filled matrix."""
    rank, eye = settings.rank, np.eye(settings.rank)
    u, d, lam = start(layout, settings)
    v: Factor | None = None
    tables = _Tables(layout)
    solution = Solution(u, d, u, lam)

    def half(group: str, multiply: Factor, low: LowRank | None, previous: Factor | None,
             weights: np.ndarray) -> Step:
        name, drop_stale = tables.next(group)
        step = half_step(layout, name, group, rank, multiply, low, previous, weights, settings.form)
        drop_stale()
        layout.sweep()
        return step

    for _ in range(settings.max_iters):
        # The filled matrix is the residual of (fill_u, fill_d, fill_v) plus that low-rank part.
        fill_u, fill_d, fill_v = u, d, v
        filled = fill_v is not None
        fill_by_u, fill_by_v = eye, np.zeros((rank, rank))

        def rows_step(weights: np.ndarray) -> tuple[Step, np.ndarray, np.ndarray]:
            nonlocal u, v, d, fill_u, fill_by_u, fill_by_v
            low = LowRank(fill_v, fill_d, fill_u, fill_by_v) if filled else None
            step = half("row_id", v, low, u, weights)
            d, w, over = thin_svd(step.raw, step.gram)
            u, v = step.raw.times(over), v.times(w)
            if filled:
                fill_u, fill_by_u = step.old, step.with_old.T @ over
            fill_by_v = fill_by_v @ w
            return step, over, w

        for _ in range(settings.max_inner_iters):
            d_old = d
            low = LowRank(fill_u, fill_d, fill_v, fill_by_u) if filled else None
            step = half("col_id", u, low, v, shrink_weights(d, lam))
            d, _, over = thin_svd(step.raw, step.gram)
            cross_v = over.T @ step.with_previous
            v = step.raw.times(over)
            if filled:
                fill_v, fill_by_v = step.old, step.with_old.T @ over

            step, over, w = rows_step(shrink_weights(d, lam))
            cross_u, cross_v = over.T @ step.with_previous, w.T @ cross_v
            if relative_change(d_old, d, cross_u, cross_v, settings.criterion) < settings.threshold:
                break

        if lam > 0:
            rows_step(np.ones(rank))
            d = soft_threshold(d, lam)

        solution.changes.append(relative_change(fill_d, d, fill_by_u.T, fill_by_v.T, settings.criterion))
        if solution.changes[-1] < settings.threshold:
            break

    solution.u, solution.d, solution.v = u, d, v
    return solution
