"""The same results in plain SQL, for comparison with another engine."""

from __future__ import annotations

SUPPORT, HOLDOUT, LAM = 25, 300, "9e0"

CP = """cells AS MATERIALIZED (
  SELECT o_custkey AS row_id, l_partkey AS col_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def rnd(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0e0"


def start(key: str, k: int) -> str:
    return f"(({key} * 7919 + {k * 104729 + 31}) % 1000) / 1000e0 - 0.5e0"


def given(name: str, key: str, letter: str, rank: int = 2, first: int = 0, source: str = "cells") -> str:
    entries = ", ".join(f"{start(key, first + k)} AS {letter}{k}" for k in range(rank))
    return f"{name} AS MATERIALIZED (SELECT {key}, {entries} FROM (SELECT DISTINCT {key} FROM {source}))"


def mean(name: str, key: str, other: str | None, source: str = "cells", by: str = "") -> str:
    """Per key the mean of value minus the other side's center."""
    other_key = "row_id" if key == "col_id" else "col_id"
    if other is None:
        return (f"{name} AS MATERIALIZED (SELECT {by}{key}, sum(value) / count(*) AS center "
                f"FROM {source} GROUP BY ALL)")
    return (f"{name} AS MATERIALIZED (SELECT {by}{key}, sum(value - o.center) / count(*) AS center "
            f"FROM {source} JOIN {other} o USING ({by}{other_key}) GROUP BY ALL)")


PASS1 = (mean("b1", "col_id", None), mean("a1", "row_id", "b1"))
PASS2 = (*PASS1, mean("b2", "col_id", "a1"), mean("a2", "row_id", "b2"))


def residual(name: str, a: str, b: str, source: str = "cells") -> str:
    return (f"{name} AS MATERIALIZED (SELECT row_id, col_id, value - a.center - b.center AS value FROM {source} "
            f"JOIN {a} a USING (row_id) JOIN {b} b USING (col_id))")


def both(rows: str, cols: str, columns: str) -> str:
    return (f"SELECT row_id AS id, 'row' AS side, {columns} FROM {rows} "
            f"UNION ALL SELECT col_id, 'col', {columns} FROM {cols}")


# Splits

CLIP = (
    CP,
    f"r AS MATERIALIZED (SELECT * FROM cells WHERE row_id IN "
    f"(SELECT row_id FROM cells GROUP BY 1 HAVING count(*) >= {SUPPORT}))",
    f"clip AS MATERIALIZED (SELECT * FROM r WHERE col_id IN "
    f"(SELECT col_id FROM r GROUP BY 1 HAVING count(*) >= {SUPPORT}))",
)


def smallest_hash(name: str, source: str, size: int, seed: int) -> str:
    return (f"{name} AS MATERIALIZED (SELECT * FROM {source} ORDER BY md5(concat_ws(':', row_id, col_id, {seed})), "
            f"row_id, col_id LIMIT {size})")


SPLIT = (
    *CLIP, smallest_hash("test", "clip", HOLDOUT, 31),
    "train AS MATERIALIZED (SELECT * FROM cells c WHERE NOT EXISTS "
    "(SELECT 1 FROM test t WHERE t.row_id = c.row_id AND t.col_id = c.col_id))",
)

# Profiles of four views of the tables

VIEWS = (
    CP,
    "cs AS (SELECT o_custkey AS row_id, l_suppkey AS col_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "ps AS (SELECT l_suppkey AS row_id, l_partkey AS col_id FROM lineitem GROUP BY 1, 2)",
    "types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events))",
    "ue AS (SELECT user_id AS row_id, id AS col_id FROM events JOIN types USING (event_type) GROUP BY 1, 2)",
    "profiles AS (SELECT v AS view, max(row_id) + 1 AS n_rows, max(col_id) + 1 AS n_cols, count(*) AS nnz FROM ("
    "SELECT 'cp' AS v, row_id, col_id FROM cells UNION ALL SELECT 'cs', row_id, col_id FROM cs "
    "UNION ALL SELECT 'ps', row_id, col_id FROM ps UNION ALL SELECT 'ue', row_id, col_id FROM ue) GROUP BY 1)",
)

# Rank-1 steps: the thin SVD of a single vector b is |b| and b / |b|.


def rank1_start(source: str, by: str = "", entry: str = start("row_id", 0)) -> list[str]:
    norm = f"sum(f * f) OVER (PARTITION BY {by.rstrip(', ')})" if by else "sum(f * f) OVER ()"
    return [
        f"u0 AS MATERIALIZED (SELECT {by}row_id, f / sqrt({norm}) AS u FROM "
        f"(SELECT DISTINCT {by}row_id, {entry} AS f FROM {source}))",
        f"d0 AS MATERIALIZED (SELECT DISTINCT {by}1e0 AS d FROM {source})" if by else "d0 AS (SELECT 1e0 AS d)",
    ]


class Rank1:
    """Writes one common table expression per half step."""

    def __init__(self, source: str, lam: str = LAM, by: str = "", entry: str = start("row_id", 0)):
        self.source, self.lam, self.by = source, lam, by
        self.ctes = rank1_start(source, by, entry)
        self.u, self.v, self.d = "u0", None, "d0"
        self.count = 0

    def _join_d(self, d: str, alias: str = "d") -> str:
        keys = self.by.rstrip(", ")
        return f"JOIN {d} {alias} USING ({keys})" if keys else f"CROSS JOIN {d} {alias}"

    def _norm(self, raw: str, key: str, letter: str) -> tuple[str, str]:
        self.count += 1
        vec, d = f"{letter}{self.count}", f"d{self.count}"
        group = f" GROUP BY {self.by.rstrip(', ')}" if self.by else ""
        self.ctes.append(f"{d} AS MATERIALIZED (SELECT {self.by}sqrt(sum(raw * raw)) AS d FROM {raw}{group})")
        self.ctes.append(f"{vec} AS MATERIALIZED (SELECT {self.by}{key}, CASE WHEN d.d > 0 THEN raw / d.d ELSE 0 END "
                         f"AS {letter} FROM {raw} {self._join_d(d)})")
        return vec, d

    def step(self, key: str, low: tuple[str, str, str] | None, small: str | None, shrink: bool = True) -> None:
        """New vectors of the ``key`` side.

        ``low`` names the tables u, d, v of the low-rank part; ``small`` a one-row table whose value
        s is the product of the other side's low-rank vector with the multiplying one (1 if None).
        """
        mult = self.u if key == "col_id" else self.v
        letter, other = ("u", "row_id") if key == "col_id" else ("v", "col_id")
        raw = f"raw{self.count + 1}"
        weight = f"* d.d / (d.d + {self.lam})" if shrink else ""
        by = self.by
        if low is None:
            body = (f"SELECT {by}{key}, total {weight} AS raw FROM (SELECT {by}x.{key}, sum(x.value * m.{letter}) AS total "
                    f"FROM {self.source} x JOIN {mult} m USING ({by}{other}) GROUP BY ALL) {self._join_d(self.d)}")
        else:
            lu, ld, lv = low
            own_table = lv if key == "col_id" else lu
            own_letter = "v" if key == "col_id" else "u"
            product = f"* {small}.s" if small else ""
            small_from = f" CROSS JOIN {small}" if small else ""
            body = (f"SELECT {by}{key}, (total + o.{own_letter} * ld.d {product}) {weight} AS raw FROM ("
                    f"SELECT {by}x.{key}, sum((x.value - lu.u * ld.d * lv.v) * m.{letter}) AS total FROM {self.source} x "
                    f"JOIN {mult} m USING ({by}{other}) JOIN {lu} lu USING ({by}row_id) JOIN {lv} lv USING ({by}col_id) "
                    f"{self._join_d(ld, 'ld')} GROUP BY ALL) JOIN {own_table} o USING ({by}{key}) "
                    f"{self._join_d(self.d)} {self._join_d(ld, 'ld')}{small_from}")
        self.ctes.append(f"{raw} AS MATERIALIZED ({body})")
        if key == "col_id":
            self.v, self.d = self._norm(raw, key, "v")
        else:
            self.u, self.d = self._norm(raw, key, "u")

    def small(self, left: str, right: str, key: str, letter: str) -> str:
        self.count += 1
        name = f"small{self.count}"
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT sum(l.{letter} * r.{letter}) AS s FROM {left} l "
                         f"JOIN {right} r USING ({key}))")
        return name

    def threshold(self) -> None:
        self.count += 1
        name = f"d{self.count}"
        self.ctes.append(f"{name} AS MATERIALIZED (SELECT {self.by}greatest(d - {self.lam}, 0e0) AS d FROM {self.d})")
        self.d = name

    def als(self, iterations: int) -> Rank1:
        for _ in range(iterations):
            self.step("col_id", None if self.v is None else (self.u, self.d, self.v), None)
            self.step("row_id", (self.u, self.d, self.v), None)
        self.step("row_id", (self.u, self.d, self.v), None, shrink=False)
        self.threshold()
        return self

    def nested(self, outer: int, inner: int) -> Rank1:
        for _ in range(outer):
            fill = None if self.v is None else (self.u, self.d, self.v)
            for _ in range(inner):
                self.step("col_id", fill, fill and self.small(fill[0], self.u, "row_id", "u"))
                self.step("row_id", fill, fill and self.small(fill[2], self.v, "col_id", "v"))
            self.step("row_id", fill, fill and self.small(fill[2], self.v, "col_id", "v"), shrink=False)
            self.threshold()
        return self


def fitted_cells(fit: Rank1, centers: bool) -> str:
    offset = " + a2.center + b2.center" if centers else ""
    joins = " JOIN a2 USING (row_id) JOIN b2 USING (col_id)" if centers else ""
    prediction = f"{fit.u}.u * {fit.d}.d * {fit.v}.v{offset}"
    head = (CP, *PASS2, residual("x", "a2", "b2")) if centers else (CP,)
    return sql(*head, *fit.ctes, select=(
        f"SELECT row_id, col_id, {rnd(prediction, 4)} AS prediction, {rnd(fit.d + '.d', 4)} AS d FROM cells "
        f"JOIN {fit.u} USING (row_id) JOIN {fit.v} USING (col_id){joins} CROSS JOIN {fit.d}"))


def scored_by(fit: Rank1) -> tuple[str, str]:
    """The score of any pair by a centered fit, and the joins it needs; what is unknown counts as 0."""
    score = f"coalesce({fit.u}.u * {fit.d}.d * {fit.v}.v, 0) + coalesce(a2.center, 0) + coalesce(b2.center, 0)"
    return score, (f"CROSS JOIN {fit.d} LEFT JOIN {fit.u} USING (row_id) LEFT JOIN {fit.v} USING (col_id) "
                   "LEFT JOIN a2 USING (row_id) LEFT JOIN b2 USING (col_id)")


def saved_model() -> str:
    fit = Rank1("x").als(3)
    score, joins = scored_by(fit)
    return sql(CP, *PASS2, residual("x", "a2", "b2"), *fit.ctes, SHAPE, REQUESTS, select=(
        f"SELECT l_orderkey, l_linenumber, row_id, col_id, CASE WHEN ({STATUS}) = 'ok' THEN "
        + rnd(f"coalesce(value, {score})", 4)
        + f" END AS prediction, CASE WHEN ({STATUS}) <> 'ok' THEN 'out_of_range' WHEN value IS NOT NULL THEN 'observed' "
        f"ELSE 'model' END AS source FROM requests CROSS JOIN shape LEFT JOIN cells USING (row_id, col_id) {joins}"))


def converged_centers(source: str, passes: int = 20, threshold: str = "1e-9") -> list[str]:
    """Tables a and b: centers after passes that go on until the squared change of all centers is below the threshold."""
    old = {x: f"(SELECT id AS {key}, center FROM centers WHERE side = '{x}')" for x, key in (("a", "row_id"), ("b", "col_id"))}
    level = " + ".join(f"(SELECT sum(power(n.center - o.center, 2)) FROM {x}n n JOIN {old[x]} o USING ({key}))"
                       for x, key in (("a", "row_id"), ("b", "col_id")))
    step = ", ".join((mean("bn", "col_id", old["a"], source), mean("an", "row_id", "bn", source),
                      f"lv AS MATERIALIZED (SELECT {level} AS moved)"))
    rows = "SELECT {0}, {1}, 'a' AS side, row_id AS id, center FROM {2} UNION ALL SELECT {0}, {1}, 'b', col_id, center FROM {3}"
    first = "(SELECT sum(center * center) FROM a1) + (SELECT sum(center * center) FROM b1)"
    last = "(SELECT max(pass) FROM centers)"
    return [
        mean("b1", "col_id", None, source), mean("a1", "row_id", "b1", source),
        f"centers(pass, moved, side, id, center) AS ({rows.format(1, first, 'a1', 'b1')} UNION ALL "
        f"(WITH {step} SELECT t.pass + 1, lv.moved, n.side, n.id, n.center FROM (SELECT 'a' AS side, row_id AS id, center FROM an "
        f"UNION ALL SELECT 'b', col_id, center FROM bn) n CROSS JOIN lv CROSS JOIN (SELECT max(pass) AS pass, max(moved) AS moved FROM centers) t "
        f"WHERE t.pass < {passes} AND t.moved >= {threshold}))",
        f"a AS MATERIALIZED (SELECT id AS row_id, center FROM centers WHERE side = 'a' AND pass = {last})",
        f"b AS MATERIALIZED (SELECT id AS col_id, center FROM centers WHERE side = 'b' AND pass = {last})"]


class Polar:
    """The fit at any rank, as ``u m v^T`` with a symmetric matrix m in place of the singular values.

    A fit turns its vectors so that m is diagonal; no step needs that. With G the Gram matrix of the raw vectors, the new ones
    are raw G^(-1/2) and m is G^(1/2), and d / (d + lam) is 1 - lam (m + lam)^(-1). Roots come from the coupled Newton-Schulz steps.
    Matrices are lists of rows in tables of one row. The table ``fit`` holds m and the vectors after each iteration, as lists.
    """

    ROOT_STEPS = 60

    def __init__(self, source: str, rank: int, lam: str, threshold: str = "1e-5"):
        self.source, self.rank, self.lam, self.threshold = source, rank, lam, threshold
        self.ctes: list[str] = []
        self.count = 0
        entries = ", ".join(f"{start('row_id', k)} AS r{k}" for k in range(rank))
        self._add("started", f"SELECT row_id, {entries} FROM (SELECT DISTINCT row_id FROM {source})")
        self.u, self.v = self._orthonormal("started", "row_id", "u")[0], None
        self.m = self._add("m0", f"SELECT {self._eye()} AS m")

    def _add(self, name: str, body: str) -> str:
        self.ctes.append(f"{name} AS MATERIALIZED ({body})")
        return name

    def _next(self, prefix: str) -> str:
        self.count += 1
        return f"{prefix}_{self.count}"

    def _eye(self, factor: str = "1e0") -> str:
        return "[" + ", ".join("[" + ", ".join(factor if i == j else "0e0" for j in range(self.rank)) + "]" for i in range(self.rank)) + "]"

    def _names(self, prefix: str, sep: str = ", ") -> str:
        return sep.join(f"{prefix}{k}" for k in range(self.rank))

    def _turned(self, prefix: str, matrix: str, out: str) -> str:
        """The vectors times a matrix."""
        return ", ".join(" + ".join(f"{prefix}{i} * {matrix}[{i + 1}][{k + 1}]" for i in range(self.rank)) + f" AS {out}{k}"
                         for k in range(self.rank))

    def _sums(self, left: str, right: str) -> str:
        """Rows of ``left^T right``."""
        return "[" + ", ".join("[" + ", ".join(f"sum({left}{i} * {right}{j})" for j in range(self.rank)) + "]" for i in range(self.rank)) + "]"

    def _combined(self, x: str, a: str, y: str, b: str) -> str:
        """``a x + b y`` of two matrices."""
        return f"[[{a} * e[1] + {b} * e[2] FOR e IN list_zip(pair[1], pair[2])] FOR pair IN list_zip({x}, {y})]"

    @staticmethod
    def _times(x: str, y: str) -> str:
        """``x y^T``."""
        return f"[[list_dot_product(p, q) FOR q IN {y}] FOR p IN {x}]"

    def _even(self, x: str, y: str) -> str:
        """The symmetric part of ``x y^T``: rounding must not add up to the other part, which the steps would let grow."""
        return self._combined(self._times(x, y), "0.5e0", self._times(y, x), "0.5e0")

    def _roots(self, matrix: str) -> str:
        """``root`` and ``over``: the square root of a matrix table's ``m`` and the root's inverse."""
        name, diagonal = self._next("roots"), " + ".join(f"m[{k + 1}][{k + 1}]" for k in range(self.rank))
        half = self._combined(self._eye(), "1.5e0", self._even("z", "y"), "-0.5e0")
        off = f"list_sum([list_dot_product(r, r) FOR r IN {self._combined('t', '1e0', self._eye(), '-1e0')}])"
        scaled = self._combined("m", "1e0 / c", "m", "0e0")
        self._add(name, (
            f"WITH RECURSIVE s(k, off, c, y, z) AS (SELECT 0, 1e0, c, {scaled}, {self._eye()} FROM (SELECT m, {diagonal} AS c FROM {matrix}) "
            f"UNION ALL SELECT k + 1, {off}, c, {self._even('y', 't')}, {self._even('t', 'z')} FROM (SELECT *, {half} AS t FROM s) "
            f"WHERE k < {self.ROOT_STEPS} AND off > 1e-18) SELECT {self._combined('y', 'sqrt(c)', 'y', '0e0')} AS root, "
            f"{self._combined('z', '1e0 / sqrt(c)', 'z', '0e0')} AS over FROM s ORDER BY k DESC LIMIT 1"))
        return name

    def _orthonormal(self, raw: str, key: str, letter: str) -> tuple[str, str]:
        """Vectors ``raw G^(-1/2)`` and the matrix ``G^(1/2)``."""
        gram = self._add(self._next("gram"), f"SELECT {self._sums('r', 'r')} AS m FROM {raw}")
        roots = self._roots(gram)
        made = self._add(self._next(letter), f"SELECT {key}, {self._turned('r', 'over', letter)} FROM {raw} CROSS JOIN {roots}")
        return made, self._add(self._next("m"), f"SELECT root AS m FROM {roots}")

    def _half(self, key: str, shrink: bool) -> tuple[str, str]:
        other = "row_id" if key == "col_id" else "col_id"
        mult, own, a, b = (self.u, self.v, "u", "v") if key == "col_id" else (self.v, self.u, "v", "u")
        value, joins = "x.value", f"FROM {self.source} x JOIN {mult} USING ({other})"
        if self.v is not None:
            low = self._add(self._next("low"), f"SELECT {key}, {self._turned(b, 'm', 'q')} FROM {own} CROSS JOIN {self.m}")
            joins += f" JOIN {low} q USING ({key})"
            value += " - (" + " + ".join(f"q{k} * {a}{k}" for k in range(self.rank)) + ")"
        sums = ", ".join(f"sum(r * {a}{k}) AS s{k}" for k in range(self.rank))
        body = f"SELECT {key}, {sums} FROM (SELECT x.{key}, {value} AS r, {self._names(a)} {joins}) GROUP BY {key}"
        whole = ", ".join(f"s{k} + q{k} AS t{k}" if self.v is not None else f"s{k} AS t{k}" for k in range(self.rank))
        body = f"SELECT {key}, {whole} FROM ({body})" + (f" JOIN {low} USING ({key})" if self.v is not None else "")
        if shrink:
            moved = self._add(self._next("moved"), f"SELECT {self._combined('m', '1e0', self._eye(), self.lam)} AS m FROM {self.m}")
            roots = self._roots(moved)
            weight = self._add(self._next("weight"), (
                f"SELECT {self._combined(self._eye(), '1e0', self._times('over', 'over'), '-' + self.lam)} AS w FROM {roots}"))
            body = f"SELECT {key}, {self._turned('t', 'w', 'r')} FROM ({body}) CROSS JOIN {weight}"
        else:
            body = f"SELECT {key}, " + ", ".join(f"t{k} AS r{k}" for k in range(self.rank)) + f" FROM ({body})"
        return self._orthonormal(self._add(self._next("raw"), body), key, b)

    def _iteration(self) -> None:
        self.v, self.m = self._half("col_id", True)
        self.u, self.m = self._half("row_id", True)

    def _state(self, it: str, change: str) -> str:
        vectors = [f"SELECT '{x}' AS side, {key} AS id, [{self._names(x)}] AS vector FROM {table}"
                   for x, key, table in (("u", "row_id", self.u), ("v", "col_id", self.v))]
        return f"SELECT {it}, {change}, * FROM ({' UNION ALL '.join(vectors)} UNION ALL SELECT 'm', 0, flatten(m) FROM {self.m})"

    def _read(self, at: str = "true") -> None:
        rank = self.rank
        for x, key in (("u", "row_id"), ("v", "col_id")):
            entries = ", ".join(f"vector[{k + 1}] AS {x}{k}" for k in range(rank))
            setattr(self, x, self._add(self._next(x), f"SELECT id AS {key}, {entries} FROM fit WHERE side = '{x}' AND {at}"))
        rows = ", ".join(f"vector[{i * rank + 1}:{(i + 1) * rank}]" for i in range(rank))
        self.m = self._add(self._next("m"), f"SELECT [{rows}] AS m FROM fit WHERE side = 'm' AND {at}")

    def als(self, iterations: int) -> Polar:
        self._iteration()  # nothing to compare with: the change is 1 or more
        first, outer, self.ctes = self._state("1", "1e0"), self.ctes, []
        self._read()
        u, v, m = self.u, self.v, self.m
        self._iteration()
        old_new = self._add(self._next("cross"), f"SELECT {self._sums('o.u', 'n.u')} AS c FROM {self.u} n JOIN {u} o USING (row_id)")
        new_old = self._add(self._next("cross"), f"SELECT {self._sums('n.v', 'o.v')} AS c FROM {self.v} n JOIN {v} o USING (col_id)")
        square = "list_sum([list_dot_product(r, r) FOR r IN {0}])"
        shared = " + ".join(f"a[{i + 1}][{j + 1}] * b[{j + 1}][{i + 1}]" for i in range(self.rank) for j in range(self.rank))
        change = self._add(self._next("change"), (
            f"SELECT (old + new - 2 * ({shared})) / greatest(old, 1e-9) AS change FROM (SELECT {square.format('o.m')} AS old, "
            f"{square.format('n.m')} AS new, {self._times('n.m', 'u.c')} AS a, {self._times('o.m', 'v.c')} AS b "
            f"FROM {m} o CROSS JOIN {self.m} n CROSS JOIN {old_new} u CROSS JOIN {new_old} v)"))
        step = (f"WITH RECURSIVE {', '.join(self.ctes)} SELECT t.it + 1, c.change, n.side, n.id, n.vector FROM ({self._state('0', '0')}) n "
                f"CROSS JOIN {change} c CROSS JOIN (SELECT max(it) AS it, max(change) AS change FROM fit) t "
                f"WHERE t.it < {iterations} AND t.change >= {self.threshold}")
        self.ctes = [*outer, f"fit(it, change, side, id, vector) AS ({first} UNION ALL ({step}))"]
        self._read("it = (SELECT max(it) FROM fit)")
        self.u, self.m = self._half("row_id", False)
        # The positive part of m - lam is the mean of that matrix and its absolute value, the root of its square.
        moved = self._add(self._next("moved"), f"SELECT {self._combined('m', '1e0', self._eye(), '-' + self.lam)} AS a FROM {self.m}")
        squared = self._add(self._next("squared"), f"SELECT {self._times('a', 'a')} AS m FROM {moved}")
        roots = self._roots(squared)
        self.m = self._add(self._next("m"), f"SELECT {self._combined('a', '0.5e0', 'root', '0.5e0')} AS m FROM {moved} CROSS JOIN {roots}")
        return self


def fit_and_score() -> str:
    """Rank 8, up to 50 iterations, the stop test, centers until they stand: the reference's budget."""
    fit = Polar("x", 8, "2e-2").als(50)
    turned = fit._add("scoring", f"SELECT row_id, {fit._turned('u', 'm', 'q')} FROM {fit.u} CROSS JOIN {fit.m}")
    score = "coalesce(" + " + ".join(f"q{k} * v{k}" for k in range(fit.rank)) + ", 0) + coalesce(a.center, 0) + coalesce(b.center, 0)"
    joins = (f"LEFT JOIN {turned} USING (row_id) LEFT JOIN {fit.v} USING (col_id) LEFT JOIN a USING (row_id) "
             "LEFT JOIN b USING (col_id)")
    return "WITH RECURSIVE " + sql(
        *SPLIT, "rated AS MATERIALIZED (SELECT * FROM train WHERE value <> 0)", *converged_centers("rated"),
        residual("x", "a", "b", "rated"), *fit.ctes,
        f"scored AS (SELECT row_id, col_id, value, {score} AS prediction FROM test {joins})",
        f"fitted AS (SELECT value, {score} AS prediction FROM rated {joins})",
        select=f"SELECT row_id, col_id, value, {rnd('prediction', 4)} AS prediction, 'model' AS source, "
               f"(SELECT {rnd('avg(power(value - prediction, 2))', 4)} FROM scored) AS mse, "
               f"(SELECT {rnd('sqrt(avg(power(value - prediction, 2)))', 4)} FROM fitted) AS train_rmse FROM scored").removeprefix("WITH ")


def step_result(fit: Rank1, letter: str, key: str) -> str:
    table = fit.v if letter == "v" else fit.u
    return sql(CP, *fit.ctes, select=(
        f"SELECT {key}, {rnd(table + '.' + letter)} AS {letter}0, {rnd(fit.d + '.d')} AS d FROM {table} CROSS JOIN {fit.d}"))


def single_step(letter: str) -> str:
    """One step of the nested method on a matrix filled by given vectors with singular value 100."""
    fit = Rank1("cells")
    fit.ctes += [
        f"v0 AS MATERIALIZED (SELECT col_id, f / sqrt(sum(f * f) OVER ()) AS v FROM "
        f"(SELECT DISTINCT col_id, {start('col_id', 0)} AS f FROM cells))",
        "dfill AS (SELECT 100e0 AS d)"]
    fit.v, fit.d = "v0", "dfill"
    fit.step("col_id" if letter == "v" else "row_id", ("u0", "dfill", "v0"), None)
    return step_result(fit, letter, "col_id" if letter == "v" else "row_id")


def als_steps(count: int) -> str:
    fit = Rank1("cells")
    fit.step("col_id", None, None)
    if count == 1:
        return step_result(fit, "v", "col_id")
    fit.step("row_id", (fit.u, fit.d, fit.v), None)
    return step_result(fit, "u", "row_id")


# Results of several trials at once

FOLD = "(row_id * 7919 + col_id * 104729) % 3"


def center_results(select: str) -> str:
    ctes = [CP,
            f"data AS MATERIALIZED (SELECT t AS trial, row_id, col_id, value, {FOLD} AS fold FROM cells CROSS JOIN range(3) r(t))",
            "train AS MATERIALIZED (SELECT * FROM data WHERE fold <> trial)"]
    parts = []
    previous = None
    for t in (1, 2, 3):
        ctes.append(mean(f"b{t}", "col_id", previous, "train", "trial, "))
        ctes.append(mean(f"a{t}", "row_id", f"b{t}", "train", "trial, "))
        previous = f"a{t}"
        for model, a, b in (("col_center", None, "b1"), ("bi_center", f"a{t}", f"b{t}")):
            estimate = "coalesce(b.center, 0)" + (" + coalesce(a.center, 0)" if a else "")
            join_a = f" LEFT JOIN {a} a USING (trial, row_id)" if a else ""
            parts.append(
                f"SELECT '{model}' AS model, {t} AS max_iter, trial, "
                f"avg(CASE WHEN fold = trial THEN power(value - ({estimate}), 2) END) AS mse, "
                f"sqrt(avg(CASE WHEN fold <> trial THEN power(value - ({estimate}), 2) END)) AS train_rmse "
                f"FROM data LEFT JOIN {b} b USING (trial, col_id){join_a} GROUP BY trial")
    ctes.append("results AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append("averages AS (SELECT model, max_iter, avg(sqrt(mse)) AS rmse, avg(train_rmse) AS train_rmse "
                "FROM results GROUP BY 1, 2)")
    return sql(*ctes, select=select)


def grid(iterations: int, fold: str) -> list[str]:
    """Errors per fold and shrinkage, all fitted at once, as the table ``scored``."""
    fit = Rank1("train", "lam", "fold, lam, ").als(iterations)
    return [
        CP,
        f"folds AS MATERIALIZED (SELECT row_id, col_id, value, {fold} AS own FROM cells)",
        "data AS MATERIALIZED (SELECT lam, row_id, col_id, value, own FROM folds "
        "CROSS JOIN (VALUES (0.02e0), (10e0), (400e0)) g(lam))",
        "train AS MATERIALIZED (SELECT t AS fold, lam, row_id, col_id, value FROM data CROSS JOIN range(3) r(t) WHERE own <> t)",
        *fit.ctes,
        "scored AS (SELECT own, x.lam AS lam, avg(power(value - coalesce(u.u * d.d * v.v, 0), 2)) AS mse FROM data x "
        f"LEFT JOIN {fit.d} d ON d.fold = x.own AND d.lam = x.lam "
        f"LEFT JOIN {fit.u} u ON u.fold = x.own AND u.lam = x.lam AND u.row_id = x.row_id "
        f"LEFT JOIN {fit.v} v ON v.fold = x.own AND v.lam = x.lam AND v.col_id = x.col_id GROUP BY own, x.lam)"]


def grid_best() -> str:
    return sql(*grid(1, FOLD), select=f"SELECT 1e0 AS max_rank, lam AS shrinkage_value, {rnd('avg(mse)', 4)} AS mse FROM scored "
               "GROUP BY lam ORDER BY avg(mse), lam LIMIT 1")


def grid_scores() -> str:
    return sql(*grid(30, "ntile(3) OVER (ORDER BY row_id, col_id) - 1"), select=(
        f"SELECT 1e0 AS max_rank, lam AS shrinkage_value, {rnd('avg(mse)', 4)} AS mse FROM scored GROUP BY lam"))


def imputations_of_fits() -> str:
    fit = Rank1("runs", by="run, ", entry="((row_id * 7919 + 31 + run * 3571) % 1000) / 1000e0 - 0.5e0").als(3)
    return sql(
        CP, *PASS2, residual("x", "a2", "b2"),
        "runs AS MATERIALIZED (SELECT run, row_id, col_id, value FROM x CROSS JOIN range(3) r(run))", *fit.ctes, SHAPE, REQUESTS,
        "asked AS (SELECT run, row_id, col_id, n_rows, n_cols FROM (SELECT DISTINCT row_id, col_id FROM requests) "
        "CROSS JOIN shape CROSS JOIN range(3) r(run))",
        f"scored AS (SELECT row_id, col_id, CASE WHEN ({STATUS}) = 'ok' THEN coalesce(u.u * d.d * v.v, 0) + coalesce(a2.center, 0) "
        f"+ coalesce(b2.center, 0) END AS prediction FROM asked JOIN {fit.d} d USING (run) LEFT JOIN {fit.u} u USING (run, row_id) "
        f"LEFT JOIN {fit.v} v USING (run, col_id) LEFT JOIN a2 USING (row_id) LEFT JOIN b2 USING (col_id))",
        select=f"SELECT row_id, col_id, {rnd('avg(prediction)', 4)} AS prediction, count(*) AS runs FROM scored GROUP BY 1, 2")


def product(key: str, mult: str, m: str, low: str, l: str, other_low: str, o: str, other: str) -> str:
    """``x m + low (other_low^T m)`` per key, two columns."""
    sums = ", ".join(f"sum(value * m.{m}{k}) AS s{k}" for k in (0, 1))
    small = ", ".join(f"sum(o.{o}{i} * m.{m}{k}) AS c{i}{k}" for i in (0, 1) for k in (0, 1))
    out = ", ".join(rnd(f"s{k} + l.{l}0 * c0{k} + l.{l}1 * c1{k}", 9) + f" AS p{k}" for k in (0, 1))
    return sql(
        CP, given("fu", "row_id", "u"), given("fv", "col_id", "v"),
        given("fa", "row_id", "a", 2, 1), given("fb", "col_id", "b", 2, 2),
        f"sp AS (SELECT {key}, {sums} FROM cells JOIN {mult} m USING ({other}) GROUP BY {key})",
        f"sm AS (SELECT {small} FROM {other_low} o JOIN {mult} m USING ({other}))",
        select=f"SELECT {key}, {out} FROM sp JOIN {low} l USING ({key}) CROSS JOIN sm")


def orphans() -> str:
    parts, tables = [], []
    for key, group, letter in (("col_id", "row_id", "v"), ("row_id", "col_id", "u")):
        few = f"few_{letter}"
        tables += [f"{few} AS MATERIALIZED (SELECT * FROM cells WHERE {key} IN (SELECT {key} FROM cells GROUP BY 1 HAVING count(*) >= {SUPPORT}))",
                   given(f"f{letter}", key, letter, source=few)]
        sums = ", ".join(rnd(f"sum(value * {letter}{k})", 9) + f" AS p{k}" for k in (0, 1))
        parts.append(f"SELECT '{group}' AS side, {group} AS id, {sums}, (SELECT count(*) FROM cells) - (SELECT count(*) FROM {few}) "
                     f"AS unmatched, (SELECT count(*) FROM cells) AS cells FROM cells JOIN f{letter} USING ({key}) GROUP BY {group}")
    return sql(CP, *tables, select=" UNION ALL ".join(parts))


def trial_sizes() -> str:
    """The rows of a tuned trial: both methods on the same split."""
    return sql(
        CP, smallest_hash("s", "cells", 10000, 0),
        "r AS MATERIALIZED (SELECT * FROM s WHERE row_id IN (SELECT row_id FROM s GROUP BY 1 HAVING count(*) >= 3))",
        "clip AS MATERIALIZED (SELECT * FROM r WHERE col_id IN (SELECT col_id FROM r GROUP BY 1 HAVING count(*) >= 3))",
        smallest_hash("test", "clip", 3, 31),
        select="SELECT model, 8::INT AS max_iter, 0::INT AS trial, (SELECT count(*) FROM s) - (SELECT count(*) FROM test) AS n_train, "
               "(SELECT count(*) FROM test) AS n_test, 1::INT AS complete FROM (VALUES ('soft_impute_als'), ('ridge_als')) m(model)")


FACTORS = (CP, given("fu", "row_id", "u"), given("fv", "col_id", "v"))
XHAT = "3e0 * u0 * v0 + 2e0 * u1 * v1"
SVD = (
    CP, given("fu", "row_id", "u"),
    "g AS MATERIALIZED (SELECT sum(u0 * u0) AS p, sum(u1 * u1) AS q, sum(u0 * u1) AS r FROM fu)",
    "s AS MATERIALIZED (SELECT sqrt((p + q) / 2 + sqrt(power((p - q) / 2, 2) + r * r)) AS s0, "
    "sqrt((p + q) / 2 - sqrt(power((p - q) / 2, 2) + r * r)) AS s1, p, q, r FROM g)",
)
SHAPE = "shape AS (SELECT max(row_id) + 1 AS n_rows, max(col_id) + 1 AS n_cols FROM cells)"
REQUESTS = ("requests AS (SELECT l_orderkey, l_linenumber, l_suppkey * 16 - 50 AS row_id, "
            "l_partkey + l_linenumber - 3 AS col_id FROM lineitem)")
STATUS = ("CASE WHEN col_id < 0 OR col_id >= n_cols THEN 'col_out_of_range' "
          "WHEN row_id < 0 OR row_id >= n_rows THEN 'row_out_of_range' ELSE 'ok' END")


def oracles() -> dict[str, str]:
    change = {
        f"c{side}": ", ".join(
            f"sum(n.{letter}{i} * o.{letter}{j}) AS {letter}{i}{j}" for i in (0, 1) for j in (0, 1))
        for side, letter in (("u", "u"), ("v", "v"))}
    d_old, d_new = (2.0, 1.0), (1.5, 0.5)
    trace = " + ".join(f"{d_new[i]}e0 * u{i}{j} * {d_old[j]}e0 * v{i}{j}" for i in (0, 1) for j in (0, 1))
    column_sum = " + ".join(
        f"({d_new[0]}e0 * u0{j} + {d_new[1]}e0 * u1{j}) * (v{j}0 * {d_old[0]}e0 + v{j}1 * {d_old[1]}e0)" for j in (0, 1))

    def relative(shared: str) -> str:
        return f"(5e0 + 2.5e0 - 2 * ({shared})) / 5e0"

    out = {
        "ratings_coo": sql(CP, select="SELECT * FROM cells"),
        "ratings_csv": sql(CP, select="SELECT * FROM cells"),
        "transpose": sql(CP, select="SELECT col_id AS row_id, row_id AS col_id, value FROM cells"),
        "adjacency_pack": sql(CP, select=(
            "SELECT col_id, row_id // 512 AS segment, count(*) AS n, "
            "string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS row_ids, "
            "string_agg(value::BIGINT::VARCHAR, ',' ORDER BY row_id) AS vals FROM cells GROUP BY 1, 2")),
        "adjacency_unpack": sql(CP, select="SELECT * FROM cells"),
        "matrix_profile": sql(*VIEWS, select=(
            f"SELECT view, n_rows, n_cols, nnz, {rnd('nnz / (n_rows::DOUBLE * n_cols)')} AS density, "
            "least(50, n_rows, n_cols)::BIGINT AS rank FROM profiles")),
        "mask_validity": sql(*VIEWS, select=(
            "SELECT view, (nnz = n_rows * n_cols)::INT AS is_full, (nnz = 0)::INT AS is_empty, "
            "(nnz > 0 AND nnz <> n_rows * n_cols)::INT AS is_valid FROM profiles")),
        "id_dictionary": "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part)",
        "pairs_from_arrays": (
            "SELECT l_orderkey, l_linenumber, 0::BIGINT AS pos, l_orderkey AS row_id, l_suppkey AS col_id FROM lineitem "
            "UNION ALL SELECT l_orderkey, l_linenumber, 1, l_partkey, l_linenumber FROM lineitem"),

        "center_weights": sql(CP, "x AS (SELECT row_id, col_id, value - 10 AS value FROM cells)", select=(
            "SELECT row_id AS id, 'row' AS side, coalesce(sum(1e0) FILTER (value <> 0), 0) AS weight FROM x GROUP BY 1 "
            "UNION ALL SELECT col_id, 'col', coalesce(sum(1e0) FILTER (value <> 0), 0) FROM x GROUP BY 1")),
        "center_pass1": sql(CP, *PASS1, select=both("a1", "b1", rnd("center") + " AS center")),
        "center_residual": sql(CP, *PASS1, residual("x", "a1", "b1"),
                               select=f"SELECT row_id, col_id, {rnd('value')} AS value FROM x"),
        "center_trace": sql(CP, *PASS2, select=(
            f"SELECT 1::INT AS iter, {rnd('(SELECT sum(center * center) FROM a1) + (SELECT sum(center * center) FROM b1)', 4)} AS level "
            "UNION ALL SELECT 2, " + rnd(
                "(SELECT sum(power(a2.center - a1.center, 2)) FROM a2 JOIN a1 USING (row_id)) + "
                "(SELECT sum(power(b2.center - b1.center, 2)) FROM b2 JOIN b1 USING (col_id))", 4))),
        "bicenter_2pass": sql(CP, *PASS2, select=both("a2", "b2", rnd("center") + " AS center, 1e0 AS scale")),
        "bicenter_residual": sql(CP, *PASS2, residual("x", "a2", "b2"),
                                 select=f"SELECT row_id, col_id, {rnd('value')} AS value FROM x"),
        "inverse_transform": sql(*FACTORS, *PASS1, select=(
            f"SELECT row_id, col_id, {rnd('u0 * v0 + u1 * v1 + a1.center + b1.center')} AS prediction FROM cells "
            "JOIN fu USING (row_id) JOIN fv USING (col_id) JOIN a1 USING (row_id) JOIN b1 USING (col_id)")),

        "ratings_sample": sql(CP, smallest_hash("s", "cells", 5000, 2), select="SELECT * FROM s"),
        "input_defects": (
            "WITH raw AS (SELECT nullif(l_suppkey, 7) AS r, nullif(l_partkey, 11) AS c, CASE WHEN l_quantity = 13 THEN NULL "
            "WHEN l_quantity = 17 THEN 'NaN'::DOUBLE ELSE l_quantity::DOUBLE END AS v FROM lineitem) "
            "SELECT count(*) AS n_rows, count(*) FILTER (r IS NULL OR c IS NULL) AS null_ids, "
            "count(*) FILTER (v IS NULL) AS null_values, count(*) FILTER (isnan(v)) AS nan_values, "
            "count(*) FILTER (r IS NULL OR c IS NULL OR v IS NULL OR isnan(v)) AS defects FROM raw"),
        "support_rows": sql(*CLIP[:2], select="SELECT * FROM r"),
        "support_clip": sql(*CLIP, select="SELECT * FROM clip"),
        "lno_test": sql(*SPLIT, select="SELECT * FROM test"),
        "lno_train": sql(*SPLIT, select="SELECT * FROM train WHERE value <> 0"),
        "lno_train_zeros": sql(*SPLIT, select="SELECT row_id, col_id, value - 10 AS value FROM train WHERE value <> 10"),
        "lno_partition_check": sql(*SPLIT, select=(
            "SELECT (SELECT count(*) FROM cells) AS cells, (SELECT count(*) FROM train WHERE value <> 10) AS train, "
            "(SELECT count(*) FROM test) AS test, 0::BIGINT AS overlap, 0::BIGINT AS lost, "
            "(SELECT count(*) FROM train WHERE value = 10) AS zeros_dropped")),
        "kfold_assign": sql(CP, select=(
            "SELECT row_id, col_id, (ntile(3) OVER (ORDER BY row_id, col_id) - 1)::INT AS fold_contiguous, "
            f"({FOLD})::INT AS fold_hash FROM cells")),
        "load_and_split": sql(
            CP, smallest_hash("s", "cells", 10000, 2),
            "r AS MATERIALIZED (SELECT * FROM s WHERE row_id IN (SELECT row_id FROM s GROUP BY 1 HAVING count(*) >= 3))",
            "clip AS MATERIALIZED (SELECT * FROM r WHERE col_id IN (SELECT col_id FROM r GROUP BY 1 HAVING count(*) >= 3))",
            smallest_hash("test", "clip", 3, 31),
            select="SELECT s.*, CASE WHEN t.row_id IS NULL THEN 'train' ELSE 'test' END AS part FROM s "
                   "LEFT JOIN test t ON t.row_id = s.row_id AND t.col_id = s.col_id"),

        "factor_scale": sql(CP, given("fu", "row_id", "u"), select=(
            f"SELECT row_id, {rnd('u0 * 2.5e0')} AS u0, {rnd('u1 * 0.75e0')} AS u1 FROM fu")),
        "factor_shrink": sql(*SVD, select=(
            f"SELECT row_id, {rnd('u0 * s0 / (s0 + 5)')} AS u0, {rnd('u1 * s1 / (s1 + 5)')} AS u1 FROM fu CROSS JOIN s")),
        "soft_threshold": sql(*SVD, "t AS (SELECT 0::BIGINT AS k, s0 AS d FROM s UNION ALL SELECT 1, s1 FROM s)", select=(
            f"SELECT k, {rnd('d')} AS d, {rnd('greatest(d - 5, 0)')} AS thresholded, "
            "(SELECT count(*) FROM t WHERE d > 5) AS effective_rank FROM t")),
        "factor_gram": sql(CP, given("fu", "row_id", "u", 3), select=" UNION ALL ".join(
            f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, {rnd(f'sum(u{i} * u{j})')} AS g FROM fu"
            for i in range(3) for j in range(i, 3))),
        "factor_svd": sql(*SVD, select=(
            f"SELECT row_id, {rnd('(u0 * u0 * q - 2 * u0 * u1 * r + u1 * u1 * p) / (p * q - r * r)', 8)} AS leverage, "
            f"{rnd('s0', 8)} AS s0, {rnd('s1', 8)} AS s1 FROM fu CROSS JOIN s")),
        "factor_change": sql(
            CP, given("ou", "row_id", "u"), given("nu", "row_id", "u", 2, 2),
            given("ov", "col_id", "v"), given("nv", "col_id", "v", 2, 2),
            f"cu AS (SELECT {change['cu']} FROM nu n JOIN ou o USING (row_id))",
            f"cv AS (SELECT {change['cv']} FROM nv n JOIN ov o USING (col_id))",
            select=f"SELECT {rnd(relative(trace), 4)} AS by_trace, {rnd(relative(column_sum), 4)} AS by_column_sum "
                   "FROM cu CROSS JOIN cv"),
        "factor_conformance": sql(
            CP, f"few AS (SELECT col_id FROM cells GROUP BY 1 HAVING count(*) >= {SUPPORT})",
            "miss AS (SELECT count(*) AS n FROM (SELECT DISTINCT col_id FROM cells) WHERE col_id NOT IN (SELECT col_id FROM few))",
            select="SELECT 2::BIGINT AS min_u, 2::BIGINT AS max_u, 2::BIGINT AS min_v, 2::BIGINT AS max_v, "
                   "0::BIGINT AS missing_rows, n AS missing_cols, (n = 0)::BIGINT AS conforms FROM miss"),
        "sddmm": sql(*FACTORS, select=(
            f"SELECT row_id, col_id, value, {rnd(XHAT)} AS xhat FROM cells JOIN fu USING (row_id) JOIN fv USING (col_id)")),
        "product_orphans": orphans(),
        "splr_r_mult": product("row_id", "fv", "v", "fa", "a", "fb", "b", "col_id"),
        "splr_l_mult": product("col_id", "fu", "u", "fb", "b", "fa", "a", "row_id"),

        "request_status": sql(CP, SHAPE, REQUESTS, select=(
            f"SELECT l_orderkey, l_linenumber, row_id, col_id, {STATUS} AS status FROM requests CROSS JOIN shape")),
        "predict_pairs": sql(*FACTORS, *PASS1, SHAPE, REQUESTS, select=(
            f"SELECT l_orderkey, l_linenumber, row_id, col_id, CASE WHEN ({STATUS}) = 'ok' THEN "
            + rnd(f"coalesce(value, coalesce({XHAT}, 0) + coalesce(a1.center, 0) + coalesce(b1.center, 0))")
            + f" END AS prediction, CASE WHEN ({STATUS}) <> 'ok' THEN 'out_of_range' "
            "WHEN value IS NOT NULL THEN 'observed' ELSE 'model' END AS source FROM requests CROSS JOIN shape "
            "LEFT JOIN cells USING (row_id, col_id) LEFT JOIN fu USING (row_id) LEFT JOIN fv USING (col_id) "
            "LEFT JOIN a1 USING (row_id) LEFT JOIN b1 USING (col_id)")),
        "predict_few": saved_model(),
        "cell_lookup": sql(CP, REQUESTS, select=(
            "SELECT row_id, col_id, value FROM cells WHERE (row_id, col_id) IN (SELECT (row_id, col_id) FROM requests)")),
        "train_rmse": sql(*FACTORS, select=(
            f"SELECT {rnd(f'sqrt(avg(power(value - ({XHAT}), 2)))')} AS rmse FROM cells "
            "JOIN fu USING (row_id) JOIN fv USING (col_id)")),
        "heldout_mse": sql(*SPLIT, mean("b1", "col_id", None, "train"), mean("a1", "row_id", "b1", "train"), select=(
            f"SELECT {rnd('avg(power(value - coalesce(a1.center, 0) - coalesce(b1.center, 0), 2))')} AS mse FROM test "
            "LEFT JOIN a1 USING (row_id) LEFT JOIN b1 USING (col_id)")),
        "imputation_mean": sql(CP, given("fu", "row_id", "u", 3), given("fv", "col_id", "v", 3), select=(
            f"SELECT row_id, col_id, {rnd('(10e0 * u0 * v0 + 10e0 * u1 * v1 + 10e0 * u2 * v2) / 3')} AS prediction, "
            "3::BIGINT AS runs FROM cells JOIN fu USING (row_id) JOIN fv USING (col_id)")),
        "result_averages": center_results(
            f"SELECT model, max_iter, {rnd('rmse')} AS rmse, {rnd('train_rmse')} AS train_rmse FROM averages"),
        "iteration_delta": center_results("SELECT model, max_iter, " + ", ".join(
            rnd(f"coalesce(abs({m} - lag({m}) OVER (PARTITION BY model ORDER BY max_iter)), {m})") + f" AS {m}_change"
            for m in ("rmse", "train_rmse")) + " FROM averages"),
        "grid_best": grid_best(),
        "grid_scores": grid_scores(),
        "imputations_of_fits": imputations_of_fits(),

        "init_factors": sql(CP, *rank1_start("cells"), select=f"SELECT row_id, {rnd('u', 8)} AS u0 FROM u0"),
        "als_a_step": als_steps(1),
        "als_b_step": als_steps(2),
        "si_u_step": single_step("v"),
        "si_v_step": single_step("u"),
        "si_inner": fitted_cells(Rank1("cells").nested(1, 2), False),
        "soft_impute_rank1": fitted_cells(Rank1("x").nested(2, 2), True),
        "als_rank1": fitted_cells(Rank1("x").als(3), True),
        "als_rank1_raw": fitted_cells(Rank1("cells").als(3), False),
        "als_rank1_default": fitted_cells(Rank1("x", "0.02e0").als(3), True),
        "model_roundtrip": saved_model(),
        "model_store": saved_model(),
        "comparison_tuned": trial_sizes(),
        "comparator_error": sql(*SPLIT, select="SELECT row_id, col_id, value, 1::INT AS scored, 1::INT AS error_agrees FROM test"),
        "fit_and_score": fit_and_score(),
    }
    out["load_and_split_csv"] = out["load_and_split"]
    return out
