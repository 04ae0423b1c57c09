"""The label grid: where a row lies and which rules can reach it.

Evenly spaced triangles overlap in pairs, so a value has at most two labels of
non-zero degree: the peaks to its left and right. The peaks cut the feature
space into cells. A row lies in exactly one cell, and every rule that can fire
on it sits on a corner of that cell. Learning therefore adds up degrees per
cell corner, and scoring looks a row's cell up: neither multiplies rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import prod

from pyspark.sql import DataFrame

from ruleloom.functions.membership import cuts, peaks
from ruleloom.operators.encode import x_col
from ruleloom.schema import RuleSchema

# Sums per group in one aggregate are 2**CORE; beyond four features the compiled
# aggregate gets too long for the JIT, so further features are exploded.
CORE = 4
# Up to this many numeric features a cell's corners are enumerated.
GRID_FEATURES = 8
KEY_LIMIT = 2**62


def pack(columns, radices) -> str:
    """SQL for one key from several small indices: a bigint if it fits, else text."""
    if not columns:
        return "0L"
    if prod(radices) >= KEY_LIMIT:
        return f"concat_ws('|', {', '.join(f'CAST({c} AS STRING)' for c in columns)})"
    terms, stride = [], 1
    for c, r in zip(columns, radices):
        terms.append(f"CAST({c} AS BIGINT) * {stride}L" if stride > 1 else f"CAST({c} AS BIGINT)")
        stride *= r
    return "(" + " + ".join(terms) + ")"


def unpack(key: str, radices) -> list[str]:
    """SQL for the indices that went into :func:`pack`."""
    if prod(radices) >= KEY_LIMIT:
        return [f"CAST(get(split({key}, '[|]'), {i}) AS INT)" for i in range(len(radices))]
    out, stride = [], 1
    for r in radices:
        whole = f"({key} DIV {stride}L)" if stride > 1 else key
        out.append(f"CAST({whole} % {r}L AS INT)")
        stride *= r
    return out


@dataclass(frozen=True)
class Grid:
    schema: RuleSchema

    @cached_property
    def numeric(self) -> tuple[int, ...]:
        return self.schema.numeric_positions

    @cached_property
    def core(self) -> tuple[int, ...]:
        """Numeric features summed per corner (the last ones, in order)."""
        return self.numeric[-CORE:]

    @cached_property
    def exploded(self) -> tuple[int, ...]:
        return self.numeric[:-CORE]

    @property
    def is_small(self) -> bool:
        return len(self.numeric) <= GRID_FEATURES

    def n_cells(self, i: int) -> int:
        v = self.schema.variables[i]
        if not v.is_numeric:
            return v.n_values
        return 1 if v.is_constant else self.schema.n_labels - 1

    def low_label(self, i: int, cell: str) -> str:
        return "0" if self.schema.variables[i].is_constant else cell

    def high_label(self, i: int, cell: str) -> str:
        return str(self.schema.n_labels - 1) if self.schema.variables[i].is_constant else f"({cell} + 1)"


def k_col(i):
    return f"__k{i}"


def lo_col(i):
    return f"__l{i}"


def hi_col(i):
    return f"__h{i}"


def own_col(i):
    return f"__o{i}"


def real(v: float) -> str:
    """A double literal of SQL text with every digit of ``v``."""
    return f"({float(v)!r}D)"


def _pick(values, index: str) -> str:
    """SQL for the entry of a short list of doubles at ``index``."""
    if len(values) == 1:
        return real(values[0])
    if len(values) <= 3:
        whens = " ".join(f"WHEN {k} THEN {real(v)}" for k, v in enumerate(values[:-1]))
        return f"CASE {index} {whens} ELSE {real(values[-1])} END"
    return f"get(array({', '.join(real(v) for v in values)}), {index})"


def place(df: DataFrame, grid: Grid, keep, own: bool = True) -> DataFrame:
    """Cell, both degrees and (``own``) the nearer corner for each feature.

    Three projections, so each break point is found once per row. Degrees are
    never null, which keeps the compiled products free of null checks.
    """
    schema, n = grid.schema, grid.schema.n_labels
    cells, ends, degrees = [], [], []
    for i, v in enumerate(schema.variables):
        x, k, a, b = x_col(i), k_col(i), f"__a{i}", f"__b{i}"
        if not v.is_numeric:
            cells.append(f"{x} AS {k}")
            ends.append(k)
            degrees.append(k)
            continue
        p, c = peaks(v.lower, v.upper, n), cuts(v.lower, v.upper, n)
        if v.is_constant:
            cells += [f"0 AS {k}", x]
            ends += [k, x]
            hit = f"coalesce(IF({x} = {real(p[0])}, 1D, 0D), 0D)"
            degrees += [k, f"{hit} AS {lo_col(i)}", f"{hit} AS {hi_col(i)}"]
            if own:
                degrees.append(f"IF({x} < {real(c[0])}, 0, 1) AS {own_col(i)}")
            continue
        whens = " ".join(f"WHEN {x} < {real(p[j])} THEN {j - 1}" for j in range(1, n - 1))
        cells += [f"CASE {whens} ELSE {n - 2} END AS {k}" if whens else f"0 AS {k}", x]
        ends += [k, x, f"{_pick(p[:-1], k)} AS {a}", f"{_pick(p[1:], k)} AS {b}"]
        inside = f"{a} <= {x} AND {x} <= {b}"
        degrees += [
            k,
            f"coalesce(IF({inside}, ({b} - {x}) / ({b} - {a}), 0D), 0D) AS {lo_col(i)}",
            f"coalesce(IF({inside}, ({x} - {a}) / ({b} - {a}), 0D), 0D) AS {hi_col(i)}",
        ]
        if own:
            degrees.append(f"IF({x} < {_pick(c, k)}, 0, 1) AS {own_col(i)}")
    keep = list(keep)
    return df.selectExpr(*keep, *cells).selectExpr(*keep, *ends).selectExpr(*keep, *degrees)


def corner_products(features, start: str = "") -> list[str]:
    """SQL for the degree of every corner of ``features``.

    Bit ``j`` of the corner number says that feature ``j`` takes its upper
    label. Factors stand in feature order, so corners share the front of their
    products and Spark works each of those out once.
    """
    out = []
    for corner in range(1 << len(features)):
        factors = [start] if start else []
        for j, i in enumerate(features):
            factors.append(hi_col(i) if corner >> j & 1 else lo_col(i))
        out.append(" * ".join(factors) or "1D")
    return out
