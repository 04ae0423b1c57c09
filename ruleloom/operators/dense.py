"""Rows against all rules, where no feature parts the rules: tiles of matrix products.

With many features and mostly middle labels every row meets every rule and a good part
of the pairs fires. The logarithm of a degree is a sum of one logarithm per feature, so
the degrees of some rows in some rules are one matrix product: the rows' logarithms in
every label, times a matrix with a 1 where a rule has the label.

Rows and rules are dealt into chunks by hash, and every chunk of rows meets every chunk
of rules as one key of a cogroup. Pairs stay in the task: it returns a sum per rule and
class, or one row per row. So rows times rules are worked out but never written, and a
task holds ``ROW_TILE`` rows and ``RULE_TILE`` rules, however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.membership import peaks
from ruleloom.operators.encode import CLASS, antecedents_of, x_col
from ruleloom.operators.match import Counted
from ruleloom.schema import RuleSchema

ROW_TILE, RULE_TILE = 16_384, 32_768
# A tile's result has a number per class; it holds at most this many.
TILE_NUMBERS = 8_000_000
# Rows and rules of one matrix product, and pairs worth a tile of their own.
ROWS, RULES = 256, 4_096
TILE_PAIRS = 4_000_000
TILES_PER_CORE = 8
# The logarithm of degree 0, what is surely below that of any double, and how near two logarithms are compared exactly.
NEVER, NOTHING, NEAR = -1e4, -5e3, 1e-9
ROW_CHUNK, RULE_CHUNK = "__row_chunk", "__rule_chunk"


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(parts).reshape(-1, width) if parts else np.zeros((0, width))


class Labels:
    """Degrees of values in all labels, by the formulas of :func:`ruleloom.operators.grid.place`."""

    def __init__(self, schema: RuleSchema, positions) -> None:
        self.n = schema.n_labels
        numeric = [schema.variables[i] for i in positions if schema.variables[i].is_numeric]
        self.ends = [(np.array(peaks(v.lower, v.upper, self.n), float), v.is_constant) for v in numeric]
        self.width, self.step = len(numeric), (ROWS, RULES)

    def degrees(self, x: np.ndarray) -> np.ndarray:
        """(rows, features, labels)"""
        out, rows = np.zeros((*x.shape, self.n)), np.arange(len(x))
        for j, (p, constant) in enumerate(self.ends):
            v = x[:, j]
            if constant:
                out[:, j, 0] = out[:, j, -1] = v == p[0]
                continue
            k = np.searchsorted(p[1:-1], v, "right")
            a, b = p[k], p[k + 1]
            inside = (a <= v) & (v <= b)
            out[rows, j, k] = np.where(inside, (b - v) / (b - a), 0.0)
            out[rows, j, k + 1] = np.where(inside, (v - a) / (b - a), 0.0)
        return out

    def logs(self, degrees: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.maximum(np.log(degrees), NEVER).reshape(len(degrees), -1)

    def hot(self, labels: np.ndarray) -> np.ndarray:
        """(features x labels, rules), 1 where a rule has the label."""
        out = np.zeros((len(labels), self.width * self.n))
        out[np.arange(len(labels))[:, None], np.arange(self.width) * self.n + labels] = 1.0
        return out.T

    def steps(self, logs: np.ndarray, labels: np.ndarray):
        """Some rows, some rules (as slices) and the logarithms of the degrees, step by step."""
        for a in range(0, len(labels), self.step[1]):
            rules = slice(a, a + self.step[1])
            hot = self.hot(labels[rules])
            for b in range(0, len(logs), self.step[0]):
                rows = slice(b, b + self.step[0])
                yield rows, rules, logs[rows] @ hot


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def _summed(labels: Labels):
    """Degree sums of the rules of a tile, for the classes that were seen with them."""

    def run(rows: pa.Table, rules: pa.Table) -> pa.Table:
        cls = rows.column(CLASS).to_numpy()
        order = np.argsort(cls, kind="stable")
        present, cls = np.unique(cls[order], return_inverse=True)
        logs = labels.logs(labels.degrees(_lists(rows.column("x"), labels.width)[order]))
        sums = np.zeros((len(present), rules.num_rows))
        for some, these, degrees in labels.steps(logs, _lists(rules.column("ants"), labels.width)):
            np.exp(degrees, out=degrees)
            own = cls[some]
            first = _runs(own)
            sums[own[first], these] += np.add.reduceat(degrees, first, axis=0)
        seen = rules.column("classes").combine_chunks()
        rule = np.repeat(np.arange(rules.num_rows), np.diff(seen.offsets.to_numpy()))
        seen = seen.flatten().to_numpy(zero_copy_only=False)
        at = np.searchsorted(present, seen)
        has = at < len(present)
        has[has] = present[at[has]] == seen[has]
        numbers = rules.column("__no").to_numpy()
        return pa.table({"__no": numbers[rule[has]], CLASS: seen[has].astype(np.int32), "degree": sums[at[has], rule[has]]})

    return run


def _winners(labels: Labels, keep):
    """Per row of a tile the strongest association and its class, the lowest on a tie.

    Logarithms only find the rules that may be the strongest; their associations are then
    multiplied, factor by factor.
    """

    def run(rows: pa.Table, rules: pa.Table) -> pa.Table:
        degrees = labels.degrees(_lists(rows.column("x"), labels.width))
        ants, w, cls = _lists(rules.column("ants"), labels.width), rules.column("w").to_numpy(), rules.column("rule_class").to_numpy()
        least = np.full(rows.num_rows, NOTHING)
        best, winner = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int32)
        log_w = np.log(w)
        for some, these, found in labels.steps(labels.logs(degrees), ants):
            found += log_w[these]
            now = least[some]
            np.maximum(now, found.max(1) - NEAR, out=now)
            r, c = np.nonzero(found >= now[:, None])
            r, c = r + some.start, c + these.start
            value = np.ones(len(r))
            for j in range(labels.width):
                value *= degrees[r, j, ants[c, j]]
            value *= w[c]
            order = np.lexsort((cls[c], -value, r))
            r, c, value = r[order], c[order], value[order]
            first = _runs(r) if len(r) else np.zeros(0, int)
            r, k, value = r[first], cls[c[first]], value[first]
            better = (value > best[r]) | ((value == best[r]) & (k < winner[r]))
            best[r[better]], winner[r[better]] = value[better], k[better]
        return rows.select(keep).append_column("degree", pa.array(best)).append_column("winner", pa.array(winner))

    return run


def _voted(labels: Labels, keep, n_classes: int):
    """Per row of a tile the summed associations of every class."""

    def run(rows: pa.Table, rules: pa.Table) -> pa.Table:
        logs = labels.logs(labels.degrees(_lists(rows.column("x"), labels.width)))
        cls = rules.column("rule_class").to_numpy()
        order = np.argsort(cls, kind="stable")
        cls, w, ants = cls[order], rules.column("w").to_numpy()[order], _lists(rules.column("ants"), labels.width)[order]
        votes = np.zeros((rows.num_rows, n_classes))
        for some, these, degrees in labels.steps(logs, ants):
            np.exp(degrees, out=degrees)
            degrees *= w[these]
            own = cls[these]
            first = _runs(own)
            votes[some, own[first]] += np.add.reduceat(degrees, first, axis=1)
        each = pa.ListArray.from_arrays(np.arange(0, votes.size + 1, n_classes, dtype=np.int32), votes.ravel())
        return rows.select(keep).append_column("votes", each)

    return run


def _tiles(encoded: DataFrame, rules: Counted, schema: RuleSchema, group, positions, keep, carry, row_key: str):
    """Rows and rules by tile, each side in as many partitions as there are tiles."""
    numeric = [i for i in positions if schema.variables[i].is_numeric]
    cores, room = encoded.sparkSession.sparkContext.defaultParallelism, TILE_NUMBERS // len(schema.classes)
    n_rows = encoded.count()
    rule_chunks = max(1, -(-rules.n_rules // max(ROWS, min(RULE_TILE, room))))
    wanted = min(TILES_PER_CORE * cores, -(-n_rows * rules.n_rules // TILE_PAIRS))
    row_chunks = max(1, -(-n_rows // max(ROWS, min(ROW_TILE, room))), -(-wanted // rule_chunks))
    x = ", ".join(f"coalesce({x_col(i)}, double('NaN'))" for i in numeric)
    rows = encoded.selectExpr(
        *group, *keep, f"array({x}) AS x", f"pmod(xxhash64({row_key}), {row_chunks}) AS {ROW_CHUNK}",
        f"explode(sequence(0L, {rule_chunks - 1}L)) AS {RULE_CHUNK}",
    )
    ants = antecedents_of(F.col("rule_key"))
    ants = F.array(*[F.get(ants, F.lit(i)) for i in numeric]).cast("array<short>")
    laid = rules.rules.withColumn("ants", ants).selectExpr(
        *group, *carry, "ants", f"explode(sequence(0L, {row_chunks - 1}L)) AS {ROW_CHUNK}",
        f"pmod(xxhash64(rule_key), {rule_chunks}) AS {RULE_CHUNK}",
    )
    by = [*group, ROW_CHUNK, RULE_CHUNK]
    parts = max(cores, row_chunks * rule_chunks)
    return rows.repartition(parts, *by).groupBy(*by).cogroup(laid.repartition(parts, *by).groupBy(*by))


def degree_sums(encoded: DataFrame, rules: Counted, schema: RuleSchema, group, positions) -> DataFrame:
    """``(group, rule_key, class_idx, degree_sum)`` of the classes listed with each rule.

    ``rules`` have a number ``__no`` and the list ``classes``.
    """
    rows = encoded.withColumn("__id", F.monotonically_increasing_id())
    tiles = _tiles(rows, rules, schema, group, positions, [CLASS], ["__no", "classes"], "__id")
    found = tiles.applyInArrow(_summed(Labels(schema, positions)), f"__no long, {CLASS} int, degree double")
    sums = found.groupBy("__no", CLASS).agg(F.sum("degree").alias("degree_sum"))
    return sums.join(rules.rules.select(*group, "rule_key", "__no"), "__no").select(*group, "rule_key", CLASS, "degree_sum")


def row_votes(encoded: DataFrame, rules: Counted, schema: RuleSchema, inference: str, group, keep, row_key: str) -> DataFrame:
    """One row per row: ``keep`` and ``degree`` and ``winner`` for the winning rule, or ``__v{k}`` per class.

    ``rules`` have ``rule_class`` and ``w``; ``keep`` holds ``row_key``, a number of each row.
    """
    positions, n_classes = list(range(len(schema.variables))), len(schema.classes)
    labels, by = Labels(schema, positions), list(dict.fromkeys([*group, *keep]))
    rest = [c for c in by if c not in group]
    tiles = _tiles(encoded, rules, schema, group, positions, rest, ["rule_class", "w"], row_key)
    kept = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in by)
    if inference == "winning_rule":
        found = tiles.applyInArrow(_winners(labels, by), f"{kept}, degree double, winner int")
        best = found.groupBy(*by).agg(F.max(F.struct("degree", (-F.col("winner")).alias("c"))).alias("b"))
        return best.selectExpr(*by, "b.degree AS degree", "-b.c AS winner")
    found = tiles.applyInArrow(_voted(labels, by, n_classes), f"{kept}, votes array<double>")
    return found.groupBy(*by).agg(*[F.expr(f"sum(get(votes, {k})) AS __v{k}") for k in range(n_classes)])
