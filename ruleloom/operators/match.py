"""Blocked rule x row matching for many features.

Rules are repeated into the cells they can reach on a few block features, rows
stay single, and both meet in an equi-join on the block. There the rules stand
in words of 64: a word has, for every label of every feature, the bit set of its
rules with that label. A row takes the sets of its labels of positive degree
feature by feature; the bits that are left are the rules that fire on it, and
only their degrees are multiplied.

The side of the rules is broadcast only after its words were counted; otherwise
the join is shuffled, with rows spread over salt buckets so that a block holding
a large part of the table is shared by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.encode import antecedents_of
from ruleloom.operators.grid import Grid, hi_col, k_col, lo_col, pack, place
from ruleloom.params import Params
from ruleloom.schema import RuleSchema
from ruleloom.session import cut_lineage

BLOCK_FEATURES = 5
# A block feature leaves a row at most this share of the rules.
BLOCK_SHARE = 0.75
RULE_ROW_BYTES = 96
WORD_RULES = 64
# Rules of a block are numbered in buckets of about this many.
BUCKET_RULES = 4096


@dataclass
class Blocks:
    """Rules laid out by block, and how rows have to meet them."""

    table: DataFrame
    positions: list[int]
    block_on: list[int]
    broadcast: bool
    salts: int
    row_partitions: int | None = None
    carry: tuple[str, ...] = ()


@dataclass
class Counted:
    """Written rules, their number and the features whose cells part them (none: :mod:`ruleloom.operators.dense`)."""

    rules: DataFrame
    n_rules: int
    block_on: list[int]


def block_positions(schema: RuleSchema, positions, labels: dict[int, dict[int, int]]) -> list[int]:
    """All nominal features (a row has one value) and the most selective numeric ones.

    ``labels`` counts the rules of each label, by feature. A row in the cell
    between two labels meets the rules of both. A feature whose cells hold most of
    the rules would repeat them for nothing; the bit sets do better.
    """

    def met(i: int) -> float:
        n = [labels.get(i, {}).get(k, 0) for k in range(schema.n_labels)]
        pairs = [n[0] + n[-1]] if schema.variables[i].is_constant else [a + b for a, b in zip(n, n[1:])]
        return sum(p * p for p in pairs) / max(sum(pairs), 1)

    def parts(i: int) -> bool:
        return met(i) <= BLOCK_SHARE * sum(labels.get(i, {}).values())

    numeric = [p for p in positions if schema.variables[p].is_numeric and parts(p)]
    numeric = sorted(numeric, key=lambda i: (met(i), i))[:BLOCK_FEATURES]
    return sorted(numeric + [p for p in positions if not schema.variables[p].is_numeric])


def reach(df: DataFrame, grid: Grid, i: int) -> DataFrame:
    """Add ``__c{i}``/``__b{i}``: each cell a rule's label touches and its side."""
    label, last = f"get(ants, {i})", grid.schema.n_labels - 1
    if grid.schema.variables[i].is_constant:
        sides = f"array(named_struct('c', 0, 'b', CASE {label} WHEN 0 THEN 0 WHEN {last} THEN 1 END))"
        return df.selectExpr("*", f"inline({sides}) AS (__c{i}, __b{i})").filter(f"__b{i} IS NOT NULL")
    sides = f"array(named_struct('c', {label} - 1, 'b', 1), named_struct('c', {label}, 'b', 0))"
    df = df.selectExpr("*", f"inline({sides}) AS (__c{i}, __b{i})")
    return df.filter(f"__c{i} BETWEEN 0 AND {grid.n_cells(i) - 1}")


def count_rules(rules: DataFrame, schema: RuleSchema, positions) -> Counted:
    """Write ``rules`` (with a ``rule_key``) once and count them and their labels."""
    rules = cut_lineage(rules)
    labels: dict[int, dict[int, int]] = {}
    wanted = [i for i in positions if schema.variables[i].is_numeric]
    spread = rules.select(F.posexplode(antecedents_of(F.col("rule_key"))).alias("i", "k")).filter(F.col("i").isin(wanted))
    for r in spread.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).collect():
        labels.setdefault(r["i"], {})[r["k"]] = r["n"]
    return Counted(rules, rules.count(), block_positions(schema, positions, labels))


def rule_blocks(counted: Counted, schema: RuleSchema, params: Params, group, positions, carry) -> Blocks:
    """Lay counted rules out by block of ``positions``.

    Their number decides between broadcast and shuffle.
    """
    grid = Grid(schema)
    rules, n_rules, block_on = counted.rules, counted.n_rules, counted.block_on
    df = rules.select(*group, *dict.fromkeys([*carry, "rule_key"]), antecedents_of(F.col("rule_key")).alias("ants"))
    cells = []
    for i in block_on:
        if schema.variables[i].is_numeric:
            df = reach(df, grid, i)
            cells.append(f"__c{i}")
        else:
            cells.append(f"get(ants, {i})")
    # Where the rule's labels stand in a row's list of degrees.
    n = schema.n_labels
    numeric = [i for i in positions if schema.variables[i].is_numeric]
    places = ", ".join(f"get(ants, {i}) + {n * j}" for j, i in enumerate(numeric))
    block = pack(cells, [grid.n_cells(i) for i in block_on])
    df = df.selectExpr(*group, *carry, f"array({places}) AS places", f"{block} AS block", "rule_key AS __key")
    table = rule_words(df, group, carry, n * len(numeric), n, -(-n_rules // BUCKET_RULES))
    small = False
    rule_bytes, word_bytes = RULE_ROW_BYTES + 8 * len(schema.variables), 8 * n * len(numeric)
    if n_rules * rule_bytes <= params.broadcast_bytes:
        table = cut_lineage(table)
        size = table.agg(F.count(F.lit(1)).alias("words"), F.sum(F.size("entries")).alias("rules")).first()
        small = size["words"] * word_bytes + (size["rules"] or 0) * rule_bytes <= params.broadcast_bytes
    salts = 1 if small else params.salt_buckets
    if not small:
        table = table.selectExpr("*", f"explode(sequence(0, {salts - 1})) AS salt")
    return Blocks(table, list(positions), block_on, small, salts, params.row_partitions if small else None, tuple(carry))


def rule_words(rules: DataFrame, group, carry, n_places: int, n_labels: int, buckets: int) -> DataFrame:
    """Rules of a block in words: ``(group, block, entries, sets)``.

    An entry has its bit, ``places`` and the carried columns; ``sets`` is, for
    every place, the bit set of the word's rules that stand there.
    """
    by = [*group, "block", "__bucket"]
    rules = rules.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    order = F.row_number().over(Window.partitionBy(*by).orderBy("__key")) - 1
    rules = rules.withColumn("__no", order)
    fields = ", ".join(f"'{c}', {c}" for c in ["places", *carry])
    entry = f"named_struct('bit', shiftleft(1L, CAST(__no % {WORD_RULES} AS INT)), {fields})"
    words = rules.groupBy(*by, F.expr(f"__no div {WORD_RULES}").alias("__word")).agg(F.expr(f"collect_list({entry})").alias("entries"))
    bits = f"aggregate(entries, 0L, (acc, e) -> acc | IF(get(e.places, CAST(p div {n_labels} AS INT)) = p, e.bit, 0L))"
    return words.selectExpr(*group, "block", "entries", f"transform(sequence(0, {n_places - 1}), p -> {bits}) AS sets")


def row_pairs(
    encoded: DataFrame, schema: RuleSchema, group, positions, keep, salt_by: Column | None, blocks: Blocks
) -> DataFrame:
    """Rows with their block and the list ``deg`` of their degrees.

    ``deg`` has, for every numeric feature, the places ``a`` and ``b`` of the two
    labels around the value and the degrees ``l`` and ``h`` in them; in all other
    labels the degree is 0. Nominal features are all part of the block. Rows
    without a block (unknown value) fall out of the join.
    """
    grid, n = Grid(schema), schema.n_labels
    if blocks.row_partitions:
        encoded = encoded.repartition(blocks.row_partitions)
    placed = place(encoded, grid, [*group, *keep], own=False)
    degrees = []
    for i in positions:
        if not schema.variables[i].is_numeric:
            continue
        k, first = k_col(i), n * len(degrees)
        low, high = f"{grid.low_label(i, k)} + {first}", f"{grid.high_label(i, k)} + {first}"
        degrees.append(f"named_struct('a', {low}, 'l', {lo_col(i)}, 'b', {high}, 'h', {hi_col(i)})")
    known = " AND ".join([f"{k_col(i)} >= 0" for i in blocks.block_on] or ["true"])
    block = pack([k_col(i) for i in blocks.block_on], [grid.n_cells(i) for i in blocks.block_on])
    out = placed.selectExpr(*group, *keep, f"IF({known}, {block}, NULL) AS block", f"array({', '.join(degrees)}) AS deg")
    if blocks.salts > 1:
        # Copies of one row spread by their input partition, the same on a rerun.
        spread = salt_by if salt_by is not None else F.xxhash64(F.spark_partition_id(), "deg")
        out = out.withColumn("salt", F.pmod(spread, F.lit(blocks.salts)).cast("int"))
    return out


def pair_degrees(rows: DataFrame, blocks: Blocks, group, out, every_row: bool = False) -> DataFrame:
    """Join rows and words of rules on the block; one row for each pair of positive degree.

    With ``every_row`` a row and word without such a pair give one row of degree
    0, and so does a row without rules: an aggregate over the pairs sees every row.
    """
    on = [*group, "block"] + (["salt"] if blocks.salts > 1 else [])
    table = F.broadcast(blocks.table) if blocks.broadcast else blocks.table
    either = "IF(d.l > 0D, get(sets, d.a), 0L) | IF(d.h > 0D, get(sets, d.b), 0L)"
    fired = f"aggregate(deg, -1L, (acc, d) -> IF(acc = 0L, 0L, acc & coalesce({either}, 0L)))"
    # The bit set is bound to a variable, so it is worked out once a word and not once an entry.
    found = f"transform(array({fired}), f -> IF(f = 0L, array(), filter(entries, e -> e.bit & f <> 0L)))"
    carried = [c for c in out if c in blocks.carry]
    others = [c for c in out if c not in blocks.carry]
    hits = rows.join(table, on, "left" if every_row else "inner").selectExpr(*group, *others, "deg", f"get({found}, 0) AS hits")
    pairs = hits.select(*group, *others, "deg", (F.explode_outer if every_row else F.explode)("hits").alias("e"))
    degree = "aggregate(zip_with(e.places, deg, (p, d) -> IF(p = d.a, d.l, d.h)), 1D, (acc, x) -> acc * x)"
    named = [f"e.{c} AS {c}" for c in carried]
    if every_row:
        return pairs.selectExpr(*group, *others, *named, f"coalesce({degree}, 0D) AS degree")
    return pairs.selectExpr(*group, *others, *named, f"{degree} AS degree").filter("degree > 0")
