"""Classifying rows with a rule base.

Rows are looked up by grid cell: one row in, one row out, no regrouping. The
cell table holds the few rules on a cell's corners and is derived from the rule
base. It is broadcast when its size is bounded by the grid or by the counted
rules; otherwise it is joined by shuffle with salted rows. Only tables with many
numeric features need pairs of rows and rules, which are reduced per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.membership import association
from ruleloom.operators.dense import row_votes
from ruleloom.operators.encode import CLASS, antecedents_of, encode
from ruleloom.operators.grid import CORE, Grid, corner_products, hi_col, k_col, lo_col, pack, place
from ruleloom.operators.match import count_rules, pair_degrees, reach, row_pairs, rule_blocks
from ruleloom.params import Params
from ruleloom.schema import RuleSchema

CORNER_BYTES = 24
UNROLL_TERMS = 128
ROW = "__row"


def default_index(schema: RuleSchema, params: Params) -> int:
    return schema.most_frequent_class if params.default_class == "most_frequent" else 0


def cell_radices(grid: Grid) -> list[int]:
    return [grid.n_cells(i) for i in range(len(grid.schema.variables))]


def cell_rules(rules: DataFrame, schema: RuleSchema, group=(), extra=()) -> DataFrame:
    """Rules laid out by the cells they can fire in: ``(group, cell, fired)``.

    A rule touches at most two cells per numeric feature and a cell has at most
    ``2**numeric`` corners, so the collected list is bounded by the grid. Entry:
    ``(corner, c, w)`` plus ``extra`` columns.
    """
    grid = Grid(schema)
    df = rules.select(*group, CLASS, "weight", *extra, antecedents_of(F.col("rule_key")).alias("ants"))
    cells, corner = [], ["0"]
    for i in range(len(schema.variables)):
        if schema.variables[i].is_numeric:
            df = reach(df, grid, i)
            cells.append(f"__c{i}")
            corner.append(f"__b{i} * {1 << grid.numeric.index(i)}")
        else:
            cells.append(f"get(ants, {i})")
    named = "".join(f", '{c}', {c}" for c in extra)
    entry = f"named_struct('corner', {' + '.join(corner)}, 'c', {CLASS}, 'w', weight{named}) AS e"
    df = df.selectExpr(*group, f"{pack(cells, cell_radices(grid))} AS cell", entry)
    return df.groupBy(*group, "cell").agg(F.collect_list("e").alias("fired"))


def _dense(table: DataFrame, grid: Grid, n_classes: int, group) -> DataFrame:
    """One column ``w{b}`` per corner (0 where no rule sits) and, per class, the
    bit set ``m`` of the corners whose rule has that class."""
    n = 1 << len(grid.numeric)
    at = "try_element_at(map_from_entries(transform(fired, e -> struct(e.corner, e.w))), b)"
    bits = "aggregate(fired, 0L, (acc, e) -> acc | IF(e.c = k, shiftleft(1L, e.corner), 0L))"
    return table.selectExpr(
        *group,
        "cell",
        f"transform(sequence(0, {n - 1}), b -> coalesce({at}, 0D)) AS w",
        f"transform(sequence(0, {n_classes - 1}), k -> {bits}) AS m",
    ).selectExpr(*group, "cell", "m", *[f"w[{b}] AS w{b}" for b in range(n)])


def table_fits(rules: DataFrame, grid: Grid, params: Params, n_groups: int = 1) -> bool:
    """Whether the cell table is small enough to broadcast.

    The grid bounds it without running anything; only a large grid makes the
    rules be counted.
    """
    corners = 1 << len(grid.numeric)
    # A cell carries its corners and a bit set per class; a corner may carry its rule's key.
    cell = corners * (CORNER_BYTES + 4 * len(grid.schema.variables)) + 8 * len(grid.schema.classes)
    bound = n_groups
    for r in cell_radices(grid):
        bound *= r
    if bound * cell <= params.broadcast_bytes:
        return True
    return rules.count() * corners * cell <= params.broadcast_bytes


def place_rows(encoded: DataFrame, grid: Grid, keep) -> DataFrame:
    """Rows with their packed cell (null for unknown values) and degrees."""
    placed = place(encoded, grid, keep, own=False)
    cell = pack([k_col(i) for i in range(len(grid.schema.variables))], cell_radices(grid))
    known = " AND ".join(f"{k_col(i)} >= 0" for i in grid.schema.nominal_positions)
    if known:
        cell = f"IF({known}, {cell}, NULL)"
    degrees = [c for i in grid.numeric for c in (lo_col(i), hi_col(i))]
    if len(grid.numeric) > CORE:
        degrees = [c for i in grid.numeric[CORE:] for c in (lo_col(i), hi_col(i))]
        degrees.append(f"array({', '.join(corner_products(grid.numeric[:CORE]))}) AS __front")
    return placed.selectExpr(*keep, f"{cell} AS cell", *degrees)


def look_up(rows: DataFrame, table: DataFrame, fits: bool, params: Params, group, how: str = "left") -> DataFrame:
    """Join rows to the cell table; a large table is repeated per salt bucket so
    that the rows of one hot cell spread over many tasks.

    The bucket depends on the row's values and its input partition: copies of one
    row spread too, and a task that runs again takes the same buckets.
    """
    on = [*group, "cell"]
    if fits:
        return rows.join(F.broadcast(table), on, how)
    salts = params.salt_buckets
    mixed = [*on, *[c for c in rows.columns if c.startswith(("__l", "__h"))]]
    spread = F.xxhash64(F.spark_partition_id(), *mixed)
    rows = rows.withColumn("salt", F.pmod(spread, F.lit(salts)).cast("int"))
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(table, [*on, "salt"], how).drop("salt")


def corner_degree(grid: Grid, corner: str) -> str:
    """SQL for the degree of a corner whose number is known only at run time."""
    factors = [
        f"IF(getbit({corner}, {j}) = 1, {hi_col(i)}, {lo_col(i)})" for j, i in enumerate(grid.numeric)
    ]
    if len(factors) > CORE:
        # The front of the product is ready for every row, see place_rows.
        factors[:CORE] = [f"get(__front, {corner} & {(1 << CORE) - 1})"]
    return " * ".join(factors) or "1D"


def choose(df: DataFrame, keep, n_corners: int, n_classes: int, inference: str, default: int) -> DataFrame:
    """Prediction from the associations ``__a*`` of all corners and the class bits.

    Equal degrees go to the lowest class; no degree above zero to the default.
    The strongest corners are gathered as a bit set and met with the class bits:
    short code, since a longer method would not be compiled by the JVM.
    """
    a = [f"__a{b}" for b in range(n_corners)]
    if inference == "winning_rule":
        top = f"greatest({', '.join(a)})" if n_corners > 1 else a[0]
        df = df.selectExpr(*keep, *a, "m", f"{top} AS degree")
        best = " | ".join(f"IF({x} >= degree, {1 << b}L, 0L)" for b, x in enumerate(a))
        df = df.selectExpr(*keep, "m", "degree", f"IF(degree > 0D, {best}, 0L) AS best")
        whens = " ".join(f"WHEN get(m, {k}) & best <> 0L THEN {k}" for k in range(n_classes))
        return df.selectExpr(*keep, f"CASE {whens} ELSE {default} END AS predicted", "degree")
    votes = [
        " + ".join(f"IF(get(m, {k}) & {1 << b}L <> 0L, {x}, 0D)" for b, x in enumerate(a)) + f" AS __v{k}"
        for k in range(n_classes)
    ]
    return vote(df.selectExpr(*keep, *votes), keep, n_classes, default)


def vote(df: DataFrame, keep, n_classes: int, default: int) -> DataFrame:
    """Prediction from the summed votes ``__v*`` per class.

    Votes are compared as shares of the row's largest one, to 12 places: however
    small a product of many degrees gets, the order of its votes stays.
    """
    votes = [f"__v{k}" for k in range(n_classes)]
    df = df.selectExpr(*keep, *votes, f"array_max(array({', '.join(votes)})) AS __top")
    entries = ", ".join(
        f"named_struct('t', IF(__top > 0D, floor({v} / __top * 1e12D + 0.5D), 0L), 'c', {-k}, 'a', {v})"
        for k, v in enumerate(votes)
    )
    df = df.selectExpr(*keep, f"array_max(array({entries})) AS b")
    return df.selectExpr(
        *keep,
        f"CAST(IF(b.t > 0, -b.c, {default}) AS INT) AS predicted",
        "IF(b.t > 0, b.a, 0D) AS degree",
    )


def choose_listed(df: DataFrame, keep, grid: Grid, n_classes: int, inference: str, default: int) -> DataFrame:
    """As :func:`choose`, over the list ``fired`` of ``(corner, c, w)`` entries."""
    scored = f"transform(fired, e -> named_struct('a', {corner_degree(grid, 'e.corner')} * e.w, 'c', -e.c))"
    if inference == "winning_rule":
        df = df.selectExpr(*keep, f"array_max({scored}) AS b")
        return df.selectExpr(
            *keep,
            f"CAST(IF(coalesce(b.a > 0D, false), -b.c, {default}) AS INT) AS predicted",
            "IF(coalesce(b.a > 0D, false), b.a, 0D) AS degree",
        )
    total = "coalesce(aggregate(s, 0D, (acc, e) -> acc + IF(e.c = {k}, e.a, 0D)), 0D) AS __v{j}"
    df = df.selectExpr(*keep, f"{scored} AS s")
    df = df.selectExpr(*keep, *[total.format(k=-k, j=k) for k in range(n_classes)])
    return vote(df, keep, n_classes, default)


def score_encoded(
    encoded: DataFrame, schema: RuleSchema, rules: DataFrame, params: Params, keep, group=(), n_groups: int = 1
) -> DataFrame:
    """``keep`` columns plus ``predicted`` and ``degree``; few numeric features."""
    grid = Grid(schema)
    default = default_index(schema, params)
    n_classes = len(schema.classes)
    keep, group = list(keep), list(group)
    carried = list(dict.fromkeys([*group, *keep]))
    rows = place_rows(encoded, grid, carried)
    table = cell_rules(rules, schema, group)
    fits = table_fits(rules, grid, params, n_groups)
    n_corners = 1 << len(grid.numeric)
    terms = n_corners * (1 if params.inference == "winning_rule" else n_classes)
    if len(grid.numeric) > CORE or terms > UNROLL_TERMS:
        hit = look_up(rows, table, fits, params, group)
        return choose_listed(hit, keep, grid, n_classes, params.inference, default)
    hit = look_up(rows, _dense(table, grid, n_classes, group), fits, params, group)
    products = [
        f"{p} * coalesce(w{b}, 0D) AS __a{b}" for b, p in enumerate(corner_products(grid.numeric))
    ]
    return choose(
        hit.selectExpr(*keep, *products, "m"), keep, n_corners, n_classes, params.inference, default
    )


def score_models(
    df: DataFrame, schema: RuleSchema, rules: DataFrame, params: Params, row_id: str, group: str, n_models: int, models
) -> DataFrame:
    """Every row by each model that ``models``, an array column over ``df``, names:
    ``(row_id, group, actual, predicted, degree)``.

    ``rules`` holds models numbered from 0 in the column ``group``. A cell's entries of all
    models are one row of the cell table: a row is encoded, placed and looked up once, also
    where the table is shuffled, and is repeated per model behind the join only. A model
    without rules in a cell gives the default class. For few numeric features.
    """
    grid, default, n_classes = Grid(schema), default_index(schema, params), len(schema.classes)
    cols = [F.col(row_id).alias("row_id"), models.alias("__models")]
    rows = encode(df, schema, cols, params.bad_rows, learning=False).withColumnRenamed(CLASS, "actual")
    rows = place_rows(rows, grid, ["row_id", "__models", "actual"])
    table = cell_rules(rules, schema, [group])
    n_corners = 1 << len(grid.numeric)
    terms = n_corners * (1 if params.inference == "winning_rule" else n_classes)
    dense = len(grid.numeric) <= CORE and terms <= UNROLL_TERMS
    if dense:
        table = _dense(table, grid, n_classes, [group])
    entry = [c for c in table.columns if c not in (group, "cell")]
    packed = table.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct(group, F.struct(*entry)))).alias("e"))
    by_cell = packed.selectExpr("cell", f"transform(sequence(0, {n_models - 1}), k -> try_element_at(e, k)) AS __entries")
    hit = look_up(rows, by_cell, table_fits(rules, grid, params, n_models), params, [])
    degrees = [c for c in rows.columns if c not in ("row_id", "__models", "actual", "cell")]
    each = hit.selectExpr("row_id", "actual", *degrees, "__entries", f"explode(__models) AS {group}")
    each = each.withColumn("__e", F.get("__entries", F.col(group).cast("int")))
    out = ["row_id", group, "actual"]
    if not dense:
        each = each.selectExpr(*out, *degrees, "__e.fired AS fired")
        return choose_listed(each, out, grid, n_classes, params.inference, default)
    products = [f"{p} * coalesce(__e.w{b}, 0D) AS __a{b}" for b, p in enumerate(corner_products(grid.numeric))]
    return choose(
        each.selectExpr(*out, *products, "__e.m AS m"), out, n_corners, n_classes, params.inference, default
    )


def fired_rules(
    encoded: DataFrame, schema: RuleSchema, rules: DataFrame, params: Params, row_id: str, keep=(), group=()
) -> DataFrame:
    """Every (row, rule) pair of positive association:
    ``(row_id, keep, group, rule_key, rule_class, degree, assoc)``."""
    grid, group = Grid(schema), list(group)
    carried = list(dict.fromkeys([*group, row_id, *keep]))
    if grid.is_small:
        table = cell_rules(rules, schema, group, extra=["rule_key"])
        n_groups = 1 if not group else rules.select(*group).distinct().count()
        rows = place_rows(encoded, grid, carried)
        hit = look_up(rows, table, table_fits(rules, grid, params, n_groups), params, group, "inner")
        hit = hit.withColumn("e", F.explode("fired"))
        pairs = hit.selectExpr(
            *carried,
            "e.rule_key AS rule_key",
            "e.c AS rule_class",
            f"{corner_degree(grid, 'e.corner')} AS degree",
            "e.w AS w",
        )
    else:
        positions = list(range(len(schema.variables)))
        named = rules.select(*group, "rule_key", F.col(CLASS).alias("rule_class"), F.col("weight").alias("w"))
        counted = count_rules(named, schema, positions)
        blocks = rule_blocks(counted, schema, params, group, positions, ["rule_key", "rule_class", "w"])
        others = [c for c in carried if c not in group]
        rows = row_pairs(encoded, schema, group, positions, others, F.xxhash64(row_id), blocks)
        pairs = pair_degrees(rows, blocks, group, [*others, "rule_key", "rule_class", "w"])
    return (
        pairs.withColumn("assoc", association(F.col("degree"), F.col("w"))).filter(F.col("assoc") > 0).drop("w")
    )


def score_pairs(
    encoded: DataFrame, schema: RuleSchema, rules: DataFrame, params: Params, keep, group=()
) -> DataFrame:
    """Scoring for many numeric features: one pass over row and rule pairs.

    Per row and class the strongest association or the sum is kept, in plain
    double columns that a hash aggregate combines on the map side. Rows are told
    apart by a number of their own, set where they are read, so rows with equal
    ids stay rows. Rows no rule reaches stay in through the outer join and get
    the default class. Where no feature parts the rules, rows meet all of them in
    tiles.
    """
    encoded = encoded.withColumn(ROW, F.monotonically_increasing_id())
    group = list(group)
    default, n_classes = default_index(schema, params), len(schema.classes)
    positions = list(range(len(schema.variables)))
    named = rules.select(*group, "rule_key", F.col(CLASS).alias("rule_class"), F.col("weight").alias("w"))
    counted = count_rules(named, schema, positions)
    others = [c for c in dict.fromkeys([ROW, *keep]) if c not in group]
    if not counted.block_on:
        found = row_votes(encoded, counted, schema, params.inference, group, others, ROW)
        if params.inference == "additive":
            return vote(found, keep, n_classes, default)
        return found.selectExpr(*keep, f"IF(degree > 0D, winner, {default}) AS predicted", "degree")
    blocks = rule_blocks(counted, schema, params, group, positions, ["rule_class", "w"])
    rows = row_pairs(encoded, schema, group, positions, others, F.xxhash64(ROW), blocks)
    pairs = pair_degrees(rows, blocks, group, [*others, "rule_class", "w"], every_row=True)
    take = "max" if params.inference == "winning_rule" else "sum"
    votes = [
        F.expr(f"{take}(IF(coalesce(rule_class = {k}, false), degree * w, 0D)) AS __v{k}") for k in range(n_classes)
    ]
    per_row = pairs.groupBy(*group, *others).agg(*votes)
    if params.inference == "additive":
        return vote(per_row, keep, n_classes, default)
    names = [f"__v{k}" for k in range(n_classes)]
    top = per_row.selectExpr(*keep, *names, f"greatest({', '.join(names)}) AS degree")
    whens = " ".join(f"WHEN {v} = degree THEN {k}" for k, v in enumerate(names))
    return top.selectExpr(*keep, f"IF(degree > 0D, CASE {whens} END, {default}) AS predicted", "degree")


def score(
    df: DataFrame,
    schema: RuleSchema,
    rules: DataFrame,
    params: Params = Params(),
    row_id: str | None = None,
    keep=(),
    group=(),
    n_groups: int = 1,
    with_actual: bool = True,
) -> DataFrame:
    """Predict every row of ``df``: ``(row_id, keep, actual, predicted, degree)``.

    Rows of an unknown class are skipped when ``with_actual``; without it the
    label column is not needed. ``row_id`` is optional and need not be unique.
    ``group`` names columns that pick a rule base per row.
    """
    cols = [F.col(row_id).alias("row_id")] if row_id else []
    cols += [F.col(c) for c in dict.fromkeys([*keep, *group])]
    out = (["row_id"] if row_id else []) + list(keep)
    encoded = encode(df, schema, cols, params.bad_rows, learning=False, need_class=with_actual)
    if with_actual:
        encoded = encoded.withColumnRenamed(CLASS, "actual")
        out.append("actual")
    if Grid(schema).is_small:
        return score_encoded(encoded, schema, rules, params, out, group, n_groups)
    return score_pairs(encoded, schema, rules, params, out, group)
