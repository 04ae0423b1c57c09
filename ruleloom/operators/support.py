"""Class-wise support of candidate rules.

``group`` columns split the rows into independent learning sets (chunks, or
folds and chunks). A candidate is an antecedent some row of the set suggests;
its support for a class is the summed degree of that class's rows times the
class cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.dense import degree_sums
from ruleloom.operators.encode import CHUNK, CLASS, encode, own_labels, rule_key, x_col
from ruleloom.operators.grid import (
    Grid,
    corner_products,
    hi_col,
    k_col,
    lo_col,
    own_col,
    pack,
    place,
    unpack,
)
from ruleloom.operators.match import count_rules, pair_degrees, row_pairs, rule_blocks
from ruleloom.params import Params
from ruleloom.schema import RuleSchema
from ruleloom.session import cut_lineage

NO_LABEL = "*"


def candidate_rules(fuzzified: DataFrame, group=(CHUNK,)) -> DataFrame:
    """Distinct antecedents with the classes seen for them and the first row."""
    return fuzzified.groupBy(*group, "rule_key", CLASS).agg(F.min("row_id").alias("first_row"))


def cell_sums(encoded: DataFrame, schema: RuleSchema, group=(CHUNK,), weight_features: str = "all") -> DataFrame:
    """One row per (group, class, cell): the degree sum of every corner.

    This is the only step of learning that touches the rows. Each row is one
    probe of a hash aggregate whose size depends on the grid, not on the data;
    the partial sums are what gets shuffled. Columns: ``s`` (array of sums per
    corner) and ``seen`` (bit set of corners that rows of the cell suggest).
    """
    grid = Grid(schema)
    last = len(schema.variables) - 1
    keep = [*group, CLASS]
    df = place(encoded, grid, keep)
    if weight_features == "all_but_last" and schema.variables[last].is_numeric:
        df = df.withColumns({lo_col(last): F.lit(1.0), hi_col(last): F.lit(1.0)})

    # Features beyond the core: two rows each, one per reachable label.
    if grid.exploded:
        df = df.withColumns({"__deg": F.lit(1.0), "__own": F.lit(1)})
    for i in grid.exploded:
        k, own = k_col(i), own_col(i)
        rest = [c for c in df.columns if c not in (k, own, lo_col(i), hi_col(i), "__deg", "__own")]
        sides = (
            f"inline(array(named_struct('k', {grid.low_label(i, k)}, 'd', __deg * {lo_col(i)}, 'o', __own * (1 - {own})),"
            f" named_struct('k', {grid.high_label(i, k)}, 'd', __deg * {hi_col(i)}, 'o', __own * {own})))"
            f" AS ({k}, __deg, __own)"
        )
        df = df.selectExpr(*rest, sides).filter("__deg > 0 OR __own = 1")

    corner = " + ".join([f"{own_col(i)} * {1 << j}" for j, i in enumerate(grid.core)] or ["0"])
    bit = f"shiftleft(1L, {corner})"
    if grid.exploded:
        bit = f"IF(__own = 1, {bit}, 0L)"
    key = pack([k_col(i) for i in range(len(schema.variables))], cell_radices(grid))
    degrees = [c for i in grid.core for c in (lo_col(i), hi_col(i))] + ["__deg"] * bool(grid.exploded)
    products = corner_products(grid.core, "__deg" if grid.exploded else "")
    agg = (
        df.selectExpr(*keep, f"{key} AS cell", f"{bit} AS __seen", *degrees)
        .groupBy(*keep, "cell")
        .agg(F.expr("bit_or(__seen) AS seen"), *[F.expr(f"sum({p}) AS __p{b}") for b, p in enumerate(products)])
    )
    sums = ", ".join(f"__p{b}" for b in range(len(products)))
    return agg.selectExpr(*keep, "cell", "seen", f"array({sums}) AS s")


def cell_radices(grid: Grid) -> list[int]:
    """Index ranges of a learning cell: labels for exploded features, cells else."""
    return [
        grid.schema.n_labels if i in grid.exploded else grid.n_cells(i)
        for i in range(len(grid.schema.variables))
    ]


def corner_support(cells: DataFrame, schema: RuleSchema, group=(CHUNK,), weight_features: str = "all") -> DataFrame:
    """Cell sums to ``(group, rule_key, class_idx, degree_sum)`` of seen rules.

    Works on the grid table only. With ``all_but_last`` the last feature takes
    no part in the degree, so a rule's sum runs over all rows that share its
    antecedent without that feature.
    """
    grid = Grid(schema)
    last = len(schema.variables) - 1
    skip_last = weight_features == "all_but_last"
    indices = unpack("cell", cell_radices(grid))
    spread = cells.selectExpr(
        *group, CLASS, "seen", *[f"{e} AS {k_col(i)}" for i, e in enumerate(indices)], "posexplode(s) AS (b, deg)"
    )
    labels = []
    for i in range(len(schema.variables)):
        k = k_col(i)
        if i in grid.core:
            up = f"getbit(b, {grid.core.index(i)}) = 1"
            labels.append(f"IF({up}, {grid.high_label(i, k)}, {grid.low_label(i, k)})")
        else:
            labels.append(k)
    # The two corners that differ in a skipped numeric feature carry the same
    # sum; one of them counts.
    deg = f"IF(getbit(b, {grid.core.index(last)}) = 1, 0D, deg)" if skip_last and last in grid.core else "deg"
    corners = spread.selectExpr(
        *group,
        CLASS,
        f"concat_ws('|', {', '.join(f'CAST({x} AS STRING)' for x in labels)}) AS rule_key",
        f"concat_ws('|', {', '.join([f'CAST({x} AS STRING)' for x in labels[:-1]] + [repr(NO_LABEL)])}) AS prefix",
        f"{deg} AS deg",
        "getbit(seen, b) = 1 AS own",
    )
    if not skip_last:
        sums = corners.groupBy(*group, "rule_key", CLASS).agg(
            F.sum("deg").alias("degree_sum"), F.max("own").alias("own")
        )
        return sums.filter("own").drop("own")
    sums = corners.groupBy(*group, "prefix", "rule_key", CLASS).agg(
        F.sum("deg").alias("deg"), F.max("own").alias("own")
    )
    w = Window.partitionBy(*group, "prefix", CLASS)
    return (
        sums.withColumn("degree_sum", F.sum("deg").over(w)).filter("own").select(*group, "rule_key", CLASS, "degree_sum")
    )


def blocked_support(encoded: DataFrame, schema: RuleSchema, params: Params, group=(CHUNK,)) -> DataFrame:
    """The same result for many numeric features, where corners are too many.

    Candidates come first (the labels of the rows); rows then meet only the
    candidates of their own block, an equi-join on the cells of a few features,
    and the remaining degrees are multiplied per pair. Sums are taken on the
    map side before the shuffle. Where no feature parts the candidates, rows meet
    all of them in tiles.
    """
    group = list(group)
    seen = encoded.select(*group, CLASS, rule_key(own_labels(schema)).alias("rule_key")).distinct()
    seen = cut_lineage(seen)
    rules = seen.groupBy(*group, "rule_key").agg(F.collect_list(CLASS).alias("classes"))
    positions = list(range(len(schema.variables)))
    if params.weight_features == "all_but_last":
        positions = positions[:-1]
    counted = count_rules(rules.withColumn("__no", F.monotonically_increasing_id()), schema, positions)
    if counted.block_on:
        blocks = rule_blocks(counted, schema, params, group, positions, carry=["rule_key"])
        rows = row_pairs(encoded, schema, group, positions, keep=[CLASS], salt_by=None, blocks=blocks)
        hits = pair_degrees(rows, blocks, group, [CLASS, "rule_key"])
        sums = hits.groupBy(*group, "rule_key", CLASS).agg(F.sum("degree").alias("degree_sum"))
    else:
        sums = degree_sums(encoded, counted, schema, group, positions)
    return seen.join(sums, [*group, "rule_key", CLASS], "left").select(
        *group, "rule_key", CLASS, F.coalesce("degree_sum", F.lit(0.0)).alias("degree_sum")
    )


def rule_support(
    df: DataFrame, schema: RuleSchema, params: Params = Params(), chunk=None, group=(CHUNK,), keep=()
) -> DataFrame:
    """``(group, rule_key, class_idx, support)`` of every class seen with a rule."""
    keep = list(keep) + [(chunk if chunk is not None else F.lit(0)).alias(CHUNK)]
    encoded = encode(df, schema, keep, params.bad_rows)
    if Grid(schema).is_small:
        sums = corner_support(
            cell_sums(encoded, schema, group, params.weight_features), schema, group, params.weight_features
        )
    else:
        sums = blocked_support(encoded, schema, params, group)
    return with_costs(sums, schema, params)


def with_costs(sums: DataFrame, schema: RuleSchema, params: Params) -> DataFrame:
    """Degree sums times the cost of their class (costs use whole-table counts)."""
    costs = F.array(*[F.lit(float(c)) for c in schema.class_costs(params.cost_sensitive)])
    return sums.withColumn("support", F.col("degree_sum") * F.get(costs, F.col(CLASS))).drop("degree_sum")
