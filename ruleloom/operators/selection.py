"""Evolutionary rule selection with the population held as a table.

All chunks advance together, one generation at a time. A chromosome is the set
of rules it switches on: ``(chunk_id, chrom_id, rule_key, active)``. Random
draws are md5 digests of the seed and the keys, so a lost task that runs again
draws the same values.

Fitness never goes back to the rows. Before the first generation each row is
reduced to its ranking: the rules that fire on it, strongest first. Which class
a chromosome gives the row depends only on that ranking, so equal rankings are
counted once and the generations work on the counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.membership import stable
from ruleloom.operators.encode import CHUNK, CLASS, chunk_of, encode
from ruleloom.operators.grid import Grid
from ruleloom.operators.ranking import numbered
from ruleloom.operators.score import cell_rules, corner_degree, default_index, fired_rules, look_up, place_rows, table_fits
from ruleloom.operators.weights import keep_rules
from ruleloom.params import Params
from ruleloom.schema import RuleSchema
from ruleloom.session import cut_lineage, write_out

# The bits per gene that set how fast the restart threshold falls,
# and the number of restarts without progress that ends a search.
BITS_PER_GENE = 62
MAX_RESETS = 3
WORD_BITS = 62
# Above this many possible rules per chunk, genes are ranked bucket by bucket.
ONE_WINDOW_RULES = 200_000


def draw(seed: int, generation: int, *keys) -> Column:
    """A uniform 32-digit hexadecimal text that depends on its arguments only."""
    parts = [F.lit(seed), F.lit(generation), *[F.lit(k) if isinstance(k, str) else k for k in keys]]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def coin(digest: Column) -> Column:
    return (digest < "8").cast("int")


def init_population(rules: DataFrame, pop_size: int, seed: int, generation: int = 0) -> DataFrame:
    """Chromosome 0 keeps every rule, the others each rule with even odds."""
    genes = rules.select(CHUNK, "rule_key").withColumn(
        "chrom_id", F.explode(F.sequence(F.lit(0), F.lit(pop_size - 1)))
    )
    bit = coin(draw(seed, generation, F.col(CHUNK), F.col("chrom_id"), F.col("rule_key")))
    return genes.select(
        CHUNK, "chrom_id", "rule_key", F.when(F.col("chrom_id") == 0, 1).otherwise(bit).alias("active")
    )


def pair_chromosomes(chromosomes: DataFrame, seed: int, generation: int) -> DataFrame:
    """Random pairs: ``(chunk_id, chrom_id, pair, side)``; an odd one is left out."""
    order = draw(seed, generation, "pair", F.col(CHUNK), F.col("chrom_id"))
    by_chunk = Window.partitionBy(CHUNK)
    ranked = chromosomes.select(
        CHUNK,
        "chrom_id",
        (F.row_number().over(by_chunk.orderBy(order, "chrom_id")) - 1).alias("at"),
        F.count(F.lit(1)).over(by_chunk).alias("n"),
    )
    paired = ranked.filter(F.col("at") < F.col("n") - F.col("n") % 2)
    return paired.select(
        CHUNK, "chrom_id", F.floor(F.col("at") / 2).cast("int").alias("pair"), (F.col("at") % 2).alias("side")
    )


def rank_in_group(df: DataFrame, group, digest: str, tie: str, small: bool) -> DataFrame:
    """Add ``place`` (1-based, by digest) and ``size`` within each group.

    A group too large for one task is cut into 256 digest buckets: the buckets
    are counted, and rows are ranked inside their bucket only.
    """
    if small:
        whole = Window.partitionBy(*group)
        return df.withColumns(
            {
                "place": F.row_number().over(whole.orderBy(digest, tie)),
                "size": F.count(F.lit(1)).over(whole),
            }
        )
    df = df.withColumn("__bucket", F.substring(digest, 1, 2))
    counts = df.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns(
        {
            "__before": F.coalesce(F.sum("__n").over(up_to), F.lit(0)),
            "size": F.sum("__n").over(Window.partitionBy(*group)),
        }
    ).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*group, "__bucket").orderBy(digest, tie))
    return (
        df.withColumn("__in", inside)
        .join(counts, [*group, "__bucket"])
        .withColumn("place", F.col("__before") + F.col("__in"))
        .drop("__bucket", "__before", "__in")
    )


def hux(population: DataFrame, pairs: DataFrame, seed: int, generation: int, first_id: int, small: bool = True) -> DataFrame:
    """Cross every pair by swapping half of the genes in which it differs.

    The genes to swap are the first half in digest order (one at least), drawn
    without replacement. Children are numbered from ``first_id``.
    """
    genes = population.join(pairs, [CHUNK, "chrom_id"])
    sides = genes.groupBy(CHUNK, "pair", "rule_key").agg(
        F.max(F.when(F.col("side") == 0, F.col("active"))).alias("mom"),
        F.max(F.when(F.col("side") == 1, F.col("active"))).alias("dad"),
    )
    sides = sides.withColumns(
        {
            "differs": (F.col("mom") != F.col("dad")).cast("int"),
            "digest": draw(seed, generation, "hux", F.col(CHUNK), F.col("pair"), F.col("rule_key")),
        }
    )
    ranked = rank_in_group(sides, [CHUNK, "pair", "differs"], "digest", "rule_key", small)
    half = F.greatest(F.lit(1), F.floor(F.col("size") / 2))
    swap = (F.col("differs") == 1) & (F.col("place") <= half)
    children = F.array(
        F.struct(
            (F.lit(first_id) + 2 * F.col("pair")).alias("chrom_id"),
            F.when(swap, F.col("dad")).otherwise(F.col("mom")).alias("active"),
        ),
        F.struct(
            (F.lit(first_id + 1) + 2 * F.col("pair")).alias("chrom_id"),
            F.when(swap, F.col("mom")).otherwise(F.col("dad")).alias("active"),
        ),
    )
    return ranked.select(CHUNK, "rule_key", F.explode(children).alias("k")).select(
        CHUNK, F.col("k.chrom_id").alias("chrom_id"), "rule_key", F.col("k.active").alias("active")
    )


def signatures(population: DataFrame) -> DataFrame:
    """Two independent 64-bit hashes and the size of each active rule set."""
    on = F.col("active") == 1
    return population.groupBy(CHUNK, "chrom_id").agg(
        F.coalesce(F.bit_xor(F.when(on, F.xxhash64("rule_key"))), F.lit(0)).alias("s1"),
        F.coalesce(F.bit_xor(F.when(on, F.xxhash64(F.lit("second"), "rule_key"))), F.lit(0)).alias("s2"),
        F.sum("active").alias("n_selected"),
    )


def new_chromosomes(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children whose rule set no parent and no earlier child has."""
    same = [CHUNK, "s1", "s2", "n_selected"]
    first = signatures(children).groupBy(*same).agg(F.min("chrom_id").alias("chrom_id"))
    return first.join(signatures(parents).select(*same).distinct(), same, "left_anti").select(CHUNK, "chrom_id")


@dataclass(frozen=True)
class Evidence:
    """What fitness needs to know about the rows.

    ``rankings`` has one row per distinct ``(chunk_id, actual, ranking)`` with its
    count ``n``; ``pairs`` has the fired rules of every row. ``totals`` counts
    rows per chunk and class. Rankings serve the winning rule on few numeric
    features; additive votes, wide tables and very large rule bases use pairs.
    """

    totals: DataFrame
    rankings: DataFrame | None = None
    pairs: DataFrame | None = None


def number_rules(chunk_rules: DataFrame) -> DataFrame:
    """Rules numbered from 0 within their chunk, in key order."""
    return numbered(chunk_rules, ["rule_key"], "rule_no", [CHUNK]).withColumn("rule_no", F.col("rule_no").cast("int"))


def row_rankings(
    df: DataFrame, schema: RuleSchema, chunk_rules: DataFrame, params: Params, row_id: str | None, chunk=None
) -> DataFrame:
    """Rows reduced to ``(chunk_id, actual, ranking, n)``.

    A ranking lists ``(class, rule number)`` of the fired rules, strongest first,
    lower class first on equal strength. One pass over the rows, combined
    map-side before the shuffle.
    """
    grid = Grid(schema)
    chunk = chunk if chunk is not None else chunk_of(df, row_id, params.n_chunks, params)
    rows = encode(df, schema, [chunk.alias(CHUNK)], params.bad_rows).withColumnRenamed(CLASS, "actual")
    table = cell_rules(number_rules(chunk_rules), schema, [CHUNK], extra=["rule_no"])
    placed = place_rows(rows, grid, [CHUNK, "actual"])
    hit = look_up(placed, table, table_fits(chunk_rules, grid, params, params.n_chunks), params, [CHUNK])

    scored = (
        f"transform(fired, e -> named_struct('s', -({corner_degree(grid, 'e.corner')} * e.w),"
        " 'c', e.c, 'rule_no', e.rule_no))"
    )
    ordered = f"array_sort(filter({scored}, e -> e.s < 0))"
    ranking = F.expr(f"transform({ordered}, e -> named_struct('c', e.c, 'rule_no', e.rule_no))")
    empty = F.array().cast("array<struct<c:int,rule_no:int>>")
    return (
        hit.select(CHUNK, "actual", F.coalesce(ranking, empty).alias("ranking"))
        .groupBy(CHUNK, "actual", "ranking")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def gather_evidence(
    df: DataFrame, schema: RuleSchema, chunk_rules: DataFrame, params: Params, row_id: str, chunk=None
) -> Evidence:
    words = -(-2 * params.pop_size // WORD_BITS)
    masks_fit = chunk_rules.count() * words * 8 <= params.broadcast_bytes
    if Grid(schema).is_small and params.inference == "winning_rule" and masks_fit:
        rankings = cut_lineage(row_rankings(df, schema, chunk_rules, params, row_id, chunk))
        totals = rankings.groupBy(CHUNK, "actual").agg(F.sum("n").alias("n"))
        return Evidence(totals, rankings=rankings)
    where = chunk if chunk is not None else chunk_of(df, row_id, params.n_chunks, params)
    rows = encode(df, schema, [F.col(row_id).alias("row_id"), where.alias(CHUNK)], params.bad_rows)
    rows = rows.withColumnRenamed(CLASS, "actual")
    pairs = fired_rules(rows, schema, chunk_rules, params, "row_id", keep=["actual"], group=[CHUNK])
    totals = rows.groupBy(CHUNK, "actual").agg(F.count(F.lit(1)).alias("n"))
    return Evidence(cut_lineage(totals), pairs=cut_lineage(pairs))


def chromosome_masks(population: DataFrame) -> DataFrame:
    """``(chunk_id, word, masks, present)``: per rule, in key order, the bit set of
    the chromosomes that use it. A word holds 62 chromosomes."""
    slot = (F.col("chrom_id") % WORD_BITS).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)
    none = F.lit(0).cast("bigint")
    per_rule = population.groupBy(
        CHUNK, F.floor(F.col("chrom_id") / WORD_BITS).cast("int").alias("word"), "rule_key"
    ).agg(
        F.bit_or(F.when(F.col("active") == 1, bit).otherwise(none)).alias("mask"), F.bit_or(bit).alias("present")
    )
    packed = per_rule.groupBy(CHUNK, "word").agg(
        F.array_sort(F.collect_list(F.struct("rule_key", "mask"))).alias("m"), F.bit_or("present").alias("present")
    )
    return packed.select(CHUNK, "word", F.transform("m", lambda e: e["mask"]).alias("masks"), "present")


def _outcomes_from_rankings(evidence: Evidence, population: DataFrame, default: int) -> DataFrame:
    """``(chunk_id, chrom_id, actual, is_pos, is_hit, n)`` from bit sets.

    Folding a ranking hands each chromosome to its first active rule, all
    chromosomes of a word at once. The masks are small (checked before rankings
    are chosen), so the rankings stay where they are.
    """
    none = F.lit(0).cast("bigint")
    start = F.struct(F.lit(-1).cast("bigint").alias("rem"), none.alias("pos"), none.alias("ok"))

    def step(acc, e):
        mask = F.get("masks", e["rule_no"])
        won = acc["rem"].bitwiseAND(mask)
        return F.struct(
            acc["rem"].bitwiseAND(F.bitwise_not(mask)).alias("rem"),
            acc["pos"].bitwiseOR(F.when(e["c"] == 0, won).otherwise(none)).alias("pos"),
            acc["ok"].bitwiseOR(F.when(e["c"] == F.col("actual"), won).otherwise(none)).alias("ok"),
        )

    rest = F.col("f.rem")
    pos = F.col("f.pos").bitwiseOR(rest if default == 0 else none)
    ok = F.col("f.ok").bitwiseOR(F.when(F.col("actual") == default, rest).otherwise(none))
    sums = (
        evidence.rankings.join(F.broadcast(chromosome_masks(population)), CHUNK)
        .withColumn("f", F.aggregate("ranking", start, step))
        .select(CHUNK, "word", "present", "actual", pos.alias("pos"), ok.alias("ok"), "n")
    )
    slots = F.filter(
        F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda p: F.getbit(F.col("present"), p) == 1
    )
    each = sums.withColumn("slot", F.explode(slots))
    return each.select(
        CHUNK,
        (F.col("word") * WORD_BITS + F.col("slot")).alias("chrom_id"),
        "actual",
        F.getbit("pos", F.col("slot")).cast("int").alias("is_pos"),
        F.getbit("ok", F.col("slot")).cast("int").alias("is_hit"),
        "n",
    )


def _outcomes_from_pairs(
    evidence: Evidence, population: DataFrame, params: Params, default: int
) -> DataFrame:
    """The same outcomes by joining fired rules with the chromosomes that use them.

    Rows without an active fired rule take the default class; they are added as
    the difference to the class totals.
    """
    active = population.filter(F.col("active") == 1).select(CHUNK, "chrom_id", "rule_key")
    used = evidence.pairs.join(active, [CHUNK, "rule_key"])
    by = [CHUNK, "chrom_id", "row_id", "actual"]
    if params.inference == "winning_rule":
        best = used.groupBy(*by).agg(F.max(F.struct("assoc", (-F.col("rule_class")).alias("c"))).alias("b"))
    else:
        # Shares of the row's largest vote, as in scoring.
        votes = used.groupBy(*by, "rule_class").agg(F.sum("assoc").alias("v"))
        share = F.floor(F.col("v") / F.max("v").over(Window.partitionBy(*by)) * 1e12 + 0.5)
        votes = votes.select(*by, "rule_class", share.alias("t"))
        best = votes.groupBy(*by).agg(F.max(F.struct("t", (-F.col("rule_class")).alias("c"))).alias("b"))
    predicted = best.select(*by, (-F.col("b.c")).alias("predicted"))
    fired = predicted.groupBy(CHUNK, "chrom_id", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    marked = fired.select(
        CHUNK,
        "chrom_id",
        "actual",
        (F.col("predicted") == 0).cast("int").alias("is_pos"),
        (F.col("predicted") == F.col("actual")).cast("int").alias("is_hit"),
        "n",
    )
    chroms = population.select(CHUNK, "chrom_id").distinct()
    done = fired.groupBy(CHUNK, "chrom_id", "actual").agg(F.sum("n").alias("m"))
    rest = (
        evidence.totals.join(chroms, CHUNK)
        .join(done, [CHUNK, "chrom_id", "actual"], "left")
        .select(
            CHUNK,
            "chrom_id",
            "actual",
            F.lit(int(default == 0)).alias("is_pos"),
            (F.col("actual") == default).cast("int").alias("is_hit"),
            (F.col("n") - F.coalesce("m", F.lit(0))).alias("n"),
        )
    )
    return marked.unionByName(rest)


def fitness(
    evidence: Evidence, population: DataFrame, schema: RuleSchema, params: Params
) -> DataFrame:
    """Fitness of every chromosome in ``population``.

    ``alpha * AUC + (1 - alpha) * share of rules left out``; class 0 is the
    positive class and an undefined rate counts as 0.
    """
    default = default_index(schema, params)
    if evidence.rankings is not None:
        outcomes = _outcomes_from_rankings(evidence, population, default)
    else:
        outcomes = _outcomes_from_pairs(evidence, population, params, default)
    n = F.col("n")
    pos, said = F.col("actual") == 0, F.col("is_pos") == 1

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0))

    counts = outcomes.groupBy(CHUNK, "chrom_id").agg(
        total(pos & said).alias("tp"),
        total(pos & ~said).alias("fn"),
        total(~pos & said).alias("fp"),
        total(~pos & ~said).alias("tn"),
        total(F.col("is_hit") == 1).alias("hits"),
        F.sum("n").alias("n_rows"),
    )
    sizes = population.groupBy(CHUNK, "chrom_id").agg(
        F.sum("active").alias("n_selected"), F.count(F.lit(1)).alias("n_rules")
    )
    tpr = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    fpr = F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0))
    auc = (F.lit(1.0) + tpr - fpr) / 2.0
    left_out = (F.col("n_rules") - F.col("n_selected")) / F.col("n_rules")
    return sizes.join(counts, [CHUNK, "chrom_id"]).select(
        CHUNK,
        "chrom_id",
        "tp",
        "fn",
        "fp",
        "tn",
        "n_selected",
        stable(auc).alias("auc"),
        (F.col("hits") / F.col("n_rows")).alias("accuracy"),
        stable(auc * params.alpha + left_out * (1.0 - params.alpha)).alias("fitness"),
    )


def truncate(fit: DataFrame, pop_size: int) -> DataFrame:
    """The ``pop_size`` fittest per chunk with their new numbers (``rank``)."""
    order = Window.partitionBy(CHUNK).orderBy(F.desc("fitness"), "chrom_id")
    return fit.withColumn("rank", (F.row_number().over(order) - 1)).filter(F.col("rank") < pop_size)


def best_chromosome(fit: DataFrame) -> DataFrame:
    """Fittest chromosome per chunk, the lowest number on a tie."""
    best = fit.groupBy(CHUNK).agg(F.max(F.struct("fitness", (-F.col("chrom_id")).alias("c"))).alias("b"))
    return best.select(CHUNK, (-F.col("b.c")).alias("chrom_id"), F.col("b.fitness").alias("fitness"))


def apply_best(rules: DataFrame, population: DataFrame, fit: DataFrame) -> DataFrame:
    """The rule base pruned to the rules the best chromosome switches on."""
    kept = population.filter(F.col("active") == 1).join(
        best_chromosome(fit).select(CHUNK, "chrom_id"), [CHUNK, "chrom_id"], "left_semi"
    )
    return keep_rules(rules, kept)


def restart(population: DataFrame, fit: DataFrame, pop_size: int, seed: int, generation: int) -> DataFrame:
    """Keep the best chromosome as number 0 and draw the others anew."""
    best = population.join(best_chromosome(fit).select(CHUNK, "chrom_id"), [CHUNK, "chrom_id"], "left_semi")
    kept = best.select(CHUNK, F.lit(0).alias("chrom_id"), "rule_key", "active")
    fresh = init_population(best, pop_size, seed, generation).filter(F.col("chrom_id") > 0)
    return kept.unionByName(fresh)


@dataclass(frozen=True)
class Selection:
    """Pruned rules, the last population with its fitness and a log of the search."""

    rules: DataFrame
    population: DataFrame
    fitness: DataFrame
    history: list = field(default_factory=list)


@dataclass
class _Search:
    """Where one chunk's search stands (a few numbers per chunk)."""

    n_rules: int
    budget: int
    best: float
    threshold: float
    resets: int = 0

    @property
    def running(self) -> bool:
        return self.budget > 0 and self.best < 1.0 and self.resets < MAX_RESETS

    def entry(self, generation: int, chunk_id: int, new: int) -> dict:
        """A line of the log: where the chunk stands after a generation and its new children."""
        return {"generation": generation, "chunk_id": chunk_id, "best": self.best, "new": new, "budget": self.budget, "resets": self.resets}


def select_rules(
    df: DataFrame, schema: RuleSchema, chunk_rules: DataFrame, params: Params, row_id: str, chunk=None
) -> Selection:
    """Search, per chunk, for the rule subset of best fitness.

    The loop keeps only a few counters per chunk on the driver. Population and
    fitness are checkpointed every generation, so plans stay short and a lost
    executor costs one generation at most.
    """
    size = params.pop_size
    bounded = 1
    for i in range(len(schema.variables)):
        bounded *= schema.label_count(i)
    small = bounded <= ONE_WINDOW_RULES
    rules = cut_lineage(chunk_rules)
    evidence = gather_evidence(df, schema, rules, params, row_id, chunk)
    pop = write_out(init_population(rules, size, params.seed), "population")
    fit = write_out(fitness(evidence, pop, schema, params).select(CHUNK, "chrom_id", "fitness"), "fitness")
    counts = {r[CHUNK]: r["n"] for r in rules.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = {r[CHUNK]: r["f"] for r in fit.groupBy(CHUNK).agg(F.max("fitness").alias("f")).collect()}
    states = {
        k: _Search(n, params.n_evaluations - size, top[k], n * BITS_PER_GENE / 4.0) for k, n in counts.items()
    }
    history = [s.entry(0, k, size) for k, s in states.items()]

    generation = 0
    while any(s.running for s in states.values()):
        generation += 1
        running = [k for k, s in states.items() if s.running]
        is_running = F.col(CHUNK).isin(running)
        parents = pop.filter(is_running)
        pairs = pair_chromosomes(parents.select(CHUNK, "chrom_id").distinct(), params.seed, generation)
        children = cut_lineage(hux(parents, pairs, params.seed, generation, size, small))
        fresh = children.join(new_chromosomes(children, parents), [CHUNK, "chrom_id"], "left_semi")
        fresh_fit = cut_lineage(fitness(evidence, fresh, schema, params).select(CHUNK, "chrom_id", "fitness"))
        found = {
            r[CHUNK]: (r["n"], r["f"])
            for r in fresh_fit.groupBy(CHUNK)
            .agg(F.count(F.lit(1)).alias("n"), F.max("fitness").alias("f"))
            .collect()
        }
        if found:
            ranked = truncate(fit.unionByName(fresh_fit), size)
            numbers = ranked.select(CHUNK, "chrom_id", "rank")
            both = pop.unionByName(fresh).join(numbers, [CHUNK, "chrom_id"])
            pop = write_out(both.select(CHUNK, F.col("rank").alias("chrom_id"), "rule_key", "active"), "population")
            fit = write_out(ranked.select(CHUNK, F.col("rank").alias("chrom_id"), "fitness"), "fitness")

        stuck = []
        for k in running:
            s = states[k]
            n, f = found.get(k, (0, 0.0))
            s.budget -= n
            if n and f > s.best:
                s.best, s.resets = f, 0
            if n == 0:
                s.threshold -= BITS_PER_GENE
                stuck.append(k)
        if stuck:
            # A population of one and the same chromosome cannot change before the
            # threshold has run out, so the idle generations are not run.
            kinds = signatures(pop.filter(F.col(CHUNK).isin(stuck))).groupBy(CHUNK).agg(
                F.count_distinct("s1", "s2", "n_selected").alias("n")
            )
            for r in kinds.collect():
                if r["n"] == 1:
                    states[r[CHUNK]].threshold = -1.0
            again = [k for k in stuck if states[k].threshold < 0]
            if again:
                redo = F.col(CHUNK).isin(again)
                drawn = cut_lineage(restart(pop.filter(redo), fit.filter(redo), size, params.seed, generation))
                new_fit = fitness(evidence, drawn.filter(F.col("chrom_id") > 0), schema, params)
                new_fit = cut_lineage(new_fit.select(CHUNK, "chrom_id", "fitness"))
                old_best = best_chromosome(fit.filter(redo)).select(CHUNK, F.lit(0).alias("chrom_id"), "fitness")
                pop = write_out(pop.filter(~redo).unionByName(drawn), "population")
                fit = write_out(fit.filter(~redo).unionByName(old_best).unionByName(new_fit), "fitness")
                for r in new_fit.groupBy(CHUNK).agg(F.max("fitness").alias("f")).collect():
                    s = states[r[CHUNK]]
                    s.budget -= size - 1
                    s.threshold = s.n_rules * BITS_PER_GENE / 4.0
                    s.resets += 1
                    if r["f"] > s.best:
                        s.best, s.resets = r["f"], 0
        history += [states[k].entry(generation, k, found.get(k, (0, 0.0))[0]) for k in running]
    return Selection(apply_best(rules, pop, fit), pop, fit, history)
