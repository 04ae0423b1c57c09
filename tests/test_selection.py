"""Rule selection: operators against plain sets, and the search as a whole."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from ruleloom import Params, learn
from ruleloom.operators import selection as S
from ruleloom.operators.encode import CHUNK, CLASS, chunk_of, encode
from ruleloom.operators.score import fired_rules
from ruleloom.plans.learn import learn_chunks
from ruleloom.session import cut_lineage
from test_bruteforce import make
import plain

PARAMS = Params(rule_weight="cf", n_chunks=2, pop_size=6, seed=3)


@pytest.fixture(scope="module")
def world(spark):
    schema, df, rows = make(spark, 3, 1, n_rows=80, seed=4)
    rules = cut_lineage(learn_chunks(df, schema, PARAMS, "id"))
    return schema, df, rows, rules


def active_sets(population):
    out = {}
    for r in population.collect():
        chosen = out.setdefault((r.chunk_id, r.chrom_id), set())
        if r.active:
            chosen.add(r.rule_key)
    return out


@pytest.mark.parametrize("n_pop", [6, 70])
def test_fitness_matches_plain_scoring(spark, world, n_pop):
    """Rankings, pairs and plain scoring agree; 70 chromosomes need two words."""
    schema, df, rows, rules = world
    pop = cut_lineage(S.init_population(rules, n_pop, 3))
    evidence = S.gather_evidence(df, schema, rules, PARAMS, "id")
    assert evidence.rankings is not None
    fit = {(r.chunk_id, r.chrom_id): r for r in S.fitness(evidence, pop, schema, PARAMS).collect()}
    table = encode(df, schema, [F.col("id").alias("row_id"), chunk_of(df, "id", 2).alias(CHUNK)])
    table = table.withColumnRenamed(CLASS, "actual")
    pairs = fired_rules(table, schema, rules, PARAMS, "row_id", keep=["actual"], group=[CHUNK])
    slow = S.fitness(S.Evidence(evidence.totals, pairs=pairs), pop, schema, PARAMS)
    assert sorted(map(tuple, fit.values())) == sorted(map(tuple, slow.collect()))
    base = {(r.chunk_id, r.rule_key): (r.class_idx, r.weight) for r in rules.collect()}
    for (chunk, chrom), chosen in list(active_sets(pop).items())[:12]:
        kept = {tuple(map(int, k.split("|"))): base[chunk, k] for k in chosen}
        tp = fn = fp = tn = 0
        for r, xs, c in rows:
            if r % 2 == chunk:
                said = plain.predict(schema, kept, xs)
                tp, fn = tp + (c == 0 and said == 0), fn + (c == 0 and said != 0)
                fp, tn = fp + (c != 0 and said == 0), tn + (c != 0 and said != 0)
        got = fit[chunk, chrom]
        assert (got.tp, got.fn, got.fp, got.tn, got.n_selected) == (tp, fn, fp, tn, len(chosen))
        n = sum(k[0] == chunk for k in base)
        auc = (1 + tp / (tp + fn) - fp / (fp + tn)) / 2
        assert got.fitness == pytest.approx(auc * 0.7 + (n - len(chosen)) / n * 0.3)


def test_additive_fitness_uses_the_subset(spark, world):
    schema, df, _, rules = world
    params = Params(rule_weight="cf", inference="additive", n_chunks=2, pop_size=6, seed=3)
    evidence = S.gather_evidence(df, schema, rules, params, "id")
    assert evidence.pairs is not None
    pop = S.init_population(rules, 6, 3)
    fit = S.fitness(evidence, pop, schema, params).collect()
    assert len({r.auc for r in fit}) > 1
    assert all(r.tp + r.fn + r.fp + r.tn == 40 for r in fit)


def test_hux_swaps_half_of_the_differences(spark, world):
    *_, rules = world
    pop = S.init_population(rules, 6, 3)
    pairs = S.pair_chromosomes(pop.select(CHUNK, "chrom_id").distinct(), 3, 1)
    children = S.hux(pop, pairs, 3, 1, 6)
    same = S.hux(pop, pairs, 3, 1, 6, small=False)
    assert sorted(map(tuple, children.collect())) == sorted(map(tuple, same.collect()))
    parents, kids = active_sets(pop), active_sets(children)
    sides = {}
    for r in pairs.collect():
        sides.setdefault((r.chunk_id, r.pair), {})[r.side] = r.chrom_id
    assert len(sides) == 6
    for (chunk, pair), s in sides.items():
        mom, dad = parents[chunk, s[0]], parents[chunk, s[1]]
        one, two = kids[chunk, 6 + 2 * pair], kids[chunk, 7 + 2 * pair]
        d = len(mom ^ dad)
        assert len(one ^ mom) == len(two ^ dad) == max(1, d // 2)
        assert one ^ two == mom ^ dad and one & two == mom & dad


def test_copies_are_not_new(spark, world):
    *_, rules = world
    pop = S.init_population(rules, 6, 3)
    copies = pop.withColumn("chrom_id", F.col("chrom_id") + 10)
    assert S.new_chromosomes(copies, pop).count() == 0
    twice = copies.unionByName(pop.withColumn("chrom_id", F.col("chrom_id") + 20))
    none = pop.filter("chrom_id < 0")
    assert S.new_chromosomes(twice, none).count() == S.new_chromosomes(copies, none).count() == 12


def test_search_improves_and_repeats(spark, world):
    schema, df, _, rules = world
    params = Params(rule_weight="cf", n_chunks=2, pop_size=6, n_evaluations=24, seed=3)
    one = S.select_rules(df, schema, rules, params, "id")
    best = {}
    for h in one.history:
        assert h["best"] >= best.get(h["chunk_id"], 0.0)
        best[h["chunk_id"]] = h["best"]
    top = {r.chunk_id: r.f for r in one.fitness.groupBy(CHUNK).agg(F.max("fitness").alias("f")).collect()}
    assert top == best
    assert one.rules.count() < rules.count()
    again = S.select_rules(df, schema, rules, params, "id")
    assert sorted(map(tuple, one.rules.collect())) == sorted(map(tuple, again.rules.collect()))


def test_search_restarts_on_a_tiny_rule_base(spark):
    """Two rules have four subsets, so new children soon run out."""
    rows = [(i, 1.0 if i % 2 else 9.0, "p" if i % 2 else "n") for i in range(12)] + [(12, 1.0, "n")]
    df = spark.createDataFrame(rows, "id long, a double, y string")
    from ruleloom import RuleSchema, Variable

    schema = RuleSchema((Variable("a", "numeric", 0.0, 10.0),), "y", ("p", "n"), (6, 7), 3)
    params = Params(rule_weight="cf", pop_size=4, n_evaluations=40, seed=1)
    model = learn(df, schema, params, "id")
    assert 1 <= model.rules.count() <= 2


def test_selection_on_wide_tables(spark):
    schema, df, _ = make(spark, 9, 1, n_rows=40, seed=6)
    params = Params(rule_weight="cf", pop_size=4, n_evaluations=8)
    model = learn(df, schema, params, "id")
    full = learn(df, schema, Params(rule_weight="cf"), "id")
    kept = {r.rule_key for r in model.rules.collect()}
    assert kept < {r.rule_key for r in full.rules.collect()}


def test_long_search_keeps_expected_sizes_small(spark):
    """Sizes that Spark expects of the population do not multiply from generation to generation."""
    schema, df, _ = make(spark, 3, 1, n_rows=80, seed=4)
    params = Params(rule_weight="cf", pop_size=4, n_evaluations=14, seed=3)
    rules = cut_lineage(learn_chunks(df, schema, params, "id"))
    found = S.select_rules(df, schema, rules, params, "id")
    assert max(h["generation"] for h in found.history) >= 4
    for table in (found.population, found.fitness):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            table.explain("cost")
        sizes = re.findall(r"sizeInBytes=([^,)]*) ", out.getvalue())
        assert sizes and all("E+" not in s for s in sizes)
