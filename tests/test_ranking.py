"""Numbering in order, and chunks and folds drawn from ids."""

import random
from collections import Counter

import pytest

from ruleloom import Params
from ruleloom.operators.encode import chunk_of
from ruleloom.operators.ranking import PART, numbered, ordered_parts
from ruleloom.plans.crossval import cross_validate
from ruleloom.sources.folds import fold_of
from test_bruteforce import CASES, make
import plain


def test_places_in_groups_with_a_hot_one(spark):
    rng = random.Random(4)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(7), [rng.randrange(3), i]) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, v array<int>").repartition(5)
    got = {(r.g, tuple(r.v)): r.no for r in numbered(df, ["v"], "no", ["g"]).collect()}
    want = {}
    for g in range(7):
        for i, v in enumerate(sorted(tuple(v) for h, v in rows if h == g)):
            want[g, v] = i
    assert got == want
    whole = {(r.g, tuple(r.v)): r.no for r in numbered(df, ["g", "v"], "no").collect()}
    assert whole == {k: i for i, k in enumerate(sorted((g, tuple(v)) for g, v in rows))}
    assert numbered(df.limit(0), ["v"], "no", ["g"]).collect() == []
    assert sorted(r.no for r in numbered(df.select("g"), ["g"], "no").collect()) == list(range(900))


def test_equal_leads_spread_over_tasks(spark):
    df = spark.range(200_000, numPartitions=8).selectExpr("array(0, CAST(id % 50 AS INT), CAST(id AS INT)) AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in ordered_parts(df, ["v"]).groupBy(PART).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_chunks_and_folds_are_independent(spark):
    df = spark.range(5_000)
    p = Params(n_chunks=5, n_folds=5, assign="digest")
    found = df.select("id", fold_of(df, "id", 5, p).alias("f"), chunk_of(df, "id", 5, p).alias("c"))
    cells = Counter((r.f, r.c) for r in found.collect())
    assert len(cells) == 25 and max(cells.values()) < 2 * min(cells.values())
    other = df.select("id", fold_of(df, "id", 5, Params(assign="digest", seed=1)).alias("f"))
    assert other.join(found, ["id", "f"]).count() < 2_000


def test_shared_divisors_are_refused(spark):
    schema, df, _ = make(spark, **CASES["grid"])
    with pytest.raises(ValueError, match="common divisor"):
        cross_validate(df, schema, Params(n_chunks=2, n_folds=4), "id")
    cross_validate(df, schema, Params(n_chunks=2, n_folds=4, assign="digest"), "id")


@pytest.mark.parametrize("case", ["grid", "exploded", "nominal_only", "three_classes"])
@pytest.mark.parametrize("inference", ["winning_rule", "additive"])
@pytest.mark.parametrize("room", [1 << 26, 0])
def test_all_fold_models_score_alike(spark, case, inference, room):
    """Each row by every model but its own fold's, cell tables broadcast and shuffled."""
    schema, df, rows = make(spark, seed=3, **CASES[case])
    params = Params(rule_weight="cf", inference=inference, n_folds=3, broadcast_bytes=room, salt_buckets=2)
    cv = cross_validate(df, schema, params, "id")
    models = {f: plain.learn(schema, [(xs, c) for r, xs, c in rows if r % 3 != f], "cf") for f in range(3)}
    want = {(r, f): plain.predict(schema, models[f], xs, inference) for r, xs, _ in rows for f in range(3)}
    train = {(r.row_id, r.fold): r.predicted for r in cv.train.collect()}
    assert train == {k: v for k, v in want.items() if k[0] % 3 != k[1]}
    test = {(r.row_id, r.fold): r.predicted for r in cv.test.collect()}
    assert test == {k: v for k, v in want.items() if k[0] % 3 == k[1]}
