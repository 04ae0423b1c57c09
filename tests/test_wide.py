"""Many numeric features, limits of profiling, unreadable numbers, dense matrices."""

import contextlib
import io
import math
import random

import pytest

from ruleloom import Params, classify, learn, profile
from ruleloom.operators import dense, match
from ruleloom.operators.evaluate import confusion_matrix
from ruleloom.schema import RuleSchema, Variable


def peaks(low, high):
    return [low, (low + high) / 2, high]


def degree(x, low, high, label):
    p = peaks(low, high)
    if x == p[label]:
        return 1.0
    left, right = p[max(label - 1, 0)], p[min(label + 1, 2)]
    if left <= x < p[label]:
        return (x - left) / (p[label] - left)
    if p[label] < x <= right:
        return (right - x) / (right - p[label])
    return 0.0


def plain(rows, rules, ranges, inference):
    out = []
    for *xs, _ in rows:
        votes = [0.0, 0.0]
        for key, c, w in rules:
            d = w
            for x, (low, high), label in zip(xs, ranges, map(int, key.split("|"))):
                d *= degree(x, low, high, label)
            votes[c] = max(votes[c], d) if inference == "winning_rule" else votes[c] + d
        out.append(0 if votes[0] >= votes[1] else 1)
    return out


@pytest.mark.parametrize("inference, ids", [("winning_rule", "equal"), ("additive", "none")])
def test_many_features(spark, inference, ids):
    r, n, m = random.Random(3), 112, 24
    names = [f"f{i}" for i in range(n)]
    rows = [[r.random() for _ in names] + [r.choice("pn")] for _ in range(m)]
    table = [[7 if ids == "equal" else k, *row] for k, row in enumerate(rows)]
    df = spark.createDataFrame(table, "id int, " + ", ".join(f"{x} double" for x in names) + ", y string")
    schema = profile(df, names, "y", 3, ["p", "n"])
    model = learn(df, schema, Params(rule_weight="cf", inference=inference))
    rules = [(x.rule_key, x.class_idx, x.weight) for x in model.rules.collect()]
    ranges = [(v.lower, v.upper) for v in schema.variables]
    found = model.predict(df, None if ids == "none" else "id").collect()
    expected = plain(rows, rules, ranges, inference)
    assert len(found) == m
    actual = ["pn".index(row[-1]) for row in rows]
    assert sorted((x.actual, x.predicted) for x in found) == sorted(zip(actual, expected))
    assert all(x.degree > 0 for x in found)


def test_grid_and_pairs_agree(spark, monkeypatch):
    from ruleloom.operators import grid

    r = random.Random(5)
    rows = [(k, *(r.random() for _ in range(4)), r.choice("rg"), r.choice("pn")) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, s string, y string")
    schema = profile(df, ["a", "b", "c", "d", "s"], "y", 3, ["p", "n"])
    both = []
    for limit in (8, 1):
        monkeypatch.setattr(grid, "GRID_FEATURES", limit)
        for inference in ("winning_rule", "additive"):
            model = learn(df, schema, Params(rule_weight="cf", inference=inference))
            both.append(sorted((x.row_id, x.predicted, round(x.degree, 9)) for x in model.predict(df, "id").collect()))
    assert both[:2] == both[2:]


def test_limits_hold_over_the_whole_table(spark):
    df = spark.range(3000).selectExpr("CAST(id AS STRING) AS s", "CAST(id % 30 AS STRING) AS y", "CAST(id AS DOUBLE) AS v")
    with pytest.raises(ValueError, match="column 's'"):
        profile(df, ["s", "v"], "y", max_values=1000)
    with pytest.raises(ValueError, match="label column 'y'"):
        profile(df, ["v"], "y", classes=["0", "1"], max_classes=29)
    assert len(profile(df, ["v"], "y", max_classes=30).classes) == 30


def test_no_number_is_unreadable(spark):
    rows = [(1.0, "p"), (math.nan, "p"), (4.0, "n"), (math.inf, "n"), (2.0, "n")]
    df = spark.createDataFrame(rows, "v double, y string")
    schema = profile(df, ["v"], "y", 3, ["p", "n"])
    assert (schema.variables[0].lower, schema.variables[0].upper) == (1.0, 4.0)
    with pytest.raises(Exception, match="unreadable number"):
        learn(df, schema, Params()).rules.collect()
    assert {x.rule_key for x in learn(df, schema, Params(bad_rows="drop", rule_weight="cf")).rules.collect()} == {"0", "1", "2"}


def test_large_dense_matrix(spark):
    k = 300
    schema = RuleSchema((Variable("v", "numeric", 0.0, 1.0),), "y", tuple(map(str, range(k))), (1,) * k, 3)
    pairs = spark.range(1000).selectExpr(f"CAST(id % {k} AS INT) AS actual", "CAST(id % 7 AS INT) AS predicted", "CAST(id % 2 AS INT) AS fold")
    assert confusion_matrix(pairs, schema).count() == k * k
    by_fold = confusion_matrix(pairs, schema, ["fold"]).groupBy("fold").sum("n").collect()
    assert sorted(tuple(x) for x in by_fold) == [(0, 500), (1, 500)]


def test_rows_are_read_once_for_each_step(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(k, float(k % 9), "pn"[k % 2]) for k in range(90)]
    df = spark.createDataFrame(rows, "id int, v double, y string").mapInArrow(counted, "id int, v double, y string")
    schema = RuleSchema((Variable("v", "numeric", 0.0, 8.0),), "y", ("p", "n"), (45, 45), 3)
    model = learn(df, schema, Params(rule_weight="cf"))
    result = classify(model, df, "id")
    for table in (result.matrix, result.auc, result.accuracy, result.pivot, model.rules, model.chunk_rules):
        table.collect()
    assert seen.value == 180


@pytest.mark.parametrize("features", ["all", "all_but_last"])
def test_tiles_and_blocks_agree(spark, monkeypatch, features):
    """Where middle labels prevail rows meet all rules in tiles; pairs by block give the same."""
    r = random.Random(7)
    names = [f"f{i}" for i in range(12)]
    rows = [(k // 2, *(4.0 if i == 3 else r.gauss(0, 1) for i in range(12)), r.choice("pqn")) for k in range(150)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{x} double" for x in names) + ", y string")
    schema = profile(df, names, "y", 3, ["p", "q", "n"])
    out = {}
    for share in (0.2, 2.0):
        monkeypatch.setattr(match, "BLOCK_SHARE", share)
        for inference in ("winning_rule", "additive"):
            params = Params(rule_weight="cf", inference=inference, n_chunks=2, weight_features=features)
            model = learn(df, schema, params, "id")
            found = model.predict(df, "id")
            text = io.StringIO()
            with contextlib.redirect_stdout(text):
                found.explain()
            assert ("CoGroups" in text.getvalue()) == (share < 1)
            rules = sorted((x.rule_key, x.class_idx, round(x.weight, 9)) for x in model.rules.collect())
            said = sorted((x.row_id, x.actual, x.predicted, f"{x.degree:.9e}") for x in found.collect())
            assert len(said) == len(rows)
            out[share, inference] = rules, said
    for inference in ("winning_rule", "additive"):
        assert out[0.2, inference] == out[2.0, inference]


def test_tiles_take_many_steps(spark, monkeypatch):
    """Several chunks of rows and of rules give what one tile gives."""
    r = random.Random(8)
    names = [f"f{i}" for i in range(10)]
    rows = [(k, *(r.gauss(0, 1) for _ in names), r.choice("pn")) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{x} double" for x in names) + ", y string")
    schema = profile(df, names, "y", 3, ["p", "n"])
    monkeypatch.setattr(match, "BLOCK_SHARE", 0.2)
    both = []
    for rule_tile, row_tile, step in ((32_768, 16_384, 256), (24, 32, 7)):
        monkeypatch.setattr(dense, "RULE_TILE", rule_tile)
        monkeypatch.setattr(dense, "ROW_TILE", row_tile)
        monkeypatch.setattr(dense, "ROWS", step)
        monkeypatch.setattr(dense, "RULES", step)
        for inference in ("winning_rule", "additive"):
            found = learn(df, schema, Params(rule_weight="cf", inference=inference)).predict(df, "id").collect()
            both.append(sorted((x.row_id, x.predicted, f"{x.degree:.9e}") for x in found))
    assert both[:2] == both[2:]
