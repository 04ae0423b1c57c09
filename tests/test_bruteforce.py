"""The DataFrame path against plain nested loops on small random tables."""

import random

import pytest

from ruleloom import Params, RuleSchema, Variable, learn
from ruleloom.plans.crossval import cross_validate
import plain


def make(spark, n_num, n_nom, n_classes=2, n_rows=60, n_labels=3, seed=1, outside=False, constant=False, hot=False):
    rng = random.Random(seed)
    variables = [Variable(f"x{i}", "numeric", 0.0, 1.0) for i in range(n_num)]
    if constant:
        variables[0] = Variable("x0", "numeric", 0.5, 0.5)
    variables += [Variable(f"s{i}", "nominal", values=("a", "b", "c")) for i in range(n_nom)]
    rng.shuffle(variables)
    classes = tuple(f"c{k}" for k in range(n_classes))
    rows = []
    for r in range(n_rows):
        xs = []
        for v in variables:
            if not v.is_numeric:
                xs.append(rng.choice(v.values))
            elif v.is_constant:
                xs.append(rng.choice([0.5, 0.5, 0.5, 0.2, 0.9]))
            else:
                x = round(rng.random(), 2)
                if hot and rng.random() < 0.4:
                    x = 0.25
                xs.append(x * 1.6 - 0.3 if outside else x)
        rows.append((r, xs, rng.randrange(n_classes)))
    counts = tuple(sum(c == k for *_, c in rows) for k in range(n_classes))
    schema = RuleSchema(tuple(variables), "y", classes, counts, n_labels)
    fields = ", ".join(f"{v.name} {'double' if v.is_numeric else 'string'}" for v in variables)
    df = spark.createDataFrame([(r, *xs, classes[c]) for r, xs, c in rows], f"id long, {fields}, y string")
    return schema, df, rows


def as_dict(rules):
    return {tuple(r.antecedents): (r.class_idx, round(r.weight, 9)) for r in rules.collect()}


def rounded(rules):
    return {k: (c, round(w, 9)) for k, (c, w) in rules.items()}


CASES = {
    "grid": dict(n_num=3, n_nom=1),
    "nominal_only": dict(n_num=0, n_nom=3),
    "one_numeric": dict(n_num=1, n_nom=0, n_labels=2),
    "core_of_four": dict(n_num=4, n_nom=1, n_labels=4),
    "outside_range": dict(n_num=3, n_nom=0, outside=True, n_labels=5),
    "constant": dict(n_num=3, n_nom=1, constant=True),
    "three_classes": dict(n_num=2, n_nom=1, n_classes=3),
    "exploded": dict(n_num=6, n_nom=1, n_rows=40),
    "exploded_constant": dict(n_num=6, n_nom=0, constant=True, n_rows=40),
    "wide": dict(n_num=10, n_nom=2, n_rows=40, n_classes=3),
    "wide_constant": dict(n_num=9, n_nom=1, constant=True, outside=True, n_rows=40),
    "hot_values": dict(n_num=9, n_nom=0, hot=True, n_rows=40),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("kw", [{"rule_weight": "cf"}, {"rule_weight": "pcf", "weight_features": "all_but_last"}], ids=["cf", "pcf_all_but_last"])
def test_rules(spark, case, kw):
    schema, df, rows = make(spark, **CASES[case])
    expected = plain.learn(
        schema, [(xs, c) for _, xs, c in rows], kw["rule_weight"], all_but_last="weight_features" in kw
    )
    assert as_dict(learn(df, schema, Params(**kw), "id").rules) == rounded(expected)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("inference", ["winning_rule", "additive"])
def test_predictions(spark, case, inference):
    schema, df, rows = make(spark, seed=2, **CASES[case])
    # Rules from the first half leave some rows without any.
    half = rows[: len(rows) // 2]
    rules = plain.learn(schema, [(xs, c) for _, xs, c in half])
    params = Params(rule_weight="cf", inference=inference, default_class="most_frequent")
    model = learn(df.filter(f"id < {len(half)}"), schema, params, "id")
    assert as_dict(model.rules) == rounded(rules)
    got = {r.row_id: r.predicted for r in model.predict(df, "id").collect()}
    want = {r: plain.predict(schema, rules, xs, inference, schema.most_frequent_class) for r, xs, _ in rows}
    assert got == want


@pytest.mark.parametrize("case", ["grid", "exploded", "wide", "hot_values"])
def test_shuffled_joins_give_the_same(spark, case):
    """With no room to broadcast, salted shuffles take over."""
    schema, df, _ = make(spark, **CASES[case])
    wide = Params(rule_weight="cf")
    tight = Params(rule_weight="cf", broadcast_bytes=0, salt_buckets=3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    expected_model = learn(df, schema, wide, "id")
    expected = sorted(map(tuple, expected_model.predict(df, "id").collect()))
    rules = as_dict(expected_model.rules)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = learn(df, schema, tight, "id")
        assert as_dict(model.rules) == rules
        assert sorted(map(tuple, model.predict(df, "id").collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("case", ["grid", "wide"])
def test_chunks(spark, case):
    schema, df, rows = make(spark, **CASES[case])
    bases = [plain.learn(schema, [(xs, c) for r, xs, c in rows if r % 3 == k]) for k in range(3)]
    assert as_dict(learn(df, schema, Params(rule_weight="cf", n_chunks=3), "id").rules) == rounded(plain.merge(bases))


@pytest.mark.parametrize("case, weight", [("grid", "cf"), ("grid", "none"), ("exploded", "pcf"), ("wide", "cf")])
def test_folds(spark, case, weight):
    schema, df, rows = make(spark, **CASES[case])
    cv = cross_validate(df, schema, Params(rule_weight=weight, n_folds=3), "id")
    got = {}
    for r in cv.rules.collect():
        key = tuple(int(k) for k in r.rule_key.split("|"))
        got.setdefault(r.fold, {})[key] = (r.class_idx, round(r.weight, 9))
    models = {f: plain.learn(schema, [(xs, c) for r, xs, c in rows if r % 3 != f], weight) for f in range(3)}
    assert got == {f: rounded(m) for f, m in models.items()}
    test = {r.row_id: r.predicted for r in cv.test.collect()}
    assert test == {r: plain.predict(schema, models[r % 3], xs) for r, xs, _ in rows}
    assert cv.train.count() == 2 * len(rows)


def test_text_numbers_and_long_value_lists(spark):
    values = tuple(f"v{i:03d}" for i in range(90))
    schema = RuleSchema(
        (Variable("x", "numeric", 0.0, 1.0), Variable("s", "nominal", values=values)), "y", ("p", "n"), (50, 50), 3
    )
    rng = random.Random(5)
    rows = [([round(rng.random(), 2), rng.choice(values)], rng.randrange(2)) for _ in range(100)]
    df = spark.createDataFrame([(str(x), s, "pn"[c]) for (x, s), c in rows], "x string, s string, y string")
    assert as_dict(learn(df, schema, Params(rule_weight="cf")).rules) == rounded(plain.learn(schema, rows))
