"""Small cases with exact results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ruleloom import Params, RuleSchema, Variable, learn, profile
from ruleloom.functions.membership import membership_vector, numeric_label
from ruleloom.operators.evaluate import binary_auc, confusion_matrix
from ruleloom.operators.weights import merge_rules
from ruleloom.schema import fuzzy_sets_table

VAR = Variable("a", "numeric", 0.0, 10.0)
ROWS = [(1, 1.0, 0.0, "p"), (2, 2.0, 0.0, "n"), (3, 9.0, 10.0, "n"), (4, 8.0, 9.0, "n")]
SCHEMA = RuleSchema((VAR, Variable("b", "numeric", 0.0, 10.0)), "y", ("p", "n"), (1, 3), 3)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, a double, b double, y string")


def test_partition_labels_and_degrees(spark):
    sets = fuzzy_sets_table(spark, SCHEMA).filter("var_idx = 0").orderBy("label").collect()
    assert [(r.left_pt, r.mid_pt, r.right_pt) for r in sets] == [(0, 0, 5), (0, 5, 10), (5, 10, 10)]
    assert [r.upper_cut for r in sets] == [2.5, 7.5, None]
    expected = {
        -3.0: (0, [0, 0, 0]),
        0.0: (0, [1, 0, 0]),
        2.0: (0, [0.6, 0.4, 0]),
        2.5: (1, [0.5, 0.5, 0]),
        5.0: (1, [0, 1, 0]),
        7.5: (2, [0, 0.5, 0.5]),
        10.0: (2, [0, 0, 1]),
        12.0: (2, [0, 0, 0]),
    }
    df = spark.createDataFrame([(x,) for x in expected], "x double")
    x = F.col("x")
    for r in df.select("x", numeric_label(x, VAR, 3).alias("l"), membership_vector(x, VAR, 3).alias("m")).collect():
        assert (r.l, r.m) == expected[r.x]


@pytest.mark.parametrize(
    "kw, first, second",
    [
        ({"rule_weight": "cf"}, ("p", 0.8), ("n", 1.0)),
        ({"rule_weight": "pcf"}, ("p", 0.6), ("n", 1.0)),
        ({"rule_weight": "cf", "cost_sensitive": False}, ("p", 0.571428571429), ("n", 1.0)),
        ({"rule_weight": "none"}, ("p", 1.0), ("n", 1.0)),
    ],
)
def test_learned_weights(table, kw, first, second):
    rules = {r.rule_key: (SCHEMA.classes[r.class_idx], r.weight) for r in learn(table, SCHEMA, Params(**kw), "id").rules.collect()}
    assert rules == {"0|0": first, "2|2": second}


def test_scoring_and_defaults(spark, table):
    model = learn(table, SCHEMA, Params(rule_weight="cf"), "id")
    points = spark.createDataFrame(
        [(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 9.0, 10.0), (4, 8.0, 9.0), (5, 5.0, 5.0)], "id long, a double, b double"
    )
    out = {r.row_id: (r.predicted, round(r.degree, 6)) for r in model.predict(points, "id", with_actual=False).collect()}
    assert out == {1: (0, 0.64), 2: (0, 0.48), 3: (1, 0.8), 4: (1, 0.48), 5: (0, 0.0)}
    other = learn(table, SCHEMA, Params(rule_weight="cf", default_class="most_frequent"), "id")
    assert other.predict(points.filter("id = 5"), "id", with_actual=False).first().predicted == 1
    matrix = confusion_matrix(model.predict(table, "id"), SCHEMA)
    assert sorted((r.actual, r.predicted, r.n) for r in matrix.collect()) == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 2)]
    assert round(binary_auc(matrix).first().auc, 6) == 0.833333


def test_merge_of_chunks(spark):
    def merged(n):
        rows = [(0, "k", 0, 0.8), (1, "k", 0, 0.4), (2, "k", 1, n)]
        r = merge_rules(spark.createDataFrame(rows, "chunk_id int, rule_key string, class_idx int, weight double")).first()
        return r.class_idx, r.weight

    assert merged(0.7) == (1, 0.7)
    assert merged(0.6) == (0, 0.6)


def test_edges(spark, table):
    with pytest.raises(ValueError):
        Params(n_labels=1)
    for bad in ({"rule_weight": "x"}, {"inference": "x"}, {"alpha": 2.0}, {"n_chunks": 0}, {"pop_size": 1}):
        with pytest.raises(ValueError):
            Params(**bad)
    constant = table.withColumn("a", F.lit(4.0))
    schema = profile(constant, ["a", "b"], "y", 3)
    assert schema.warnings
    assert all(r.antecedents[0] == 2 for r in learn(constant, schema, Params(), "id").rules.collect())
    # An absent class has no AUC.
    only_n = table.filter("y = 'n'")
    matrix = confusion_matrix(learn(table, SCHEMA, Params(), "id").predict(only_n, "id"), SCHEMA)
    assert binary_auc(matrix).first().auc is None


def test_bad_rows(spark):
    schema = RuleSchema((VAR, Variable("s", "nominal", values=("r", "g"))), "y", ("p", "n"), (2, 2), 3)
    rows = [("1", "r", "p"), ("2", "g", "n"), ("oops", "r", "p"), ("3", "blue", "n"), ("4", "r", "n")]
    df = spark.createDataFrame(rows, "a string, s string, y string")
    with pytest.raises(Exception, match="unreadable number"):
        learn(df.filter("s <> 'blue'"), schema, Params()).rules.collect()
    with pytest.raises(Exception, match="unknown value"):
        learn(df.filter("a <> 'oops'"), schema, Params()).rules.collect()
    model = learn(df, schema, Params(bad_rows="drop", rule_weight="cf"))
    assert {r.rule_key for r in model.rules.collect()} == {"0|0", "0|1", "1|0"}
    unknown = spark.createDataFrame([("1", "r", "z")], df.schema)
    with pytest.raises(Exception, match="unknown class"):
        learn(unknown, schema, Params()).rules.collect()
    assert model.predict(unknown).count() == 0
    # An unknown nominal value matches no rule when scoring.
    assert model.predict(df.filter("s = 'blue'")).first().degree == 0.0


def test_small_integers_become_nominal(spark):
    df = spark.createDataFrame([(0, 1.5, "p"), (1, 2.5, "n"), (2, 3.5, "p")], "k int, v double, y string")
    schema = profile(df, ["k", "v"], "y", 3, classes=["p", "n"])
    assert [v.kind for v in schema.variables] == ["nominal", "numeric"]
    assert {r.rule_key for r in learn(df, schema, Params(rule_weight="cf")).rules.collect()} == {"0|0", "1|1", "2|2"}
