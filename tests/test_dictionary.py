"""Nominal columns whose values stand in a table."""

import random

import pytest

from ruleloom import Params, RuleSchema, Variable, learn
from ruleloom.operators.dictionary import coded, dictionary, with_values
from ruleloom.operators.profile import profile
from ruleloom.sinks.tables import load_model, save_model
import plain


def frame(spark, n=300, seed=3):
    """Rows of which a third share one value."""
    rng = random.Random(seed)
    rows = [(i, round(rng.random(), 2), "hot" if rng.random() < 0.34 else f"v{rng.randrange(80)}", rng.choice("pn")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, s string, y string").repartition(4)


@pytest.mark.parametrize("room", [1 << 26, 0], ids=["broadcast", "shuffled"])
def test_codes_learn_and_score_like_values(spark, room):
    rows, df = frame(spark)
    d = dictionary(df, "s")
    values = tuple(sorted({r[2] for r in rows}))
    assert {r.value: r.code for r in d.table.collect()} == {v: k for k, v in enumerate(values)}
    assert d.size == len(values)
    params = Params(rule_weight="cf", broadcast_bytes=room, salt_buckets=3)
    table = coded(df, [d], params)
    assert table.columns == df.columns and table.count() == len(rows)
    schema = profile(table, ["x", "s"], "y", 3, ["p", "n"], dictionaries=[d])
    assert schema.variables[1].size == len(values) and not schema.variables[1].values
    listed = RuleSchema((schema.variables[0], Variable("s", "nominal", values=values)), "y", schema.classes, schema.class_counts, 3)
    model = learn(table, schema, params, "id")
    base = plain.learn(listed, [([x, s], "pn".index(y)) for _, x, s, y in rows])
    got = {tuple(r.antecedents): (r.class_idx, round(r.weight, 9)) for r in model.rules.collect()}
    assert got == {k: (c, round(w, 9)) for k, (c, w) in base.items()}
    found = {r.row_id: r.predicted for r in model.predict(table, "id").collect()}
    assert found == {i: plain.predict(listed, base, [x, s]) for i, x, s, _ in rows}


def test_null_and_unknown_values_and_clashing_names(spark):
    _, df = frame(spark, 40)
    d = dictionary(df, "s")
    other = spark.createDataFrame([(None, 1, {"a": 1}), ("never", 2, None), ("hot", 3, None)], "s string, code int, value map<string,int>")
    for params in (Params(), Params(broadcast_bytes=0, salt_buckets=2)):
        out = coded(other, [d], params)
        assert out.columns == other.columns
        codes = {r.code: r.s for r in out.collect()}
        hot = d.table.filter("value = 'hot'").first().code
        assert codes == {1: -1, 2: -1, 3: hot}
    back = with_values(coded(other, [d]), d, "s", "name").collect()
    assert {r.code: r.name for r in back} == {1: None, 2: None, 3: "hot"}
    assert dictionary(df.limit(0), "s").size == 0
    with pytest.raises(ValueError, match="at least one value"):
        profile(df, ["x", "s"], "y", dictionaries=[dictionary(df.limit(0), "s")])


def test_stored_model_keeps_the_size(spark, tmp_path):
    _, df = frame(spark, 60)
    d = dictionary(df, "s")
    table = coded(df, [d])
    model = learn(table, profile(table, ["x", "s"], "y", 3, ["p", "n"], dictionaries=[d]), Params(), "id")
    save_model(model, spark, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.schema == model.schema
    assert sorted(map(tuple, again.predict(table, "id").collect())) == sorted(map(tuple, model.predict(table, "id").collect()))
