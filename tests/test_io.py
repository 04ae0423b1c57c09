"""Sources, sinks and stored models."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ruleloom import Params, classify, learn
from ruleloom.operators import counters
from ruleloom.operators.evaluate import mean_auc
from ruleloom.operators.faults import drop_counts, watched
from ruleloom.plans.crossval import validate_files, validate_folds
from ruleloom.sinks import tables, text
from ruleloom.sources.examples import read_examples
from ruleloom.sources.folds import fold_files, read_folds
from ruleloom.sources.header import class_sizes, numeric_range, read_header, value_list
from ruleloom.sources.rulefiles import read_compact_rules

HEADER = """@relation demo
@attribute a real [0.0, 10.0]
@attribute b integer[0,2]
@attribute c {red, green}
@attribute y {p,n}
@inputs a, b, c
@outputs y
@numInstancesByClass 2,3"""
ROWS = """1.0, 0, red, p
2.0,0,red,n
9.0,2,green,n
8.5, 2, green, n
1.5,1,red,p
3.0,1,red
4.0,1,red,p,extra
5.0,1,red,p,,"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "h.txt").write_text(HEADER + "\n")
    (tmp_path / "d.txt").write_text(ROWS + "\n")
    return tmp_path


def test_header(spark, files):
    schema = read_header(spark, str(files / "h.txt"), 3)
    assert [v.kind for v in schema.variables] == ["numeric", "nominal", "nominal"]
    assert schema.variables[1].values == ("0.0", "1.0", "2.0")
    assert (schema.classes, schema.class_counts, schema.label) == (("p", "n"), (2, 3), "y")
    assert read_header(spark, str(files / "h.txt"), 2).variables[1].kind == "numeric"
    assert class_sizes(spark, str(files / "h.txt")) == [2, 3]
    assert numeric_range("real [1.5, 2]") == (1.5, 2.0) and value_list("{a, b}") == ["a", "b"]


@pytest.mark.parametrize(
    "text, message",
    [
        (HEADER.replace("@numInstancesByClass 2,3", "@data"), "number of examples"),
        (HEADER.replace("@outputs y", "@outputs z"), "no declared attribute"),
        (HEADER.replace("@outputs y", "@outputs y, c"), "exactly one"),
        (HEADER.replace("@attribute c {red, green}", "@attribute c"), "either values"),
        (HEADER.replace("@inputs", "\n@inputs"), "empty lines"),
    ],
)
def test_bad_headers(spark, tmp_path, text, message):
    (tmp_path / "h.txt").write_text(text)
    with pytest.raises(ValueError, match=message):
        read_header(spark, str(tmp_path / "h.txt"))


def test_example_files(spark, files):
    schema = read_header(spark, str(files / "h.txt"), 3)
    seen = Observation("scan")
    rows = read_examples(spark, str(files / "d.txt"), schema, seen)
    assert rows.count() == 6
    assert seen.get == {"read": 8, "dropped": 2}
    first = rows.orderBy("row_id").first()
    assert (first.a, first.b, first.c, first.y) == ("1.0", "0", "red", "p")
    model = learn(rows, schema, Params(rule_weight="cf"), "row_id")
    assert {r.rule_key for r in model.rules.collect()} == {"0|0|0", "2|2|1", "0|1|0", "1|1|0"}


def test_class_may_come_first(spark, tmp_path):
    lines = HEADER.split("\n")
    moved = [lines[0], lines[4], *lines[1:4], *lines[5:]]
    (tmp_path / "h.txt").write_text("\n".join(moved))
    (tmp_path / "d.txt").write_text("p,1.0,0,red\n")
    schema = read_header(spark, str(tmp_path / "h.txt"))
    assert read_examples(spark, str(tmp_path / "d.txt"), schema).first().y == "p"


@pytest.fixture
def model(spark, files):
    schema = read_header(spark, str(files / "h.txt"), 3)
    rows = read_examples(spark, str(files / "d.txt"), schema)
    return learn(rows, schema, Params(rule_weight="cf", n_chunks=2), "row_id"), rows


def lines_of(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def test_text_outputs(spark, files, model):
    m, rows = model
    text.write_rule_base(m, str(files / "rb"))
    content = "\n".join(lines_of(spark, str(files / "rb")))
    n = m.rules.count()
    assert f"RULE BASE: ({n})" in content and content.count("\nRule (") == n
    assert "IF a IS L_0 AND b IS 0.0 AND c IS red THEN CLASS = " in content
    text.write_variables(m.schema, spark, str(files / "db"))
    content = "\n".join(lines_of(spark, str(files / "db")))
    assert " L_1: (0.0,5.0,10.0)" in content and "Nominal values: red, green" in content
    assert "Class:\n p, n\n\nIR:\n 1.5, 1.0" in content
    report = classify(m, rows, "row_id")
    text.write_confusion_matrix(report.pivot, m.schema, str(files / "cm"))
    cm = lines_of(spark, str(files / "cm"))
    assert cm[0] == "\tPrediction p\tPrediction n" and cm[1].startswith("Class p\t") and len(cm) == 3
    text.write_counters(counters.mean_rule_counts(m.chunk_rules, m.schema, 2), m.schema, str(files / "cr"))
    assert lines_of(spark, str(files / "cr"))[0].endswith("total Map = 2")
    text.write_knowledge_base(m, spark, str(files / "kb"))
    assert lines_of(spark, str(files / "kb"))[0] == "DATABASE"


def test_compact_rules_round_trip(spark, files, model):
    m, _ = model
    text.write_compact_rules(m.rules, str(files / "rules"))
    back = read_compact_rules(spark, str(files / "rules"), m.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.rules.select(*back.columns).collect()))
    assert sorted(map(tuple, read_compact_rules(spark, str(files / "rules"), m.schema).collect()))


def test_stored_model(spark, files, model):
    m, rows = model
    tables.save_model(m, spark, str(files / "model"))
    again = tables.load_model(spark, str(files / "model"))
    assert again.schema == m.schema and again.params == m.params
    assert sorted(map(tuple, again.rules.collect())) == sorted(map(tuple, m.rules.collect()))
    assert sorted(map(tuple, again.predict(rows, "row_id").collect())) == sorted(
        map(tuple, m.predict(rows, "row_id").collect())
    )


def test_fold_files_and_averages(spark, files):
    schema = read_header(spark, str(files / "h.txt"), 3)
    for i in (1, 2):
        (files / f"d-5-{i}tra.dat").write_text(ROWS)
        (files / f"d-5-{i}tst.dat").write_text("1.0,0,red,p\n9.0,2,green,n\n")
    pairs = [fold_files(spark, str(files / "d"), "tst.dat", i, schema) for i in (1, 2)]
    metrics = validate_files(pairs, schema, Params(rule_weight="cf"))
    for part in metrics.filter("part = 'test'").orderBy("fold").collect():
        text.append_fold_metrics(spark.createDataFrame([part], metrics.schema), str(files / "auc"))
    again = metrics.filter("part = 'test' and fold = 1")
    text.append_fold_metrics(again, str(files / "auc"))
    rows = read_folds(spark, str(files / "d"), "tst.dat", 2, schema)
    once = validate_folds(rows, schema, Params(rule_weight="cf", n_folds=2))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, metrics.collect()))
    stored = spark.read.parquet(str(files / "auc"))
    assert mean_auc(stored).first().n_folds == 2
    text.write_fold_average(stored, str(files / "avg"))
    assert lines_of(spark, str(files / "avg"))[0] == " Number of iterations = 2"


def test_reasons_are_observed_without_a_pass(spark, files):
    schema = read_header(spark, str(files / "h.txt"), 3)
    rows = [("1", "0", "red", "p"), ("x", "0", "red", "p"), ("inf", "0", "red", "n"), (None, "0", "red", "n")]
    rows += [("1", "9", "red", "p"), ("1", "0", None, "n"), ("1", "0", "red", "q"), ("1", "0", "red", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, y string")
    counts = {r.reason: r.n for r in drop_counts(df, schema).collect()}
    assert counts == {"kept": 1, "number": 3, "value": 2, "class": 2}
    seen = Observation()
    assert watched(df, schema, seen).count() == 8 and seen.get == counts
    assert drop_counts(df.limit(0), schema).collect() == []
