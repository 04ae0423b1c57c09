"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from ruleloom.catalog import datasets as D
from ruleloom.catalog.queries import setup, trained
from ruleloom.operators.encode import encode
from ruleloom.operators.evaluate import confusion_matrix
from ruleloom.operators.support import cell_sums
from ruleloom.operators.score import score
from ruleloom.params import Params
from ruleloom.plans.crossval import cross_validate
from ruleloom.session import cut_lineage

SF = "/root/testdata/sf0.001"
JIT_LIMIT = 8000


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


@pytest.mark.parametrize("ds", [D.EVENTS, D.LINEITEM, D.DOCUMENTS, D.EMBEDDINGS_8], ids=lambda d: d.name)
def test_no_pairwise_joins_and_no_python(spark, ds):
    df, model = trained(spark, SF, ds)
    for q in (model.rules, model.predict(df, ds.row_id)):
        text = plan(q)
        for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "BatchEval"):
            assert bad not in text


def test_scan_reads_only_what_is_needed(spark):
    df, schema = setup(spark, SF, D.LINEITEM)
    text = plan(cell_sums(encode(df, schema, [F.lit(0).alias("chunk_id")]), schema))
    read = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    }


def test_learning_shuffles_partial_sums_once_per_row_pass(spark):
    df, schema = setup(spark, SF, D.EVENTS)
    text = plan(cell_sums(encode(df, schema, [F.lit(0).alias("chunk_id")]), schema))
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("HashAggregate") == 2
    assert "SortMergeJoin" not in tree and "BroadcastHashJoin" not in tree


def test_scoring_keeps_rows_in_place(spark):
    """Rows meet a broadcast cell table; only the counted matrix is shuffled."""
    df, model = trained(spark, SF, D.LINEITEM)
    rules = cut_lineage(model.rules)
    predictions = score(df, model.schema, rules, Params(rule_weight="cf"))
    rows_side = plan(predictions).split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in rows_side
    assert "BroadcastHashJoin LeftOuter" in rows_side
    assert "HashAggregate" in plan(confusion_matrix(predictions))


@pytest.mark.parametrize("ds", [D.EVENTS, D.LINEITEM], ids=lambda d: d.name)
def test_row_code_is_short_enough_for_the_jit(spark, ds):
    df, model = trained(spark, SF, ds)
    rules = cut_lineage(model.rules)
    encoded = encode(df, model.schema, [F.lit(0).alias("chunk_id")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for q in (score(df, model.schema, rules, Params()), cell_sums(encoded, model.schema)):
            sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", plan(q, "codegen"))]
            assert sizes and max(sizes) < JIT_LIMIT
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_of_all_fold_models_meet_their_cell_once(spark):
    """The training side of cross-validation repeats rows behind the lookup only."""
    df, schema = setup(spark, SF, D.EVENTS)
    cv = cross_validate(df, schema, Params(rule_weight="cf", n_folds=5), D.EVENTS.row_id)
    tree = plan(cv.train, "simple").split("BroadcastExchange")[0]
    assert tree.count("BroadcastHashJoin") == 1 and tree.index("Generate") < tree.index("BroadcastHashJoin")


def test_lines_meet_their_orders_once(spark):
    """Every step after the first reads the joined rows and shuffles no lines again."""
    df, model = trained(spark, SF, D.ORDER_LINES)
    for q in (df, cell_sums(encode(df, model.schema, [F.lit(0).alias("chunk_id")]), model.schema)):
        assert "Join" not in plan(q)
