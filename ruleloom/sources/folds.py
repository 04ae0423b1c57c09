"""Cross-validation inputs: a fold column or pairs of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.encode import assigned
from ruleloom.params import Params
from ruleloom.schema import RuleSchema
from ruleloom.sources.examples import read_examples, split_examples

# The names of fold files, numbered from 1.
TRAIN_FILE = "{name}-5-{fold}tra.dat"
TEST_FILE = "{name}-5-{fold}{suffix}"


def fold_of(df: DataFrame, row_id: str, n_folds: int, params: Params = Params()) -> Column:
    """Fold of a row."""
    return assigned(df, row_id, n_folds, params, "fold")


def fold_files(spark: SparkSession, name: str, suffix: str, fold: int, schema: RuleSchema):
    """The training and test table of one numbered pair of files."""
    train = read_examples(spark, TRAIN_FILE.format(name=name, fold=fold), schema)
    test = read_examples(spark, TEST_FILE.format(name=name, fold=fold, suffix=suffix), schema)
    return train, test


def read_folds(spark: SparkSession, name: str, suffix: str, n_folds: int, schema: RuleSchema) -> DataFrame:
    """All numbered pairs as one table: ``fold`` counts from 0, ``part`` is train or test.

    One scan, however many files; a row's file tells its fold and part. A name may
    stand for a folder of files.
    """
    paths = [f.format(name=name, fold=i, suffix=suffix) for i in range(1, n_folds + 1) for f in (TRAIN_FILE, TEST_FILE)]
    path = F.col("_metadata.file_path")
    lines = spark.read.text(paths).select(
        "value",
        (F.regexp_extract(path, r".*-5-(\d+)", 1).cast("int") - 1).alias("fold"),
        F.when(path.rlike(r"-5-\d+tra\.dat(/|$)"), "train").otherwise("test").alias("part"),
    )
    return split_examples(lines, schema, keep=["fold", "part"])
