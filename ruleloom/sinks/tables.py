"""Models as parquet tables."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from ruleloom.params import Params
from ruleloom.plans.learn import Model
from ruleloom.schema import classes_table, fuzzy_sets_table, schema_from_tables, variables_table


def save_model(model: Model, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    """Write rules, chunk rules, variables, fuzzy sets, classes and parameters."""
    s = model.schema
    facts = json.dumps(
        {"label": s.label, "n_labels": s.n_labels, "label_at": s.label_at, "params": asdict(model.params)}
    )
    tables = {
        "rules": model.rules,
        "chunk_rules": model.chunk_rules,
        "variables": variables_table(spark, s),
        "fuzzy_sets": fuzzy_sets_table(spark, s),
        "classes": classes_table(spark, s, model.params.cost_sensitive),
        "facts": spark.createDataFrame([(facts,)], "facts string"),
    }
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> Model:
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
    schema = schema_from_tables(
        spark.read.parquet(f"{path}/variables"),
        spark.read.parquet(f"{path}/classes"),
        facts["label"],
        facts["n_labels"],
        facts["label_at"],
    )
    return Model(
        schema,
        Params(**facts["params"]),
        spark.read.parquet(f"{path}/rules"),
        spark.read.parquet(f"{path}/chunk_rules"),
    )
