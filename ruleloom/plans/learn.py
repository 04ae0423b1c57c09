"""Learning a rule base and the model that carries it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.operators.encode import CHUNK, CLASS, chunk_of, encode, own_labels, rule_key
from ruleloom.operators.profile import profile
from ruleloom.operators.score import score
from ruleloom.operators.support import rule_support
from ruleloom.operators.weights import best_class, class_weights, finish_rules, first_class, merge_rules
from ruleloom.params import Params
from ruleloom.schema import RuleSchema
from ruleloom.session import cut_lineage


@dataclass(frozen=True)
class Model:
    """A learned rule base: schema, parameters and two tables.

    ``rules`` is the final rule base, ``chunk_rules`` what each chunk learned
    before merging. Learning writes the latter to the checkpoint folder, so the
    rows are read once however often the model is used;
    :mod:`ruleloom.sinks.tables` stores both.
    """

    schema: RuleSchema
    params: Params
    rules: DataFrame
    chunk_rules: DataFrame

    def cache(self) -> "Model":
        return replace(self, rules=self.rules.persist(), chunk_rules=self.chunk_rules.persist())

    def unpersist(self) -> None:
        self.rules.unpersist()
        self.chunk_rules.unpersist()

    def predict(self, df: DataFrame, row_id: str | None = None, keep=(), with_actual: bool = True) -> DataFrame:
        return score(df, self.schema, self.rules, self.params, row_id, keep, with_actual=with_actual)


def learn_chunks(
    df: DataFrame, schema: RuleSchema, params: Params, row_id: str | None = None, chunk=None, group=(CHUNK,), keep=()
) -> DataFrame:
    """One rule base per ``group``: ``(group, rule_key, class_idx, weight)``."""
    chunk = chunk if chunk is not None else chunk_of(df, row_id, params.n_chunks, params)
    if params.rule_weight == "none":
        if row_id is None:
            raise ValueError("rule_weight='none' takes the first row of a rule and needs a row_id")
        cols = [F.col(row_id).alias("row_id"), chunk.alias(CHUNK), *keep]
        rows = encode(df, schema, cols, params.bad_rows)
        seen = rows.select(*group, "row_id", CLASS, rule_key(own_labels(schema)).alias("rule_key"))
        return first_class(seen.withColumnRenamed("row_id", "first_row"), group)
    support = rule_support(df, schema, params, chunk, group, keep)
    return best_class(class_weights(support, params.rule_weight, group), group)


def learn(
    df: DataFrame,
    schema: RuleSchema | None = None,
    params: Params = Params(),
    row_id: str | None = None,
    features=None,
    label: str | None = None,
    classes=None,
    chunk=None,
) -> Model:
    """Learn a rule base from a table.

    Give a ``schema`` (from a header or an earlier profile), or ``features`` and
    ``label`` to have it read off the table. ``chunk`` is a column that assigns
    rows to chunks; by default the row id modulo ``n_chunks``. With evaluations
    in the parameters every chunk's rules go through rule selection before the
    chunks are merged.
    """
    if schema is None:
        if features is None or label is None:
            raise ValueError("give a schema, or features and label")
        schema = profile(df, features, label, params.n_labels, classes)
    chunk_rules = learn_chunks(df, schema, params, row_id, chunk)
    if params.n_evaluations > 0:
        from ruleloom.operators.selection import select_rules

        if row_id is None:
            raise ValueError("rule selection needs a row_id")
        chunk_rules = select_rules(df, schema, chunk_rules, params, row_id, chunk).rules
    chunk_rules = cut_lineage(chunk_rules)
    one_chunk = chunk is None and params.n_chunks == 1
    merged = chunk_rules.drop(CHUNK) if one_chunk else merge_rules(chunk_rules)
    return Model(schema, params, finish_rules(merged), finish_rules(chunk_rules, [CHUNK]))
