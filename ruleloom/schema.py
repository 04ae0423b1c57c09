"""Variables, classes and the tables that describe them.

A schema is the only thing the driver ever holds: one small entry per column
and one per class. It is baked into column expressions as literals, so the
jobs that learn and score read nothing but the data and the rules.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
NOMINAL = "nominal"


@dataclass(frozen=True)
class Variable:
    """One feature: a numeric range, an ordered list of values, or a number of coded values.

    With ``size`` the column holds codes from 0, see :mod:`ruleloom.operators.dictionary`.
    """

    name: str
    kind: str
    lower: float | None = None
    upper: float | None = None
    values: tuple[str, ...] = ()
    compare_as_number: bool = False
    size: int | None = None

    def __post_init__(self):
        if self.kind not in (NUMERIC, NOMINAL):
            raise ValueError(f"unknown variable kind {self.kind!r}")
        if self.kind == NUMERIC and (self.lower is None or self.upper is None or self.lower > self.upper):
            raise ValueError(f"variable {self.name!r} needs a range with lower <= upper")
        if self.kind == NOMINAL and not self.n_values:
            raise ValueError(f"variable {self.name!r} needs at least one value")

    @property
    def is_numeric(self) -> bool:
        return self.kind == NUMERIC

    @property
    def n_values(self) -> int:
        return self.size or len(self.values)

    @property
    def is_constant(self) -> bool:
        return self.is_numeric and self.lower == self.upper


@dataclass(frozen=True)
class RuleSchema:
    """Features in order, classes in order, class sizes and the label count.

    ``label_at`` is the place of the class among the columns of a text file,
    the last one by default.
    """

    variables: tuple[Variable, ...]
    label: str
    classes: tuple[str, ...]
    class_counts: tuple[int, ...]
    n_labels: int
    label_at: int | None = None

    def __post_init__(self):
        if self.n_labels < 2:
            raise ValueError("n_labels must be at least 2")
        if not self.variables:
            raise ValueError("a schema needs at least one variable")
        if len(self.classes) < 2:
            raise ValueError("a schema needs at least two classes")
        if len(self.classes) != len(self.class_counts):
            raise ValueError("class_counts must have one entry per class")

    @cached_property
    def numeric_positions(self) -> tuple[int, ...]:
        return tuple(i for i, v in enumerate(self.variables) if v.is_numeric)

    @cached_property
    def nominal_positions(self) -> tuple[int, ...]:
        return tuple(i for i, v in enumerate(self.variables) if not v.is_numeric)

    @property
    def feature_names(self) -> list[str]:
        return [v.name for v in self.variables]

    @property
    def file_columns(self) -> list[str]:
        names = self.feature_names
        at = len(names) if self.label_at is None else self.label_at
        return [*names[:at], self.label, *names[at:]]

    @property
    def most_frequent_class(self) -> int:
        return self.class_counts.index(max(self.class_counts))

    @property
    def warnings(self) -> list[str]:
        return [f"column {v.name!r} is constant" for v in self.variables if v.is_constant]

    def label_count(self, position: int) -> int:
        v = self.variables[position]
        return self.n_labels if v.is_numeric else v.n_values

    def class_costs(self, cost_sensitive: bool) -> tuple[float, ...]:
        """Smallest class over own class, so the rarest class costs 1."""
        if not cost_sensitive:
            return tuple(1.0 for _ in self.classes)
        present = [n for n in self.class_counts if n > 0]
        low = min(present) if present else 1
        return tuple(low / n if n > 0 else 1.0 for n in self.class_counts)

    def imbalance_ratios(self) -> tuple[float, ...]:
        """Largest class over own class, the inverse reading of the costs."""
        high = max(self.class_counts)
        return tuple(high / n if n > 0 else 1.0 for n in self.class_counts)

    def with_labels(self, n_labels: int) -> "RuleSchema":
        return replace(self, n_labels=n_labels)


VARIABLES_TYPE = T.StructType(
    [
        T.StructField("var_idx", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("vals", T.ArrayType(T.StringType())),
        T.StructField("as_number", T.BooleanType()),
        T.StructField("size", T.IntegerType()),
    ]
)
CLASSES_TYPE = T.StructType(
    [
        T.StructField("class_idx", T.IntegerType()),
        T.StructField("label", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("imbalance_ratio", T.DoubleType()),
    ]
)


def variables_table(spark: SparkSession, schema: RuleSchema) -> DataFrame:
    rows = [
        (i, v.name, v.kind, v.lower, v.upper, list(v.values), v.compare_as_number, v.size)
        for i, v in enumerate(schema.variables)
    ]
    return spark.createDataFrame(rows, VARIABLES_TYPE)


def classes_table(spark: SparkSession, schema: RuleSchema, cost_sensitive: bool = True) -> DataFrame:
    costs = schema.class_costs(cost_sensitive)
    ratios = schema.imbalance_ratios()
    rows = [
        (i, label, int(schema.class_counts[i]), float(costs[i]), float(ratios[i]))
        for i, label in enumerate(schema.classes)
    ]
    return spark.createDataFrame(rows, CLASSES_TYPE)


def class_indices(spark: SparkSession, schema: RuleSchema) -> DataFrame:
    return classes_table(spark, schema).select("class_idx")


def schema_from_tables(
    variables: DataFrame, classes: DataFrame, label: str, n_labels: int, label_at: int | None = None
) -> RuleSchema:
    """Rebuild a schema from its two stored tables (one row per column or class)."""
    vs = variables.orderBy("var_idx").collect()
    cs = classes.orderBy("class_idx").collect()
    return RuleSchema(
        variables=tuple(
            Variable(
                r["name"],
                r["kind"],
                r["lower"],
                r["upper"],
                tuple(r["vals"] or ()),
                bool(r["as_number"]),
                r["size"] if "size" in r else None,
            )
            for r in vs
        ),
        label=label,
        classes=tuple(r["label"] for r in cs),
        class_counts=tuple(r["n"] for r in cs),
        n_labels=n_labels,
        label_at=label_at,
    )


def fuzzy_sets(ranges: DataFrame, n_labels: int) -> DataFrame:
    """Evenly spaced triangles for every row of ``(var_idx, name, lower, upper)``.

    The outer sets lean on the ends of the range. ``upper_cut`` is the point
    half-way to the next peak; the last set has none.
    """
    if n_labels < 2:
        raise ValueError("n_labels must be at least 2")
    last = n_labels - 1
    step = (F.col("upper") - F.col("lower")) / F.lit(float(last))

    def peak(k):
        return F.col("lower") + F.col("step") * k.cast("double")

    at = F.col("label")
    mid, nxt = peak(at), peak(at + 1)
    return (
        ranges.withColumn("step", step)
        .withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .select(
            "var_idx",
            "name",
            "label",
            F.when(at == 0, mid).otherwise(peak(at - 1)).alias("left_pt"),
            mid.alias("mid_pt"),
            F.when(at == last, mid).otherwise(nxt).alias("right_pt"),
            F.when(at < last, nxt - (nxt - mid) / 2).alias("upper_cut"),
        )
    )


def fuzzy_sets_table(spark: SparkSession, schema: RuleSchema) -> DataFrame:
    ranges = variables_table(spark, schema).filter(F.col("kind") == NUMERIC)
    return fuzzy_sets(ranges.select("var_idx", "name", "lower", "upper"), schema.n_labels)
