"""Schema facts read from a table: ranges, value lists and class sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.operators.encode import finite, quoted
from ruleloom.schema import NOMINAL, NUMERIC, RuleSchema, Variable


def _is_number(dtype) -> bool:
    return isinstance(dtype, T.NumericType)


def feature_ranges(df: DataFrame, features) -> DataFrame:
    """``(var_idx, name, lower, upper)`` of the numeric features, in one scan."""
    features = list(features)
    aggs = []
    for i, name in enumerate(features):
        x = F.expr(finite(f"CAST({quoted(name)} AS DOUBLE)", df.schema[name].dataType))
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    entries = [
        F.struct(
            F.lit(i).alias("var_idx"),
            F.lit(name).alias("name"),
            F.col(f"lo{i}").alias("lower"),
            F.col(f"hi{i}").alias("upper"),
        )
        for i, name in enumerate(features)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def nominal_values(df: DataFrame, features) -> DataFrame:
    """``(name, value)``: the distinct non-null values of each nominal feature.

    The columns are turned into rows first, so one shuffle serves them all and
    duplicates are dropped on the map side before anything moves.
    """
    entries = [
        F.struct(F.lit(name).alias("name"), F.col(name).cast("string").alias("value")) for name in features
    ]
    return df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull()).distinct()


def class_profile(df: DataFrame, label: str) -> DataFrame:
    """``(class_idx, label, n, cost, imbalance_ratio)``, classes in sorted order.

    Rows are counted per label first; the array below holds one entry per class.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).count()
    packed = counts.agg(
        F.array_sort(F.collect_list(F.struct("label", F.col("count").alias("n")))).alias("c"),
        F.min("count").alias("low"),
        F.max("count").alias("high"),
    )
    return packed.select("low", "high", F.posexplode("c").alias("class_idx", "c")).select(
        "class_idx",
        F.col("c.label").alias("label"),
        F.col("c.n").alias("n"),
        (F.col("low") / F.col("c.n")).alias("cost"),
        (F.col("high") / F.col("c.n")).alias("imbalance_ratio"),
    )


def most_frequent_class(classes: DataFrame) -> DataFrame:
    """One row: the index of the largest class, the lowest index on a tie."""
    return classes.agg(
        F.max_by("class_idx", F.struct(F.col("n"), -F.col("class_idx"))).alias("most_frequent_class")
    )


def profile(
    df: DataFrame,
    features,
    label: str,
    n_labels: int = 3,
    classes=None,
    max_values: int = 10_000,
    max_classes: int = 1_000,
    dictionaries=(),
) -> RuleSchema:
    """Read a schema off a table.

    Strings and booleans become nominal, other numbers numeric, and an integer
    column with no more distinct steps than labels becomes nominal as well.
    ``classes`` fixes the class order (the first one is the positive class);
    by default the labels are sorted. Value lists and class lists end up on the
    driver, so both are counted over the whole table before they are fetched and
    refused when they are longer than the limits. Columns of ``dictionaries`` hold
    codes already; only their sizes are taken.
    """
    features = list(features)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    sizes = {d.column: d.size for d in dictionaries}
    numeric = [c for c in features if _is_number(dtypes[c]) and c not in sizes]
    nominal = [c for c in features if c not in numeric and c not in sizes]

    labels = df.select(F.col(label).cast("string")).filter(F.col(label).isNotNull()).distinct()
    if labels.limit(max_classes + 1).count() > max_classes:
        raise ValueError(f"label column {label!r} has more than {max_classes} values")
    values: dict[str, list[str]] = {c: [] for c in nominal}
    if nominal:
        distinct = nominal_values(df, nominal)
        for r in distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect():
            if r["n"] > max_values:
                raise ValueError(f"nominal column {r['name']!r} has {r['n']} values, more than {max_values}: give it a dictionary")
        for r in distinct.collect():
            values[r["name"]].append(r["value"])

    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(numeric):
        x = finite(f"CAST({quoted(name)} AS DOUBLE)", dtypes[name])
        aggs += [F.expr(f"min({x}) AS lo{i}"), F.expr(f"max({x}) AS hi{i}")]
    # One scan: a row per class with the ranges seen in that class.
    per_class = df.groupBy(F.col(label).cast("string").alias("label")).agg(*aggs).collect()


    counts = {r["label"]: r["n"] for r in per_class if r["label"] is not None}
    order = [str(c) for c in classes] if classes is not None else sorted(counts)

    variables = []
    for name in features:
        if name in sizes:
            variables.append(Variable(name, NOMINAL, size=sizes[name]))
            continue
        if name in values:
            variables.append(Variable(name, NOMINAL, values=tuple(sorted(values[name]))))
            continue
        i = numeric.index(name)
        lows = [r[f"lo{i}"] for r in per_class if r[f"lo{i}"] is not None]
        highs = [r[f"hi{i}"] for r in per_class if r[f"hi{i}"] is not None]
        if not lows:
            raise ValueError(f"numeric column {name!r} has no values")
        low, high = min(lows), max(highs)
        if isinstance(dtypes[name], T.IntegralType):
            variables.append(integer_variable(name, low, high, n_labels))
        else:
            variables.append(Variable(name, NUMERIC, low, high))
    return RuleSchema(
        variables=tuple(variables),
        label=label,
        classes=tuple(order),
        class_counts=tuple(counts.get(c, 0) for c in order),
        n_labels=n_labels,
    )


def integer_variable(name: str, low: float, high: float, n_labels: int) -> Variable:
    """A whole-number range: nominal when it has no more steps than labels."""
    if high - low + 1 <= n_labels:
        steps = tuple(repr(float(low + k)) for k in range(int(high - low) + 1))
        return Variable(name, NOMINAL, values=steps, compare_as_number=True)
    return Variable(name, NUMERIC, low, high)
