"""Dataset headers: declared variables, the output column and class sizes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.profile import integer_variable
from ruleloom.schema import NOMINAL, NUMERIC, RuleSchema, Variable

# The header keywords and the shapes of their lines.
ATTRIBUTE_KEY = "@attribute"
OUTPUT_KEYS = ("@output", "@outputs")
COUNTS_KEY = "@numinstancesbyclass"
NOMINAL_LINE = r"(?i)^@attribute\s+([^\s{\[]+)\s*\{([^}]*)\}"
RANGE_LINE = r"(?i)^@attribute\s+([^\s{\[]+)\s+(integer|real)\s*\[([^\]]*)\]"
OUTPUT_LINE = r"(?i)^@outputs?\s+(.+)$"
COUNTS_LINE = r"(?i)^@numInstancesByClass\s+(.+)$"


def header_items(lines: DataFrame) -> DataFrame:
    """One row per recognised header line, in file order.

    ``(line_no, item, name, kind, items)``: ``items`` are the values of a
    nominal column, the two ends of a range, the output names or the class
    sizes. Unknown keywords are ignored; an empty line has item ``empty`` and a
    badly formed declaration ``malformed``.
    """
    line = F.trim("value")
    word = F.lower(F.element_at(F.split(line, r"\s+"), 1))
    nominal, ranged = F.rlike(line, F.lit(NOMINAL_LINE)), F.rlike(line, F.lit(RANGE_LINE))

    def part(pattern, group):
        return F.regexp_extract(line, pattern, group)

    items = (
        F.when(nominal, part(NOMINAL_LINE, 2))
        .when(ranged, part(RANGE_LINE, 3))
        .when(word.isin(*OUTPUT_KEYS), part(OUTPUT_LINE, 1))
        .when(word == COUNTS_KEY, part(COUNTS_LINE, 1))
    )
    item = (
        F.when(line == "", "empty")
        .when(word.isin(*OUTPUT_KEYS), "output")
        .when(word == COUNTS_KEY, "counts")
        .when((word == ATTRIBUTE_KEY) & (nominal | ranged), "attribute")
        .when(word == ATTRIBUTE_KEY, "malformed")
    )
    split = F.filter(F.transform(F.split(items, ","), lambda v: F.trim(v)), lambda v: v != "")
    return lines.select(
        F.monotonically_increasing_id().alias("line_no"),
        item.alias("item"),
        F.when(nominal, part(NOMINAL_LINE, 1)).when(ranged, part(RANGE_LINE, 1)).alias("name"),
        F.when(nominal, F.lit("nominal")).when(ranged, F.lower(part(RANGE_LINE, 2))).alias("kind"),
        split.alias("items"),
    ).filter(F.col("item").isNotNull())


def read_header(spark: SparkSession, path, n_labels: int = 3) -> RuleSchema:
    """Read a header file into a schema.

    Files are small (a line per column) and end up as the schema on the driver.
    An integer range with no more steps than labels becomes nominal.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.explode(F.split(F.regexp_replace("value", r"(\r?\n)+$", ""), r"\r?\n")).alias("value")
    )
    return schema_from_items(header_items(lines).orderBy("line_no").collect(), n_labels)


def schema_from_items(rows, n_labels: int) -> RuleSchema:
    variables: list[Variable] = []
    output, counts = None, None
    for r in rows:
        if r["item"] == "empty":
            raise ValueError("header files must not have empty lines")
        if r["item"] == "malformed":
            raise ValueError("an attribute needs a name and either values or a typed range")
        if r["item"] == "attribute":
            if r["kind"] == "nominal":
                variables.append(Variable(r["name"], NOMINAL, values=tuple(r["items"])))
            else:
                low, high = float(r["items"][0]), float(r["items"][1])
                if r["kind"] == "integer":
                    variables.append(integer_variable(r["name"], low, high, n_labels))
                else:
                    variables.append(Variable(r["name"], NUMERIC, low, high))
        elif r["item"] == "output":
            if len(r["items"]) != 1:
                raise ValueError("exactly one output column is supported")
            output = r["items"][0]
        elif r["item"] == "counts":
            counts = tuple(int(v) for v in r["items"])
    if counts is None:
        raise ValueError("the header does not give the number of examples of each class")
    label = next((v for v in variables if v.name == output), None)
    if label is None:
        raise ValueError("the output names no declared attribute")
    if label.is_numeric:
        raise ValueError("the output attribute must be nominal")
    features = tuple(v for v in variables if v is not label)
    return RuleSchema(features, label.name, label.values, counts, n_labels, variables.index(label))


def class_sizes(spark: SparkSession, path) -> list[int]:
    """Only the class sizes of a header."""
    lines = spark.read.text(path)
    rows = header_items(lines).filter(F.col("item") == "counts").select("items").collect()
    if not rows:
        raise ValueError("the header does not give the number of examples of each class")
    return [int(v) for v in rows[-1]["items"]]


def numeric_range(text: str) -> tuple[float, float]:
    """The two ends in ``… [lo, hi]``."""
    low, high = re.search(r"\[([^\]]*)\]", text).group(1).split(",")
    return float(low), float(high)


def value_list(text: str) -> list[str]:
    """The values in ``… {a, b}``."""
    return [v.strip() for v in re.search(r"\{([^}]*)\}", text).group(1).split(",")]
