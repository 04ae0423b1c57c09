"""Rows to indices: class index, typed features, labels and antecedents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.functions.membership import class_index, cuts, membership_vector, nominal_label
from ruleloom.params import Params
from ruleloom.schema import RuleSchema

CLASS = "class_idx"
CHUNK = "chunk_id"
LOOKUP_FROM = 64
BROADCAST_VALUES = 200_000


def x_col(i: int) -> str:
    return f"__x{i}"


def assigned(df: DataFrame, row_id: str, n: int, params: Params, purpose: str) -> Column:
    """A number below ``n`` from a row's id only, so file layout does not matter.

    ``assign='id'`` takes the id modulo ``n``, which keeps rows of neighbouring ids apart
    but makes two such numbers of one row depend on each other. ``'digest'`` draws from a
    digest of seed, purpose and id: chunks and folds are then independent.
    """
    key = F.col(row_id)
    if params.assign == "digest":
        digest = F.md5(F.concat_ws("|", F.lit(str(params.seed)), F.lit(purpose), key.cast("string")))
        key = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    elif not isinstance(df.schema[row_id].dataType, T.IntegralType):
        key = F.xxhash64(key)
    return F.pmod(key, F.lit(n)).cast("int")


def chunk_of(df: DataFrame, row_id: str | None, n_chunks: int, params: Params = Params()) -> Column:
    """Chunk number of a row."""
    if n_chunks == 1:
        return F.lit(0)
    if row_id is None:
        raise ValueError("n_chunks > 1 needs a row_id column")
    return assigned(df, row_id, n_chunks, params, "chunk")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def finite(number: str, dtype) -> str:
    """SQL for a double that is null where it is no number or infinite."""
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return number
    return f"IF(abs({number}) < double('infinity'), {number}, NULL)"


def all_finite(numbers: list[str]) -> str:
    """SQL that is false where one of the doubles is null, no number or infinite.

    Zero times such a value isn't zero. One test of the sum keeps scoring code short
    enough for the JVM to compile.
    """
    return f"coalesce({' + '.join(f'{n} * 0D' for n in numbers)} = 0D, false)"


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def encode(
    df: DataFrame,
    schema: RuleSchema,
    keep=(),
    bad_rows: str = "error",
    learning: bool = True,
    need_class: bool = True,
) -> DataFrame:
    """``keep`` columns, the class index and one typed column per feature.

    Learning refuses unknown classes and, with ``bad_rows='error'``, unreadable
    features; ``'drop'`` leaves such rows out. Scoring skips rows of an unknown
    class and keeps unknown nominal values, which simply match no rule.
    """
    out = [F.col(c) if isinstance(c, str) else c for c in keep]
    if need_class:
        idx = class_index(F.col(schema.label), schema.classes)
        if learning:
            idx = F.when(idx >= 0, idx).otherwise(_fail("a row has an unknown class label"))
        out.append(idx.alias(CLASS))

    lookups = []
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = {}
    for i in schema.numeric_positions:
        name = schema.variables[i].name
        cast = "try_cast" if isinstance(types[name], T.StringType) else "CAST"
        numbers[i] = f"{cast}({quoted(name)} AS DOUBLE)"
    for i, var in enumerate(schema.variables):
        raw = F.col(quoted(var.name))
        if var.is_numeric:
            number = finite(numbers[i], types[var.name])
            if bad_rows == "error":
                # Not null from here on; the first column carries the test of all.
                number = f"coalesce({numbers[i]}, 0D)"
                if i == min(numbers):
                    names = ", ".join(schema.variables[k].name for k in numbers).replace("\\", "").replace("'", "")
                    failed = f"CAST(raise_error('a row has an unreadable number in one of the columns {names}') AS DOUBLE)"
                    number = f"coalesce(IF({all_finite(list(numbers.values()))}, {numbers[i]}, {failed}), 0D)"
            out.append(F.expr(f"{number} AS {x_col(i)}"))
            continue
        if len(var.values) > LOOKUP_FROM and not var.compare_as_number:
            lookups.append(i)
            x = raw.cast("string")
        else:
            x = nominal_label(raw, var)
        out.append(x.alias(x_col(i)))
    res = df.select(*out)
    if need_class and not learning:
        res = res.filter(F.col(CLASS) >= 0)
    # Long value lists are joined instead of searched; broadcast up to a length.
    for i in lookups:
        values = schema.variables[i].values
        table = df.sparkSession.createDataFrame(
            [(v, k) for k, v in enumerate(values)], f"`{x_col(i)}` string, __code int"
        )
        side = F.broadcast(table) if len(values) <= BROADCAST_VALUES else table
        res = res.join(side, x_col(i), "left").withColumn(
            x_col(i), F.coalesce(F.col("__code"), F.lit(-1))
        )
        res = res.drop("__code")
    if learning and bad_rows == "error":
        for i in schema.nominal_positions:
            name = schema.variables[i].name
            res = res.withColumn(
                x_col(i),
                F.when(F.col(x_col(i)) < 0, _fail(f"column {name} has an unknown value")).otherwise(
                    F.col(x_col(i))
                ),
            )
    if bad_rows == "drop":
        good = [f"{x_col(i)} IS NOT NULL" for i in schema.numeric_positions]
        if learning:
            good += [f"{x_col(i)} >= 0" for i in schema.nominal_positions]
        res = res.filter(" AND ".join(good) or "true")
    return res


def own_labels(schema: RuleSchema) -> list[Column]:
    """The label of every feature of an encoded row."""
    out = []
    for i, v in enumerate(schema.variables):
        if not v.is_numeric:
            out.append(F.col(x_col(i)))
            continue
        ends = cuts(v.lower, v.upper, schema.n_labels)
        whens = " ".join(f"WHEN {x_col(i)} < ({c!r}D) THEN {k}" for k, c in enumerate(ends))
        out.append(F.expr(f"CASE {whens} ELSE {schema.n_labels - 1} END"))
    return out


def rule_key(labels) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in labels])


def antecedents_of(key: Column) -> Column:
    return F.split(key, r"\|").cast("array<int>")


def fuzzify(
    df: DataFrame, schema: RuleSchema, row_id: str, params: Params = Params(), n_chunks: int | None = None
) -> DataFrame:
    """``(row_id, chunk_id, class_idx, rule_key, labels, mu)`` for every row.

    ``labels`` is the rule the row suggests, ``mu`` the degrees of its values in
    all labels. Scoring and learning do not need this wide form; it is the view
    a user looks at.
    """
    chunks = chunk_of(df, row_id, n_chunks or params.n_chunks, params)
    base = encode(df, schema, [F.col(row_id).alias("row_id"), chunks.alias(CHUNK)], params.bad_rows)
    labels = own_labels(schema)
    mu = []
    for i, v in enumerate(schema.variables):
        if v.is_numeric:
            mu.append(membership_vector(F.col(x_col(i)), v, schema.n_labels))
        else:
            mu.append(
                F.transform(
                    F.sequence(F.lit(0), F.lit(v.n_values - 1)),
                    lambda k, c=F.col(x_col(i)): F.when(k == c, 1.0).otherwise(0.0),
                )
            )
    return base.select(
        "row_id", CHUNK, CLASS, rule_key(labels).alias("rule_key"), F.array(*labels).alias("labels"), F.array(*mu).alias("mu")
    )
