"""Fuzzy scalar functions as column expressions.

Break points are plain doubles worked out once on the driver from the column
range; every expression below is a CASE over literals, which Spark compiles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleloom.schema import Variable


def peaks(lower: float, upper: float, n_labels: int) -> list[float]:
    step = (upper - lower) / (n_labels - 1)
    return [lower + step * k for k in range(n_labels)]


def cuts(lower: float, upper: float, n_labels: int) -> list[float]:
    """Points where one label hands over to the next."""
    p = peaks(lower, upper, n_labels)
    return [b - (b - a) / 2 for a, b in zip(p, p[1:])]


def triangle(x: Column, left, mid, right) -> Column:
    """Degree of ``x`` in a triangle; a side of no width counts as 1 at its point."""
    left, mid, right = (c if isinstance(c, Column) else F.lit(float(c)) for c in (left, mid, right))
    return (
        F.when(x == mid, F.when((left <= x) & (x <= right), 1.0).otherwise(0.0))
        .when((left <= x) & (x < mid), (x - left) / (mid - left))
        .when((mid < x) & (x <= right), (right - x) / (right - mid))
        .otherwise(0.0)
    )


def numeric_label(x: Column, var: Variable, n_labels: int) -> Column:
    """First label whose upper cut lies above ``x``; ties go up, ends clamp."""
    out = None
    for label, cut in enumerate(cuts(var.lower, var.upper, n_labels)):
        out = F.when(x < cut, label) if out is None else out.when(x < cut, label)
    return out.otherwise(n_labels - 1)


def numeric_membership(x: Column, var: Variable, n_labels: int, label: int) -> Column:
    p = peaks(var.lower, var.upper, n_labels)
    left = p[label] if label == 0 else p[label - 1]
    right = p[label] if label == n_labels - 1 else p[label + 1]
    return triangle(x, left, p[label], right)


def membership_vector(x: Column, var: Variable, n_labels: int) -> Column:
    """Degrees of ``x`` in every label of ``var`` (0/1 for nominal values)."""
    if var.is_numeric:
        return F.array(*[numeric_membership(x, var, n_labels, k) for k in range(n_labels)])
    own = nominal_label(x, var)
    if var.size:
        return F.transform(F.sequence(F.lit(0), F.lit(var.size - 1)), lambda k: F.when(own == k, 1.0).otherwise(0.0))
    return F.array(*[F.when(own == k, 1.0).otherwise(0.0) for k in range(len(var.values))])


def nominal_label(x: Column, var: Variable) -> Column:
    """Position in the value list, -1 when absent or null."""
    if var.size:
        code = x.try_cast("int")
        return F.when(code.between(0, var.size - 1), code).otherwise(-1)
    if var.compare_as_number:
        values = F.array(*[F.lit(float(v)) for v in var.values])
        x = x.try_cast("double")
    else:
        values = F.array(*[F.lit(v) for v in var.values])
        x = x.cast("string")
    return (F.coalesce(F.array_position(values, x), F.lit(0)) - 1).cast("int")


def class_index(x: Column, classes) -> Column:
    """Position of a class label, -1 when unknown or null."""
    values = F.array(*[F.lit(c) for c in classes])
    return (F.coalesce(F.array_position(values, x.cast("string")), F.lit(0)) - 1).cast("int")


def pick(labels, index: Column) -> Column:
    """The label at a zero-based index, null outside the list."""
    return F.get(F.array(*[F.lit(v) for v in labels]), index)


def association(degree: Column, weight: Column) -> Column:
    return degree * weight


def stable(x: Column) -> Column:
    """Rounded to 12 places: sums taken in another order give the same value."""
    return F.round(x, 12)

