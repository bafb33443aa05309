"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: str | Column, eps: float = 1e-12) -> Column:
    """v / max(norm, eps): a zero vector stays zero. The norm is bound to a variable, so that it is computed once a vector."""
    length = F.array(F.greatest(norm(v), F.lit(eps)))
    return F.element_at(F.transform(length, lambda n: F.transform(col(v), lambda x: x.cast("double") / n)), 1)


def sigmoid(c: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def pick(value: str | Column, by: str | Column, lowest: str | Column) -> Column:
    """Aggregate: value of the row with the greatest `by`, ties to the smallest `lowest`."""
    return F.max_by(col(value), F.struct(col(by), -col(lowest)))
