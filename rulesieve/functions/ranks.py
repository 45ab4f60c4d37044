"""Ranks of the ordered enumerations, as codegen-friendly expressions."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from rulesieve import schema


def rank_in(col: str | Column, values: Sequence[str]) -> Column:
    """Position of ``col`` in ``values``; values outside the list rank last."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), _col(col))
    return F.when(position > 0, position - 1).otherwise(F.lit(len(values))).cast("int")


def value_at(rank: str | Column, values: Sequence[str]) -> Column:
    """Inverse of :func:`rank_in`."""
    return F.get(F.array(*[F.lit(v) for v in values]), _col(rank))


def category_rank(col: str | Column = "category") -> Column:
    return rank_in(col, schema.CATEGORIES)


def severity_rank(col: str | Column = "severity") -> Column:
    """0 for info up to 4 for critical; an unknown label counts below info."""
    position = F.array_position(F.array(*[F.lit(v) for v in schema.SEVERITIES]), _col(col))
    return (F.coalesce(position, F.lit(0)) - 1).cast("int")


def verdict_rank(col: str | Column = "verdict") -> Column:
    return rank_in(col, schema.VERDICTS)


def is_blocking(col: str | Column = "behavior") -> Column:
    return F.coalesce(_col(col).isin(*schema.BLOCKING_BEHAVIORS), F.lit(False))


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
