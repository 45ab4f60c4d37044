"""Keyed comparison of two sets of findings."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rulesieve import schema
from rulesieve.functions.ranks import category_rank, rank_in

KEYS = ("artifact_id", "rule_id", "category")


def latest_by_key(findings: DataFrame, keys: Sequence[str] = KEYS, seq: str = "seq") -> DataFrame:
    """One row per key, the last by ``seq`` (among equals the largest); combined before the shuffle."""
    rest = [c for c in findings.columns if c not in keys and c != seq]
    last = F.max_by(F.struct(*rest), F.struct(seq, *rest)).alias("_last")
    return findings.groupBy(*keys).agg(last, F.max(seq).alias(seq)).select(*keys, seq, "_last.*")


def diff(
    old: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, seq: str | None = None
) -> DataFrame:
    """Keys added, removed and unchanged, with the newer row's attributes.

    Repeated keys are reduced to the last row by ``seq``; without it, or among
    equal ``seq``, to the row with the largest attributes, so the result does not
    depend on arrival. Both sides are aggregated together: one shuffle of
    pre-combined rows, no join.
    """
    rest = [c for c in new.columns if c not in keys and c != seq]
    return _changes(_side(old, F.lit(False), rest, keys, seq).unionByName(_side(new, F.lit(True), rest, keys, seq)), keys)


def diff_marked(findings: DataFrame, is_new: str, keys: Sequence[str] = KEYS, seq: str | None = None) -> DataFrame:
    """:func:`diff` of one table whose column ``is_new`` tells the sides apart."""
    rest = [c for c in findings.columns if c not in keys and c not in (seq, is_new)]
    return _changes(_side(findings, F.col(is_new), rest, keys, seq), keys)


def _side(df: DataFrame, is_new: Column, rest: Sequence[str], keys: Sequence[str], seq: str | None) -> DataFrame:
    order = F.col(seq) if seq else F.lit(0)
    return df.select(*keys, is_new.alias("_new"), order.alias("_seq"), F.struct(*rest).alias("_row"))


def _changes(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    last = both.groupBy(*keys).agg(
        F.max_by("_row", F.struct("_new", "_seq", "_row")).alias("_last"),
        F.max("_new").alias("_in_new"),
        F.min("_new").alias("_only_new"),
    )
    status = (
        F.when(F.col("_only_new"), "added").when(~F.col("_in_new"), "removed").otherwise("unchanged")
    )
    return last.select(*keys, status.alias("status"), "_last.*")


def diff_counts(changes: DataFrame) -> DataFrame:
    """One row with the number of keys per status, zeros included."""
    return changes.agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in schema.DIFF_STATUSES]
    )


def order_diff(changes: DataFrame) -> DataFrame:
    """Listing order: status, canonical category, rule."""
    ties = [c for c in ("artifact_id",) if c in changes.columns]
    return changes.orderBy(rank_in("status", schema.DIFF_STATUSES), category_rank(), "rule_id", *ties)
