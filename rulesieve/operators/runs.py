"""Runs over the scan history: in which consecutive scans a rule fired.

A rule that fires in every scan of a large artifact is one key with all of its
scans, so scans are numbered and runs are found within ranges of numbers. Only
runs that touch the border of a range can go on in the next one; these, two a
range at most, are put together per key.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from rulesieve.operators.budgets import WIDTH, running_total


def firing_runs(
    scans: DataFrame,
    findings: DataFrame,
    keys: Sequence[str] = ("artifact_id",),
    scan: str = "scan",
    rule: str = "rule_id",
    width: int = WIDTH,
) -> DataFrame:
    """One row per run: keys, rule, ``first_scan``, ``last_scan``, ``n_scans``, ``still_firing``.

    ``scans`` lists the scans of each key, ``findings`` in which of them a rule
    fired; ``scan`` is an integer that ascends with time, gaps do not matter.
    ``still_firing`` says that the run reaches the key's last scan. Repeated rows
    count once, findings of scans that are not listed not at all, and rows with a
    null key, scan or rule are left out.
    """
    keys = list(keys)
    listed = scans.select(*keys, F.col(scan).cast("long").alias("_scan")).na.drop().distinct()
    numbered = running_total(listed, keys, "_scan", F.lit(1), "_place", width=width)
    # Only whether a rule fired counts, so what is joined is one row per key, scan and rule.
    fired = findings.select(*keys, F.col(scan).cast("long").alias("_scan"), F.col(rule).alias("_rule")).na.drop()
    placed = fired.distinct().join(numbered, [*keys, "_scan"]).withColumn(
        "_range", F.floor((F.col("_place") - 1) / width).cast("long")
    )
    within = Window.partitionBy(*keys, "_rule", "_range").orderBy("_place")
    parts = (
        placed.withColumn("_island", F.col("_place") - F.row_number().over(within))
        .groupBy(*keys, "_rule", "_range", "_island")
        .agg(
            F.min("_place").alias("_from"),
            F.max("_place").alias("_to"),
            F.min("_scan").alias("_first"),
            F.max("_scan").alias("_last"),
        )
    )
    at_border = (F.col("_from") % width == F.lit(1 % width)) | (F.col("_to") % width == 0)
    parts = parts.withColumn("_group", F.when(at_border, F.lit(-1)).otherwise(F.col("_range")))
    ordered = Window.partitionBy(*keys, "_rule", "_group").orderBy("_from")
    begins = F.coalesce(F.lag("_to").over(ordered) != F.col("_from") - 1, F.lit(True))
    runs = (
        parts.withColumn("_begins", begins.cast("long"))
        .withColumn("_run", F.sum("_begins").over(ordered))
        .groupBy(*keys, "_rule", "_group", "_run")
        .agg(
            F.min("_first").alias("first_scan"),
            F.max("_last").alias("last_scan"),
            F.sum(F.col("_to") - F.col("_from") + 1).alias("n_scans"),
        )
    )
    latest = listed.groupBy(*keys).agg(F.max("_scan").alias("_latest"))
    return runs.join(latest, keys).select(
        *keys,
        F.col("_rule").alias(rule),
        "first_scan",
        "last_scan",
        "n_scans",
        (F.col("last_scan") == F.col("_latest")).alias("still_firing"),
    )


def firing_history(runs: DataFrame, keys: Sequence[str] = ("artifact_id",), rule: str = "rule_id") -> DataFrame:
    """Per key and rule: first and last seen, scans, ``flaps`` (how often it came back), longest run."""
    return runs.groupBy(*keys, rule).agg(
        F.min("first_scan").alias("first_seen"),
        F.max("last_scan").alias("last_seen"),
        F.sum("n_scans").alias("n_scans"),
        (F.count(F.lit(1)) - 1).alias("flaps"),
        F.max("n_scans").alias("longest_run"),
        F.bool_or("still_firing").alias("still_firing"),
    )
