"""Distinct counts and quantiles that are kept per scan and merged without the rows.

Distinct counts are HyperLogLog sketches of Spark, one small value per group.
Quantiles are counts of logarithmic bins: a bin holds the amounts that differ by
at most the stated relative error, so counts of bins are all that has to be kept,
and adding them up merges any number of scans in any order.
"""

from collections.abc import Sequence
from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Binary logarithm of a distinct sketch's registers.
LG_REGISTERS = 12
#: Relative error of a quantile.
ACCURACY = 0.01


def distinct_error(lg_registers: int = LG_REGISTERS, deviations: float = 4.0) -> float:
    """Relative error that a distinct count stays within, at so many standard deviations."""
    return deviations * 1.04 / sqrt(2**lg_registers)


def distinct_sketches(rows: DataFrame, by: Sequence[str], of: str, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """``by`` and ``sketch``, the distinct values of ``of``; nulls are no value."""
    text = F.col(of).cast("string")
    return rows.groupBy(*by).agg(F.hll_sketch_agg(text, F.lit(lg_registers)).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of finer groups, or of several scans, as one per ``by``."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))


def distinct_estimates(sketches: DataFrame, out: str = "estimate") -> DataFrame:
    return sketches.withColumn(out, F.hll_sketch_estimate("sketch")).drop("sketch")


def _base(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return log((1 + accuracy) / (1 - accuracy))


def amount_bins(rows: DataFrame, by: Sequence[str], amount: Column, accuracy: float = ACCURACY) -> DataFrame:
    """``by``, ``bin`` and ``n``: how many amounts are in a bin.

    Amounts above zero go to the bin of their logarithm; zero has the bin null.
    Null, negative and non-finite amounts are left out. There are some
    ``log(largest / smallest) / (2 accuracy)`` bins a group, whatever its rows.
    """
    value = amount.cast("double")
    counted = rows.withColumn("_amount", value).where("_amount >= 0 and _amount < double('infinity')")
    bin_ = F.when(F.col("_amount") > 0, F.ceil(F.log("_amount") / _base(accuracy)).cast("int"))
    return counted.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def merge_bins(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bins of finer groups, or of several scans, added up per ``by``."""
    return bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def quantiles(bins: DataFrame, by: Sequence[str], shares: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """``by`` and ``quantiles``, for each share the smallest amount that so many are not above.

    Bins are read with the accuracy they were made with. A window holds the bins
    of one group, which are bounded.
    """
    by, base = list(by), _base(accuracy)
    over = Window.partitionBy(*by).orderBy(F.col("bin").asc_nulls_first())
    # The middle of a bin, which is within the relative error of both ends.
    middle = F.coalesce(F.exp(F.col("bin") * base) * (1 - accuracy), F.lit(0.0))
    placed = bins.withColumn("_up_to", F.sum("n").over(over)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    reached = [
        F.min(F.when(F.col("_up_to") >= F.greatest(F.ceil(F.col("_all") * share), F.lit(1)), middle)) for share in shares
    ]
    return placed.groupBy(*by).agg(F.array(*reached).alias("quantiles"))
