"""Per-artifact limits: bytes in scan order, number of containers, outcome.

No limit is on by default: a caller names it, or says ``None`` for no limit.
Rows with a null key or a null position are rows like any other; null keys are
one group, null positions come first.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 65_536


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    amount: Column,
    out: str,
    ties: Sequence[str] = (),
    width: int = WIDTH,
    limit: int | None = None,
) -> DataFrame:
    """Running sum of ``amount`` per key without putting a whole key in one task.

    ``order`` is an integer position. It is cut into ranges of ``width``, and
    these into ranges of ranges; each window runs within one range and starts
    from the sum of the earlier ones, so a key that holds a third of all rows is
    spread over its ranges. With ``limit``, amounts must not be negative, and
    only rows whose sum is at most ``limit`` are kept; ranges that begin above it
    are dropped before their rows are sorted.
    """
    keys = list(keys)
    position = F.floor(F.col(order) / width).cast("long")
    ranged = df.withColumn("_range", position).withColumn("_amount", amount)
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("_amount").alias("_sum"))
    sums = sums.withColumn("_wide", F.floor(F.col("_range") / width).cast("long"))
    starts = _starts(sums, [*keys, "_wide"], "_range", "_within")
    wide = sums.groupBy(*keys, "_wide").agg(F.sum("_sum").alias("_sum"))
    starts = _null_safe(starts, _starts(wide, keys, "_wide", "_before"), [*keys, "_wide"])
    starts = starts.select(*keys, "_range", (F.col("_before") + F.col("_within")).alias("_start"))
    if limit is not None:
        starts = starts.where(F.col("_start") <= limit)
    within = (
        Window.partitionBy(*keys, "_range")
        .orderBy(order, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = (
        _null_safe(ranged, starts, [*keys, "_range"])
        .withColumn(out, F.col("_start") + F.sum("_amount").over(within))
        .drop("_range", "_amount", "_start")
    )
    return summed if limit is None else summed.where(F.col(out) <= limit)


def _starts(sums: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Per key the sum of all earlier rows, exclusive."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, *({order} - set(keys)), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(out))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which null keys meet; the keys appear once."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(Column.__and__, (left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys))
    return left.join(named, same).drop(*[f"_r_{k}" for k in keys])


def within_bytes(
    df: DataFrame,
    limit: int,
    size: str = "uncompressed_size",
    keys: Sequence[str] = ("artifact_id",),
    order: str = "container_ord",
    ties: Sequence[str] = (),
    width: int = WIDTH,
) -> DataFrame:
    """Containers in order while the running sum of sizes is at most ``limit``.

    Sizes are not negative, so after the first container that does not fit none
    fits. A missing size counts as 0.
    """
    return running_total(df, keys, order, charge(size, limit), "running_bytes", ties, width, limit)


def charge(size: str, limit: int) -> Column:
    """Bytes charged for a container; sizes over the limit are all alike, so the
    sum cannot overflow."""
    return F.least(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(limit + 1))


def first_n(
    df: DataFrame,
    n: int,
    keys: Sequence[str] = ("artifact_id",),
    order: str = "container_ord",
    ties: Sequence[str] = (),
    width: int = WIDTH,
) -> DataFrame:
    """First ``n`` rows per key in order, counted by ranges for every ``n``."""
    return running_total(df, keys, order, F.lit(1).cast("long"), "_n", ties, width, n).drop("_n")


def apply_budget(
    containers: DataFrame,
    max_bytes: int | None,
    max_containers: int | None,
    size: str = "uncompressed_size",
    ties: Sequence[str] = (),
    width: int = WIDTH,
) -> DataFrame:
    """Containers with ``kept``; those beyond the count cap are left out first.

    A container that could not be read is charged like any other.
    """
    keys, order = ["artifact_id"], "container_ord"
    capped = containers if max_containers is None else first_n(containers, max_containers, keys, order, ties, width)
    if max_bytes is None:
        return capped.withColumn("kept", F.lit(True))
    summed = running_total(capped, keys, order, charge(size, max_bytes), "running_bytes", ties, width)
    return summed.withColumn("kept", F.col("running_bytes") <= max_bytes)


def outcome(
    budgeted: DataFrame,
    max_bytes: int | None,
    max_containers: int | None,
    artifacts: DataFrame | None = None,
    error: str | None = None,
) -> DataFrame:
    """Per artifact ``ok``, ``partial`` or ``failed``, with a reason.

    ``partial``: the byte budget dropped something; the count cap alone is shown
    in ``at_count_cap`` instead. ``failed``: there are containers to scan and
    none could be read, as the column ``error`` of ``budgeted`` tells (null where
    a container was read); some that could not be read are passed over. With
    ``artifacts`` every artifact has a row, ``ok`` where it has no container.
    """
    unread = F.lit(False) if error is None else F.col(error).isNotNull()
    first_error = F.lit(None).cast("string") if error is None else F.min(F.when(F.col("kept"), F.col(error)))
    counts = budgeted.groupBy("artifact_id").agg(
        F.count("*").alias("n_containers"),
        F.count_if("kept").alias("n_kept"),
        F.count_if(F.col("kept") & unread).alias("_n_unread"),
        first_error.alias("_error"),
    )
    if artifacts is not None:
        spine = artifacts.select("artifact_id").distinct()
        joined = spine.withColumnRenamed("artifact_id", "_a").join(
            counts, F.col("_a").eqNullSafe(F.col("artifact_id")), "left"
        )
        counts = joined.drop("artifact_id").withColumnRenamed("_a", "artifact_id")
        counts = counts.fillna(0, ["n_containers", "n_kept", "_n_unread"])
    dropped = F.col("n_kept") < F.col("n_containers")
    failed = (F.col("n_kept") > 0) & (F.col("_n_unread") == F.col("n_kept"))
    reason = F.format_string(
        "byte budget exceeded: %d of %d containers scanned "
        + f"(max_total_bytes={max_bytes}, max_containers={max_containers})",
        "n_kept",
        "n_containers",
    )
    unreadable = F.format_string("none of %d containers could be read: %s", "n_kept", "_error")
    capped = F.lit(False) if max_containers is None else F.col("n_containers") >= max_containers
    return counts.select(
        "artifact_id",
        "n_containers",
        "n_kept",
        F.when(failed, "failed").when(dropped, "partial").otherwise("ok").alias("outcome"),
        F.when(failed, unreadable).when(dropped, reason).alias("outcome_reason"),
        capped.alias("at_count_cap"),
    )
