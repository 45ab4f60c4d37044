"""Joins of rows that are near or overlap in time or position.

Neither has an equality that would bring matching rows together. Both here deal
time or positions into ranges that follow from the data, so a key that a third
of all rows share is worked on in many tasks, and neither plans a nested loop.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Rows of one key that are sorted together, about.
RANGE_ROWS = 50_000
#: Spans per range in which rows are counted before ranges are cut.
_SPANS = 16
#: Lengths of intervals are told apart by powers of this.
_LEVEL_BASE = 4


def as_of(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str],
    values: Sequence[str] | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` at or before it in the column ``on``.

    Both sides have ``on`` (a number, date or time) and at least one column
    ``by``; rows match within equal ``by``. ``values`` are the columns taken over
    (all others by default), under ``right_<name>``; of several rows at the same
    time the one that is largest in them, in their order, is the last.

    A row of ``left`` without an earlier one stays, with nulls; so does one whose
    ``on`` or ``by`` holds a null, which matches nothing, and rows that repeat
    stay as often as they are there. Rows of ``right`` with such nulls are left
    out.

    One union of both sides is sorted by time and the last value carried on,
    within time ranges of about ``range_rows`` rows of a key. Each range leaves
    one row behind, its last value; these are carried over the ranges of the key
    and handed to the next one.
    """
    by = list(by)
    if not by:
        raise ValueError("as_of needs a column to match by")
    values = [c for c in right.columns if c not in (on, *by)] if values is None else list(values)
    names = [f"_by{i}" for i in range(len(by))]
    complete = _all_set([on, *by])
    keys = [F.col(c).alias(n) for c, n in zip(by, names)]
    last = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)], F.lit(0).alias("any"))
    kept = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(left.columns)])
    mine = left.where(complete).select(*keys, F.col(on).alias("_at"), kept.alias("_left"))
    theirs = right.where(complete).select(*keys, F.col(on).alias("_at"), last.alias("_right"))
    both = _ranged(mine.unionByName(theirs, allowMissingColumns=True), names, range_rows)
    # At equal times the other side comes first, its largest row last.
    order = [F.col("_at"), F.col("_left").isNotNull(), F.col("_right")]
    so_far = Window.partitionBy(*names, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_right", ignorenulls=True).over(so_far)).where("_left is not null")
    latest = F.max(F.when(F.col("_right").isNotNull(), F.struct("_at", "_right")))
    ends = both.groupBy(*names, "_range").agg(latest.alias("_end"))
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*names, "_range", F.last("_end", ignorenulls=True).over(earlier)["_right"].alias("_handed"))
    found = here.join(handed.where("_handed is not null"), [*names, "_range"], "left")
    taken = F.coalesce("_here", "_handed")
    matched = found.select(
        *[F.col(f"_left.c{i}").alias(c) for i, c in enumerate(left.columns)],
        *[taken[f"v{i}"].alias(f"right_{c}") for i, c in enumerate(values)],
    )
    unmatched = left.where(~complete).select(
        *left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(f"right_{c}") for c in values]
    )
    return matched.unionByName(unmatched)


def _all_set(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def _ranged(rows: DataFrame, keys: Sequence[str], range_rows: int) -> DataFrame:
    """``rows`` with ``_range``, which ascends with ``_at`` within a key.

    Keys of more than ``range_rows`` rows are counted in equal spans of time,
    and neighbouring spans are put together to about that many rows. Rows at one
    and the same time stay together.
    """
    at = _number(F.col("_at"), rows.schema["_at"].dataType)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to"))
    spans = F.ceil(F.col("_n") / range_rows) * _SPANS
    large = sizes.where((F.col("_n") > range_rows) & (F.col("_to") > F.col("_from"))).select(
        *keys, "_from", ((F.col("_to") - F.col("_from")) / spans).alias("_width")
    )
    placed = rows.join(large, list(keys), "left").withColumn("_span", F.floor((at - F.col("_from")) / F.col("_width")))
    counted = placed.where("_span is not null").groupBy(*keys, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    dealt = counted.select(*keys, "_span", F.floor(earlier / range_rows).cast("long").alias("_range"))
    out = placed.join(dealt, [*keys, "_span"], "left").withColumn("_range", F.coalesce("_range", F.lit(0).cast("long")))
    return out.drop("_from", "_width", "_span")


def _number(at: Column, kind: T.DataType) -> Column:
    """A number that ascends with ``at``; seconds for times, whatever the session's zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at).cast("double") / 1e6
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        days = F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("double") * 86_400
        if isinstance(kind, T.DateType):
            return days
        return days + F.hour(at) * 3_600 + F.minute(at) * 60 + F.second(at)
    return at.cast("double")


def overlapping(
    left: DataFrame,
    right: DataFrame,
    start: str = "start",
    end: str = "end",
    by: Sequence[str] = (),
) -> DataFrame:
    """Pairs of rows of both sides whose ranges ``[start, end)`` overlap, within equal ``by``.

    Starts and ends are whole numbers. The pair carries ``by``, the columns of
    ``left`` under ``left_<name>`` and those of ``right`` under ``right_<name>``.
    Ranges that are empty or turned round overlap nothing, nor do rows with a
    null in ``start``, ``end`` or ``by``; rows that repeat give as many pairs.

    A range belongs to the level of its length, a power of four, and touches at
    most two bins of that width there. A pair meets at the level of its longer
    range, to whose bins the shorter one is copied, and is reported in the bin in
    which the overlap begins. So short ranges never meet each other in the wide
    bins that long ranges need. Levels that occur (at most 32 numbers) are looked
    at first; copies are made only for these.
    """
    by = list(by)
    sides = [_levelled(df, start, end, by) for df in (left, right)]
    levels = sorted({r["_level"] for side in sides for r in side.select("_level").distinct().collect()})
    names = [f"_by{i}" for i in range(len(by))]
    keys = [*names, "_at_level", "_bin"]
    own = [_binned(side, [], levels) for side in sides]
    finer = [_binned(side, levels, levels) for side in sides]
    parts = [
        _met(own[0], own[1].unionByName(finer[1]), keys),
        _met(finer[0], own[1], keys),
    ]
    both = parts[0].unionByName(parts[1])
    return both.select(
        *[F.col(n).alias(c) for n, c in zip(names, by)],
        *[F.col(f"_l.c{i}").alias(f"left_{c}") for i, c in enumerate(left.columns) if c not in by],
        *[F.col(f"_r.c{i}").alias(f"right_{c}") for i, c in enumerate(right.columns) if c not in by],
    )


def _levelled(df: DataFrame, start: str, end: str, by: Sequence[str]) -> DataFrame:
    """``(_by…, _start, _end, _level, _row)``; widths of a level are the next power of the base from the length on."""
    first, after = F.col(start).cast("long"), F.col(end).cast("long")
    level = F.ceil(F.log(float(_LEVEL_BASE), (F.col("_end") - F.col("_start")).cast("double"))).cast("int")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = df.where(_all_set([start, end, *by]) & (after > first)).select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], first.alias("_start"), after.alias("_end"), row.alias("_row")
    )
    return rows.withColumn("_level", F.least(level, F.lit(31)))


def _binned(side: DataFrame, coarser: Sequence[int], levels: Sequence[int]) -> DataFrame:
    """Copies in the bins of the own level, or of all coarser ones that occur."""
    at = F.array(*map(F.lit, coarser)) if coarser else F.array("_level")
    chosen = F.filter(at, lambda k: k > F.col("_level")) if coarser else at
    rows = side.select("*", F.explode(chosen).alias("_at_level"))
    width = F.element_at(F.array(*[F.lit(_LEVEL_BASE**k if k < 31 else 2**62) for k in range(32)]), F.col("_at_level") + 1)
    rows = rows.withColumn("_w", width.cast("long"))
    bins = F.sequence(_bin_of("_start"), _bin_of("_end - 1"))
    return rows.withColumn("_bin", F.explode(bins)).drop("_level")


def _bin_of(position: str) -> Column:
    """The bin of width ``_w``, in whole numbers and rounded down below zero too."""
    return F.expr(f"(({position}) - pmod({position}, _w)) div _w")


def _met(one: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [c for c in one.columns if c not in ("_start", "_end", "_row")]
    first = one.select(*names, F.col("_start").alias("_s1"), F.col("_end").alias("_e1"), F.col("_row").alias("_l"))
    second = other.select(*keys, F.col("_start").alias("_s2"), F.col("_end").alias("_e2"), F.col("_row").alias("_r"))
    overlap = (F.col("_s1") < F.col("_e2")) & (F.col("_s2") < F.col("_e1"))
    begins = _bin_of("greatest(_s1, _s2)") == F.col("_bin")
    return first.join(second, list(keys)).where(overlap & begins)
