"""Small text expressions used by reports and history."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from rulesieve.schema import PREVIEW_CHARS

# The counter line that stored reports carry, as it is written and as it is read.
COUNTS_TEXT = "**Findings:** %d total — %d triggered, %d bypassed, %d unknown"
COUNTS_LINE = r"(\d+)\s+total\s+—\s+(\d+)\s+triggered,\s+(\d+)\s+bypassed,\s+(\d+)\s+unknown"
COUNT_NAMES = ("total", "triggered", "bypassed", "unknown")

# What a stored evaluation report says overall, in test order.
OVERALL_MARKERS = (
    ("✓ PASS —", "pass"),
    ("✗ FAIL —", "fail"),
    ("⚠ INCONCLUSIVE —", "inconclusive"),
    ("⚪ NO BLOCKING DETECTIONS —", "no_blocking"),
    ("⚠ SIMULATION ERROR —", "error"),
)


def fingerprint(col: Column) -> Column:
    """SHA-256 of the content, in hex."""
    return F.sha2(col, 256)


def utc_millis(ts: Column) -> Column:
    """Epoch milliseconds of a TIMESTAMP_NTZ read as UTC, whatever the session zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def minute_text(millis: Column, zone: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm`` of epoch milliseconds in ``zone``."""
    local = F.timestamp_millis(millis).cast("timestamp_ntz")
    shifted = F.convert_timezone(F.current_timezone(), F.lit(zone), local)
    return F.date_format(shifted, "yyyy-MM-dd HH:mm")


def bucketed_key(key: Column, millis: Column, seconds: int = 60) -> Column:
    """SHA-256 of ``key:bucket``: equal for all times (epoch ms) of one bucket."""
    bucket = F.floor(millis / F.lit(seconds * 1000)).cast("long")
    return F.sha2(F.concat_ws(":", key.cast("string"), bucket.cast("string")), 256)


def truncate(col: Column, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters, with an ellipsis only where something was cut."""
    return F.when(F.char_length(col) > n, F.concat(F.substring(col, 1, n), F.lit("…"))).otherwise(col)


def parse_counts(col: Column) -> Column:
    """Struct of the four counters in a stored report; null where there are none.

    Any counter too large for an int makes the whole result null.
    """
    parts = [
        F.regexp_extract(col, COUNTS_LINE, i + 1).try_cast("int").alias(name)
        for i, name in enumerate(COUNT_NAMES)
    ]
    counts = F.struct(*parts)
    readable = col.rlike(COUNTS_LINE)
    for i in range(1, len(COUNT_NAMES)):
        readable = readable & F.regexp_extract(col, COUNTS_LINE, i + 1).try_cast("int").isNotNull()
    return F.when(readable, counts)


def classify_marker(col: Column, markers: Sequence[tuple[str, str]] = OVERALL_MARKERS) -> Column:
    """Label of the first marker, in list order, that the text contains."""
    found = None
    for text, label in markers:
        test = F.contains(col, F.lit(text))
        found = F.when(test, F.lit(label)) if found is None else found.when(test, F.lit(label))
    return found


def marker_explanation(
    col: Column, markers: Sequence[str] = tuple(m for m, _ in OVERALL_MARKERS), close: str = "**"
) -> Column:
    """Text between a marker (plus one blank) and the next ``close``, trimmed.

    Markers are tried in order; one with nothing before its close is passed over.
    """
    tries = []
    for marker in markers:
        opening = f"{marker} "
        start = F.locate(opening, col)
        after = F.substring(col, start + F.lit(len(opening)), F.char_length(col))
        end = F.locate(close, after)
        tries.append(
            F.when((start > 0) & (end > 1), F.trim(F.substring(after, F.lit(1), end - F.lit(1))))
        )
    return F.coalesce(*tries)
