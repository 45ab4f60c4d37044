"""Counts per time window over a stream, and what came too late for them.

A window is given out once, when the watermark has passed its end; Spark keeps
the counts of open windows only and leaves out rows of closed ones. The counts
are combined before their shuffle, so one hot group is a row per task.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rulesieve.session import scratch_path


def window_counts(rows: DataFrame, at: str, by: Sequence[str], size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """``by``, ``start``, ``end`` and ``n`` per window of ``size``, beginning every ``slide`` (by default ``size``).

    The same over a stream and over a table; of a stream, rows may come ``delay``
    after later ones. Windows begin at whole multiples of ``slide`` since 1970,
    UTC. Rows with a null time are in no window, null groups are a group.
    """
    window = F.window(at, size, slide) if slide else F.window(at, size)
    counted = rows.withWatermark(at, delay).groupBy(window.alias("_window"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), "n")


def start_window_stream(counts: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append closed windows to ``out``; exactly once by checkpoint. Open ones stay in the state for the next run."""
    writer = (
        counts.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_counts(closed: DataFrame, whole: DataFrame, by: Sequence[str], closed_until: object) -> DataFrame:
    """``by``, ``start``, ``end``, ``n``, ``n_late``: closed windows of a stream beside the counts of all rows.

    ``whole`` are the counts of the stream's whole input, of which windows up to
    ``closed_until`` (a timestamp or column, the watermark reached) are looked at. A
    window all of whose rows were late was never given out and has ``n`` zero.
    """
    keys = [*by, "start", "end"]
    both = whole.where(F.col("end") <= closed_until).select(*keys, F.col("n").alias("_all"), F.lit(0).cast("long").alias("n"))
    seen = closed.select(*keys, F.lit(0).cast("long").alias("_all"), "n")
    # Added up rather than joined, so that null groups meet and a hot one is combined in the task.
    summed = both.unionByName(seen).groupBy(*keys).agg(F.sum("_all").alias("_all"), F.sum("n").alias("n"))
    return summed.select(*keys, "n", (F.col("_all") - F.col("n")).alias("n_late"))


def windows_so_far(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """All that is there of a stream's input counted, and the closed windows read back from the shared folder."""
    out = scratch_path(spark, "windows")
    start_window_stream(counts, out, scratch_path(spark, "windows-state")).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)
