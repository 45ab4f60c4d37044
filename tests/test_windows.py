"""Windowed counts: a stream gives out what a table gives, and late rows are accounted for."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rulesieve.streaming.windows import late_counts, start_window_stream, window_counts

ROWS = "rule string, at timestamp"
START = datetime(2024, 1, 1)


def minutes(*values):
    return [None if v is None else START + timedelta(minutes=v) for v in values]


def rows(df):
    return sorted(map(repr, df.select("rule", F.unix_millis("start").alias("s"), F.unix_millis("end").alias("e"), *[c for c in df.columns if c.startswith("n")]).collect()))


def fed(spark, tmp_path, parts, **window):
    """The closed windows after every part came as a micro-batch of its own, restarted in between."""
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
        counts = window_counts(spark.readStream.schema(ROWS).parquet(source), "at", ["rule"], delay="10 minutes", **window)
        start_window_stream(counts, out, state).awaitTermination()
    whole = window_counts(spark.read.schema(ROWS).parquet(source), "at", ["rule"], **window)
    return spark.read.schema(counts.schema).parquet(out), whole


@pytest.mark.parametrize("slide", [None, "5 minutes"])
def test_out_of_order_rows_in_time_count_as_in_a_table(spark, tmp_path, slide):
    parts = [
        [("r", t) for t in minutes(3, 1, 14, None)] + [(None, t) for t in minutes(2)],
        [("r", t) for t in minutes(9, 22, 22)] + [("s", t) for t in minutes(6, 25)],
        [("r", t) for t in minutes(21, 90)],
    ]
    closed, whole = fed(spark, tmp_path, parts, size="10 minutes", slide=slide)
    until = F.lit(START + timedelta(minutes=80))
    assert rows(closed) == rows(whole.where(F.col("end") <= until)) != []
    assert late_counts(closed, whole, ["rule"], until).where("n_late <> 0").count() == 0


def test_late_rows_are_left_out_and_accounted_for(spark, tmp_path):
    parts = [[("r", t) for t in minutes(1, 2, 60)], [("r", t) for t in minutes(3, 70)] + [("s", t) for t in minutes(4, 5)]]
    closed, whole = fed(spark, tmp_path, parts, size="10 minutes")
    late = late_counts(closed, whole, ["rule"], F.lit(START + timedelta(minutes=60)))
    assert sorted((r.rule, r.n, r.n_late) for r in late.collect()) == [("r", 2, 1), ("s", 0, 2)]


def test_no_rows(spark):
    none = window_counts(spark.createDataFrame([], ROWS), "at", ["rule"], "1 hour")
    assert late_counts(none, none, ["rule"], F.current_timestamp()).count() == 0
