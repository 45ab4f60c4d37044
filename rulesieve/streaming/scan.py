"""Matching evidence files as they arrive.

Matching looks at one row at a time, so the batch operators run unchanged on a
stream; what spans rows (caps, findings) is resolved when the stored matches
are read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rulesieve import schema
from rulesieve.operators.findings import cap_evidence, to_findings
from rulesieve.operators.matching import PatternSet, match_longest


def evidence_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Evidence rows from parquet files appearing under ``path``."""
    reader = spark.readStream.schema(schema.EVIDENCE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def start_match_stream(
    evidence: DataFrame, rules: DataFrame, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append the matches of a stream to ``out``; exactly once by checkpoint."""
    patterns = PatternSet.of(rules)
    if patterns.rows is None:
        raise ValueError("a stream needs a catalogue within the compile bounds")
    writer = (
        match_longest(evidence, patterns)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def findings_so_far(spark: SparkSession, out: str, rules: DataFrame) -> DataFrame:
    """Findings over all matches a stream has stored."""
    return to_findings(cap_evidence(spark.read.parquet(out)), rules)
