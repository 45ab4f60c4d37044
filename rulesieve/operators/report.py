"""Tables behind a report: summaries, rollups, filters, prevalence."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from rulesieve import schema
from rulesieve.functions.ranks import category_rank, is_blocking, severity_rank, value_at


def artifact_summary(
    artifacts: DataFrame, entries: DataFrame, findings: DataFrame, rules: DataFrame
) -> DataFrame:
    """Size, findings and rules loaded per artifact; artifacts without any stay."""
    sizes = entries.groupBy("artifact_id").agg(F.sum("uncompressed_size").alias("size_bytes"))
    found = findings.groupBy("artifact_id").agg(F.count("*").alias("n_findings"))
    loaded = rules.agg(F.count("*")).scalar()
    return (
        artifacts.select("artifact_id")
        .join(sizes, "artifact_id", "left")
        .join(found, "artifact_id", "left")
        .select(
            "artifact_id",
            F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"),
            F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
            loaded.alias("rules_loaded"),
        )
    )


def with_guidance(findings: DataFrame, rules: DataFrame, guidance: DataFrame) -> DataFrame:
    """Add the rule's description and the user's ``guidance(guidance_key, guidance)``.

    A key that is missing, or not in the table, gives none.
    """
    described = rules.select(F.col("id").alias("rule_id"), "description")
    return findings.join(described, "rule_id", "left").join(
        guidance.select("guidance_key", "guidance"), "guidance_key", "left"
    )


def category_rollup(findings: DataFrame) -> DataFrame:
    """Findings and highest severity per artifact and non-empty category.

    The severity is aggregated as its rank, which keeps the aggregate hashed
    and combined before the shuffle. ``category_rank`` gives the report order.
    """
    return (
        findings.groupBy("artifact_id", "category")
        .agg(F.count("*").alias("n_findings"), F.max(severity_rank()).alias("_rank"))
        .select(
            "artifact_id",
            "category",
            "n_findings",
            value_at("_rank", schema.SEVERITIES).alias("highest_severity"),
            category_rank().alias("category_rank"),
        )
    )


def findings_cube(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Findings, blocking ones and highest severity for every combination of ``by``, with all totals.

    ``level`` has a bit for each column of ``by``, the first one highest, that is
    summed over; its value is null then, which tells a total from a group of
    nulls. Every row is given to its ``2 ** len(by)`` combinations within the task
    and combined there, so one shuffle carries a row per task and combination and
    the grand total is no hot group. Without findings there is no row at all.
    """
    return (
        findings.cube(*by)
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.count(F.lit(1)).alias("n_findings"),
            F.count_if(is_blocking()).alias("n_blocking"),
            F.max(severity_rank()).alias("_rank"),
        )
        .select(*by, "level", "n_findings", "n_blocking", value_at("_rank", schema.SEVERITIES).alias("highest_severity"))
    )


def order_findings(findings: DataFrame) -> DataFrame:
    """Number the findings of an artifact in report order.

    An artifact has at most one finding per rule, so the window is bounded by
    the catalogue.
    """
    report_order = Window.partitionBy("artifact_id").orderBy(
        category_rank(), severity_rank().desc(), "rule_id"
    )
    return findings.withColumn("position", F.row_number().over(report_order))


def blocking_only(findings: DataFrame) -> DataFrame:
    """Findings whose behavior restricts the user."""
    return findings.where(is_blocking())


def min_severity(findings: DataFrame, level: str = "medium") -> DataFrame:
    """Findings of at least the given severity."""
    return findings.where(severity_rank() >= schema.SEVERITIES.index(level))


def blocking_counts(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Total, kept and hidden findings under the blocking filter, zeros included."""
    counts = findings.groupBy("artifact_id").agg(
        F.count("*").alias("total"), F.count_if(is_blocking()).alias("kept")
    )
    total, kept = F.coalesce("total", F.lit(0)), F.coalesce("kept", F.lit(0))
    return (
        artifacts.select("artifact_id")
        .join(counts, "artifact_id", "left")
        .select("artifact_id", total.alias("total"), kept.alias("kept"), (total - kept).alias("hidden"))
    )


def prevalence(findings: DataFrame, artifacts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Distinct artifacts per rule and their share of the corpus.

    With ``rules`` also those that never fired. The corpus size is a scalar
    subquery, so nothing is cross-joined.
    """
    corpus = artifacts.agg(F.count_distinct("artifact_id")).scalar()
    counts = findings.groupBy("rule_id").agg(F.count_distinct("artifact_id").alias("n_artifacts"))
    if rules is not None:
        every = rules.select(F.col("id").alias("rule_id")).distinct()
        counts = every.join(counts, "rule_id", "left")
    n = F.coalesce("n_artifacts", F.lit(0))
    share = F.when(corpus > 0, n.cast("double") / corpus)
    return counts.select("rule_id", n.alias("n_artifacts"), share.alias("share"))
