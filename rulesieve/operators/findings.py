"""From matches to one finding per artifact and rule."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulesieve import schema
from rulesieve.operators.matching import LONGEST_KINDS, PatternSet, match

# Evidence text per kind, as (opening, separator, closing).
LABELS = {
    "dex_string": ("DEX string match: `", "`, `", "`"),
    "manifest": ("Manifest match: `", "`, `", "`"),
    "native_lib_name": ("Native lib: ", ", ", ""),
    "native_symbol": ("Native symbol: ", ", ", ""),
    "zip_entry": ("ZIP entry: ", ", ", ""),
}


def first_pattern_hits(matches: DataFrame) -> DataFrame:
    """Per artifact and rule, only the hits of the first listed pattern that hits.

    Matches are found once and shuffled once. ``rank`` is 1 exactly for the rows
    with the smallest pattern, so Spark drops the others before the shuffle too
    (``WindowGroupLimit``).
    """
    by_pattern = Window.partitionBy("artifact_id", "rule_id").orderBy("pattern_ord")
    return matches.withColumn("_rank", F.rank().over(by_pattern)).where("_rank = 1").drop("_rank")


def cap_evidence(matches: DataFrame, n: int | None = schema.EVIDENCE_CAP) -> DataFrame:
    """First ``n`` matches per artifact and rule in scan order, repeats kept; ``None`` keeps all."""
    return _first_n(matches, n, *_SCAN_ORDER)


def cap_first_pattern(matches: DataFrame, n: int | None = schema.EVIDENCE_CAP) -> DataFrame:
    """:func:`first_pattern_hits` and :func:`cap_evidence` in one bounded window."""
    return cap_by_kind(matches, n, longest_kinds=())


def cap_by_kind(
    matches: DataFrame, n: int | None = schema.EVIDENCE_CAP, longest_kinds: tuple[str, ...] = LONGEST_KINDS
) -> DataFrame:
    """First ``n`` matches per artifact and rule (``None``: all); outside
    ``longest_kinds`` only those of the first listed pattern that hits.

    Ordered by pattern first, the top ``n`` hold the wanted rows; what remains
    of later patterns is cut from groups of at most ``n`` rows.
    """
    turn = F.when(F.col("kind").isin(*longest_kinds), F.lit(0)).otherwise(F.col("pattern_ord"))
    ranked = _first_n(matches, n, turn, *_SCAN_ORDER)
    first = F.min(turn).over(Window.partitionBy("artifact_id", "rule_id"))
    return ranked.withColumn("_first", first).where(turn == F.col("_first")).drop("_first")


# Total but for rows that are equal, so "the first n" is one result.
_SCAN_ORDER = ("container_ord", "ordinal", "match_pos", "pattern_ord", "container", "value", "kind", "pattern")


def _first_n(matches: DataFrame, n: int | None, *order: str | Column) -> DataFrame:
    scan_order = Window.partitionBy("artifact_id", "rule_id").orderBy(*order)
    ranked = matches.withColumn("evidence_rank", F.row_number().over(scan_order))
    return ranked if n is None else ranked.where(F.col("evidence_rank") <= n)


def shown_value() -> Column:
    """What a match shows as evidence: the pattern, the library path or the value."""
    return (
        F.when(F.col("kind") == "manifest", F.col("pattern"))
        .when(F.col("kind") == "native_lib_name", F.concat(F.lit("lib/"), "container", F.lit("/"), "value"))
        .otherwise(F.col("value"))
    )


def evidence_label(kind: Column, values: Column) -> Column:
    """Join shown values to the evidence text of their kind."""
    out = None
    for name, (opening, separator, closing) in LABELS.items():
        text = F.concat(F.lit(opening), F.array_join(values, separator), F.lit(closing))
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out.otherwise(F.array_join(values, ", "))


def to_findings(capped: DataFrame, rules: DataFrame) -> DataFrame:
    """One finding per artifact and rule, from at most a few capped matches each.

    A manifest finding shows the pattern once, however many segments hold it.
    """
    shown = F.struct("evidence_rank", shown_value().alias("shown"))
    grouped = (
        capped.groupBy("artifact_id", "rule_id", "kind")
        .agg(F.array_sort(F.collect_list(shown)).alias("shown"))
        .withColumn("shown", F.col("shown.shown"))
        .withColumn(
            "shown",
            F.when(F.col("kind") == "manifest", F.slice("shown", 1, 1)).otherwise(F.col("shown")),
        )
    )
    attributes = rules.select(
        F.col("id").alias("rule_id"),
        F.col("name").alias("rule_name"),
        "category",
        "severity",
        "behavior",
        "guidance_key",
    )
    return (
        grouped.select(
            "artifact_id", "rule_id", evidence_label(F.col("kind"), F.col("shown")).alias("evidence")
        )
        .join(attributes, "rule_id")
        .select(*schema.FINDING.names)
    )


def scan(
    evidence: DataFrame,
    rules: DataFrame | PatternSet,
    cap: int | None = schema.EVIDENCE_CAP,
    containers: DataFrame | None = None,
    error: str | None = None,
    artifacts: DataFrame | None = None,
) -> DataFrame:
    """All rules against all evidence.

    ``containers``, as from ``budgets.apply_budget``, says which containers of
    code strings are searched: those that are ``kept`` and, where ``error`` names
    their column of read errors, could be read. Evidence of other kinds is
    searched whole. ``cap`` bounds the matches shown per finding; ``match`` gives
    all of them. With ``artifacts`` (a column ``artifact_id``) only theirs are
    found; the matches meet them, so that evidence is not shuffled however many
    they are.

    Code strings are matched leftmost-longest and keep the first ``cap``
    matches; names and manifests are searched for substrings and keep the first
    listed pattern that hits. One pass over the evidence, one shuffle of matches.
    """
    other_kinds = [k for k in schema.KINDS if k not in LONGEST_KINDS]
    patterns = PatternSet.of(rules)
    if containers is not None:
        evidence = within_containers(evidence, containers, error)
    matches = match(evidence, patterns, longest=LONGEST_KINDS, contains=other_kinds, regex=schema.KINDS)
    if artifacts is not None:
        matches = matches.join(artifacts.select("artifact_id"), "artifact_id", "left_semi")
    return to_findings(cap_by_kind(matches, cap), patterns.rules)


def within_containers(evidence: DataFrame, containers: DataFrame, error: str | None = None) -> DataFrame:
    """Evidence without the code strings of containers that are not to be searched."""
    of_code = F.col("kind").isin(*LONGEST_KINDS)
    readable = F.lit(True) if error is None else F.col(error).isNull()
    searched = containers.where(F.col("kept") & readable).select(
        F.col("artifact_id").cast("string").alias("_a"), F.col("container_ord").cast("long").alias("_c")
    )
    same = F.col("artifact_id").eqNullSafe(F.col("_a")) & F.col("container_ord").eqNullSafe(F.col("_c"))
    code = evidence.where(of_code).join(searched, same, "left_semi")
    return code.unionByName(evidence.where(~of_code))


def scan_report(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """Outcomes with the findings of each artifact: their number and rules, none included.

    The rules of an artifact are at most the catalogue.
    """
    found = findings.groupBy(F.col("artifact_id").alias("_a")).agg(
        F.count("*").alias("n_findings"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids")
    )
    joined = outcomes.join(found, outcomes["artifact_id"].cast("string").eqNullSafe(F.col("_a")), "left")
    none = F.array().cast("array<string>")
    return joined.drop("_a").fillna(0, ["n_findings"]).withColumn("rule_ids", F.coalesce("rule_ids", none))


def clean_artifacts(artifacts: DataFrame, findings: DataFrame) -> DataFrame:
    """Artifacts without any finding."""
    return artifacts.join(findings.select("artifact_id"), "artifact_id", "left_anti")
