"""Ordered decision tables evaluated over attribute profiles.

``conditions(rule_id, row_no, fields, verdict[, detail])`` says when a check
fires: rows are tried by ``row_no`` and the first whose ``fields`` all equal the
profile's values decides. A field the profile does not know never matches, an
empty ``fields`` always does, and where nothing matches the verdict is unknown.

``profiles(profile_id, profile MAP<STRING, BOOLEAN>)`` are the attributes;
``pairs(artifact_id, profile_id)`` says which artifacts are evaluated against
which profiles. The checks of one artifact are at most the catalogue, so they
travel as one array: a pair is one row, every verdict and every count is
computed within it, and no later step shuffles again. A decision table of up to
``MAX_SHARED_ROWS`` rows and ``MAX_SHARED_CHARS`` characters is read once and
shared by all tasks; a larger one meets the findings by rule, and a catalogue
evaluated without artifacts is then dealt into blocks of about that size.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rulesieve import __version__, schema
from rulesieve.functions.ranks import category_rank, is_blocking, severity_rank, verdict_rank

# Decision rows, and characters of them, that every task may hold as one value.
MAX_SHARED_ROWS, MAX_SHARED_CHARS = 2_000, 4_000_000
_CHECK = ("rule_id", "rule_name", "category", "severity", "behavior", "evidence")


# --- profiles ----------------------------------------------------------------


def parse_profiles(df: DataFrame, col: str, fields: Sequence[str]) -> DataFrame:
    """JSON objects to one nullable boolean column per field.

    Unknown keys are ignored, missing and null fields are null. Text that is not
    one object of true / false / null values is flagged ``rejected`` as a whole.
    """
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_bad",
        "allowSingleQuotes": "false",
    }
    known = ", ".join(f"`{f}` BOOLEAN" for f in fields)
    typed = F.from_json(col, f"{known}, _bad STRING", options)
    values = F.from_json(col, "map<string,string>", {"allowSingleQuotes": "false"})
    text_ok = F.forall(F.map_values(values), lambda v: v.isNull() | v.isin("true", "false"))
    is_object = F.trim(F.col(col)).startswith("{") & F.trim(F.col(col)).endswith("}")
    good = F.coalesce(is_object & typed["_bad"].isNull() & typed.isNotNull() & text_ok, F.lit(False))
    return df.select(
        *df.columns,
        *[F.when(good, typed[f]).alias(f) for f in fields],
        (~good).alias("rejected"),
    )


def profile_json(fields: Sequence[str]) -> Column:
    """JSON object of the fields, nulls left out."""
    return F.to_json(F.struct(*fields))


def profile_map(profiles: DataFrame, fields: Sequence[str], profile_id: str = "profile_id") -> DataFrame:
    """Attribute columns as the map the evaluation reads."""
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*fields))
    return profiles.select(F.col(profile_id).alias("profile_id"), values.alias("profile"))


# --- evaluation --------------------------------------------------------------


def _decision_rows(conditions: DataFrame) -> DataFrame:
    """The decision table of each rule as one ordered array."""
    if "detail" not in conditions.columns:
        conditions = conditions.withColumn("detail", F.lit(None).cast("string"))
    row = F.struct("row_no", F.map_entries("fields").alias("fields"), "verdict", "detail")
    return conditions.where("rule_id is not null").groupBy("rule_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _blocks(table: DataFrame, rows: Column, chars: Column) -> int:
    """Into how many blocks a table goes so that one is within the bounds of what tasks share."""
    found = table.agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")
    ).first()
    bounds = ((found["rows"], MAX_SHARED_ROWS), (found["chars"], MAX_SHARED_CHARS))
    # A bound of zero lets nothing be shared.
    return max(1, *(-(-n // bound) if bound else n + 1 for n, bound in bounds))


def _checks(found: DataFrame, attributes: Sequence[str], decisions: DataFrame | None = None) -> DataFrame:
    """Findings (or catalogue rules) as one struct, with their decision rows if these are given."""
    ranks = {"category": category_rank().alias("category_rank"), "severity": severity_rank().alias("severity_rank")}
    carried = [*dict.fromkeys(["rule_id", *attributes]), *[ranks[a] for a in attributes if a in ranks]]
    if decisions is None:
        return found.withColumn("check", F.struct(*carried))
    return found.join(decisions, "rule_id", "left").withColumn("check", F.struct(*carried, "rows"))


def _carried(attributes: Sequence[str]) -> list[str]:
    return [*attributes, *[f"{a}_rank" for a in attributes if a in ("category", "severity")]]


def _decide(check: Column, rows: Column, profile: Column, attributes: Sequence[str]) -> Column:
    def holds(field: Column) -> Column:
        return F.coalesce(F.element_at(profile, field["key"]) == field["value"], F.lit(False))

    matching = F.filter(rows, lambda row: F.forall(row["fields"], holds))
    first = F.get(matching, F.lit(0))
    note = F.when(rows.isNull(), "no conditions for this rule").otherwise(
        "no condition row matches this profile"
    )
    return F.struct(
        *[check[c].alias(c) for c in _carried(attributes)],
        F.coalesce(first["verdict"], F.lit("unknown")).alias("verdict"),
        F.when(first.isNull(), note).otherwise(first["detail"]).alias("detail"),
    )


def evaluate_pairs(
    findings: DataFrame,
    pairs: DataFrame,
    profiles: DataFrame,
    conditions: DataFrame,
    attributes: Sequence[str] = _CHECK,
) -> DataFrame:
    """One row per pair: ``(artifact_id, profile_id, profile, entries)``.

    ``entries`` holds a verdict per finding of the artifact and is empty, not
    missing, where there are none. Only the ``attributes`` of the findings are
    carried along; counts and overall results need no more than the rule id. A
    pair whose profile is not among ``profiles`` knows no field, so what its
    rules ask is unknown. An artifact has at most as many checks as the
    catalogue has rules.
    """
    decisions = _decision_rows(conditions)
    row = F.struct(*conditions.columns)
    shared = _blocks(conditions.limit(MAX_SHARED_ROWS + 1), F.lit(1), F.length(F.to_json(row))) == 1
    checks = _checks(findings, attributes, None if shared else decisions)
    per_artifact = checks.groupBy("artifact_id").agg(F.collect_list("check").alias("checks"))
    nothing_known = F.create_map().cast("map<string,boolean>")
    spine = pairs.join(profiles, "profile_id", "left").withColumn("profile", F.coalesce("profile", nothing_known))
    joined = spine.join(per_artifact, "artifact_id", "left")
    if shared:
        entry = F.struct("rule_id", "rows")
        table = decisions.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()
        joined = joined.withColumn("decisions", table)
        rows = lambda check: F.col("decisions")[check["rule_id"]]
    else:
        rows = lambda check: check["rows"]
    entries = F.transform("checks", lambda c: _decide(c, rows(c), F.col("profile"), attributes))
    return joined.select(
        "artifact_id",
        "profile_id",
        "profile",
        F.coalesce(entries, F.array().cast(_entries_type(attributes))).alias("entries"),
    )


def _entries_type(attributes: Sequence[str]) -> str:
    kinds = [f"{c}: {'int' if c.endswith('_rank') else 'string'}" for c in _carried(attributes)]
    return f"array<struct<{', '.join([*kinds, 'verdict: string', 'detail: string'])}>>"


def verdict_rows(evaluated: DataFrame) -> DataFrame:
    """Evaluated pairs as one row per (artifact, profile, rule)."""
    keys = [c for c in ("artifact_id", "profile_id") if c in evaluated.columns]
    # The outer form: a plain inline would first test the size and so decide twice.
    rows = evaluated.select(*keys, F.inline_outer("entries")).where("verdict is not null")
    return rows.drop("category_rank", "severity_rank")


def evaluate(
    findings: DataFrame, pairs: DataFrame, profiles: DataFrame, conditions: DataFrame
) -> DataFrame:
    """Verdict of every finding under every profile it is paired with."""
    return verdict_rows(evaluate_pairs(findings, pairs, profiles, conditions))


def evaluate_blocking(
    findings: DataFrame,
    pairs: DataFrame,
    profiles: DataFrame,
    conditions: DataFrame,
    attributes: Sequence[str] = _CHECK,
) -> DataFrame:
    """:func:`evaluate_pairs` for the findings that restrict the user."""
    return evaluate_pairs(findings.where(is_blocking()), pairs, profiles, conditions, attributes)


def evaluate_catalogue(
    rules: DataFrame,
    profiles: DataFrame,
    conditions: DataFrame,
    excluded: Sequence[str] = schema.ARTIFACT_SIDE_CATEGORIES,
) -> DataFrame:
    """Which rules of the catalogue fire for a profile, without any artifact.

    Rules without conditions and rules of the ``excluded`` categories are left
    out. The result has a row for every profile and remaining rule. Within the
    bounds the rules reach each profile as one shared array, so nothing is joined
    or shuffled; more of them go block by block: a profile is there once for each
    block, and a block once for each part of the profiles, so that neither side
    gathers in one task. Equal profile ids are evaluated each for itself.
    """
    found = (
        rules.where(~F.col("category").isin(*excluded))
        .select(
            F.col("id").alias("rule_id"),
            F.col("name").alias("rule_name"),
            "category",
            "severity",
            "behavior",
            F.lit("").alias("evidence"),
        )
        .join(conditions.select("rule_id").distinct(), "rule_id", "left_semi")
    )
    checks = _checks(found, _CHECK, _decision_rows(conditions)).select("check")
    gathered = F.collect_list("check").alias("checks")
    blocks = _blocks(checks, F.size("check.rows"), F.length(F.to_json("check")))
    every = profiles.select("profile_id", "profile")
    if blocks == 1:
        every = every.withColumn("checks", checks.agg(gathered).scalar())
    else:
        parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        block = F.pmod(F.xxhash64("check.rule_id"), F.lit(blocks)).cast("int").alias("block")
        dealt = checks.groupBy(block).agg(gathered).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        part = F.pmod(F.xxhash64("profile_id"), F.lit(parts)).cast("int")
        every = every.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        every = every.join(dealt, ["block", "part"])
    entries = F.transform("checks", lambda c: _decide(c, c["rows"], F.col("profile"), _CHECK))
    return verdict_rows(every.select("profile_id", entries.alias("entries")))


# --- what is reported of it --------------------------------------------------


def _count(verdict: str) -> Column:
    return F.size(F.filter("entries", lambda e: e["verdict"] == verdict)).cast("long")


def verdict_counts(evaluated: DataFrame) -> DataFrame:
    """Verdicts per (artifact, profile), zeros included."""
    return evaluated.select(
        "artifact_id",
        "profile_id",
        *[_count(v).alias(f"n_{v}") for v in schema.VERDICTS],
        F.size("entries").cast("long").alias("n_total"),
    )


def overall(evaluated: DataFrame) -> DataFrame:
    """no_blocking, fail, inconclusive or pass per (artifact, profile)."""
    counts = verdict_counts(evaluated)
    result = (
        F.when(F.col("n_total") == 0, "no_blocking")
        .when(F.col("n_triggered") > 0, "fail")
        .when(F.col("n_unknown") > 0, "inconclusive")
        .otherwise("pass")
    )
    return counts.withColumn("overall", result)


def verdict_documents(evaluated: DataFrame) -> DataFrame:
    """One JSON document per (artifact, profile): header, summary, entries.

    Entries follow report order: category, severity, rule.
    """
    ranked = F.array_sort(
        F.transform(
            "entries",
            lambda e: F.struct(
                e["category_rank"].alias("c"),
                (-e["severity_rank"]).alias("s"),
                e["rule_id"].alias("r"),
                F.struct(
                    *[e[c].alias(c) for c in ("rule_id", "rule_name", "category", "severity", "evidence")],
                    e["verdict"].alias("verdict"),
                    F.coalesce(e["detail"], F.lit("")).alias("detail"),
                ).alias("entry"),
            ),
        )
    )
    summary = F.struct(
        *[_count(v).alias(v) for v in schema.VERDICTS], F.size("entries").cast("long").alias("total")
    )
    document = F.struct(
        F.col("artifact_id").alias("artifact"),
        F.map_filter("profile", lambda _, v: v.isNotNull()).alias("profile"),
        F.lit(__version__).alias("engine_version"),
        summary.alias("summary"),
        F.transform(ranked, lambda x: x["entry"]).alias("entries"),
    )
    return evaluated.select("artifact_id", "profile_id", F.to_json(document).alias("document"))


def order_verdicts(verdicts: DataFrame) -> DataFrame:
    """Listing order: triggered, not triggered, unknown; then report order."""
    keys = [c for c in ("artifact_id", "profile_id") if c in verdicts.columns]
    return verdicts.orderBy(*keys, verdict_rank(), category_rank(), severity_rank().desc(), "rule_id")
