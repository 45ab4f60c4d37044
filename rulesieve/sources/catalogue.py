"""The rule catalogue: loading, checks and listings."""

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rulesieve import schema


class BadCatalogue(ValueError):
    """A catalogue with rules that cannot be used."""


class EmptyCatalogue(BadCatalogue):
    """A catalogue without any rule."""


# Columns with a fixed set of values.
ENUMERATIONS = {
    "category": schema.CATEGORIES,
    "severity": schema.SEVERITIES,
    "behavior": schema.BEHAVIORS,
    "evidence_location": schema.KINDS,
}


def _unknown(column: str) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*ENUMERATIONS[column])


def load_rules(spark: SparkSession, path: str, multiline: bool = False, fmt: str | None = None) -> DataFrame:
    """Rules from JSON lines, JSON arrays (``multiline``) or YAML, fixed schema.

    ``fmt`` is ``json`` or ``yaml``; it may be left out where the path ends like
    such a file, and must be named for a folder. Missing ``behavior`` becomes
    ``unknown``, missing ``is_regex`` false; the guidance key is optional. An
    empty catalogue, faulty syntax, a rule without id and a category, severity,
    behavior or location that is not in its enumeration are errors.
    """
    ending = path.lower().rpartition(".")[2]
    fmt = fmt or {"yaml": "yaml", "yml": "yaml", "json": "json", "jsonl": "json", "ndjson": "json"}.get(ending)
    if fmt == "yaml":
        rules = _read_yaml(spark, path)
    elif fmt == "json":
        rules = spark.read.schema(_INPUT).option("multiLine", multiline).option("mode", "FAILFAST").json(path)
    else:
        raise BadCatalogue(f"name the format of {path}: json or yaml")
    rules = with_defaults(rules)
    # One pass looks at everything.
    found = rules.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("id").isNull()).alias("id"),
        *[F.count_if(_unknown(column)).alias(column) for column in ENUMERATIONS],
    ).first()
    if not found.n:
        raise EmptyCatalogue(f"no rules in {path}")
    bad = [f"{found[c]} with a missing or unknown {c}" for c in ("id", *ENUMERATIONS) if found[c]]
    if bad:
        raise BadCatalogue(f"rules in {path}: {', '.join(bad)}")
    return rules


def rules_frame(spark: SparkSession, rules: Iterable[Mapping]) -> DataFrame:
    """Rules from plain dictionaries, as a local relation with known size."""
    rows = [
        {
            **{name: rule.get(name) for name in schema.RULE.names},
            "behavior": rule.get("behavior") or schema.DEFAULT_BEHAVIOR,
            "is_regex": bool(rule.get("is_regex")),
            "guidance_key": rule.get("guidance_key") or rule.get("bypass_hint"),
        }
        for rule in rules
    ]
    if not rows:
        raise EmptyCatalogue("no rules given")
    return local_table(spark, rows, schema.RULE)


def local_table(spark: SparkSession, rows: list[dict], struct) -> DataFrame:
    """A small driver-side table; planned as a local relation, not as an RDD."""
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, struct)


def with_defaults(rules: DataFrame) -> DataFrame:
    """Fill the optional fields."""
    key = (
        F.coalesce("guidance_key", "bypass_hint") if "bypass_hint" in rules.columns else F.col("guidance_key")
    )
    return rules.select(
        "id",
        "name",
        "category",
        "severity",
        F.coalesce("behavior", F.lit(schema.DEFAULT_BEHAVIOR)).alias("behavior"),
        "evidence_location",
        "patterns",
        F.coalesce("is_regex", F.lit(False)).alias("is_regex"),
        "description",
        key.alias("guidance_key"),
    )


# Stored catalogues may use either name for the optional guidance key.
_INPUT = schema._struct(*[(f.name, f.dataType) for f in schema.RULE], ("bypass_hint", schema._S))


def _read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """One task per YAML file; rule files are small, so each is parsed whole."""

    def parse(batches):
        import yaml

        for batch in batches:
            for text in batch.column("value").to_pylist():
                listed = yaml.safe_load(text) or []
                if not isinstance(listed, list) or not all(isinstance(rule, dict) for rule in listed):
                    raise ValueError("a rule file must hold a list of rules")
                rows = [{name: rule.get(name) for name in names} for rule in listed]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    names, arrow = _INPUT.names, to_arrow_schema(_INPUT)
    return spark.read.text(path, wholetext=True).mapInArrow(parse, _INPUT)


def pattern_rules(rules: DataFrame) -> DataFrame:
    """Long form, one row per listed pattern: the fan-out side of every match."""
    return rules.select(
        F.col("evidence_location").alias("kind"),
        F.col("id").alias("rule_id"),
        "is_regex",
        F.posexplode("patterns").alias("pattern_ord", "pattern"),
    ).select("kind", "is_regex", "pattern", "rule_id", "pattern_ord")


def pattern_table(rules: DataFrame) -> DataFrame:
    """Distinct patterns per kind with the number of rules that share each.

    The rules behind a pattern stay rows (:func:`pattern_rules`), so a pattern
    that very many rules list is never gathered into one array.
    """
    return pattern_rules(rules).groupBy("kind", "is_regex", "pattern").agg(
        F.count_distinct("rule_id").alias("n_rules"),
        F.min("rule_id").alias("first_rule_id"),
    )


def rule_violations(rules: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """Catalogue checks as rows ``(check, subject, n)``; empty when all is well.

    Null and unknown values of enumerations are violations too. With
    ``conditions`` it also reports rules no condition speaks about and
    conditions whose rule does not exist.
    """

    def rows(df: DataFrame, check: str, subject: Column, n: Column) -> DataFrame:
        return df.select(
            F.lit(check).alias("check"), subject.alias("subject"), n.cast("long").alias("n")
        )

    spark = rules.sparkSession
    one = F.lit(1)
    categories = local_table(
        spark, [{"category": c} for c in schema.CATEGORIES], schema._struct(("category", schema._S))
    )
    used = rules.select("category").distinct()
    repeated = rules.where("id is not null").groupBy("id").count().where("count > 1")
    blank = rules.where(F.exists("patterns", lambda p: p == "") | (F.size("patterns") <= 0))
    checks = [
        rows(repeated, "duplicate_id", F.col("id"), F.col("count")),
        rows(categories.join(used, "category", "left_anti"), "empty_category", F.col("category"), F.lit(0)),
        rows(rules.where("behavior = 'unknown'"), "unclassified_behavior", F.col("id"), one),
        rows(blank, "empty_pattern", F.col("id"), one),
        rows(rules.where("id is null"), "missing_id", F.col("name" if "name" in rules.columns else "id"), one),
        *[
            rows(rules.where(_unknown(c)), f"unknown_{c}", F.col("id"), one)
            for c in ENUMERATIONS
            if c in rules.columns
        ],
    ]
    if conditions is not None:
        named = conditions.select(F.col("rule_id").alias("id")).distinct()
        checks += [
            rows(rules.join(named, "id", "left_anti"), "rule_without_condition", F.col("id"), one),
            rows(
                named.join(rules, "id", "left_anti"), "condition_without_rule", F.col("id"), one
            ),
        ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def list_rules(rules: DataFrame) -> DataFrame:
    """One JSON object per rule: id, name, category, severity, description."""
    listing = F.to_json(F.struct("id", "name", "category", "severity", "description"))
    return rules.select("id", listing.alias("listing"))


def rules_for(rules: DataFrame, category: str | None = None, rule_id: str | None = None) -> DataFrame:
    """Rules of one category, or the rule with one id, or both conditions."""
    if category is not None:
        rules = rules.where(F.col("category") == category)
    if rule_id is not None:
        rules = rules.where(F.col("id") == rule_id)
    return rules


def rules_for_ids(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rules whose id occurs in ``wanted(id)``; Spark picks the join by size."""
    return rules.join(wanted.select("id").distinct(), "id", "left_semi")
