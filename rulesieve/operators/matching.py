"""Matching evidence against the patterns of a rule catalogue.

A catalogue that fits the bounds below is compiled on the driver: evidence is
screened in Arrow batches and the few rows with hits are matched exactly by one
folded expression per kind, in one pass without a join against patterns. A
larger catalogue stays distributed: patterns and values meet in an equi-join on
a fixed-length piece of the pattern, and the candidates are verified. Both ways
give the same rows.
"""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from rulesieve import schema
from rulesieve.functions.expressions import needed_literals
from rulesieve.functions.grams import bitmap_bits, pattern_pieces, piece_bitmap, text_pieces
from rulesieve.functions.literals import TooDeep, literal_regex
from rulesieve.functions.screen import evidence_screen, regex_found
from rulesieve.session import scratch_path
from rulesieve.sources.catalogue import local_table, pattern_rules

# Bounds of a compiled catalogue. They bound what reaches the driver (at most
# MAX_PATTERNS strings of MAX_PATTERN_CHARS) and what is shipped and broadcast
# (at most MAX_TOTAL_CHARS).
MAX_PATTERNS = 100_000
MAX_PATTERN_CHARS = 2_000
MAX_TOTAL_CHARS = 4_000_000
REGEX_BLOCK = 256
# Share of the evidence in which pieces of patterns are counted.
ANCHOR_SAMPLE = 0.02
# Literals that one folded expression of the JVM matches faster than rows match their own.
FOLDED_LITERALS = 200

LONGEST_KINDS = ("dex_string",)
_PATTERN = schema._struct(
    ("kind", schema._S),
    ("is_regex", schema._B),
    ("pattern", schema._S),
    ("rule_id", schema._S),
    ("pattern_ord", schema._I),
)


@dataclass
class PatternSet:
    """A catalogue with its patterns: as a table, and on the driver if they are few.

    Made once, it serves any number of scans.
    """

    rules: DataFrame
    table: DataFrame
    rows: list[dict] | None

    @classmethod
    def of(cls, rules: "DataFrame | PatternSet") -> "PatternSet":
        if isinstance(rules, PatternSet):
            return rules
        table = pattern_rules(rules)
        if rules.isLocal():  # already on the driver, so no job is needed to look
            rows = _exploded(rules)
            sizes = [(len(r["pattern"] or ""), len(r["rule_id"] or ""), len(r["kind"] or "")) for r in rows]
            seen = len(sizes), max((s[0] for s in sizes), default=0), sum(map(sum, sizes))
        else:  # sizes first, so that a catalogue over the bounds never reaches the driver
            length = F.coalesce(F.char_length("pattern"), F.lit(0))
            others = [F.coalesce(F.char_length(c), F.lit(0)) for c in ("rule_id", "kind")]
            found = table.agg(F.count(F.lit(1)), F.max(length), F.sum(length + others[0] + others[1])).first()
            seen = found[0], found[1] or 0, found[2] or 0
            rows = None
        fits = seen[0] <= MAX_PATTERNS and seen[1] <= MAX_PATTERN_CHARS and seen[2] <= MAX_TOTAL_CHARS
        if fits and rows is None:
            rows = [r.asDict() for r in table.collect()]
        return cls(rules, table, rows if fits else None)

    @classmethod
    def distributed(cls, rules: DataFrame) -> "PatternSet":
        """The same without the look at its size; nothing reaches the driver."""
        return cls(rules, pattern_rules(rules), None)

    @cached_property
    def fan_out_side(self) -> DataFrame:
        """Patterns with the rules that list them, for the join after matching."""
        if self.rows is None:
            return self.table
        small = local_table(self.table.sparkSession, self.rows, _PATTERN)
        return F.broadcast(small)  # patterns, rule ids and kinds are within MAX_TOTAL_CHARS

    def distinct(self, is_regex: bool, kinds: Sequence[str]) -> dict[str, list[str]]:
        """Distinct non-empty patterns per kind."""
        found: dict[str, set[str]] = {}
        for row in self.rows or []:
            if row["is_regex"] == is_regex and row["pattern"] and row["kind"] in kinds:
                found.setdefault(row["kind"], set()).add(row["pattern"])
        return {kind: sorted(values) for kind, values in sorted(found.items())}

    def fan_out(self, hits: DataFrame) -> DataFrame:
        """Join matched patterns to every rule that lists them."""
        return hits.join(self.fan_out_side, ["kind", "is_regex", "pattern"]).select(
            *schema.EVIDENCE.names, "match_pos", "pattern", "rule_id", "pattern_ord"
        )


def _exploded(rules: DataFrame) -> list[dict]:
    found = rules.select("id", "evidence_location", "is_regex", "patterns").collect()
    return [
        dict(kind=r[1], is_regex=r[2], pattern=pattern, rule_id=r[0], pattern_ord=i)
        for r in found
        for i, pattern in enumerate(r[3] or [])
    ]


def match(
    evidence: DataFrame,
    rules: DataFrame | PatternSet,
    longest: Sequence[str] = (),
    contains: Sequence[str] = (),
    regex: Sequence[str] = (),
) -> DataFrame:
    """Match each kind of evidence in its own way, in one pass over the evidence.

    ``longest``, ``contains`` and ``regex`` name the kinds to be matched as in
    :func:`match_longest`, :func:`match_contains` and :func:`match_regex`.
    """
    patterns = PatternSet.of(rules)
    hits = _compiled_match(evidence, patterns, longest, contains, regex)
    if hits is None:
        hits = _match_distributed(evidence, patterns, longest, contains, regex)
    return patterns.fan_out(hits)


def match_longest(
    evidence: DataFrame, rules: DataFrame | PatternSet, kinds: Sequence[str] = schema.KINDS
) -> DataFrame:
    """Leftmost-longest, non-overlapping literal matches, one row per match and rule.

    A literal inside a longer literal that matches at the same place is not
    reported. ``match_pos`` counts the matches within the value.
    """
    return match(evidence, rules, longest=kinds)


def match_contains(
    evidence: DataFrame, rules: DataFrame | PatternSet, kinds: Sequence[str] = schema.KINDS
) -> DataFrame:
    """Every literal that occurs in the value, one row per literal and rule."""
    return match(evidence, rules, contains=kinds)


def match_regex(
    evidence: DataFrame, rules: DataFrame | PatternSet, kinds: Sequence[str] = schema.KINDS
) -> DataFrame:
    """Rules flagged ``is_regex``: each expression found in the value is a match."""
    return match(evidence, rules, regex=kinds)


def _compiled_match(
    evidence: DataFrame,
    patterns: PatternSet,
    longest: Sequence[str],
    contains: Sequence[str],
    regex: Sequence[str],
) -> DataFrame | None:
    """Hits of a catalogue within the bounds, or None where it is too large.

    Screened first; only rows in which something occurs are matched exactly.
    """
    if patterns.rows is None:
        return None
    as_longest = patterns.distinct(False, longest)
    as_contained = patterns.distinct(False, contains)
    expressions = [(k, e) for k, found in patterns.distinct(True, regex).items() for e in found]
    kinds = sorted({*as_longest, *as_contained, *(k for k, _ in expressions)})
    found = F.col("found")
    some_literal = F.exists(found, lambda f: f["pattern"].isNull())
    literals_found = F.filter(found, lambda f: f["pattern"].isNotNull() & ~f["is_regex"])
    exact, named_longest = F.array().cast(_HITS), []
    for kind, literals in as_longest.items():
        of_kind = F.col("kind") == kind
        expression = _folded(literals)
        if expression is not None:
            exact = F.when(of_kind & some_literal, _longest_hits(F.lit(expression))).otherwise(exact)
        else:
            named_longest.append(kind)
            own = _longest_hits(_alternation(F.transform(literals_found, lambda f: f["pattern"])))
            exact = F.when(of_kind & (F.size(literals_found) > 0), own).otherwise(exact)
    final = F.lit(True) if not named_longest else ~F.col("kind").isin(*named_longest)
    named = F.transform(
        F.filter(found, lambda f: f["pattern"].isNotNull() & (f["is_regex"] | final)),
        lambda f: _hit(F.lit(0), f["is_regex"], f["pattern"]),
    )
    screen = evidence_screen(
        {**as_longest, **as_contained}, (*as_contained, *named_longest), expressions
    )
    # The kind filter reaches the scan, and prunes folders laid out by kind.
    wanted = evidence.where(F.col("kind").isin(*kinds)) if kinds else evidence.where("false")
    # Rows without hits go with inline; a filter on the screen would run it twice.
    screened = wanted.select(
        *schema.EVIDENCE.names, screen(F.col("kind"), F.col("value")).alias("found")
    )
    return screened.select(*schema.EVIDENCE.names, F.inline(F.concat(exact, named)))


_HITS = "array<struct<match_pos: int, is_regex: boolean, pattern: string>>"


def _hit(match_pos: Column, is_regex: Column, pattern: Column) -> Column:
    return F.struct(
        match_pos.cast("int").alias("match_pos"), is_regex.alias("is_regex"), pattern.alias("pattern")
    )


def _folded(literals: list[str]) -> str | None:
    """One expression for the literals, unless there are too many for it."""
    if len(literals) > FOLDED_LITERALS:
        return None
    try:
        return literal_regex(literals)
    except TooDeep:
        return None


def _longest_hits(expression: Column) -> Column:
    found = F.regexp_extract_all("value", expression, F.lit(0))
    return F.transform(found, lambda p, i: _hit(i, F.lit(False), p))


def _alternation(literals: Column) -> Column:
    """The literals of one row as that row's own expression, longest first."""

    def entry(literal: Column) -> Column:
        quoted = F.regexp_replace(literal, F.lit(r"(\p{Punct})"), F.lit(r"\\$1"))
        return F.struct((-F.char_length(literal)).alias("rank"), quoted.alias("quoted"))

    ordered = F.array_sort(F.transform(literals, entry))
    return F.array_join(F.transform(ordered, lambda e: e["quoted"]), "|")


# --- catalogues beyond the compile bounds -----------------------------------


def _match_distributed(
    evidence: DataFrame,
    patterns: PatternSet,
    longest: Sequence[str],
    contains: Sequence[str],
    regex: Sequence[str],
) -> DataFrame:
    parts = []
    if longest:
        parts.append(_longest_from_hits(_contained(evidence, patterns, longest)))
    if contains:
        parts.append(_contained(evidence, patterns, contains).withColumn("match_pos", F.lit(0)))
    parts = [part.withColumn("is_regex", F.lit(False)) for part in parts]
    if regex:
        parts.append(_regex_distributed(evidence, patterns, regex))
    columns = [*schema.EVIDENCE.names, "match_pos", "is_regex", "pattern"]
    if not parts:
        nothing = {"match_pos": F.lit(0), "is_regex": F.lit(False), "pattern": F.lit("")}
        return evidence.where("false").withColumns(nothing).select(*columns)
    hits = parts[0].select(*columns)
    for part in parts[1:]:
        hits = hits.unionByName(part.select(*columns))
    return hits


def _contained(evidence: DataFrame, patterns: PatternSet, kinds: Sequence[str]) -> DataFrame:
    """Evidence rows with every literal they contain, by equi-join on an anchor.

    Each pattern is represented by one of its pieces, so a row and a pattern meet
    at most once: the one rarest in a sample of the evidence, then the one fewest
    other patterns share. (The sample only decides how many candidates there
    are, never which matches are found.) A bitmap of the anchors, bounded in
    size, drops nearly all other pieces of the evidence before they leave the
    task; Spark broadcasts the anchors if they are small. The anchors are
    computed once and stored.
    """
    wanted = F.col("kind").isin(*kinds)
    evidence = evidence.where(wanted)
    table = patterns.table.where(wanted & ~F.col("is_regex") & (F.col("pattern") != ""))
    pieces = table.select("kind", "pattern").distinct().select(
        "kind", "pattern", F.inline(pattern_pieces(F.col("pattern")))
    )
    pieces = _stored(pieces, "pieces")
    shared = pieces.groupBy("kind", "size", "piece", "slot").agg(F.count("*").alias("n"))
    sizes = {r["size"]: r["n"] for r in shared.groupBy("size").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return evidence.where("false").withColumn("pattern", F.lit(None).cast("string"))
    bits = bitmap_bits(sum(sizes.values()))
    looked_at = text_pieces(F.col("value"), sorted(sizes), bits, piece_bitmap(shared, bits))
    in_text = (
        evidence.sample(ANCHOR_SAMPLE, 1)
        .select("kind", F.inline(looked_at))
        .groupBy("kind", "size", "piece")
        .agg(F.count("*").alias("seen"))
    )
    # Among equally rare pieces a hash decides: the smallest numbers end in blanks, which text is full of.
    seen = F.coalesce("seen", F.lit(0)).alias("seen")
    rarest = F.min(F.struct(seen, "n", F.xxhash64("piece").alias("turn"), "piece", "size", "slot"))
    anchors = (
        pieces.join(shared.drop("slot"), ["kind", "size", "piece"])
        .join(in_text, ["kind", "size", "piece"], "left")
        .groupBy("kind", "pattern")
        .agg(rarest.alias("anchor"))
        .select("kind", "pattern", "anchor.size", "anchor.piece", "anchor.slot")
    )
    anchors = _stored(anchors, "anchors")
    sizes = {r["size"]: r["count"] for r in anchors.groupBy("size").count().collect()}
    bits = bitmap_bits(sum(sizes.values()))
    known = text_pieces(F.col("value"), sorted(sizes), bits, piece_bitmap(anchors, bits))
    return (
        evidence.select(*evidence.columns, F.inline(known))
        .join(anchors.drop("slot"), ["kind", "size", "piece"])
        .where(F.contains("value", F.col("pattern")))
        .select(*evidence.columns, "pattern")
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table of the catalogue, written once to the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _longest_from_hits(contained: DataFrame) -> DataFrame:
    """Leftmost-longest matches from the literals each row is known to contain.

    Equal rows hold equal literals, so they are one group, whose size over the
    number of its literals says how often the row is there.
    """
    rows = contained.groupBy(*schema.EVIDENCE.names).agg(
        F.collect_set("pattern").alias("literals"), F.count(F.lit(1)).alias("n")
    )
    found = F.regexp_extract_all("value", _alternation(F.col("literals")), F.lit(0))
    copies = F.sequence(F.lit(1).cast("long"), F.expr("n div size(literals)"))
    each = rows.select(*schema.EVIDENCE.names, found.alias("found"), F.explode(copies))
    return each.select(*schema.EVIDENCE.names, F.posexplode("found").alias("match_pos", "pattern"))


def regex_candidates(evidence: DataFrame, expressions: DataFrame) -> DataFrame:
    """Evidence rows with each of ``expressions(kind, pattern, literals)`` that they may match.

    ``literals`` are those of which every match of the expression holds one. A
    row meets an expression by the first of its literals that the row holds, so
    both meet once at most, whatever else they share.
    """
    listed = expressions.select("kind", "pattern", "literals", F.explode("literals").alias("literal"))
    table = listed.select("kind", F.col("literal").alias("pattern")).distinct().withColumn("is_regex", F.lit(False))
    kinds = [r["kind"] for r in expressions.select("kind").distinct().collect()]
    held = _contained(evidence, PatternSet(table, table, None), kinds).withColumnRenamed("pattern", "literal")
    first = F.get(F.filter("literals", lambda literal: F.contains(F.col("value"), literal)), F.lit(0))
    return held.join(listed, ["kind", "literal"]).where(first == F.col("literal")).drop("literal", "literals")


def _regex_distributed(evidence: DataFrame, patterns: PatternSet, kinds: Sequence[str]) -> DataFrame:
    """Very many regular expressions: only rows that hold a literal of one meet it.

    Expressions that need no literal still meet every row of their kind.
    """
    wanted = F.col("kind").isin(*kinds)
    distinct = patterns.table.where(wanted & F.col("is_regex")).select("kind", "pattern").distinct()
    expressions = _stored(distinct.withColumn("literals", needed_literals(F.col("pattern"))), "expressions")
    indexed = regex_candidates(evidence, expressions.where("size(literals) > 0"))
    columns = [*schema.EVIDENCE.names, "pattern"]
    found = indexed.where(regex_found(F.col("value"), F.col("pattern"))).select(*columns)
    rest = expressions.where("size(literals) = 0").select("kind", "pattern")
    if not rest.isEmpty():
        found = found.unionByName(_regex_blocks(evidence, rest).select(*columns))
    return found.withColumns({"match_pos": F.lit(0), "is_regex": F.lit(True)})


def _regex_blocks(evidence: DataFrame, distinct: DataFrame) -> DataFrame:
    """Expressions ``(kind, pattern)`` that no literal tells of, in blocks against copies of the evidence.

    Every value has to meet every one of its kind; blocks keep each task's share
    of expressions bounded.
    """
    blocks = max(1, -(-distinct.count() // REGEX_BLOCK))
    block = F.pmod(F.xxhash64("kind", "pattern"), F.lit(blocks)).cast("int")
    copies = evidence.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = copies.join(distinct.withColumn("block", block), ["kind", "block"])
    return met.where(regex_found(F.col("value"), F.col("pattern")))
