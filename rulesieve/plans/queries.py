"""Registered queries: one or more per operator, each over whole given tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulesieve import schema
from rulesieve.functions import text as tx
from rulesieve.operators import budgets, diff, evidence as ev, findings as fi, intervals, matching, policy, report, runs, sketches
from rulesieve.plans import corpus, pack
from rulesieve.session import dealt, scratch_path
from rulesieve.sources import catalogue, files, history
from rulesieve.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Sources before this name form the old corpus of the diff queries, the rest the new.
DIFF_BOUNDARY = "src15"
BYTE_LIMIT = 50_000
ORDER_BYTES = 120
LARGE_COUNT = 5_000


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _joined(column: str, separator: str = ",") -> Column:
    return F.array_join(column, separator)


# --- sources and sinks -------------------------------------------------------


@query
def text_fingerprint(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", tx.fingerprint(F.col("text")).alias("sha256")
    )


@query
def event_minute_key(spark, sf_dir):
    key = tx.bucketed_key(F.col("event_type"), tx.utc_millis(F.col("ts")))
    return corpus.table(spark, sf_dir, "events").select("event_id", key.alias("minute_key"))


@query
def catalogue_load(spark, sf_dir):
    """Stored without the optional fields, loaded with their defaults."""
    path = scratch_path(spark, "catalogue")
    stored = corpus.part_rules(spark, sf_dir).withColumn(
        "behavior", F.when(F.col("behavior") != "unknown", F.col("behavior"))
    )
    stored.drop("is_regex").withColumnRenamed("guidance_key", "bypass_hint").write.json(path)
    rules = catalogue.load_rules(spark, path, fmt="json")
    return rules.withColumn("patterns", _joined("patterns", "|"))


@query
def catalogue_violations(spark, sf_dir):
    rules = corpus.part_rules(spark, sf_dir)
    return catalogue.rule_violations(rules)


@query
def catalogue_condition_gaps(spark, sf_dir):
    """Missing conditions in both directions: parts never ordered, and returned
    orders, which are named apart."""
    number = F.col("p_size").cast("long")
    rules = corpus.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        corpus.pick(schema.CATEGORIES, number).alias("category"),
        F.lit("log_only").alias("behavior"),
        F.split("p_name", " ").alias("patterns"),
    )
    conditions = (
        corpus.table(spark, sf_dir, "lineitem")
        .select(F.concat("l_partkey", F.when(F.col("l_returnflag") == "R", "R").otherwise("")).alias("rule_id"))
    )
    return catalogue.rule_violations(rules, conditions)


@query
def catalogue_listing(spark, sf_dir):
    return catalogue.list_rules(corpus.part_rules(spark, sf_dir))


@query
def catalogue_by_category(spark, sf_dir):
    rules = catalogue.rules_for(corpus.part_rules(spark, sf_dir), category="anti_hooking")
    return rules.select("id", "name", "category", "severity")


@query
def catalogue_by_id(spark, sf_dir):
    """Rules of the parts that were ordered."""
    rules = corpus.part_rules(spark, sf_dir)
    ordered = corpus.table(spark, sf_dir, "lineitem").select("l_partkey")
    parts = corpus.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_name", "p_brand").alias("id")
    )
    wanted = parts.join(ordered, "l_partkey", "left_semi")
    return catalogue.rules_for_ids(rules, wanted).select("id", "category", "behavior")


@query
def catalogue_patterns(spark, sf_dir):
    return catalogue.pattern_table(corpus.part_rules(spark, sf_dir)).drop("is_regex")


@query
def catalogue_pattern_rules(spark, sf_dir):
    return catalogue.pattern_rules(corpus.benchmark_rules(spark, sf_dir)).drop("is_regex")


@query
def findings_round_trip(spark, sf_dir):
    path = scratch_path(spark, "findings")
    files.write_findings(corpus.findings(spark, sf_dir), path)
    return files.read_findings(spark, path)


@query
def findings_round_trip_json(spark, sf_dir):
    path = scratch_path(spark, "findings")
    files.write_findings(corpus.findings(spark, sf_dir), path, "json")
    return files.read_findings(spark, path, "json")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as history rows; all orders of a day share the key."""
    return corpus.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("label"),
        F.concat(F.lit("order/"), "o_orderkey").alias("path"),
        F.concat_ws(" ", "o_orderstatus", F.col("o_custkey").cast("string")).alias("report"),
        tx.utc_millis(F.col("o_orderdate")).alias("created_at"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("status"),
    )


@query
def history_upsert(spark, sf_dir):
    rows = _history(spark, sf_dir)
    old = rows.where("status = 'F'").drop("status")
    new = rows.where("status <> 'F'").drop("status")
    return history.upsert_history(old, new).drop("seq")


@query
def history_append(spark, sf_dir):
    """The same through storage: two batches appended, resolved on read."""
    path = scratch_path(spark, "history")
    rows = _history(spark, sf_dir)
    history.append_history(rows.where("status = 'F'"), path, 0)
    history.append_history(rows.where("status <> 'F'"), path, 1)
    return history.read_history(spark, path)


@query
def history_cleared(spark, sf_dir):
    path = scratch_path(spark, "history")
    history.append_history(_history(spark, sf_dir), path, 0)
    counted = scratch_path(spark, "count")
    history.read_history(spark, path).agg(F.count("*").alias("rows_before")).write.parquet(counted)
    history.clear_history(spark, path)
    after = history.read_history(spark, path).agg(F.count("*").alias("rows_after"))
    return after.withColumn("rows_before", spark.read.parquet(counted).scalar())


@query
def history_listing(spark, sf_dir):
    rows = corpus.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("label"),
        F.concat(F.lit("event/"), "event_id").alias("path"),
        F.repeat(F.concat_ws(" ", "event_type", "props"), 12).alias("report"),
        tx.utc_millis(F.col("ts")).alias("created_at"),
    )
    return history.history(rows)


# --- projections and filters -------------------------------------------------


@query
def code_entries(spark, sf_dir):
    entries = corpus.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return ev.code_containers(entries, "small", "ring")


@query
def library_names(spark, sf_dir):
    libs = ev.native_lib_names(corpus.path_entries(spark, sf_dir))
    return libs.select("artifact_id", "entry_ord", "abi", "filename", "uncompressed_size")


@query
def order_haystack(spark, sf_dir):
    return ev.manifest_haystack(corpus.order_elements(spark, sf_dir))


@query
def customer_haystack_segments(spark, sf_dir):
    """Small segments with lookahead, as a huge manifest would be cut."""
    elements = corpus.customer_elements(spark, sf_dir)
    return ev.manifest_haystack(elements, segment=4096, lookahead=24)


@query
def first_attribute(spark, sf_dir):
    return ev.first_attr(corpus.customer_elements(spark, sf_dir), "name")


@query
def first_tagged_attribute(spark, sf_dir):
    return ev.first_attr(corpus.customer_elements(spark, sf_dir), "name", tag="open")


@query
def attribute_values(spark, sf_dir):
    return ev.attr_values(corpus.customer_elements(spark, sf_dir), "open", "name")


@query
def document_strings(spark, sf_dir):
    return corpus.document_lines(spark, sf_dir).select("doc_id", "ordinal", "value")


@query
def evidence_union(spark, sf_dir):
    turns = ev.explode_strings(
        corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    )
    spoken = ev.evidence(
        turns, "dex_string", F.col("conv_id"), F.col("turn"), F.col("turn"), F.col("ordinal"), F.col("value")
    )
    parts = [
        corpus.document_evidence(spark, sf_dir),
        corpus.page_evidence(spark, sf_dir),
        spoken,
    ]
    return (
        ev.build_evidence(parts)
        .groupBy("kind", "container_ord")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("artifact_id").alias("n_artifacts"),
            F.sum(F.length("value")).alias("n_chars"),
            F.sum("ordinal").alias("ordinals"),
        )
    )


@query
def customer_search(spark, sf_dir):
    customers = corpus.table(spark, sf_dir, "customer")
    return ev.search(customers, ["c_name", "c_mktsegment"], "BUILD", "c_name", "c_nationkey").select(
        "c_custkey", "c_name", "c_mktsegment"
    )


@query
def part_search_blank(spark, sf_dir):
    parts = corpus.table(spark, sf_dir, "part")
    return ev.search(parts, ["p_name"], "  ", "p_name", "p_brand").select("p_partkey", "p_name")


@query
def text_preview(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", tx.truncate(F.col("text")).alias("preview")
    )


@query
def report_counts(spark, sf_dir):
    """Counter lines written per customer, then read back."""
    status = F.col("o_orderstatus")
    counts = corpus.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("t"),
        F.count_if(status == "F").alias("a"),
        F.count_if(status == "O").alias("b"),
        F.count_if(status == "P").alias("c"),
    )
    line = F.format_string(tx.COUNTS_TEXT, "t", "a", "b", "c")
    stored = counts.select("o_custkey", F.when(F.col("c") > 0, line).otherwise("no counters").alias("report"))
    parsed = stored.select("o_custkey", tx.parse_counts(F.col("report")).alias("p"))
    return parsed.select("o_custkey", "p.*")


@query
def license_marker(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", tx.classify_marker(F.col("text"), pack.LICENSE_MARKERS).alias("license")
    )


@query
def overall_marker(spark, sf_dir):
    """Overall results written into report text, then classified and explained."""
    evaluated = _evaluated(spark, sf_dir)
    shown = {label: marker for marker, label in tx.OVERALL_MARKERS}
    text = None
    for label, marker in shown.items():
        line = F.concat(F.lit(f"**{marker} "), "n_total", F.lit(" checks.** end"))
        test = F.col("overall") == label
        text = F.when(test, line) if text is None else text.when(test, line)
    stored = policy.overall(evaluated).select("artifact_id", "profile_id", text.alias("report"))
    return stored.select(
        "artifact_id",
        "profile_id",
        tx.classify_marker(F.col("report")).alias("overall"),
        tx.marker_explanation(F.col("report")).alias("explanation"),
    )


# --- matching ----------------------------------------------------------------

_MATCH = ("artifact_id", "kind", "container_ord", "ordinal", "match_pos", "pattern", "rule_id", "pattern_ord")


@query
def match_contains_documents(spark, sf_dir):
    lines = corpus.document_evidence(spark, sf_dir)
    return matching.match_contains(lines, corpus.catalogue(spark)).select(*_MATCH, "value")


@query
def match_longest_documents(spark, sf_dir):
    lines = corpus.document_evidence(spark, sf_dir)
    return matching.match_longest(lines, corpus.catalogue(spark)).select(*_MATCH, "value")


@query
def match_longest_pages(spark, sf_dir):
    return matching.match_longest(corpus.page_evidence(spark, sf_dir), corpus.catalogue(spark)).select(*_MATCH)


@query
def match_page_markup(spark, sf_dir):
    """The whole markup of all pages, line by line."""
    return matching.match_longest(corpus.page_markup(spark, sf_dir), corpus.catalogue(spark)).select(*_MATCH)


@query
def match_regex_documents(spark, sf_dir):
    lines = corpus.document_evidence(spark, sf_dir)
    return matching.match_regex(lines, corpus.catalogue(spark)).select(*_MATCH)


@query
def match_entry_names(spark, sf_dir):
    evidence = corpus.page_evidence(spark, sf_dir)
    return matching.match_contains(evidence, corpus.catalogue(spark), ["zip_entry"]).select(*_MATCH)


@query
def match_all_kinds(spark, sf_dir):
    """Every kind in its own way; a rule only ever sees evidence of its kind."""
    matches = matching.match(
        corpus.all_evidence(spark, sf_dir),
        corpus.catalogue(spark),
        longest=["dex_string"],
        contains=["zip_entry", "native_lib_name", "manifest"],
        regex=["dex_string"],
    )
    return matches.select(*_MATCH)


@query
def match_shared_patterns(spark, sf_dir):
    """Matches of patterns that several rules list: all of those rules fire."""
    shared = catalogue.pattern_table(corpus.rules(spark)).where("n_rules > 1").select("pattern")
    lines = corpus.document_evidence(spark, sf_dir)
    matches = matching.match_longest(lines, corpus.catalogue(spark)).join(shared, "pattern", "left_semi")
    return matches.select(*_MATCH)


@query
def match_benchmark_passages(spark, sf_dir):
    """Document lines against every line of the benchmark, whatever its size."""
    lines = corpus.document_evidence(spark, sf_dir)
    return matching.match_contains(lines, corpus.benchmark_rules(spark, sf_dir)).select(*_MATCH)


@query
def match_benchmark_openings(spark, sf_dir):
    """Document lines against as many regular expressions as the benchmark has beginnings."""
    lines = corpus.document_evidence(spark, sf_dir)
    return matching.match_regex(lines, corpus.opening_rules(spark, sf_dir)).select(
        "artifact_id", "container_ord", "ordinal", "pattern", "rule_id"
    )


@query
def match_openings_distributed(spark, sf_dir):
    """The same by the literals that the expressions need, as for a catalogue of any size."""
    patterns = matching.PatternSet.distributed(corpus.opening_rules(spark, sf_dir))
    return matching.match_regex(corpus.document_evidence(spark, sf_dir), patterns).select(
        "artifact_id", "container_ord", "ordinal", "pattern", "rule_id"
    )


@query
def match_benchmark_distributed(spark, sf_dir):
    """The passages by equi-join on pattern pieces, as for a catalogue of any size."""
    patterns = matching.PatternSet.distributed(corpus.benchmark_rules(spark, sf_dir))
    lines = corpus.document_evidence(spark, sf_dir)
    return matching.match_contains(lines, patterns).select(*_MATCH)


@query
def match_longest_distributed(spark, sf_dir):
    """Leftmost-longest without bringing the catalogue to the driver."""
    patterns = matching.PatternSet.distributed(corpus.rules(spark))
    lines = corpus.document_evidence(spark, sf_dir)
    return matching.match_longest(lines, patterns).select(*_MATCH)


@query
def first_pattern_pages(spark, sf_dir):
    matches = matching.match_contains(corpus.page_evidence(spark, sf_dir), corpus.catalogue(spark))
    return fi.first_pattern_hits(matches).select(*_MATCH)


@query
def capped_evidence(spark, sf_dir):
    lines = corpus.document_evidence(spark, sf_dir, "source")
    capped = fi.cap_evidence(matching.match_longest(lines, corpus.catalogue(spark)))
    return capped.select(*_MATCH, "evidence_rank")


@query
def findings_by_document(spark, sf_dir):
    return corpus.findings(spark, sf_dir)


@query
def incremental_findings(spark, sf_dir):
    """Findings after three refreshes: of part of the documents in an older state
    against part of the rules, of other documents, and of all as they are now."""
    return corpus.refreshed_findings(spark, sf_dir).findings()


@query
def incremental_rescans(spark, sf_dir):
    """Which documents the last refresh had to scan: the others kept their findings."""
    store = corpus.refreshed_findings(spark, sf_dir)
    last = store.version()
    return store.snapshot().select("artifact_id", (F.col("since") == last).alias("scanned"))


@query
def findings_by_source(spark, sf_dir):
    return corpus.findings(spark, sf_dir, "source")


@query
def findings_all_kinds(spark, sf_dir):
    """The full scan; evidence text takes the form of its kind."""
    return fi.scan(corpus.all_evidence(spark, sf_dir), corpus.catalogue(spark))


@query
def clean_documents(spark, sf_dir):
    return fi.clean_artifacts(corpus.artifacts(spark, sf_dir), corpus.findings(spark, sf_dir))


# --- budgets -----------------------------------------------------------------


@query
def byte_budget_sources(spark, sf_dir):
    entries = corpus.document_entries(spark, sf_dir)
    return budgets.within_bytes(entries, BYTE_LIMIT)


@query
def byte_budget_orders(spark, sf_dir):
    """Line quantities of an order while they add up to the limit."""
    lines = dealt(corpus.table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("artifact_id"),
        F.col("l_linenumber").alias("container_ord"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.col("l_extendedprice"),
        F.col("l_quantity").cast("long").alias("uncompressed_size"),
    )
    ties = ["l_partkey", "l_suppkey", "l_extendedprice"]
    return budgets.within_bytes(lines, ORDER_BYTES, ties=ties)


@query
def first_orders(spark, sf_dir):
    orders = corpus.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("artifact_id"), F.col("o_orderkey").alias("container_ord"), "o_orderstatus"
    )
    return budgets.first_n(orders, schema.MAX_CONTAINERS)


@query
def first_orders_large(spark, sf_dir):
    """A large count, per order status."""
    orders = corpus.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("artifact_id"), F.col("o_orderkey").alias("container_ord"), "o_custkey"
    )
    return budgets.first_n(orders, LARGE_COUNT)


@query
def scan_outcome(spark, sf_dir):
    entries = corpus.document_entries(spark, sf_dir)
    budgeted = budgets.apply_budget(entries, BYTE_LIMIT, 40)
    return budgets.outcome(budgeted, BYTE_LIMIT, 40)


@query
def scan_outcome_defaults(spark, sf_dir):
    entries = corpus.document_entries(spark, sf_dir)
    limits = schema.MAX_TOTAL_BYTES, schema.MAX_CONTAINERS
    return budgets.outcome(budgets.apply_budget(entries, *limits), *limits)


@query
def budgeted_findings(spark, sf_dir):
    """A scan under a budget: outcome and findings per source; languages, which
    have no containers, stand for artifacts with nothing to scan."""
    kept = budgets.apply_budget(corpus.document_entries(spark, sf_dir), BYTE_LIMIT, 40)
    docs = corpus.table(spark, sf_dir, "documents")
    spine = docs.select(F.col("source").alias("artifact_id")).union(docs.select("lang")).distinct()
    lines = corpus.document_evidence(spark, sf_dir, "source")
    found = fi.scan(lines, corpus.catalogue(spark), containers=kept)
    scanned = fi.scan_report(budgets.outcome(kept, BYTE_LIMIT, 40, spine), found)
    return scanned.withColumn("rule_ids", _joined("rule_ids"))


# --- report tables -----------------------------------------------------------


@query
def document_summary(spark, sf_dir):
    entries = corpus.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("artifact_id"), F.col("n_chars").alias("uncompressed_size")
    )
    found = corpus.findings(spark, sf_dir)
    return report.artifact_summary(corpus.artifacts(spark, sf_dir), entries, found, corpus.rules(spark))


@query
def guided_findings(spark, sf_dir):
    found = corpus.findings(spark, sf_dir)
    guided = report.with_guidance(found, corpus.rules(spark), corpus.guidance(spark))
    return guided.select("artifact_id", "rule_id", "guidance_key", "description", "guidance")


@query
def category_rollup(spark, sf_dir):
    return report.category_rollup(corpus.findings(spark, sf_dir))


@query
def category_rollup_sources(spark, sf_dir):
    return report.category_rollup(corpus.findings(spark, sf_dir, "source"))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per document with the document's language, source and size."""
    docs = corpus.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("artifact_id"), "doc_id", "lang", "source", "n_chars"
    )
    return corpus.findings(spark, sf_dir).join(docs, "artifact_id")


@query
def findings_cube(spark, sf_dir):
    return report.findings_cube(_described(spark, sf_dir), ["source", "lang", "category"])


@query
def rule_reach_merged(spark, sf_dir):
    """Documents per rule from sketches kept per source, beside the exact count."""
    found = _described(spark, sf_dir)
    kept = sketches.distinct_sketches(found, ["source", "rule_id"], "artifact_id")
    estimated = sketches.distinct_estimates(sketches.merge_distinct(kept, ["rule_id"]))
    exact = found.groupBy("rule_id").agg(F.count_distinct("artifact_id").alias("n_artifacts"))
    off = F.abs(F.col("estimate") - F.col("n_artifacts"))
    within = off <= F.greatest(F.lit(1.0), sketches.distinct_error() * F.col("n_artifacts"))
    return exact.join(estimated, "rule_id").select("rule_id", "n_artifacts", within.alias("within_error"))


@query
def rule_sizes_merged(spark, sf_dir):
    """Quantiles of the sizes of the documents that a rule found, from bins kept per source, beside the exact ones."""
    found = _described(spark, sf_dir).where("n_chars is not null")
    shares = [0.5, 0.9]
    kept = sketches.amount_bins(found, ["source", "rule_id"], F.col("n_chars"))
    estimated = sketches.quantiles(sketches.merge_bins(kept, ["rule_id"]), ["rule_id"], shares)
    exact = found.groupBy("rule_id").agg(
        *[F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY n_chars)").cast("long").alias(f"p{share * 100:.0f}") for share in shares]
    )
    both = exact.join(estimated, "rule_id")
    # The last ulp of a logarithm may put an amount at the edge into the next bin.
    bound = sketches.ACCURACY + 1e-9
    within = [
        (F.abs(F.col("quantiles")[i] - F.col(f"p{share * 100:.0f}")) <= bound * F.col(f"p{share * 100:.0f}"))
        for i, share in enumerate(shares)
    ]
    return both.select("rule_id", "p50", "p90", (within[0] & within[1]).alias("within_error"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of documents, as the scans of their source, in which a rule fired."""
    scans = corpus.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("scan"))
    found = corpus.findings(spark, sf_dir).select(F.col("artifact_id").cast("long").alias("scan"), "rule_id")
    return runs.firing_runs(scans, scans.join(found, "scan"), ["source"])


@query
def rule_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query
def rule_flaps(spark, sf_dir):
    return runs.firing_history(_runs(spark, sf_dir), ["source"])


@query
def ordered_findings(spark, sf_dir):
    ordered = report.order_findings(corpus.findings(spark, sf_dir))
    return ordered.select("artifact_id", "position", "rule_id", "category", "severity")


@query
def blocking_findings(spark, sf_dir):
    return report.blocking_only(corpus.findings(spark, sf_dir)).select("artifact_id", "rule_id", "behavior")


@query
def severe_findings(spark, sf_dir):
    return report.min_severity(corpus.findings(spark, sf_dir)).select("artifact_id", "rule_id", "severity")


@query
def blocking_counts(spark, sf_dir):
    return report.blocking_counts(corpus.artifacts(spark, sf_dir), corpus.findings(spark, sf_dir))


@query
def rule_prevalence(spark, sf_dir):
    return report.prevalence(
        corpus.findings(spark, sf_dir), corpus.artifacts(spark, sf_dir), corpus.rules(spark)
    )


# --- diff --------------------------------------------------------------------


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per language compared: over the sources before the boundary, and
    the rest. Both are found in one scan, told apart by the artifact's name."""
    side = F.when(F.col("source") >= DIFF_BOUNDARY, "new/").otherwise("old/")
    lines = corpus.document_lines(spark, sf_dir).withColumn("lang", F.concat(side, "lang"))
    found = fi.scan(corpus.line_evidence(lines, "lang"), corpus.catalogue(spark))
    marked = found.withColumn("is_new", F.startswith("artifact_id", F.lit("new/")))
    return diff.diff_marked(marked.withColumn("artifact_id", F.expr("substring(artifact_id, 5)")), "is_new")


@query
def latest_findings(spark, sf_dir):
    """Findings of all documents of a language, the last document's one kept."""
    docs = corpus.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("artifact_id"), F.col("doc_id").alias("seq"), "lang"
    )
    found = corpus.findings(spark, sf_dir).join(docs, "artifact_id").drop("artifact_id")
    latest = diff.latest_by_key(found, ["lang", "rule_id", "category"])
    return latest.select("lang", "rule_id", "category", "seq", "severity", "evidence")


@query
def findings_diff(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    return changes.select("artifact_id", "rule_id", "category", "status", "severity", "evidence")


@query
def diff_counts(spark, sf_dir):
    return diff.diff_counts(_changes(spark, sf_dir))


@query
def ordered_diff(spark, sf_dir):
    changes = diff.order_diff(_changes(spark, sf_dir))
    return changes.select("status", "category", "rule_id", "artifact_id", "behavior")


@query
def host_diff(spark, sf_dir):
    """Hosts over plain and over encrypted connections."""
    urls = ev.entry_evidence(corpus.page_entries(spark, sf_dir))
    plain = F.startswith(F.col("value"), F.lit("http://"))
    rules = corpus.catalogue(spark)
    changes = diff.diff(fi.scan(urls.where(plain), rules), fi.scan(urls.where(~plain), rules))
    return changes.select("artifact_id", "rule_id", "category", "status", "evidence")


# --- policy ------------------------------------------------------------------


def _evaluated(
    spark: SparkSession, sf_dir: str, *attributes: str, blocking: bool = True, profiles: DataFrame | None = None
) -> DataFrame:
    """Stored findings per source, for the users who met it, carrying some attributes."""
    evaluate = policy.evaluate_blocking if blocking else policy.evaluate_pairs
    return evaluate(
        corpus.stored_findings(spark, sf_dir, "source"),
        corpus.pairs(spark, sf_dir),
        corpus.profile_maps(spark, sf_dir) if profiles is None else profiles,
        corpus.conditions(spark),
        attributes or ("rule_id",),
    )


@query
def profiles_parsed(spark, sf_dir):
    """Event properties as profile text: a third well-formed, with an unknown
    key, a null and a missing one; some with an unquoted key; some with a value
    that is no boolean."""
    flag = F.when(F.col("value") > 20, "true").otherwise("false")
    good = F.format_string('{"click": %s, "view": null, "other": true}', flag)
    unquoted = F.format_string("{click: %s}", flag)
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", unquoted).when(kind == "view", F.col("props")).otherwise(good)
    )
    stored = corpus.table(spark, sf_dir, "events").select("event_id", text.alias("profile_text"))
    return policy.parse_profiles(stored, "profile_text", ["click", "error", "view"])


@query
def profiles_written(spark, sf_dir):
    return corpus.profiles(spark, sf_dir).select("profile_id", policy.profile_json(pack.FIELDS).alias("profile"))


@query
def verdicts(spark, sf_dir):
    return policy.verdict_rows(_evaluated(spark, sf_dir, blocking=False)).select(
        "artifact_id", "profile_id", "rule_id", "verdict", "detail"
    )


@query
def blocking_verdicts(spark, sf_dir):
    return policy.verdict_rows(_evaluated(spark, sf_dir)).select(
        "artifact_id", "profile_id", "rule_id", "verdict"
    )


@query
def catalogue_verdicts(spark, sf_dir):
    found = policy.evaluate_catalogue(
        corpus.rules(spark), corpus.profile_maps(spark, sf_dir), corpus.conditions(spark)
    )
    return found.select("profile_id", "rule_id", "verdict", "detail")


@query
def verdict_counts(spark, sf_dir):
    return policy.verdict_counts(_evaluated(spark, sf_dir))


@query
def unprofiled_verdicts(spark, sf_dir):
    """Only users whose clicks are known have a profile; the others' pairs stay."""
    known = corpus.profile_maps(spark, sf_dir).where(F.col("profile")["click"].isNotNull())
    return policy.verdict_rows(_evaluated(spark, sf_dir, blocking=False, profiles=known)).select(
        "artifact_id", "profile_id", "rule_id", "verdict"
    )


@query
def overall_verdict(spark, sf_dir):
    return policy.overall(_evaluated(spark, sf_dir)).select("artifact_id", "profile_id", "overall")


@query
def verdict_documents(spark, sf_dir):
    shown = ("rule_id", "rule_name", "category", "severity", "evidence")
    return policy.verdict_documents(_evaluated(spark, sf_dir, *shown))


@query
def ordered_verdicts(spark, sf_dir):
    rows = policy.verdict_rows(_evaluated(spark, sf_dir, "rule_id", "category", "severity"))
    return policy.order_verdicts(rows).select("artifact_id", "profile_id", "verdict", "category", "rule_id")


# --- joins of times and positions ----------------------------------------------


@query
def events_as_of_orders(spark, sf_dir):
    """Every event, set back to the years of the orders, with its user's last order until then."""
    events = corpus.table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.expr("ts - INTERVAL '27' YEAR").alias("at")
    )
    orders = corpus.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), "o_orderkey", "o_orderstatus"
    )
    return intervals.as_of(events, orders, "at", ["user_id"]).select(
        "event_id", "user_id", "right_o_orderkey", "right_o_orderstatus"
    )


@query
def orders_open_together(spark, sf_dir):
    """Pairs of orders of a customer that were open on the same day, from order to last shipment."""
    day = F.date_diff("o_orderdate", F.lit("1970-01-01").cast("date"))
    shipped = corpus.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    orders = corpus.table(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    last = F.date_diff("shipped", F.lit("1970-01-01").cast("date")) + 1
    periods = orders.select("o_custkey", "o_orderkey", day.alias("start"), last.alias("end"))
    pairs = intervals.overlapping(periods, periods, by=["o_custkey"])
    return pairs.select("o_custkey", "left_o_orderkey", "right_o_orderkey")


# --- windows of a stream --------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, slide: str | None) -> DataFrame:
    """Closed windows of a day of the events, read as a stream; events are at most an hour late."""
    # A pattern, as a stream takes a plain path for a folder, and the table may be one file.
    stream = spark.readStream.schema(corpus.COLUMNS["events"]).parquet(f"{sf_dir}/[e]vents.parquet")
    events = stream.select("event_type", F.timestamp_millis(tx.utc_millis(F.col("ts"))).alias("at"))
    closed = windows.windows_so_far(spark, windows.window_counts(events, "at", ["event_type"], "1 day", slide))
    return closed.select("event_type", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


@query
def event_days_streamed(spark, sf_dir):
    return _streamed(spark, sf_dir, None)


@query
def event_sliding_days_streamed(spark, sf_dir):
    return _streamed(spark, sf_dir, "6 hours")
