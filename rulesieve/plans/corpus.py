"""Artifacts, evidence, catalogues and profiles derived from the given tables."""

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulesieve import schema
from rulesieve.functions.text import fingerprint
from rulesieve.operators import evidence as ev
from rulesieve.operators.findings import scan
from rulesieve.operators.incremental import FindingStore, read_evidence, write_evidence
from rulesieve.operators.matching import PatternSet
from rulesieve.operators.policy import profile_map
from rulesieve.plans import pack
from rulesieve.session import dealt, scratch_path
from rulesieve.sources.catalogue import local_table, rules_frame
from rulesieve.sources.files import read_findings, write_findings


# Columns of the given tables; stated, so that no job has to read footers first.
COLUMNS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=4)
def catalogue(spark: SparkSession) -> PatternSet:
    """The rule pack, compiled once per session."""
    return PatternSet.of(rules_frame(spark, pack.RULES))


def rules(spark: SparkSession) -> DataFrame:
    return catalogue(spark).rules


def conditions(spark: SparkSession) -> DataFrame:
    rows = [
        dict(rule_id=r, row_no=n, fields=list(f.items()), verdict=v, detail=d)
        for r, n, f, v, d in pack.CONDITIONS
    ]
    return local_table(spark, rows, schema.CONDITION)


def guidance(spark: SparkSession) -> DataFrame:
    struct = schema._struct(("guidance_key", schema._S), ("guidance", schema._S))
    return local_table(spark, [dict(guidance_key=k, guidance=g) for k, g in pack.GUIDANCE], struct)


# --- evidence ----------------------------------------------------------------


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ordinal, value), one row per line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return ev.explode_strings(dealt(docs, "doc_id"))


def line_evidence(lines: DataFrame, artifact: str = "doc_id") -> DataFrame:
    """Document lines as code strings; the documents are the containers."""
    return ev.evidence(
        lines, "dex_string", F.col(artifact), F.col("doc_id"), F.col("doc_id"), F.col("ordinal"), F.col("value")
    )


def document_evidence(spark: SparkSession, sf_dir: str, artifact: str = "doc_id") -> DataFrame:
    return line_evidence(document_lines(spark, sf_dir), artifact)


def host(url: str = "url") -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/]+)", 1)


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the entries of their host."""
    return table(spark, sf_dir, "pages").select(
        host().alias("artifact_id"),
        F.col("page_id").alias("entry_ord"),
        F.col("url").alias("name"),
        F.length("url").cast("long").alias("compressed_size"),
        F.length("html").cast("long").alias("uncompressed_size"),
        F.lit(True).alias("is_compressed"),
    )


def path_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths as library entries ``lib/<lang>/<page>.so`` of their host."""
    path = F.regexp_extract("name", "^[a-z]+://[^/]+/(.*)$", 1)
    name = F.concat(F.lit("lib/"), path, F.lit(".so"))
    return page_entries(spark, sf_dir).withColumn("name", name)


def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as entry names and URL paths as library names."""
    urls = ev.entry_evidence(page_entries(spark, sf_dir))
    libs = ev.lib_evidence(ev.native_lib_names(path_entries(spark, sf_dir)))
    return ev.build_evidence([urls, libs])


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.cast("string").alias("v"))


def order_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the elements of its manifest."""
    attrs = F.array(
        _pair("part", F.col("l_partkey")),
        _pair("qty", F.col("l_quantity").cast("long")),
        _pair("flag", F.col("l_returnflag")),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"
    )
    return dealt(lines, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("artifact_id"),
        F.col("l_linenumber").cast("long").alias("elem_ord"),
        F.lit("item").alias("tag"),
        attrs.alias("attrs"),
    )


def customer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as elements; ``name`` is listed twice or, while an
    order is pending, not at all."""
    status = F.col("o_orderstatus")
    named = F.array(
        _pair("status", status), _pair("name", F.col("o_orderpriority")), _pair("name", status)
    )
    unnamed = F.array(_pair("status", status))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("artifact_id"),
        F.col("o_orderkey").alias("elem_ord"),
        F.when(status == "F", "filled").otherwise("open").alias("tag"),
        F.when(status == "P", unnamed).otherwise(named).alias("attrs"),
    )


def page_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the pages' markup as code strings of their host."""
    pages = table(spark, sf_dir, "pages").select(host().alias("host"), "page_id", F.col("html").alias("text"))
    lines = ev.explode_strings(dealt(pages, "page_id"))
    return ev.evidence(
        lines, "dex_string", F.col("host"), F.col("page_id"), F.col("page_id"), F.col("ordinal"), F.col("value")
    )


def all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind: document lines, URLs, URL paths, order manifests."""
    manifests = ev.manifest_evidence(order_elements(spark, sf_dir))
    return ev.build_evidence(
        [document_evidence(spark, sf_dir), page_evidence(spark, sf_dir), manifests]
    )


# --- artifacts and findings --------------------------------------------------


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("artifact_id"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the containers of their source, sized in characters."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("artifact_id"),
        F.col("doc_id").alias("container_ord"),
        F.col("n_chars").alias("uncompressed_size"),
    )


def findings(spark: SparkSession, sf_dir: str, artifact: str = "doc_id") -> DataFrame:
    return scan(document_evidence(spark, sf_dir, artifact), catalogue(spark))


@lru_cache(maxsize=16)
def stored_findings(spark: SparkSession, sf_dir: str, artifact: str) -> DataFrame:
    """Findings scanned once and stored in the shared folder; evaluations read them from there."""
    path = scratch_path(spark, "findings")
    write_findings(findings(spark, sf_dir, artifact), path)
    return read_findings(spark, path)


#: Folders of the evidence that the given documents are laid out in.
DOCUMENT_PARTS = 16


@lru_cache(maxsize=16)
def refreshed_findings(spark: SparkSession, sf_dir: str) -> FindingStore:
    """A store that saw the documents change three times, ending with them as they are."""
    docs, store = table(spark, sf_dir, "documents"), FindingStore.create(spark, scratch_path(spark, "store"))
    number, all_rules = F.col("doc_id"), rules(spark)
    older = F.when(number % 5 == 1, F.left("text", F.lit(400))).otherwise(F.col("text"))
    states = [
        (docs.where(number % 7 != 2).withColumn("text", older), all_rules.where("id not in ('license-mit', 'secret-token')")),
        (docs.where(number % 7 != 3).withColumn("text", older), all_rules.where("id <> 'release-note'")),
        (docs, all_rules),
    ]
    for state, catalogue_then in states:
        path = scratch_path(spark, "evidence")
        lines = ev.explode_strings(dealt(state.select("doc_id", "text"), "doc_id"))
        write_evidence(line_evidence(lines), path, DOCUMENT_PARTS)
        inventory = state.select(number.cast("string").alias("artifact_id"), fingerprint(F.col("text")).alias("fingerprint"))
        store.refresh(inventory, read_evidence(spark, path), catalogue_then, parts=DOCUMENT_PARTS)
    return store


# --- catalogues that grow with the data --------------------------------------


def pick(values: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per part: its words are the patterns; ids repeat where the same
    name is sold under the same brand."""
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_name", "p_brand").alias("id"),
        F.col("p_name").alias("name"),
        pick(schema.CATEGORIES, size).alias("category"),
        pick(schema.SEVERITIES, size).alias("severity"),
        pick(schema.BEHAVIORS, size).alias("behavior"),
        F.lit("dex_string").alias("evidence_location"),
        F.split("p_name", " ").alias("patterns"),
        F.lit(False).alias("is_regex"),
        F.concat_ws(" ", "p_brand", "p_type").alias("description"),
        F.col("p_type").alias("guidance_key"),
    )


def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per benchmark item: its lines are the patterns."""
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    number = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"),
        F.lit("Benchmark passage").alias("name"),
        pick(schema.CATEGORIES, number).alias("category"),
        pick(schema.SEVERITIES, number).alias("severity"),
        pick(schema.BEHAVIORS, number).alias("behavior"),
        F.lit("dex_string").alias("evidence_location"),
        lines.alias("patterns"),
        F.lit(False).alias("is_regex"),
        F.lit("Text also found in a benchmark.").alias("description"),
        F.lit(None).cast("string").alias("guidance_key"),
    )


def opening_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per benchmark item: regular expressions for how its lines begin."""
    opening = F.transform(F.split("text", "\n"), lambda line: F.regexp_extract(line, "^[A-Za-z]+ [A-Za-z]+", 0))
    expression = F.transform(F.filter(opening, lambda o: o != ""), lambda o: F.concat(F.lit("^"), o, F.lit("\\b")))
    found = benchmark_rules(spark, sf_dir).drop("patterns", "is_regex")
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("id"),
        F.array_distinct(expression).alias("patterns"),
        F.lit(True).alias("is_regex"),
    )
    return found.join(items, "id")


# --- profiles ----------------------------------------------------------------


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(profile_id, click, error, ...): does most of a user's activity of a type
    exceed 20; null where there are fewer than twelve events of the type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    columns = []
    for name in pack.FIELDS:
        of_type = F.col("event_type") == name
        n, high = F.count_if(of_type), F.count_if(of_type & (F.col("value") > 20))
        columns.append(F.when(n >= 12, high * 2 > n).alias(name))
    grouped = events.groupBy("user_id").agg(*columns)
    return grouped.select(F.col("user_id").cast("string").alias("profile_id"), *pack.FIELDS)


def profile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_map(profiles(spark, sf_dir), pack.FIELDS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources a user meets: those of the documents their events name."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("profile_id"),
        F.get_json_object("props", "$.k").try_cast("long").alias("doc_id"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("artifact_id"))
    return events.distinct().join(docs, "doc_id").select("artifact_id", "profile_id").distinct()
