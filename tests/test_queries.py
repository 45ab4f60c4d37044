"""Every registered query against its SQL, over the smallest given tables."""

import os

import pytest

import __spark_entry__ as driver
from rulesieve.operators.matching import match_longest
from rulesieve.plans import corpus
from rulesieve.plans.oracles import ORACLES as OWN_ORACLES
from rulesieve.plans.queries import QUERIES as OWN_QUERIES
from tests.oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = OWN_QUERIES, OWN_ORACLES  # those of the subpackage have tests of their own

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")


@pytest.fixture(scope="module")
def sql():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    assert compare(spark, sql, name, SF_DIR, QUERIES[name], ORACLES[name]) == ""


def test_every_query_has_sql():
    assert set(OWN_QUERIES) == set(OWN_ORACLES)


def test_entry_has_rows(spark):
    found = driver.entry(spark)
    assert found.columns == ["artifact_id", "category", "n_findings", "highest_severity", "category_rank"]
    assert found.count() > 0


def test_longest_rules_are_a_subset_of_contained_rules(spark):
    pairs = {}
    for name in ("match_longest_documents", "match_contains_documents"):
        df = QUERIES[name](spark, SF_DIR).select("artifact_id", "ordinal", "rule_id").distinct()
        pairs[name] = {tuple(r) for r in df.collect()}
    longest, contained = pairs["match_longest_documents"], pairs["match_contains_documents"]
    assert longest < contained  # nested patterns make it strict


def test_scan_reads_only_what_it_needs(spark):
    lines = corpus.document_evidence(spark, SF_DIR)
    plan = match_longest(lines, corpus.catalogue(spark))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"history_cleared"}))
def test_no_nested_loops_or_row_udfs(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not [bad for bad in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython") if bad in plan]
