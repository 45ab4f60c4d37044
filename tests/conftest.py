import pytest

from rulesieve import schema
from rulesieve.session import local_session
from rulesieve.sources.catalogue import local_table, rules_frame


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_rules(spark):
    """Rules from short tuples (id, patterns[, overrides])."""

    def make(*rows):
        full = []
        for row in rows:
            rule_id, patterns, *rest = row
            rule = dict(
                id=rule_id, name=f"rule {rule_id}", category="root", severity="medium", behavior="hard_block",
                evidence_location="dex_string", patterns=patterns, description=f"about {rule_id}",
            )
            full.append({**rule, **(rest[0] if rest else {})})
        return rules_frame(spark, full)

    return make


@pytest.fixture
def make_evidence(spark):
    """Evidence from (artifact, kind, container, container_ord, ordinal, value)."""

    def make(*rows):
        names = schema.EVIDENCE.names
        return local_table(spark, [dict(zip(names, row)) for row in rows], schema.EVIDENCE)

    return make


@pytest.fixture
def strings(make_evidence):
    """Code strings of one artifact, in order."""
    return lambda *values: make_evidence(
        *[("a", "dex_string", "classes.dex", 0, i, v) for i, v in enumerate(values)]
    )


@pytest.fixture
def make_findings(spark):
    """Findings from (artifact, rule, category, severity, behavior[, evidence])."""

    def make(*rows):
        full = [
            dict(artifact_id=a, rule_id=r, rule_name=f"rule {r}", category=c, severity=s, behavior=b,
                 evidence=(rest[0] if rest else f"evidence of {r}"), guidance_key=None)
            for a, r, c, s, b, *rest in rows
        ]
        return local_table(spark, full, schema.FINDING)

    return make


@pytest.fixture
def artifacts(spark):
    struct = schema._struct(("artifact_id", schema._S))
    return lambda *ids: local_table(spark, [dict(artifact_id=i) for i in ids], struct)
