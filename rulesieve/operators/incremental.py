"""Findings kept up under changes of artifacts and rules.

A store is a folder of versions. Each refresh compares an inventory of artifacts
(id and fingerprint) and a catalogue with the last version, and scans only what
can have changed:

* artifacts that are new or have another fingerprint meet all rules;
* rules whose definition changed, came or went are looked for, by their old and
  new patterns, in the evidence of the other artifacts. Patterns can hide each
  other (the leftmost-longest one is reported), so an artifact that holds one of
  them meets all rules again. An artifact that holds none has no match of such a
  rule, before or after, nor one that such a rule could have hidden;
* artifacts that vanished are no longer listed.

An artifact's row says since which version its findings stand; findings of an
artifact are those written in that version, so what was found earlier is
retracted without a rewrite. A version counts once it is marked as done, which
happens last: a refresh that was broken off is repeated under the same number and
overwrites what it left.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulesieve import schema
from rulesieve.operators.findings import scan
from rulesieve.operators.matching import match

#: Folders that evidence is laid out in; also the most that a plan names one by one.
PARTS = 256

#: So many artifacts are broadcast, and only their evidence is matched. Of more, the evidence of
#: their folders is matched and their matches are kept. Evidence is shuffled in neither case.
FEW = 100_000

_SNAPSHOT = "artifact_id string, fingerprint string, since long"
_FOUND = "artifact_id string, rule_id string, evidence string"


def part_of(artifact_id: Column, parts: int = PARTS) -> Column:
    """The folder that an artifact's evidence lies in."""
    return F.pmod(F.xxhash64(artifact_id), F.lit(parts)).cast("int")


def write_evidence(evidence: DataFrame, path: str, parts: int = PARTS) -> None:
    """Evidence laid out by ``part``, so that a refresh reads only folders with something to do.

    Rebalanced first: a folder gets a few full files, and one that holds a hot
    artifact is split.
    """
    placed = evidence.select(*schema.EVIDENCE.names, part_of(F.col("artifact_id"), parts).alias("part"))
    balanced = evidence.sparkSession.sql("SELECT /*+ REBALANCE(part) */ * FROM {placed}", placed=placed)
    balanced.write.partitionBy("part").parquet(path)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence as :func:`write_evidence` laid it out, with its column ``part``."""
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in schema.EVIDENCE]
    return spark.read.schema(", ".join([*columns, "part int"])).parquet(path)


class FindingStore:
    """Findings of the artifacts of an inventory, in the folder ``path``.

    Artifacts without an id, and evidence of artifacts that the inventory does
    not list, take no part. An id that is listed repeatedly is one artifact,
    whose fingerprint covers all of its rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> "FindingStore":
        """An empty store, at version 0."""
        store = cls(spark, path)
        spark.createDataFrame([], _FOUND).write.parquet(f"{store.path}/findings/version=0")
        store._commit(0, spark.createDataFrame([], _SNAPSHOT), spark.createDataFrame([], schema.RULE))
        return store

    def version(self) -> int:
        """The last version that was finished."""
        done = self.spark.read.schema("done boolean, version long").parquet(f"{self.path}/done")
        return done.agg(F.max("version")).first()[0]

    def snapshot(self, version: int | None = None) -> DataFrame:
        """``(artifact_id, fingerprint, since)`` of the artifacts of a version, the last one by default."""
        version = self.version() if version is None else version
        return self.spark.read.schema(_SNAPSHOT).parquet(f"{self.path}/snapshot/version={version}")

    def rules(self, version: int | None = None) -> DataFrame:
        """The catalogue of a version."""
        version = self.version() if version is None else version
        return self.spark.read.schema(schema.RULE).parquet(f"{self.path}/rules/version={version}")

    def findings(self, version: int | None = None) -> DataFrame:
        """The findings that stand in a version, with the attributes that its rules have there."""
        version = self.version() if version is None else version
        written = self.spark.read.schema(f"{_FOUND}, version long").parquet(f"{self.path}/findings")
        listed = self.snapshot(version).select("artifact_id", F.col("since").alias("version"))
        rules = self.rules(version).withColumnsRenamed({"id": "rule_id", "name": "rule_name"})
        attributes = rules.select("rule_id", "rule_name", "category", "severity", "behavior", "guidance_key")
        standing = written.where(F.col("version") <= version).join(listed, ["artifact_id", "version"])
        return standing.join(attributes, "rule_id").select(*schema.FINDING.names)

    def refresh(
        self,
        artifacts: DataFrame,
        evidence: DataFrame,
        rules: DataFrame,
        cap: int | None = schema.EVIDENCE_CAP,
        parts: int = PARTS,
    ) -> int:
        """Bring the store up to date and return the new version.

        ``artifacts`` has ``artifact_id`` and ``fingerprint``, all that are present
        now; ``evidence`` is theirs. Where it has a column ``part`` (of ``parts``
        folders, see :func:`write_evidence`), folders without artifacts to be
        scanned are not read. ``cap`` bounds the matches shown per finding; keep it
        the same for a store.
        """
        last = self.version()
        version, before, known = last + 1, self.snapshot(last), self.rules(last)
        now = _inventory(artifacts)
        same = now.join(before, ["artifact_id", "fingerprint"])
        changed = now.join(before, ["artifact_id", "fingerprint"], "left_anti").select("artifact_id", "fingerprint")
        redefined = _redefined(known, rules)
        if last and not redefined.isEmpty():
            held = match(evidence, redefined, contains=schema.KINDS, regex=schema.KINDS).select("artifact_id").distinct()
            again = same.join(held, "artifact_id", "left_semi").select("artifact_id", "fingerprint")
            same, changed = same.join(held, "artifact_id", "left_anti"), changed.unionByName(again)
        current = same.select("artifact_id", "fingerprint", "since").unionByName(
            changed.withColumn("since", F.lit(version).cast("long"))
        )
        target = f"{self.path}/snapshot/version={version}"
        current.write.mode("overwrite").parquet(target)
        todo = self.snapshot(version).where(F.col("since") == version).select("artifact_id")
        if todo.limit(FEW + 1).count() <= FEW:
            found = scan(evidence_of(evidence, F.broadcast(todo), parts), rules, cap)
        else:
            found = scan(_in_folders(evidence, todo, parts), rules, cap, artifacts=todo)
        found.select("artifact_id", "rule_id", "evidence").write.mode("overwrite").parquet(
            f"{self.path}/findings/version={version}"
        )
        self._commit(version, None, rules)
        return version

    def _commit(self, version: int, snapshot: DataFrame | None, rules: DataFrame) -> None:
        if snapshot is not None:
            snapshot.write.mode("overwrite").parquet(f"{self.path}/snapshot/version={version}")
        rules.select(*schema.RULE.names).write.mode("overwrite").parquet(f"{self.path}/rules/version={version}")
        done = self.spark.createDataFrame([(True,)], "done boolean")
        done.write.mode("overwrite").parquet(f"{self.path}/done/version={version}")


def evidence_of(evidence: DataFrame, artifacts: DataFrame, parts: int = PARTS) -> DataFrame:
    """Evidence of ``artifacts``; of a table laid out by ``part``, only their folders are read."""
    return _in_folders(evidence, artifacts, parts).join(artifacts, "artifact_id", "left_semi").select(*schema.EVIDENCE.names)


def _in_folders(evidence: DataFrame, artifacts: DataFrame, parts: int) -> DataFrame:
    """Evidence of the folders of ``artifacts``, where it is laid out by ``part``."""
    if "part" not in evidence.columns:
        return evidence
    touched = artifacts.select(part_of(F.col("artifact_id"), parts).alias("part")).distinct().collect()
    return evidence.where(F.col("part").isin(*[r["part"] for r in touched]))


def _inventory(artifacts: DataFrame) -> DataFrame:
    """One ``(artifact_id, fingerprint)`` per id; combined before the shuffle, so an id may repeat at will."""
    rows = artifacts.select(F.col("artifact_id").cast("string"), F.col("fingerprint").cast("string")).where(
        "artifact_id is not null"
    )
    combined = F.concat_ws(
        "/", F.count(F.lit(1)), F.bit_xor(F.xxhash64("fingerprint")), F.min("fingerprint"), F.max("fingerprint")
    )
    return rows.groupBy("artifact_id").agg(combined.alias("fingerprint"))


def _redefined(before: DataFrame, now: DataFrame) -> DataFrame:
    """Old and new definitions of the rules whose patterns, kind or dialect are not the same in both."""
    definition = ["id", "evidence_location", "patterns", "is_regex"]
    sides = [
        side.select(*schema.RULE.names).withColumn("_definition", F.to_json(F.struct(*definition))) for side in (before, now)
    ]
    gone = sides[0].join(sides[1], "_definition", "left_anti")
    come = sides[1].join(sides[0], "_definition", "left_anti")
    return gone.unionByName(come).drop("_definition")
