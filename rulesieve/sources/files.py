"""File listings and finding reports on storage."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulesieve import schema

PACKAGE_EXTENSIONS = ("apk", "apks")


def package_inventory(
    spark: SparkSession, path: str, extensions: Sequence[str] = PACKAGE_EXTENSIONS
) -> DataFrame:
    """Candidate files below ``path``: ``(path, length, ext)``, any letter case.

    The content column is never selected, so no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("ext", ext).where(F.col("ext").isin(*[e.lower() for e in extensions]))


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write findings as one folder per category (``parquet`` or ``json``).

    Rebalanced first: each category gets a few full files instead of one small
    file from every task, and a category most findings fall in is split.
    """
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported report format: {fmt}")
    balanced = findings.sparkSession.sql("SELECT /*+ REBALANCE(category) */ * FROM {found}", found=findings)
    balanced.write.mode(mode).partitionBy("category").format(fmt).save(path)


def read_findings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read back what :func:`write_findings` wrote, in the findings schema."""
    names = schema.FINDING.names
    return spark.read.schema(schema.FINDING).format(fmt).load(path).select(*names)
