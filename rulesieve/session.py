"""Session settings and the shared scratch folder."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans here rely on; all are ordinary Spark options.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# How many partitions a scan is dealt into whose files cannot be split: a file
# with one row group is read by one task. Unset (the default) nothing is dealt.
SCAN_PARTITIONS = "spark.rulesieve.scanPartitions"


def local_session(cores: int = 8, memory: str = "8g", app: str = "rulesieve") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config(SCAN_PARTITIONS, str(cores))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


class NoSharedFolder(RuntimeError):
    """``spark.checkpoint.dir`` names no folder."""


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Without that setting there is no folder that all executors see, so this is
    an error; only where driver and executors are one process (``local``) a
    temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hash-partitioned as :data:`SCAN_PARTITIONS` asks, or as it is."""
    partitions = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(partitions), *keys) if partitions else df
