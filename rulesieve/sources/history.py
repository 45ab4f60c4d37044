"""Scan history: append-only on storage, newest version resolved on read."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rulesieve import schema
from rulesieve.functions.text import minute_text

_STORED = schema._struct(
    *[(f.name, f.dataType) for f in schema.HISTORY], ("batch", schema._L), ("seq", schema._L)
)


def upsert_history(old: DataFrame, new: DataFrame, key: str = "created_at", seq: str = "seq") -> DataFrame:
    """``old`` plus ``new``; of rows with the same key the last inserted stays.

    Both sides carry ``seq``, the insertion order within the side. The window
    keeps one row per key and is pruned before the shuffle, so a key that a
    third of all rows share sends one row per map task.
    """
    rows = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return _last_per_key(rows, key, "_batch", seq).drop("_batch")


def append_history(new: DataFrame, path: str, batch: int) -> None:
    """Add one batch of history rows; nothing stored is rewritten.

    ``seq`` is the order of insertion within the batch and is stored with it.
    """
    rows = new.select(*schema.HISTORY.names, F.lit(batch).cast("long").alias("batch"), F.col("seq").cast("long"))
    rows.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored history with the last inserted row of each ``created_at``."""
    rows = spark.read.schema(_STORED).parquet(path)
    return _last_per_key(rows, "created_at", "batch", "seq").drop("batch", "seq")


def clear_history(spark: SparkSession, path: str) -> None:
    """Replace the stored history by an empty one of the same schema."""
    spark.createDataFrame([], _STORED).write.mode("overwrite").parquet(path)


def _last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def history(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Newest first, with a minute timestamp and a 200-character preview."""
    return rows.select(
        "label",
        "path",
        "created_at",
        minute_text(F.col("created_at"), zone).alias("created_minute"),
        F.left("report", F.lit(schema.PREVIEW_CHARS)).alias("preview"),
    ).orderBy(F.col("created_at").desc(), "path")
