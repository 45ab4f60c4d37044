"""Bounded samples of labelled documents to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rulesieve.llm.common import fold, id_text

#: Rows whose crc32(id) modulo ``FOLDS`` is ``HELD_OUT`` teach nothing.
FOLDS, HELD_OUT = 4, 2


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int,
    max_chars: int = 200_000,
    total_chars: int = 200_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """At most ``rows`` of the labelled documents outside the held-out fold: ``(id, text, y)``.

    This bound, ``max_chars`` (longer documents are not fitted on) and
    ``total_chars`` keep the fit to one task's memory; they are the only rows
    left out, and scoring leaves out none. The rows of the smallest hash of the
    id are taken, so the choice is even and repeatable. An id that is there with
    several texts teaches one of them (that of the smallest hash), an id with
    both labels teaches both, a label that is repeated teaches once. Rows with a
    null id, text or label are left out.
    """
    y = F.col(label).cast("int")
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), y.alias("y"))
        .where((fold(F.col("id"), FOLDS) != HELD_OUT) & F.col("y").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(rows)
    )
    texts = id_text(docs, id_col, text_col).where(F.length("text") <= max_chars)
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    sample = texts.join(chosen, "id").groupBy("id", "y").agg(first)
    so_far = F.sum(F.length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id", "y"))
    return sample.withColumn("so_far", so_far).where(F.col("so_far") <= total_chars).select("id", "text", "y")


def held_out(id_column) -> object:
    """Whether a row is in the held-out fold (false for a null id)."""
    return F.coalesce(fold(id_column, FOLDS) == HELD_OUT, F.lit(False))
