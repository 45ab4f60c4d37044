"""The bounds of the sample that classifiers are fitted on."""

from pyspark.sql import functions as F

from rulesieve.llm.common import fold
from rulesieve.llm.training import HELD_OUT, labelled_sample


def taught(spark, n):
    """The first ``n`` ids outside the held-out fold."""
    ids = spark.range(10 * n).where(fold(F.col("id"), 4) != HELD_OUT).orderBy("id").limit(n)
    return [r.id for r in ids.collect()]


def test_repeated_id_is_one_row(spark):
    hot, *rest = taught(spark, 4)
    docs = spark.range(10_000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"))
    docs = docs.union(spark.createDataFrame([(i, f"own {i}") for i in rest] + [(None, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1) for i in [hot, hot, *rest]] + [(None, 1), (rest[0], None)], "doc_id long, toxic int")
    for parts in (1, 5):
        found = labelled_sample(docs.repartition(parts), labels, "toxic", rows=100).collect()
        assert sorted(r.id for r in found) == sorted([hot, *rest])
        again = {r.id: r.text for r in found}
        assert parts == 1 or again == before
        before = again


def test_both_labels_of_an_id_stay(spark):
    (one,) = taught(spark, 1)
    docs = spark.createDataFrame([(one, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(one, 0), (one, 1), (one, 1)], "doc_id long, toxic int")
    assert sorted(r.y for r in labelled_sample(docs, labels, "toxic", rows=9).collect()) == [0, 1]


def test_bounds(spark):
    ids = taught(spark, 40)
    docs = spark.createDataFrame([(i, "x" * 10) for i in ids] + [(ids[0], "y" * 99)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")

    def chosen(**bounds):
        return {r.id for r in labelled_sample(docs, labels, "toxic", **bounds).collect()}

    assert chosen(rows=100) == set(ids)
    assert len(chosen(rows=7)) == 7
    few = chosen(rows=100, max_chars=10, total_chars=55)
    assert len(few) == 5 and few <= chosen(rows=7, max_chars=10)
    assert labelled_sample(docs.limit(0), labels, "toxic", rows=9).count() == 0
