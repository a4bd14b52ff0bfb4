from pyspark.sql import functions as F

from quadframe.llm import exact_dedup

ROWS = [(5, "a  b"), (3, "a b"), (3, "a\tb"), (None, "a b"), (7, None), (8, ""), (9, " "), (2, "c"), (2, "c"), (1, "é")]


def groups(spark, **options):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, keep_id string, at_row int")
    return [tuple(r)[:4] for r in exact_dedup.exact_groups(docs, **options).collect()]


WANT = sorted(
    [(5, 3, 4, False), (3, 3, 4, True), (3, 3, 4, False), (None, 3, 4, False), (7, 7, 2, True), (8, 7, 2, False), (9, 9, 1, True), (2, 2, 2, True), (2, 2, 2, False), (1, 1, 1, True)],
    key=str,
)


def test_groups(spark):
    assert sorted(groups(spark), key=str) == WANT


def test_colliding_digests_are_told_apart_by_text(spark):
    assert sorted(groups(spark, digest=lambda text: F.lit("same")), key=str) == WANT


def test_empty_and_pipeline_form(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []
    kept = exact_dedup.drop_exact_copies(docs.withColumn("digest", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "digest"] and kept.count() == 5
