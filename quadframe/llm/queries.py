"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, exact_dedup, langid, mixing, packing, pii, simhash, site_tree, suffix_dedup, toxicity, url_filter, whiten
from .work import crc32_of_id

#: Fixed values of the url contract: verdict, host, start of the path.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc32_of_id(F.col("doc_id")) % 4 == 2
    found = langid.predict(docs, langid.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc32_of_id(F.col("doc_id")) % 5 == 0
    found = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    outcomes = url_filter.page_outcomes(pages, _table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4, total=None)
    return found.select("doc_id", simhash.spell(F.col("fp")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind, *_ in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.spell(F.col("base")), 256).alias("base_sha256"), pii.spell(F.col("spans")).alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("removed_at")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(_table(spark, sf_dir, "pages"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"))


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened_components(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)


QUERIES = {f.__name__: f for f in (op1_langid, op2_toxicity, op3_url_filter, op4_packing, op5_ann, op6_exact_dedup, op7_simhash, op8_pii, op9_mixing, op10_suffix_dedup, op11_html, op12_align, op13_whiten)}

_BLANK = r"\x20\x09-\x0D"

ORACLE_SQL = {
    "op6_exact_dedup": rf"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[{_BLANK}]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op9_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+')) AS BIGINT) AS size,
                          sha256('9:' || doc_id) AS key FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                     2.0::DOUBLE * source_size AS cap FROM s),
        f AS (SELECT *, cap / weight AS fill, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM w),
        l AS (SELECT *, wanted - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     >= fill * sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM f),
        t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * ((wanted - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
                     / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM l),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
        o AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
                     sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN middle < part THEN 1 ELSE 0 END) AS taken FROM o""",
}
