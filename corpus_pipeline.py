"""A corpus from raw documents to packed sequences, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadframe.llm import exact_dedup, mixing, near, packing, toxicity
from quadframe.llm.work import Work


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from labels of these documents, scores below 0.5.

    Null and empty texts match nothing and stay; long texts are read whole and rated by length; repeated rows are rated
    alike and all stay or go. Rows with a null doc_id have no label and are only rated. Where nothing is
    learned, every row scores the share of toxic labels, smoothed. Columns may have any names; an empty table gives an empty result.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id.

    Null counts as an empty text; runs of ASCII white space count as one space, in long texts too. A null doc_id comes last;
    of rows equal in text and doc_id one stays. Columns may have any names; an empty table gives an empty result.
    """
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id.

    Texts without words, null ones too, are copies of each other only; texts of fewer than five words are one shingle; long
    texts are shingled whole. A null doc_id comes last, ties go by the text; rows equal in both stay together. Columns may
    have any names; an empty table gives an empty result.
    """
    return near.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is one source, the last; a null or empty text has size 0, and is taken as often as its place in the seeded
    order says. Rows of one doc_id and size go by their other columns, so reruns agree. No document is taken more than
    twice, however long. Columns may have any names; an empty table gives an empty result.
    """
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096.

    A null or empty text is one end token; long texts become several pieces; repeated rows are separate documents, null
    doc_ids are carried along. Only doc_id and text are read; an empty table gives an empty result.
    """
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages learn, hash and tokenize; SQL can't express them. tests/llm/test_pipeline.py checks them instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Work(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
