"""Exact deduplication as a stateful stream.

Every row becomes (digest of the normalised text, stable identifier, content locator). A Structured Streaming query
folds those rows into keyed state that is kept on disk (RocksDB) and never expires: per digest the first identifier with
its locator, and the number of rows. A digest seen more than once is a hit; the texts of hits are fetched by locator and
compared byte by byte with the text that stays. Rows that a digest brings together wrongly are grouped again by text.

The locator is (file, row in file) of the input; input that isn't in files is written to the shared folder first. Null
texts count as empty. Of rows with equal text and identifier the one first by locator stays; a null identifier comes
after all others. Repeated rows are separate documents. An empty table gives an empty result. Very long texts are hashed
and compared whole. Columns of the input may have any names. A call is one run of the stream: its state lives in the
checkpoint of that call.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work, collapse_blanks

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # State lives in the checkpoint; an executor holds a partition's files only while it works on it.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, work: Work) -> DataFrame:
    """docs with at_file and at_row."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    except AnalysisException:
        return work.save(docs, "input").select("*", F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))


def fold(schema, work: Work, path: str) -> DataFrame:
    """Run the stream over the Parquet files at path: (digest, keeper, group_size), keeper a struct in order of preference."""
    spark = work.spark
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    keeper = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at_file", "at_row")).alias("keeper")
    state = spark.readStream.schema(schema).parquet(path).groupBy("digest").agg(keeper, F.count(F.lit(1)).alias("group_size"))
    try:
        stream = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(work.at(f"state/batch={n}")))
            .option("checkpointLocation", work.at("stream"))
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    try:
        written = spark.read.schema(state.schema).parquet(work.at("state"))
    except AnalysisException:  # no batch ran: no rows
        return spark.createDataFrame([], state.schema)
    # A digest appears once for each batch that changed it; its least keeper and its largest count are the last ones.
    return written.groupBy("digest").agg(F.min("keeper").alias("keeper"), F.max("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, digest=sha256_of, work: Work | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) and at_file, at_row, for each row of docs.

    digest is the function whose values are the keys of the state; group membership doesn't rest on it alone.
    """
    work = work or Work(docs.sparkSession, "exact")
    source = located(docs.select("doc_id", "text"), work)
    norm = collapse_blanks(F.col("text"))
    index = source.select("doc_id", norm.alias("norm"), "at_file", "at_row").select("doc_id", "at_file", "at_row", digest(F.col("norm")).alias("digest"), sha256_of(F.col("norm")).alias("text_sha256"))
    index = work.save(index, "index")
    groups = fold(index.schema, work, work.at("index"))
    groups = work.save(groups, "groups")
    judged = index.join(groups, "digest")

    at = ["at_file", "at_row"]
    is_keeper = (F.col("keeper.at_file") == F.col("at_file")) & (F.col("keeper.at_row") == F.col("at_row"))
    hits = judged.filter("group_size > 1").select("digest", is_keeper.alias("kept"), *at)
    texts = work.save(source.select("doc_id", "text", *at).join(hits, at).select("doc_id", "digest", "kept", *at, norm.alias("norm")), "hits")
    stays = texts.filter("kept").select("digest", F.col("norm").alias("stays"))
    unequal = work.save(texts.join(stays, "digest").filter("norm <> stays").select("doc_id", "digest", *at, "norm"), "unequal")
    out = judged.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", is_keeper.alias("kept"), "text_sha256", "digest", *at)
    if not unequal.isEmpty():
        own = unequal.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *at)).alias("own"), F.count(F.lit(1)).alias("own_size"))
        moved = unequal.join(own, ["digest", "norm"]).select(*at, "own", "own_size")
        lost = unequal.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        own_kept = (F.col("own.at_file") == F.col("at_file")) & (F.col("own.at_row") == F.col("at_row"))
        other = F.col("own").isNotNull()
        out = out.join(moved, at, "left").join(lost, "digest", "left").select(
            "doc_id",
            F.when(other, F.col("own.doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(other, F.col("own_size")).otherwise(F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
            F.when(other, own_kept).otherwise(F.col("kept")).alias("kept"),
            "text_sha256", "digest", *at,
        )
    work.drop("hits")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *at)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    work, names = Work(docs.sparkSession, "kept"), docs.columns
    try:
        if "_metadata" in names:
            raise AnalysisException("a column of the input hides the locator")
        docs.select("_metadata.row_index")
        where = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    except AnalysisException:
        docs = work.save(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]), "docs")
        where = docs.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
        docs = docs.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"))
    groups_work = Work(docs.sparkSession, "exact")
    kept = work.save(exact_groups(docs, work=groups_work).filter("kept").select("at_file", "at_row"), "kept")
    groups_work.clear()
    return where.join(kept, ["at_file", "at_row"], "left_semi").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
