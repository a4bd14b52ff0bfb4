"""A hashed dataset as Parquet tables, laid out for look-ups.

leaves: in order of their hashes, a folder for each pair of leading digits; marks: first and last place of each bucket of
leading digits; levels: the hash tree, a folder for each level; root: one row. A look-up of a few hashes reads the
folders of their digits and the marks only, membership paths read the subtrees above the leaves that are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import commit

#: Leading digits that name a folder of leaves.
FOLDER = 2


def save(quads: DataFrame, path: str, prefixes: bool = False) -> None:
    """Write the tables of quads, or of their distinct (s, p, g), under path."""
    spark = quads.sparkSession
    rows = commit.prefix_leaves(quads) if prefixes else commit.leaves(quads)
    # Ranges of hashes, so that a task writes few folders, and large folders have several files.
    rows.withColumn("digits", F.substring("h", 1, FOLDER)).repartitionByRange("h").sortWithinPartitions("h").write.partitionBy("digits").parquet(f"{path}/leaves")
    leaf = _leaves(spark, path)
    commit.marks_of(leaf).write.parquet(f"{path}/marks")
    commit.levels(leaf).repartition("level").write.partitionBy("level").parquet(f"{path}/levels")
    commit.root(spark.read.parquet(f"{path}/levels")).write.parquet(f"{path}/root")


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    """With digits as text, whatever they look like."""
    kinds = [T.StructField(f.name, T.StringType() if f.name == "digits" else f.dataType) for f in spark.read.parquet(f"{path}/leaves").schema]
    return spark.read.schema(T.StructType(kinds)).parquet(f"{path}/leaves")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Leaves and levels."""
    return _leaves(spark, path).drop("digits"), spark.read.parquet(f"{path}/levels")


def root(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/root").first()[0]


def absent(probes: DataFrame, path: str) -> DataFrame:
    """Brackets of many probes, which have a hash h, as commit.absent() gives them."""
    spark = probes.sparkSession
    return commit.absent(probes, _leaves(spark, path).drop("digits"), spark.read.parquet(f"{path}/marks"))


def look_up(spark: SparkSession, path: str, hashes: Sequence[str]) -> DataFrame:
    """Brackets of a few hashes, known when the query is built: other folders of leaves are not read."""
    probes = spark.createDataFrame([(h,) for h in dict.fromkeys(hashes)], "h string")
    near = _leaves(spark, path).filter(F.col("digits").isin(sorted({h[:FOLDER] for h in hashes})))
    return commit.absent(probes, near.drop("digits"), spark.read.parquet(f"{path}/marks"))


def members(spark: SparkSession, path: str, hashes: Sequence[str]) -> DataFrame:
    """(idx, h, path, ok) of those hashes that are leaves, checked against the stored root."""
    near = _leaves(spark, path).filter(F.col("digits").isin(sorted({h[:FOLDER] for h in hashes})) & F.col("h").isin(list(hashes)))
    return commit.check_inclusion(commit.paths(near.select("idx", "h"), spark.read.parquet(f"{path}/levels")), root(spark, path))
