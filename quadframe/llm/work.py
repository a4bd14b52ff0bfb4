"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of all the text contracts, as a character class body.
BLANK = r"\x20\x09-\x0D"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests), a temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="spark-quadframe-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


class Work:
    """Names tables under one fresh folder: a written table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return it as read back."""
        df.write.parquet(self.at(name))
        return self.read(df.schema, name)

    def read(self, schema, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.at(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


    def clear(self, *keep: str) -> None:
        """Delete all tables but those to keep."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        for at in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if at.getPath().getName() not in keep:
                self.drop(at.getPath().getName())


def collapse_blanks(text):
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK}]+", " ")


def word_count(text):
    """Number of maximal runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def crc32_of_id(col):
    """CRC-32 of an id written as text, as in the contracts' folds."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
