"""Shared plumbing of the corpus operators: the shared folder, written tables, and word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table that lower-cases A-Z and leaves every other byte.
LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())

#: The word rule `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on lower-cased UTF-8: every byte over 0x7F belongs to a word.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The same rule on str, for character offsets.
WORD_CHARS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


SPARKS_BYTES, BATCH_BYTES = "67108864b", "4194304b"
#: A key with more than this part of all rows is not left to one task.
HEAVY = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only where that is unset
    (a local test session) a temporary folder of this machine is set and used."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext.getCheckpointDir()
        if not known:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            known = spark.sparkContext.getCheckpointDir()
        found = known
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives a lost executor. Its path too."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return written(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Removes all tables that this application's operators have written beside their results."""
    remove(spark, f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")


def join_by_key(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """The inner join of left with right, which has one row for each key and in the column size how many rows of left
    have it. Keys with over a HEAVY-th of all of left's rows, HEAVY of them at most, are joined where left's rows are;
    so no task gets all rows of a key."""
    total = right.agg(F.sum(size)).first()[0] or 0
    hot = (F.col(size) > total / HEAVY) & (F.col(size) > 1)
    few = F.broadcast(right.where(hot))
    usual = left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(right.where(~hot), key)
    return usual.unionByName(left.join(few, key))


def ready(spark: SparkSession) -> None:
    """Lets workers that share this machine's folders import the package (a cluster gets it with --py-files), and, where
    the session still has Spark's own bound of 64 MB to an Arrow batch, bounds it to BATCH_BYTES: whole texts in
    batches of 64 MB would fill an executor. No result depends on it, and a bound that a user has set stays."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == SPARKS_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, so that few whole texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
