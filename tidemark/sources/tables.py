"""Parquet collections, point and batch reads, reference follows, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses the session's checkpoint folder; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))


def importable(spark: SparkSession) -> None:
    """Lets Python workers that share this machine's folders import the package (a cluster gets it with --py-files)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoints(spark)
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/tidemark/{tag}-{uuid.uuid4().hex[:12]}"


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(df[key] == value)


def get_batch(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in ids (a table with the same column); unknown ids are skipped."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def follow(df: DataFrame, ref: str, target: DataFrame, key: str) -> DataFrame:
    return df.join(target, df[ref] == target[key], "left")
