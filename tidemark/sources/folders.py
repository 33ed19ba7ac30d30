"""Folders on whatever file system Spark reaches: what is there, numbered versions, removal."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers N of the folders version=N that were written to the end, ascending."""
    system, place = _place(spark, path)
    if not system.exists(place):
        return []
    found = [(re.fullmatch(r"version=(\d+)", f.getPath().getName()), f.getPath()) for f in system.listStatus(place)]
    return sorted(int(m[1]) for m, at in found if m and system.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    system, place = _place(spark, path)
    system.delete(place, True)
