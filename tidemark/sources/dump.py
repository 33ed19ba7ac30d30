"""Logical dumps: the events and the states of a collection as two Parquet tables in a folder, and their way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def dump(events: DataFrame, states: DataFrame, path: str) -> str:
    """Writes both tables; a folder that exists is an error, so that no dump is half an older one."""
    events.write.option("compression", "zstd").parquet(f"{path}/events")
    states.write.option("compression", "zstd").parquet(f"{path}/states")
    return path


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The events and the states of a dump."""
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/states")


def append_new(events: DataFrame, known: DataFrame, path: str, *, id_col: str = "event_id", part_col: str = "property") -> None:
    """Adds to the table in path the rows of events whose id is not in known, each (id, part) once: ids are content
    addresses, so adding a dump twice changes nothing."""
    seen = known.select(id_col).distinct()
    events.join(seen, id_col, "left_anti").select(*events.columns).dropDuplicates([id_col, part_col]).write.mode("append").parquet(path)
