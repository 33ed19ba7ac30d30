"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, remove, written


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _joined(rows: DataFrame, ends: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with the m of their u in ends (u, m, n rows); total: of all rows. Hot nodes, HEAVY at most, are joined
    by broadcast; the others by a shuffle."""
    hot = F.col("n") > max(total / HEAVY, 16)
    few = F.broadcast(ends.where(hot).select("u", "m"))
    usual = rows.join(F.broadcast(ends.where(hot).select("u")), "u", "left_anti").join(ends.where(~hot).select("u", "m"), "u")
    return usual.union(rows.join(few, "u"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (long, nulls and loops ignored). Returns node, component (the smallest node reachable) of every
    node that has an edge. Nothing but three counters a round reaches the driver; each round is a written table, after
    which the one before is removed. Aggregates combine before they shuffle, so a hub costs them a row for each task;
    in joins, nodes with over a HEAVY-th of all edges are joined where their edges are. An empty table gives an empty one."""
    spark = edges.sparkSession
    flat = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges, path = written(flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = _mark(edges)
        if now == before or not now[0]:
            break
        before = now
        # large star: each node's greater neighbours go to its smallest neighbour or itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large, large_path = written(_joined(both.where("v > u"), least, 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        # small star: each node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _joined(large, low, 2 * now[0])
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, (edges, path) = path, written(moved.distinct(), "edges")
        remove(spark, old)
        remove(spark, large_path)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
