"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    ours = QUERIES[name](spark, DATA)
    theirs = sql.execute(ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(c[0] for c in theirs.description)
    spots = [[c[0] for c in theirs.description].index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(repr(tuple(r[k] for k in spots)) for r in theirs.fetchall())


def test_subscription_of_parts_joined_apart(spark, sql):
    """Sort-merge joins deal all parts of the log by entity, and small partitions are joined into larger ones."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = sorted(map(tuple, QUERIES["live_subscription"](spark, DATA).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted(sql.execute(ORACLES["live_subscription"]).fetchall())
