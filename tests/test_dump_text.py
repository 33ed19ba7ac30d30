from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import dump
from tidemark.sources.context import EventTable, Transaction


def test_dump_round_trip_is_idempotent(spark, tmp_path):
    first = EventTable(spark, str(tmp_path / "first"))
    change = Transaction(first)
    entity = change.create(title="a", year=3)
    change.commit()
    change.edit(entity, title="b")
    change.commit()
    states = spark.createDataFrame([(entity, "b", 3)], "entity_id string, title string, year int")
    events, again = dump.load(spark, dump.dump(first.read(), states, str(tmp_path / "dump")))
    assert again.collect() == states.collect()
    second = EventTable(spark, str(tmp_path / "second"))
    for _ in range(2):
        dump.append_new(events, second.read(), second.path)
    assert sorted(map(repr, second.read().collect())) == sorted(map(repr, first.read().collect()))
    assert spark.read.parquet(second.path).count() == 3
    assert second.heads(entity) == first.heads(entity)


def test_text_edits(spark):
    rows = [("héllo", 1, 2), ("", 0, 0), ("abc", 9, 1), ("abc", 2, 9), (None, 0, 1), ("abc", None, 1), ("日本語", 0, 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, at int, n int").orderBy("k")
    got = df.select(text.insert(F.col("t"), F.col("at"), "X"), text.delete(F.col("t"), F.col("at"), F.col("n")), text.overwrite(F.col("t"), F.col("at"), F.col("n"), "Y")).collect()
    want = [(None,) * 3 if t is None or at is None else (t[:at] + "X" + t[at:], t[:at] + t[at + n :], t[:at] + "Y" + t[at + n :]) for t, at, n in rows]
    assert [tuple(r) for r in got] == want
