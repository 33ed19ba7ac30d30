"""Live queries: the changes between two result sets, and streams that keep one current.

A LiveQuery follows the states of a collection as a stream of Parquet files. Each version of the states is one commit
and becomes one change set, from the result before it and the result after it. Both are read from the versioned
states, so a batch that runs again gives the same change sets, and nothing has to be kept between batches. Without a
limit only the entities that the version touched are evaluated; with one, both results are (as many rows as the limit
takes). `follow` is for a state that is not versioned: the result before a batch is written before the batch is applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import eventlog
from tidemark.operators.compile import select
from tidemark.plans import selection as S
from tidemark.sources import folders


def initial(df: DataFrame, what, key: str) -> DataFrame:
    return select(df, what, key=key).select(F.lit("initial").alias("change_type"), "*")


def changes(before: DataFrame, after: DataFrame, key: str, with_rows: bool = False) -> DataFrame:
    """change_type (add, remove, update) and key of every row whose membership or contents differ; with_rows: and the
    row as it is now, or for a removal as it was."""
    digest = lambda df: F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema))
    one = lambda df, name: df.select(F.col(f"`{key}`").alias(key), F.struct(digest(df).alias("hash"), F.struct("*").alias("row")).alias(name))
    joined = one(before, "was").join(one(after, "now"), key, "full_outer")
    kind = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("was.hash") != F.col("now.hash"), "update")
    found = joined.select(kind.alias("change_type"), key, F.coalesce("now.row", "was.row").alias("row") if with_rows else F.lit(None).alias("row")).where("change_type IS NOT NULL")
    rest = [f"`{c}`" for c in after.columns if c != key]
    return found.select("change_type", key, *(F.col(f"row.{c}") for c in rest)) if with_rows else found.drop("row")


def live_changes(before: DataFrame, after: DataFrame, what, key: str, then=None) -> DataFrame:
    """Changes of a selection between two states; a limited one is filled up again, as both sides are exact.
    then: another selection for the later state."""
    return changes(select(before, what, key=key), select(after, then or what, key=key), key)


def touched_changes(before: DataFrame, after: DataFrame, touched: DataFrame, what, key: str, with_rows: bool = False) -> DataFrame:
    """The same where only the keys in touched may differ: without a limit, no others are evaluated."""
    chosen = S.parse(what) if isinstance(what, str) else what
    if chosen.limit is None:
        keys = touched.select(key).distinct()
        before, after = before.join(keys, key, "left_semi").select(before.columns), after.join(keys, key, "left_semi").select(after.columns)
    return changes(select(before, chosen, key=key), select(after, chosen, key=key), key, with_rows)


def entity_changes(before: DataFrame, after: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Changes of given entities, whatever they match."""
    return touched_changes(before, after, ids, S.Selection(), key)


def reset(result: DataFrame, key: str) -> DataFrame:
    """The change set that empties a result."""
    return result.select(F.lit("remove").alias("change_type"), key)


def subscription_deltas(states: DataFrame, what, known: DataFrame, events: DataFrame, parents: DataFrame, *, key: str, hidden: DataFrame | None = None) -> DataFrame:
    """What a peer gets that subscribes to a selection (narrowed by its policy before) and holds the clocks of known
    (entity, head): entity, kind, place, event as from eventlog.bridges, for the entities that match and for those
    that it knows; current ones are left out."""
    matches = select(states, what, key=key)
    told = eventlog.expand_known(matches, known.select(F.col("entity").alias(key)), states, key).select(F.col(key).alias("entity"))
    keep = lambda df: df.join(told, "entity", "left_semi")
    return eventlog.bridges(keep(known), keep(events), keep(parents), hidden=hidden).where("kind <> 'current'")


def follow(stream: DataFrame, state: Callable[[], DataFrame], upsert: Callable[[DataFrame], None], what, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that applies each micro-batch to the state and gives one change set for it. The result before a
    batch is written under the checkpoint first: upsert may overwrite the state, and a batch that runs again after
    upsert is compared with what was there before its first run. upsert must bear being repeated."""

    def step(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, f"{checkpoint}/results"
        path = f"{kept}/version={number}"
        if number not in folders.versions(spark, kept):
            select(state(), what, key=key).write.mode("overwrite").parquet(path)
        upsert(batch)
        now = select(state(), what, key=key)
        sink(changes(spark.read.schema(now.schema).parquet(path), now, key), number)
        for old in folders.versions(spark, kept):
            if old < number:
                folders.remove(spark, f"{kept}/version={old}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


class LiveQuery:
    """A selection over a collection, kept current. sink(change set, version) gets, for the state at the start, rows
    of change_type initial, and then for every version that has changes one set of change_type add, update or remove
    with the columns of the state; a set may come again with the same version after a failure, with the same rows."""

    def __init__(self, collection, what: str | S.Selection, sink: Callable[[DataFrame, int], None], checkpoint: str, *, ids: list[str] | None = None):
        self.collection, self.sink, self.checkpoint, self.ids = collection, sink, checkpoint, ids
        self.what = S.parse(what) if isinstance(what, str) else what
        self.since = collection.version()
        self.query = None

    def result(self, version: int | None = None) -> DataFrame:
        return select(self._own(self.collection.states(version)), self.what, name=self.collection.model.name, key="id")

    def _own(self, states: DataFrame) -> DataFrame:
        return states if self.ids is None else states.where(F.col("id").isin(self.ids))

    def start(self, **trigger):
        """The initial rows go to the sink before the stream starts. trigger: of the stream, availableNow=True for what
        is there."""
        spark = self.collection.spark
        mark = f"{self.checkpoint}/since"
        found = folders.versions(spark, mark)
        if found:  # a query that goes on
            self.since = found[-1]
        else:
            spark.range(1).write.mode("overwrite").parquet(f"{mark}/version={self.since}")
            self.sink(initial(self._own(self.collection.states(self.since)), self.what, "id"), self.since)
        schema = T.StructType([*self.collection.schema.fields, T.StructField("version", T.LongType())])
        stream = spark.readStream.schema(schema).parquet(f"{self.collection.path}/states")
        self.query = stream.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.checkpoint}/stream").trigger(**(trigger or {"processingTime": "1 second"})).start()
        return self.query

    def _step(self, batch: DataFrame, number: int) -> None:
        # a number for each commit of the batch, nothing else, reaches the driver
        for version in sorted(r[0] for r in batch.select("version").distinct().collect()):
            if version > self.since:
                self.step(version)

    def step(self, version: int) -> None:
        """The change set of one version."""
        before, after = (self._own(self.collection.states(v)) for v in (version - 1, version))
        found = touched_changes(before, after, self.collection.touched(version), self.what, "id", with_rows=True)
        if not found.isEmpty():
            self.sink(found, version)

    def update(self, what: str | S.Selection) -> None:
        """Another selection from the current version on: the sink gets the rows that come as initial and those that go
        as remove; versions up to this one are not given again."""
        version = self.collection.version()
        old = self.result(version)
        self.what = S.parse(what) if isinstance(what, str) else what
        found = changes(old, self.result(version), "id", with_rows=True)
        self.since = version
        self.sink(found.withColumn("change_type", F.when(F.col("change_type") == "add", "initial").otherwise(F.col("change_type"))), version)

    def reset(self) -> None:
        version = self.collection.version()
        self.sink(reset(self.result(version), "id"), version)

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
