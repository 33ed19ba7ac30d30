"""A collection of entities in a folder: an append-only event table, and versioned states folded from it.

  events/                     a row for each property that an event writes
  states/version=N/           the states of the entities that commit N touched, with their heads
  base/version=N/             all states as of N, from compact(); states up to N are then read from here

A state of version N is the latest row of each entity up to N, so an upsert is an append, every version stays readable
until vacuum(), and a live query compares two versions. Both tables are written by Spark's committer: a lost executor
leaves no half-written file. Reading drops repeated events by id, so adding one again changes nothing; reads for given
entities or ids filter before that.

Defined results: events without properties keep a row with a null property; unknown ids are skipped by batch reads and
NotFound for point reads; a collection without files is empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import EngineError
from tidemark.functions import casts
from tidemark.operators import eventlog
from tidemark.operators.compile import select
from tidemark.plans import selection as S
from tidemark.sources import folders
from tidemark.sources.tables import ensure_checkpoints

#: Spark's type of a property's kind.
TYPES = {"string": T.StringType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "json": T.StringType(), "entity_id": T.StringType(), "ref": T.StringType()}
_NAMES = T.ArrayType(T.StringType())
EVENTS = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("event_id", "entity_id", "kind")), T.StructField("parents", _NAMES),
    *(T.StructField(c, T.StringType()) for c in ("author", "nonce")), T.StructField("ts_ms", T.LongType()), T.StructField("added", _NAMES),
    *(T.StructField(c, T.StringType()) for c in ("property", "backend", "value")), *(T.StructField(c, T.IntegerType()) for c in ("seq", "at", "removed")),
])


class NotFound(EngineError, LookupError):
    """No entity has the id."""


@dataclass(frozen=True)
class Property:
    """kind: one of TYPES. backend: lww (the last write wins) or text (edits of texts are merged). target: the model
    that a ref points to."""

    kind: str = "string"
    backend: str = "lww"
    optional: bool = True
    target: str | None = None


@dataclass(frozen=True)
class Model:
    name: str
    properties: dict[str, Property] = field(default_factory=dict)


def _lww(kept: DataFrame, parents: DataFrame) -> DataFrame:
    writes = kept.select(F.col("entity_id").alias("entity"), F.col("event_id").alias("event"), "property", "value")
    return eventlog.lww_state(writes, parents).select("entity", "property", "value")


def _text(kept: DataFrame, parents: DataFrame) -> DataFrame:
    edits = kept.select(F.col("entity_id").alias("entity"), F.col("event_id").alias("event"), "property", "seq", "at", "removed", F.col("value").alias("inserted"))
    # events without an edit carry the order between those with one
    bare = kept.select(F.col("entity_id").alias("entity"), F.col("event_id").alias("event")).distinct()
    return eventlog.text_state(edits.unionByName(bare, allowMissingColumns=True), parents).select("entity", "property", F.to_json(F.struct("value")).alias("value"))


#: How the writes of a backend's properties become a value: a function of (all event rows, of which those of other
#: backends have no property; parents) that gives entity, property, value (JSON text, or {"value": text} for text).
BACKENDS = {"lww": _lww, "text": _text}


def parents_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("entity_id").alias("entity"), F.col("event_id").alias("event"), F.explode("parents").alias("parent")).distinct()


def _typed(text: Column, prop: Property) -> Column:
    """The value of a JSON text as the property's type; null where it is of another kind."""
    if prop.backend == "text":
        return F.get_json_object(text, "$.value")
    if prop.kind == "json":
        return text
    value = F.try_parse_json(text)
    return casts.json_to(value, {"entity_id": "string", "ref": "string"}.get(prop.kind, prop.kind))


def fold(events: DataFrame, model: Model) -> DataFrame:
    """The states of events' entities: id, head (ascending), models, and a column for each property of the model."""
    ensure_checkpoints(events.sparkSession)
    events = events.checkpoint()  # read and freed of repeated rows once, for all that follows
    parents = parents_of(events)
    names = events.select(F.col("entity_id").alias("entity"), F.col("event_id").alias("event")).distinct()
    states = eventlog.clocks_of(names, parents)
    added = events.select(F.col("entity_id").alias("entity"), F.col("event_id"), "added").distinct()
    states = states.join(eventlog.memberships(added), "entity", "left")
    for backend, values in BACKENDS.items():
        own = [p for p, x in model.properties.items() if x.backend == backend]
        if own:
            ours = F.col("property").isin(own) & (F.coalesce("backend", F.lit("lww")) == backend)
            blank = {c: F.when(ours, F.col(c)) for c in ("property", "value", "seq", "at", "removed")}
            found = values(events.withColumns(blank), parents)
            wide = found.groupBy("entity").agg(*(F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in own))
            states = states.join(wide.select("entity", *(_typed(F.col(f"`{p}`"), model.properties[p]).cast(TYPES[model.properties[p].kind]).alias(p) for p in own)), "entity", "left")
    return states.select(F.col("entity").alias("id"), "head", "models", *(f"`{p}`" for p in model.properties))


def _none(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows; createDataFrame([]) would start Python workers on the executors to make them."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


class Collection:
    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        fixed = [T.StructField("id", T.StringType()), T.StructField("head", _NAMES), T.StructField("models", _NAMES)]
        self.schema = T.StructType([*fixed, *(T.StructField(p, TYPES[x.kind]) for p, x in model.properties.items())])

    # events

    def events(self) -> DataFrame:
        return self._once(self._raw())

    def _raw(self) -> DataFrame:
        path = f"{self.path}/events"
        if not folders.exists(self.spark, path):
            return _none(self.spark, EVENTS)
        return self.spark.read.schema(EVENTS).parquet(path)

    @staticmethod
    def _once(rows: DataFrame) -> DataFrame:
        return rows.dropDuplicates(["event_id", "property", "seq"])

    def add_events(self, rows: DataFrame) -> None:
        """Appends events; ones that are there already change nothing."""
        rows.select(*EVENTS.names).write.mode("append").parquet(f"{self.path}/events")

    def get_events(self, ids: list[str]) -> DataFrame:
        return self._once(self._raw().where(F.col("event_id").isin(ids)))

    def entity_events(self, entity: str) -> DataFrame:
        """The whole history of an entity."""
        return self._once(self._raw().where(F.col("entity_id") == entity))

    def events_of(self, entities: DataFrame) -> DataFrame:
        """The histories of the entities in the column entity_id."""
        return self._once(self._raw().join(entities.select("entity_id").distinct(), "entity_id", "left_semi").select(*EVENTS.names))

    # states

    def version(self) -> int:
        """The latest version; 0 without any."""
        return max([*folders.versions(self.spark, f"{self.path}/states"), *folders.versions(self.spark, f"{self.path}/base"), 0])

    def states(self, version: int | None = None) -> DataFrame:
        """The states as of a version, by default the latest."""
        at = self.version() if version is None else version
        base = max((v for v in folders.versions(self.spark, f"{self.path}/base") if v <= at), default=0)
        later = [v for v in folders.versions(self.spark, f"{self.path}/states") if base < v <= at]
        wide = T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])
        parts = [self.spark.read.schema(wide).option("basePath", f"{self.path}/{of}").parquet(*(f"{self.path}/{of}/version={v}" for v in some)) for of, some in (("base", [base] if base else []), ("states", later)) if some]
        if not parts:
            return _none(self.spark, self.schema)
        if len(parts) == 1 and (base or len(later) == 1):
            return parts[0].drop("version")
        every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        latest = F.max_by(F.struct(*(f"`{c}`" for c in self.schema.names)), "version").alias("row")
        return every.groupBy(F.col("id").alias("id_")).agg(latest).select("row.*")

    def touched(self, version: int) -> DataFrame:
        """id of the states that a version wrote."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/states/version={version}").select("id")

    def get_state(self, entity: str):
        found = self.states().where(F.col("id") == entity).take(1)
        if not found:
            raise NotFound(f"{self.model.name} {entity}")
        return found[0]

    def get_states(self, ids: list[str]) -> DataFrame:
        return self.states().where(F.col("id").isin(ids))

    def fetch_states(self, what: str | S.Selection) -> DataFrame:
        return select(self.states(), what, name=self.model.name, key="id")

    def set_states(self, rows: DataFrame, version: int | None = None) -> bool:
        """Upserts states as the next version (or the one given, so that a repeated commit writes it again); whether
        any head differs from what was there."""
        at = self.version() + 1 if version is None else version
        made = rows.select(*(f"`{c}`" for c in self.schema.names))
        made.write.mode("overwrite").parquet(f"{self.path}/states/version={at}")
        now = self.spark.read.schema(self.schema).parquet(f"{self.path}/states/version={at}").select("id", "head")
        before = self.states(at - 1).select("id", F.col("head").alias("was"))
        return not now.join(before, "id", "left").where(~F.col("head").eqNullSafe(F.col("was"))).isEmpty()

    def rebuild(self, entities: DataFrame | None = None) -> bool:
        """Folds the histories of entities (column entity_id; all without it) into the next version."""
        history = self.events() if entities is None else self.events_of(entities)
        return self.set_states(fold(history, self.model))

    def compact(self) -> None:
        """Writes all states as of now as one table, which reads then begin from."""
        at = self.version()
        if at and at not in folders.versions(self.spark, f"{self.path}/base"):
            self.states(at).write.mode("overwrite").parquet(f"{self.path}/base/version={at}")

    def vacuum(self, before: int) -> None:
        """Removes what only versions before the given one need: states up to the last base before it, and older bases."""
        bases = [v for v in folders.versions(self.spark, f"{self.path}/base") if v <= before]
        for of, last in (("states", max(bases, default=0) + 1), ("base", max(bases, default=0))):
            for v in folders.versions(self.spark, f"{self.path}/{of}"):
                if v < last:
                    folders.remove(self.spark, f"{self.path}/{of}/version={v}")

    def drop(self) -> None:
        folders.remove(self.spark, self.path)
