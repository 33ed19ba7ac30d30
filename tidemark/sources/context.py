"""The session surface: tables and collections under a policy, fetches, transactions and live queries."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.operators.compile import select
from tidemark.operators.policy import Agent
from tidemark.plans import selection as S
from tidemark.sources import folders
from tidemark.sources.collection import EVENTS, Collection, Model, NotFound, fold

__all__ = ["Context", "EntityTransaction", "EventTable", "MatchArgs", "NotFound", "ResultSet", "Transaction", "UnknownCollection", "event_id", "nocache"]


class UnknownCollection(EngineError, LookupError):
    """No table or collection has the name."""


def event_id(entity: str, parents: list[str], changes: dict, nonce: str, author: str = "", ts_ms: int = 0) -> str:
    """Content address of an event; that of a genesis, whose entity is still "", is the entity's id."""
    return hashlib.sha256(json.dumps([entity, sorted(parents), sorted(changes.items()), nonce, author, ts_ms]).encode()).hexdigest()


@dataclass(frozen=True)
class MatchArgs:
    """A selection and whether a result that was read before will do."""

    selection: str | S.Selection
    cached: bool = True


def nocache(what: str | S.Selection) -> MatchArgs:
    return MatchArgs(what, cached=False)


class ResultSet:
    """The rows of a fetch, read from the cluster when first asked for."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key
        self._rows: list[Row] | None = None

    @property
    def loaded(self) -> bool:
        return self._rows is not None

    def rows(self) -> list[Row]:
        if self._rows is None:
            self._rows = self.df.collect()  # a fetch hands its rows to the caller, as many as its selection takes
        return self._rows

    def __iter__(self):
        return iter(self.rows())

    def __len__(self) -> int:
        return len(self._rows) if self.loaded else self.df.count()

    def ids(self) -> list:
        return [r[self.key] for r in self.rows()] if self.loaded else [r[0] for r in self.df.select(self.key).collect()]

    def by_id(self, value) -> Row | None:
        if self.loaded:
            return next((r for r in self._rows if r[self.key] == value), None)
        return next(iter(self.df.where(F.col(self.key) == F.lit(value)).take(1)), None)

    def __contains__(self, value) -> bool:
        return self.by_id(value) is not None


@dataclass
class Context:
    """tables: DataFrames by name, keyed by keys[name]; collections: by name, in folders under root. credentials:
    claims, judged by policy; without a policy everything is allowed."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    keys: dict[str, str] = field(default_factory=dict)
    policy: Agent | None = None
    credentials: list[dict] = field(default_factory=list)
    root: str | None = None
    collections: dict[str, Collection] = field(default_factory=dict)
    _results: dict = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, key: str) -> None:
        self.tables[name], self.keys[name] = df, key

    def register_model(self, model: Model, path: str | None = None) -> Collection:
        if path is None and self.root is None:
            raise ValueError("a context without a root needs a path for each model")
        made = Collection(self.spark, path or f"{self.root}/{model.name}", model)
        self.collections[model.name] = made
        return made

    def delete_all_collections(self) -> None:
        for made in self.collections.values():
            made.drop()
        self._results.clear()

    def rows(self, name: str) -> tuple[DataFrame, str]:
        if name in self.collections:
            return self.collections[name].states(), "id"
        if name not in self.tables:
            raise UnknownCollection(name)
        return self.tables[name], self.keys[name]

    def narrowed(self, name: str, what: str | S.Selection) -> S.Selection:
        chosen = S.parse(what) if isinstance(what, str) else what
        if self.policy is None:
            return chosen
        self.policy.admit(name, self.credentials)
        return self.policy.narrow(name, chosen, self.credentials)

    def fetch(self, name: str, what: str | S.Selection | MatchArgs) -> DataFrame:
        args = what if isinstance(what, MatchArgs) else MatchArgs(what)
        chosen = self.narrowed(name, args.selection)
        df, key = self.rows(name)
        return select(df, chosen, name=name, key=key)

    def results(self, name: str, what: str | S.Selection | MatchArgs) -> ResultSet:
        """fetch() as a ResultSet; one read before comes again while the collection's version is the same."""
        args = what if isinstance(what, MatchArgs) else MatchArgs(what)
        at = (name, S.to_sql(self.narrowed(name, args.selection)), self.collections[name].version() if name in self.collections else 0)
        if not args.cached or at not in self._results:
            self._results[at] = ResultSet(self.fetch(name, args), self.rows(name)[1])
        return self._results[at]

    def fetch_one(self, name: str, what: str | S.Selection | MatchArgs) -> Row | None:
        return next(iter(self.fetch(name, what).take(1)), None)

    def retrieve(self, name: str, ids: list) -> DataFrame:
        """Rows by their ids, which needs no more than the retrieve privilege; unknown and hidden ones are left out."""
        df, key = self.rows(name)
        named = df.where(F.col(key).isin(ids))
        return named if self.policy is None else self.policy.readable(name, named, self.credentials)

    def get(self, name: str, value) -> Row:
        found = self.retrieve(name, [value]).take(1)
        if not found:
            raise NotFound(f"{name} {value}")
        return found[0]

    def begin(self, author: str = "") -> EntityTransaction:
        return EntityTransaction(self, author)

    def query(self, name: str, what: str | S.Selection, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None, **options):
        """A live query that runs: its first rows are there when this returns, and its signal tells of each version
        that changed something."""
        from tidemark.streaming.signals import Signal

        told = Signal(0)

        def sink(rows: DataFrame, version: int) -> None:
            if on_change is not None:
                on_change(rows, version)
            told.set(version)

        made = self.live(name, what, sink, checkpoint, **options)
        made.signal = told
        made.start()
        return made

    def live(self, name: str, what: str | S.Selection, sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
        """A live query over a collection: see streaming.live.LiveQuery."""
        from tidemark.streaming.live import LiveQuery

        return LiveQuery(self.collections[name], self.narrowed(name, what), sink, checkpoint, **options)


class EntityTransaction:
    """Creations and edits of a context's collections that become events together, or not at all."""

    def __init__(self, context: Context, author: str = ""):
        self.context, self.author = context, author
        self.rollback()

    def rollback(self) -> None:
        self.made: dict[str, tuple[str, dict, str, int]] = {}
        self.edits: dict[str, tuple[str, dict, dict]] = {}

    def create(self, name: str, /, **values) -> str:
        """A new entity's id."""
        self._known(name, values)
        nonce, ts = uuid.uuid4().hex, int(time.time() * 1000)
        entity = event_id("", [], values, nonce, self.author, ts)
        self.made[entity] = (name, values, nonce, ts)
        return entity

    def get(self, name: str, entity: str) -> Row:
        """An entity as this transaction sees it."""
        if entity in self.made or entity in self.edits:
            rows = self._rows(name, {entity})
            history = self.context.collections[name].entity_events(entity).unionByName(rows)
            return fold(history, self.context.collections[name].model).first()
        return self.context.get(name, entity)

    def edit(self, name: str, entity: str, /, **values) -> None:
        self._known(name, values)
        self.edits.setdefault(entity, (name, {}, {}))[1].update(values)

    def edit_text(self, name: str, entity: str, prop: str, at: int, removed: int = 0, inserted: str = "") -> None:
        """An edit of a text property, on the text as it stands after the transaction's earlier edits of it."""
        self._known(name, {prop: None})
        self.edits.setdefault(entity, (name, {}, {}))[2].setdefault(prop, []).append((at, removed, inserted))

    def _known(self, name: str, values: dict) -> None:
        if name not in self.context.collections:
            raise UnknownCollection(name)
        model = self.context.collections[name].model
        if strange := set(values) - set(model.properties):
            raise KeyError(f"{name} has no {', '.join(sorted(strange))}")

    def _rows(self, name: str, entities: set[str]) -> DataFrame:
        """The events that would be written for some of the transaction's entities."""
        own = self.context.collections[name]
        rows = []

        def write(event: str, entity: str, kind: str, parents: list[str], values: dict, nonce: str, ts: int, added: list[str], texts: dict | None = None) -> None:
            head = (event, entity, kind, parents, self.author, nonce, ts, added)
            kept = [(*head, p, "lww", json.dumps(v), None, None, None) for p, v in values.items() if own.model.properties[p].backend == "lww"]
            edits = {p: [(0, 0, v)] for p, v in values.items() if own.model.properties[p].backend == "text"} | (texts or {})
            kept += [(*head, p, "text", new, k, at, removed) for p, many in edits.items() for k, (at, removed, new) in enumerate(many)]
            rows.extend(kept or [(*head, None, None, None, None, None, None)])

        for entity in entities & set(self.made):
            _, values, nonce, ts = self.made[entity]
            write(entity, entity, "genesis", [], values, nonce, ts, [name])
        edited = sorted(entities & set(self.edits))
        stored = {r["id"]: list(r["head"]) for r in own.get_states([e for e in edited if e not in self.made]).select("id", "head").collect()} if edited else {}
        for entity in edited:
            parents = [entity] if entity in self.made else stored.get(entity)
            if not parents:
                raise NotFound(f"{name} {entity}")
            _, values, texts = self.edits[entity]
            nonce, ts = uuid.uuid4().hex, int(time.time() * 1000)
            write(event_id(entity, parents, values | {p: many for p, many in texts.items()}, nonce, self.author, ts), entity, "update", parents, values, nonce, ts, [], texts)
        return self.context.spark.createDataFrame(rows, EVENTS)

    def commit(self) -> int:
        """Writes one event for each entity created, one for each edited, and the states that follow; returns the
        entities touched. The policy sees the images before and after the whole transaction before anything is
        written. Events are written first: states that were lost with the driver come from Collection.rebuild()."""
        by_name: dict[str, set[str]] = {}
        for entity, (name, *_) in [*self.made.items(), *self.edits.items()]:
            by_name.setdefault(name, set()).add(entity)
        context, ready = self.context, []
        for name, entities in by_name.items():
            own = context.collections[name]
            rows = self._rows(name, entities)
            history = own.events_of(rows).unionByName(rows)
            after = fold(history, own.model)
            if context.policy is not None:
                before = own.get_states([e for e in entities if e not in self.made])
                context.policy.check_write(name, before.unionByName(after), context.credentials)
            ready.append((own, rows, after))
        for own, rows, after in ready:
            # one file: the events of a commit are there together or not at all
            kept = context.spark.createDataFrame(after.collect(), own.schema)  # a row for each entity of the transaction
            own.add_events(rows.coalesce(1))
            own.set_states(kept)
        self.rollback()
        return sum(map(len, by_name.values()))


PLAIN_EVENTS = "event_id string, entity_id string, kind string, parents array<string>, property string, value string"


class EventTable:
    """An append-only event table in a folder, without a model; appending an event again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _raw(self) -> DataFrame:
        if not folders.exists(self.spark, self.path):
            return self.spark.createDataFrame([], PLAIN_EVENTS)
        return self.spark.read.schema(PLAIN_EVENTS).parquet(self.path)

    def read(self) -> DataFrame:
        """A row for each property that an event writes; repeated events count once."""
        return self._raw().dropDuplicates(["event_id", "property"])

    def append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, PLAIN_EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def heads_of(self, entities: list[str]) -> dict[str, list[str]]:
        """The heads of several entities in one read, which their rows alone pass."""
        own = self._raw().where(F.col("entity_id").isin(entities)).select("entity_id", "event_id", "parents").distinct()
        taken = own.select("entity_id", F.explode("parents").alias("event_id"))
        found = own.select("entity_id", "event_id").join(taken, ["entity_id", "event_id"], "left_anti").collect()
        return {e: sorted(r[1] for r in found if r[0] == e) for e in entities}

    def heads(self, entity: str) -> list[str]:
        return self.heads_of([entity])[entity]


class Transaction:
    """Creations and edits that become events of an event table together, or not at all."""

    def __init__(self, events: EventTable):
        self.events, self.rows, self.edits = events, [], {}

    def create(self, **values) -> str:
        nonce = uuid.uuid4().hex
        entity = event_id("", [], values, nonce)
        self.rows += [(entity, entity, "genesis", [], p, json.dumps(v)) for p, v in (values or {"": None}).items()]
        return entity

    def edit(self, entity: str, **values) -> None:
        self.edits.setdefault(entity, {}).update(values)

    def commit(self) -> int:
        """Writes one event for each entity edited and returns the rows written."""
        created = {r[1] for r in self.rows}
        stored = self.events.heads_of([e for e in self.edits if e not in created]) if set(self.edits) - created else {}
        for entity, values in self.edits.items():
            parents = [entity] if entity in created else stored[entity]
            if not parents:
                raise NotFound(entity)
            name = event_id(entity, parents, values, uuid.uuid4().hex)
            self.rows += [(name, entity, "update", parents, p, json.dumps(v)) for p, v in values.items()]
        if self.rows:
            self.events.append(self.rows)
        written, self.rows, self.edits = len(self.rows), [], {}
        return written

    def rollback(self) -> None:
        self.rows, self.edits = [], {}
