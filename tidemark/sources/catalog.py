"""The catalog: which models, properties and memberships there are, as three small tables in a folder.

Registering looks every definition up first, by a model's label and, within it, a property's name, so that equal
registrations change nothing; a difference is planned, judged, and written as the next version of the whole catalog
(schema rows alone, a few for each property, which one driver holds).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.sources import folders
from tidemark.sources.collection import TYPES, Model

RESERVED = "_"
TABLES = {
    "model": "id string, label string, name string",
    "property": "id string, minted_for string, name string, backend string, value_type string, target_model string",
    "membership": "id string, model string, property string, optional boolean",
}


class RegistrationError(EngineError, ValueError):
    """A definition that contradicts the catalog, or that it cannot hold."""


@dataclass
class Plan:
    """What a registration would do."""

    creates: dict[str, list[dict]] = field(default_factory=lambda: {t: [] for t in TABLES})
    updates: list[tuple[str, str, str, object, object]] = field(default_factory=list)  # table, id, column, from, to
    existing: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not any(self.creates.values()) and not self.updates


def _id(*parts: str) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        found = folders.versions(self.spark, f"{self.path}/{name}")
        if not found:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/version={found[-1]}")

    def counts(self) -> DataFrame:
        """kind, n: the rows of each table."""
        out = None
        for name in TABLES:
            one = self.table(name).agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
            out = one if out is None else out.unionByName(one)
        return out

    def plan(self, models: list[Model], renamed: dict[str, dict[str, str]] | None = None, names: dict[str, str] | None = None) -> Plan:
        """renamed: by model label, the new name of a property by its old one. names: display names by label."""
        made = Plan()
        held = {t: [r.asDict() for r in self.table(t).collect()] for t in TABLES}
        by_label = {r["label"]: r for r in held["model"]}
        for model in models:
            targets = [p.target for p in model.properties.values() if p.target]
            if any(x.startswith(RESERVED) for x in (model.name, *targets)):
                raise RegistrationError(f"{model.name}: names that begin with {RESERVED} are the catalog's own")
        for label in dict.fromkeys([*(m.name for m in models), *(p.target for m in models for p in m.properties.values() if p.target)]):
            wanted = (names or {}).get(label, label)
            if label not in by_label:
                by_label[label] = {"id": _id("model", label), "label": label, "name": wanted}
                made.creates["model"].append(by_label[label])
            elif (names or {}).get(label, by_label[label]["name"]) != by_label[label]["name"]:
                made.updates.append(("model", by_label[label]["id"], "name", by_label[label]["name"], wanted))
            else:
                made.existing.append(by_label[label]["id"])
        members = {(r["model"], r["property"]): r for r in held["membership"]}
        properties = {(r["minted_for"], r["name"]): r for r in held["property"]}
        for model in models:
            at = by_label[model.name]["id"]
            old_names = {new: old for old, new in (renamed or {}).get(model.name, {}).items()}
            for name, prop in model.properties.items():
                if prop.kind not in TYPES:
                    raise RegistrationError(f"{model.name}.{name}: there is no kind {prop.kind}")
                target = by_label[prop.target]["id"] if prop.target else None
                found = properties.get((at, name))
                if found is None and name in old_names:
                    found = properties.get((at, old_names[name]))
                    if found is None:
                        raise RegistrationError(f"{model.name} has no {old_names[name]} to rename")
                    made.updates.append(("property", found["id"], "name", found["name"], name))
                if found is None:
                    found = {"id": _id("property", at, name), "minted_for": at, "name": name, "backend": prop.backend, "value_type": prop.kind, "target_model": target}
                    made.creates["property"].append(found)
                elif (found["backend"], found["value_type"]) != (prop.backend, prop.kind):
                    raise RegistrationError(f"{model.name}.{name} is {found['value_type']} by {found['backend']}, not {prop.kind} by {prop.backend}")
                elif found["target_model"] != target:
                    made.updates.append(("property", found["id"], "target_model", found["target_model"], target))
                else:
                    made.existing.append(found["id"])
                member = members.get((at, found["id"]))
                if member is None:
                    made.creates["membership"].append({"id": _id("membership", at, found["id"]), "model": at, "property": found["id"], "optional": prop.optional})
                elif member["optional"] != prop.optional:
                    made.updates.append(("membership", member["id"], "optional", member["optional"], prop.optional))
                else:
                    made.existing.append(member["id"])
        return made

    def register(self, models: list[Model], *, renamed: dict[str, dict[str, str]] | None = None, names: dict[str, str] | None = None, judge: Callable[[Plan], None] | None = None) -> Plan:
        """Carries the plan out and returns it. judge may raise; one that changes nothing is not judged."""
        made = self.plan(models, renamed, names)
        if made.empty:
            return made
        if judge is not None:
            judge(made)
        for name, schema in TABLES.items():
            rows = {r["id"]: r.asDict() for r in self.table(name).collect()} | {r["id"]: dict(r) for r in made.creates[name]}
            for table, row, column, _, to in made.updates:
                if table == name:
                    rows[row][column] = to
            columns = [c.split()[0] for c in schema.split(", ")]
            at = max(folders.versions(self.spark, f"{self.path}/{name}"), default=0) + 1
            self.spark.createDataFrame([tuple(r[c] for c in columns) for r in rows.values()], schema).coalesce(1).write.parquet(f"{self.path}/{name}/version={at}")
        return made
