"""Row policies: a reader's selection narrowed to the rows that their claims allow, and checks of rows read and written.

Closed by default: a collection that the policy does not list is open to privileged credentials and wildcard roles
alone. Admission has three tiers: read or write admits selections, retrieve admits rows named by their id. A scope
rule whose claim a credential lacks makes that credential useless for the collection, not the whole request.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import EngineError
from tidemark.operators.compile import Compiler
from tidemark.plans import selection as S

#: A credential that may do everything.
PRIVILEGED = {"privileged": True}
EVERYTHING = "*"


class AccessDenied(EngineError, PermissionError):
    """No credential allows it."""


class MissingClaim(AccessDenied):
    """A scope rule names a claim that the credential does not have."""


class Agent(Protocol):
    """What a context asks about its requests."""

    def admit(self, collection: str, credentials: list[dict]) -> None:
        """Raises unless some credential may reach the collection at all."""

    def narrow(self, collection: str, selection: S.Selection, credentials: list[dict]) -> S.Selection:
        """The selection over the rows that the credentials may scan."""

    def readable(self, collection: str, rows: DataFrame, credentials: list[dict]) -> DataFrame:
        """Those of rows, named by id, that some credential may read."""

    def check_write(self, collection: str, rows: DataFrame, credentials: list[dict]) -> None:
        """Raises unless every row (an image before or after a write) may be written."""


class Permissive:
    """Everything is allowed."""

    def admit(self, collection, credentials):
        return None

    def narrow(self, collection, selection, credentials):
        return selection

    def readable(self, collection, rows, credentials):
        return rows

    def check_write(self, collection, rows, credentials):
        return None


@dataclass(frozen=True)
class Scope:
    """applies_to: read, write or both."""

    filter: str
    unless_privilege: str | None = None
    applies_to: str = "both"


@dataclass(frozen=True)
class Rules:
    read: str | None = None
    write: str | None = None
    scopes: tuple[Scope, ...] = ()
    retrieve: str | None = None


@dataclass(frozen=True)
class Policy:
    roles: dict[str, set[str]]
    collections: dict[str, Rules] = field(default_factory=dict)

    def privileges(self, claims: dict) -> set[str]:
        return set().union(*(self.roles.get(r, set()) for r in claims.get("roles", ())))

    def _holds(self, claims: dict, *wanted: str | None) -> bool:
        has = self.privileges(claims)
        return EVERYTHING in has or any(w is not None and w in has for w in wanted)

    def may(self, claims: dict, collection: str, action: str) -> bool:
        """action: scan, retrieve or write."""
        if claims.get("privileged"):
            return True
        rules = self.collections.get(collection, Rules())
        return self._holds(claims, *{"scan": (rules.read, rules.write), "retrieve": (rules.read, rules.write, rules.retrieve), "write": (rules.write,)}[action])

    def admit(self, collection: str, credentials: list[dict]) -> None:
        if not any(self.may(c, collection, "retrieve") for c in credentials):
            raise AccessDenied(collection)

    def scope(self, collection: str, claims: dict, action: str) -> list:
        """The predicates that bind a credential; MissingClaim if one cannot be made."""
        rules = self.collections.get(collection, Rules())
        return [bound(s.filter, claims) for s in rules.scopes if s.applies_to in ("both", action) and not (s.unless_privilege and self._holds(claims, s.unless_privilege))]

    def _slices(self, collection: str, credentials: list[dict], action: str) -> list | None:
        """A predicate for each credential that may act and whose claims suffice; None if one of them is not bound."""
        made = []
        for claims in credentials:
            if claims.get("privileged"):
                return None
            if not self.may(claims, collection, action):
                continue
            try:
                parts = self.scope(collection, claims, "read")
            except MissingClaim:
                continue
            if not parts:
                return None
            whole = reduce(lambda a, b: S.Both("and", a, b), parts)
            if whole not in made:
                made.append(whole)
        return made

    def narrow(self, collection: str, selection: S.Selection, credentials: list[dict]) -> S.Selection:
        """P AND (slice OR slice ...), a slice for each credential that may scan; P alone if one is not bound; FALSE if
        none may scan. Refused without credentials, for a collection that is not listed, and where every credential
        that may scan lacks a claim."""
        if not credentials or collection not in self.collections and not any(self.may(c, collection, "scan") for c in credentials):
            raise AccessDenied(collection)
        slices = self._slices(collection, credentials, "scan")
        if slices is None:
            return selection
        if not slices:
            if any(self.may(c, collection, "scan") for c in credentials):
                raise AccessDenied(f"{collection}: no credential has the claims that its scope needs")
            return S.Selection(S.Const(False), selection.order, selection.limit)
        union = reduce(lambda a, b: S.Both("or", a, b), slices)
        return S.Selection(S.Both("and", selection.where, union), selection.order, selection.limit)

    def readable(self, collection: str, rows: DataFrame, credentials: list[dict]) -> DataFrame:
        """Rows that all rules of one credential pass."""
        self.admit(collection, credentials)
        slices = self._slices(collection, credentials, "retrieve")
        if slices is None:
            return rows
        if not slices:
            raise AccessDenied(f"{collection}: no credential has the claims that its scope needs")
        return rows.where(Compiler(rows.schema, collection).where(reduce(lambda a, b: S.Both("or", a, b), slices)))

    def refused(self, collection: str, rows: DataFrame, claims: dict) -> DataFrame:
        """Rows that a credential may not write: all without the privilege, else those that fail a write rule. A rule
        that a row gives no answer to (a null) refuses it."""
        if claims.get("privileged"):
            return rows.limit(0)
        if not self.may(claims, collection, "write"):
            return rows
        try:
            parts = self.scope(collection, claims, "write")
        except MissingClaim:
            return rows
        if not parts:
            return rows.limit(0)
        held = Compiler(rows.schema, collection).where(reduce(lambda a, b: S.Both("and", a, b), parts))
        return rows.where(~F.coalesce(held, F.lit(False)))

    def check_write(self, collection: str, rows: DataFrame, credentials: list[dict]) -> None:
        """One credential must allow all rows."""
        if not any(self.refused(collection, rows, c).isEmpty() for c in credentials if self.may(c, collection, "write")):
            raise AccessDenied(f"{collection}: a write outside the permitted scope")


def bound(text: str, claims: dict) -> object:
    """A rule's predicate; $jwt.* becomes a bound value, never text."""
    values = []

    def take(m: re.Match) -> str:
        value = claims
        for step in m[1].split("."):
            if not isinstance(value, dict) or step not in value:
                raise MissingClaim(m[0])
            value = value[step]
        if value is None or isinstance(value, (dict, list, tuple)):
            raise MissingClaim(f"{m[0]} is no single value")
        values.append(value)
        return "?"

    return S.bind(S.parse(re.sub(r"\$jwt\.([\w.]*\w)", take, text)), values).where
