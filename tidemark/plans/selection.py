"""The selection language: predicate [ORDER BY ...] [LIMIT n], its syntax tree, binding, text form and rewrites.

AND and OR share one precedence level and group from the left (strict=True: AND binds closer). A quote in a text is
written twice; a step of a path that is no plain name stands in double quotes.
"""

from __future__ import annotations

import datetime
import decimal
import math
import re
from dataclasses import dataclass, replace

from tidemark.errors import EngineError


class SelectionError(EngineError, ValueError):
    """The text is no selection, or its parameters do not fit."""


class SyntaxFault(SelectionError):
    """A character or word that cannot stand where it does."""


class MissingOperand(SelectionError):
    """The text ends, or a clause begins, where a value was expected."""


class InvalidPredicate(SelectionError):
    """A value stands where a predicate was expected."""


class BindingFault(SelectionError):
    """Values and placeholders do not fit."""


@dataclass(frozen=True)
class EntityId:
    """The id of an entity as a value: 32 bytes as 43 characters of base64 or 64 of hexadecimal."""

    text: str

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9_-]{43}|[0-9a-f]{64}", self.text):
            raise SelectionError(f"{self.text!r} is no entity id")


@dataclass(frozen=True)
class Path:
    steps: tuple[str, ...]


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Hole:
    """A placeholder, for a value or for a whole predicate."""


@dataclass(frozen=True)
class Cmp:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class In:
    left: object
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    of: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Both:
    op: str  # and, or
    left: object
    right: object


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Selection:
    where: object = Const(True)
    order: tuple[Order, ...] = ()
    limit: int | None = None


_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^']|'')*')|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>"[^"]*"|[A-Za-z_А-Яа-я][\w-]*)|(?P<op><>|!=|>=|<=|[=<>(),.?]))""")
_RESERVED = {"AND", "OR", "NOT", "IN", "IS", "NULL", "ORDER", "BY", "LIMIT", "ASC", "DESC", "TRUE", "FALSE", "BETWEEN"}
_FLIP = {"=": "=", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


class _Parser:
    def __init__(self, text: str, strict: bool = False):
        self.strict = strict
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxFault(f"unexpected {text[at:at + 10]!r}")
            kind = m.lastgroup
            value = m[kind]
            word = value.upper() if kind == "name" and value.upper() in _RESERVED else None
            self.items.append((word or (value if kind == "op" else kind), value))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at][0] if self.at < len(self.items) else None

    def take(self, *kinds: str) -> str:
        if self.peek() not in kinds:
            fault = MissingOperand if self.peek() in (None, "ORDER", "LIMIT", "AND", "OR", ")") else SyntaxFault
            raise fault(f"expected {' or '.join(kinds)}, found {self.peek() or 'the end'}")
        self.at += 1
        return self.items[self.at - 1][1]

    def accept(self, *kinds: str) -> str | None:
        return self.take(*kinds) if self.peek() in kinds else None

    def selection(self) -> Selection:
        where = Const(True) if self.peek() in (None, "ORDER", "LIMIT") else self.chain()
        order, limit = [], None
        if self.accept("ORDER"):
            self.take("BY")
            while True:
                column = _bare(self.take("name"))
                order.append(Order(column, (self.accept("ASC", "DESC") or "ASC").upper() == "DESC"))
                if not self.accept(","):
                    break
        if self.accept("LIMIT"):
            count = self.take("num")
            if not count.isdecimal():
                raise SyntaxFault(f"{count} is no limit")
            limit = int(count)
        if self.peek() is not None:
            raise SyntaxFault(f"unexpected {self.items[self.at][1]!r}")
        return Selection(where, tuple(order), limit)

    def chain(self) -> object:
        left = self.term()
        while op := self.accept("AND", "OR"):
            right = self.term()
            while self.strict and op.upper() == "OR" and self.accept("AND"):
                right = Both("and", right, self.term())
            left = Both(op.lower(), left, right)
        return left

    def term(self) -> object:
        if self.accept("NOT"):
            return Not(self.term())
        if self.peek() == "(":
            mark = self.at
            self.take("(")
            inside = self.chain()
            self.take(")")
            if self.peek() in (None, "AND", "OR", ")", "ORDER", "LIMIT"):
                return inside
            self.at = mark
        left = self.value()
        if self.accept("IS"):
            negated = self.accept("NOT")
            self.take("NULL")
            return Not(IsNull(left)) if negated else IsNull(left)
        negated = bool(self.accept("NOT"))
        if self.accept("IN"):
            if self.accept("?"):
                return In(left, (Hole(),), negated)
            self.take("(")
            items = [self.value()]
            while self.accept(","):
                items.append(self.value())
            self.take(")")
            return In(left, tuple(items), negated)
        if negated:
            raise SyntaxFault("NOT must stand before IN or a predicate")
        if op := self.accept("=", "!=", "<>", ">", "<", ">=", "<="):
            return Cmp("!=" if op == "<>" else op, left, self.value())
        if isinstance(left, Lit) and isinstance(left.value, bool):
            return Const(left.value)
        if isinstance(left, Hole):
            return left
        raise InvalidPredicate("a predicate was expected")

    def value(self) -> object:
        if self.accept("?"):
            return Hole()
        if (text := self.accept("str")) is not None:
            return Lit(text[1:-1].replace("''", "'"))
        if (text := self.accept("num")) is not None:
            return Lit(int(text) if text.lstrip("-").isdecimal() else float(text))
        if text := self.accept("TRUE", "FALSE"):
            return Lit(text.upper() == "TRUE")
        steps = [_bare(self.take("name"))]
        while self.accept("."):
            steps.append(_bare(self.take("name")))
        return Path(tuple(steps))


def _bare(name: str) -> str:
    return name[1:-1] if name[:1] == '"' else name


def parse(text: str, strict: bool = False) -> Selection:
    return _Parser(text, strict).selection()


def walk(node: object, change) -> object:
    """A tree with change applied to every node from the leaves up."""
    if isinstance(node, Both):
        node = Both(node.op, walk(node.left, change), walk(node.right, change))
    elif isinstance(node, Cmp):
        node = Cmp(node.op, walk(node.left, change), walk(node.right, change))
    elif isinstance(node, (Not, IsNull)):
        node = type(node)(walk(node.of, change))
    elif isinstance(node, In):
        node = In(walk(node.left, change), tuple(walk(x, change) for x in node.items), node.negated)
    return change(node)


#: What a placeholder can be bound to, besides lists of them and predicates.
VALUES = (str, bool, int, float, EntityId, datetime.date, datetime.datetime, decimal.Decimal)


def bind(selection: Selection, values: list) -> Selection:
    """Placeholders filled in order: a list fills an IN, a tree a whole predicate."""
    left = list(values)

    def checked(value: object) -> object:
        if not isinstance(value, VALUES):
            raise BindingFault(f"a {type(value).__name__} cannot be bound")
        return value

    def fill(node: object) -> object:
        if isinstance(node, In) and any(isinstance(x, Lit) and isinstance(x.value, list) for x in node.items):
            return In(node.left, tuple(y for x in node.items for y in ([Lit(v) for v in x.value] if isinstance(x, Lit) and isinstance(x.value, list) else [x])), node.negated)
        if isinstance(node, Cmp) and any(isinstance(x, Lit) and isinstance(x.value, list) for x in (node.left, node.right)):
            raise BindingFault("a list fills an IN alone")
        if not isinstance(node, Hole):
            return node
        if not left:
            raise BindingFault("too few values")
        value = left.pop(0)
        if isinstance(value, (Both, Cmp, Not, In, IsNull, Const)):
            return value
        return Lit([checked(v) for v in value]) if isinstance(value, (list, tuple)) else Lit(checked(value))

    bound = replace(selection, where=walk(selection.where, fill))
    if left:
        raise BindingFault("too many values")
    return bound


_SLOT = re.compile(r"\{(?P<op>>=|<=|<>|!=|>|<|=)?(?P<name>\w*)\}")


def template(text: str, *args: object, **named: object) -> Selection:
    """{name} after an operator or IN is a value; standing alone, with or without an operator, it compares that name."""
    values, spare = [], list(args)

    def put(m: re.Match) -> str:
        values.append(named[m["name"]] if m["name"] else spare.pop(0))
        before = text[: m.start()].rstrip()
        if m["name"] and not re.search(r"(=|<|>|\bIN)$", before, re.I):
            return f"{m['name']} {m['op'] or '='} ?"
        return "?"

    return bind(parse(_SLOT.sub(put, text)), values)


def to_sql(node: object) -> str:
    """Text of a tree, every AND and OR in parentheses."""
    if isinstance(node, Selection):
        order = ", ".join(f"{_step(o.column)} {'DESC' if o.descending else 'ASC'}" for o in node.order)
        return to_sql(node.where) + (f" ORDER BY {order}" if order else "") + (f" LIMIT {node.limit}" if node.limit is not None else "")
    if isinstance(node, Both):
        return f"({to_sql(node.left)} {node.op.upper()} {to_sql(node.right)})"
    if isinstance(node, Cmp):
        return f"{to_sql(node.left)} {node.op} {to_sql(node.right)}"
    if isinstance(node, Not):
        return f"NOT ({to_sql(node.of)})"
    if isinstance(node, IsNull):
        return f"{to_sql(node.of)} IS NULL"
    if isinstance(node, In):
        return f"{to_sql(node.left)} {'NOT ' if node.negated else ''}IN ({', '.join(map(to_sql, node.items))})"
    if isinstance(node, Const):
        return str(node.value).upper()
    if isinstance(node, Path):
        return ".".join(map(_step, node.steps))
    if isinstance(node, Hole):
        return "?"
    if isinstance(node.value, str):
        return "'" + node.value.replace("\0", "").replace("'", "''") + "'"
    if isinstance(node.value, (EntityId, datetime.date)):
        return f"'{node.value.text if isinstance(node.value, EntityId) else node.value.isoformat()}'"
    return str(node.value).upper() if isinstance(node.value, bool) else str(node.value)


def _step(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_А-Яа-я][\w-]*", name) and name.upper() not in _RESERVED else f'"{name}"'


def columns(node: object) -> set[str]:
    """First steps of all paths."""
    found: set[str] = set()
    walk(node, lambda n: (found.add(n.steps[0]) if isinstance(n, Path) else None, n)[1])
    return found


def conjuncts(node: object) -> list:
    return conjuncts(node.left) + conjuncts(node.right) if isinstance(node, Both) and node.op == "and" else [node]


def assume_null(node: object, missing) -> object:
    """The tree for rows that lack some columns: missing(path) tells which. A comparison with one is false, IS NULL of
    one true, and constants are folded."""

    def change(n: object) -> object:
        if isinstance(n, Cmp) and any(isinstance(x, Path) and missing(x) for x in (n.left, n.right)):
            return Const(False)
        if isinstance(n, In) and isinstance(n.left, Path) and missing(n.left):
            return Const(n.negated)
        if isinstance(n, IsNull) and isinstance(n.of, Path) and missing(n.of):
            return Const(True)
        if isinstance(n, Not) and isinstance(n.of, Const):
            return Const(not n.of.value)
        if isinstance(n, Both):
            ends = n.op == "or"  # the constant that decides alone
            for one, other in ((n.left, n.right), (n.right, n.left)):
                if isinstance(one, Const):
                    return one if one.value == ends else other
        return n

    return walk(node, change)


def _ordered(value: object) -> object:
    """A value and its class, within which values are ordered; None for those without an order."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if isinstance(value, float) and math.isnan(value) else "number"
    if isinstance(value, str):
        return "text"
    return "time" if isinstance(value, datetime.datetime) else "day" if isinstance(value, datetime.date) else None


def contradicts(node: object, typed=lambda path, value: value) -> bool:
    """Whether the bounds that a conjunction sets on one column leave no value. typed(path, value): the value as the
    column compares it, or None if it does not compare as itself; bounds of several classes are left alone."""
    bounds: dict[Path, list[tuple[str, object]]] = {}
    for c in conjuncts(node):
        if isinstance(c, Const) and not c.value:
            return True
        if isinstance(c, Cmp) and c.op != "!=":
            op, path, lit = (c.op, c.left, c.right) if isinstance(c.left, Path) else (_FLIP[c.op], c.right, c.left)
            if isinstance(path, Path) and isinstance(lit, Lit):
                value = typed(path, lit.value)
                if _ordered(value):
                    bounds.setdefault(path, []).append((op, value))
    for every in bounds.values():
        if len({_ordered(v) for _, v in every}) > 1:
            continue
        low = max(((v, op == ">") for op, v in every if op in (">", ">=", "=")), default=None)
        high = min(((v, op != "<") for op, v in every if op in ("<", "<=", "=")), default=None)
        if low and high and (low[0] > high[0] or low[0] == high[0] and (low[1] or not high[1])):
            return True
    return False


def after(order: tuple[Order, ...], key: str, last: dict) -> object:
    """The exact predicate of the rows that follow the row last in an order, ties by key. Nulls come first in both
    directions, so after a null come all values, and after a value no null. A NaN has no place that a predicate can
    name; it is refused."""
    every = [*order, *([] if any(o.column == key for o in order) else [Order(key)])]
    out, same = None, None
    for o in every:
        path, value = Path((o.column,)), last[o.column]
        if isinstance(value, float) and math.isnan(value):
            raise SelectionError("no page follows a NaN")
        step = Not(IsNull(path)) if value is None else Cmp("<" if o.descending else ">", path, Lit(value))
        step = Both("and", same, step) if same else step
        out = Both("or", out, step) if out else step
        equal = IsNull(path) if value is None else Cmp("=", path, Lit(value))
        same = Both("and", same, equal) if same else equal
    return out
