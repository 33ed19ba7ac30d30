"""Kinds of values, and casts of literals to them before a plan is made."""

from __future__ import annotations

import datetime
import decimal
import math
import re

from pyspark.sql import types as T

from tidemark.functions.casts import FALSE, TRUE
from tidemark.plans import selection as S


class CastError(S.SelectionError):
    """A literal does not fit the kind of its column."""


NUMBERS = ("i16", "i32", "i64", "decimal", "f64")
BITS = {"i16": 15, "i32": 31, "i64": 63}
_KINDS = {
    T.ByteType: "i16", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f64", T.DoubleType: "f64", T.DecimalType: "decimal",
    T.BooleanType: "bool", T.StringType: "string", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.BinaryType: "binary", T.VariantType: "json",
}
_NUMBER = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def kind_of(of: T.DataType) -> str:
    return _KINDS.get(type(of), "other")


def literal_kind(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "i32" if -(2**31) <= value < 2**31 - 1 else "i64" if -(2**63) <= value < 2**63 else "decimal"
    for of, kind in ((float, "f64"), (str, "string"), (S.EntityId, "entity_id"), (datetime.datetime, "timestamp"), (datetime.date, "date"), (decimal.Decimal, "decimal"), (bytes, "binary")):
        if isinstance(value, of):
            return kind
    raise CastError(f"a {type(value).__name__} is no value")


def text_of(value: object) -> str:
    """The text that a value casts to; a whole float has no fraction part."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    return value.text if isinstance(value, S.EntityId) else str(value)


def _fits(value: int, kind: str) -> bool:
    return -(1 << BITS[kind]) <= value < 1 << BITS[kind]


def cast(value: object, kind: str) -> object:
    """The value as one of the kind, or CastError. Numbers become booleans by being other than 0; texts become numbers,
    booleans, days and times only as a whole, without blanks; floats are cut towards zero."""
    own = literal_kind(value)
    if own == kind or kind == "json":
        return value
    made = None
    if kind == "string" and own != "binary":
        made = text_of(value)
    elif own in ("string", "entity_id"):
        made = _from_text(text_of(value), kind)
    elif own in NUMBERS:
        if kind == "bool":
            made = bool(value)
        elif kind in BITS:
            made = int(value) if not isinstance(value, float) or math.isfinite(value) else None
            made = made if made is not None and _fits(made, kind) else None
        elif kind == "f64":
            made = float(value)
        elif kind == "decimal":
            made = decimal.Decimal(value) if not isinstance(value, float) or math.isfinite(value) else None
    elif own == "bool" and kind in NUMBERS:
        made = cast(int(value), kind)
    elif own == "date" and kind == "timestamp":
        made = datetime.datetime.combine(value, datetime.time())
    if made is None:
        raise CastError(f"{value!r} does not fit {kind}")
    return made


def _from_text(text: str, kind: str) -> object:
    if kind in BITS:
        return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) and _fits(int(text), kind) else None
    if kind == "decimal":
        return decimal.Decimal(text) if _NUMBER.fullmatch(text) else None
    if kind == "f64":
        return float(text) if _NUMBER.fullmatch(text) or re.fullmatch(r"[+-]?(inf(inity)?|nan)", text, re.I) else None
    if kind == "bool":
        return True if text.lower() in TRUE else False if text.lower() in FALSE else None
    if kind == "entity_id":
        return S.EntityId(text) if re.fullmatch(r"[A-Za-z0-9_-]{43}|[0-9a-f]{64}", text) else None
    if kind in ("date", "timestamp") and re.match(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        try:
            return datetime.date.fromisoformat(text) if kind == "date" else datetime.datetime.fromisoformat(text)
        except ValueError:
            return None
    return None
