"""Casts of the value model: null where a value does not fit, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelled booleans.
TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def text_to_int(c: Column, kind: str = "int") -> Column:
    """Digits with a sign, no blanks around; out of range is null."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast(kind))


def text_to_bool(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)


def float_to_int(c: Column, kind: str = "int") -> Column:
    """Finite numbers, cut towards zero; out of range is null."""
    return F.when(~F.isnan(c), c.try_cast(kind))


def bool_to_int(c: Column, kind: str = "int") -> Column:
    return c.cast(kind)


def text_is_entity_id(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]{43}$")


def entity_id_bytes(c: Column) -> Column:
    """The 32 bytes that ids are ordered by."""
    return F.unbase64(F.concat(F.translate(c, "-_", "+/"), F.lit("=")))


def text_to_float(c: Column) -> Column:
    """Decimal text with an optional exponent, and the spelled infinities and not-a-number; no blanks around."""
    number = c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    low = F.regexp_replace(F.lower(c), r"^\+", "")
    return F.when(number, c.try_cast("double")).when(low.isin("inf", "infinity", "-inf", "-infinity", "nan", "-nan"), F.regexp_replace(F.regexp_replace(low, "inf(inity)?", "Infinity"), "-?nan", "NaN").try_cast("double"))


def number_to_bool(c: Column) -> Column:
    return c != F.lit(0)


def float_to_text(c: Column) -> Column:
    """A whole number has no fraction part: 1.0 is "1". Others keep the digits that tell them from their neighbours."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return F.when(F.isnan(c), F.lit("NaN")).when(whole, c.cast("decimal(20,0)").cast("string")).when(F.abs(c) == F.lit(float("inf")), F.when(c > 0, "inf").otherwise("-inf")).otherwise(c.cast("string"))


def entity_id_text(c: Column) -> Column:
    """Text form of 32 bytes; null for any other length."""
    return F.when(F.length(c) == 32, F.regexp_replace(F.translate(F.base64(c), "+/", "-_"), "=+$", ""))


# Which kinds a kind casts to, besides itself.
NUMBERS = ("i16", "i32", "i64", "f64")
CASTABLE = {
    "string": {"entity_id", "bool", "json", *NUMBERS},
    "entity_id": {"string"},
    "bool": {"string", "json", *NUMBERS},
    "json": {"string", "bool", *NUMBERS},
    **{n: {"string", "bool", "json", *NUMBERS} - {n} for n in NUMBERS},
}


def castable(kind: str, to: str) -> bool:
    return kind == to or to in CASTABLE.get(kind, ())


def mutually_castable(a: str, b: str) -> bool:
    return castable(a, b) and castable(b, a)


def json_kind(v: Column) -> Column:
    """Of a VARIANT: integer, number, string, bool, object, array or null."""
    of = F.schema_of_variant(v)
    return (
        F.when(of == "BIGINT", "integer").when(of.startswith("DECIMAL"), "number").when(of.isin("DOUBLE", "FLOAT"), "number")
        .when(of == "STRING", "string").when(of == "BOOLEAN", "bool").when(of.startswith("OBJECT"), "object").when(of.startswith("ARRAY"), "array").when(of == "VOID", "null")
    )


def json_to(v: Column, kind: str) -> Column:
    """A JSON scalar of the kind asked for, else null: text from text, integers from integers in range, floats from
    any number, booleans from booleans."""
    of = json_kind(v)
    allowed, target = {"string": (["string"], "string"), "bool": (["bool"], "boolean"), "i16": (["integer"], "smallint"), "i32": (["integer"], "int"), "i64": (["integer"], "bigint"), "f64": (["integer", "number"], "double")}[kind]
    return F.when(of.isin(*allowed), F.try_variant_get(v, "$", target))


def to_json_value(c: Column) -> Column:
    """A scalar as a VARIANT of its own kind; null stays null."""
    return F.try_variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")


def parse_as_json(c: Column) -> Column:
    """The VARIANT that a text or UTF-8 bytes hold; null if they hold none."""
    return F.try_parse_json(c.cast("string"))


def json_is_null(v: Column) -> Column:
    return F.is_variant_null(v)


def json_is_object(v: Column) -> Column:
    return F.coalesce(json_kind(v) == "object", F.lit(False))


def json_is_array(v: Column) -> Column:
    return F.coalesce(json_kind(v) == "array", F.lit(False))


def json_at(v: Column, *steps: str) -> Column:
    """What lies at a path of object keys; null where there is no such key, and inside arrays."""
    return F.try_variant_get(v, "$" + "".join(f'["{s}"]' for s in steps), "variant")


def is_in_range(c: Column, lower: object = None, upper: object = None, *, lower_in: bool = True, upper_in: bool = True) -> Column:
    """Whether a value lies between two bounds, each in or out; None is no bound. NaN is above all numbers."""
    out = F.lit(True)
    if lower is not None:
        out = out & ((c >= F.lit(lower)) if lower_in else (c > F.lit(lower)))
    if upper is not None:
        out = out & ((c <= F.lit(upper)) if upper_in else (c < F.lit(upper)))
    return F.when(c.isNotNull(), out)


def entity_id_short(c: Column, length: int = 6) -> Column:
    """The first characters of an id's text, enough to tell ids apart in print."""
    return F.substring(c, 1, length)
