import base64

import pytest
from pyspark.sql import functions as F

from tidemark.functions import casts


def _values(spark, rows, kind, what):
    return [r[0] for r in spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, c {kind}").orderBy("k").select(what(F.col("c"))).collect()]


def test_text_to_float(spark):
    got = _values(spark, ["1", "-2.5e1", ".5", "3.", " 1", "x", "", None, "inf", "-Infinity"], "string", casts.text_to_float)
    assert got == [1.0, -25.0, 0.5, 3.0, None, None, None, None, float("inf"), float("-inf")]


def test_number_texts(spark):
    assert _values(spark, [1.0, -2.0, 0.5, None, float("inf"), float("nan")], "double", casts.float_to_text) == ["1", "-2", "0.5", None, "inf", "NaN"]
    assert _values(spark, [0, 3, None], "int", casts.number_to_bool) == [False, True, None]


def test_entity_ids_round_trip(spark):
    ids = [base64.urlsafe_b64encode(bytes([k * 37 % 256] * 32)).decode().rstrip("=") for k in range(9)]
    assert _values(spark, ids, "string", lambda c: casts.entity_id_text(casts.entity_id_bytes(c))) == ids


@pytest.mark.parametrize("kind,want", [("i16", [5, None, None, None, None, None, None, None]), ("i64", [5, 70000, None, None, None, None, None, None]), ("f64", [5.0, 70000.0, 1.5, None, None, None, None, None]), ("string", [None, None, None, "a", None, None, None, None]), ("bool", [None, None, None, None, True, None, None, None])])
def test_json_scalars_keep_their_kind(spark, kind, want):
    rows = ["5", "70000", "1.5", '"a"', "true", "null", "[1]", None]
    assert _values(spark, rows, "string", lambda c: casts.json_to(F.try_parse_json(c), kind)) == want


def test_castable():
    assert casts.castable("string", "i64") and not casts.castable("entity_id", "bool")
    assert casts.mutually_castable("i16", "f64") and casts.mutually_castable("string", "entity_id")
