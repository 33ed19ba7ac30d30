"""The typed comparison of columns, literals and JSON values, row by row."""

import datetime

import pytest

from tidemark.operators import compile as C
from tidemark.plans import literals as L
from tidemark.plans import selection as S

ROWS = [
    (1, 9, "9", True, 9.0, '{"k":9007199254740993,"j":9,"x.y":1,"a b":{"c":2},"t":"9","b":true}', datetime.date(2024, 1, 2)),
    (2, 10, "abc", False, float("nan"), '{"k":9007199254740992,"j":"9"}', None),
    (3, None, None, None, None, None, None),
]

CASES = [
    ("n >= '9' AND n <= '10'", [1, 2]), ("d >= '9' AND d < '10'", [1]), ("d > '9' AND d < '10'", []), ("s > 10 AND s < 95", [1]), ("s > 1 AND s < 95", [1]),
    ("n = s", [1]), ("s = n", [1]), ("flag = 'abc'", []), ("flag != 'abc'", [1, 2]), ("flag = 1", [1]), ("flag = 2", [1]), ("flag = s", []), ("d = flag", []),
    ("p.k = 9007199254740993", [1]), ("p.k = 9007199254740992", [2]), ("p.k > 9007199254740992", [1]), ("p.j = n", [1]), ("p.j > n", []), ("p.j != n", [2]), ("p.j = p.t", []), ("p.t = s", [1]), ("p.b = flag", [1]), ("p.b = true", [1]), ("p.b = 1", []),
    ('p."x.y" = 1', [1]), ('p."a b".c = 2', [1]), ("p.a.b = 1", []),
    ("day > '2024-01-01'", [1]), ("day = 'abc'", []), ("day != 'abc'", [1]), ("day = 5", []),
    ("NOT (nosuch = 1)", [1, 2, 3]), ("nosuch NOT IN (1)", [1, 2, 3]), ("nosuch = 1 OR n = 9", [1]), ("nosuch IS NULL", [1, 2, 3]), ("n = nosuch", []),
    ("d != 5", [1, 2]), ("d < 100", [1]), ("d = d", [1]), ("n = 9.5", []), ("n < 9.5", [1]), ("n = 9.0", [1]), ("n < -5", []),
    ("n IN (9, '10')", [1, 2]), ("n IN (9, 'x')", [1]), ("s IN (9, 'abc')", [1, 2]), ("p.j IN ('9', 9)", [1, 2]), ("n NOT IN (9)", [2]),
    ("n = 99999999999", []), ("n < 99999999999999999999999", [1, 2]), ("id = 1", [1]), ("p.k IS NULL", [3]), ("1 = '1'", [1, 2, 3]), ("1 = 'x'", []), ("n > 10 AND n < 9", []),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "pk int, n int, s string, flag boolean, d double, p string, day date").cache()


@pytest.mark.parametrize(("text", "wanted"), CASES)
def test_selection(rows, text, wanted):
    assert sorted(r.pk for r in C.select(rows, text, key="pk").collect()) == wanted


def test_an_impossible_conjunction_reads_nothing(rows):
    plan = lambda text: C.select(rows, text, key="pk")._jdf.queryExecution().optimizedPlan().toString()
    assert "<empty>" in plan("n > '10' AND n < '9'")
    assert "<empty>" not in plan("n >= '9' AND n <= '10'")


def test_literals_that_must_fit(rows):
    compiler = C.Compiler(rows.schema)
    assert C.resolve(S.parse("n = '9'").where, compiler, must=True) == S.parse("n = 9").where
    for text in ("n = 'x'", "flag = 'maybe'", "nosuch = 1", "day = 'soon'"):
        with pytest.raises(L.CastError):
            C.resolve(S.parse(text).where, compiler, must=True)
        assert C.resolve(S.parse(text).where, compiler) == S.parse(text).where


def test_limits_beyond_sparks_own(spark, monkeypatch):
    monkeypatch.setattr(C, "MOST", 5)
    df = spark.range(0, 100, 1, 7).withColumnRenamed("id", "k")
    assert [r.k for r in C.select(df, "ORDER BY k DESC LIMIT 31", key="k").collect()] == list(range(99, 68, -1))
    assert C.select(df, "LIMIT 500", key="k").count() == 100


@pytest.mark.parametrize(("value", "kind", "made"), [("9", "i32", 9), (" 9", "i32", None), ("40000", "i16", None), (2.9, "i64", 2), (float("inf"), "i64", None), ("YES", "bool", True), (2, "bool", True), (True, "f64", 1.0), (1.0, "string", "1"), ("x", "f64", None), ("2024-02-30", "date", None), (b"x", "string", None)])
def test_literal_casts(value, kind, made):
    if made is None:
        with pytest.raises(L.CastError):
            L.cast(value, kind)
    else:
        assert L.cast(value, kind) == made
        assert type(L.cast(value, kind)) is type(made)


def test_pages_cover_all_rows(spark):
    rows = [(k, None if k % 3 == 0 else k % 4, None if k % 5 == 0 else f"x{k % 2}") for k in range(40)]
    df = spark.createDataFrame(rows, "k int, a int, b string")
    for down in (False, True):
        order = (S.Order("a", down), S.Order("b"))
        whole = [tuple(r) for r in C.select(df, S.Selection(order=order), key="k").collect()]
        got, last = [], None
        while True:
            where = S.Const(True) if last is None else S.after(order, "k", last)
            page = C.select(df, S.Selection(where, order, 7), key="k").collect()
            if not page:
                break
            got += [tuple(r) for r in page]
            last = page[-1].asDict()
        assert got == whole


def test_places_in_an_order(spark):
    df = spark.range(0, 2000, 1, 7).selectExpr("id AS k", "CASE WHEN id % 3 > 0 THEN id % 10 END AS a", "id % 2 AS `b c`")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = C.numbered(df, "ORDER BY a DESC", "k", ["k", "b c"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.rdd.getNumPartitions() > 1
    wanted = sorted(range(2000), key=lambda k: (-(k % 10) if k % 3 else -99, k))
    assert sorted((r.place, r.k, r["b c"]) for r in got.collect()) == [(n, k, k % 2) for n, k in enumerate(wanted, 1)]
    assert C.numbered(df.limit(0), "", "k", ["k"]).collect() == []


def test_places_of_a_whole_table_take_no_single_task(spark):
    from tidemark.queries import QUERIES

    assert "Exchange SinglePartition" not in QUERIES["order_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
