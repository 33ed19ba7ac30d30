"""Registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import casts
from tidemark.functions import text as edits
from tidemark.operators import eventlog
from tidemark.operators.compile import Compiler, marked, numbered, ordering, resolve, select
from tidemark.operators.policy import EVERYTHING, PRIVILEGED, AccessDenied, Policy, Rules, Scope
from tidemark.plans import selection as S
from tidemark.sources.catalog import Catalog
from tidemark.sources.collection import EVENTS, Collection, Model, Property
from tidemark.sources.context import Context
from tidemark.sources.tables import ensure_checkpoints, follow, get, get_batch, scratch, table
from tidemark.streaming import live

QUERIES, ORACLES = {}, {}


def _add(name, run, sql):
    QUERIES[name], ORACLES[name] = run, sql


def _plain(name, of, key, what, where, columns="*"):
    """A selection of one table against a WHERE clause."""
    _add(name, lambda spark, d: select(table(spark, d, of), what() if callable(what) else what, name=of, key=key).select(*columns.split(", ")), f"SELECT {columns} FROM {of} WHERE {where}")


_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_E = "event_id, user_id, event_type, value, props"
for _op, _name in (("=", "eq"), ("<>", "ne"), (">", "gt"), (">=", "gte"), ("<", "lt"), ("<=", "lte")):
    _plain(f"filter_{_name}", "orders", "o_orderkey", f"o_custkey {_op} 70", f"o_custkey {_op} 70", _O)
_plain("filter_in", "events", "event_id", "event_type IN ('purchase', 'click')", "event_type IN ('purchase', 'click')", _E)
_plain("filter_in_single", "events", "event_id", "event_type IN ('purchase')", "event_type = 'purchase'", _E)
_plain("filter_not_in", "events", "event_id", "event_type NOT IN ('purchase', 'click')", "event_type NOT IN ('purchase', 'click')", _E)
_plain("filter_and_or_left_assoc", "orders", "o_orderkey", "o_orderstatus = 'F' OR o_custkey < 50 AND o_totalprice > 1000", "(o_orderstatus = 'F' OR o_custkey < 50) AND o_totalprice > 1000", _O)
_plain("filter_parens", "orders", "o_orderkey", "o_orderstatus = 'F' OR (o_custkey < 50 AND o_totalprice > 1000)", "o_orderstatus = 'F' OR (o_custkey < 50 AND o_totalprice > 1000)", _O)
_plain("filter_not", "orders", "o_orderkey", "NOT (o_orderstatus = 'F' OR o_custkey < 50)", "NOT (o_orderstatus = 'F' OR o_custkey < 50)", _O)
_plain("filter_missing_column", "events", "event_id", "nosuch = 1 OR value > 100", "value > 100", _E)
_plain("filter_missing_column_null", "events", "event_id", "nosuch IS NULL AND value > 100", "value > 100", _E)
_plain("filter_col_col", "lineitem", "l_orderkey", "l_discount > l_tax", "l_discount > l_tax", "l_orderkey, l_linenumber, l_discount, l_tax")
_plain("filter_literal_left", "orders", "o_orderkey", "100 < o_custkey", "100 < o_custkey", _O)
_plain("filter_bool_const", "region", "r_regionkey", "true", "TRUE")
_plain("empty_scan", "orders", "o_orderkey", "o_custkey > 50 AND o_custkey < 30", "FALSE", _O)
_plain("filter_string_number_cast", "orders", "o_orderkey", "o_custkey = '70' OR o_orderstatus = 1", "o_custkey = 70 OR o_orderstatus = '1'", _O)
_plain("filter_uncastable", "orders", "o_orderkey", "o_custkey = 'x7' OR o_custkey = 70", "o_custkey = 70", _O)
_plain("bind_placeholders", "orders", "o_orderkey", lambda: S.bind(S.parse("o_custkey > ? AND o_orderstatus = ?"), [70, "F"]), "o_custkey > 70 AND o_orderstatus = 'F'", _O)
_plain("bind_in_list", "events", "event_id", lambda: S.template("event_type IN {kinds}", kinds=["purchase", "view"]), "event_type IN ('purchase', 'view')", _E)
_plain("template_named", "orders", "o_orderkey", lambda: S.template("{o_orderstatus} AND {>o_custkey}", o_orderstatus="F", o_custkey=70), "o_orderstatus = 'F' AND o_custkey > 70", _O)
_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"
_plain("json_path_eq", "events", "event_id", "props.k = 87", f"{_K} = 87", _E)
_plain("json_path_range", "events", "event_id", "props.k > 50 AND props.k <= 80", f"{_K} > 50 AND {_K} <= 80", _E)
_plain("json_path_in", "events", "event_id", "props.k IN (1, 2, 3)", f"{_K} IN (1, 2, 3)", _E)
_plain("json_path_cross_type", "events", "event_id", "props.k = '87'", "FALSE", _E)
_plain("json_path_cross_type_ne", "events", "event_id", "props.k != '87'", "TRUE", _E)
_plain("json_missing_path", "events", "event_id", "props.none.deep = 1", "FALSE", _E)
_plain("json_qualified_path", "events", "event_id", "events.props.k >= 95", f"{_K} >= 95", _E)
_plain("pk_range", "orders", "o_orderkey", "o_orderkey >= 100 AND o_orderkey < 200", "o_orderkey >= 100 AND o_orderkey < 200", _O)
_LABELLED = "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left")


_add("filter_is_null", lambda spark, d: select(_labelled(spark, d), "quality IS NULL"), f"SELECT * FROM ({_LABELLED}) WHERE quality IS NULL")
_add("filter_is_not_null", lambda spark, d: select(_labelled(spark, d), "lang = 'en' AND quality IS NOT NULL"), f"SELECT * FROM ({_LABELLED}) WHERE lang = 'en' AND quality IS NOT NULL")


def _taken(name, of, key, what, order, limit, columns, where="TRUE", numbered=True):
    """An ordered selection; with a limit the place of each row shows the order."""

    def run(spark, d):
        df = select(table(spark, d, of), what, key=key)
        chosen = S.parse(what)
        return df.select(*columns.split(", "), F.row_number().over(W.orderBy(*ordering(df, chosen, key))).cast("long").alias("place"))

    _add(name, run, f"SELECT {columns}, place FROM (SELECT {columns}, row_number() OVER (ORDER BY {order}) AS place FROM {of} WHERE {where}) WHERE place <= {limit}")


_taken("minimum_slice", "events", "event_id", "event_type = 'purchase' AND value > 100 ORDER BY value DESC LIMIT 10", "value DESC, event_id", 10, "event_id, event_type, value", "event_type = 'purchase' AND value > 100")
_taken("topk_asc", "orders", "o_orderkey", "ORDER BY o_totalprice LIMIT 25", "o_totalprice, o_orderkey", 25, _O)
_taken("topk_desc", "orders", "o_orderkey", "ORDER BY o_totalprice DESC LIMIT 25", "o_totalprice DESC, o_orderkey", 25, _O)
_taken("topk_mixed", "orders", "o_orderkey", "ORDER BY o_orderstatus DESC, o_totalprice LIMIT 40", "o_orderstatus DESC, o_totalprice, o_orderkey", 40, _O)
_taken("limit_zero", "orders", "o_orderkey", "LIMIT 0", "o_orderkey", 0, _O)
_taken("limit_n", "orders", "o_orderkey", "o_custkey > 10 LIMIT 33", "o_orderkey", 33, _O, "o_custkey > 10")
_taken("order_by_id_desc", "orders", "o_orderkey", "ORDER BY o_orderkey DESC LIMIT 50", "o_orderkey DESC", 50, _O)
_taken("order_multi_mixed", "nation", "n_nationkey", "ORDER BY n_regionkey DESC, n_name LIMIT 25", "n_regionkey DESC, n_name, n_nationkey", 25, "n_nationkey, n_name, n_regionkey")


def _page(spark, d):
    orders = table(spark, d, "orders")
    order = (S.Order("o_orderstatus", True), S.Order("o_custkey"))
    return select(orders, S.Selection(S.after(order, "o_orderkey", {"o_orderstatus": "F", "o_custkey": 50, "o_orderkey": 100}), order, 30), key="o_orderkey").select(*_O.split(", "))


_add("page_next", _page, f"SELECT {_O} FROM orders WHERE o_orderstatus < 'F' OR (o_orderstatus = 'F' AND (o_custkey > 50 OR (o_custkey = 50 AND o_orderkey > 100))) ORDER BY o_orderstatus DESC, o_custkey, o_orderkey LIMIT 30")
_add("get_by_id", lambda spark, d: get(table(spark, d, "customer"), "c_custkey", 42), "SELECT * FROM customer WHERE c_custkey = 42")
_add("get_batch", lambda spark, d: get_batch(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))), "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_add("ref_follow", lambda spark, d: follow(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey").select("o_orderkey", "c_name", "c_mktsegment"), "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")

POLICY = Policy({"clerk": {"read"}, "chief": {"read", "all"}, "guest": set()}, {"customer": Rules("read", scopes=(Scope("c_nationkey = $jwt.custom.nation", "all", "read"),))})
_CLERK = [{"roles": ["clerk"], "custom": {"nation": n}} for n in (3, 7)]


def _scoped(credentials):
    return lambda spark, d: select(table(spark, d, "customer"), POLICY.narrow("customer", S.parse("c_acctbal > 0"), credentials))


_add("policy_scope_read", _scoped(_CLERK[:1]), "SELECT * FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3")
_add("policy_union", _scoped(_CLERK), "SELECT * FROM customer WHERE c_acctbal > 0 AND (c_nationkey = 3 OR c_nationkey = 7)")
_add("policy_unscoped", _scoped([{"roles": ["chief"], "custom": {}}]), "SELECT * FROM customer WHERE c_acctbal > 0")
_add("policy_denied", _scoped([{"roles": ["guest"]}]), "SELECT * FROM customer WHERE FALSE")

_LOG = """WITH RECURSIVE rows_ AS (SELECT user_id AS entity, event_id AS event, event_type AS property, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
wanted AS (SELECT entity, event, (k - 1) // 2 AS pk FROM rows_ WHERE k >= 1 UNION ALL SELECT entity, event, (k - 1) // 2 + 1 FROM rows_ WHERE k >= 5 AND k % 5 = 0),
parents AS (SELECT w.entity, w.event, r.event AS parent FROM wanted w JOIN rows_ r ON r.entity = w.entity AND r.k = w.pk),
paths AS (SELECT entity, event, parent AS ancestor, 1 AS depth FROM parents UNION SELECT p.entity, p.event, q.parent, p.depth + 1 FROM paths p JOIN parents q ON q.entity = p.entity AND q.event = p.ancestor)
"""


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ensure_checkpoints(spark)
    events, parents = eventlog.forked_log(table(spark, d, "events"))
    return events.checkpoint(), parents.checkpoint()


_add("log_generations", lambda spark, d: eventlog.generations(*_log(spark, d)), _LOG + "SELECT r.entity, r.event, CAST(coalesce(max(p.depth), 0) AS BIGINT) AS generation FROM rows_ r LEFT JOIN paths p ON p.entity = r.entity AND p.event = r.event GROUP BY ALL")
_add("log_heads", lambda spark, d: eventlog.heads(*_log(spark, d)), _LOG + "SELECT entity, event FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.entity = r.entity AND p.parent = r.event)")
_add("log_ancestors", lambda spark, d: eventlog.ancestors(*_log(spark, d)), _LOG + "SELECT DISTINCT entity, event, ancestor FROM paths")
_add("lww_state", lambda spark, d: eventlog.lww_state(*_log(spark, d)), _LOG + """, lost AS (SELECT DISTINCT p.entity, w.property, p.ancestor AS event FROM paths p JOIN rows_ w ON w.entity = p.entity AND w.event = p.event)
SELECT entity, property, max(event) AS event, arg_max(value, event) AS value FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.entity = r.entity AND l.property = r.property AND l.event = r.event) GROUP BY ALL""")

_HALF = "event_id % 3 <> 0"


def _states(spark, d):
    """Two states of the users' spending: from some events, and from all of them."""
    events = table(spark, d, "events")
    of = lambda e: e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return of(events.where(_HALF)), of(events)


_BEFORE, _AFTER = f"(SELECT user_id, count(*) AS n FROM events WHERE {_HALF} GROUP BY 1)", "(SELECT user_id, count(*) AS n FROM events GROUP BY 1)"
_DIFF = "SELECT CASE WHEN b.user_id IS NULL THEN 'add' WHEN a.user_id IS NULL THEN 'remove' ELSE 'update' END AS change_type, coalesce(a.user_id, b.user_id) AS user_id FROM b FULL JOIN a ON a.user_id = b.user_id WHERE b.user_id IS NULL OR a.user_id IS NULL OR a.n <> b.n"
_add("live_initial", lambda spark, d: live.initial(_states(spark, d)[1], "n > 60", "user_id"), f"SELECT 'initial' AS change_type, * FROM {_AFTER} WHERE n > 60")
_add("live_changes", lambda spark, d: live.live_changes(*_states(spark, d), "n > 40", "user_id"), f"WITH b AS (SELECT * FROM {_BEFORE} WHERE n > 40), a AS (SELECT * FROM {_AFTER} WHERE n > 40) {_DIFF}")
_add("live_gap_fill", lambda spark, d: live.live_changes(*_states(spark, d), "n < 70 ORDER BY n DESC LIMIT 20", "user_id"), f"WITH b AS (SELECT * FROM {_BEFORE} WHERE n < 70 ORDER BY n DESC, user_id LIMIT 20), a AS (SELECT * FROM {_AFTER} WHERE n < 70 ORDER BY n DESC, user_id LIMIT 20) {_DIFF}")
_add("live_update_selection", lambda spark, d: live.live_changes(*(2 * [_states(spark, d)[1]]), "n > 60", "user_id", "n > 50 AND n < 70"), f"WITH b AS (SELECT * FROM {_AFTER} WHERE n > 60), a AS (SELECT * FROM {_AFTER} WHERE n > 50 AND n < 70) {_DIFF}")


def _compared(spark, d):
    events, parents = _log(spark, d)
    pairs = events.select("entity", "event", F.lead("event").over(W.partitionBy("entity").orderBy("event")).alias("other")).where("other IS NOT NULL").select("entity", F.col("event").alias("subject"), "other")
    asked = pairs.select("entity", F.array("subject").alias("subject"), F.array("other").alias("other"))
    return eventlog.compare(asked, events, parents).select("entity", F.col("subject")[0].alias("subject"), F.col("other")[0].alias("other"), "verdict")


_add("log_compare", _compared, _LOG + """, pairs AS (SELECT entity, event AS subject, lead(event) OVER (PARTITION BY entity ORDER BY event) AS other FROM rows_)
SELECT entity, subject, other, CASE WHEN EXISTS (SELECT 1 FROM paths p WHERE p.entity = q.entity AND p.event = q.subject AND p.ancestor = q.other) THEN 'descends'
  WHEN EXISTS (SELECT 1 FROM paths p WHERE p.entity = q.entity AND p.ancestor = q.subject AND p.event = q.other) THEN 'ascends'
  WHEN EXISTS (SELECT 1 FROM paths p JOIN paths o ON o.entity = p.entity AND o.ancestor = p.ancestor WHERE p.entity = q.entity AND p.event = q.subject AND o.event = q.other) THEN 'diverged' ELSE 'disjoint' END AS verdict
FROM pairs q WHERE other IS NOT NULL""")


def _deltas(spark, d):
    events, parents = _log(spark, d)
    known = events.where("entity % 3 <> 0").groupBy("entity").agg(F.array(F.max("event")).alias("head"))
    return eventlog.deltas(known, events, parents)


_add("delta_snapshot_or_bridge", _deltas, _LOG + """, known AS (SELECT entity, max(event) AS event FROM rows_ WHERE entity % 3 <> 0 GROUP BY 1),
held AS (SELECT * FROM known UNION SELECT p.entity, p.ancestor FROM paths p JOIN known k ON k.entity = p.entity AND k.event = p.event),
missing AS (SELECT entity, count(*) AS n FROM (SELECT entity, event FROM rows_ EXCEPT SELECT entity, event FROM held) GROUP BY 1)
SELECT e.entity, CASE WHEN k.entity IS NULL THEN 'snapshot' WHEN m.n IS NULL THEN 'current' ELSE 'bridge' END AS kind, CASE WHEN k.entity IS NULL THEN 0 ELSE coalesce(m.n, 0) END::BIGINT AS n_events
FROM (SELECT DISTINCT entity FROM rows_) e LEFT JOIN known k USING (entity) LEFT JOIN missing m ON m.entity = e.entity""")


def _casts(spark, d):
    text = F.expr("CASE event_id % 5 WHEN 0 THEN ' 30 ' WHEN 1 THEN '30' WHEN 2 THEN 'abc' WHEN 3 THEN '99999999999' ELSE 'YES' END")
    return table(spark, d, "events").select("event_id", casts.text_to_int(text).alias("i"), casts.text_to_int(text, "bigint").alias("l"), casts.text_to_bool(text).alias("b"))


_add("cast_text", _casts, "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 30 END::INTEGER AS i, CASE event_id % 5 WHEN 1 THEN 30 WHEN 3 THEN 99999999999 END::BIGINT AS l, CASE event_id % 5 WHEN 4 THEN TRUE END AS b FROM events")


def _json_casts(spark, d):
    made = F.expr("""CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('{"k":"', user_id, '"}') WHEN 2 THEN '{"k":true}' WHEN 3 THEN '{"k":70000}' ELSE '{}' END""")
    value = F.try_variant_get(F.try_parse_json(made), "$.k", "variant")
    held = table(spark, d, "events").select("event_id", value.alias("v"))
    return held.select("event_id", casts.json_kind(F.col("v")).alias("kind"), *(casts.json_to(F.col("v"), k).alias(k) for k in ("i16", "i64", "string", "bool")))


_add("cast_json", _json_casts, """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'string' WHEN 2 THEN 'bool' WHEN 4 THEN NULL ELSE 'integer' END AS kind,
  CASE event_id % 5 WHEN 0 THEN CAST(json_extract(props, '$.k') AS SMALLINT) END AS i16,
  CASE event_id % 5 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN 3 THEN 70000 END::BIGINT AS i64,
  CASE event_id % 5 WHEN 1 THEN CAST(user_id AS VARCHAR) END AS string, CASE event_id % 5 WHEN 2 THEN TRUE END AS bool FROM events""")


def _number_casts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", casts.float_to_int(F.col("o_totalprice")).alias("i"), casts.number_to_bool(F.col("o_custkey") % 2).alias("b"), casts.float_to_text(F.col("o_custkey").cast("double")).alias("t"))


_add("cast_number", _number_casts, "SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS i, o_custkey % 2 <> 0 AS b, CAST(o_custkey AS VARCHAR) AS t FROM orders")

# --- reconciliation of kinds

_TEXT = "CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR(20)) WHEN 1 THEN 'x' WHEN 2 THEN 'yes' ELSE '07' END"


def _made(name, what, where, columns, made):
    """A selection of events with further columns, made by the same SQL on both sides (Spark's form may differ)."""
    spark_made, sql_made = made if isinstance(made, tuple) else (made, made)
    run = lambda spark, d: select(table(spark, d, "events").selectExpr("*", *(f"{e} AS {n}" for n, e in spark_made.items())), what() if callable(what) else what, name="events", key="event_id").select(*columns.split(", "))
    _add(name, run, f"SELECT {columns} FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in sql_made.items())} FROM events) WHERE {where}")


_plain("filter_text_bounds_number", "orders", "o_orderkey", "o_custkey >= '9' AND o_custkey <= '100'", "o_custkey >= 9 AND o_custkey <= 100", _O)
_plain("filter_text_bounds_double", "orders", "o_orderkey", "o_totalprice > '9000' AND o_totalprice < '100000.5'", "o_totalprice > 9000 AND o_totalprice < 100000.5", _O)
_plain("filter_number_bounds_text", "customer", "c_custkey", "c_mktsegment > 10 AND c_mktsegment < 'C'", "c_mktsegment > '10' AND c_mktsegment < 'C'")
_plain("filter_date_text", "orders", "o_orderkey", "o_orderdate >= '1995-02-01' AND o_orderdate < '1995-03-01 12:00:00' OR o_orderdate = 'soon'", "o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1995-03-01 12:00:00'", _O)
_plain("filter_not_missing", "events", "event_id", "NOT (nosuch = 1) AND value > 100", "value > 100", _E)
_plain("filter_id_column", "orders", "o_orderkey", "id >= 100 AND orders.id < 120", "o_orderkey >= 100 AND o_orderkey < 120", _O)
_plain("filter_float_literal", "orders", "o_orderkey", "o_custkey > 69.5 AND o_custkey <= 71.0", "o_custkey > 69 AND o_custkey <= 71", _O)
_plain("filter_huge_literal", "orders", "o_orderkey", "o_custkey < 99999999999999999999 AND o_custkey > 100", "o_custkey > 100", _O)
_plain("filter_strict_precedence", "orders", "o_orderkey", lambda: S.parse("o_orderstatus = 'F' OR o_custkey < 50 AND o_totalprice > 1000", strict=True), "o_orderstatus = 'F' OR (o_custkey < 50 AND o_totalprice > 1000)", _O)
_plain("filter_unparsed", "customer", "c_custkey", lambda: S.parse(S.to_sql(S.parse("c_name != 'it''s' AND (c_nationkey = 3 OR NOT (c_acctbal < 0))"))), "c_name <> 'it''s' AND (c_nationkey = 3 OR NOT (c_acctbal < 0))")
_plain("template_operators", "orders", "o_orderkey", lambda: S.template("{>=o_custkey} AND {<o_totalprice} AND o_orderstatus <> {}", "P", o_custkey=70, o_totalprice=90000.0), "o_custkey >= 70 AND o_totalprice < 90000 AND o_orderstatus <> 'P'", _O)
_plain("default_order_id", "orders", "o_orderkey", "o_custkey < 5", "o_custkey < 5", _O)
_plain("json_col_col", "events", "event_id", "props.k > user_id", f"{_K} > user_id", _E)
_made("filter_col_col_mixed", "user_id = t", "(event_id % 4 = 0) OR (event_id % 4 = 3 AND user_id = 7)", "event_id, user_id, t", ({"t": _TEXT.replace("VARCHAR(20)", "STRING")}, {"t": _TEXT}))
_made("filter_bool_text", "flag = t", "(event_id % 4 = 2 AND flag) OR (event_id % 4 = 0 AND ((user_id = 0 AND NOT flag) OR (user_id = 1 AND flag)))", "event_id, flag, t", ({"t": _TEXT.replace("VARCHAR(20)", "STRING"), "flag": "user_id % 2 = 1"}, {"t": _TEXT, "flag": "user_id % 2 = 1"}))
_made("filter_bool_literals", "flag = 'yes' AND flag != 'abc' AND flag = 1", "flag", "event_id, flag", {"flag": "user_id % 2 = 1"})
_made("json_quoted_path", """p."a b"."x.y" = 7 OR p."a b".z > 'm'""", "event_id % 10 = 7 OR event_type > 'm'", "event_id, event_type", {"p": """concat('{"a b":{"x.y":', event_id % 10, ',"z":"', event_type, '"}}')"""})
_made("json_whole_numbers", "p.k = 9007199254740993 OR p.k > 9007199254740995", "event_id % 7 = 1 OR event_id % 7 > 3", "event_id", {"p": """concat('{"k":', 9007199254740992 + event_id % 7, '}')"""})
_made("json_kinds_apart", "p.k = '5' OR p.k = 5 OR p.k = true", "event_id % 5 IN (0, 1, 2)", "event_id", {"p": """concat('{"k":', CASE event_id % 5 WHEN 0 THEN '5' WHEN 1 THEN '"5"' WHEN 2 THEN 'true' WHEN 3 THEN 'null' ELSE '[5]' END, '}')"""})
_add("filter_outcome", lambda spark, d: marked(_labelled(spark, d), "quality = 1 AND lang = 'en'").select("doc_id", "outcome"), f"SELECT doc_id, CASE WHEN quality = 1 AND lang = 'en' THEN 'pass' WHEN (quality = 1 AND lang = 'en') IS NULL THEN 'error' ELSE 'skip' END AS outcome FROM ({_LABELLED})")


def _resolved(spark, d):
    orders = table(spark, d, "orders")
    chosen = S.parse("o_custkey = '70' OR o_orderstatus = 1 OR o_custkey = 'x'")
    return select(orders, S.Selection(resolve(chosen.where, Compiler(orders.schema))), key="o_orderkey").select(*_O.split(", "))


_add("resolve_literals", _resolved, f"SELECT {_O} FROM orders WHERE o_custkey = 70 OR o_orderstatus = '1'")

# --- order and pages


def _nulls_first(spark, d):
    df, chosen = _labelled(spark, d), S.parse("ORDER BY quality DESC, lang LIMIT 500")
    return numbered(select(df, chosen, key="doc_id"), chosen, "doc_id", ["doc_id", "quality", "lang"])


_add("order_nulls_first", _nulls_first, f"SELECT * FROM (SELECT doc_id, quality, lang, row_number() OVER (ORDER BY quality DESC NULLS FIRST, lang NULLS FIRST, doc_id) AS place FROM ({_LABELLED})) WHERE place <= 500")
_MIXED = """CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN CAST(user_id AS {text}) WHEN 3 THEN concat(CAST(user_id AS {text}), '.5') WHEN 4 THEN concat('"', event_type, '"') ELSE 'false' END"""


def _json_order(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", f"parse_json({_MIXED.format(text='STRING')}) AS v")
    return numbered(df, "ORDER BY v", "event_id", ["event_id"])


_add("order_json", _json_order, """SELECT event_id, row_number() OVER (ORDER BY CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 5 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END, CASE event_id % 6 WHEN 1 THEN 1 WHEN 5 THEN 0 END,
  CASE event_id % 6 WHEN 2 THEN user_id WHEN 3 THEN user_id END, CASE event_id % 6 WHEN 4 THEN event_type END, event_id) AS place FROM events""")


def _page_null(spark, d):
    order = (S.Order("quality", True), S.Order("lang"))
    where = S.after(order, "doc_id", {"quality": None, "lang": "fr", "doc_id": 100})
    return select(_labelled(spark, d), S.Selection(where, order, 2000), key="doc_id")


_add("page_next_null", _page_null, f"SELECT * FROM ({_LABELLED}) WHERE quality IS NOT NULL OR lang > 'fr' OR (lang = 'fr' AND doc_id > 100) ORDER BY quality DESC NULLS FIRST, lang NULLS FIRST, doc_id LIMIT 2000")
_plain("page_expand", "events", "event_id", "event_type = 'view' AND event_id <= 900 ORDER BY event_id DESC LIMIT 33", "event_id IN (SELECT event_id FROM events WHERE event_type = 'view' AND event_id <= 900 ORDER BY event_id DESC LIMIT 33)", _E)

# --- policy

_LOCKED = Policy(
    {"clerk": {"read", "write"}, "finder": {"find"}, "root": {EVERYTHING}, "guest": set()},
    {"customer": Rules("read", "write", (Scope("c_nationkey = $jwt.custom.nation", None, "read"), Scope("c_acctbal >= 0 AND c_nationkey = $jwt.custom.nation", "all", "write")), retrieve="find")},
)
_AT = lambda role, **custom: {"roles": [role], "custom": custom}


def _outcomes(spark, d):
    """Who may select what: the rows, or -1 where it is refused."""
    rows, out = table(spark, d, "customer"), []
    cases = [("unlisted", "supplier", [_AT("guest")]), ("unlisted_clerk", "supplier", [_AT("clerk")]), ("unlisted_root", "supplier", [_AT("root")]), ("privileged", "supplier", [PRIVILEGED]), ("no_credentials", "customer", []), ("missing_claim", "customer", [_AT("clerk")]), ("guest", "customer", [_AT("guest")]), ("finder", "customer", [_AT("finder", nation=3)])]
    for case, name, credentials in cases:
        try:
            found = select(rows, _LOCKED.narrow(name, S.Selection(), credentials)).agg(F.count(F.lit(1)).alias("n"))
        except AccessDenied:
            found = spark.range(1).select(F.lit(-1).cast("long").alias("n"))
        out.append(found.select(F.lit(case).alias("case"), "n"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


_add("policy_unlisted", _outcomes, """SELECT * FROM (VALUES ('unlisted', -1::BIGINT), ('unlisted_clerk', -1), ('no_credentials', -1), ('missing_claim', -1), ('guest', 0), ('finder', 0)) t("case", n)
UNION ALL SELECT 'unlisted_root', count(*) FROM customer UNION ALL SELECT 'privileged', count(*) FROM customer""")
_add("policy_missing_claim", lambda spark, d: select(table(spark, d, "customer"), _LOCKED.narrow("customer", S.parse("c_acctbal > 0"), [_AT("clerk"), _AT("clerk", nation=3)])), "SELECT * FROM customer WHERE c_acctbal > 0 AND c_nationkey = 3")
_add("policy_write", lambda spark, d: _LOCKED.refused("customer", table(spark, d, "customer"), _AT("clerk", nation=3)), "SELECT * FROM customer WHERE NOT (c_acctbal >= 0 AND c_nationkey = 3)")
_add("policy_retrieve", lambda spark, d: _LOCKED.readable("customer", table(spark, d, "customer").where("c_custkey < 60"), [_AT("finder", nation=3), _AT("finder", nation=5)]), "SELECT * FROM customer WHERE c_custkey < 60 AND c_nationkey IN (3, 5)")

# --- event log: orders, clocks, bridges

_DEPTH = "deep AS (SELECT r.entity, r.event, coalesce(max(p.depth), 0) AS generation FROM rows_ r LEFT JOIN paths p ON p.entity = r.entity AND p.event = r.event GROUP BY ALL)"
_add("log_topological", lambda spark, d: eventlog.topological(*_log(spark, d)), _LOG + f", {_DEPTH} SELECT entity, event, row_number() OVER (PARTITION BY entity ORDER BY generation, event) - 1 AS place FROM deep")


def _tips(spark, d):
    """The log, and of each entity with 3 events or more the last three by place: last, before, earlier; and the middle one."""
    events, parents = _log(spark, d)
    src = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("event"), "ts")
    k = F.row_number().over(W.partitionBy("entity").orderBy("ts", "event")) - 1
    n = F.count(F.lit(1)).over(W.partitionBy("entity"))
    at = lambda x: F.max(F.when(x, F.col("event")))
    tips = src.select("entity", "event", k.alias("k"), n.alias("n")).groupBy("entity").agg(F.max("n").alias("n"), at(F.expr("k = n - 1")).alias("last"), at(F.expr("k = n - 2")).alias("before"), at(F.expr("k = n - 3")).alias("earlier"), at(F.expr("k = n div 2")).alias("middle"), at(F.expr("k = 0")).alias("first"))
    return events, parents, tips.where("n >= 3")


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _meets(spark, d):
    events, parents, tips = _tips(spark, d)
    found = eventlog.compare(tips.select("entity", F.array("last", "earlier").alias("subject"), F.array("before").alias("other")), events, parents)
    return found.select("entity", "verdict", *(_joined(c).alias(c) for c in ("meet", "subject_next", "other_next")), "n_subject", "n_other")


_add("log_meet", _meets, _LOG + """, n AS (SELECT entity, count(*) AS n FROM rows_ GROUP BY 1 HAVING count(*) >= 3),
clock AS (SELECT r.entity, r.event, CASE WHEN k = n - 2 THEN 'o' ELSE 's' END AS side FROM rows_ r JOIN n USING (entity) WHERE k >= n - 3),
past AS (SELECT entity, side, event FROM clock UNION SELECT c.entity, c.side, p.ancestor FROM clock c JOIN paths p ON p.entity = c.entity AND p.event = c.event),
common AS (SELECT entity, event FROM past WHERE side = 's' INTERSECT SELECT entity, event FROM past WHERE side = 'o'),
tips AS (SELECT entity, event FROM common c WHERE NOT EXISTS (SELECT 1 FROM parents q JOIN common x ON x.entity = q.entity AND x.event = q.event WHERE q.entity = c.entity AND q.parent = c.event)),
alone AS (SELECT * FROM past p WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.entity = p.entity AND c.event = p.event)),
next_ AS (SELECT DISTINCT a.entity, a.side, a.event FROM alone a JOIN parents q ON q.entity = a.entity AND q.event = a.event JOIN tips t ON t.entity = q.entity AND t.event = q.parent),
verdicts AS (SELECT entity, CASE WHEN entity NOT IN (SELECT entity FROM alone WHERE side = 'o') THEN 'descends' WHEN entity NOT IN (SELECT entity FROM alone WHERE side = 's') THEN 'ascends' ELSE 'diverged' END AS verdict FROM n)
SELECT v.entity, verdict,
  CASE WHEN verdict = 'diverged' THEN (SELECT string_agg(event::VARCHAR, ',' ORDER BY event) FROM tips t WHERE t.entity = v.entity) ELSE '' END AS meet,
  CASE WHEN verdict = 'diverged' THEN coalesce((SELECT string_agg(event::VARCHAR, ',' ORDER BY event) FROM next_ t WHERE t.entity = v.entity AND side = 's'), '') ELSE '' END AS subject_next,
  CASE WHEN verdict = 'diverged' THEN coalesce((SELECT string_agg(event::VARCHAR, ',' ORDER BY event) FROM next_ t WHERE t.entity = v.entity AND side = 'o'), '') ELSE '' END AS other_next,
  (SELECT count(*) FROM alone a WHERE a.entity = v.entity AND side = 's') AS n_subject, (SELECT count(*) FROM alone a WHERE a.entity = v.entity AND side = 'o') AS n_other
FROM verdicts v""")


def _layers(spark, d):
    events, parents, tips = _tips(spark, d)
    return eventlog.layers(tips.select("entity", F.array("first").alias("meet"), F.array("before").alias("head"), F.array("last").alias("incoming")), events, parents)


_PAST = """, n AS (SELECT entity, count(*) AS n FROM rows_ GROUP BY 1 HAVING count(*) >= 3),
own AS (SELECT entity, event, event AS up FROM rows_ UNION ALL SELECT entity, event, ancestor FROM (SELECT DISTINCT entity, event, ancestor FROM paths))"""
_add("log_layers", _layers, _LOG + _PAST + f""", {_DEPTH},
past AS (SELECT DISTINCT r.entity, o.up AS event, r.k = n.n - 2 AS applied FROM rows_ r JOIN n USING (entity) JOIN own o ON o.entity = r.entity AND o.event = r.event WHERE r.k >= n.n - 2)
SELECT p.entity, generation - 1 AS layer, p.event, bool_or(applied) AS applied FROM past p JOIN deep g ON g.entity = p.entity AND g.event = p.event WHERE generation > 0 GROUP BY ALL""")


def _classified(spark, d):
    events, parents, tips = _tips(spark, d)
    return eventlog.classify(events, tips.where("entity % 5 <> 0").select("entity", F.array("middle").alias("head")), events, parents)


_add("log_classify", _classified, _LOG + _PAST + """, head AS (SELECT r.entity, r.event FROM rows_ r JOIN n USING (entity) WHERE r.k = n // 2 AND r.entity % 5 <> 0)
SELECT r.entity, r.event, CASE WHEN h.event IS NULL THEN CASE WHEN r.k = 0 THEN 'create' ELSE 'reject' END WHEN EXISTS (SELECT 1 FROM own o WHERE o.entity = r.entity AND o.event = h.event AND o.up = r.event) THEN 'ignore'
  WHEN EXISTS (SELECT 1 FROM own o WHERE o.entity = r.entity AND o.event = r.event AND o.up = h.event) THEN 'apply' ELSE 'merge' END AS effect FROM rows_ r LEFT JOIN head h USING (entity)""")


def _adopted(spark, d):
    events, parents, tips = _tips(spark, d)
    return eventlog.adopt(tips.select("entity", F.array("last").alias("head")), tips.where("entity % 5 <> 0").select("entity", F.array(F.when(F.col("entity") % 2 == 0, F.col("before")).otherwise(F.col("middle"))).alias("head")), events, parents)


_add("log_adopt", _adopted, _LOG + _PAST + """, heads_ AS (SELECT n.entity, max(CASE WHEN r.k = n - 1 THEN event END) AS incoming, CASE WHEN n.entity % 5 <> 0 THEN max(CASE WHEN r.k = CASE WHEN n.entity % 2 = 0 THEN n - 2 ELSE n // 2 END THEN event END) END AS held FROM n JOIN rows_ r USING (entity) GROUP BY n.entity)
SELECT entity, CASE WHEN held IS NULL OR EXISTS (SELECT 1 FROM own o WHERE o.entity = h.entity AND o.event = h.incoming AND o.up = h.held) THEN 'adopt' ELSE 'needs_events' END AS action FROM heads_ h""")


def _bridged(spark, d):
    events, parents = _log(spark, d)
    known = events.where("entity % 3 <> 0").groupBy("entity").agg(F.array(F.max("event")).alias("head"))
    return eventlog.bridges(known, events, parents)


_BRIDGE = """, known AS (SELECT entity, max(event) AS event FROM rows_ WHERE entity % 3 <> 0 GROUP BY 1),
held AS (SELECT entity, event FROM known UNION SELECT p.entity, p.ancestor FROM paths p JOIN known k ON k.entity = p.entity AND k.event = p.event),
missing AS (SELECT entity, event FROM rows_ WHERE entity IN (SELECT entity FROM known) EXCEPT SELECT entity, event FROM held),
lines AS (SELECT entity, event, 0 AS d FROM missing UNION SELECT q.entity, q.event, l.d + 1 FROM lines l JOIN parents q ON q.entity = l.entity AND q.parent = l.event),
sent AS (SELECT entity, event, max(d) AS layer FROM lines GROUP BY ALL)
"""
_add("log_bridge_events", _bridged, _LOG + _BRIDGE + """SELECT entity, 'bridge' AS kind, row_number() OVER (PARTITION BY entity ORDER BY layer, event) - 1 AS place, event FROM sent
UNION ALL SELECT DISTINCT entity, CASE WHEN entity % 3 = 0 THEN 'snapshot' ELSE 'current' END, 0, NULL::BIGINT FROM rows_ WHERE entity NOT IN (SELECT entity FROM sent)""")
_add("log_memberships", lambda spark, d: eventlog.memberships(table(spark, d, "events").select(F.col("user_id").alias("entity"), F.array("event_type").alias("added"))).select("entity", F.array_join("models", ",").alias("models")), "SELECT user_id AS entity, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS models FROM events GROUP BY 1")


def _faulty(spark, d):
    kind = F.expr("CASE event_id % 7 WHEN 0 THEN 'genesis' WHEN 6 THEN 'other' ELSE 'update' END")
    above = F.expr("CASE WHEN event_id % 3 = 0 THEN array() ELSE array(event_id - 1) END")
    rows = table(spark, d, "events").select(F.expr("CASE WHEN event_id % 2 = 0 THEN event_id ELSE user_id END").alias("entity"), F.col("event_id").alias("event"), kind.alias("kind"), above.alias("parents"))
    return eventlog.faults(rows).where("fault IS NOT NULL").select("event", "fault")


_add("log_invalid", _faulty, """SELECT event, fault FROM (SELECT event_id AS event, CASE WHEN event_id % 7 = 6 THEN 'unknown_kind' WHEN event_id % 7 = 0 AND event_id % 3 <> 0 THEN 'genesis_with_parent' WHEN event_id % 7 = 0 AND event_id % 2 <> 0 AND event_id <> user_id THEN 'genesis_id_mismatch'
  WHEN event_id % 7 <> 0 AND event_id % 3 = 0 THEN 'update_without_parent' END AS fault FROM events) WHERE fault IS NOT NULL""")


def _lined(spark, d):
    """Each user's events in line, each adding its type at the end of a text."""
    src = table(spark, d, "events").withColumn("before", F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    rows = src.select(F.col("user_id").alias("entity"), F.col("event_id").alias("event"), F.lit("log").alias("property"), F.lit(0).alias("seq"), F.lit(2**31 - 1).alias("at"), F.lit(0).alias("removed"), F.concat("event_type", F.lit(" ")).alias("inserted"))
    parents = src.where("before IS NOT NULL").select(F.col("user_id").alias("entity"), F.col("event_id").alias("event"), F.col("before").alias("parent"))
    return eventlog.text_state(rows, parents)


_add("text_merge", _lined, "SELECT user_id AS entity, 'log' AS property, string_agg(event_type || ' ', '' ORDER BY ts, event_id) AS value FROM events GROUP BY 1")

# --- collections: events, states, versions, live queries

_KINDS = ("click", "error", "purchase", "signup", "view")
USER = Model("user", {k: Property("f64") for k in _KINDS})


def _events(spark, d):
    """The log as event rows, and k, the place of an event: ids as text of equal length, so that they order as the
    numbers do."""
    events, parents = _log(spark, d)
    above = parents.groupBy("event").agg(F.collect_list(F.lpad(F.col("parent").cast("string"), 12, "0")).alias("above"))
    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    placed = table(spark, d, "events").select(F.col("event_id").alias("event"), place.alias("k"))
    rows = events.join(above, "event", "left").join(placed, "event")
    made = {"event_id": F.lpad(F.col("event").cast("string"), 12, "0"), "entity_id": F.col("entity").cast("string"), "kind": F.when(F.col("above").isNull(), "genesis").otherwise("update"), "parents": F.coalesce("above", F.expr("cast(array() as array<string>)")), "added": F.array(F.lit("user")), "property": F.col("property"), "backend": F.lit("lww"), "value": F.get_json_object(F.to_json(F.struct("value")), "$.value")}
    return rows.select("k", *(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS)).checkpoint()


def _collection(spark, d):
    """Two commits: the first 10 events of each user, then all others."""
    made, log = Collection(spark, scratch(spark, "user"), USER), _events(spark, d)
    for where in ("k < 10", "k >= 10"):
        rows = log.where(where)
        made.add_events(rows)
        made.rebuild(rows.select("entity_id"))
    return made


def _of(states):
    return states.select("id", _joined("head").alias("head"), F.array_join("models", ",").alias("models"), *_KINDS)


def _folded(where):
    """SQL of the states that some of the events give."""
    return f"""{_LOG}, kept AS (SELECT * FROM rows_ WHERE {where}), ways AS (SELECT p.* FROM paths p JOIN kept USING (entity, event)),
lost AS (SELECT DISTINCT p.entity, w.property, p.ancestor AS event FROM ways p JOIN kept w ON w.entity = p.entity AND w.event = p.event),
best AS (SELECT entity, property, arg_max(value, event) AS value FROM kept r WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.entity = r.entity AND l.property = r.property AND l.event = r.event) GROUP BY ALL),
tops AS (SELECT entity, string_agg(lpad(event::VARCHAR, 12, '0'), ',' ORDER BY event) AS head FROM kept r WHERE NOT EXISTS (SELECT 1 FROM parents q JOIN kept c ON c.entity = q.entity AND c.event = q.event WHERE q.entity = r.entity AND q.parent = r.event) GROUP BY 1),
states AS (SELECT t.entity::VARCHAR AS id, head, 'user' AS models, {", ".join(f"max(CASE WHEN property = '{k}' THEN value END) AS {k}" for k in _KINDS)} FROM tops t JOIN best b USING (entity) GROUP BY ALL)
"""


_add("state_upsert", lambda spark, d: _of(_collection(spark, d).states()), _folded("TRUE") + "SELECT * FROM states")
_add("state_version", lambda spark, d: _of(_collection(spark, d).states(1)), _folded("k < 10") + "SELECT * FROM states")
_add("state_fetch", lambda spark, d: _of(_collection(spark, d).fetch_states("user.purchase > 50 ORDER BY view DESC LIMIT 20")), _folded("TRUE") + "SELECT * FROM states WHERE purchase > 50 ORDER BY view DESC NULLS FIRST, id LIMIT 20")


def _compacted(spark, d):
    made = _collection(spark, d)
    made.compact()
    made.vacuum(made.version())
    made.rebuild(spark.createDataFrame([("3",)], "entity_id string"))
    return _of(made.states())


_add("state_compacted", _compacted, ORACLES["state_upsert"])


def _idempotent(spark, d):
    """Events that are added twice, by their id and by their entity."""
    made = Collection(spark, scratch(spark, "user"), USER)
    for _ in range(2):
        made.add_events(_events(spark, d).where("CAST(entity_id AS INT) < 20"))
    points = made.get_events([f"{k:012d}" for k in range(0, 500, 5)] + ["nosuch"])
    return points.select(F.lit("point").alias("read"), "event_id", "property").unionByName(made.entity_events("7").select(F.lit("entity").alias("read"), "event_id", "property"))


_add("event_reads", _idempotent, "SELECT 'point' AS read, lpad(event_id::VARCHAR, 12, '0') AS event_id, event_type AS property FROM events WHERE event_id < 500 AND event_id % 5 = 0 AND user_id < 20 UNION ALL SELECT 'entity', lpad(event_id::VARCHAR, 12, '0'), event_type FROM events WHERE user_id = 7")


def _live(what, **options):
    def run(spark, d):
        sets = []
        query = live.LiveQuery(_collection(spark, d), what, lambda rows, version: sets.append(rows), "", **options)
        query.step(2)
        none = query.collection.states(2).limit(0).select(F.lit("").alias("change_type"), "id")
        return sets[0].select("change_type", "id") if sets else none

    return run


def _live_sql(where, tail=""):
    one = lambda name, rows: f"{name} AS (SELECT * FROM ({_folded(rows)} SELECT * FROM states) WHERE {where} {tail})"
    return f"WITH {one('b', 'k < 10')}, {one('a', 'TRUE')} SELECT CASE WHEN b.id IS NULL THEN 'add' WHEN a.id IS NULL THEN 'remove' ELSE 'update' END AS change_type, coalesce(a.id, b.id) AS id FROM b FULL JOIN a ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR (a.head, a.view, a.purchase, a.click, a.error, a.signup) IS DISTINCT FROM (b.head, b.view, b.purchase, b.click, b.error, b.signup)"


_add("live_commit", _live("purchase > 50 AND view < 100"), _live_sql("purchase > 50 AND view < 100"))
_add("live_commit_limited", _live("purchase > 20 ORDER BY purchase DESC LIMIT 25"), _live_sql("purchase > 20", "ORDER BY purchase DESC NULLS FIRST, id LIMIT 25"))
_add("live_entities", _live("", ids=[str(k) for k in range(0, 150, 7)]), _live_sql("id::INT % 7 = 0 AND id::INT < 150"))
_add("live_reset", lambda spark, d: live.reset(select(_states(spark, d)[1], "n > 60", key="user_id"), "user_id"), f"SELECT 'remove' AS change_type, user_id FROM {_AFTER} WHERE n > 60")


def _subscribed(spark, d):
    events, parents = _log(spark, d)
    known = events.where("entity % 3 <> 0").groupBy("entity").agg(F.array(F.max("event")).alias("head"))
    states = _states(spark, d)[1].withColumnRenamed("user_id", "entity")
    sent = live.subscription_deltas(states, "n > 65", known.where("entity < 60"), events, parents, key="entity")
    return sent.groupBy("entity", "kind").agg(F.count("event").alias("n_events"))


_add("live_subscription", _subscribed, _LOG + _BRIDGE + """, counts AS (SELECT entity, count(*) AS n FROM rows_ GROUP BY 1), peer AS (SELECT entity FROM known WHERE entity < 60),
told AS (SELECT entity FROM counts WHERE n > 65 UNION SELECT entity FROM peer)
SELECT t.entity, CASE WHEN t.entity IN (SELECT entity FROM peer) THEN 'bridge' ELSE 'snapshot' END AS kind, CASE WHEN t.entity IN (SELECT entity FROM peer) THEN (SELECT count(*) FROM sent s WHERE s.entity = t.entity) ELSE 0 END AS n_events
FROM told t WHERE t.entity NOT IN (SELECT entity FROM peer) OR EXISTS (SELECT 1 FROM sent s WHERE s.entity = t.entity)""")


def _expanded(spark, d):
    states = _states(spark, d)[1]
    return eventlog.expand_known(select(states, "n > 70", key="user_id"), spark.range(0, 5000, 11).select(F.col("id").alias("user_id")), states, "user_id")


_add("known_matches", _expanded, f"SELECT * FROM {_AFTER} WHERE n > 70 OR (user_id % 11 = 0 AND user_id < 5000)")


def _results(spark, d):
    context = Context(spark)
    context.register("orders", table(spark, d, "orders"), "o_orderkey")
    found = context.results("orders", "o_totalprice > 100000 ORDER BY o_totalprice DESC LIMIT 50")
    return spark.createDataFrame([(len(found), len(found.ids()), found.ids()[0] in found, -1 in found)], "n int, ids int, first_in boolean, other_in boolean")


_add("result_set", _results, "SELECT CAST(least(50, count(*)) AS INTEGER) AS n, CAST(least(50, count(*)) AS INTEGER) AS ids, TRUE AS first_in, FALSE AS other_in FROM orders WHERE o_totalprice > 100000")
_add("derived_values", lambda spark, d: select(table(spark, d, "orders"), "o_totalprice > 1000", key="o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("highest")), "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS highest FROM orders WHERE o_totalprice > 1000 GROUP BY 1")


def _cataloged(spark, d):
    """A model for each region, with a property for each of its nations, registered twice; then one property renamed."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").collect()
    models = {}
    for r in rows:
        models.setdefault(r["r_name"], {})[r["n_name"]] = Property("i64", target=None)
    catalog = Catalog(spark, scratch(spark, "catalog"))
    whole = [Model(name, of) for name, of in sorted(models.items())]
    catalog.register(whole)
    assert catalog.register(whole).empty
    first = whole[0]
    old = sorted(first.properties)[0]
    catalog.register([Model(first.name, {"renamed": Property("i64")})], renamed={first.name: {old: "renamed"}})
    return catalog.counts().unionByName(catalog.table("property").where("name = 'renamed'").agg(F.lit("renamed").alias("kind"), F.count(F.lit(1)).alias("n")))


_add("catalog_counts", _cataloged, "SELECT 'model' AS kind, count(DISTINCT n_regionkey) AS n FROM nation UNION ALL SELECT 'property', count(*) FROM nation UNION ALL SELECT 'membership', count(*) FROM nation UNION ALL SELECT 'renamed', 1")

# --- functions


def _to_json(spark, d):
    v = lambda c: F.to_json(casts.to_json_value(c))
    return table(spark, d, "events").select("event_id", v(F.col("event_type")).alias("t"), v(F.col("user_id")).alias("i"), v(F.col("user_id") % 2 == 0).alias("b"))


_add("cast_to_json", _to_json, """SELECT event_id, '"' || event_type || '"' AS t, user_id::VARCHAR AS i, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS b FROM events""")


def _json_helpers(spark, d):
    v = F.col("v")
    held = table(spark, d, "events").select("event_id", casts.parse_as_json(F.expr("""CASE event_id % 5 WHEN 0 THEN '{"a":{"b":null,"c":"d"}}' WHEN 1 THEN '{"a":[1]}' WHEN 2 THEN '{"a":{"b":3}}' WHEN 3 THEN 'nonsense' ELSE '{}' END""")).alias("v"))
    return held.select("event_id", casts.json_is_object(casts.json_at(v, "a")).alias("obj"), casts.json_is_array(casts.json_at(v, "a")).alias("arr"), F.coalesce(casts.json_is_null(casts.json_at(v, "a", "b")), F.lit(False)).alias("nul"), F.to_json(casts.json_at(v, "a", "b")).alias("b"))


_add("json_helpers", _json_helpers, "SELECT event_id, event_id % 5 IN (0, 2) AS obj, event_id % 5 = 1 AS arr, event_id % 5 = 0 AS nul, CASE event_id % 5 WHEN 0 THEN 'null' WHEN 2 THEN '3' END AS b FROM events")
_add("in_range", lambda spark, d: table(spark, d, "orders").where(casts.is_in_range(F.col("o_totalprice"), 5000.0, 9000.0, upper_in=False) & casts.is_in_range(F.col("o_custkey"), lower=10, lower_in=False)).select(*_O.split(", ")), f"SELECT {_O} FROM orders WHERE o_totalprice >= 5000 AND o_totalprice < 9000 AND o_custkey > 10")


def _ids(spark, d):
    raw = F.unhex(F.sha2(F.col("c_name"), 256))
    text = casts.entity_id_text(raw)
    return table(spark, d, "customer").select("c_custkey", text.alias("id"), casts.entity_id_short(text).alias("short"), casts.text_is_entity_id(text).alias("valid"), (casts.entity_id_bytes(text) == raw).alias("same"))


_IDTEXT = "replace(replace(rtrim(to_base64(from_hex(sha256(c_name))), '='), '+', '-'), '/', '_')"
_add("entity_ids", _ids, f"SELECT c_custkey, {_IDTEXT} AS id, substr({_IDTEXT}, 1, 6) AS short, TRUE AS valid, TRUE AS same FROM customer")


def _text_edits(spark, d):
    t = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", edits.insert(t, 3, "--").alias("i"), edits.delete(t, 2, 4).alias("x"), edits.overwrite(t, F.col("c_nationkey"), 2, "é").alias("o"))


_add("text_edits", _text_edits, "SELECT c_custkey, substr(c_name, 1, 3) || '--' || substr(c_name, 4) AS i, substr(c_name, 1, 2) || substr(c_name, 7) AS x, substr(c_name, 1, c_nationkey) || 'é' || substr(c_name, c_nationkey + 3) AS o FROM customer")
