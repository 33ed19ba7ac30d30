"""A selection over a DataFrame: columns, order and limit as Catalyst expressions.

The column's kind decides a comparison. A literal is cast to it before the plan is made, so that filters reach the
scan; where it does not fit, the column's value is cast to the literal's kind row by row, and where that does not fit
either, nothing matches. Two columns of unlike kinds go the same way, the right one cast first; numbers of any kinds
compare as numbers. A JSON value compares within its kind alone: numbers, texts, booleans; across kinds only != holds.
NaN is unlike everything, itself included, and has no order.
"""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import casts
from tidemark.plans import literals as L
from tidemark.plans import selection as S

MOST = 2**31 - 1  # of a limit in Spark
_SPARK = {"i16": "smallint", "i32": "int", "i64": "bigint", "f64": "double", "bool": "boolean", "string": "string", "date": "date"}


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _lit(value: object) -> Column:
    if isinstance(value, S.EntityId):
        return F.lit(value.text)
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        return F.lit(str(value)).try_cast("decimal(38,0)")
    return F.lit(value)


def cast_column(c: Column, of: str, to: str) -> Column | None:
    """c, of a kind, as another kind: null where a value does not fit; None where no value ever does."""
    if of == to:
        return c
    if of == "string":
        if to in ("i16", "i32", "i64"):
            return casts.text_to_int(c, _SPARK[to])
        made = {"f64": casts.text_to_float, "bool": casts.text_to_bool}.get(to)
        if made:
            return made(c)
        if to == "decimal":
            return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), c.try_cast("decimal(38,18)"))
        return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), c.try_cast("date" if to == "date" else "timestamp_ntz")) if to in ("date", "timestamp") else None
    if to == "string":
        return casts.float_to_text(c.cast("double")) if of == "f64" else None if of in ("other", "binary", "json") else c.cast("string")
    if of in L.NUMBERS and to == "bool":
        return casts.number_to_bool(c)
    if of == "bool" and to in L.NUMBERS:
        return c.cast("int")
    if {of, to} == {"date", "timestamp"}:
        return c.cast("timestamp_ntz") if to == "timestamp" else None
    return None


class Compiler:
    """schema: of the rows; name: the collection's, which a path may begin with; key: what `id` stands for."""

    def __init__(self, schema: T.StructType, name: str | None = None, key: str | None = None):
        self.types = {f.name: f.dataType for f in schema}
        self.name, self.key = name, key

    def path(self, p: S.Path) -> tuple[str | None, tuple[str, ...]]:
        """Column (None if there is none) and the steps into it."""
        steps = p.steps[1:] if len(p.steps) > 1 and p.steps[0] == self.name and p.steps[0] not in self.types else p.steps
        if steps[0] == "id" and "id" not in self.types and self.key:
            steps = (self.key, *steps[1:])
        return (steps[0] if steps[0] in self.types else None), steps[1:]

    def missing(self, p: S.Path) -> bool:
        return self.path(p)[0] is None

    def side(self, p: S.Path) -> tuple[Column, str]:
        """The column expression of a path and its kind; "json" for what lies inside a JSON text or VARIANT."""
        column, steps = self.path(p)
        at, of = F.col(f"`{column}`"), self.types[column]
        for k, step in enumerate(steps):
            if isinstance(of, T.StructType):
                found = {f.name: f.dataType for f in of}
                if step not in found:
                    return F.lit(None).cast("string"), "string"
                at, of = at.getField(step), found[step]
            elif isinstance(of, (T.StringType, T.VariantType)):
                value = at if isinstance(of, T.VariantType) else F.try_parse_json(at)
                return F.try_variant_get(value, "$" + "".join(f'["{x}"]' for x in steps[k:]), "variant"), "json"
            else:
                return F.lit(None).cast("string"), "string"
        return at, L.kind_of(of)

    def where(self, node: object) -> Column:
        return self._where(S.assume_null(node, self.missing))

    def _where(self, node: object) -> Column:
        if isinstance(node, S.Const):
            return F.lit(node.value)
        if isinstance(node, S.Both):
            left, right = self._where(node.left), self._where(node.right)
            return left & right if node.op == "and" else left | right
        if isinstance(node, S.Not):
            return ~self._where(node.of)
        if isinstance(node, S.IsNull):
            return self.is_null(node.of)
        if isinstance(node, S.In):
            return ~self.any_of(node) if node.negated else self.any_of(node)
        if isinstance(node, S.Cmp):
            return self.compare(node.op, node.left, node.right)
        raise S.BindingFault("a placeholder has no value")

    def is_null(self, of: object) -> Column:
        if isinstance(of, S.Lit):
            return F.lit(of.value is None)
        at, kind = self.side(of)
        return at.isNull() | F.is_variant_null(at) if kind == "json" else at.isNull()

    def any_of(self, node: S.In) -> Column:
        if isinstance(node.left, S.Path) and all(isinstance(x, S.Lit) for x in node.items):
            at, kind = self.side(node.left)
            if kind not in ("json", "f64", "other"):
                fit = [v for x in node.items if (v := self.fitting(kind, x.value)) is not None]
                if len(fit) == len(node.items):
                    return at.isin(*[_lit(v) for v in fit])
        out = None
        for item in node.items:
            one = F.lit(False) if isinstance(item, S.Path) and self.missing(item) else self.compare("=", node.left, item)
            out = one if out is None else out | one
        return out

    def fitting(self, kind: str, value: object) -> object:
        """The literal as the column's kind compares it as a whole; None if it does not. Numbers stay what they are
        beside numbers: 1.5 is no whole number's equal."""
        if kind in L.NUMBERS and L.literal_kind(value) in L.NUMBERS:
            if isinstance(value, float) and kind != "f64" and math.isfinite(value) and value.is_integer():
                value = int(value)
            return value
        try:
            return L.cast(value, kind)
        except L.CastError:
            return None

    def compare(self, op: str, left: object, right: object) -> Column:
        if isinstance(left, S.Lit) and isinstance(right, S.Path):
            return self.compare(S._FLIP[op], right, left)
        if isinstance(left, S.Lit):
            return F.lit(_plain(op, left.value, right.value))
        if isinstance(right, S.Path):
            return self.columns(op, self.side(left), self.side(right))
        at, kind = self.side(left)
        return _json_literal(op, at, right.value) if kind == "json" else self.typed(op, at, kind, right.value)

    def typed(self, op: str, at: Column, kind: str, value: object) -> Column:
        own = L.literal_kind(value)
        if kind == "f64" and own in L.NUMBERS and not isinstance(value, float) and abs(value) >= 2**53:
            return _compared(op, at, "f64", _lit(float(value)), "f64")
        if own == "f64" and kind != "f64" and kind in L.NUMBERS and (math.isnan(value) or math.isinf(value)):
            return _compared(op, at.cast("double"), "f64", _lit(value), "f64")
        fit = self.fitting(kind, value)
        if fit is not None:
            return _compared(op, at, kind, _lit(fit), "f64" if isinstance(fit, float) else kind)
        turned = cast_column(at, kind, own)
        if turned is None:
            return F.when(at.isNotNull(), F.lit(False))
        return F.when(turned.isNotNull(), _compared(op, turned, own, _lit(value), own)).when(at.isNotNull(), F.lit(False))

    def columns(self, op: str, left: tuple[Column, str], right: tuple[Column, str]) -> Column:
        (a, ka), (b, kb) = left, right
        if "json" in (ka, kb):
            return _json_pair(op, a, ka, b, kb)
        if ka == kb or {ka, kb} <= set(L.NUMBERS):
            return F.lit(None).cast("boolean") if ka == "other" else _compared(op, a, ka, b, kb)
        there, back = cast_column(b, kb, ka), cast_column(a, ka, kb)
        out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean"))
        if there is not None:
            out = out.when(there.isNotNull(), _compared(op, a, ka, there, ka))
        if back is not None:
            out = out.when(back.isNotNull(), _compared(op, back, kb, b, kb))
        return out.otherwise(F.lit(False))


def _plain(op: str, a: object, b: object) -> bool:
    """Two literals: the right one as the left one's kind, else the other way round, else false."""
    if {L.literal_kind(a), L.literal_kind(b)} - set(L.NUMBERS):
        for one, other in ((a, b), (b, a)):
            try:
                turned = L.cast(other, L.literal_kind(one))
            except L.CastError:
                continue
            a, b = (one, turned) if one is a else (turned, one)
            break
        else:
            return False
    a, b = (x.text if isinstance(x, S.EntityId) else x for x in (a, b))
    return {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]


def _compared(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    """Values of one kind, or two numbers."""
    made = _apply(op, a, b)
    for c, k in ((a, ka), (b, kb)):
        if k == "f64":
            made = made | F.isnan(c.cast("double")) if op == "!=" else made & ~F.isnan(c.cast("double"))
    return made


def _json_kind(at: Column) -> Column:
    of = F.schema_of_variant(at)
    return F.when(of == "BIGINT", "whole").when(of.rlike(r"^DECIMAL\([0-9]+,0\)"), "whole").when(of.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(of == "STRING", "text").when(of == "BOOLEAN", "bool")


def _json_values(at: Column) -> dict[str, Column]:
    return {k: F.try_variant_get(at, "$", t) for k, t in (("whole", "decimal(38,0)"), ("number", "double"), ("text", "string"), ("bool", "boolean"))}


def _json_literal(op: str, at: Column, value: object) -> Column:
    kind, of = _json_kind(at), _json_values(at)
    if isinstance(value, float) and math.isfinite(value) and value.is_integer():
        value = int(value)
    across = F.when(at.isNotNull() & ~F.is_variant_null(at), F.lit(op == "!="))
    if isinstance(value, bool):
        return F.when(kind == "bool", _apply(op, of["bool"], F.lit(value))).otherwise(across)
    if isinstance(value, (str, S.EntityId, datetime.date)):
        return F.when(kind == "text", _apply(op, of["text"], F.lit(L.text_of(value)))).otherwise(across)
    if isinstance(value, int):
        made = F.when(kind == "whole", _apply(op, of["whole"], F.lit(str(value)).cast("decimal(38,0)"))).when(kind == "number", _compared(op, of["number"], "f64", F.lit(float(value)), "f64"))
    else:
        made = F.when(kind.isin("whole", "number"), _compared(op, of["number"], "f64", F.lit(float(value)), "f64"))
    return made.otherwise(across)


def _json_pair(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    """JSON beside JSON or beside a column, whose value has the kind of its type."""

    def parts(c: Column, k: str) -> tuple[Column, dict[str, Column], Column]:
        if k == "json":
            return _json_kind(c), _json_values(c), c.isNotNull() & ~F.is_variant_null(c)
        name = {"i16": "whole", "i32": "whole", "i64": "whole", "f64": "number", "decimal": "number", "string": "text", "bool": "bool"}.get(k, "other")
        of = {"whole": c.cast("decimal(38,0)"), "number": c.cast("double")} if name == "whole" else {name: c.cast("double") if name == "number" else c}
        return F.lit(name), of, c.isNotNull()

    (one, x, here), (two, y, there) = parts(a, ka), parts(b, kb)
    out = F.when(~(here & there), F.lit(None).cast("boolean"))
    if "whole" in x and "whole" in y:
        out = out.when((one == "whole") & (two == "whole"), _apply(op, x["whole"], y["whole"]))
    if "number" in x and "number" in y:
        out = out.when(one.isin("whole", "number") & two.isin("whole", "number"), _compared(op, x["number"], "f64", y["number"], "f64"))
    for k in ("text", "bool"):
        if k in x and k in y:
            out = out.when((one == k) & (two == k), _apply(op, x[k], y[k]))
    return out.otherwise(F.lit(op == "!="))


def resolve(node: object, compiler: Compiler, must: bool = False) -> object:
    """The tree with every literal as the kind of the column beside it. One that does not fit stays, or, with must, is
    a CastError; what lies inside JSON keeps its own kind."""

    def change(n: object) -> object:
        if isinstance(n, S.Cmp):
            return S.Cmp(n.op, put(n.left, n.right), put(n.right, n.left))
        return S.In(n.left, tuple(put(x, n.left) for x in n.items), n.negated) if isinstance(n, S.In) else n

    def put(one: object, beside: object) -> object:
        if not isinstance(one, S.Lit) or not isinstance(beside, S.Path):
            return one
        if compiler.missing(beside):
            if must:
                raise L.CastError(f"there is no {S.to_sql(beside)}")
            return one
        try:
            return S.Lit(L.cast(one.value, compiler.side(beside)[1]))
        except L.CastError:
            if must:
                raise
            return one

    return S.walk(node, change)


def prepare(selection: S.Selection, compiler: Compiler | None = None) -> S.Selection:
    """The selection with an impossible predicate folded to FALSE, so that Catalyst plans an empty relation."""

    def typed(path: S.Path, value: object) -> object:
        if compiler is None:
            return value
        if compiler.missing(path):
            return None
        kind = compiler.side(path)[1]
        return value if kind == "json" else compiler.fitting(kind, value)

    where = selection.where if compiler is None else S.assume_null(selection.where, compiler.missing)
    if S.contradicts(where, typed):
        return S.Selection(S.Const(False), selection.order, selection.limit)
    return S.Selection(where, selection.order, selection.limit)


def json_order(at: Column) -> list[Column]:
    """Sort columns of a VARIANT: null, then booleans, whole numbers, other numbers, texts, and the rest by its text."""
    kind, of = _json_kind(at), _json_values(at)
    rank = F.when(at.isNull() | F.is_variant_null(at), 0).when(kind == "bool", 1).when(kind == "whole", 2).when(kind == "number", 3).when(kind == "text", 4).otherwise(5)
    return [rank, F.when(kind == "bool", of["bool"].cast("int")), F.when(kind == "whole", of["whole"]), F.when(kind == "number", of["number"]), F.when(kind == "text", of["text"]).when(rank == 5, F.to_json(at))]


def _order(df: DataFrame, selection: S.Selection, key: str | None) -> list[tuple[Column, bool]]:
    """What rows are ordered by, and whether it descends."""
    types, made = {f.name: f.dataType for f in df.schema}, []
    named = [(key if o.column == "id" and "id" not in types and key else o.column, o.descending) for o in selection.order]
    for column, descending in named:
        if column in types:
            at = F.col(f"`{column}`")
            made += [(p, descending) for p in (json_order(at) if isinstance(types[column], T.VariantType) else [at])]
    return made + ([(F.col(f"`{key}`"), False)] if key and all(c != key for c, _ in named) else [])


def ordering(df: DataFrame, selection: S.Selection, key: str | None) -> list[Column]:
    """Nulls first both ways; ties, and selections without an order, by the key. Columns that do not exist are left out."""
    return [c.desc_nulls_first() if descending else c.asc_nulls_first() for c, descending in _order(df, selection, key)]


def take(df: DataFrame, count: int) -> DataFrame:
    """The first count rows of df in its order. Spark's own limit ends at 2^31 - 1; beyond it rows are numbered by
    partition, of which only the sizes reach the driver."""
    if count <= MOST:
        return df.limit(count)
    from tidemark.sources.tables import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    kept = df.checkpoint()
    sizes, before, room = dict(kept.groupBy(F.spark_partition_id()).count().collect()), 0, {}
    for part in sorted(sizes):
        room[part] = max(0, min(sizes[part], count - before))
        before += sizes[part]
    if before <= count:
        return kept
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    allowed = F.create_map(*(F.lit(x) for pair in room.items() for x in pair))[F.spark_partition_id()]
    return kept.where(place < allowed)


def numbered(df: DataFrame, what: str | S.Selection, key: str, columns: list[str]) -> DataFrame:
    """columns of df and the place of each row in a selection's order, from 1. Rows are sorted by ranges of the order,
    one for a task, and counted by partition; of these only the sizes reach the driver."""
    from tidemark.sources.tables import ensure_checkpoints

    ensure_checkpoints(df.sparkSession)
    order = _order(df, S.parse(what) if isinstance(what, str) else what, key)
    # made before the sort, which would make them again for each comparison
    wide = df.select(*(f"`{c}`" for c in columns), *(c.alias(f"order {n}") for n, (c, _) in enumerate(order)))
    by = [F.col(f"`order {n}`") for n in range(len(order))]
    kept = wide.orderBy(*(c.desc_nulls_first() if descending else c.asc_nulls_first() for c, (_, descending) in zip(by, order, strict=True))).select(*(f"`{c}`" for c in columns)).checkpoint()
    part = F.spark_partition_id()
    sizes, starts = dict(kept.groupBy(part).count().collect()), [0]
    for number in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(number, 0))
    before = F.array(*(F.lit(n).cast("long") for n in starts))[part]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("place", before + within + 1)


def select(df: DataFrame, what: str | S.Selection, *, name: str | None = None, key: str | None = None) -> DataFrame:
    """Rows of df that a selection takes, in its order, up to its limit. Without an order rows go by the key where a
    limit makes the order matter."""
    compiler = Compiler(df.schema, name, key)
    chosen = prepare(S.parse(what) if isinstance(what, str) else what, compiler)
    out = df.where(compiler._where(chosen.where))
    order = ordering(df, chosen, key)
    if order and (chosen.order or chosen.limit is not None):
        out = out.orderBy(*order)
    return out if chosen.limit is None else take(out, chosen.limit)


def marked(df: DataFrame, what: str | S.Selection, *, name: str | None = None, key: str | None = None, column: str = "outcome") -> DataFrame:
    """All rows of df, each with what a selection's predicate makes of it: pass, skip, or error where a value that it
    needs is missing."""
    compiler = Compiler(df.schema, name, key)
    held = compiler.where((S.parse(what) if isinstance(what, str) else what).where)
    return df.withColumn(column, F.when(held, "pass").when(held.isNull(), "error").otherwise("skip"))
