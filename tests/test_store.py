"""Collections, contexts, policies and live queries end to end."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.policy import PRIVILEGED, AccessDenied, Permissive, Policy, Rules, Scope
from tidemark.plans import selection as S
from tidemark.sources.catalog import Catalog, RegistrationError
from tidemark.sources.collection import EVENTS, Model, Property
from tidemark.sources.context import Context, NotFound, UnknownCollection, nocache
from tidemark.streaming import live
from tidemark.streaming.signals import Calculated, Signal

ALBUM = Model("album", {"name": Property(), "year": Property("i32"), "notes": Property("string", "text"), "extra": Property("json"), "owner": Property()})


@pytest.fixture
def context(spark, tmp_path):
    made = Context(spark, root=str(tmp_path / "data"))
    made.register_model(ALBUM)
    return made


def put(context, **rows):
    change = context.begin()
    ids = {name: change.create("album", name=name, **values) for name, values in rows.items()}
    change.commit()
    return ids


def test_commit_fetch_edit(context):
    ids = put(context, a={"year": 2020, "notes": "hello", "extra": {"k": [1]}}, b={"year": 2021}, c={})
    assert [r.name for r in context.fetch("album", "album.year >= 2020 ORDER BY year DESC").collect()] == ["b", "a"]
    assert context.get("album", ids["a"]).head == [ids["a"]]
    assert context.get("album", ids["a"]).models == ["album"]
    assert context.fetch_one("album", "extra.k IS NOT NULL").name == "a"
    change = context.begin("me")
    change.edit("album", ids["a"], year=1999)
    change.edit_text("album", ids["a"], "notes", 0, 1, "J")
    change.edit_text("album", ids["a"], "notes", 5, 0, "!")
    assert change.get("album", ids["a"]).year == 1999
    assert context.get("album", ids["a"]).year == 2020
    assert change.commit() == 1
    got = context.get("album", ids["a"])
    assert (got.year, got.notes, got.name) == (1999, "Jello!", "a")
    assert context.collections["album"].entity_events(ids["a"]).select("event_id").distinct().count() == 2
    assert context.collections["album"].states(1).where(F.col("id") == ids["a"]).first().year == 2020


def test_rollback_and_unknown_things(context):
    change = context.begin()
    change.create("album", name="x")
    change.rollback()
    assert change.commit() == 0
    assert context.fetch("album", "").count() == 0
    with pytest.raises(UnknownCollection):
        change.create("nosuch", name="x")
    with pytest.raises(KeyError):
        change.create("album", nosuch=1)
    change.edit("album", "none", name="y")
    with pytest.raises(NotFound):
        change.commit()
    with pytest.raises(NotFound):
        context.get("album", "none")


def test_states_survive_compaction_and_repeated_events(spark, context):
    ids = put(context, a={"year": 1}, b={"year": 2})
    own = context.collections["album"]
    change = context.begin()
    change.edit("album", ids["a"], year=3)
    change.commit()
    before = sorted(map(repr, own.states().collect()))
    own.add_events(own.events())
    assert not own.rebuild()
    own.compact()
    own.vacuum(own.version())
    assert sorted(map(repr, own.states().collect())) == before
    assert own.get_states([ids["b"], "none"]).count() == 1
    context.delete_all_collections()
    assert own.states().count() == own.events().count() == 0


def test_an_empty_collection_is_made_without_python(context):
    album = context.collections["album"]
    for empty, schema in ((album.states(), album.schema), (album.events(), EVENTS)):
        assert "ExistingRDD" not in empty._jdf.queryExecution().executedPlan().toString()
        assert [(f.name, f.dataType) for f in empty.schema] == [(f.name, f.dataType) for f in schema]
        assert empty.collect() == []


def test_result_sets_are_kept_by_version(context):
    ids = put(context, a={"year": 1}, b={"year": 2})
    first = context.results("album", "year > 0 ORDER BY year")
    assert not first.loaded
    assert len(first) == 2
    assert [r.name for r in first] == ["a", "b"]
    assert first.ids() == [ids["a"], ids["b"]]
    assert first.by_id(ids["b"]).name == "b"
    assert "none" not in first
    assert context.results("album", "year > 0 ORDER BY year") is first
    assert context.results("album", nocache("year > 0 ORDER BY year")) is not first
    put(context, c={"year": 3})
    assert len(context.results("album", "year > 0 ORDER BY year")) == 3


POLICY = Policy({"clerk": {"read", "write"}, "finder": {"find"}, "guest": set()}, {"album": Rules("read", "write", (Scope("owner = $jwt.sub", "all"),), retrieve="find")})


def test_policy_over_a_context(context):
    ids = put(context, a={"owner": "ann"}, b={"owner": "bob"})
    ask = lambda *credentials: Context(context.spark, policy=POLICY, credentials=list(credentials), collections=context.collections, tables={"open": context.spark.range(3)}, keys={"open": "id"})
    ann, finder, guest = {"roles": ["clerk"], "sub": "ann"}, {"roles": ["finder"], "sub": "bob"}, {"roles": ["guest"], "sub": "ann"}
    assert [r.name for r in ask(ann).fetch("album", "").collect()] == ["a"]
    assert ask(PRIVILEGED).fetch("album", "").count() == 2
    assert ask(finder).fetch("album", "").count() == 0
    assert ask(finder).get("album", ids["b"]).name == "b"
    with pytest.raises(NotFound):
        ask(finder).get("album", ids["a"])
    for who, name in ((guest, "album"), (ann, "open"), ({"roles": ["clerk"]}, "album")):
        with pytest.raises(AccessDenied):
            ask(who).fetch(name, "")
    assert [r.name for r in ask({"roles": ["clerk"]}, ann).fetch("album", "").collect()] == ["a"]
    change = ask(ann).begin()
    change.edit("album", ids["a"], year=7)
    change.commit()
    for entity, values in ((ids["b"], {"year": 7}), (ids["a"], {"owner": "bob"})):  # the image before, and after
        change.edit("album", entity, **values)
        with pytest.raises(AccessDenied):
            change.commit()
        change.rollback()
    change = ask(finder).begin()
    change.create("album", name="z", owner="bob")
    with pytest.raises(AccessDenied):
        change.commit()
    assert context.fetch("album", "").count() == 2
    everyone = Context(context.spark, policy=Permissive(), collections=context.collections)
    assert everyone.fetch("album", "year = 7").count() == 1


def test_live_query_fills_gaps_and_bears_replays(context, tmp_path):
    ids = put(context, **{f"y{k}": {"year": k} for k in range(2020, 2025)})
    seen = []
    query = context.live("album", "year >= 2020 ORDER BY year LIMIT 3", lambda rows, version: seen.append((version, sorted((r.change_type, r.name) for r in rows.collect()))), str(tmp_path / "live"))
    query.start(availableNow=True).awaitTermination()
    assert seen == [(1, [("initial", "y2020"), ("initial", "y2021"), ("initial", "y2022")])]
    change = context.begin()
    change.edit("album", ids["y2021"], year=1999)
    change.edit("album", ids["y2020"], notes="x")
    change.commit()
    put(context, other={"year": 5})
    query.start(availableNow=True).awaitTermination()
    want = (2, [("add", "y2023"), ("remove", "y2021"), ("update", "y2020")])
    assert seen[1:] == [want]
    query.step(2)
    assert seen[2:] == [want]
    query.update("year >= 2023 ORDER BY year LIMIT 3")
    assert seen[3] == (3, [("initial", "y2024"), ("remove", "y2020"), ("remove", "y2022")])
    gone = []
    query.sink = lambda rows, version: gone.append(sorted(map(tuple, rows.collect())))
    query.reset()
    assert gone == [sorted(("remove", ids[f"y{k}"]) for k in (2023, 2024))]


def test_running_query_signals_its_versions(context, tmp_path):
    from tidemark.errors import EngineError

    ids = put(context, a={"year": 1}, b={"year": 5})
    query = context.query("album", "year > 2", str(tmp_path / "live"))
    size = query.signal.map(lambda version: query.result(version).count())
    assert size.get() == 1
    change = context.begin()
    change.edit("album", ids["a"], year=9)
    change.commit()
    assert query.signal.wait(lambda version: version == 2, 60)
    query.stop()
    assert size.get() == 2
    with pytest.raises(EngineError):
        context.get("album", "none")


@pytest.mark.parametrize("overwrite", [False, True])
def test_follow_a_table(spark, tmp_path, overwrite):
    source, state, seen = str(tmp_path / "in"), str(tmp_path / "state"), []
    schema = "k int, v int"
    spark.createDataFrame([(1, 5), (2, 6)], schema).write.parquet(state)
    read = lambda: spark.read.schema(schema).parquet(state)

    def upsert(batch):
        if overwrite:
            kept = read().join(batch.select("k"), "k", "left_anti").unionByName(batch).checkpoint()
            kept.write.mode("overwrite").parquet(state)
        else:
            batch.join(read(), ["k", "v"], "left_anti").write.mode("append").parquet(state)

    from tidemark.sources.tables import ensure_checkpoints

    ensure_checkpoints(spark)
    for rows in ([(3, 7)], [(4, 1), (5, 9)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        live.follow(stream, read, upsert, "v > 4", "k", lambda c, n: seen.append(sorted(map(tuple, c.collect()))), str(tmp_path / "check")).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
    assert seen == [[("add", 3)], [("add", 5)]]


def test_changes_of_given_entities(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    after = spark.createDataFrame([(1, "A"), (3, "C"), (4, "d")], "k int, v string")
    ids = spark.createDataFrame([(1,), (2,), (4,)], "k int")
    assert sorted(map(tuple, live.entity_changes(before, after, ids, "k").collect())) == [("add", 4), ("remove", 2), ("update", 1)]


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    song = Model("song", {"title": Property(), "album": Property("ref", target="album")})
    plan = catalog.register([song])
    assert [m["label"] for m in plan.creates["model"]] == ["song", "album"]
    assert catalog.register([song]).empty
    judged = []
    catalog.register([Model("song", {"name": Property(optional=False)})], renamed={"song": {"title": "name"}}, judge=judged.append)
    assert [u[2:] for u in judged[0].updates] == [("name", "title", "name"), ("optional", True, False)]
    assert sorted(r.name for r in catalog.table("property").collect()) == ["album", "name"]
    assert {r.kind: r.n for r in catalog.counts().collect()} == {"model": 2, "property": 2, "membership": 2}
    for bad in (Model("_own"), Model("song", {"name": Property("i32")}), Model("song", {"x": Property("nokind")})):
        with pytest.raises(RegistrationError):
            catalog.register([bad])
    with pytest.raises(PermissionError):
        catalog.register([Model("new")], judge=lambda plan: (_ for _ in ()).throw(PermissionError()))
    assert catalog.table("model").count() == 2


def test_signals():
    a, b, runs, told = Signal(1), Signal(10), [], []
    both = Calculated(lambda: (runs.append(1), a.get() + (b.get() if a.get() > 1 else 0))[1])
    assert (both.get(), both.get(), len(runs)) == (1, 1, 1)
    b.set(20)
    assert (both.get(), len(runs)) == (1, 1)
    stop = both.subscribe(told.append)
    a.set(2)
    assert told == [22]
    b.set(30)
    assert (both.peek(), told) == (32, [22, 32])
    stop()
    b.set(40)
    assert told == [22, 32]
    assert both.map(lambda x: x * 2).get() == 84
    assert both.wait(lambda x: x == 42, 0.1)
    assert not a.wait(lambda x: x == 99, 0.01)
    with pytest.raises(TypeError):
        both.set(1)


def test_rows_of_a_context_table(spark):
    context = Context(spark)
    context.register("pet", spark.createDataFrame([(1, "Rex"), (2, "Ina")], "id int, name string"), "id")
    assert context.retrieve("pet", [2, 9]).collect()[0].name == "Ina"
    assert context.fetch("pet", S.parse("id > 1")).count() == 1
    with pytest.raises(UnknownCollection):
        context.fetch("cat", "")
