import pytest

from tidemark.sources.context import Context, EventTable, NotFound, Transaction


def test_fetch_and_get(spark):
    context = Context(spark)
    context.register("pet", spark.createDataFrame([(1, "Rex", 3), (2, "Ina", None)], "id int, name string, age int"), "id")
    assert context.fetch_one("pet", "age IS NULL").name == "Ina"
    assert [r.id for r in context.fetch("pet", "pet.id > 0 ORDER BY age DESC").collect()] == [2, 1]
    assert context.get("pet", 1).name == "Rex"
    with pytest.raises(NotFound):
        context.get("pet", 9)


def test_transaction(spark, tmp_path):
    events = EventTable(spark, str(tmp_path / "events"))
    first = Transaction(events)
    entity = first.create(name="a")
    first.rollback()
    assert first.commit() == 0
    entity = first.create(name="a", age=1)
    first.commit()
    assert events.heads(entity) == [entity]
    second = Transaction(events)
    second.edit(entity, name="b")
    second.commit()
    assert len(events.heads(entity)) == 1
    assert events.heads(entity) != [entity]
    with pytest.raises(NotFound):
        third = Transaction(events)
        third.edit("none", name="c")
        third.commit()
