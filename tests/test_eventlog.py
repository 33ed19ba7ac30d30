"""Event logs against brute force over random graphs, and their defined edge cases."""

import itertools
import random

import pytest

from tidemark.operators import dag
from tidemark.operators import eventlog as E

EVENTS, PARENTS = "entity long, event string, property string, value double", "entity long, event string, parent string"


def random_log(seed=1, entities=6):
    rng, events, parents = random.Random(seed), [], []
    for entity in range(entities):
        names = []
        for k in range(rng.randint(1, 12)):
            name = f"e{entity}_{rng.randint(100, 999)}_{k}"
            events += [(entity, name, p, float(rng.randint(0, 9))) for p in rng.sample("xyz", rng.randint(1, 2))]
            if names and rng.random() < 0.9:
                parents += [(entity, name, p) for p in rng.sample(names, min(len(names), rng.randint(1, 2)))]
            names.append(name)
    return events, parents


class Brute:
    def __init__(self, events, parents):
        self.up = {}
        for _, event, parent in parents:
            self.up.setdefault(event, set()).add(parent)
        self.ids = sorted({r[:2] for r in events})

    def past(self, clock):
        seen, todo = set(clock), list(clock)
        while todo:
            for p in self.up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    def generation(self, event):
        return max((self.generation(p) + 1 for p in self.up.get(event, ())), default=0)


@pytest.fixture(scope="module")
def log(spark):
    events, parents = random_log()
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame(parents, PARENTS), Brute(events, parents), events, parents


def test_generations_and_order(log):
    events, parents, brute, *_ = log
    want = sorted((a, b, brute.generation(b)) for a, b in brute.ids)
    for most in (E.MOST_EVENTS, 8):
        assert sorted(map(tuple, E.generations(events, parents, most).collect())) == want
    placed = {r.event: r.place for r in E.topological(events, parents).collect()}
    assert all(placed[p] < placed[e] for e, ps in brute.up.items() for p in ps)


def test_ancestors(log):
    events, parents, brute, *_ = log
    assert sorted(map(tuple, E.ancestors(events, parents).collect())) == sorted((a, b, c) for a, b in brute.ids for c in brute.past([b]) - {b})


def test_last_writer_wins(log):
    events, parents, brute, rows, _ = log
    writes = {}
    for entity, event, prop, value in rows:
        writes.setdefault((entity, prop), {})[event] = value
    want = []
    for (entity, prop), made in writes.items():
        best = max(b for b in made if not any(b != o and b in brute.past([o]) for o in made))
        want.append((entity, prop, best, made[best]))
    for most in (E.MOST_EVENTS, 8):
        assert sorted(map(tuple, E.lww_state(events.union(events.limit(3)), parents, most).collect())) == sorted(want)


def test_clocks(spark, log):
    events, parents, brute, *_ = log
    rng, pairs = random.Random(7), []
    for entity, names in itertools.groupby(brute.ids, key=lambda x: x[0]):
        names = [b for _, b in names]
        pick = lambda: rng.sample(names, min(len(names), rng.randint(0, 3)))  # noqa: B023, E731
        pairs += [(entity, pick(), pick(), k) for k in range(80)]
    got = E.compare(spark.createDataFrame(pairs, "entity long, subject array<string>, other array<string>, k int"), events, parents).collect()
    assert sorted((r.entity, r.k) for r in got) == sorted((p[0], p[3]) for p in pairs)
    met = set()
    for r in got:
        s, o = brute.past(r.subject), brute.past(r.other)
        roots = lambda past: {x for x in past if not brute.up.get(x)}
        want = "equal" if s == o else "descends" if r.other and set(r.other) <= s and roots(s) <= o else "ascends" if r.subject and set(r.subject) <= o else "diverged" if s & o else "disjoint"
        met.add(want)
        assert (r.verdict, r.n_subject, r.n_other) == (want, len(s - o), len(o - s))
        tips = {c for c in s & o if not any(c in brute.up.get(x, ()) for x in s & o)} if want == "diverged" else set()
        assert list(r.meet) == sorted(tips)
        assert list(r.subject_next) == sorted(x for x in s - o if brute.up.get(x, set()) & tips)
        assert list(r.other_next) == sorted(x for x in o - s if brute.up.get(x, set()) & tips)
    assert met == {"equal", "descends", "ascends", "diverged", "disjoint"}
    few = E.compare(spark.createDataFrame([(brute.ids[-1][0], [brute.ids[-1][1]], [])], "entity long, subject array<string>, other array<string>"), events, parents, budget=0)
    assert few.first().verdict == "budget_exceeded"


def test_bridges_can_be_applied(spark, log):
    events, parents, brute, *_ = log
    for pick in (min, max):
        known = {}
        for entity, event in brute.ids:
            known[entity] = pick(known.get(entity, event), event, key=brute.generation)
        rows = E.bridges(spark.createDataFrame([(e, [x]) for e, x in known.items() if e != 0], "entity long, head array<string>"), events, parents).collect()
        assert {r.kind for r in rows if r.entity == 0} == {"snapshot"}
        for entity in set(known) - {0}:
            own = sorted((r for r in rows if r.entity == entity), key=lambda r: r.place)
            every = {b for a, b in brute.ids if a == entity}
            strange = {x for x in every if not brute.up.get(x)} - brute.past([known[entity]])
            if strange:
                assert [r.kind for r in own] == ["snapshot"]
            elif brute.past([known[entity]]) == every:
                assert [r.kind for r in own] == ["current"]
            else:
                held = brute.past([known[entity]])
                for r in own:
                    assert r.kind == "bridge"
                    assert brute.up.get(r.event, set()) <= held
                    held.add(r.event)
                assert held == every


def test_a_hidden_event_makes_a_bridge_a_snapshot(spark):
    events = spark.createDataFrame([(1, "a", "x", 1.0), (1, "b", "x", 1.0), (2, "a", "x", 1.0), (2, "b", "x", 1.0)], EVENTS)
    parents = spark.createDataFrame([(1, "b", "a"), (2, "b", "a")], PARENTS)
    known = spark.createDataFrame([(1, ["a"]), (2, ["a"])], "entity long, head array<string>")
    got = E.bridges(known, events, parents, hidden=spark.createDataFrame([(2, "b")], "entity long, event string"))
    assert sorted(map(tuple, got.collect())) == [(1, "bridge", 0, "b"), (2, "snapshot", 0, None)]


@pytest.mark.parametrize("most", [E.MOST_EVENTS, 0])
def test_cycles_are_errors(spark, most):
    events = spark.createDataFrame([(1, "a", "x", 1.0), (1, "b", "x", 1.0), (2, "c", "x", 1.0)], EVENTS)
    parents = spark.createDataFrame([(1, "a", "b"), (1, "b", "a")], PARENTS)
    for made in (E.generations, E.lww_state):
        with pytest.raises(Exception, match="cycle"):
            made(events, parents, most).collect()


def test_empty_and_incomplete_logs(spark):
    events, parents = spark.createDataFrame([], EVENTS), spark.createDataFrame([], PARENTS)
    for made in (E.generations, E.ancestors, E.lww_state, E.topological, E.heads, E.clocks_of):
        assert made(events, parents).count() == 0
    events = spark.createDataFrame([(1, "a", "x", None), (None, "b", "x", 1.0), (1, None, "x", 1.0), (1, "a", "x", 2.0)], EVENTS)
    parents = spark.createDataFrame([(1, "a", "lost"), (1, "strange", "a"), (None, "b", "a"), (1, "a", None)], PARENTS)
    assert E.generations(events, parents).collect() == [(1, "a", 0)]
    assert E.lww_state(events, parents).collect() == [(1, "x", "a", 2.0)]


def test_chunks_hold_whole_entities():
    import pyarrow as pa

    rows = [e for e, n in enumerate([1, 7, 3, 40, 1, 1, 5]) for _ in range(n)]
    batches = [pa.RecordBatch.from_pydict({"entity": rows[k : k + 4]}) for k in range(0, len(rows), 4)]
    made = [t["entity"].to_pylist() for t in dag.chunks(iter(batches), 6)]
    assert sum(made, []) == rows
    assert sum(len(set(t)) for t in made) == 7


def test_chunks_stay_small():
    import numpy as np
    import pyarrow as pa

    batches = (pa.RecordBatch.from_pydict({"entity": np.arange(k, k + 10_000) // 70}) for k in range(0, 300_000, 10_000))
    sizes = [len(t) for t in dag.chunks(batches)]
    assert sum(sizes) == 300_000
    assert max(sizes) <= 60_000


def test_texts_written_side_by_side(spark):
    edits = "entity long, event string, property string, seq int, at int, removed int, inserted string"
    rows = [(1, "a", "t", 0, 0, 0, "hello"), (1, "b", "t", 0, 5, 0, " world"), (1, "c", "t", 0, 0, 1, "J"), (1, "d", "t", 0, 11, 0, "!"), (2, "a", "t", 0, 0, 0, "abc"), (2, "b", "t", 0, 1, 1, "XY"), (2, "b", "t", 1, 99, 0, "."), (3, "a", "t", 0, 0, 0, "ab"), (3, "b", "t", 0, 1, 0, "11"), (3, "c", "t", 0, 1, 0, "22"), (3, "d", "t", 0, 0, 2, None)]
    parents = [(1, "b", "a"), (1, "c", "a"), (1, "d", "b"), (1, "d", "c"), (2, "b", "a"), (3, "b", "a"), (3, "c", "a"), (3, "d", "a")]
    rng = random.Random(2)
    for _ in range(3):
        rng.shuffle(rows)
        got = E.text_state(spark.createDataFrame(rows, edits), spark.createDataFrame(parents, PARENTS))
        assert sorted((r.entity, r.value) for r in got.collect()) == [(1, "Jello world!"), (2, "aXYc."), (3, "2211")]


def test_states_that_part(spark):
    events = spark.createDataFrame([(1, x, "p", 1.0) for x in "abcd"] + [(2, "r", "p", 1.0), (2, "s", "p", 1.0)], EVENTS)
    parents = spark.createDataFrame([(1, "b", "a"), (1, "c", "a"), (1, "d", "b")], PARENTS)
    heads = "entity long, head array<string>"
    action = lambda entity, new, old: E.adopt(spark.createDataFrame([(entity, new)], heads), spark.createDataFrame([(entity, old)] if old else [], heads), events, parents).first().action
    assert [action(1, ["d"], ["b"]), action(1, ["b"], ["d"]), action(1, ["b"], ["b"]), action(1, ["d"], ["c"]), action(2, ["r"], ["s"]), action(1, ["d"], None)] == ["adopt", "keep", "keep", "needs_events", "reject", "adopt"]
    current = spark.createDataFrame([(1, ["b"]), (2, ["r"])], heads)
    got = {(r.entity, r.event): r.effect for r in E.classify(events, current, events, parents).collect()}
    assert got == {(1, "a"): "ignore", (1, "b"): "ignore", (1, "c"): "merge", (1, "d"): "apply", (2, "r"): "ignore", (2, "s"): "reject"}
