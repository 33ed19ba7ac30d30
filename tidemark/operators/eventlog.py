"""Event logs: generations, heads, clock comparison, layers, bridges, and last-writer-wins and text state.

A log is two tables: events (entity, event, property, value; a row for each property that an event writes) and parents
(entity, event, parent). What needs the shape of the graph runs over whole entities: rows are dealt by entity once and
each entity's events pass in linear time (operators/dag.py); no table of ancestor pairs is made, but for `ancestors`,
which is one. An entity with more than MOST_EVENTS rows does not go to one task: `generations` and `lww_state` take
it by rounds of joins instead, one for each generation.

Defined results: rows without an entity or event belong to no log and are left out; repeated rows count once; a
parent that is not in the log is no parent; a cycle is an error; an empty log gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators import dag
from tidemark.sources.tables import ensure_checkpoints, importable

#: Rows of an entity's events that one task passes at most.
MOST_EVENTS = 20_000_000


def forked_log(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log with forks and merges from events(event_id, ts, user_id, event_type, value): the k-th event of a user has
    the event floor((k-1)/2) as parent, and every fifth the one after that too."""
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.select(F.col("user_id").alias("entity"), "event_id", F.col("event_type").alias("property"), "value", at.alias("k"))
    wanted = rows.where("k >= 1").select("entity", F.col("event_id").alias("event"), F.explode(F.expr("CASE WHEN k >= 5 AND k % 5 = 0 THEN array((k - 1) div 2, (k - 1) div 2 + 1) ELSE array((k - 1) div 2) END")).alias("of"))
    parents = wanted.join(rows.select(F.col("entity").alias("e"), F.col("k").alias("pk"), F.col("event_id").alias("parent")), (F.col("entity") == F.col("e")) & (F.col("of") == F.col("pk"))).select("entity", "event", "parent")
    return rows.select("entity", F.col("event_id").alias("event"), "property", "value"), parents


def _graph(events: DataFrame, parents: DataFrame, *more: str) -> DataFrame:
    """Rows entity, event, parent (null for an event's own rows), and more columns of events."""
    kinds = {f.name: f.dataType for f in events.schema}
    own = events.select("entity", "event", F.lit(None).cast(kinds["event"]).alias("parent"), *more)
    edges = parents.select(F.col("entity").cast(kinds["entity"]), F.col("event").cast(kinds["event"]), F.col("parent").cast(kinds["event"]), *(F.lit(None).cast(kinds[m]).alias(m) for m in more))
    return own.where("entity IS NOT NULL AND event IS NOT NULL").unionByName(edges.where("entity IS NOT NULL AND event IS NOT NULL AND parent IS NOT NULL"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with each entity in one partition, in a run. By a hash of the entity, not the entity: of a union whose parts
    are dealt by entity already, Spark leaves a shuffle by the same column out, and then joins partitions of each part
    into larger ones (AQE) on its own, which parts an entity's rows."""
    return rows.repartition(F.xxhash64("entity")).sortWithinPartitions("entity")


def _run(rows: DataFrame, kernel, schema: T.StructType) -> DataFrame:
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def cast(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for made in kernel(table):
            yield from pa.Table.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(made.columns, arrow, strict=True)], schema=arrow).to_batches()

    importable(rows.sparkSession)
    return _dealt(rows).mapInArrow(dag.over_entities(cast), schema)


def _kinds(events: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in events.schema}


def _read(table: pa.Table) -> tuple[dag.Dag, pa.Array, pa.Array, np.ndarray]:
    """The chunk's graph (of its rows that name an event), its entities, its events, and the entity code of each row."""
    (entity,), entities = dag.codes(table["entity"])
    (event, parent), events = dag.codes(table["event"], table["parent"])
    real = event >= 0
    return dag.Dag(entity[real], event[real], parent[real]), entities, events, entity


def _large(events: DataFrame, most: int) -> DataFrame | None:
    """The entities with more rows than one task should pass; None if there are none."""
    sizes = events.groupBy("entity").count().where(F.col("count") > most).select("entity").checkpoint()
    return None if sizes.isEmpty() else sizes


def generations(events: DataFrame, parents: DataFrame, most_events: int = MOST_EVENTS) -> DataFrame:
    """entity, event, generation: the longest path from an event without parents, which makes (generation, event) an
    order with parents first."""
    ensure_checkpoints(events.sparkSession)
    kinds = _kinds(events)
    schema = T.StructType([T.StructField("entity", kinds["entity"]), T.StructField("event", kinds["event"]), T.StructField("generation", T.LongType())])

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        graph, entities, names, _ = _read(table)
        yield pa.table([entities.take(pa.array(graph.entity)), names.take(pa.array(graph.event)), pa.array(graph.generation)], names=["entity", "event", "generation"])

    large = _large(events.select("entity"), most_events)
    if large is None:
        return _run(_graph(events, parents), kernel, schema)
    keep = lambda df, how: df.join(F.broadcast(large), "entity", how)  # noqa: E731  (few: each has most_events rows)
    small = _run(_graph(keep(events, "left_anti"), keep(parents, "left_anti")), kernel, schema)
    return small.unionByName(_generations_by_rounds(keep(events, "left_semi"), keep(parents, "left_semi")))


def _generations_by_rounds(events: DataFrame, parents: DataFrame) -> DataFrame:
    nodes = events.where("event IS NOT NULL").select("entity", "event").distinct().checkpoint()
    edges = parents.join(nodes, ["entity", "event"], "left_semi").join(nodes.withColumnRenamed("event", "parent"), ["entity", "parent"], "left_semi").select("entity", "event", "parent").distinct().checkpoint()
    left, done, layer, total = edges, [], 0, nodes.count()
    front = nodes.join(edges.select("entity", "event").distinct(), ["entity", "event"], "left_anti").checkpoint()
    seen = 0
    while (size := front.count()) > 0:
        done.append(front.withColumn("generation", F.lit(layer).cast("long")))
        seen += size
        met = left.join(front.withColumnRenamed("event", "parent"), ["entity", "parent"], "left_semi")
        rest = left.join(front.withColumnRenamed("event", "parent"), ["entity", "parent"], "left_anti").checkpoint()
        front = met.select("entity", "event").distinct().join(rest.select("entity", "event").distinct(), ["entity", "event"], "left_anti").checkpoint()
        left, layer = rest, layer + 1
    if seen < total:
        raise dag.CycleError("the log has a cycle")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def topological(events: DataFrame, parents: DataFrame) -> DataFrame:
    """entity, event, place: an order of each entity's events with parents first, from 0; equals by event."""
    order = W.partitionBy("entity").orderBy("generation", "event")
    return generations(events, parents).select("entity", "event", (F.row_number().over(order) - 1).cast("long").alias("place"))


def heads(events: DataFrame, parents: DataFrame) -> DataFrame:
    """entity, event of the events that are nobody's parent."""
    return events.select("entity", "event").distinct().join(parents.select("entity", F.col("parent").alias("event")), ["entity", "event"], "left_anti")


def ancestors(events: DataFrame, parents: DataFrame) -> DataFrame:
    """entity, event, ancestor: every proper ancestor of every event. Its size is quadratic in an entity's history."""
    kinds = _kinds(events)
    schema = T.StructType([T.StructField("entity", kinds["entity"]), T.StructField("event", kinds["event"]), T.StructField("ancestor", kinds["event"])])

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        graph, entities, names, _ = _read(table)
        _, inside = dag.lists(np.arange(graph.size), graph.entity, len(entities))
        rank = np.arange(graph.size) - inside[graph.entity]
        for low in range(0, int(rank.max(initial=-1)) + 1, 64):
            chosen = np.flatnonzero((rank >= low) & (rank < low + 64))
            by_bit = np.full((len(entities), 64), -1)
            by_bit[graph.entity[chosen], rank[chosen] - low] = chosen
            marks = np.zeros(graph.size, np.uint64)
            marks[chosen] = np.uint64(1) << (rank[chosen] - low).astype(np.uint64)
            graph.spread_up(marks)
            for bit in range(64):
                up = np.flatnonzero(marks >> np.uint64(bit) & np.uint64(1))
                of = by_bit[graph.entity[up], bit]
                up, of = up[up != of], of[up != of]
                if len(up):
                    yield pa.table([entities.take(pa.array(graph.entity[up])), names.take(pa.array(graph.event[of])), names.take(pa.array(graph.event[up]))], names=schema.names)

    return _run(_graph(events, parents), kernel, schema)


def lww_state(events: DataFrame, parents: DataFrame, most_events: int = MOST_EVENTS) -> DataFrame:
    """entity, property, event, value: of the writes that no other write to the property descends from, the one with
    the largest event."""
    ensure_checkpoints(events.sparkSession)
    kinds = _kinds(events)
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("entity", "property", "event", "value")])

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        graph, _, _, entity = _read(table)
        writes = pc.and_(pc.is_valid(table["property"]), pc.is_null(table["parent"]))
        rows = np.flatnonzero(writes.combine_chunks().to_numpy(zero_copy_only=False))
        if not len(rows):
            return
        (event,), _ = dag.codes(table["event"])
        node = graph.find(entity[rows], event[rows])
        (prop,), _ = dag.codes(table["property"])
        # properties numbered within their entity, 64 to a pass
        pair, first = np.unique(entity[rows] * (int(prop.max()) + 1) + prop[rows], return_inverse=True)
        of = pair // (int(prop.max()) + 1)
        number = (np.arange(len(pair)) - np.searchsorted(of, of))[first]
        lost = np.zeros(len(rows), bool)
        for low in range(0, int(number.max()) + 1, 64):
            some = np.flatnonzero((number >= low) & (number < low + 64))
            own = np.zeros(graph.size, np.uint64)
            bit = np.uint64(1) << (number[some] - low).astype(np.uint64)
            np.bitwise_or.at(own, node[some], bit)
            lost[some] = graph.below(own)[node[some]] & bit != 0
        left = table.take(pa.array(rows[~lost])).select(schema.names).append_column("group", pa.array(first[~lost]))
        # the largest event of each group is its last one; of repeated rows, that with the largest value
        left = left.take(pc.sort_indices(left, sort_keys=[("group", "ascending"), ("event", "ascending"), ("value", "ascending")], null_placement="at_start"))
        group = left["group"].to_numpy()
        yield left.take(pa.array(np.flatnonzero(np.append(group[1:] != group[:-1], True)))).select(schema.names)

    rows = events.select("entity", "event", "property", "value")
    large = _large(rows.select("entity"), most_events)
    if large is None:
        return _run(_graph(rows, parents, "property", "value"), kernel, schema)
    keep = lambda df, how: df.join(F.broadcast(large), "entity", how)
    small = _run(_graph(keep(rows, "left_anti"), keep(parents, "left_anti"), "property", "value"), kernel, schema)
    return small.unionByName(_lww_by_rounds(keep(rows, "left_semi"), keep(parents, "left_semi")))


def _lww_by_rounds(rows: DataFrame, parents: DataFrame) -> DataFrame:
    _generations_by_rounds(rows, parents)  # a cycle is an error here too
    write = rows.where("event IS NOT NULL AND property IS NOT NULL")
    front = write.select("entity", "event", "property").distinct()
    below = None
    while True:  # properties written by proper descendants, handed to parents until nothing is new
        up = front.join(parents, ["entity", "event"]).select("entity", F.col("parent").alias("event"), "property").distinct()
        front = (up if below is None else up.join(below, ["entity", "event", "property"], "left_anti")).checkpoint()
        if front.isEmpty():
            break
        below = (front if below is None else below.unionByName(front)).checkpoint()
    left = write if below is None else write.join(below, ["entity", "event", "property"], "left_anti")
    best = F.max(F.struct("event", "value")).alias("best")
    return left.groupBy("entity", "property").agg(best).select("entity", "property", "best.event", "best.value")


# Clocks are arrays of events; a clock's past is its events and all their ancestors.

def compare(pairs: DataFrame, events: DataFrame, parents: DataFrame, budget: int | None = None) -> DataFrame:
    """pairs: entity, subject, other (clocks), and any further columns, which stay. Adds
      verdict         equal, descends (the subject's past holds the other clock, and has no root that the other's has
                      not), ascends, diverged (some past in common), disjoint, or budget_exceeded (both pasts together
                      have more than budget events)
      meet            of what both pasts share, the events without a shared child; empty for other verdicts than diverged
      subject_next, other_next   children of the meet on the way to either clock alone
      n_subject, n_other         events of one past alone
    A clock with an event that the log does not have is compared by its known events; two empty clocks are equal, an
    empty and another one disjoint. Pairs of one entity go 32 at a time."""
    kinds = _kinds(events)
    extra = [f for f in pairs.schema if f.name not in ("entity", "subject", "other")]
    clock = T.ArrayType(kinds["event"])
    made = [T.StructField("entity", kinds["entity"]), T.StructField("subject", clock), T.StructField("other", clock), *extra]
    told = [T.StructField("verdict", T.StringType()), *(T.StructField(n, clock) for n in ("meet", "subject_next", "other_next")), T.StructField("n_subject", T.LongType()), T.StructField("n_other", T.LongType())]
    schema = T.StructType([*made, *told])

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        asked = pc.is_null(table["event"]).combine_chunks().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(asked)
        if not len(rows):
            return
        graph, names, entity, sides = _clock_nodes(table, rows, ["subject", "other"])
        pair_entity = entity[rows]
        _, starts = dag.lists(np.arange(len(rows)), pair_entity, int(entity.max()) + 1)
        order = np.argsort(pair_entity, kind="stable")
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows)) - starts[pair_entity[order]]
        for low in range(0, int(rank.max()) + 1, 32):
            yield _compared(table, rows, np.flatnonzero((rank >= low) & (rank < low + 32)), rank - low, graph, names, entity, sides, budget, schema)

    asked = pairs.select(F.col("entity").cast(kinds["entity"]), F.lit(None).cast(kinds["event"]).alias("event"), F.lit(None).cast(kinds["event"]).alias("parent"), F.col("subject").cast(clock), F.col("other").cast(clock), *(f"`{f.name}`" for f in extra))
    asked = asked.where("entity IS NOT NULL")
    return _run(_graph(events, parents).unionByName(asked, allowMissingColumns=True), kernel, schema)


def _clock_nodes(table: pa.Table, rows: np.ndarray, columns: list[str]):
    """The chunk's graph, its event names, the entity of each table row, and of each clock column: node and row (of
    rows) of every event, and which rows have an event."""
    (entity,), _ = dag.codes(table["entity"])
    clocks = [table[c].combine_chunks().take(pa.array(rows)) for c in columns]
    flat = [pa.chunked_array([c.flatten()]) for c in clocks]
    (event, parent, *told), names = dag.codes(table["event"], table["parent"], *flat)
    real = event >= 0
    graph = dag.Dag(entity[real], event[real], parent[real])
    sides = []
    for c, codes in zip(clocks, told, strict=True):
        owner = pc.list_parent_indices(c).to_numpy(zero_copy_only=False).astype(np.int64)
        node = graph.find(entity[rows][owner], codes)
        sides.append((node[node >= 0], owner[node >= 0]))
    return graph, names, entity, sides


def _compared(table, rows, chosen, bit_of, graph, names, entity, sides, budget, schema) -> pa.Table:
    marks = np.zeros(graph.size, np.uint64)
    inside = np.zeros(len(rows), bool)
    inside[chosen] = True
    one = lambda k: np.uint64(1) << k.astype(np.uint64)
    told = []
    for shift, (node, owner) in enumerate(sides):
        here = inside[owner]
        told.append((node[here], owner[here]))
        np.bitwise_or.at(marks, node[here], one(2 * bit_of[owner[here]] + shift))
    graph.spread_up(marks)
    low = np.uint64(0x5555555555555555)
    both = marks & (marks >> np.uint64(1)) & low  # at the subject's bit
    shared_below = np.zeros(graph.size, np.uint64)
    np.bitwise_or.at(shared_below, graph.parent, both[graph.child])
    tip = both & ~shared_below
    root = graph.generation == 0
    count = len(rows)
    # of each clock: does the other past hold all its events
    covered = []
    for (node, owner), back in zip(told, (1, 0), strict=True):
        miss = (marks[node] >> (2 * bit_of[owner] + back).astype(np.uint64)) & np.uint64(1) == 0
        covered.append(np.bincount(owner[miss], minlength=count) == 0)
    sizes = [np.bincount(owner, minlength=count) for _, owner in told]
    stats = {k: np.zeros(count, np.int64) for k in ("s", "o", "both", "strange")}
    meet, toward = [], ([], [])
    of_slot = np.full((int(entity.max()) + 1, 32), -1)
    of_slot[entity[rows[chosen]], bit_of[chosen]] = chosen
    for slot in range(int(bit_of[chosen].max(initial=-1)) + 1):
        at = np.uint64(2 * slot)
        s, o = marks >> at & np.uint64(1) > 0, marks >> (at + np.uint64(1)) & np.uint64(1) > 0
        owner = of_slot[graph.entity, slot]
        for k, mask in (("s", s & ~o), ("o", o & ~s), ("both", s & o), ("strange", s & ~o & root)):
            stats[k] += np.bincount(owner[mask], minlength=count)
        tips = tip >> at & np.uint64(1) > 0
        found = np.flatnonzero(tips)
        meet.append((found, owner[found]))
        under = tips[graph.parent]
        for side, mask in enumerate((s & ~o, o & ~s)):
            kids = np.unique(graph.child[under & mask[graph.child]])
            toward[side].append((kids, owner[kids]))
    same = covered[0] & covered[1] & (stats["s"] + stats["o"] == 0)
    verdict = np.select(
        [same & ((sizes[0] > 0) == (sizes[1] > 0)), covered[1] & (stats["strange"] == 0) & (sizes[1] > 0), covered[0] & (sizes[0] > 0), stats["both"] > 0],
        ["equal", "descends", "ascends", "diverged"], "disjoint")
    if budget is not None:
        verdict = np.where(stats["s"] + stats["o"] + stats["both"] > budget, "budget_exceeded", verdict)
    columns = [table[c].combine_chunks().take(pa.array(rows[chosen])) for c in schema.names[:-6]]
    columns.append(pa.array(verdict[chosen]))
    place = np.full(count, -1)
    place[chosen] = np.arange(len(chosen))
    for found in (meet, *toward):
        node = np.concatenate([n for n, _ in found]) if found else np.empty(0, np.int64)
        owner = place[np.concatenate([w for _, w in found])] if found else np.empty(0, np.int64)
        keep = (verdict[chosen] == "diverged")[owner] if len(owner) else np.empty(0, bool)
        columns.append(_named(node[keep], owner[keep], len(chosen), graph, names))
    return pa.table([*columns, pa.array(stats["s"][chosen]), pa.array(stats["o"][chosen])], names=schema.names)


def _named(node: np.ndarray, owner: np.ndarray, owners: int, graph: dag.Dag, names: pa.Array) -> pa.Array:
    """Lists of events by owner, each ascending."""
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    order = np.lexsort((rank[graph.event[node]], owner)) if len(node) else np.empty(0, np.int64)
    ends = np.searchsorted(owner[order], np.arange(owners + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(graph.event[node[order]])))


def layers(clocks: DataFrame, events: DataFrame, parents: DataFrame) -> DataFrame:
    """clocks: entity, meet, head, incoming; one row for each entity. Returns entity, layer, event, applied: the events
    of the pasts of head and incoming that are not in the past of the meet, by the longest path from it (from 0);
    applied are those in the past of the head."""
    kinds = _kinds(events)
    schema = T.StructType([T.StructField("entity", kinds["entity"]), T.StructField("layer", T.LongType()), T.StructField("event", kinds["event"]), T.StructField("applied", T.BooleanType())])

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        rows = np.flatnonzero(pc.is_null(table["event"]).combine_chunks().to_numpy(zero_copy_only=False))
        if not len(rows):
            return
        graph, names, entity, sides = _clock_nodes(table, rows, ["meet", "head", "incoming"])
        marks = np.zeros(graph.size, np.uint8)
        for shift, (node, _) in enumerate(sides):
            np.bitwise_or.at(marks, node, np.uint8(1 << shift))
        graph.spread_up(marks)
        kept = np.flatnonzero((marks & 1 == 0) & (marks > 0))
        place = np.full(graph.size, -1)
        place[kept] = np.arange(len(kept))
        edge = (place[graph.child] >= 0) & (place[graph.parent] >= 0)
        layer = dag.generations(len(kept), place[graph.child[edge]], place[graph.parent[edge]])
        _, entities = dag.codes(table["entity"])
        yield pa.table([entities.take(pa.array(graph.entity[kept])), pa.array(layer), names.take(pa.array(graph.event[kept])), pa.array(marks[kept] & 2 > 0)], names=schema.names)

    clock = T.ArrayType(kinds["event"])
    asked = clocks.where("entity IS NOT NULL").select(F.col("entity").cast(kinds["entity"]), F.lit(None).cast(kinds["event"]).alias("event"), F.lit(None).cast(kinds["event"]).alias("parent"), *(F.col(c).cast(clock) for c in ("meet", "head", "incoming")))
    return _run(_graph(events, parents).unionByName(asked, allowMissingColumns=True), kernel, schema)


def clocks_of(events: DataFrame, parents: DataFrame) -> DataFrame:
    """entity, head: the events of an entity that are nobody's parent, ascending."""
    return heads(events, parents).groupBy("entity").agg(F.array_sort(F.collect_set("event")).alias("head"))


def bridges(known: DataFrame, events: DataFrame, parents: DataFrame, *, hidden: DataFrame | None = None) -> DataFrame:
    """What a peer must be sent that holds the clocks of known (entity, head; a row for each entity that it knows):
    entity, kind, place, event. current: nothing (event is null). bridge: a row for each event that is new to it,
    place counting from 0 with parents first; only where the log's head descends from what it knows and none of the
    events is in hidden (entity, event). snapshot: the state itself (event is null), for all others."""
    now = clocks_of(events, parents)
    held = known.groupBy("entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("head")))).alias("other"))
    pairs = now.withColumnRenamed("head", "subject").join(held, "entity", "left")
    verdicts = compare(pairs.where("other IS NOT NULL"), events, parents).select("entity", "verdict", "subject", "other")
    nothing = F.expr("filter(subject, x -> false)")
    asked = verdicts.where("verdict = 'descends'").select("entity", F.col("other").alias("meet"), nothing.alias("head"), F.col("subject").alias("incoming"))
    sent = layers(asked, events, parents).select("entity", "layer", "event")
    if hidden is not None:
        sent = sent.join(sent.join(hidden.select("entity", "event"), ["entity", "event"], "left_semi").select("entity").distinct(), "entity", "left_anti")
    place = F.row_number().over(W.partitionBy("entity").orderBy("layer", "event")) - 1
    sent = sent.select("entity", F.lit("bridge").alias("kind"), place.cast("long").alias("place"), "event")
    none = F.lit(None).cast(_kinds(events)["event"]).alias("event")
    told = pairs.select("entity").join(verdicts, "entity", "left").join(sent.select("entity").distinct().withColumn("bridged", F.lit(True)), "entity", "left")
    rest = told.where("bridged IS NULL").select("entity", F.when(F.col("verdict") == "equal", "current").otherwise("snapshot").alias("kind"), F.lit(0).cast("long").alias("place"), none)
    return sent.unionByName(rest)


def deltas(known: DataFrame, events: DataFrame, parents: DataFrame) -> DataFrame:
    """The size of what bridges() sends: entity, kind, n_events."""
    return bridges(known, events, parents).groupBy("entity", "kind").agg(F.count("event").alias("n_events"))


def expand_known(matches: DataFrame, known: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """The matches of a predicate and, besides, the states of the entities that the peer knows (known: the key) and
    that no longer match; ids without a state are skipped."""
    rest = states.join(known.select(key).distinct(), key, "left_semi").join(matches.select(key), key, "left_anti")
    return matches.unionByName(rest)


def classify(incoming: DataFrame, current: DataFrame, events: DataFrame, parents: DataFrame) -> DataFrame:
    """What each incoming event (entity, event; already in the log) does to a state with the clock of current
    (entity, head): entity, event, effect, one of create, apply, ignore, merge, reject. An entity without a head is
    created by an event without parents, and rejects all others."""
    kinds = _kinds(events)
    rooted = events.select("entity", "event").distinct().join(parents.select("entity", "event").distinct(), ["entity", "event"], "left_anti").withColumn("root", F.lit(True))
    empty = F.expr("cast(array() as array<string>)").cast(T.ArrayType(kinds["event"]))
    asked = incoming.select("entity", "event").distinct().join(current, "entity", "left").join(rooted, ["entity", "event"], "left")
    pairs = asked.select("entity", F.array("event").alias("subject"), F.coalesce("head", empty).alias("other"), F.coalesce("root", F.lit(False)).alias("root"))
    found = compare(pairs, events, parents)
    effect = F.when(F.size("other") == 0, F.when(F.col("root"), "create").otherwise("reject")).when(F.col("verdict") == "descends", "apply").when(F.col("verdict").isin("equal", "ascends"), "ignore").when(F.col("verdict") == "diverged", "merge").otherwise("reject")
    return found.select("entity", F.col("subject")[0].alias("event"), effect.alias("effect"))


def adopt(incoming: DataFrame, current: DataFrame, events: DataFrame, parents: DataFrame) -> DataFrame:
    """What a received state (incoming: entity, head) does beside the one held (current: entity, head): entity,
    action, one of adopt, keep, needs_events (the histories part), reject (no history in common)."""
    pairs = incoming.select("entity", F.col("head").alias("subject")).join(current.select("entity", F.col("head").alias("other")), "entity", "left")
    fresh = pairs.where("other IS NULL OR size(other) = 0").select("entity", F.lit("adopt").alias("action"))
    action = F.when(F.col("verdict") == "descends", "adopt").when(F.col("verdict").isin("equal", "ascends"), "keep").when(F.col("verdict") == "diverged", "needs_events").otherwise("reject")
    return compare(pairs.where("size(other) > 0"), events, parents).select("entity", action.alias("action")).unionByName(fresh)


def memberships(events: DataFrame) -> DataFrame:
    """events: entity, added (array of models). entity, models: all that were ever added, ascending."""
    return events.select("entity", F.explode_outer("added").alias("model")).groupBy("entity").agg(F.array_sort(F.collect_set("model")).alias("models"))


def faults(events: DataFrame) -> DataFrame:
    """events: entity, event, kind (genesis or update), parents (array). Adds fault, null for a sound event: the first
    of genesis_with_parent, genesis_id_mismatch, update_without_parent, unknown_kind."""
    bare = F.coalesce(F.size("parents"), F.lit(0)) <= 0
    genesis = F.col("kind") == "genesis"
    made = F.when(genesis & ~bare, "genesis_with_parent").when(genesis & ~F.col("event").eqNullSafe(F.col("entity")), "genesis_id_mismatch").when((F.col("kind") == "update") & bare, "update_without_parent")
    return events.withColumn("fault", made.when(~F.coalesce(F.col("kind").isin("genesis", "update"), F.lit(False)), "unknown_kind"))


def text_state(edits: DataFrame, parents: DataFrame) -> DataFrame:
    """Merged texts. edits: entity, event, property, seq, at, removed, inserted: at code point at of the text as the
    event's own past shows it, removed code points go and inserted comes; seq orders an event's edits. Returns entity,
    property, value.

    Every character is known by its event and stands after the one that it was written after; of characters written
    after the same one by events that do not know of each other, those of the larger event come first. So the result
    depends on the log alone, not on the order in which events came. A place beyond the end is the end. An entity
    whose events form one line has its edits replayed in order; edits with forks cost the square of their number."""
    kinds = _kinds(edits)
    schema = T.StructType([T.StructField("entity", kinds["entity"]), T.StructField("property", kinds["property"]), T.StructField("value", T.StringType())])

    def kernel(table: pa.Table) -> Iterator[pa.Table]:
        graph, entities, names, entity = _read(table)
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        rows = np.flatnonzero(pc.is_valid(table["seq"]).combine_chunks().to_numpy(zero_copy_only=False))
        (event,), _ = dag.codes(table["event"])
        node = graph.find(entity[rows], event[rows])
        edit = table.take(pa.array(rows)).select(["property", "seq", "at", "removed", "inserted"]).to_pylist()
        up: dict[int, list[int]] = {}
        for c, p in zip(graph.child.tolist(), graph.parent.tolist(), strict=True):
            up.setdefault(c, []).append(p)
        order = sorted(range(len(rows)), key=lambda k: (graph.entity[node[k]], graph.generation[node[k]], rank[graph.event[node[k]]], edit[k]["seq"]))
        made: dict[tuple[int, str], list] = {}
        plain: dict[tuple[int, str], str] = {}
        pasts: dict[int, set[int]] = {}
        top = np.zeros(len(entities), np.int64)
        np.maximum.at(top, graph.entity, graph.generation + 1)
        straight = top == np.bincount(graph.entity, minlength=len(entities))

        def past(n: int) -> set[int]:
            if n not in pasts:
                seen, todo = {n}, [n]
                while todo:
                    for p in up.get(todo.pop(), ()):
                        if p not in seen:
                            seen.add(p)
                            todo.append(p)
                pasts.clear()
                pasts[n] = seen
            return pasts[n]

        for k in order:
            n, e = int(node[k]), edit[k]
            of = (int(graph.entity[n]), e["property"])
            if straight[of[0]]:
                text = plain.get(of, "")
                at = min(max(0, e["at"] or 0), len(text))
                plain[of] = text[:at] + (e["inserted"] or "") + text[at + max(0, e["removed"] or 0) :]
                continue
            # a character: [text, its event, depth of its chain, removed by]
            line = made.setdefault(of, [])
            known = past(n)
            shown = [c for c, x in enumerate(line) if x[1] in known and not x[3] & known]
            at = min(max(0, e["at"] or 0), len(shown))
            for c in shown[at : at + max(0, e["removed"] or 0)]:
                line[c][3].add(n)
            left = shown[at - 1] if at else -1
            parent = line[left][4] if left >= 0 else None
            spot = left + 1
            mine = int(rank[graph.event[n]])
            # pass over what was written after the same character by larger events unknown here, and what follows it
            while spot < len(line) and line[spot][1] not in known and (line[spot][2] == parent and line[spot][5] > mine or line[spot][2] != parent and _under(line, spot, parent)):
                spot += 1
            for text in e["inserted"] or "":
                name = (n, e["seq"], len(line), spot)
                line.insert(spot, [text, n, parent, set(), name, mine])
                parent, spot = name, spot + 1
        plain |= {of: "".join(x[0] for x in line if not x[3]) for of, line in made.items()}
        yield pa.table([entities.take(pa.array([k[0] for k in plain], pa.int64())), pa.array([k[1] for k in plain], pa.string()), pa.array(list(plain.values()), pa.string())], names=schema.names)

    return _run(_graph(edits, parents, "property", "seq", "at", "removed", "inserted"), kernel, schema)


def _under(line: list, spot: int, top: object) -> bool:
    """Whether the character at spot follows, through those it was written after, one that was written after top."""
    by_name = {x[4]: x for x in line[:spot]}
    at = line[spot][2]
    while at is not None and at != top:
        at = by_name[at][2] if at in by_name else None
    return at == top
