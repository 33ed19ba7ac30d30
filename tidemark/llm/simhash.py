"""Operator 4, SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint: a bit is set if over half of the text's 4-word shingles have it in their XXH64 (seed 42).
Two fingerprints with at most 4 differing bits, cut into 3 segments, have one segment that differs in at most one
bit. So each distinct fingerprint is indexed under every one-wildcard variant of each segment (64 rows); an equal
variant makes a candidate, and the whole fingerprints are compared.

The comparison runs over sorted runs of equal variants, vectorised, and yields a spanning forest of the links found,
never all pairs. Above some 4 billion distinct fingerprints the mean run of a variant passes RUN, and most rows take the
second deal too. A run longer than RUN rows is dealt on: the 42 or 43 bits outside its segment are cut into 5 pieces,
of which one must be equal; a run that is long even then is compared block against block.

Defined results: a null, empty or blank text has fingerprint 0 and links like any other; fewer than 4 words are one
shingle; repeated rows each get their row; a null doc_id takes part in linking but never names a component
(component_id is null if no document reached has an id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, join_by_key, materialize, ready, sliced, table
from .graph import connected_components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
RUN = 2048
BLOCK = 2048


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long); keyed: text_key too, the text's hash."""
    ready(docs.sparkSession)
    kept = ["doc_id", "text_key"] if keyed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.int64())], [*kept, "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return slim.select(*kept, "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in [*kept, "fp"]))


def variants(distinct: DataFrame) -> DataFrame:
    """A row for each fingerprint, segment and wildcard: key (segment, place, the segment's other bits), fp."""
    made = []
    for number, (first, width) in enumerate(SEGMENTS):
        bits = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for place in range(width):
            head = (number << 5 | place) << 22
            made.append(bits.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << place))).bitwiseOR(F.lit(head)))
    return distinct.select("fp", F.explode(F.array(*made)).alias("key"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links a-b, one from each node to the smallest node of its component: as many links as nodes, no more."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new[label] if not np.array_equal(new[label], label) else new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def links_of_runs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys (sorted), as a forest."""
    left, right = [], []
    live = np.flatnonzero(np.append(key[1:] == key[:-1], False)) if len(key) else np.empty(0, np.int64)
    distance = 1
    bits = fp.view(np.uint64)
    while len(live):
        close = np.bitwise_count(bits[live] ^ bits[live + distance]) <= MOST_BITS
        left.append(fp[live[close]])
        right.append(fp[live[close] + distance])
        if sum(map(len, left)) > 1_000_000:
            a, b = _forest(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
        distance += 1
        live = live[live + distance < len(key)]
        live = live[key[live] == key[live + distance]]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(np.concatenate(left), np.concatenate(right))


def compare_sorted(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """In: key, fp sorted by key. Out: kind 0 (a link u, v) or kind 1 (a row of a run longer than most: u its key, v its fp)."""
    names = ["kind", "u", "v"]

    def out(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names)

    held_key, held_fp, giving = np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in batches:
        key = np.concatenate((held_key, batch.column(0).to_numpy()))
        fp = np.concatenate((held_fp, batch.column(1).to_numpy()))
        if giving is not None:  # the long run goes on
            same = int(np.searchsorted(key, giving, "right"))
            if same:
                yield out(1, key[:same], fp[:same])
            key, fp = key[same:], fp[same:]
            giving = None if len(key) else giving
        if not len(key):
            held_key, held_fp = key, fp
            continue
        last = int(np.searchsorted(key, key[-1], "left"))
        if most and len(key) - last > most:
            yield out(1, key[last:], fp[last:])
            giving = int(key[-1])
            held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            held_key, held_fp = key[last:], fp[last:]
        yield from settled(key[:last], fp[:last], most, out)
    yield from settled(held_key, held_fp, most, out)


def settled(key: np.ndarray, fp: np.ndarray, most: int | None, out) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    if most:
        run = np.cumsum(np.append(0, key[1:] != key[:-1]))
        long_ = np.bincount(run)[run] > most
        if long_.any():
            yield out(1, key[long_], fp[long_])
            key, fp = key[~long_], fp[~long_]
    yield out(0, *links_of_runs(key, fp))


def _pass(rows: DataFrame, most: int | None) -> DataFrame:
    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return materialize(dealt.mapInArrow(lambda b: compare_sorted(b, most), "kind int, u bigint, v bigint"), "links")


def similar_links(distinct: DataFrame, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) whose components are those of all links at MOST_BITS or fewer."""
    first = _pass(variants(distinct), run)
    links = first.where("kind = 0").select("u", "v")
    long_ = first.where("kind = 1")
    if long_.isEmpty():
        return links
    # the bits outside the segment, in 5 pieces: one of them is equal
    segment = F.shiftright("u", 27).cast("int")
    pieces = []
    for number, (first_bit, width) in enumerate(SEGMENTS):
        rest = [b for b in range(64) if not first_bit <= b < first_bit + width]
        masks = [sum(1 << int(b) for b in part) for part in np.array_split(rest, MOST_BITS + 1)]
        masks = [m - (1 << 64) if m >> 63 else m for m in masks]
        pieces.append((number, F.array(*(F.xxhash64("u", F.lit(k), F.col("v").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)))))
    chosen = F.when(segment == 0, pieces[0][1]).when(segment == 1, pieces[1][1]).otherwise(pieces[2][1])
    second = _pass(long_.select(F.col("v").alias("fp"), F.explode(chosen).alias("key")), run)
    links = links.union(second.where("kind = 0").select("u", "v"))
    still = second.where("kind = 1")
    if still.isEmpty():
        return links
    # block against block: every pair of blocks of a key is a run of its own
    sizes = still.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    placed = still.join(sizes, "u").withColumn("mine", F.pmod(F.xxhash64("v", F.lit(7)), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.xxhash64("u", F.least("mine", o), F.greatest("mine", o)))
    third = _pass(placed.select(F.col("v").alias("fp"), F.explode(pairs).alias("key")), None)
    return links.union(third.where("kind = 0").select("u", "v"))


def _members(made: DataFrame, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """fp, component (a fingerprint of it), component_id, rows of each distinct fingerprint of made (doc_id, fp)."""
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "distinct")
    found = connected_components(similar_links(distinct.select("fp"), run, block))
    named = found.join(distinct, found.node == distinct.fp).select("fp", "component", "first_id")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "component").select("fp", "component", "component_id")
    every = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"), "rows")
    return materialize(every, "members")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, fp (long), component_id (smallest doc_id that links reach, itself included)."""
    made = materialize(fingerprints(docs, id_col, text_col), "simhash")
    return join_by_key(made, _members(made, run, block), "fp", "rows").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component, all columns: one row stays of each group, that with the
    smallest id. Rows without an id go if their group has an id. Texts under one repeated id stay if they are of
    different groups; of a group's texts under its smallest id, and of repeated rows, one stays."""
    spark = docs.sparkSession
    slim = docs.select(F.struct("*").alias("row_"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"))
    made = materialize(fingerprints(docs, id_col, text_col, keyed=True), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("first")
    kept = join_by_key(made, _members(made).select("fp", "component", "rows"), "fp", "rows").groupBy("component").agg(first)
    kept = materialize(kept.select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_key").alias("kept_key")), "kept")
    chosen = slim.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key")), "left_semi")
    if not made.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        chosen = chosen.groupBy("doc_id", "text_key").agg(F.first("row_").alias("row_"))
    return chosen.select("row_.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
