"""Operator 7, mixing sources to target weights by Pfair scheduling.

A source's rows, in the order of a hash of their ids, form blocks of equal size. In the ideal mix all sources that
still have blocks get parts of each slot in proportion to their weights, until their blocks are used up; the others
then share what is free. A block is released at the slot in which its part of the ideal mix begins and is due at the
end of the slot in which it ends; in each slot the released block that is due first goes (earliest deadline first).
With w a source's share, block i (from 0) of the first phase is released at slot floor(i / w) and due before slot
ceil((i + 1) / w). Weights are exact rationals, so in every prefix of the whole schedule a source is less than one
block from the ideal mix.

No row is dropped or repeated. A phase ends where the ideal mix uses up a source. The schedule (a row for each block)
is made in one task from the sources' sizes and written; that task holds a few hundred bytes for each source, which is
the only limit on their number, and its time grows with the blocks.

Defined results: null sources form a source of their own; sources without a weight, or of weight 0, follow after all
others with equal shares; repeated rows each get a place; a null id is hashed like any value; no rows, no slots.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ready, table

BLOCK, BIN_ROWS = 32, 8192
NO_SOURCE = "\x00none"


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int, int]]:
    """source, block, phase, released, due, slot of every block, by slot."""
    slot = phase = 0
    weighty = {s: Fraction(w) for s in blocks if (w := weights.get(s, 0)) > 0}
    for tier in (weighty, {s: Fraction(1) for s in blocks if s not in weighty}):
        shares = {s: w for s, w in tier.items() if blocks[s]}
        if shares:
            scale = math.lcm(*(w.denominator for w in shares.values()))
            ends = yield from _tier({s: blocks[s] for s in shares}, {s: int(w * scale) for s, w in shares.items()}, slot, phase)
            slot, phase = slot + sum(blocks[s] for s in shares), phase + ends


def _tier(blocks: dict[str, int], shares: dict[str, int], first_slot: int, first_phase: int):
    """The schedule of sources with whole-numbered shares; returns its number of phases.

    At the ideal mix's time v a source of share a has had min(a * v, its blocks); all together have had a slot each
    v * (shares of those that still have blocks) + (blocks of the others)."""
    ends = sorted({Fraction(n, shares[s]) for s, n in blocks.items()})
    leaving = dict.fromkeys(ends, (0, 0))
    for s, n in blocks.items():
        end = Fraction(n, shares[s])
        leaving[end] = (leaving[end][0] + shares[s], leaving[end][1] + n)
    open_, used = [sum(shares.values())], [0]  # by phase
    for end in ends[:-1]:
        open_.append(open_[-1] - leaving[end][0])
        used.append(used[-1] + leaving[end][1])

    def at(i: int, share: int, phase: int) -> tuple[int, int, int]:
        """Slots used, rounded down and up, when i blocks of the source are, and the phase (not before the given one)."""
        if i * ends[phase].denominator > ends[phase].numerator * share:
            phase = bisect_left(ends, Fraction(i, share), phase)
        whole, rest = divmod(i * open_[phase], share)
        return used[phase] + whole, used[phase] + whole + (rest > 0), phase

    def job(s: str, i: int, released: int, phase: int) -> tuple:
        """due, source, block, released, phase, and the release and phase of the next block"""
        low, high, then = at(i + 1, shares[s], phase)
        return high, s, i, released, phase, low, then

    ready, waiting = [job(s, 0, 0, 0) for s in blocks], []
    heapq.heapify(ready)
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            released, s, i, phase = heapq.heappop(waiting)
            heapq.heappush(ready, job(s, i, released, phase))
        due, s, i, released, phase, low, then = heapq.heappop(ready)
        assert slot < due
        yield s, i, first_phase + phase, first_slot + released, first_slot + due, first_slot + slot
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (low, s, i + 1, then))
    return len(ends)


def period_table(units: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source where the blocks are in proportion to the weights."""
    slots: dict[str, list[int]] = {s: [] for s in units}
    for s, *_, slot in schedule(units, units):
        slots[s].append(slot)
    return slots


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, bin_rows: int = BIN_ROWS) -> DataFrame:
    """docs' rows as a struct row_, with source_ (null as NO_SOURCE), block, phase, released, due, slot, place (in the
    block). Order by slot, place is the mix. weights by source; without it a source weighs the square root of its size.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    bins = max(1, -(-docs.count() // bin_rows))
    order = F.xxhash64(id_col)
    slim = docs.select(named.alias("source_"), F.pmod(order, F.lit(bins)).alias("bin_"))
    counts = materialize(slim.groupBy("source_", "bin_").count(), "bins")
    ready(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {s: n for batch in batches for s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
        made = schedule({s: -(-n // block) for s, n in sizes.items()}, {s: n**0.5 for s, n in sizes.items()} if weights is None else weights)
        names = ["source_", "block", "phase", "released", "due", "slot"]
        kinds = [pa.string(), *[pa.int64()] * 5]
        while rows := list(islice(made, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    sizes = counts.groupBy("source_").agg(F.sum("count").alias("rows")).repartition(1)
    plan = materialize(sizes.mapInArrow(deal, "source_ string, block long, phase long, released long, due long, slot long"), "slots")
    before = counts.select("source_", "bin_", (F.sum("count").over(W.partitionBy("source_").orderBy("bin_")) - F.col("count")).alias("before_"))
    keyed = docs.select(F.struct("*").alias("row_"), named.alias("source_"), F.pmod(order, F.lit(bins)).alias("bin_"), order.alias("hash_"), F.col(id_col).alias("id_"))
    # a hot source is spread over its bins; both sides and the ranking use the same distribution
    ranked = keyed.join(before.hint("merge"), ["source_", "bin_"]).withColumn("rank_", F.col("before_") + F.row_number().over(W.partitionBy("source_", "bin_").orderBy("hash_", "id_")) - 1)
    blocks = ranked.select("row_", F.col("source_"), F.expr(f"rank_ div {block}").alias("block"), F.pmod("rank_", F.lit(block)).alias("place"))
    return blocks.join(plan, ["source_", "block"]).select("row_", "source_", "block", "phase", "released", "due", "slot", "place")


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of docs, all columns, in the order of the mix: written files hold it by part number and row."""
    mixed = mix(docs, weights, **options)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row_.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("row_.doc_id", "row_.source", "block", "phase", "released", "due", "slot", "place")
