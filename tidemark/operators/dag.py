"""Graph passes over whole entities: numpy kernels that see many entities' events at once, in linear time and memory.

A row stream sorted by entity is cut into chunks of whole entities; each chunk is one graph. Edges to events that the
chunk does not hold are dead ends. A chunk holds some 40 bytes for each event and edge; only an entity that is larger
than CHUNK_ROWS by itself makes a larger chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.errors import EngineError

CHUNK_ROWS = 50_000


class CycleError(EngineError, ValueError):
    """Events that are their own ancestors."""


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Tables of whole entities from batches sorted by the column entity."""
    held, size, wanted = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= wanted:
            whole = pa.Table.from_batches(held).combine_chunks()
            first = pc.index(whole["entity"], whole["entity"][-1]).as_py()
            if first:
                yield whole.slice(0, first)
                whole = whole.slice(first)
                wanted = rows
            held, size = whole.to_batches(), whole.num_rows
            wanted = max(wanted, 2 * size)  # an entity beyond the chunk: look again when it has doubled
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Each column as places in one array of their distinct values; -1 for null."""
    whole = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks()
    coded = whole.dictionary_encode()
    every = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(every, np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary


class Dag:
    """Of a chunk's rows (entity, event, parent; a null parent names the event itself): nodes, edges and generations."""

    def __init__(self, entity: np.ndarray, event: np.ndarray, parent: np.ndarray):
        self.span = int(max(event.max(initial=0), parent.max(initial=0))) + 1
        own = np.flatnonzero(parent < 0)
        self.keys, first = np.unique(entity[own] * self.span + event[own], return_index=True)
        self.entity, self.event, self.size = entity[own[first]], event[own[first]], len(first)
        edge = np.flatnonzero(parent >= 0)
        child, above = self.find(entity[edge], event[edge]), self.find(entity[edge], parent[edge])
        real = (child >= 0) & (above >= 0)
        self.child, self.parent = child[real], above[real]
        self._layers()

    def find(self, entity: np.ndarray, event: np.ndarray) -> np.ndarray:
        """Nodes of events; -1 where there is none."""
        if not self.size:
            return np.full(len(event), -1)
        wanted = entity * self.span + event
        at = np.minimum(np.searchsorted(self.keys, wanted), self.size - 1)
        return np.where((event >= 0) & (self.keys[at] == wanted), at, -1)

    def _layers(self) -> None:
        self.generation = generations(self.size, self.child, self.parent)
        order = np.argsort(self.generation[self.child], kind="stable")
        self.child, self.parent = self.child[order], self.parent[order]
        self.bounds = np.searchsorted(self.generation[self.child], np.arange(int(self.generation.max(initial=0)) + 2))

    def spread_up(self, marks: np.ndarray) -> np.ndarray:
        """marks (bits by node) handed from every event to its ancestors."""
        for layer in range(len(self.bounds) - 2, 0, -1):
            a, b = self.bounds[layer], self.bounds[layer + 1]
            np.bitwise_or.at(marks, self.parent[a:b], marks[self.child[a:b]])
        return marks

    def below(self, own: np.ndarray) -> np.ndarray:
        """Of each node the bits that its proper descendants have in own."""
        under = np.zeros_like(own)
        for layer in range(len(self.bounds) - 2, 0, -1):
            a, b = self.bounds[layer], self.bounds[layer + 1]
            np.bitwise_or.at(under, self.parent[a:b], (under | own)[self.child[a:b]] if b - a > self.size // 4 else under[self.child[a:b]] | own[self.child[a:b]])
        return under


def generations(size: int, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The longest path to each node from one without parents."""
    order = np.argsort(parent, kind="stable")
    to = child[order]
    starts = np.searchsorted(parent[order], np.arange(size + 1))
    waiting = np.bincount(child, minlength=size)
    made = np.zeros(size, np.int64)
    front, layer, done = np.flatnonzero(waiting == 0), 0, 0
    while len(front):
        made[front] = layer
        done += len(front)
        counts = starts[front + 1] - starts[front]
        total = int(counts.sum())
        if not total:
            break
        reached = to[np.repeat(starts[front] - np.cumsum(counts) + counts, counts) + np.arange(total)]
        np.subtract.at(waiting, reached, 1)
        front = np.unique(reached[waiting[reached] == 0])
        layer += 1
    if done < size:
        raise CycleError("the log has a cycle")
    return made


def lists(nodes: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """nodes grouped by owner: the nodes in that order, and where each owner's begin and end."""
    order = np.argsort(owner, kind="stable")
    return nodes[order], np.searchsorted(owner[order], np.arange(owners + 1))


def over_entities(kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that gives kernel whole entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            yield from kernel(table)

    return run
