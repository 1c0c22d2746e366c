"""What lies two arcs from each vertex, brought to a task a block of vertices: for kernels that list or count there what a join of
a graph with itself would send through a shuffle, path by path.

A block is a range of ids with about ``ARCS`` arcs. Its task gets the arcs of its own vertices, and those of the vertices that
these lead to: a vertex is sent once to each block that needs it, as its neighbours' differences in as few bytes as hold them.
So what is sent grows with arcs times the blocks that need them, not with paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

ARCS = 1_000_000
#: Arcs that a task holds while it packs them.
CHUNK = 2_000_000
ROWS = "key long, first long, width int, near binary"


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _packed(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """ROWS: the values ``b`` of each ``a``, the first and then differences."""
    order = np.lexsort((b, a))
    a, v = a[order], b[order].view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    lengths = np.diff(np.append(starts, len(a)))
    step = np.zeros(len(v), np.uint64)
    step[1:] = v[1:] - v[:-1]
    step[starts] = 0
    widest = np.maximum.reduceat(step, starts)
    width = np.left_shift(1, np.searchsorted(np.array([1 << 8, 1 << 16, 1 << 32], np.uint64), widest, side="right"))
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        for at in range(0, len(rows), 50_000):
            r = rows[at : at + 50_000]
            n = lengths[r]
            data, ends = step[runs(starts[r], n)].astype(f"<u{w}"), np.concatenate([[0], np.cumsum(n * w)]).astype(np.int32)
            near = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(a[starts[r]]), pa.array(v[starts[r]].view(np.int64)), pa.array(np.full(len(r), w, np.int32)), near], names=["key", "first", "width", "near"])


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in ascending order, how many values each has, all values in this order)."""
    table = table.take(pa.array(np.argsort(table["key"].to_numpy(), kind="stable"))).combine_chunks()
    key, first, width = (table[c].to_numpy() for c in ("key", "first", "width"))
    size = np.zeros(len(key), np.int64)
    found = []
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        if not len(rows):
            continue
        near = pa.concat_arrays(table["near"].take(pa.array(rows)).cast(pa.large_binary()).chunks)
        ends = np.frombuffer(near.buffers()[1], np.int64)[near.offset : near.offset + len(rows) + 1]
        step = np.frombuffer(near.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(f"<u{w}")
        n = np.diff(ends) // w
        total = np.cumsum(step, dtype=np.uint64)
        total -= np.repeat(total[np.cumsum(n) - n] - first[rows].view(np.uint64), n)
        size[rows] = n
        found.append((rows, total.view(np.int64)))
    if len(found) == 1:
        values = found[0][1]
    else:
        values, starts = np.empty(size.sum(), np.int64), np.cumsum(size) - size
        for rows, v in found:
            values[runs(starts[rows], size[rows])] = v
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[fresh], np.add.reduceat(size, fresh) if len(key) else size, values


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield tuple(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            held = []
    if held:
        yield tuple(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))


def _block(bounds: list[float], ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(bounds), ids.astype(np.float64), side="right").astype(np.int32)


def _pack(bounds: list[float] | None):
    """ROWS of arcs (a, b) by a; with ``bounds`` each with the block of a before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _chunks(batches):
            for rows in _packed(a, b):
                yield rows if bounds is None else pa.RecordBatch.from_arrays([pa.array(_block(bounds, rows.column(0).to_numpy())), *rows.columns], names=["b", *rows.schema.names])

    return run


def _needs(bounds: list[float]):
    """(b, key): what the block of a needs for arcs (a, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, key in _chunks(batches):
            b = _block(bounds, a)
            order = np.lexsort((key, b))
            b, key = b[order], key[order]
            fresh = np.concatenate([[True], (b[1:] != b[:-1]) | (key[1:] != key[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(b[fresh]), pa.array(key[fresh])], names=["b", "key"])

    return run


Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def two_steps(first: DataFrame, second: DataFrame, kernel: Callable[[Lists, Lists], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``kernel`` gives for each block of the vertices a of ``first``, arcs (a, m): it gets their arcs, and the arcs (m, c) of
    ``second`` from all m that these lead to, both as ``unpacked`` gives them. Both are read several times, so they should be cheap."""
    ship(first.sparkSession)
    a, m = first.columns
    blocks = -(-first.count() // ARCS) or 1
    bounds = sorted({*first.approxQuantile(a, [i / blocks for i in range(1, blocks)], 0.25 / blocks)}) if blocks > 1 else []
    own = first.mapInArrow(_pack(bounds), f"b int, {ROWS}").select("b", F.lit(True).alias("own"), "key", "first", "width", "near")
    need = first.mapInArrow(_needs(bounds), "b int, key long").repartition(blocks, "key").distinct()
    there = second.mapInArrow(_pack(None), ROWS).repartition(blocks, "key").join(need, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        block = table["b"].to_numpy()
        for b in np.unique(block):
            part = table.filter(pa.array(block == b))
            yield from kernel(unpacked(part.filter(part["own"])), unpacked(part.filter(pa.array(~part["own"].to_numpy()))))

    return own.union(there.select("b", F.lit(False), "key", "first", "width", "near")).repartitionById(len(bounds) + 1, "b").mapInArrow(run, schema)


def local(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each value in the ascending ``ids``, whether it is there)."""
    if not len(ids):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
    return at, ids[at] == values
