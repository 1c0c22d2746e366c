"""Cliques, loops ignored: all of a size by joins, largest ones by a search kernel in each vertex's later neighbourhood."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph, UnsupportedConfiguration
from ..session import cut, ship
from .blocks import Lists, local, runs, two_steps


#: Vertices of more edges are hubs, of which there are few.
HUB = 1000


def oriented(t: Graph) -> DataFrame:
    """(src, dst): each undirected edge once, towards the greater id, but from others to hubs, and among hubs towards the greater degree; so hubs have few edges out."""
    e = t.edges.where("src < dst").select("src", "dst")
    hubs = cut(t.edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")).where(F.col("d") > HUB))
    if hubs.isEmpty():
        return e
    of = lambda c: F.broadcast(hubs.select(F.col("id").alias(c), F.col("d").alias(f"d{c}")))
    both = e.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    up = F.coalesce("dsrc", F.lit(0)) <= F.coalesce("ddst", F.lit(0))
    return both.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"))


#: Rows of a level, or pairs of such rows, that a kernel holds at once.
LEVEL = 500_000


def _triangles(own: Lists, there: Lists) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """(ids, edges between them as codes, triangles with their first vertex in the block), of places in ids."""
    ids = np.unique(np.concatenate([own[0], own[2]]))
    size = len(ids)
    mid, lengths, values = there
    to, inside = local(ids, values)
    row = np.repeat(local(ids, mid)[0], lengths)[inside]
    to = to[inside]
    degree = np.bincount(row, minlength=size)
    start = np.cumsum(degree) - degree
    code = row * size + to
    mark = np.zeros(size, bool)

    def found() -> Iterator[np.ndarray]:
        held: list[np.ndarray] = []
        n = 0
        near_all, ends = local(ids, own[2])[0], np.cumsum(own[1])
        for a, i, j in zip(local(ids, own[0])[0].tolist(), (ends - own[1]).tolist(), ends.tolist()):
            near = near_all[i:j]
            count = degree[near]
            mark[near] = True
            last = to[runs(start[near], count)]
            hit = np.flatnonzero(mark[last])
            mark[near] = False
            if len(hit):
                held.append(np.stack([np.full(len(hit), a), np.repeat(near, count)[hit], last[hit]]))
                n += len(hit)
            if n >= LEVEL:
                yield np.concatenate(held, axis=1)
                held, n = [], 0
        if held:
            yield np.concatenate(held, axis=1)

    return ids, code, found()


def _larger(level: np.ndarray, code: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Cliques of one vertex more: of two that share all but their last vertices, if an edge joins these. Equal beginnings are in a row, and are so in what comes out."""
    fresh = np.concatenate([[True], (level[:-1, 1:] != level[:-1, :-1]).any(axis=0)])
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    start, count = first[group], np.diff(np.append(first, level.shape[1]))[group]
    cuts = np.searchsorted(np.cumsum(count), np.arange(0, count.sum() + LEVEL, LEVEL))
    for i, j in zip(cuts[:-1], np.append(cuts[1:-1], level.shape[1])):
        x = np.repeat(np.arange(i, j), count[i:j])
        y = runs(start[i:j], count[i:j])
        there = local(code, level[-1, x] * size + level[-1, y])[1]
        if there.any():
            yield np.concatenate([level[:, x[there]], level[-1:, y[there]]])


def _sized(k: int, level: np.ndarray, code: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """All cliques of 3 to k vertices that begin as those of ``level``, that level included."""
    yield level
    if level.shape[0] < k:
        for more in _larger(level, code, size):
            yield from _sized(k, more, code, size)


def _listing(k: int):
    def kernel(own: Lists, there: Lists) -> Iterator[pa.RecordBatch]:
        ids, code, triangles = _triangles(own, there)
        code = np.sort(code) if k > 3 else code
        for level in triangles:
            for c in _sized(k, level, code, len(ids)):
                if len(c) == k:
                    for at in range(0, c.shape[1], 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[x]) for x in c[:, at : at + 100_000]], names=[f"c{i}" for i in range(1, k + 1)])

    return kernel


def _counting(most: int):
    def kernel(own: Lists, there: Lists) -> Iterator[pa.RecordBatch]:
        ids, code, triangles = _triangles(own, there)
        code = np.sort(code) if most > 3 else code
        n = np.zeros(most + 1, np.int64)
        for level in triangles:
            for c in _sized(most, level, code, len(ids)):
                n[len(c)] += c.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3, most + 1, dtype=np.int32)), pa.array(n[3:])], names=["size", "cliques"])

    return kernel


def cliques(t: Graph, k: int, edges: DataFrame | None = None) -> DataFrame:
    """(c1, .., ck): each clique of k vertices once, in the order of its edges' orientation.

    From three vertices on, the task of a block of vertices finds those that begin there: triangles from the edges of their
    first vertex, then level by level. Nothing but edges is shuffled.
    """
    if k == 1:
        return t.vertices.select(F.col("id").alias("c1"))
    e = edges if edges is not None else oriented(t)
    if k == 2:
        return e.select(F.col("src").alias("c1"), F.col("dst").alias("c2"))
    return two_steps(e, e, _listing(k), ", ".join(f"c{i} long" for i in range(1, k + 1)))


ORDERS = ("colour", "singletons", "sorted")


@dataclass
class CliqueResult:
    """``complete`` is False where time ran out: ``members`` are then the best so far."""

    members: list[int]
    nodes: int = 0
    complete: bool = True

    @property
    def size(self) -> int:
        return len(self.members)


def search_clique(adjacent: list[int], above: int = 0, order: str = "singletons", input_order: bool = False, decide: int | None = None, touching: list[int] | None = None, timeout: float | None = None) -> CliqueResult:
    """A largest clique of more than ``above`` vertices, or none, of a graph as bit sets of neighbours: branch and bound, with a
    greedy colouring as the bound.

    ``order``: of the colours, as they come, those of one vertex first, or the larger first. Vertices are numbered by degree,
    or as given with ``input_order``. ``decide`` ends with the first clique of that many. With ``touching``, bit sets too, each
    vertex but the first must touch one before it.
    """
    if order not in ORDERS:
        raise UnsupportedConfiguration(f"order is one of {', '.join(ORDERS)}")
    n = len(adjacent)
    by = list(range(n)) if input_order else sorted(range(n), key=lambda v: (-adjacent[v].bit_count(), v))
    at = {v: i for i, v in enumerate(by)}
    moved = lambda sets: [sum(1 << at[w] for w in _bits(sets[v])) for v in by]
    near = adjacent if input_order else moved(adjacent)
    touch = None if touching is None else touching if input_order else moved(touching)
    result = CliqueResult([])
    most = max(above, (decide or 0) - 1)
    deadline = None if timeout is None else time.monotonic() + timeout

    def colours(left: int) -> tuple[list[int], list[int]]:
        classes: list[list[int]] = []
        while left:
            free, own = left, []
            while free:
                v = (free & -free).bit_length() - 1
                free &= ~(near[v] | (1 << v))
                left &= ~(1 << v)
                own.append(v)
            classes.append(own)
        if order == "singletons":
            classes.sort(key=lambda c: len(c) > 1)
        elif order == "sorted":
            classes.sort(key=len, reverse=True)
        return [v for c in classes for v in c], [k for k, c in enumerate(classes, 1) for _ in c]

    def expand(chosen: list[int], left: int, around: int) -> bool:
        """False once the search is to end."""
        nonlocal most
        result.nodes += 1
        if deadline is not None and time.monotonic() > deadline:
            result.complete = False
            return False
        vertices, bound = colours(left)
        skipped = 0
        for v, most_here in zip(reversed(vertices), reversed(bound)):
            if len(chosen) + most_here + skipped <= most:
                return True
            if touch is not None and chosen and not around >> v & 1:
                skipped += 1
                continue
            chosen.append(v)
            if len(chosen) > most:
                most, result.members = len(chosen), chosen.copy()
            if decide is not None and len(chosen) >= decide or not expand(chosen, left & near[v], 0 if touch is None else around | touch[v]):
                return False
            chosen.pop()
            left &= ~(1 << v)
        return True

    if decide is None or decide > 0:
        expand([], (1 << n) - 1, 0)
    result.members = sorted(by[v] for v in result.members)
    return result


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def largest(adjacent: list[int], above: int = 0, **kw) -> list[int]:
    return search_clique(adjacent, above, **kw).members


def local_clique_size(p: LocalGraph, v: int) -> int:
    """Vertices of the largest clique through v."""
    near = sorted(p.neighbours(v) - {v})
    at = {w: i for i, w in enumerate(near)}
    return 1 + len(largest([sum(1 << at[x] for x in p.neighbours(w) if x in at and x != w) for w in near]))


def _adjacency(rows: pa.Table) -> tuple[list[int], list[int]]:
    """(ids, neighbours as bit sets) of rows (a, b), where a null b only names a vertex."""
    a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
    there = ~np.isnan(b) if b.dtype.kind == "f" else np.ones(len(b), bool)
    ids = np.unique(a)
    adjacent = [0] * len(ids)
    for x, y in zip(np.searchsorted(ids, a[there]).tolist(), np.searchsorted(ids, b[there].astype(np.int64)).tolist()):
        adjacent[x] |= 1 << y
        adjacent[y] |= 1 << x
    return ids.tolist(), adjacent


def _kernel(options: dict):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, adjacent = _adjacency(rows)
        r = search_clique(adjacent, **options)
        found = sorted([key[0].as_py(), *(ids[i] for i in r.members)])
        return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([len(found)], pa.int32()), "members": pa.array([found], pa.list_(pa.int64())), "nodes": pa.array([r.nodes], pa.int64()), "complete": pa.array([r.complete])})

    return run


CLIQUE = "id long, size int, members array<long>, nodes long, complete boolean"


def _through(key: tuple, rows: pa.Table) -> pa.Table:
    """The largest clique through the group's vertex and each of the others."""
    ids, adjacent = _adjacency(rows)
    sizes = []
    for i in range(len(ids)):
        inside = list(_bits(adjacent[i]))
        at = {v: k for k, v in enumerate(inside)}
        sizes.append(2 + len(largest([sum(1 << at[w] for w in _bits(adjacent[v]) if w in at) for v in inside])))
    own = key[0].as_py()
    return pa.table({"id": pa.array([own, *ids], pa.int64()), "size": pa.array([max(sizes, default=1), *sizes], pa.int32())})


def _neighbourhoods(e: DataFrame) -> DataFrame:
    """(id, a, b): the edges among the vertices that id has edges to, and (id, a, null) for these vertices."""
    inside = two_steps(e, e, _listing(3), "c1 long, c2 long, c3 long").toDF("id", "a", "b")
    return inside.union(e.select("src", "dst", F.lit(None).cast("long")))


def max_cliques(t: Graph, **kw) -> DataFrame:
    """CLIQUE: for each vertex, a largest clique of it and vertices its oriented edges lead to; a vertex without any is a clique
    of one. ``kw``: options of ``search_clique``, for each of these searches."""
    ship(t.edges.sparkSession)
    e = oriented(t)
    found = _neighbourhoods(e).groupBy("id").applyInArrow(_kernel(kw), CLIQUE)
    alone = t.vertices.select("id").join(e.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(1).alias("size"), F.array("id").alias("members"), F.lit(0).cast("long").alias("nodes"), F.lit(True).alias("complete"))
    return found.union(alone)


def clique_number(t: Graph) -> DataFrame:
    """(clique_number): 0 of an empty graph."""
    return max_cliques(t).agg(F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("clique_number"))


def max_clique(t: Graph) -> list[int]:
    """The members of a largest clique."""
    return solve_clique(t).members


def solve_clique(t: Graph, decide: int | None = None, **kw) -> CliqueResult:
    """A largest clique; with ``decide`` one of at least that many, or none. ``timeout`` is that of each task's search."""
    if decide is not None:
        if decide <= 0:
            return CliqueResult([])
        kw["decide"] = max(1, decide - 1)  # the vertex that the neighbourhood is of comes with what is found in it
    rows = max_cliques(t, **kw)
    best = rows.agg(F.max(F.struct("size", F.negative("id").alias("i"), "members")).alias("m"), F.coalesce(F.sum("nodes"), F.lit(0)).alias("n"), F.coalesce(F.bool_and("complete"), F.lit(True)).alias("c")).first()
    members = [] if best["m"] is None or decide is not None and best["m"]["size"] < decide else list(best["m"]["members"])
    return CliqueResult(members, best["n"], best["c"] or decide is not None and bool(members))


def has_clique(t: Graph, k: int) -> bool:
    """Whether there is a clique of k vertices; of 0 there always is."""
    return k <= 0 or not cliques(t, k).isEmpty()


def clique_counts(t: Graph, most: int) -> DataFrame:
    """(size, cliques) for sizes 1..most."""
    e = oriented(t)
    one = lambda k, df: df.agg(F.count("*").alias("cliques")).select(F.lit(k).alias("size"), "cliques")
    out = one(1, t.vertices)
    if most > 1:
        out = out.union(one(2, e))
    if most > 2:
        none = t.edges.sparkSession.range(3, most + 1).select(F.col("id").cast("int").alias("size"), F.lit(0).cast("long").alias("cliques"))
        out = out.union(two_steps(e, e, _counting(most), "size int, cliques long").union(none).groupBy("size").agg(F.sum("cliques").alias("cliques")))
    return out


def clique_sizes(t: Graph) -> DataFrame:
    """(id, size): vertices of the largest clique through each vertex: the kernel finds it for each pair of a vertex and one that
    its oriented edges lead to, so a hub's whole neighbourhood is never in one task."""
    ship(t.edges.sparkSession)
    found = _neighbourhoods(oriented(t)).groupBy("id").applyInArrow(_through, "id long, size int")
    return found.union(t.vertices.select("id", F.lit(1).alias("size"))).groupBy("id").agg(F.max("size").alias("size"))
