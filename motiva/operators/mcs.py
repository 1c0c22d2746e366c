"""Maximum common induced subgraphs of two graphs, whose labels and loops must agree.

As DataFrames: pairs of vertices that may correspond are the vertices of an association graph, consistent pairs its edges, and
common mappings of a size its cliques of that size. As a search in tasks: vertices of both graphs are split into classes by
how they are connected to the mapping so far, and the sizes of classes bound what can still be mapped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph, UnsupportedConfiguration
from ..session import cut, ship
from .clique import cliques, max_clique, search_clique


def association(f: Graph, s: Graph) -> Graph:
    """Vertices (f, s) of equal label and loop, numbered, with names 'f:s'; edges between those that map arcs and non-arcs alike, with equal labels."""
    def own(g: Graph, name: str) -> DataFrame:
        loops = g.loops().select(F.col("src").alias("id"), F.col("label").alias("loop"))
        return g.vertices.join(loops, "id", "left").select(F.col("id").alias(name), F.col("label"), F.col("loop"))

    a, b = own(f, "f"), own(s, "s")
    pairs = a.join(b.withColumnRenamed("label", "l2").withColumnRenamed("loop", "loop2"), (F.col("label") == F.col("l2")) & F.col("loop").eqNullSafe(F.col("loop2")))
    # Ids are ranks of (f, s): a rank within f, after all pairs of the f before.
    pairs = pairs.select("f", "s", F.row_number().over(Window.partitionBy("f").orderBy("s")).alias("r"))
    sizes = pairs.groupBy("f").agg(F.count("*").alias("n"))
    before = sizes.select("f", (F.sum("n").over(Window.orderBy("f")) - F.col("n")).alias("b"))  # one row for each vertex of f
    ranks = cut(pairs.join(before, "f").select((F.col("b") + F.col("r") - 1).cast("long").alias("id"), "f", "s"))
    x, y = ranks.toDF("x", "fx", "sx"), ranks.toDF("y", "fy", "sy")
    both = x.join(y, (F.col("fx") != F.col("fy")) & (F.col("sx") != F.col("sy")))
    for g, u, v, name in ((f, "fx", "fy", "e1"), (s, "sx", "sy", "e2"), (f, "fy", "fx", "e3"), (s, "sy", "sx", "e4")):
        both = both.join(g.edges.select(F.col("src").alias(u), F.col("dst").alias(v), F.col("label").alias(name)), [u, v], "left")
    edges = both.where(F.col("e1").eqNullSafe(F.col("e2")) & F.col("e3").eqNullSafe(F.col("e4"))).select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit("").alias("label"))
    edges = cut(edges)
    return Graph(ranks.select("id", F.concat_ws(":", "f", "s").alias("name"), F.lit("").alias("label")), edges)


def mappings_of_size(f: Graph, s: Graph, k: int) -> DataFrame:
    """(c1, .., ck): common mappings of k vertices, each once, as vertices of the association graph."""
    return cliques(association(f, s), k)


def mcs_by_clique(f: Graph, s: Graph, connected: bool = False) -> dict[str, str]:
    """A maximum common subgraph by a largest clique, as names 'f' -> 's' of vertex ids. A connected one takes one search, in
    which pairs touch if an arc of the first graph joins theirs."""
    a = association(f, s)
    if connected:
        rows = a.vertices.select("id", F.split("name", ":")[0].cast("long").alias("f")).orderBy("id").collect()
        arcs = {(r["src"], r["dst"]) for r in f.edges.where("src <> dst").collect()}
        near = [0] * len(rows)
        for r in a.edges.select("src", "dst").toLocalIterator():
            near[r["src"]] |= 1 << r["dst"]
        touching = [sum(1 << y["id"] for y in rows if (x["f"], y["f"]) in arcs or (y["f"], x["f"]) in arcs) for x in rows]
        chosen = search_clique(near, touching=touching).members
    else:
        chosen = max_clique(a)
    names = {r["id"]: r["name"] for r in a.vertices.where(F.col("id").isin(chosen)).collect()} if chosen else {}
    return dict(n.split(":") for n in names.values())


@dataclass
class CommonSubgraph:
    mapping: dict[int, int]
    size: int
    count: int | None = None
    complete: bool = True
    nodes: int = 0


class _Search:
    def __init__(self, f: LocalGraph, s: LocalGraph, connected: bool, decide: int | None, count: bool, timeout: float | None = None) -> None:
        self.f, self.s, self.connected, self.decide, self.counting = f, s, connected, decide, count
        self.deadline = None if timeout is None else time.monotonic() + timeout
        self.complete, self.nodes = True, 0
        self.best: list[tuple[int, int]] = []
        self.count = 0
        self.done = False

    def classes(self) -> list[tuple[list[int], list[int], bool]]:
        groups: dict[tuple, tuple[list[int], list[int]]] = {}
        for side, g in enumerate((self.f, self.s)):
            for v in range(g.size):
                groups.setdefault((g.labels[v], g.arcs.get((v, v))), ([], []))[side].append(v)
        return [(a, b, False) for a, b in groups.values() if a and b]

    def split(self, parts: list, v: int, w: int) -> list:
        out = []
        for left, right, near in parts:
            groups: dict[tuple, tuple[list[int], list[int]]] = {}
            for side, g, x, members in ((0, self.f, v, left), (1, self.s, w, right)):
                for u in members:
                    if u != x:
                        groups.setdefault((g.arcs.get((x, u)), g.arcs.get((u, x))), ([], []))[side].append(u)
            out += [(a, b, near or key != (None, None)) for key, (a, b) in groups.items() if a and b]
        return out

    def found(self, mapping: list[tuple[int, int]]) -> None:
        if len(mapping) > len(self.best):
            self.best = mapping.copy()
        if self.decide is not None and len(mapping) >= self.decide:
            if self.counting:
                self.count += 1
            else:
                self.done = True

    def expand(self, mapping: list[tuple[int, int]], parts: list) -> None:
        self.nodes += 1
        if self.deadline is not None and time.monotonic() > self.deadline:
            self.complete, self.done = False, True
        if self.done:
            return
        room = len(mapping) + sum(min(len(a), len(b)) for a, b, _ in parts)
        if room < self.decide if self.decide is not None else room <= len(self.best):
            return
        open_parts = [p for p in parts if p[2] or not self.connected or not mapping]
        if not open_parts:
            return
        part = min(open_parts, key=lambda p: (len(p[0]), p[0][0]))
        left, right, near = part
        v, rest = left[0], left[1:]
        for w in right:
            mapping.append((v, w))
            self.found(mapping)
            self.expand(mapping, self.split(parts, v, w))
            mapping.pop()
        without = [p for p in parts if p is not part] + ([(rest, right, near)] if rest else [])
        self.expand(mapping, without)


def search(f: LocalGraph, s: LocalGraph, connected: bool = False, decide: int | None = None, count: bool = False, timeout: float | None = None) -> CommonSubgraph:
    """The search on the driver. ``decide`` stops at the first mapping of that many vertices; ``count`` counts all of at least as
    many; ``timeout``, in seconds, gives the best so far, not complete."""
    if count and decide is None:
        raise UnsupportedConfiguration("common subgraphs are only counted from a size on")
    run = _Search(f, s, connected, decide, count, timeout)
    if decide is not None and decide <= 0:
        run.found([])
    if not run.done:
        run.expand([], run.classes())
    best = run.best if decide is None or len(run.best) >= decide else []
    return CommonSubgraph(dict(sorted(best)), len(best), run.count if count else None, run.complete, run.nodes)


def max_common_subgraph(spark: SparkSession, f: LocalGraph, s: LocalGraph, connected: bool = False, decide: int | None = None, count: bool = False, timeout: float | None = None) -> DataFrame:
    """(size, mapping, count, complete): the search, a task for each image of the first branching vertex and for leaving it out, so that no mapping is met twice.

    ``mapping`` is JSON of first to second graph's vertices; ``count`` is null unless counting; ``timeout`` is that of
    each task.
    """
    if count and decide is None:
        raise UnsupportedConfiguration("common subgraphs are only counted from a size on")
    ship(spark)
    start = _Search(f, s, connected, decide, count)
    parts = start.classes()
    if not parts or (decide is not None and decide <= 0):
        r = search(f, s, connected, decide, count)
        return spark.createDataFrame([(r.size, json.dumps(r.mapping), r.count, r.complete)], "size int, mapping string, count long, complete boolean")
    first = min(parts, key=lambda p: (len(p[0]), p[0][0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in batch.column(0).to_pylist():
                one = _Search(f, s, connected, decide, count, timeout)
                if w < 0:
                    rest = first[0][1:]
                    one.expand([], [p for p in parts if p != first] + ([(rest, first[1], False)] if rest else []))
                else:
                    mapping = [(first[0][0], w)]
                    one.found(mapping)
                    one.expand(mapping, one.split(parts, first[0][0], w))
                best = one.best if decide is None or len(one.best) >= decide else []
                yield pa.RecordBatch.from_arrays([pa.array([len(best)], pa.int32()), pa.array([json.dumps(dict(sorted(best)))]), pa.array([one.count if count else None], pa.int64()), pa.array([one.complete])], names=["size", "mapping", "count", "complete"])

    roots = spark.createDataFrame([(w,) for w in (-1, *first[1])], "w long").repartition(len(first[1]) + 1)
    found = roots.mapInArrow(run, "size int, mapping string, count long, complete boolean")
    return found.agg(F.max("size").alias("size"), F.max_by("mapping", F.struct("size", "mapping")).alias("mapping"), F.sum("count").alias("count"), F.bool_and("complete").alias("complete"))
