"""Filters of candidates and graphs derived from a target: each a DataFrame of its own, none changes solutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph
from .blocks import Lists, local, runs, two_steps
from .match import Options, _domain, match


def _plain(t: Graph) -> DataFrame:
    return t.edges.where("src <> dst").select("src", "dst")


def applicable(p: LocalGraph, t: Graph, o: Options) -> bool:
    """Whether degrees may filter: not without injectivity, and with local injectivity only where there is no loop."""
    return o.injectivity == "injective" or (o.injectivity == "locally_injective" and not p.loopy and t.loops().isEmpty())


def sound_filters(p: LocalGraph, t: Graph, o: Options) -> dict[str, bool]:
    """Which filters leave all solutions in.

    degree: what a vertex has arcs to maps to as many others. neighbours, sequence, shapes, clique: images differ
    throughout, too. paths: degrees hold, of graphs of common neighbours as well. equal: degrees are equal, as a mapping onto
    all of the target keeps arcs and their absence.
    """
    injective, degrees = o.injectivity == "injective", applicable(p, t, o)
    plain = not (p.directed or t.directed)
    return {
        "degree": degrees,
        "neighbours": injective,
        "sequence": injective,
        "paths": injective and plain,
        "distance2": plain,
        "distance3": injective and plain,
        "k4": injective and plain,
        "shapes": injective,
        "clique": injective and plain,
        "equal": injective and o.induced and plain and not p.has_edge_labels and t.vertices.count() == p.size,
    }


def simple_degrees(t: Graph) -> DataFrame:
    """(id, degree): arcs out, loops left out."""
    return t.vertices.select("id").join(_plain(t).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))


def neighbourhood_degrees(t: Graph) -> DataFrame:
    """(id, degrees): degrees of the neighbours, largest first; vertices without any are left out."""
    d = simple_degrees(t).select(F.col("id").alias("dst"), "degree")
    return _plain(t).join(d, "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("degree"), asc=False).alias("degrees"))


def dominated(pattern: list[int], target: Column) -> Column:
    """Whether the sorted ``target`` has at least as many entries, none smaller than its counterpart."""
    want = F.array(*(F.lit(x).cast("long") for x in pattern))
    return (F.size(target) >= len(pattern)) & F.forall(F.zip_with(want, F.slice(target, 1, len(pattern)), lambda x, y: y >= x), lambda x: x)


#: Ends of paths that a kernel holds at once, of paths from one vertex.
PATHS = 4_000_000


def _ends(own: Lists, there: Lists) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each vertex of a block: it, the vertices at the ends of its paths of two arcs, and how many lead to each."""
    mid, lengths, values = there
    ids, to = np.unique(values, return_inverse=True)
    to = to.astype(np.int32)
    start = np.cumsum(lengths) - lengths
    near_all, inside = local(mid, own[2])
    ends = np.cumsum(own[1])
    for a, i, j in zip(own[0].tolist(), (ends - own[1]).tolist(), ends.tolist()):
        near = near_all[i:j][inside[i:j]]
        count = lengths[near]
        reach = np.cumsum(count)
        if not len(reach):
            continue
        cuts = np.searchsorted(reach, np.arange(0, reach[-1] + PATHS, PATHS))
        total = None
        for x, y in zip(cuts[:-1], np.append(cuts[1:-1], len(near))):
            last = to[runs(start[near[x:y]], count[x:y])]
            if len(cuts) == 2 and 20 * len(last) < len(ids):
                at, n = np.unique(last, return_counts=True)
                yield a, ids[at], n
                break
            n = np.bincount(last, minlength=len(ids))
            total = n if total is None else total + n
        else:
            at = np.flatnonzero(total)
            yield a, ids[at], total[at]


def _pairs_of(least: int):
    def kernel(own: Lists, there: Lists) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            src, dst, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(n)], names=["src", "dst", "n"])

        for a, ends, n in _ends(own, there):
            enough = n >= least
            held.append((np.full(enough.sum(), a), ends[enough], n[enough].astype(np.int64)))
            size += len(held[-1][0])
            if size >= 100_000:
                yield out()
                size = 0
        if held:
            yield out()

    return kernel


def _histogram(own: Lists, there: Lists) -> Iterator[pa.RecordBatch]:
    pairs = np.zeros(1, np.int64)
    for _, _, n in _ends(own, there):
        more = np.bincount(n)
        pairs, more = (pairs, more) if len(pairs) >= len(more) else (more, pairs)
        pairs[: len(more)] += more
    n = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(pairs[n])], names=["n", "pairs"])


def _two_arcs(t: Graph, kernel, schema: str) -> DataFrame:
    e = _plain(t)
    return two_steps(e.select(F.col("dst").alias("a"), F.col("src").alias("m")), e, kernel, schema)


def common_neighbours(t: Graph, least: int = 1) -> DataFrame:
    """(src, dst, n): vertices with n >= ``least`` common neighbours, of which there is one at least; with itself, a vertex has its degree."""
    return _two_arcs(t, _pairs_of(least), "src long, dst long, n long")


def common_neighbour_counts(t: Graph) -> DataFrame:
    """(n, pairs): how many pairs of ``common_neighbours`` have n of them. No pair leaves the task that counts it."""
    return _two_arcs(t, _histogram, "n long, pairs long").groupBy("n").agg(F.sum("pairs").alias("pairs"))


def exact_path_graph(t: Graph, k: int) -> DataFrame:
    """(src, dst): at least k common neighbours; a vertex with itself if its degree is that."""
    return common_neighbours(t, k).select("src", "dst")


def distance2_graph(t: Graph) -> DataFrame:
    """(src, dst): within two steps, none included."""
    e = _plain(t)
    two = e.select(F.col("src"), F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    return e.union(two).union(t.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()


def distance3_graph(t: Graph) -> DataFrame:
    """(src, dst): different vertices within three steps."""
    e = _plain(t)
    two = distance2_graph(t)
    three = two.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    return e.union(three).where("src <> dst").distinct()


def k4_graph(t: Graph) -> DataFrame:
    """(src, dst): edges with two adjacent common neighbours."""
    from .clique import cliques

    c = ["c1", "c2", "c3", "c4"]
    four = cliques(t, 4)
    pairs = F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a in c for b in c if a != b))
    return four.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


def shape_graph(t: Graph, shape: LocalGraph, start: int, end: int, least: int = 1) -> DataFrame:
    """(src, dst): pairs to which at least ``least`` injective mappings of a shape take its vertices ``start`` and ``end``."""
    a, b = shape.names[start], shape.names[end]
    return match(shape, t).groupBy(F.col(f"`{a}`").alias("src"), F.col(f"`{b}`").alias("dst")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("src", "dst")


def degree_sequence_fits(p: LocalGraph, t: Graph) -> bool:
    """Whether the target's largest degrees dominate the pattern's: else it has no injective solution."""
    want = sorted((len(p.neighbours(v) - {v}) for v in range(p.size)), reverse=True)
    have = [r[0] for r in simple_degrees(t).orderBy(F.desc("degree")).limit(p.size).select("degree").collect()]
    return len(have) == len(want) and all(x <= y for x, y in zip(want, have))


def _pattern_paths(p: LocalGraph, k: int) -> list[int]:
    """How many other vertices each has k or more common neighbours with."""
    near = [p.neighbours(v) - {v} for v in range(p.size)]
    return [sum(w != v and len(near[v] & near[w]) >= k for w in range(p.size)) for v in range(p.size)]


def candidates(p: LocalGraph, t: Graph, use: tuple[str, ...] = ("degree", "neighbours"), paths: int = 4, shapes: list[tuple[LocalGraph, int, int, int]] = (), **kw) -> dict[int, DataFrame]:
    """For each pattern vertex, (id) of the target vertices left to it by labels, loops, degrees ('degree'), neighbours' degrees
    ('neighbours'), degrees in the graphs of 1..``paths`` common neighbours ('paths') and in those of ``shapes``, as (shape,
    start, end, least) ('shapes'), and largest cliques ('clique'). Where a filter isn't sound it is left out; where degrees
    must be equal, they are compared so."""
    o = Options(**kw)
    out = {}
    degrees, around, sizes = simple_degrees(t), neighbourhood_degrees(t), None
    sound = sound_filters(p, t, o)
    equal = sound["equal"]
    derived: list[tuple[list[int], DataFrame]] = []
    out_degrees = lambda e: e.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    if "paths" in use and sound["paths"]:
        n = common_neighbours(t)
        derived += [(own, out_degrees(n.where(F.col("n") >= k).select("src", "dst"))) for k in range(1, paths + 1) if any(own := _pattern_paths(p, k))]
    if "shapes" in use and sound["shapes"]:
        from .search import Search

        for shape, start, end, least in shapes:
            own = [x.bit_count() - (x >> v & 1) for v, x in enumerate(Search._shape(p, shape, start, end, least))]
            derived.append((own, out_degrees(shape_graph(Graph(t.vertices, t.edges, t.directed), shape, start, end, least))))
    for v in range(p.size):
        domain = _domain(p, t, o, v)
        df = domain if domain is not None else t.vertices.select("id")
        near = p.neighbours(v) - {v}
        if sound["degree"] and near:
            if "degree" in use:
                fits = F.col("degree") == len(near) if equal else F.col("degree") >= len(near)
                df = df.join(degrees.where(fits).select("id"), "id", "left_semi")
            if "neighbours" in use and sound["neighbours"]:
                want = sorted((len(p.neighbours(w) - {w}) for w in near), reverse=True)
                fits = F.col("degrees") == F.array(*(F.lit(x).cast("long") for x in want)) if equal else dominated(want, F.col("degrees"))
                df = df.join(around.where(fits).select("id"), "id", "left_semi")
        for own, have in derived:
            if own[v]:
                df = df.join(have.where(F.col("degree") >= own[v]).select("id"), "id", "left_semi")
        if "clique" in use and sound["clique"]:
            from .clique import clique_sizes, local_clique_size

            sizes = clique_sizes(t) if sizes is None else sizes
            df = df.join(sizes.where(F.col("size") >= local_clique_size(p, v)).select("id"), "id", "left_semi")
        out[v] = df
    return out


def domain_sizes(p: LocalGraph, t: Graph, **kw) -> DataFrame:
    """(pattern_vertex, candidates): how many candidates each pattern vertex has; 0 means there is no solution."""
    spark = t.edges.sparkSession
    every = None
    for v, df in candidates(p, t, **kw).items():
        row = df.agg(F.count("*").alias("candidates")).select(F.lit(p.names[v]).alias("pattern_vertex"), "candidates")
        every = row if every is None else every.union(row)
    return every if every is not None else spark.createDataFrame([], "pattern_vertex string, candidates long")


def domains_suffice(domains: dict[int, DataFrame], injectivity: str = "injective") -> bool:
    """Whether no pattern vertex is without a candidate and, injectively, all of them together have enough: else there is no solution."""
    if not domains:
        return True
    every = None
    for v, df in domains.items():
        row = df.select("id", F.lit(v).alias("v"))
        every = row if every is None else every.unionByName(row)
    ids, vertices = every.agg(F.countDistinct("id"), F.countDistinct("v")).first()
    return vertices == len(domains) and (injectivity != "injective" or ids >= len(domains))
