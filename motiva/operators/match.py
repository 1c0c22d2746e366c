"""Pattern matching: a pattern is compiled to joins of the target's edges, one column for each pattern vertex.

A mapping of pattern vertices to target vertices is a solution if
  - arcs map to arcs, with equal labels if the pattern has edge labels, and loops to loops;
  - labels are equal, if the pattern has vertex labels;
  - injective: images differ; locally_injective: images of the vertices one vertex has arcs to differ; noninjective: any;
  - induced: pairs without an arc, and vertices without a loop, map to such.
An undirected pattern edge needs both arcs.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph, UnsupportedConfiguration
from ..plans.order import INJECTIVITY, check_less, common_in_neighbour, is_clique, join_order, subgraph


@dataclass
class Options:
    injectivity: str = "injective"
    induced: bool = False
    #: Pairs (a, b) of pattern vertices: the image of a has the smaller id.
    less: list[tuple[int, int]] = field(default_factory=list)
    #: Pairs (a, b) of target vertices: where b is used, a is used by an earlier pattern vertex.
    occurs_less: list[tuple[int, int]] = field(default_factory=list)
    #: Candidates of pattern vertices, (id) by pattern vertex, as operators.filters makes them: solutions stay the same.
    candidates: dict[int, DataFrame] = field(default_factory=dict)
    #: Filters of operators.filters.candidates to apply before any join.
    filters: tuple[str, ...] = ()

    def check(self, p: LocalGraph) -> None:
        if self.injectivity not in INJECTIVITY:
            raise UnsupportedConfiguration(f"injectivity is one of {', '.join(INJECTIVITY)}")
        check_less(p, self.less)


def column(v: int) -> str:
    return f"p{v}"


def _domain(p: LocalGraph, t: Graph, o: Options, v: int) -> DataFrame | None:
    """(id) of the target vertices that v may map to by itself, or None for any."""
    out = None
    if p.has_vertex_labels:
        out = t.vertices.where(F.col("label") == p.labels[v]).select("id")
    if (v, v) in p.arcs:
        loops = t.loops() if not p.has_edge_labels else t.loops().where(F.col("label") == p.arcs[v, v])
        loops = loops.select(F.col("src").alias("id"))
        out = loops if out is None else out.join(loops, "id", "left_semi")
    elif o.induced:
        loops = t.loops().select(F.col("src").alias("id"))
        out = (t.vertices.select("id") if out is None else out).join(loops, "id", "left_anti")
    if v in o.candidates:
        out = o.candidates[v] if out is None else out.join(o.candidates[v], "id", "left_semi")
    return out


def _arcs(p: LocalGraph, t: Graph, a: int, b: int) -> DataFrame:
    """Target arcs for the pattern arc a -> b, as columns of a and b."""
    e = t.edges.where(F.col("label") == p.arcs[a, b]) if p.has_edge_labels else t.edges
    return e.select(F.col("src").alias(column(a)), F.col("dst").alias(column(b)))


def _one_way(p: LocalGraph, t: Graph) -> bool:
    """Whether an arc of the target comes with its opposite, so that checking one is enough."""
    return not t.directed and not p.has_edge_labels


def _plain(p: LocalGraph, t: Graph, o: Options) -> bool:
    """Whether only the edges of the pattern, without loops, say what is a solution."""
    return not (p.directed or p.has_vertex_labels or p.has_edge_labels or p.loopy or t.directed or o.less or o.occurs_less or o.candidates)


def match(p: LocalGraph, t: Graph, options: Options | None = None, **kw) -> DataFrame:
    """All solutions: a row each, with a column of target ids for each pattern vertex, named after it."""
    o = options or Options(**kw)
    o.check(p)
    if o.filters and p.size:
        from .filters import candidates

        own = candidates(p, t, use=o.filters, injectivity=o.injectivity, induced=o.induced)
        o = replace(o, filters=(), candidates={v: df if v not in o.candidates else df.join(o.candidates[v], "id", "left_semi") for v, df in own.items()})
    if 3 <= p.size <= 5 and is_clique(p) and _plain(p, t, o) and o.injectivity == "injective" and not o.induced:
        # A clique in all its orders: what lies around a vertex is sent to one task, not each path through it.
        from .clique import cliques

        orders = F.array(*(F.struct(*(F.col(f"c{i + 1}").alias(column(v)) for v, i in enumerate(order))) for order in permutations(range(p.size))))
        return cliques(t, p.size).select(F.explode(orders).alias("m")).select(*(F.col(f"m.{column(v)}").alias(p.names[v]) for v in range(p.size)))
    distinct = {(a, b) for a in range(p.size) for b in range(a + 1, p.size)} if o.injectivity == "injective" else common_in_neighbour(p) if o.injectivity == "locally_injective" else set()
    df, placed = None, []
    for v in join_order(p):
        own = column(v)
        domain = _domain(p, t, o, v)
        ends = []
        for x in placed:
            both = [arc for arc in ((x, v), (v, x)) if arc in p.arcs]
            ends += both[:1] if _one_way(p, t) else both
        if df is None:
            df = (domain if domain is not None else t.vertices.select("id")).select(F.col("id").alias(own))
        elif not ends:
            df = df.crossJoin((domain if domain is not None else t.vertices.select("id")).select(F.col("id").alias(own)))
        else:
            for k, (a, b) in enumerate(ends):
                arcs = _arcs(p, t, a, b)
                if k:
                    df = df.join(arcs, [column(a), column(b)], "left_semi")
                    continue
                if domain is not None:
                    arcs = arcs.join(domain.select(F.col("id").alias(own)), own, "left_semi")
                df = df.join(arcs, column(b if a == v else a))
        conditions = [F.col(column(x)) != F.col(own) for x in placed if (min(x, v), max(x, v)) in distinct]
        conditions += [F.col(column(a)) < F.col(column(b)) for a, b in o.less if (a == v and b in placed) or (b == v and a in placed)]
        for c in conditions:
            df = df.where(c)
        if o.induced:
            for x in placed:
                pairs = [(a, b) for a, b in ((x, v), (v, x)) if (a, b) not in p.arcs]
                for a, b in pairs[:1] if not t.directed else pairs:
                    df = df.join(t.edges.select(F.col("src").alias(column(a)), F.col("dst").alias(column(b))), [column(a), column(b)], "left_anti")
        placed.append(v)
    if df is None:
        return t.edges.sparkSession.range(1).select()
    used = F.array(*(column(v) for v in range(p.size)))
    for a, b in o.occurs_less:
        at_b, at_a = F.array_position(used, F.lit(b).cast("long")), F.array_position(used, F.lit(a).cast("long"))
        df = df.where((at_b == 0) | ((at_a >= 1) & (at_a < at_b)))
    return df.select(*(F.col(column(v)).alias(p.names[v]) for v in range(p.size)))


@dataclass
class Result:
    """``complete`` is False only where a limit stopped the search. ``mapping``: a solution by pattern vertex, {} of an empty pattern."""

    status: str
    mapping: dict[int, int] | None = None
    count: int | None = None
    complete: bool = True


def find(p: LocalGraph, t: Graph, **kw) -> Result:
    """One solution, or none: trivial cases are answered before any join."""
    o = Options(**kw)
    o.check(p)
    if p.size == 0:
        return Result("true", {})
    if o.injectivity == "injective" and t.vertices.limit(p.size).count() < p.size:
        return Result("false")
    if o.injectivity == "noninjective" and not (o.induced or p.has_vertex_labels or p.has_edge_labels or o.less or o.occurs_less or o.candidates):
        loop = t.loops().first()
        if loop is not None:
            return Result("true", dict.fromkeys(range(p.size), loop["src"]))
    touched = sorted({v for arc in p.arcs for v in arc})
    if len(touched) < p.size and not (o.induced or p.has_vertex_labels or o.less or o.occurs_less or o.candidates):
        # Vertices without arcs take whatever is left; there is enough, or any will do.
        r = find(subgraph(p, touched), t, injectivity=o.injectivity)
        if r.mapping is None:
            return r
        used = {touched[v]: w for v, w in r.mapping.items()}
        some = [row["id"] for row in t.vertices.select("id").limit(p.size).collect()]
        if not some:
            return Result("false")
        free = iter([w for w in some if w not in used.values()])
        return Result("true", {v: used[v] if v in used else next(free) if o.injectivity == "injective" else some[0] for v in range(p.size)})
    if _plain(p, t, o) and p.size > 1 and o.injectivity == "injective" and is_clique(p) and (not o.induced or t.loops().isEmpty()):
        from .clique import cliques

        row = cliques(t, p.size).first()
        return Result("true", dict(enumerate(row))) if row is not None else Result("false")
    row = match(p, t, o).first()
    return Result("true", dict(enumerate(row))) if row is not None else Result("false")


def search(p: LocalGraph, t: Graph, **kw) -> Result:
    """By the kernel of ``operators.search`` in tasks over the images of one pattern vertex, for hard patterns in targets that fit
    a machine: one solution, or with ``count`` their number; ``timeout`` gives what was found until then, not complete."""
    from .search import solve_in_tasks, solved

    rows = [r["id"] for r in t.vertices.select("id").orderBy("id").collect()]
    r = solved(solve_in_tasks(t.edges.sparkSession, p, t.to_local(), **kw))
    return Result(r.status, None if r.mapping is None else {v: rows[w] for v, w in r.mapping.items()}, r.count, r.complete)


def solutions(p: LocalGraph, t: Graph, limit: int, **kw) -> Result:
    """At most ``limit`` solutions counted; aborted if there are more."""
    n = match(p, t, **kw).limit(limit + 1).count()
    return Result("aborted" if n > limit else "true" if n else "false", count=min(n, limit), complete=n <= limit)
