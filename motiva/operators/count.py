"""Counting solutions without listing them, where the pattern allows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph
from ..plans.order import adjacency, components, is_forest, subgraph
from .match import Options, _arcs, _domain, match

BIG = "decimal(38,0)"


def tree_weights(p: LocalGraph, t: Graph, o: Options | None = None, root: int = 0) -> DataFrame:
    """(id, w): for each image of ``root``, how many noninjective mappings of the tree ``p`` extend it.

    Leaves are eliminated one by one: what hangs below a vertex is a weight of its images, summed over the edge to its
    parent. So a tree of n vertices takes n - 1 joins and group-bys of the size of the target, however many solutions it has.
    """
    o = o or Options(injectivity="noninjective")
    near = adjacency(p)

    def below(v: int, parent: int | None) -> DataFrame:
        domain = _domain(p, t, o, v)
        ids = domain if domain is not None else t.vertices.select("id")
        total = F.lit(1).cast(BIG)
        df = ids
        for k, c in enumerate(sorted(near[v] - {parent})):
            arcs = None
            for a, b in ((v, c), (c, v)):
                if (a, b) in p.arcs:
                    e = _arcs(p, t, a, b).select(F.col(f"p{v}").alias("v"), F.col(f"p{c}").alias("c"))
                    arcs = e if arcs is None else arcs if not t.directed and not p.has_edge_labels else arcs.join(e, ["v", "c"], "left_semi")
            w = arcs.join(below(c, v).select(F.col("id").alias("c"), F.col("w").alias("cw")), "c").groupBy(F.col("v").alias("id")).agg(F.sum("cw").cast(BIG).alias(f"w{k}"))
            df = df.join(w, "id")
            total = (total * F.col(f"w{k}")).cast(BIG)
        return df.select("id", total.alias("w"))

    return below(root, None)


def count_solutions(p: LocalGraph, t: Graph, **kw) -> int:
    """How many solutions there are.

    Pattern vertices without edges are counted by a factor, unless induced or constrained. Without injectivity, what isn't
    connected multiplies, and trees are counted by elimination; a sum beyond 38 digits raises, as Spark's decimals do.
    """
    o = Options(**kw)
    o.check(p)
    if p.size == 0:
        return 1
    free = not (o.induced or o.less or o.occurs_less or o.candidates or p.has_vertex_labels)
    touched = {v for arc in p.arcs for v in arc}
    alone = p.size - len(touched)
    if free and alone:
        n = t.vertices.count()
        core = subgraph(p, sorted(touched))
        rest = count_solutions(core, t, injectivity=o.injectivity)
        room = n - core.size
        return rest * ((math.perm(room, alone) if room >= alone else 0) if o.injectivity == "injective" else n**alone)
    if o.injectivity == "noninjective" and not (o.induced or o.less or o.occurs_less or o.candidates):
        total = 1
        for part in components(p):
            g = subgraph(p, part)
            total *= int(tree_weights(g, t).agg(F.sum("w")).first()[0] or 0) if is_forest(g) else match(g, t, injectivity="noninjective").count()
        return total
    return match(p, t, o).count()
