"""An independent check of solutions: rows that break a rule, with the rule's name. One pass over the solutions, with a left join for each arc that is looked up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph
from ..plans.order import common_in_neighbour


def violations(result: DataFrame, p: LocalGraph, t: Graph, injectivity: str = "injective", induced: bool = False) -> DataFrame:
    """The rows of ``result``, as match returns them, that are no solution, each with a column ``rule``."""
    df = result.toDF(*(f"p{v}" for v in range(p.size)))
    rules: list[Column] = []

    def broken(when: Column, rule: str) -> None:
        rules.append(F.when(when, F.lit(rule)))

    for v in range(p.size):
        own = t.vertices.where(F.col("label") == p.labels[v]) if p.has_vertex_labels else t.vertices
        df = df.join(own.select(F.col("id").alias(f"p{v}"), F.lit(True).alias(f"__v{v}")), f"p{v}", "left")
        broken(F.col(f"__v{v}").isNull(), "vertex")
    pairs = {(a, b) for a in range(p.size) for b in range(a + 1, p.size)} if injectivity == "injective" else common_in_neighbour(p) if injectivity == "locally_injective" else set()
    if pairs:
        broken(reduce(lambda x, y: x | y, [F.col(f"p{a}") == F.col(f"p{b}") for a, b in sorted(pairs)]), "injectivity")
    for a in range(p.size):
        for b in range(p.size):
            there, flag = (a, b) in p.arcs, f"__e{a}_{b}"
            if there or induced:
                arcs = t.edges.where(F.col("label") == p.arcs[a, b]) if there and p.has_edge_labels else t.edges
                on = (F.col(f"p{a}") == F.col("__a")) & (F.col(f"p{b}") == F.col("__b"))
                df = df.join(arcs.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.lit(True).alias(flag)), on, "left").drop("__a", "__b")
                broken(F.col(flag).isNull() if there else F.col(flag).isNotNull(), "edge" if there else "induced")
    names = [f"p{v}" for v in range(p.size)]
    rule = F.explode(F.array_distinct(F.array_compact(F.array(*rules)))) if rules else F.explode(F.array().cast("array<string>"))
    return df.select(*names, rule.alias("rule")).distinct().toDF(*p.names, "rule")
