"""Steps of the graph queries whose memory or disk must not grow with the whole input."""

import random
from collections import Counter
from itertools import combinations, permutations

from pyspark.sql import functions as F

from motiva import queries
from motiva.graph import Graph, LocalGraph
from motiva.operators import blocks, clique, filters
from motiva.operators.match import match

SF = "/root/testdata/sf0.001"


def _weights(spark) -> dict[tuple[int, int], int]:
    orders: dict[int, set[int]] = {}
    for o, p in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(o, set()).add(p)
    return Counter(pair for parts in orders.values() for pair in combinations(sorted(parts), 2))


def test_pairs_are_counted_by_as_many_tasks_as_items_need(spark, monkeypatch):
    monkeypatch.setattr(queries, "ITEMS", 1000)
    have = queries.co_order_weights(spark, SF, 1)
    assert have.rdd.getNumPartitions() == 6
    want = _weights(spark)
    assert {(r["src"], r["dst"]): r["w"] for r in have.collect()} == want
    assert max(r["n"] for r in have.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < len(want) / 3


def test_items_without_an_order_or_a_part_make_no_pairs(spark, tmp_path):
    rows = [(1, 1), (1, 2), (1, 2), (1, None), (None, 1), (None, 2), (2, 2), (2, 1), (3, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in queries.co_order_weights(spark, str(tmp_path), 1).collect()] == [(1, 2, 2)]
    assert sorted(tuple(r) for r in queries.co_order(spark, str(tmp_path), 1).edges.collect()) == [(1, 2, ""), (2, 1, "")]


def _random(spark, n: int, p: float, seed: int) -> tuple[Graph, dict[int, set[int]]]:
    """A graph on ids far apart and of both signs, with a vertex that has an edge to each other and a loop; and its neighbours by id."""
    rng = random.Random(seed)
    ids = [(i - n // 2) * (1 + i * 10**11) for i in range(n)]
    edges = {(a, b) for a, b in combinations(ids, 2) if rng.random() < p or a == ids[0]}
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in ids}
    return Graph.from_edges(spark.createDataFrame([*edges, (ids[0], ids[0])], "src long, dst long")), near


def _small_blocks(monkeypatch) -> None:
    for name, size in (("ARCS", 40), ("CHUNK", 70)):
        monkeypatch.setattr(blocks, name, size)
    monkeypatch.setattr(clique, "HUB", 12)
    monkeypatch.setattr(clique, "LEVEL", 30)
    monkeypatch.setattr(filters, "PATHS", 25)


def test_cliques_in_blocks(spark, monkeypatch):
    _small_blocks(monkeypatch)
    g, near = _random(spark, 30, 0.35, 1)
    whole = {k: {frozenset(c) for c in combinations(near, k) if all(b in near[a] for a, b in combinations(c, 2))} for k in (1, 2, 3, 4, 5)}
    for k, want in whole.items():
        have = [frozenset(r) for r in clique.cliques(g, k).collect()]
        assert len(have) == len(want) and set(have) == want, k
    assert {r["size"]: r["cliques"] for r in clique.clique_counts(g, 5).collect()} == {k: len(c) for k, c in whole.items()}
    triangle = LocalGraph.of([("a", "b"), ("b", "c"), ("a", "c")])
    assert sorted(tuple(r) for r in match(triangle, g).collect()) == sorted(o for c in whole[3] for o in permutations(c))
    assert max(near[a].__len__() for a in near) == 29 and max(r["n"] for r in clique.oriented(g).groupBy("src").agg(F.count("*").alias("n")).collect()) < 20


def test_common_neighbours_in_blocks(spark, monkeypatch):
    _small_blocks(monkeypatch)
    g, near = _random(spark, 30, 0.2, 2)
    want = {(a, b): n for a in near for b in near if (n := len(near[a] & near[b]))}
    assert {(r["src"], r["dst"]): r["n"] for r in filters.common_neighbours(g).collect()} == want
    assert {(r["src"], r["dst"]) for r in filters.exact_path_graph(g, 3).collect()} == {pair for pair, n in want.items() if n >= 3}
    assert {r["n"]: r["pairs"] for r in filters.common_neighbour_counts(g).collect()} == Counter(want.values())


def test_no_path_of_two_edges_is_shuffled(spark):
    """A star has edges in number, and paths of two edges in their square."""
    g = Graph.from_edges(spark.range(1, 3001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")))
    assert clique.cliques(g, 3).count() == 0 and [tuple(r) for r in clique.clique_counts(g, 3).collect()] == [(1, 3001), (2, 3000), (3, 0)]
    for df in (clique.cliques(g, 4), match(LocalGraph.of([("a", "b"), ("b", "c"), ("a", "c")]), g), filters.common_neighbour_counts(g)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and plan.count("Join Inner") == 1
    assert {r["n"]: r["pairs"] for r in filters.common_neighbour_counts(g).collect()} == {1: 3000 * 3000, 3000: 1}
