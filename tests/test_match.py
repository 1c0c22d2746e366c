import random

import pytest

from motiva.functions.combinatorics import choose, factorial
from motiva.functions.generate import random_graph
from motiva.graph import Graph, LocalGraph, UnsupportedConfiguration
from motiva.operators.count import count_solutions
from motiva.operators.filters import candidates
from motiva.operators.match import find, match, solutions
from motiva.operators.verify import violations
from motiva.streaming.enumerate import for_each

from . import brute

MODES = [(i, d) for i in ("injective", "locally_injective", "noninjective") for d in (False, True)]


def instance(rng, n, directed=False, labels=False, edge_labels=False):
    g = LocalGraph(n, directed, labels, edge_labels, labels=[rng.choice("ab") if labels else "" for _ in range(n)])
    for a in range(n):
        for b in range(n) if directed else range(a, n):
            if rng.random() < (0.15 if a == b else 0.5):
                g.add(a, b, rng.choice("xy") if edge_labels else "")
    return g


def got(p, t, **kw):
    return sorted(tuple(r) for r in match(p, t, **kw).collect())


@pytest.mark.parametrize("seed", range(8))
def test_random_instances(spark, seed):
    rng = random.Random(seed)
    directed, labels, edge_labels = seed % 2 == 1, seed % 4 >= 2, seed >= 5
    p, t = instance(rng, rng.randint(2, 3), directed, labels, edge_labels), instance(rng, rng.randint(3, 5), directed, labels, edge_labels)
    g = Graph.from_local(spark, t)
    injectivity, induced = MODES[seed % 6]
    want = sorted(brute.solutions(p, t, injectivity, induced))
    assert got(p, g, injectivity=injectivity, induced=induced) == want
    assert count_solutions(p, g, injectivity=injectivity, induced=induced) == len(want)
    assert violations(match(p, g, injectivity=injectivity, induced=induced), p, g, injectivity, induced).count() == 0


def test_undirected_pattern_in_a_directed_target_needs_both_arcs(spark):
    t = LocalGraph.of([("a", "b"), ("b", "a"), ("b", "c")], directed=True)
    assert got(LocalGraph.of([("u", "v")]), Graph.from_local(spark, t)) == [(0, 1), (1, 0)]


PATH3, PATH4 = LocalGraph.of([("a", "b"), ("b", "c")]), LocalGraph.of([(1, 2), (2, 3), (3, 4)])
K3 = LocalGraph.of([("x", "y"), ("y", "z"), ("x", "z")])


@pytest.mark.parametrize(
    "p, t, kw, n",
    [
        (LocalGraph(3), LocalGraph(4), {"injectivity": "noninjective"}, 64),
        (LocalGraph(3), LocalGraph(4), {}, 24),
        (PATH3, PATH4, {"injectivity": "noninjective"}, 10),
        (PATH3, PATH4, {}, 4),
        (LocalGraph.of([("a", "a"), ("a", "b")]), LocalGraph.of([(1, 2), (2, 2), (2, 3), (3, 4)]), {"injectivity": "noninjective"}, 3),
        (LocalGraph.of([("a", "a"), ("a", "b")]), LocalGraph.of([(1, 2), (2, 2), (2, 3), (3, 4)]), {}, 2),
        (LocalGraph.of([("a", "a"), ("a", "b"), ("b", "c")]), LocalGraph.of([(1, 1), (1, 2)]), {"injectivity": "noninjective"}, 3),
        (PATH3, K3, {}, 6),
        (PATH3, K3, {"induced": True}, 0),
        (LocalGraph(2), PATH3, {}, 6),
        (LocalGraph(2), PATH3, {"induced": True}, 2),
        (PATH4, K3, {}, 0),
        (PATH4, K3, {"injectivity": "locally_injective"}, 6),
        (PATH4, K3, {"injectivity": "noninjective"}, 24),
        (LocalGraph.of([("a", "b")], directed=True), LocalGraph.of([("a", "b"), ("b", "c")], directed=True), {}, 2),
        (LocalGraph.of([], labels={"a": "red"}), LocalGraph.of([], labels={"a": "red", "b": "blue"}), {}, 1),
        (LocalGraph.of([("a", "b", "x")]), LocalGraph.of([("a", "b", "x"), ("c", "d", "y")]), {}, 2),
        (LocalGraph(2), LocalGraph(2), {"injectivity": "locally_injective", "induced": True}, 4),
        (LocalGraph(0), PATH3, {}, 1),
    ],
)
def test_known_counts(spark, p, t, kw, n):
    g = Graph.from_local(spark, t)
    assert count_solutions(p, g, **kw) == n == len(brute.solutions(p, t, **kw))
    assert match(p, g, **kw).count() == n
    r = find(p, g, **kw)
    assert (r.status == "true") == (n > 0) and r.complete


def test_vertices_without_arcs_take_what_is_left(spark):
    t = LocalGraph.of([(0, 1), (2, 3)], vertices=map(str, range(40)))
    p = LocalGraph.of([("a", "b")], vertices=["x", "a", "b", *(f"y{i}" for i in range(30))])
    r = find(p, Graph.from_local(spark, t))
    assert r.status == "true" and len(set(r.mapping.values())) == p.size and all((r.mapping[a], r.mapping[b]) in t.arcs for a, b in p.arcs)
    assert find(LocalGraph(41), Graph.from_local(spark, t)).status == "false"


def test_matching_with_filters_of_its_own(spark):
    rng = random.Random(15)
    for mode in MODES[:4]:
        p, t = instance(rng, 3), instance(rng, 6)
        own = got(p, Graph.from_local(spark, t), injectivity=mode[0], induced=mode[1], filters=("degree", "neighbours", "paths", "clique"))
        assert own == sorted(brute.solutions(p, t, *mode))


def test_constraints(spark):
    t = LocalGraph.of([(a, b) for a in range(4) for b in range(a)])
    g = Graph.from_local(spark, t)
    assert got(K3, g, less=[(0, 1), (1, 2)]) == sorted(brute.solutions(K3, t, less=[(0, 1), (1, 2)]))
    assert got(K3, g, occurs_less=[(0, 1), (1, 2)]) == sorted(brute.solutions(K3, t, occurs_less=[(0, 1), (1, 2)]))
    with pytest.raises(UnsupportedConfiguration):
        match(K3, g, less=[(0, 1), (1, 0)])
    with pytest.raises(UnsupportedConfiguration):
        match(K3, g, injectivity="sometimes")


def test_limits_and_callbacks(spark):
    g = Graph.from_local(spark, K3)
    r = solutions(PATH3, g, 4)
    assert (r.status, r.count, r.complete) == ("aborted", 4, False)
    assert solutions(PATH3, g, 6).complete
    seen = []
    assert not for_each(match(PATH3, g), lambda s: seen.append(s) or len(seen) < 2)
    assert len(seen) == 2 and set(seen[0]) == {"a", "b", "c"}


@pytest.mark.parametrize("mode", MODES[:4])
def test_filters_leave_solutions_as_they_are(spark, mode):
    rng = random.Random(5)
    p, t = instance(rng, 3), instance(rng, 6)
    g = Graph.from_local(spark, t)
    kw = {"injectivity": mode[0], "induced": mode[1]}
    use = candidates(p, g, use=("degree", "neighbours", "clique"), **kw)
    assert got(p, g, candidates=use, **kw) == sorted(brute.solutions(p, t, *mode))


def test_violations_are_found(spark):
    g = Graph.from_local(spark, PATH4)
    rows = spark.createDataFrame([(0, 1, 2), (0, 1, 0), (0, 2, 1), (0, 1, 9)], "a long, b long, c long")
    bad = {(r[0], r[1], r[2]): r[3] for r in violations(rows, PATH3, g).collect()}
    assert set(bad) == {(0, 1, 0), (0, 2, 1), (0, 1, 9)} and bad[0, 1, 0] == "injectivity"


def test_trees_are_counted_without_listing(spark):
    star = LocalGraph.of([("c", i) for i in range(12)])
    hub = LocalGraph.of([("h", i) for i in range(50)])
    assert count_solutions(star, Graph.from_local(spark, hub), injectivity="noninjective") == 50**12 + 50


def test_generator_and_numbers(spark):
    g = random_graph(spark, 40, 0.3, seed=3, loops=0.5)
    n, loops = g.edges.where("src < dst").count(), g.loops().count()
    assert 170 < n < 300 and 8 < loops < 32 and g.edges.where("src > dst").count() == n
    assert choose(5, 2) == 10 and choose(2, 5) == 0 and factorial(25) == 15511210043330985984000000
