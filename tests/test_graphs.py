"""Readers, writers, filters, cliques, common subgraphs and the registered queries."""

import random
import struct
from itertools import permutations

import pytest

from motiva.graph import Graph, GraphFileError, LocalGraph, UnsupportedConfiguration
from motiva.operators import clique, filters, mcs
from motiva.operators.opb import opb_constraints, write_opb
from motiva.sources import formats, sinks

from . import brute


def arcs(g: LocalGraph):
    return {(g.names[a], g.names[b], label) for (a, b), label in g.arcs.items()}


def test_csv():
    g = formats.parse_csv("a,b\nb,c\nd,\n")
    assert g.names == ["a", "b", "c", "d"] and not g.directed and len(g.arcs) == 4
    g = formats.parse_csv("a>b\nb,c\n")
    assert g.directed and arcs(g) == {("a", "b", ""), ("b", "c", ""), ("c", "b", "")}
    g = formats.parse_csv("a,b,x\na,,red\na,,blue\n")
    assert g.directed and g.has_edge_labels and g.has_vertex_labels and g.labels == ["red", ""] and len(g.arcs) == 2
    g = formats.parse_csv("a>b,x\na>b,y\n")
    assert arcs(g) == {("a", "b", "y")}
    assert formats.parse_csv("a,a\n").loopy
    assert formats.parse_csv("a,b\n", rename={"a": "x", "b": "y"}).names == ["x", "y"]
    for bad in ("ab\n", "a,b c\n", "a,b\r\n", "a,b\x01\n"):
        with pytest.raises(GraphFileError):
            formats.parse_csv(bad)
    with pytest.raises(GraphFileError):
        formats.parse_csv("a,b\n", rename={"a": "x"})


def test_lad():
    g = formats.parse_lad("3\n1 1\n2 0 2\n1 1\n1=mid\n")
    assert g.names == ["0", "mid", "2"] and len(g.arcs) == 4 and not g.directed
    assert len(formats.parse_lad("2\n1 1\n0\n", kind="directedlad").arcs) == 1
    g = formats.parse_lad("2\n5 1 1 7\n6 0\n", kind="labelledlad")
    assert g.labels == ["5", "6"] and g.arcs == {(0, 1): "7"} and g.directed
    g = formats.parse_lad("2\n5 1 1\n6 1 0\n", kind="vertexlabelledlad")
    assert g.labels == ["5", "6"] and not g.has_edge_labels and len(g.arcs) == 2
    for bad in ("", "x", "2\n1 5\n0", "1\n0\nrest", "2\n1"):
        with pytest.raises(GraphFileError):
            formats.parse_lad(bad)


def test_dimacs():
    g = formats.parse_dimacs("c hello\np edge 3 2\ne 1 2\ne 2 3\n")
    assert g.names == ["1", "2", "3"] and len(g.arcs) == 4
    for bad in ("e 1 2\n", "p edge 2 1\np edge 2 1\n", "p edge 2 1\ne 1 3\n", "p edge 2 1\nx\n", "p edge 2 1\ne 0 1\n"):
        with pytest.raises(GraphFileError):
            formats.parse_dimacs(bad)


def words(*values):
    return struct.pack(f"<{len(values)}H", *values)


def test_vfmcs():
    data = words(2, 0xFFFF, 0, 1, 1, 9, 0)
    assert formats.parse_vfmcs(data).arcs == {(0, 1): "", (1, 0): ""}
    g = formats.parse_vfmcs(data, kind="vfmcsvd")
    assert g.arcs == {(0, 1): "directed"} and g.directed and g.labels == ["0", "0"]
    assert [formats.label_shift(n) for n in (2, 6, 9, 13, 40)] == [16, 16, 16, 15, 13]
    big = formats.parse_vfmcs(words(13, *([0x8000] * 13), *([0] * 13)), kind="vfmcsv")
    assert big.labels == ["1"] * 13
    for bad in (b"", b"\1", words(1), words(1, 0, 1, 5, 0), words(1, 0, 0, 0)):
        with pytest.raises(GraphFileError):
            formats.parse_vfmcs(bad)


def test_detection():
    for lines, kind in [(["c x", "p edge 2 1"], "dimacs"), (["p col 2 1"], "dimacs"), (["0"], "lad"), (["3", "0"], "lad"), (["3", "0 0"], "labelledlad"), (["3", "2 1 2"], "lad"), (["3", "5 1 1 7"], "labelledlad"), (["a,b"], "csv"), (["a>b"], "csv")]:
        assert formats.detect_format(lines) == kind
    for bad in ([], ["c only"], ["c x", "e 1 2"], ["3"], ["3", "1 1"], ["3", "9 9 9"], ["what is this"]):
        if bad == ["3", "1 1"]:
            assert formats.detect_format(bad) == "lad"
            continue
        with pytest.raises(GraphFileError):
            formats.detect_format(bad)


def test_files_local_and_distributed(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a,b\nb>c,x\nd,,red\na>b,y\n")
    (tmp_path / "n.csv").write_text("a,one\nb,two\nc,three\nd,four\n")
    (tmp_path / "g.clq").write_text("c x\np edge 4 3\ne 1 2\ne 2 3\n\ne 1 3\n")
    (tmp_path / "g.lad").write_text("3\n1 1\n2 0 2\n1 1\n")
    for name in ("g.csv", "g.clq", "g.lad"):
        path = str(tmp_path / name)
        kind = "csv" if name == "g.csv" else "auto"
        a, b = formats.load(path, kind), formats.read_graph(spark, path, kind).to_local()
        assert (a.names, a.labels, a.arcs, a.directed, a.has_vertex_labels, a.has_edge_labels) == (b.names, b.labels, b.arcs, b.directed, b.has_vertex_labels, b.has_edge_labels)
    assert formats.load(str(tmp_path / "g.csv"), f"csvname:{tmp_path / 'n.csv'}").names == ["one", "two", "three", "four"]
    named = formats.read_graph(spark, f"file://{tmp_path}/g.csv", f"csvname:file://{tmp_path}/n.csv")
    assert [r["name"] for r in named.vertices.orderBy("id").collect()] == ["one", "two", "three", "four"]
    with pytest.raises(GraphFileError) as e:
        formats.load(str(tmp_path / "missing"))
    assert not e.value.existed
    with pytest.raises(GraphFileError) as e:
        formats.read_graph(spark, str(tmp_path / "missing"), "lad")
    assert not e.value.existed
    with pytest.raises(GraphFileError):
        formats.load(str(tmp_path / "g.lad"), "odd")
    for text, reader in (("ab\n", formats.read_csv), ("a,b c\n", formats.read_csv), ("p edge 2 1\ne 1 9\n", formats.read_dimacs), ("e 1 2\n", formats.read_dimacs)):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(GraphFileError):
            reader(spark, str(tmp_path / "bad"))


def test_lad_output_and_reports(spark, tmp_path):
    g = LocalGraph.of([(0, 1), (1, 2), (3, 3)], vertices=["0", "1", "2", "3", "4"])
    text = sinks.lad_text(g)
    assert formats.parse_lad(text).arcs == g.arcs and text.splitlines()[-1] == "0"
    sinks.write_lad(Graph.from_local(spark, g), str(tmp_path / "lad"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "lad").glob("part-*"))) == text
    with pytest.raises(UnsupportedConfiguration):
        sinks.lad_text(LocalGraph.of([("a", "b", "x")]))
    assert sinks.report({"status": True, "n": 3}) == "status = true\nn = 3\n"
    assert sinks.mapping_text(LocalGraph.of([("a", "b")]), {4: "x", 5: "y"}, {1: 4, 0: 5}) == "(a -> y) (b -> x)"


def some_graph(seed, n=9, p=0.55):
    rng, g = random.Random(seed), LocalGraph(n)
    for a in range(n):
        for b in range(a, n):
            if rng.random() < (0.2 if a == b else p):
                g.add(a, b)
    return g


def test_derived_graphs(spark):
    g = some_graph(1)
    t = Graph.from_local(spark, g)
    near = {v: g.neighbours(v) - {v} for v in range(g.size)}
    pairs = lambda df: {tuple(r) for r in df.select("src", "dst").collect()}
    assert pairs(filters.exact_path_graph(t, 3)) == {(a, b) for a in near for b in near if len(near[a] & near[b]) >= 3}
    two = {(a, b) for a in near for b in near if a == b or b in near[a] or near[a] & near[b]}
    assert pairs(filters.distance2_graph(t)) == two
    assert pairs(filters.distance3_graph(t)) == {(a, b) for a in near for b in near if a != b and ((a, b) in two or any((a, c) in two for c in near[b]))}
    assert pairs(filters.k4_graph(t)) == {(a, b) for a in near for b in near[a] if any(d in near[c] for c in near[a] & near[b] for d in near[a] & near[b])}
    path = LocalGraph.of([("x", "y"), ("y", "z")])
    assert pairs(filters.shape_graph(t, path, 0, 2, 2)) == {(a, b) for a in near for b in near if a != b and len(near[a] & near[b]) >= 2}
    assert {r.id: r.degrees for r in filters.neighbourhood_degrees(t).collect()} == {v: sorted((len(near[w]) for w in near[v]), reverse=True) for v in near if near[v]}
    assert filters.degree_sequence_fits(path, t) and not filters.degree_sequence_fits(LocalGraph.of([("h", i) for i in range(9)]), t)
    sizes = {r.pattern_vertex: r.candidates for r in filters.domain_sizes(path, t).collect()}
    assert sizes["y"] == sum(len(near[v]) >= 2 for v in near)


@pytest.mark.parametrize("seed", [2, 3])
def test_cliques(spark, seed):
    g = some_graph(seed)
    t = Graph.from_local(spark, g)
    counts = {r["size"]: r["cliques"] for r in clique.clique_counts(t, 5).collect()}
    assert counts == {k: brute.cliques(g, k) for k in range(1, 6)}
    best = max(k for k in range(1, 10) if brute.cliques(g, k))
    assert clique.clique_number(t).first()[0] == best
    found = clique.max_clique(t)
    assert len(found) == best and all((a, b) in g.arcs for a in found for b in found if a != b)
    assert clique.has_clique(t, best) and not clique.has_clique(t, best + 1) and clique.has_clique(t, 0)
    assert {r["id"]: r["size"] for r in clique.clique_sizes(t).collect()} == {v: clique.local_clique_size(g, v) for v in range(g.size)}


def test_cliques_of_graphs_without_edges(spark):
    assert clique.clique_number(Graph.from_local(spark, LocalGraph(3))).first()[0] == 1
    assert clique.clique_number(Graph.from_local(spark, LocalGraph(0))).first()[0] == 0
    loops = LocalGraph.of([("a", "a"), ("b", "b")])
    assert clique.clique_number(Graph.from_local(spark, loops)).first()[0] == 1


def common(f, s, connected=False):
    """Sizes of all common mappings, by trying all."""
    out = []
    for k in range(1, min(f.size, s.size) + 1):
        for left in (c for c in permutations(range(f.size), k) if list(c) == sorted(c)):
            if connected:
                seen, stack = {left[0]}, [left[0]]
                while stack:
                    v = stack.pop()
                    new = {w for w in left if w not in seen and ((v, w) in f.arcs or (w, v) in f.arcs)}
                    seen |= new
                    stack += new
                if len(seen) < k:
                    continue
            for right in permutations(range(s.size), k):
                if all(f.labels[a] == s.labels[b] for a, b in zip(left, right)) and all(f.arcs.get((a, c)) == s.arcs.get((b, d)) for a, b in zip(left, right) for c, d in zip(left, right)):
                    out.append(k)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_common_subgraphs(spark, seed):
    f, s = some_graph(seed, 4, 0.5), some_graph(seed + 50, 5, 0.5)
    for connected in (False, True):
        sizes = common(f, s, connected)
        assert mcs.search(f, s, connected).size == max(sizes, default=0)
        for k in (1, 2, 3):
            r = mcs.search(f, s, connected, decide=k, count=True)
            assert r.count == sum(x >= k for x in sizes)
    sizes = common(f, s)
    a, b = Graph.from_local(spark, f), Graph.from_local(spark, s)
    assert len(mcs.mcs_by_clique(a, b)) == max(sizes, default=0)
    assert mcs.mappings_of_size(a, b, 2).count() == sizes.count(2)
    row = mcs.max_common_subgraph(spark, f, s, decide=2, count=True).first()
    assert row["count"] == sum(x >= 2 for x in sizes)
    assert mcs.max_common_subgraph(spark, f, s, connected=True).first()["size"] == max(common(f, s, True), default=0)


def test_known_common_subgraphs():
    k = lambda n: LocalGraph.of([(a, b) for a in range(n) for b in range(a)])
    path = lambda n: LocalGraph.of([(i, i + 1) for i in range(n - 1)])
    two = LocalGraph.of([(0, 1), (2, 3)])
    assert [mcs.search(*x).size for x in ((k(3), k(4)), (k(3), path(3)), (path(4), path(4)), (two, two))] == [3, 2, 4, 4]
    assert mcs.search(two, two, connected=True).size == 2 and mcs.search(k(2), k(2), decide=2, count=True).count == 2
    assert mcs.search(k(3), k(3), decide=0).size == 0 and mcs.search(k(3), k(3), decide=4).mapping == {}
    with pytest.raises(UnsupportedConfiguration):
        mcs.search(k(2), k(2), count=True)


def test_opb_models_hold_for_solutions_only(spark, tmp_path):
    p, t = LocalGraph.of([("a", "b"), ("b", "c")]), some_graph(7, 4)
    g = Graph.from_local(spark, t)
    rows = [r.constraint for r in opb_constraints(p, g, induced=True).collect()]

    def holds(line, m):
        left, right = line.rstrip(" ;").split(" >= ")
        terms = left.split()
        total = 0
        for weight, x in zip(terms[::2], terms[1::2]):
            v, image = x.lstrip("~x").split("_")
            total += int(weight) * ((m[int(v)] == int(image)) != x.startswith("~"))
        return total >= int(right)

    want = brute.solutions(p, t, induced=True)
    for m in ((a, b, c) for a in range(4) for b in range(4) for c in range(4)):
        assert all(holds(r, m) for r in rows) == (m in want)
    write_opb(p, g, str(tmp_path / "opb"), induced=True)
    text = "".join(f.read_text() for f in sorted((tmp_path / "opb").glob("part-*")))
    assert text.splitlines()[0] == f"* #variable= 12 #constraint= {len(rows)}"


def test_registered_queries(spark):
    import duckdb

    import __spark_entry__ as e
    from motiva import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "part", "nation"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert set(queries.oracle_sql()) <= set(e.queries()) and e.entry(spark).columns == ["a", "b", "c"]
    for name in ("triangle_embeddings", "path3_induced", "directed_cycle3", "loop_induced", "edge_labelled_path", "clique_counts", "tree_hom_count"):
        df = e.queries()[name](spark, sf)
        rows = con.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(rows), name


def test_clique_kernel_options():
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        near = [0] * n
        for a, b in itertools.combinations(range(n), 2):
            if rng.random() < 0.5:
                near[a] |= 1 << b
                near[b] |= 1 << a
        whole = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(near[a] >> b & 1 for a, b in itertools.combinations(c, 2))]
        best = max(map(len, whole))
        for order in clique.ORDERS:
            for given in (False, True):
                r = clique.search_clique(near, order=order, input_order=given)
                assert r.size == best and tuple(r.members) in whole and r.complete
        assert clique.search_clique(near, decide=best).size == best and clique.search_clique(near, decide=best + 1).size == 0
        touch = [0] * n
        for a, b in itertools.combinations(range(n), 2):
            if near[a] >> b & 1 and rng.random() < 0.4:
                touch[a] |= 1 << b
                touch[b] |= 1 << a

        def joined(c):
            seen = {c[0]}
            for _ in c:
                seen |= {v for v in c if any(touch[v] >> w & 1 for w in seen)}
            return len(seen) == len(c)

        assert clique.search_clique(near, touching=touch).size == max(len(c) for c in whole if joined(c))
    dense = [((1 << 90) - 1) & ~(1 << v) & ~(1 << (v + 1) % 90) & ~(1 << (v - 1) % 90) & ~sum(1 << w for w in range(90) if (v * w + v + w) % 3 == 0) for v in range(90)]
    dense = [sum(1 << w for w in range(90) if dense[v] >> w & 1 and dense[w] >> v & 1) for v in range(90)]
    assert not clique.search_clique(dense, timeout=0.0).complete


def test_clique_results(spark):
    g = some_graph(5)
    t = Graph.from_local(spark, g)
    best = max(k for k in range(1, 10) if brute.cliques(g, k))
    r = clique.solve_clique(t)
    assert r.size == best and r.complete and r.nodes > 0
    assert clique.solve_clique(t, decide=best).size == best and clique.solve_clique(t, decide=best + 1).members == [] and clique.solve_clique(t, decide=0).size == 0
    text = sinks.run_report(r, graph="g.lad", seconds=0.5)
    assert f"size = {best}\n" in text and "status = true\n" in text and "runtime = 500\n" in text and "graph_file = g.lad\n" in text


@pytest.mark.parametrize("seed", range(3))
def test_connected_common_subgraphs_by_clique(spark, seed):
    f, s = some_graph(seed, 4, 0.5), some_graph(seed + 50, 5, 0.5)
    found = mcs.mcs_by_clique(Graph.from_local(spark, f), Graph.from_local(spark, s), connected=True)
    assert len(found) == max(common(f, s, True), default=0)


def test_timeouts_of_common_subgraphs():
    f, s = some_graph(1, 40, 0.5), some_graph(2, 40, 0.5)
    r = mcs.search(f, s, timeout=0.3)
    assert not r.complete and r.size > 0 and r.nodes > 0


def test_domains_suffice(spark):
    t = Graph.from_local(spark, LocalGraph.of([(0, 1), (1, 2), (2, 3)]))
    path, star = LocalGraph.of([("a", "b"), ("b", "c")]), LocalGraph.of([("a", "b"), ("a", "c"), ("a", "d")])
    assert filters.domains_suffice(filters.candidates(path, t)) and not filters.domains_suffice(filters.candidates(star, t))
    same = LocalGraph.of([(0, 1), (1, 2), (2, 3)])
    sizes = {v: df.count() for v, df in filters.candidates(same, t, induced=True).items()}
    assert filters.sound_filters(same, t, filters.Options(induced=True))["equal"] and sizes == {0: 2, 1: 2, 2: 2, 3: 2}
    shapes = [(path, 0, 2, 1)]
    assert {v: df.count() for v, df in filters.candidates(same, t, use=("shapes",), shapes=shapes).items()} == {0: 4, 1: 4, 2: 4, 3: 4}


def test_models_of_cliques_and_common_subgraphs(spark):
    from itertools import product

    from motiva.operators.opb import clique_model, common_subgraph_model, mapping_literals, proof_text

    def holds(line, true):
        left, right = line.rstrip(" ;").split(" >= ")
        terms = left.split()
        return sum(int(w) * (x in true) for w, x in zip(terms[::2], terms[1::2])) >= int(right)

    g = some_graph(3, 6)
    lines = [r["constraint"] for r in clique_model(Graph.from_local(spark, g), least=3).collect()]
    count = sum(all(holds(x, {f"x{v}" for v in range(6) if m[v]}) for x in lines) for m in product((0, 1), repeat=6))
    assert count == sum(brute.cliques(g, k) for k in range(3, 7))
    f, s = some_graph(1, 3, 0.5), some_graph(2, 4, 0.5)
    lines = [r["constraint"] for r in common_subgraph_model(Graph.from_local(spark, f), Graph.from_local(spark, s), least=2).collect()]
    good = 0
    for m in product((None, 0, 1, 2, 3), repeat=3):
        good += all(holds(x, {f"x{v}_{'null' if w is None else w}" for v, w in enumerate(m)}) for x in lines)
    assert good == sum(k >= 2 for k in common(f, s))
    text = proof_text(5, [mapping_literals(LocalGraph(2), {0: 3, 1: 4})], "SAT")
    assert text.splitlines()[1] == "f 5" and "conclusion SAT : x0_3 x1_4" in text
    with pytest.raises(ValueError):
        proof_text(5, [], "UNSAT")
