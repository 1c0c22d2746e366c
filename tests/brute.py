"""Solutions by trying all mappings, with the rules spelled out here: nothing of the code under test but the class of graphs."""

from itertools import combinations, permutations, product

from motiva.graph import LocalGraph


def solutions(p: LocalGraph, t: LocalGraph, injectivity: str = "injective", induced: bool = False, less=(), occurs_less=()) -> set[tuple[int, ...]]:
    out = set()
    for m in permutations(range(t.size), p.size) if injectivity == "injective" else product(range(t.size), repeat=p.size):
        # Locally injective: what one vertex has arcs to, itself included where it has a loop, has images that differ.
        if injectivity == "locally_injective" and any(len({m[b] for b in near}) < len(near) for v in range(p.size) if (near := [b for b in range(p.size) if (v, b) in p.arcs])):
            continue
        if p.has_vertex_labels and any(p.labels[v] != t.labels[m[v]] for v in range(p.size)):
            continue
        ok = all((m[a], m[b]) in t.arcs and (not p.has_edge_labels or t.arcs[m[a], m[b]] == label) for (a, b), label in p.arcs.items())
        if ok and induced:
            ok = all((a, b) in p.arcs or (m[a], m[b]) not in t.arcs for a in range(p.size) for b in range(p.size))
        if ok and all(m[a] < m[b] for a, b in less) and all(b not in m or (a in m and m.index(a) < m.index(b)) for a, b in occurs_less):
            out.add(m)
    return out


def cliques(g: LocalGraph, k: int) -> int:
    return sum(all((a, b) in g.arcs for a, b in combinations(c, 2)) for c in combinations(range(g.size), k))
