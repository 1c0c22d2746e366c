"""Driver-side planning: the order in which pattern vertices are joined, and checks of constraints."""

from __future__ import annotations

from ..graph import LocalGraph, UnsupportedConfiguration

INJECTIVITY = ("injective", "locally_injective", "noninjective")


def adjacency(p: LocalGraph) -> list[set[int]]:
    """Neighbours of each vertex along arcs of either direction, without itself."""
    near: list[set[int]] = [set() for _ in range(p.size)]
    for a, b in p.arcs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def join_order(p: LocalGraph) -> list[int]:
    """Connected as far as possible: next is the vertex with most neighbours among those placed, then with most at all."""
    near, order = adjacency(p), []
    left = set(range(p.size))
    while left:
        v = max(left, key=lambda v: (len(near[v].intersection(order)), (v, v) in p.arcs, len(near[v]), bool(p.labels[v]), -v))
        order.append(v)
        left.remove(v)
    return order


def components(p: LocalGraph) -> list[list[int]]:
    near, seen, out = adjacency(p), set(), []
    for v in range(p.size):
        if v not in seen:
            stack, part = [v], []
            seen.add(v)
            while stack:
                x = stack.pop()
                part.append(x)
                new = near[x] - seen
                seen |= new
                stack += new
            out.append(sorted(part))
    return out


def subgraph(p: LocalGraph, keep: list[int]) -> LocalGraph:
    at = {v: i for i, v in enumerate(keep)}
    g = LocalGraph(len(keep), p.directed, p.has_vertex_labels, p.has_edge_labels, [p.names[v] for v in keep], [p.labels[v] for v in keep])
    g.arcs = {(at[a], at[b]): label for (a, b), label in p.arcs.items() if a in at and b in at}
    return g


def is_forest(p: LocalGraph) -> bool:
    near = adjacency(p)
    return sum(map(len, near)) // 2 == p.size - len(components(p))


def is_clique(p: LocalGraph) -> bool:
    return all((a, b) in p.arcs for a in range(p.size) for b in range(p.size) if a != b)


def common_in_neighbour(p: LocalGraph) -> set[tuple[int, int]]:
    """Pairs a < b with a vertex that has arcs to both: the images of these differ in a locally injective mapping."""
    out = set()
    for c in range(p.size):
        near = sorted(p.neighbours(c))
        out |= {(a, b) for a in near for b in near if a < b}
    return out


def check_less(p: LocalGraph, less: list[tuple[int, int]]) -> None:
    """Raises if the constraints a < b have a cycle."""
    after: dict[int, set[int]] = {v: set() for v in range(p.size)}
    for a, b in less:
        after[a].add(b)
    state: dict[int, int] = {}

    def visit(v: int) -> None:
        state[v] = 1
        for w in after[v]:
            if state.get(w) == 1:
                raise UnsupportedConfiguration("the less-than constraints have a cycle")
            if w not in state:
                visit(w)
        state[v] = 2

    for v in after:
        if v not in state:
            visit(v)
