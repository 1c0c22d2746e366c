"""Writers: LAD text and reports of results."""

from __future__ import annotations

import platform
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph, UnsupportedConfiguration


def lad_text(g: LocalGraph) -> str:
    """LAD of an unlabelled graph: its size, then degree and neighbours of each vertex."""
    if g.has_vertex_labels or g.has_edge_labels:
        raise UnsupportedConfiguration("LAD has no labels")
    lines = [str(g.size)]
    for v in range(g.size):
        near = sorted(g.neighbours(v))
        lines.append(" ".join(map(str, (len(near), *near))))
    return "\n".join(lines) + "\n"


def lad_lines(g: Graph) -> DataFrame:
    """(id, value): the line of each vertex of a large graph, whose ids must be 0, 1, ..; the size comes before them."""
    if g.has_vertex_labels or g.has_edge_labels:
        raise UnsupportedConfiguration("LAD has no labels")
    near = g.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("n"))
    line = F.concat_ws(" ", F.size("n").cast("string"), F.transform("n", lambda x: x.cast("string")))
    rows = g.vertices.select("id").join(near, "id", "left").select("id", F.when(F.col("n").isNull(), "0").otherwise(line).alias("value"))
    head = g.vertices.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).cast("long").alias("id"), "value")
    return head.union(rows)


def write_lad(g: Graph, path: str) -> None:
    """LAD as text files that hold its lines in order."""
    lad_lines(g).orderBy("id").select("value").write.text(path)


def report(values: dict[str, object]) -> str:
    """Lines 'key = value'."""
    return "".join(f"{k} = {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in values.items())


def run_report(result, pattern: LocalGraph | None = None, names: dict[int, str] | None = None, seconds: float | None = None, **files: str) -> str:
    """The report of a matching, clique or common subgraph result: who ran it when, on which files, status, counts, nodes,
    the mapping or members, and the runtime in milliseconds."""
    values: dict[str, object] = {"hostname": platform.node(), "started_at": time.strftime("%Y-%m-%d %H:%M:%S"), **{f"{k}_file": v for k, v in files.items()}}
    mapping, members = getattr(result, "mapping", None), getattr(result, "members", None)
    values["status"] = getattr(result, "status", None) or ("true" if mapping or members else "false" if result.complete else "aborted")
    for key in ("size", "count", "nodes", "propagations", "restarts", "complete"):
        if (value := getattr(result, key, None)) is not None:
            values["solution_count" if key == "count" else key] = value
    named = names or {}
    if mapping:
        values["mapping"] = mapping_text(pattern, {t: named.get(t, str(t)) for t in mapping.values()}, mapping) if pattern is not None else " ".join(f"({a} -> {b})" for a, b in sorted(mapping.items()))
    if members:
        values["clique"] = " ".join(named.get(v, str(v)) for v in members)
    seconds = getattr(result, "seconds", None) if seconds is None else seconds
    if seconds is not None:
        values["runtime"] = round(1000 * seconds)
    return report(values)


def mapping_text(pattern: LocalGraph, names: dict[int, str], mapping: dict[int, int]) -> str:
    """(p -> t) for each pattern vertex, in order of its id."""
    return " ".join(f"({pattern.names[p]} -> {names[t]})" for p, t in sorted(mapping.items()))
