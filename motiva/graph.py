"""Graphs: small ones on the driver, large ones as two DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTICES = "id long, name string, label string"
EDGES = "src long, dst long, label string"


class GraphFileError(ValueError):
    """A graph file that is missing or can't be read; ``existed`` says which."""

    def __init__(self, path: str, message: str, existed: bool = True) -> None:
        super().__init__(f"{path}: {message}")
        self.path, self.existed = path, existed


class UnsupportedConfiguration(ValueError):
    """Options that don't go together."""


def _printable(text: str, what: str) -> str:
    if any(not ("!" <= c <= "~") for c in text):
        raise ValueError(f"{what} {text!r} has a character that is a space or can't be printed")
    return text


@dataclass
class LocalGraph:
    """A graph on the driver: patterns, and inputs of the search kernel. An undirected edge is two arcs, a loop one."""

    size: int = 0
    directed: bool = False
    has_vertex_labels: bool = False
    has_edge_labels: bool = False
    names: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    arcs: dict[tuple[int, int], str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.names = self.names or [str(i) for i in range(self.size)]
        self.labels = self.labels or [""] * self.size

    @staticmethod
    def of(edges: Iterable[tuple], vertices: Iterable[str] = (), labels: dict[str, str] | None = None, directed: bool = False) -> LocalGraph:
        """From (from, to) or (from, to, label) with vertex names; ids are in order of first mention."""
        edges, ids = [tuple(e) for e in edges], {}
        for v in (*vertices, *(x for e in edges for x in e[:2]), *(labels or {})):
            ids.setdefault(str(v), len(ids))
        g = LocalGraph(len(ids), directed, labels is not None, any(len(e) > 2 and e[2] for e in edges), list(ids))
        for v, label in (labels or {}).items():
            g.labels[ids[str(v)]] = _printable(str(label), "label")
        for a, b, *label in edges:
            g.add(ids[str(a)], ids[str(b)], str(label[0]) if label else "")
        for name in g.names:
            _printable(name, "name")
        return g

    def add(self, a: int, b: int, label: str = "") -> None:
        """An arc if the graph is directed, else an edge; the last label of an arc counts."""
        self.arcs[a, b] = _printable(label, "label")
        if not self.directed:
            self.arcs[b, a] = label

    @property
    def loopy(self) -> bool:
        return any(a == b for a, b in self.arcs)

    def neighbours(self, v: int) -> set[int]:
        return {b for a, b in self.arcs if a == v}

    def degree(self, v: int) -> int:
        """Arcs out, a loop included."""
        return len(self.neighbours(v))


@dataclass
class Graph:
    """``vertices`` (id, name, label) and ``edges`` (src, dst, label), both orientations of an undirected edge; missing labels are ''."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    has_vertex_labels: bool = False
    has_edge_labels: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, src: str = "src", dst: str = "dst", label: str | None = None, directed: bool = False, vertices: DataFrame | None = None) -> Graph:
        """Arcs or, unless ``directed``, edges given once or twice, of integer vertices. Nulls are left out; of repeated arcs the greatest label counts.

        ``vertices``: (id, label) or (id,), where some have no edge or a label.
        """
        e = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), (F.coalesce(F.col(label).cast("string"), F.lit("")) if label else F.lit("")).alias("label")).where("src is not null and dst is not null")
        if not directed:
            e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))
        e = e.groupBy("src", "dst").agg(F.max("label").alias("label")) if label else e.distinct()
        ends = e.select(F.col("src").alias("id")) if not directed else e.select(F.explode(F.array("src", "dst")).alias("id"))
        v = ends.withColumn("label", F.lit(""))
        labelled = vertices is not None and "label" in vertices.columns
        if vertices is not None:
            v = v.unionByName(vertices.where("id is not null").select(F.col("id").cast("long").alias("id"), (F.coalesce(F.col("label"), F.lit("")) if labelled else F.lit("")).alias("label")))
        v = v.groupBy("id").agg(F.max("label").alias("label")) if labelled else v.distinct()
        return Graph(v.select("id", F.col("id").cast("string").alias("name"), "label"), e, directed, labelled, label is not None)

    @staticmethod
    def from_local(spark: SparkSession, g: LocalGraph) -> Graph:
        v = spark.createDataFrame([(i, g.names[i], g.labels[i]) for i in range(g.size)], VERTICES)
        e = spark.createDataFrame([(a, b, label) for (a, b), label in sorted(g.arcs.items())], EDGES)
        return Graph(v, e, g.directed, g.has_vertex_labels, g.has_edge_labels)

    def to_local(self) -> LocalGraph:
        """The graph on the driver, ids made dense in their order: for patterns and the kernel, not for large graphs."""
        rows = sorted((tuple(r) for r in self.vertices.select("id", "name", "label").collect()), key=lambda r: r[0])
        at = {r[0]: i for i, r in enumerate(rows)}
        g = LocalGraph(len(rows), self.directed, self.has_vertex_labels, self.has_edge_labels, [r[1] for r in rows], [r[2] for r in rows])
        g.arcs = {(at[a], at[b]): label for a, b, label in self.edges.select("src", "dst", "label").collect()}
        return g

    def loops(self) -> DataFrame:
        return self.edges.where("src = dst")

    def degrees(self) -> DataFrame:
        """(id, degree) of every vertex; arcs out, loops included."""
        return self.vertices.select("id").join(self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("long").alias("degree"))
