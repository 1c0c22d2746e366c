"""Readers of graph files.

Text of a small file is parsed on the driver. Large edge lists (CSV, DIMACS) can be read as DataFrames instead: ids then are
in order of first mention, as they are on the driver, but not dense.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, GraphFileError, LocalGraph

PROBLEM = re.compile(r"p\s+(?:edge|col)\s+(\d+)(?:\s+\d*)?\s*")
COMMENT = re.compile(r"c(\s.*)?")
EDGE = re.compile(r"e\s+(\d+)\s+(\d+)\s*")
LAD = {"lad": (False, False, False), "directedlad": (True, False, False), "labelledlad": (True, True, True), "vertexlabelledlad": (False, True, False)}
VFMCS = {"vfmcs": (False, False), "vfmcsv": (True, False), "vfmcsvd": (True, True)}


def detect_format(lines: Iterable[str], path: str = "<text>") -> str:
    """dimacs, lad, labelledlad or csv, from the first lines of a file."""
    it = iter(lines)
    first = next(it, "")
    if not first:
        raise GraphFileError(path, "it is empty, so its format can't be told")
    if COMMENT.fullmatch(first):
        while COMMENT.fullmatch(first):
            first = next(it, "")
        if not PROBLEM.fullmatch(first):
            raise GraphFileError(path, "comments aren't followed by a problem line, so its format can't be told")
        return "dimacs"
    if PROBLEM.fullmatch(first):
        return "dimacs"
    if re.fullmatch(r"\d+", first):
        if first == "0":
            return "lad"
        second = next(it, "")
        if second == "0":
            return "lad"
        if re.fullmatch(r"0 \d+", second):
            return "labelledlad"
        words = second.split()
        if not re.fullmatch(r"\d+\s+(\d+\s+)*\d+\s*", second):
            raise GraphFileError(path, "a number comes first, but no line of edges after it, so its format can't be told")
        plain, labelled = len(words) == int(words[0]) + 1, len(words) == 2 * int(words[1]) + 2
        if plain == labelled:
            raise GraphFileError(path, f"a line of {len(words)} numbers fits {'both' if plain else 'neither'} of lad and labelledlad")
        return "lad" if plain else "labelledlad"
    if re.fullmatch(r"\S+[,>]\S+", first):
        return "csv"
    raise GraphFileError(path, "its format can't be told")


def _checked(g: LocalGraph, path: str) -> LocalGraph:
    for text in (*g.names, *g.labels, *g.arcs.values()):
        if any(not ("!" <= c <= "~") for c in text):
            raise GraphFileError(path, f"{text!r} has a character that is a space or can't be printed")
    return g


def _rows(text: str) -> list[str]:
    return text.split("\n")[:-1] if text.endswith("\n") else text.split("\n") if text else []


def parse_csv(text: str, path: str = "<text>", rename: dict[str, str] | None = None) -> LocalGraph:
    ids: dict[str, int] = {}
    labels: dict[str, str] = {}
    edges, arrows, edge_labels = [], False, False
    for line in _rows(text):
        if not (m := re.fullmatch(r"([^,>]*)([,>])([^,]*)(?:,(.*))?", line)):
            raise GraphFileError(path, f"line {line!r} has no delimiter")
        a, kind, b, label = m.group(1), m.group(2), m.group(3), m.group(4) or ""
        if not b and a:
            ids.setdefault(a, len(ids))
            if label:
                labels.setdefault(a, label)
            continue
        for v in (a, b):
            ids.setdefault(v, len(ids))
        arrows, edge_labels = arrows or kind == ">", edge_labels or bool(label)
        edges.append((ids[a], ids[b], label, kind == ">"))
    g = LocalGraph(len(ids), arrows or edge_labels, bool(labels), edge_labels, list(ids), [labels.get(v, "") for v in ids])
    for a, b, label, arrow in edges:
        g.arcs[a, b] = label
        if not arrow:
            g.arcs[b, a] = label
    if rename is not None:
        if missing := [v for v in ids if v not in rename]:
            raise GraphFileError(path, f"vertex {missing[0]!r} has no other name")
        g.names = [rename[v] for v in ids]
    return _checked(g, path)


def parse_lad(text: str, path: str = "<text>", kind: str = "lad") -> LocalGraph:
    directed, vertex_labels, edge_labels = LAD[kind]
    words = iter(text.split())

    def number(what: str) -> int:
        w = next(words, None)
        if w is None or not re.fullmatch(r"-?\d+", w):
            raise GraphFileError(path, f"{what} expected, not {w!r}")
        return int(w)

    g = LocalGraph(number("number of vertices"), directed, vertex_labels, edge_labels)
    for v in range(g.size):
        if vertex_labels:
            g.labels[v] = str(number("label"))
        for _ in range(number("number of edges")):
            w = number("vertex")
            if not 0 <= w < g.size:
                raise GraphFileError(path, f"vertex {w} is out of bounds")
            label = number("edge label") if edge_labels else 0
            if label < 0:
                raise GraphFileError(path, f"edge label {label} is negative")
            g.add(v, w, str(label) if edge_labels else "")
    for w in words:
        at, equals, name = w.partition("=")
        if not equals or not at.isdigit() or int(at) >= g.size:
            raise GraphFileError(path, f"{w!r} follows the last vertex")
        g.names[int(at)] = name
    return _checked(g, path)


def parse_dimacs(text: str, path: str = "<text>") -> LocalGraph:
    g = LocalGraph()
    for line in _rows(text):
        if not line or COMMENT.fullmatch(line):
            continue
        if m := PROBLEM.fullmatch(line):
            if g.size:
                raise GraphFileError(path, "it has two problem lines")
            g = LocalGraph(int(m.group(1)), names=[str(i + 1) for i in range(int(m.group(1)))])
        elif m := EDGE.fullmatch(line):
            a, b = int(m.group(1)), int(m.group(2))
            if not (1 <= a <= g.size and 1 <= b <= g.size):
                raise GraphFileError(path, f"line {line!r} is out of bounds")
            g.add(a - 1, b - 1)
        else:
            raise GraphFileError(path, f"line {line!r} is neither comment, problem nor edge")
    return g


def label_shift(size: int) -> int:
    """Bits of an attribute word that are dropped, for about a third as many labels as vertices."""
    power, bits, ahead = 1, 0, 0
    while power < size * 33 // 100 and bits < 16:
        power, bits, ahead = power * 2, ahead, ahead + 1
    return 16 - bits


def parse_vfmcs(data: bytes, path: str = "<bytes>", kind: str = "vfmcs") -> LocalGraph:
    vertex_labels, directed = VFMCS[kind]
    if len(data) % 2:
        raise GraphFileError(path, "it has half a word")
    words = iter(struct.unpack(f"<{len(data) // 2}H", data))

    def word(what: str) -> int:
        w = next(words, None)
        if w is None:
            raise GraphFileError(path, f"it ends before {what}")
        return w

    g = LocalGraph(word("the number of vertices"), directed, vertex_labels)
    shift = label_shift(g.size)
    for v in range(g.size):
        label = word("the labels end") >> shift
        if vertex_labels:
            g.labels[v] = str(label)
    for v in range(g.size):
        for _ in range(word("the number of edges")):
            w = word("the edges end")
            if w >= g.size:
                raise GraphFileError(path, f"vertex {w} is out of bounds")
            g.add(v, w, "directed" if directed else "")
            word("an edge's label")
    if next(words, None) is not None:
        raise GraphFileError(path, "something follows the last vertex")
    return g


def load(path: str, format: str = "auto") -> LocalGraph:
    """A graph file on the driver. ``format``: auto, csv, csvname:FILE, lad, directedlad, labelledlad, vertexlabelledlad, dimacs, vfmcs, vfmcsv or vfmcsvd."""
    return parse(_local(path), path, format, _local)


def _local(path: str) -> bytes:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError as e:
        raise GraphFileError(path, "it can't be opened", existed=False) from e


def parse(data: bytes, path: str, format: str, read: Callable[[str], bytes]) -> LocalGraph:
    """The graph of a file's content; ``read`` gives that of another file."""
    if format in VFMCS:
        return parse_vfmcs(data, path, format)
    text = data.decode("utf-8", "replace")
    if format == "auto":
        format = detect_format(_rows(text), path)
    if format in LAD:
        return parse_lad(text, path, format)
    if format == "dimacs":
        return parse_dimacs(text, path)
    if format == "csv":
        return parse_csv(text, path)
    if format.startswith("csvname:"):
        pairs = [line.partition(",") for line in read(format[8:]).decode("utf-8").split("\n") if line]
        return parse_csv(text, path, {a: b for a, _, b in pairs})
    raise GraphFileError(path, f"format {format!r} is unknown")


def read_graph(spark: SparkSession, path: str, format: str = "auto") -> Graph:
    """A graph file, in any store that Spark reads, as DataFrames: CSV and DIMACS as distributed edge lists, other formats by way of the driver."""

    def content(file: str) -> bytes:
        try:
            row = spark.read.format("binaryFile").load(file).select("content").first()
        except Exception as e:
            raise GraphFileError(file, "it can't be opened", existed=False) from e
        if row is None:
            raise GraphFileError(file, "it can't be opened", existed=False)
        return bytes(row["content"])

    if format == "auto":
        try:
            format = detect_format((r[0] for r in spark.read.text(path).limit(1000).toLocalIterator()), path)
        except GraphFileError:
            raise
        except Exception as e:
            raise GraphFileError(path, "it can't be opened", existed=False) from e
    if format == "csv":
        return read_csv(spark, path)
    if format == "dimacs":
        return read_dimacs(spark, path)
    return Graph.from_local(spark, parse(content(path), path, format, content))


def _bad(df: DataFrame, condition: str, path: str, message: str) -> None:
    row = df.where(condition).select("value").first()
    if row is not None:
        raise GraphFileError(path, f"line {row[0]!r} {message}")


def read_csv(spark: SparkSession, path: str) -> Graph:
    pattern = r"^([^,>]*)([,>])([^,]*)(?:,(.*))?$"
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    _bad(lines, r"not value rlike '^[^,>]*[,>]' or value rlike '[^!-~]'", path, "has no delimiter, or a character that is a space or can't be printed")
    part = lambda k: F.regexp_extract("value", pattern, k)
    rows = lines.select("line", part(1).alias("a"), part(2).alias("kind"), part(3).alias("b"), part(4).alias("label"))
    alone = rows.where("b = '' and a <> ''")
    pairs = rows.where("not (b = '' and a <> '')")
    mentions = alone.select("a", (F.col("line") * 2).alias("at")).union(pairs.select("a", (F.col("line") * 2).alias("at"))).union(pairs.select("b", (F.col("line") * 2 + 1).alias("at")))
    named = mentions.groupBy(F.col("a").alias("name")).agg(F.min("at").alias("id"))
    labels = alone.where("label <> ''").groupBy(F.col("a").alias("name")).agg(F.min_by("label", "line").alias("label"))
    flags = pairs.agg(F.coalesce(F.max(F.col("kind") == ">"), F.lit(False)), F.coalesce(F.max(F.col("label") != ""), F.lit(False))).first()
    arcs = pairs.select("a", "b", "label", "line").union(pairs.where("kind = ','").select("b", "a", "label", "line"))
    a, b = named.select(F.col("name").alias("a"), F.col("id").alias("src")), named.select(F.col("name").alias("b"), F.col("id").alias("dst"))
    edges = arcs.join(a, "a").join(b, "b").groupBy("src", "dst").agg(F.max_by("label", "line").alias("label"))
    vertices = named.join(labels, "name", "left").select("id", "name", F.coalesce("label", F.lit("")).alias("label"))
    return Graph(vertices, edges, bool(flags[0] or flags[1]), not labels.isEmpty(), bool(flags[1]))


def read_dimacs(spark: SparkSession, path: str) -> Graph:
    lines = spark.read.text(path).where("value <> '' and not value rlike '^c(\\\\s.*)?$'")
    problem, edge = r"^p\s+(?:edge|col)\s+(\d+)(?:\s+\d*)?\s*$", r"^e\s+(\d+)\s+(\d+)\s*$"
    _bad(lines.where(~F.col("value").rlike(problem) & ~F.col("value").rlike(edge)), "true", path, "is neither comment, problem nor edge")
    sizes = [int(r[0]) for r in lines.where(F.col("value").rlike(problem)).select(F.regexp_extract("value", problem, 1)).limit(2).collect()]
    if len(sizes) != 1:
        raise GraphFileError(path, f"it has {'two problem lines' if sizes else 'no problem line'}")
    ends = lines.where(F.col("value").rlike(edge)).select("value", F.regexp_extract("value", edge, 1).cast("long").alias("a"), F.regexp_extract("value", edge, 2).cast("long").alias("b"))
    _bad(ends, f"not (a between 1 and {sizes[0]} and b between 1 and {sizes[0]})", path, "is out of bounds")
    arcs = ends.select((F.col("a") - 1).alias("src"), (F.col("b") - 1).alias("dst"))
    edges = arcs.union(arcs.select("dst", "src")).distinct().withColumn("label", F.lit(""))
    vertices = spark.range(sizes[0]).select("id", (F.col("id") + 1).cast("string").alias("name"), F.lit("").alias("label"))
    return Graph(vertices, edges)
