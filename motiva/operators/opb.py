"""The matching problem as a pseudo-Boolean model in OPB text, for solvers and checkers outside: a constraint a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, LocalGraph
from .match import Options, _domain


def opb_constraints(p: LocalGraph, t: Graph, **kw) -> DataFrame:
    """(kind, constraint) over variables xP_T, true if pattern vertex P maps to target vertex T, both by id: each vertex has
    an image and no second one, images that must differ do, and an arc's other end maps to a neighbour (and, induced, that
    of a pair without an arc to none)."""
    from ..plans.order import common_in_neighbour

    o = Options(**kw)
    o.check(p)
    ids = t.vertices.select("id")
    rows: list[DataFrame] = []

    def add(kind: str, df: DataFrame) -> None:
        rows.append(df.select(F.lit(kind).alias("kind"), F.col("c").alias("constraint")))

    def terms(v: int, weight: int, column: str = "id"):
        return F.array_join(F.transform(F.sort_array(F.collect_list(column)), lambda x: F.concat(F.lit(f"{weight:+d} x{v}_"), x.cast("string"))), " ")

    for v in range(p.size):
        add("some image", ids.agg(F.concat(terms(v, 1), F.lit(" >= 1 ;")).alias("c")))
        add("one image", ids.agg(F.concat(terms(v, -1), F.lit(" >= -1 ;")).alias("c")))
        domain = _domain(p, t, o, v)
        if domain is not None:
            add("domain", ids.join(domain, "id", "left_anti").select(F.concat(F.lit(f"+1 ~x{v}_"), F.col("id").cast("string"), F.lit(" >= 1 ;")).alias("c")))
    pairs = {(a, b) for a in range(p.size) for b in range(a + 1, p.size)} if o.injectivity == "injective" else common_in_neighbour(p) if o.injectivity == "locally_injective" else set()
    if o.injectivity == "injective" and p.size:
        every = " ".join(f"-1 x{v}_%" for v in range(p.size))
        add("injective", ids.select(F.concat(F.regexp_replace(F.lit(every), "%", F.col("id").cast("string")), F.lit(" >= -1 ;")).alias("c")))
    elif pairs:
        for a, b in sorted(pairs):
            add("injective", ids.select(F.concat(F.lit(f"-1 x{a}_"), F.col("id").cast("string"), F.lit(f" -1 x{b}_"), F.col("id").cast("string"), F.lit(" >= -1 ;")).alias("c")))
    for a in range(p.size):
        for b in range(p.size):
            if a == b:
                continue
            if (a, b) in p.arcs:
                e = t.edges.where(F.col("label") == p.arcs[a, b]) if p.has_edge_labels else t.edges
                near = e.groupBy(F.col("src").alias("id")).agg(terms(b, 1, "dst").alias("n"))
                c = F.concat(F.lit(f"+1 ~x{a}_"), F.col("id").cast("string"), F.lit(" "), F.coalesce("n", F.lit("")), F.lit(" >= 1 ;"))
                add("edge", ids.join(near, "id", "left").select(F.regexp_replace(c, "  +", " ").alias("c")))
            elif o.induced:
                add("induced", t.edges.select(F.concat(F.lit(f"-1 x{a}_"), F.col("src").cast("string"), F.lit(f" -1 x{b}_"), F.col("dst").cast("string"), F.lit(" >= -1 ;")).alias("c")))
    out = None
    for r in rows:
        out = r if out is None else out.unionByName(r)
    return out if out is not None else t.edges.sparkSession.createDataFrame([], "kind string, constraint string")


def write_opb(p: LocalGraph, t: Graph, path: str, **kw) -> None:
    """The model as text files: a header with the numbers of variables and constraints, then the constraints."""
    rows = opb_constraints(p, t, **kw)
    head = f"* #variable= {p.size * t.vertices.count()} #constraint= {rows.count()}"
    spark = t.edges.sparkSession
    first = spark.createDataFrame([(0, head)], "o int, value string")
    first.union(rows.select(F.lit(1).alias("o"), F.col("constraint").alias("value"))).orderBy("o").select("value").write.text(path)


def clique_model(t: Graph, least: int | None = None) -> DataFrame:
    """(kind, constraint) over xV, true if vertex V is in the clique: no two vertices without an edge, and ``least`` vertices if given, else as many as possible."""
    ids = t.vertices.select("id")
    x = lambda c: F.concat(F.lit("x"), F.col(c).cast("string"))
    terms = lambda sign: F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda v: F.concat(F.lit(f"{sign}1 x"), v.cast("string"))), " ")
    if least is None:
        goal = ids.agg(F.concat(F.lit("min: "), terms("-"), F.lit(" ;")).alias("constraint")).select(F.lit("objective").alias("kind"), "constraint")
    else:
        goal = ids.agg(F.concat(terms("+"), F.lit(f" >= {least} ;")).alias("constraint")).select(F.lit("size").alias("kind"), "constraint")
    pairs = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
    apart = pairs.join(t.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    return goal.union(apart.select(F.lit("apart"), F.concat(F.lit("-1 "), x("a"), F.lit(" -1 "), x("b"), F.lit(" >= -1 ;"))))


def common_subgraph_model(f: Graph, s: Graph, least: int | None = None) -> DataFrame:
    """(kind, constraint) over xF_S, true if vertex F of the first graph maps to S of the second, and xF_null if to none: one of these
    for each F, one F for each S, no two pairs that disagree, and ``least`` pairs if given, else as many as possible."""
    from .mcs import association

    a = association(f, s)
    name = F.regexp_replace(F.concat(F.lit("x"), "name"), ":", "_")
    pairs = a.vertices.select("id", name.alias("x"), F.split("name", ":")[0].cast("long").alias("f"), F.split("name", ":")[1].cast("long").alias("s"))
    joined = lambda sign, column="x": F.array_join(F.transform(F.sort_array(F.collect_list(column)), lambda v: F.concat(F.lit(f"{sign}1 "), v)), " ")
    null = F.concat(F.lit("x"), F.col("f").cast("string"), F.lit("_null"))
    firsts = f.vertices.select(F.col("id").alias("f")).join(pairs.groupBy("f").agg(joined("+").alias("p"), joined("-").alias("m")), "f", "left")
    rows = firsts.select(F.lit("some image").alias("kind"), F.concat_ws(" ", "p", F.concat(F.lit("+1 "), null), F.lit(">= 1 ;")).alias("constraint"))
    rows = rows.union(firsts.select(F.lit("one image"), F.concat_ws(" ", "m", F.concat(F.lit("-1 "), null), F.lit(">= -1 ;"))))
    rows = rows.union(pairs.groupBy("s").agg(joined("-").alias("m")).select(F.lit("injective"), F.concat_ws(" ", "m", F.lit(">= -1 ;"))))
    x, y = (pairs.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"), F.col("f").alias(f"f{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    apart = x.join(y, (F.col("fa") < F.col("fb")) & (F.col("sa") != F.col("sb"))).join(a.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    rows = rows.union(apart.select(F.lit("apart"), F.concat(F.lit("-1 "), "xa", F.lit(" -1 "), "xb", F.lit(" >= -1 ;"))))
    nulls = f.vertices.select(F.col("id").alias("f")).select(null.alias("x"))
    if least is None:
        goal = nulls.agg(F.concat(F.lit("min: "), joined("+"), F.lit(" ;")).alias("c"))
    else:
        goal = nulls.agg(F.count("*").alias("n"), joined("-").alias("m")).select(F.concat("m", F.lit(" >= "), (F.lit(least) - F.col("n")).cast("string"), F.lit(" ;")).alias("c"))
    return rows.union(goal.select(F.lit("objective" if least is None else "size"), "c"))


def proof_text(constraints: int, solutions: list[list[str]] = (), conclusion: str = "NONE") -> str:
    """A proof file for a model of that many constraints, which logs solutions as lists of literals.

    ``conclusion``: NONE; SAT, where the last solution is the witness; or BOUNDS low high, as of a model with an objective. What
    needs the steps of a search (that there is no solution, or no other) isn't concluded.
    """
    word = conclusion.split(" ")[0]
    if word not in ("NONE", "SAT", "BOUNDS") or word == "SAT" and not solutions:
        raise ValueError(f"conclusion {conclusion!r} isn't one that this log supports")
    lines = ["pseudo-Boolean proof version 2.0", f"f {constraints}"]
    lines += [f"{'soli' if word == 'BOUNDS' else 'solx'} {' '.join(s)}" for s in (solutions if word != "SAT" else solutions[:-1])]
    lines += ["output NONE", f"conclusion {conclusion}" + (f" : {' '.join(solutions[-1])}" if word == "SAT" else ""), "end pseudo-Boolean proof"]
    return "\n".join(lines) + "\n"


def mapping_literals(p: LocalGraph, mapping: dict[int, int]) -> list[str]:
    """The literals of a solution of ``opb_constraints``."""
    return [f"x{v}_{mapping[v]}" for v in range(p.size)]
