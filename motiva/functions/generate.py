"""Random graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def random_graph(spark: SparkSession, n: int, p: float, seed: int = 0, directed: bool = False, loops: float = 0.0) -> Graph:
    """n vertices v0, v1, ..; each pair an edge (each ordered pair an arc, if ``directed``) with probability p, each vertex a loop with ``loops``."""
    draw = (F.xxhash64(F.lit(seed), "src", "dst").cast("double") / 2.0**64) + 0.5
    pairs = spark.range(n).select(F.col("id").alias("src")).crossJoin(spark.range(n).select(F.col("id").alias("dst")))
    chosen = pairs.where(draw < F.when(F.col("src") == F.col("dst"), F.lit(loops)).otherwise(F.lit(p)))
    if not directed:
        chosen = chosen.where("src <= dst")
        chosen = chosen.union(chosen.where("src < dst").select("dst", "src"))
    vertices = spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("name"), F.lit("").alias("label"))
    return Graph(vertices, chosen.select("src", "dst", F.lit("").alias("label")), directed)
