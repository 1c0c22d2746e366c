"""Mixing sources to target weights by weighted fair queueing.

Within its source, each document is put in a shuffled order (MD5 of seed and doc_id). Its virtual finish time is the
source's tokens up to and with it, divided by the source's target weight. The global order by finish time, cut where the
total budget is reached, then holds the sources in proportion to their weights for as long as each lasts.

Running sums never pass through one task: a source is cut into buckets of its shuffle key, and the global order into
ranges; sums within these are added to the sums of those before. The tables of those sums have a row for each source and
bucket, or each range.

Defined cases: tokens are the runs of characters other than white space; a null or blank text has 0 tokens and is placed at
its source's time; a null source is the source '' and sources without a target weight have ``other``; a null doc_id hashes
as 'null'; of repeated rows each counts; ties are ordered by source, key, doc_id and tokens; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed_row

ROWS = 10_000
ORDER = ["__finish", "__source", "__key", "__doc", "__tokens"]


def tokens(text: str = "text") -> Column:
    return F.size(F.expr(f"regexp_extract_all(coalesce({text}, ''), '[^ \\\\t\\\\n\\\\r\\\\f]+', 0)")).cast("long")


def _keyed(docs: DataFrame, seed: int, count: Column) -> DataFrame:
    return docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__source": F.coalesce(F.col("source"), F.lit("")), "__tokens": count, "__key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))))})


def _bucket(buckets: int) -> Column:
    return F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("int")


def _finish(keyed: DataFrame, before: DataFrame, buckets: int, weights: dict[str, float], other: float) -> DataFrame:
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col("__source") == name, float(w)).otherwise(weight)
    own = F.sum("__tokens").over(Window.partitionBy("__source", "__bucket").orderBy("__key", "__doc", "__tokens").rowsBetween(Window.unboundedPreceding, 0))
    return keyed.withColumn("__bucket", _bucket(buckets)).join(before, ["__source", "__bucket"]).withColumn("__finish", (F.col("__before") + own).cast("double") / weight)


def _plan(docs: DataFrame, weights: dict[str, float], budget_share: float, budget_tokens: int | None, seed: int, other: float) -> tuple[DataFrame, DataFrame, int]:
    """(selected light rows with __cum, sums before each bucket, number of buckets)."""
    light = cut(_keyed(docs.select("doc_id", "source", "text"), seed, tokens()).select("__doc", "__source", "__tokens", "__key"))
    rows, total = light.agg(F.count("*"), F.coalesce(F.sum("__tokens"), F.lit(0))).first()
    buckets = max(1, math.ceil(rows / ROWS))
    sums = light.groupBy("__source", _bucket(buckets).alias("__bucket")).agg(F.sum("__tokens").alias("__sum"))
    before = cut(sums.select("__source", "__bucket", (F.sum("__sum").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("__sum")).alias("__before")))
    timed = _finish(light, before, buckets, weights, other)
    ranged = cut(timed.select(*ORDER).repartitionByRange(buckets, *ORDER).sortWithinPartitions(*ORDER).withColumn("__range", F.spark_partition_id()))
    ranges = ranged.groupBy("__range").agg(F.sum("__tokens").alias("__sum"))
    ranges = ranges.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__first"))
    cum = F.col("__first") + F.sum("__tokens").over(Window.partitionBy("__range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    budget = math.floor(total * budget_share) if budget_tokens is None else budget_tokens
    return ranged.join(ranges, "__range").withColumn("__cum", cum).where(F.col("__cum") <= budget), before, buckets


def mix_sources(docs: DataFrame, weights: dict[str, float], budget_share: float = 1.0, budget_tokens: int | None = None, seed: int = 7, other: float = 1.0) -> DataFrame:
    """(doc_id, source, n_tokens, finish, cum_tokens) of the selected documents in order of finish time; cum_tokens is the
    total up to and with each. The budget is ``budget_tokens``, or else ``budget_share`` of all tokens, rounded down."""
    chosen, _, _ = _plan(docs, weights, budget_share, budget_tokens, seed, other)
    return chosen.orderBy(*ORDER).select(F.col("__doc").alias("doc_id"), F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__finish").alias("finish"), F.col("__cum").alias("cum_tokens"))


def mix_documents(docs: DataFrame, weights: dict[str, float], budget_share: float = 1.0, budget_tokens: int | None = None, seed: int = 7, other: float = 1.0) -> DataFrame:
    """The selected documents themselves, with the columns of ``docs``, in order of finish time."""
    chosen, before, buckets = _plan(docs, weights, budget_share, budget_tokens, seed, other)
    last = chosen.agg(F.max(F.struct(*ORDER))).first()[0]
    if last is None:
        return docs.limit(0)
    whole = docs.select(packed_row(docs), "doc_id", "source", "text")
    timed = _finish(_keyed(whole, seed, tokens()), before, buckets, weights, other)
    bound = F.struct(*(F.lit(last[k]).cast(t).alias(k) for k, t in zip(ORDER, ("double", "string", "string", "long", "long"))))
    return timed.where(F.struct(*ORDER) <= bound).orderBy(*ORDER).select("__row.*")


def mixing_sql(weights: dict[str, float], budget_share: float, seed: int, other: float) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in weights.items())
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+'))::BIGINT AS n_tokens, md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
        f AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING)::DOUBLE / CASE source {cases} ELSE {float(other)!r}::DOUBLE END AS finish FROM t),
        c AS (SELECT *, (sum(n_tokens) OVER (ORDER BY finish, source, k, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING))::BIGINT AS cum_tokens FROM f)
        SELECT doc_id, source, n_tokens, finish, cum_tokens FROM c WHERE cum_tokens <= (SELECT floor(sum(n_tokens)::DOUBLE * {budget_share!r}::DOUBLE) FROM t)"""
