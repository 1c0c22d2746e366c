"""The corpus pipeline: documents of good quality, one of each group of near duplicates, without secrets, mixed to target weights, packed into windows.

Each stage takes documents (doc_id, text, source and any other columns, whatever their names) and, but for the last, returns
such. Texts are whole in every stage, however long, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiva.llm.common import cut, table
from motiva.llm.mixing import mix_documents
from motiva.llm.ngram_jaccard import connected, ngram_jaccard_join
from motiva.llm.packing import pack
from motiva.llm.quality import keep_good
from motiva.llm.secrets import redact_secrets
from motiva.session import ship

#: Target weights of sources; all others have OTHER. BUDGET is the share of the tokens at hand that the mixture may hold.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}
OTHER = 1.0
BUDGET = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the table ``labels``, keeps.

    Rows without any word (null, empty or blank text) go; a null doc_id is judged like any; of repeated rows each is judged.
    """
    return keep_good(docs, table(ship(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near duplicates connect, the document with the smallest doc_id stays, and of texts that share a doc_id
    the one with the least SHA-1, once.

    A row with a null doc_id, or without any word, is no duplicate and stays; different texts of one doc_id are documents
    of their own; of rows equal in both one stays.
    """
    ship(spark)
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    own, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    shared = cut(plain.where(f"{own} is not null").groupBy(own).count().where("count > 1").select(own))
    if shared.isEmpty():
        keyed = plain.withColumn("key", F.col(own).cast("long"))
    else:
        keyed = cut(plain.withColumn("key", F.when(F.col(own).isNotNull(), F.monotonically_increasing_id())))
    groups = connected(ngram_jaccard_join(keyed.select(F.col("key").alias("doc_id"), F.col(text).alias("text")), forest=True))
    if shared.isEmpty():
        drop = groups.where("doc_id <> `group`").select(F.col("doc_id").alias("key"))
    else:
        order = F.struct(own, F.sha1(F.col(text)), "key")
        least = keyed.join(groups.select(F.col("doc_id").alias("key"), "group"), "key").groupBy("group").agg(F.min(order).alias("least"))
        drop = groups.join(least.select("group", F.col("least.key").alias("stays")), "group").where("doc_id <> stays").select(F.col("doc_id").alias("key"))
    return keyed.join(drop, "key", "left_anti").select(*plain.columns).toDF(*names)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the names of their rules; a null text stays null, repeated rows stay repeated."""
    ship(spark)
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that come first by virtual finish time, up to BUDGET of all tokens.

    A null source is the source ''; a null or blank text has no token and comes at its source's time; ties are ordered by
    source, hash of doc_id, doc_id and tokens; repeated rows each take their part.
    """
    ship(spark)
    return mix_documents(docs, WEIGHTS, budget_share=BUDGET, other=OTHER)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of the documents' tokens. A null or blank text is in none, a null doc_id stays null, repeated rows are packed each."""
    ship(spark)
    return pack(docs)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("secret scans", secrets), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither a fitted classifier nor online packing; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
