"""Exact deduplication (skew-safe combining)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, table

SALTS = 16
HOT = 1000


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def groups_of_equal_texts(docs: DataFrame, digest: Callable[[Column], Column] = _digest, salts: int = SALTS) -> DataFrame:
    """digest, keep_id, group_size of each distinct text of documents(docs), and the text
    where others share its digest.

    Three stages, each of which groups by the content beside its digest: the partial
    aggregate within a task, then (digest, salt), then digest. A text that a third of
    all rows holds is one row for each task and salt after the first of them.
    """
    d = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    salted = d.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    whole = salted.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    texts = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return whole.withColumn("texts", texts).select("digest", "keep_id", "group_size", F.when(F.col("texts") > 1, F.col("text")).alias("text"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = _digest, salts: int = SALTS) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row
    with the largest id stays.

    A null text counts as an empty one. A null id is below all others; a group of null
    ids only has a null keep_id and keeps one row. Of rows repeated with the same id and
    text, one is kept; group_size counts them all. An empty table gives no rows; further
    columns are ignored.
    """
    docs = documents(df, id_col, text_col)
    groups = cut(groups_of_equal_texts(docs, digest, salts), "op5-groups")
    d = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"))
    # groups with over 1/HOT of all rows, of which there are HOT at most, go to every task;
    # the rest, without a hot key, is joined by digest
    alone = groups.filter(F.col("text").isNull()).drop("text")
    much = (groups.agg(F.sum("group_size")).first()[0] or 0) / HOT
    hot = F.broadcast(alone.filter(F.col("group_size") > much))
    rare = d.join(hot, "digest", "left_anti").join(alone.filter(F.col("group_size") <= much), "digest")
    out = d.join(hot, "digest").unionByName(rare)
    if not groups.filter(F.col("text").isNotNull()).isEmpty():  # texts that differ under one digest
        t = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.sha2("text", 256).alias("text_sha256"), "text")
        out = out.unionByName(t.join(groups.filter(F.col("text").isNotNull()), ["digest", "text"]).select(out.columns))
    same = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(0)))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (same == 1)).alias("kept"), "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
WINDOW w AS (PARTITION BY text)
"""
