"""Connected components by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (a, b).

    Kiveris et al.: alternately link each node's larger neighbours, then its smaller
    ones and itself, to the least of them, until nothing changes. Edges never grow in
    number, a hub costs one aggregation, and each round is written out and the one before deleted.
    """
    now = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large, name)
        release(now)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").filter("b <> m").toDF("a", "b").unionByName(low.toDF("a", "b")).distinct()
        now = cut(small, name)
        release(large)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select("b", "b").distinct().toDF("node", "root"))
