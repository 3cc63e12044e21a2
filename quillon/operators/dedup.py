"""Duplicates: exact ones by key, and similar texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import ref


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """All rows of groups with several members. Null equals null."""
    keys = [ref(c) for c in subset or df.columns]
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def duplicate_summary(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """total, duplicate_rows (all members), surplus_rows (all but one of each group), groups; by
    counts alone, so a hot key costs one row for each task."""
    g = df.groupBy(*[ref(c) for c in subset or df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    return g.agg(F.coalesce(F.sum("_n"), zero).alias("total"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), zero).alias("duplicate_rows"), F.coalesce(F.sum(F.col("_n") - 1), zero).alias("surplus_rows"), F.count_if(F.col("_n") > 1).alias("groups"))


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | None = "first", order_by: list[str] | None = None) -> DataFrame:
    """keep first or last in order_by, or None: no row of a group with several. The rows
    kept come from a partial aggregate (max_by of the row), not from sorting each group."""
    keys = subset or df.columns
    if keep is None:
        n = df.groupBy(*[ref(c) for c in keys]).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*map(ref, df.columns))).alias("_r"))
        return n.filter("_n = 1").select("_r.*")
    if keep not in ("first", "last"):
        raise ValueError("keep is first, last or None")
    if not order_by:
        return df.dropDuplicates(keys)
    best = (F.min_by if keep == "first" else F.max_by)(F.struct(*map(ref, df.columns)), F.struct(*map(ref, order_by)))
    return df.groupBy(*[ref(c).alias(f"_k{i}") for i, c in enumerate(keys)]).agg(best.alias("_r")).select("_r.*")


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of lengths (bit-parallel)."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return 2 * (len(a) - bin(state).count("1")) / (len(a) + len(b))


def similar_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of distinct texts (column v) with ratio >= threshold.

    Texts of n and m characters that are so similar differ in at most (1-threshold)(n+m)
    insertions and deletions, each of which destroys at most two bigrams. So they share
    one of their rarest bigrams (prefix filter), on which they are joined; texts too short
    for that are joined by the lengths that can match.
    """
    import pandas as pd

    t = threshold
    d = values.select("v", F.length("v").cast("long").alias("n"))
    gram = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), (F.col("n") - 1).cast("int")), lambda i: F.col("v").substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = F.flatten(F.transform(F.array_distinct(gram), lambda g: F.transform(F.sequence(F.lit(1), F.size(F.filter(gram, lambda x: x == g))), lambda k: F.concat(g, k.cast("string")))))
    # of a text of n characters, a partner has at most n(2-t)/t characters
    lost = F.floor((1 - t) * 2 * F.col("n") / t + 1e-9).cast("int")
    d = d.withColumn("lost", lost * 2)
    cells = d.filter(F.col("n") - 1 > F.col("lost")).select("v", "n", "lost", F.explode(numbered).alias("g"))
    seen = cells.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("f", "g"))
    by_gram = cells.join(seen, "g").withColumn("p", place).filter(F.col("p") <= F.col("lost") + 1).select("v", "n", F.col("g").alias("k"))
    short = d.filter(F.col("n") - 1 <= F.col("lost"))
    reach = lambda n: F.sequence(F.ceil(n * t / (2 - t) - 1e-9).cast("int"), F.floor(n * (2 - t) / t + 1e-9).cast("int"))
    left = short.select("v", "n", F.explode(F.transform(reach(F.col("n")), lambda x: x.cast("string"))).alias("k"))
    sized = d.select("v", "n", F.col("n").cast("string").alias("k"))
    o = lambda x: x.toDF("b", "m", "k")
    pairs = by_gram.join(o(by_gram), "k").filter("v < b").select("v", "b", "n", "m").unionByName(left.join(o(sized), "k").filter("v <> b").select(F.least("v", "b").alias("v"), F.greatest("v", "b").alias("b"), "n", "m")).distinct()
    pairs = pairs.filter(2 * F.least("n", "m") >= t * (F.col("n") + F.col("m")) - 1e-9)

    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) >= t - 1e-12 for x, y in zip(a, b, strict=True)], dtype=bool)

    same.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return pairs.filter(F.pandas_udf(same, "boolean")("v", "b")).select(F.col("v").alias("a"), "b")


def fuzzy_duplicates(df: DataFrame, column: str, threshold: float = 0.85, keep: str = "first", order_by: str | None = None) -> DataFrame:
    """df without rows whose text is as similar as threshold to that of an earlier (keep
    first) or later (last) row which itself stays. Nulls stay; equal texts count as similar.

    Each round keeps the texts whose similar earlier ones are all dropped, and drops those
    similar to a kept one, until all are decided.
    """
    order = F.col(order_by) if order_by else F.monotonically_increasing_id()
    sign = 1 if keep == "first" else -1
    d = df.withColumn("_o", order).cache() if not order_by else df.withColumn("_o", order)
    first = d.filter(ref(column).isNotNull()).groupBy(ref(column).alias("v")).agg((F.min if sign > 0 else F.max)("_o").alias("o")).checkpoint()
    edges = similar_pairs(first, threshold)
    oa, ob = first.toDF("a", "oa"), first.toDF("b", "ob")
    j = edges.join(oa, "a").join(ob, "b")
    earlier = F.col("oa") < F.col("ob") if sign > 0 else F.col("oa") > F.col("ob")
    j = j.select(F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("late")).checkpoint()
    dropped = None
    while not j.isEmpty():
        waiting = j.select("late").distinct()
        fixed = j.join(waiting.toDF("early"), "early", "left_anti")  # these earlier texts stay
        gone = fixed.select(F.col("late").alias("v")).distinct().checkpoint()
        dropped = gone if dropped is None else dropped.unionByName(gone)
        j = j.join(gone.toDF("late"), "late", "left_anti").join(gone.toDF("early"), "early", "left_anti").checkpoint()
    out = d.join(first.toDF("_v", "_f"), ref(column) == F.col("_v"), "left")
    out = out.filter(F.col("_v").isNull() | (F.col("_o") == F.col("_f")))
    if dropped is not None:
        out = out.join(dropped.toDF("_g"), F.col("_v") == F.col("_g"), "left_anti")
    return out.select(*[ref(c) for c in df.columns])
