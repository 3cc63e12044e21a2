"""Running values over a whole table in the order of one column, without sending the
table to one task.

The order column is cut into ranges at values picked from a bounded sample (which
affects balance only). Windows run within a range; what a range adds to those behind it
is one row each, summed up and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def with_range(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """df with _range: 0 for the lowest values and nulls, ascending."""
    sample = df.select(F.col(order).alias("v")).filter("v is not null").distinct().orderBy(F.xxhash64("v"), "v").limit(ranges * 50).collect()
    values = sorted(r.v for r in sample)
    bounds = values[len(values) // ranges :: max(1, len(values) // ranges)][: ranges - 1]
    if not bounds:
        return df.withColumn("_range", F.lit(0))
    kind = df.schema[order].dataType

    def place(low: int, high: int) -> Column:
        """How many bounds are at most the value, by halving."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(order) < F.lit(bounds[mid]).cast(kind), place(low, mid)).otherwise(place(mid + 1, high))

    return df.withColumn("_range", F.when(F.col(order).isNull(), 0).otherwise(place(0, len(bounds))))


def running_sum(df: DataFrame, order: str, weight: Column, name: str, *ties: str) -> DataFrame:
    """df with the sum of weight over the rows before each in the order of `order`, then of
    `ties`; together they must be unique."""
    d = with_range(df, order).withColumn("_w", weight)
    sums = d.groupBy("_range").agg(F.sum("_w").alias("_s"))
    above = sums.select("_range", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))  # RANGES rows
    own = F.coalesce(F.sum("_w").over(Window.partitionBy("_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn(name, own).join(F.broadcast(above), "_range").withColumn(name, F.col(name) + F.col("_above")).drop("_range", "_w", "_above")


def carried(df: DataFrame, columns: list[str], order: str, forward: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Nulls of these columns take the last (forward) or next value in order, within keys if
    given. Where rows tie in order, which of them comes first is open: give a unique order."""
    # backward is forward in reversed order: Spark computes a frame that ends unbounded anew for each row
    at = F.asc_nulls_first(order) if forward else F.desc_nulls_last(order)
    frame = lambda w: w.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    if keys:
        w = frame(Window.partitionBy(*keys))
        return df.withColumns({c: F.last(c, True).over(w) for c in columns})
    d = with_range(df, order)
    w = frame(Window.partitionBy("_range"))
    last = F.max_by if forward else F.min_by
    ends = d.groupBy("_range").agg(*[last(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{i}") for i, c in enumerate(columns)])
    out = Window.orderBy("_range" if forward else F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = ends.select("_range", *[F.last(f"_{i}", True).over(out).alias(f"_b{i}") for i in range(len(columns))])  # RANGES rows
    filled = d.withColumns({c: F.last(c, True).over(w) for c in columns}).join(F.broadcast(beyond), "_range")
    return filled.select(*[F.coalesce(c, f"_b{columns.index(c)}").alias(c) if c in columns else F.col(c) for c in df.columns])
