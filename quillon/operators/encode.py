"""Categories as numbers or flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import running_sum
from .profile import ref, value_counts

#: One-hot encoding makes so many columns for one at most.
MOST_CATEGORIES = 5000


def categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list:
    got = [r[0] for r in df.select(ref(column)).filter(ref(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has over {most} categories")
    return sorted(got)


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = False, prefix: str | None = None, drop_original: bool = True) -> DataFrame:
    """A boolean column {column}_{value} for each value in sorted order; all false for a null."""
    flags = []
    for c in columns:
        for v in categories(df, c)[int(drop_first) :]:
            flags.append(F.coalesce(ref(c) == F.lit(v), F.lit(False)).alias(f"{prefix or c}_{v}"))
    kept = [ref(c) for c in df.columns if not (drop_original and c in columns)]
    return df.select(*kept, *flags)


def label_codes(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """value, code: from 0 in the order of first appearance; values that first appear together, by value."""
    first = df.filter(ref(column).isNotNull()).groupBy(ref(column).alias("value")).agg(F.min(ref(order_by)).alias("_o"))
    return running_sum(first, "_o", F.lit(1).cast("long"), "code", "value").select("value", "code")


def label_encode(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """These columns as codes by first appearance in order_by; nulls stay null."""
    out = df
    for c in columns:
        codes = label_codes(df, c, order_by).toDF("_v", "_c")
        out = out.join(codes, ref(c) == F.col("_v"), "left").select(*[F.col("_c").alias(c) if x == c else ref(x) for x in df.columns])
    return out


def ordinal_encode(df: DataFrame, column: str, ordering: list) -> DataFrame:
    """The place in ordering, from 0; other values become null."""
    codes = F.create_map(*[x for i, v in enumerate(ordering) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(column, codes[ref(column)])


def auto_columns(df: DataFrame, exclude: list[str] | None = None, max_categories: int = 10, min_frequency: float = 0.01) -> list[str]:
    """Text, boolean-free and number columns with 2 to max_categories values, not all of them rare."""
    cols = [f.name for f in df.schema if f.name not in (exclude or []) and isinstance(f.dataType, T.StringType | T.NumericType | T.BooleanType)]
    if not cols:
        return []
    n = df.count()
    s = value_counts(df, cols).groupBy("column_name").agg(F.count(F.lit(1)).alias("u"), F.max("n").alias("m")).collect()  # a row for each column
    fit = {r.column_name for r in s if 2 <= r.u <= max_categories and r.m >= min_frequency * n}
    return [c for c in cols if c in fit]


def auto_encode(df: DataFrame, exclude: list[str] | None = None, max_categories: int = 10, min_frequency: float = 0.01, drop_first: bool = False, drop_original: bool = True) -> DataFrame:
    return one_hot(df, auto_columns(df, exclude, max_categories, min_frequency), drop_first, None, drop_original)
