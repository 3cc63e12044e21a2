"""Outliers by quartiles, by standard deviations, and by isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import moments, numeric_columns, present, ref, tidy
from .quantiles import quantiles


def bounds(df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: list[str] | None = None) -> DataFrame:
    """column_name, low, high: values outside are outliers. A column without spread has none."""
    if method == "iqr":
        q = quantiles(df, {c: [0.25, 0.75] for c in numeric_columns(df, columns)})
        p = df.sparkSession.createDataFrame([(c, *v) for c, v in q.items()], "column_name string, q25 double, q75 double")
        spread = F.col("q75") - F.col("q25")
        return p.select("column_name", (F.col("q25") - threshold * spread).alias("low"), (F.col("q75") + threshold * spread).alias("high"))
    if method == "zscore":
        spread = F.nullif("std", F.lit(0.0))
        return moments(df, columns).select("column_name", (F.col("mean") - threshold * spread).alias("low"), (F.col("mean") + threshold * spread).alias("high"))
    raise ValueError("method is iqr or zscore")


def _bounds(df: DataFrame, method: str, threshold: float, columns: list[str] | None) -> dict:
    return {r.column_name: (r.low, r.high) for r in bounds(df, method, threshold, columns).collect()}  # a row for each column


def outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: list[str] | None = None) -> DataFrame:
    """column_name, outlier_count, outlier_pct (of values), of columns with outliers."""
    out = {}
    for c, (low, high) in _bounds(df, method, threshold, columns).items():
        x = present(df, c)
        n = F.count_if((x < low) | (x > high)) if low is not None and high is not None else F.lit(0).cast("long")
        out[c] = {"outlier_count": n, "outlier_pct": F.when(F.count(x) > 0, n * 100.0 / F.count(x)).otherwise(0.0)}
    return tidy(df, out).filter("outlier_count > 0")


def outlier_rows(df: DataFrame, column: str, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    (low, high), x = _bounds(df, method, threshold, [column])[column], present(df, column)
    return df.filter((x < low) | (x > high)) if low is not None and high is not None else df.limit(0)


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1 or x.min() == x.max():
        return (len(x),)
    cut = rng.uniform(x.min(), x.max())
    return cut, _tree(x[x < cut], rng, depth - 1), _tree(x[x >= cut], rng, depth - 1)


def _mean_depth(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _depth(tree: tuple, x: np.ndarray, at: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), at + _mean_depth(tree[0]))
    out, left = np.empty(len(x)), x < tree[0]
    out[left], out[~left] = _depth(tree[1], x[left], at + 1), _depth(tree[2], x[~left], at + 1)
    return out


def isolation_scores(df: DataFrame, column: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """df with isolation_score (null for missing values): nearer 1 is more isolated. Trees
    grow on bounded samples (trees x sample values); all rows are scored."""
    value = present(df, column)
    # by a hash of the whole row, so that values come as often as they are; a table of one
    # column has no more to tell equal values apart than their places
    row = [ref(c) for c in df.columns] if len(df.columns) > 1 else [value, F.monotonically_increasing_id()]
    drawn = df.select(value.alias("v"), F.xxhash64(*row, F.lit(seed)).alias("h")).filter("v is not null")
    rows = drawn.orderBy("h", "v").limit(trees * sample).collect()
    pool, rng = np.array([r.v for r in rows]), np.random.Generator(np.random.PCG64(seed))
    if not len(pool):
        return df.withColumn("isolation_score", F.lit(None).cast("double"))
    size = min(sample, len(pool))
    forest = [_tree(rng.choice(pool, size, replace=False), rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)]
    shared, norm = df.sparkSession.sparkContext.broadcast(forest), _mean_depth(size) or 1.0
    import pandas as pd

    def score(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            x = v.to_numpy(dtype=float, na_value=np.nan)
            s = 2 ** (-np.mean([_depth(t, x) for t in shared.value], axis=0) / norm)
            yield pd.Series(np.where(np.isnan(x), np.nan, s)).astype(object).where(~np.isnan(x), None)

    score.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("isolation_score", F.pandas_udf(score, "double")(value))


def isolation_outliers(df: DataFrame, column: str, contamination: float = 0.1, **how) -> DataFrame:
    """The rows whose score lies above the (1 - contamination) quantile."""
    scored = isolation_scores(df, column, **how)
    kept = scored.select("isolation_score").persist()
    limit = quantiles(kept, {"isolation_score": [1 - contamination]})["isolation_score"][0]
    kept.unpersist()
    return scored.filter(F.col("isolation_score") > limit) if limit is not None else scored.limit(0)


