"""The data of plots, reduced by aggregates; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .correlate import matrix, pearson, target_correlation
from .profile import missing_values, present, ref, top_values
from .quantiles import quantiles

__all__ = ["box", "compare", "heatmap", "histogram", "missing_bars", "scatter", "target_bars", "time_series", "trend", "value_bars"]


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 0), n, of bins of equal width; empty ones are left out."""
    x = present(df, column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (high - low) / bins or 1.0
    place = F.least(F.lit(bins - 1), F.floor((x - low) / F.lit(width))).cast("int")
    return df.filter(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box(df: DataFrame, column: str) -> DataFrame:
    """q25, median, q75, the whiskers (furthest values within 1.5 spreads), outliers."""
    x = present(df, column)
    a, m, b = (F.lit(v).cast("double") for v in quantiles(df, {column: [0.25, 0.5, 0.75]})[column])
    low, high = a - 1.5 * (b - a), b + 1.5 * (b - a)
    return df.agg(F.any_value(a).alias("q25"), F.any_value(m).alias("median"), F.any_value(b).alias("q75"), F.min(F.when(x >= low, x)).alias("low_whisker"), F.max(F.when(x <= high, x)).alias("high_whisker"), F.count_if((x < low) | (x > high)).alias("outliers"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = present(df, x), present(df, y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), pearson(a, b).alias("r"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n"))


def scatter(df: DataFrame, x: str, y: str, points: int = 1000, seed: int = 42) -> DataFrame:
    """The points with the smallest hashes, as many as a picture can show."""
    d = df.select(present(df, x).alias("x"), present(df, y).alias("y")).filter("x is not null and y is not null")
    return d.orderBy(F.xxhash64("x", "y", F.lit(seed)), "x", "y").limit(points)


def time_series(df: DataFrame, at: str, column: str, unit: str = "day") -> DataFrame:
    return df.groupBy(F.date_trunc(unit, ref(at)).cast("timestamp_ntz").alias("at")).agg(F.avg(present(df, column)).alias("mean"), F.count(present(df, column)).alias("n"))


def compare(df: DataFrame, column: str, by: str) -> DataFrame:
    """n, mean and quartiles for each group."""
    x = present(df, column)
    return df.groupBy(ref(by)).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("quartiles"))


def heatmap(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    return matrix(df, columns, method)


def missing_bars(df: DataFrame) -> DataFrame:
    return missing_values(df).filter("null_count > 0").orderBy(F.desc("null_count"), "column_name")


def value_bars(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return top_values(df, [column], k)


def target_bars(df: DataFrame, target: str, top_n: int = 15) -> DataFrame:
    return target_correlation(df, target, top_n=top_n)
