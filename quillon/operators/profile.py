"""Column and table profiles.

All numbers of a profile but exact quantiles come from two jobs whatever the number of
columns: one aggregate over all columns, and one table of value counts (column, value, n), which an
exchange on (column, value) makes after partial aggregation. Distinct counts come from
the latter, as many distinct aggregates in one job would copy each row for each column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: By so many parts distinct_sets sees whether values are spread evenly.
BUCKETS = 64
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame, kinds: tuple, columns: list[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and (columns is None or f.name in columns)]


def numeric_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return columns_of(df, NUMERIC, columns)


def text_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return columns_of(df, (T.StringType,), columns)


def missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number."""
    c = ref(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, T.FloatType | T.DoubleType) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value as a double, null where it is missing."""
    return F.when(~missing(df, name), ref(name).cast("double"))


def tidy(df: DataFrame, aggregates: dict[str, dict[str, Column]]) -> DataFrame:
    """One row for each key of aggregates (column_name) and its measures, by one aggregate of df."""
    if not aggregates:
        return df.sparkSession.createDataFrame([], "column_name string")
    names = list(next(iter(aggregates.values())))
    flat = df.agg(*[F.struct(F.lit(c).alias("column_name"), *[m[n].alias(n) for n in names]).alias(f"_{i}") for i, (c, m) in enumerate(aggregates.items())])
    return flat.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(aggregates))])))


def skewness(x: Column) -> Column:
    """Of a sample, corrected for bias; null for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Excess, corrected for bias; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.coalesce(F.kurtosis(x), F.lit(0.0)) + 6))


def numeric_profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """column_name, count, null_count, null_pct, mean, std, min, q25, median, q75, max,
    skewness, kurtosis of each numeric column. Exact quantiles are found at once, in a few
    passes; exact=False takes approximate ones, in the same aggregate as the rest."""
    from .quantiles import quantiles

    rows = F.count(F.lit(1))
    out = {}
    found = quantiles(df, {c: [0.25, 0.5, 0.75] for c in numeric_columns(df, columns)}) if exact else {}
    for c in numeric_columns(df, columns):
        x = present(df, c)
        q = [F.lit(v).cast("double") for v in found[c]] if exact else F.percentile_approx(x, [0.25, 0.5, 0.75], 10000)
        out[c] = {
            "count": F.count(x), "null_count": rows - F.count(x), "null_pct": F.when(rows > 0, (rows - F.count(x)) * 100.0 / rows).otherwise(0.0),
            "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "q25": q[0], "median": q[1], "q75": q[2], "max": F.max(x),
            "skewness": skewness(x), "kurtosis": kurtosis(x),
        }
    return tidy(df, out)


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, count, mean, std, skewness, kurtosis: one pass without quantiles."""
    made = {c: present(df, c) for c in numeric_columns(df, columns)}
    return tidy(df, {c: {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "skewness": skewness(x), "kurtosis": kurtosis(x)} for c, x in made.items()})


def boolean_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    out = {}
    for c in columns_of(df, (T.BooleanType,), columns):
        n, yes = F.count(ref(c)), F.count_if(ref(c))
        out[c] = {"true_count": yes, "false_count": n - yes, "true_pct": F.when(n > 0, yes * 100.0 / n).otherwise(0.0)}
    return tidy(df, out)


def datetime_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    out = {}
    for c in columns_of(df, TEMPORAL, columns):
        low, high = F.min(ref(c)).cast("timestamp_ntz"), F.max(ref(c)).cast("timestamp_ntz")
        out[c] = {"min": low, "max": high, "range_days": F.floor((F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))) / 86_400_000_000)}
    return tidy(df, out)


def text_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, count, avg_length, min_length, max_length, mode (least of equal ones), mode_count."""
    cols = text_columns(df, columns)
    out = {c: {"count": F.count(ref(c)), "avg_length": F.avg(F.length(ref(c))), "min_length": F.min(F.length(ref(c))), "max_length": F.max(F.length(ref(c)))} for c in cols}
    counts = value_counts(df, cols)
    most = counts.groupBy("column_name").agg(F.max("n").alias("mode_count"))
    best = counts.join(F.broadcast(most), "column_name").filter("n = mode_count")
    mode = best.groupBy("column_name", "mode_count").agg(F.min("value").alias("mode"))
    return tidy(df, out).join(F.broadcast(mode), "column_name", "left").select("column_name", "count", "avg_length", "min_length", "max_length", "mode", "mode_count")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (as text), n, of values that aren't missing."""
    cols = columns or df.columns
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(~missing(df, c), _text(df, c)).alias("value")) for c in cols])
    return df.select(F.inline(cells)).filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def _text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return F.to_json(F.struct(ref(name))) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else F.hex(ref(name)) if isinstance(kind, T.BinaryType) else ref(name).cast("string")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """column_name, value, n, place of the k most frequent values, ties by value."""
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """column_name, unique_count."""
    cols = columns or df.columns
    if approximate:
        return tidy(df, {c: {"unique_count": F.approx_count_distinct(F.when(~missing(df, c), _text(df, c)))} for c in cols})
    n = distinct_sets(df, [(c,) for c in cols]).select(F.element_at(F.array(*map(F.lit, cols)), F.col("i") + 1).alias("column_name"), F.col("n").alias("unique_count"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return every.join(F.broadcast(n), "column_name", "left").na.fill(0, ["unique_count"])


def _typed(df: DataFrame, name: str) -> tuple[str, Column]:
    """The type in which values are compared, and the value in it; whole numbers share one."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return "bigint", ref(name).cast("bigint")
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "double", ref(name).cast("double")
    if isinstance(kind, T.DecimalType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType) or kind == T.StringType():
        return kind.simpleString(), ref(name)
    return "text", _text(df, name)


def distinct_sets(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """i, n: of each set of columns (by its place) with rows that lack none of them, how many
    differ. Values keep their types, as they are smaller and quicker to compare than texts;
    sets of the same types go through one exchange."""
    cells, alike = [], {}
    for i, cols in enumerate(sets):
        typed = sorted((_typed(df, c) for c in cols), key=lambda t: t[0])
        there = ~missing(df, cols[0])
        for c in cols[1:]:
            there = there & ~missing(df, c)
        values = [v for _, v in typed]
        cells.append(F.when(there, F.struct(F.lit(i).alias("i"), F.xxhash64(*values).alias("h"))))
        alike.setdefault(tuple(t for t, _ in typed), []).append((i, F.when(there, F.struct(F.lit(i).alias("i"), *[v.alias(f"v{k}") for k, v in enumerate(values)]))))
    # where most values differ, maps of them before the exchange save nothing and spill; where few
    # do, or one comes often, they keep its rows from going to one task
    sizes: dict[int, list] = {}
    for r in df.select(F.inline(F.array(*cells))).filter("i is not null").groupBy("i", F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("u")).collect():
        sizes.setdefault(r.i, []).append((r.n, r.u))
    total = {i: sum(n for n, _ in own) for i, own in sizes.items()}
    even = {i for i, own in sizes.items() if sum(u for _, u in own) > total[i] / 2 and max(n for n, _ in own) < 2 * total[i] / BUCKETS}
    out = None
    for kinds, own in alike.items():
        for direct in (True, False):
            some = [c for i, c in own if (i in even) == direct]
            if not some:
                continue
            rows = df.select(F.inline(F.array(*some))).filter("i is not null")
            rows = rows.repartition("i", *[f"v{k}" for k in range(len(kinds))]) if direct else rows
            n = rows.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
            out = n if out is None else out.unionByName(n)
    return out


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, null_count, null_pct, mostly_missing (over half), complete."""
    rows = F.count(F.lit(1))
    out = {}
    for c in columns or df.columns:
        n = F.count_if(missing(df, c))
        out[c] = {"null_count": n, "null_pct": F.when(rows > 0, n * 100.0 / rows).otherwise(0.0), "mostly_missing": F.coalesce(n * 2 > rows, F.lit(False)), "complete": n == 0}
    return tidy(df, out)


def column_stats(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """column_name, dtype, total, null_count, null_pct, unique_count, unique_pct."""
    cols = columns or df.columns
    rows = F.count(F.lit(1))
    base = tidy(df, {c: {"total": rows, "null_count": F.count_if(missing(df, c))} for c in cols})
    kinds = df.sparkSession.createDataFrame([(c, dict(df.dtypes)[c]) for c in cols], "column_name string, dtype string")
    j = base.join(F.broadcast(distinct_counts(df, cols, approximate)), "column_name").join(F.broadcast(kinds), "column_name")
    pct = lambda n: F.when(F.col("total") > 0, F.col(n) * 100.0 / F.col("total")).otherwise(0.0)
    return j.select("column_name", "dtype", "total", "null_count", pct("null_count").alias("null_pct"), "unique_count", pct("unique_count").alias("unique_pct"))


def summary_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column_stats with the numbers of numeric columns beside them."""
    return column_stats(df, None, approximate).join(F.broadcast(numeric_profile(df).drop("null_count", "null_pct")), "column_name", "left")


def cardinality(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """column_stats and a level: high (over 95 % distinct), medium (over 5 %) or low."""
    level = F.when(F.col("unique_pct") > 95, "high").when(F.col("unique_pct") > 5, "medium").otherwise("low")
    return column_stats(df, columns, approximate).select("column_name", "unique_count", "unique_pct", level.alias("level"))


def distributions(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, skewness, kurtosis, shape, of columns with three values or more."""
    p = moments(df, columns).filter("count >= 3")
    s, k = F.col("skewness"), F.coalesce("kurtosis", F.lit(0.0))
    shape = F.when((F.abs(s) < 0.5) & (F.abs(k) < 3), "normal").when(s > 1, "right-skewed").when(s < -1, "left-skewed").when(k > 3, "heavy-tailed").when(k < -1, "light-tailed").otherwise("other")
    return p.select("column_name", "count", "skewness", "kurtosis", shape.alias("shape"))


def type_histogram(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for _, kind in df.dtypes:
        out[kind] = out.get(kind, 0) + 1
    return out
