"""Correlations: Pearson, Spearman, Kendall's tau-b, and with a target."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import running_sum
from .profile import numeric_columns, present, ref

#: Kendall sorts the distinct pairs of values on the driver, so many at most (24 bytes each).
MOST_PAIRS = 5_000_000


def _complete(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(present(df, a).alias("a"), present(df, b).alias("b")).filter("a is not null and b is not null")


def spearman(df: DataFrame, a: str, b: str) -> float | None:
    """Pearson of average ranks over the rows that have both values. Ranks come from the
    table of distinct values, not from sorting rows."""
    rows = _complete(df, a, b)
    pairs = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs
    for c in ("a", "b"):
        counts = pairs.groupBy(c).agg(F.sum("n").alias("m"))
        rank = running_sum(counts, c, F.col("m"), "before").select(c, (F.col("before") + (F.col("m") + 1) / 2).alias(f"r{c}"))
        ranked = ranked.join(rank, c)
    n = F.sum("n")
    x, y, w = F.col("ra"), F.col("rb"), F.col("n")
    r = ranked.agg(n.alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy")).first()
    if not r.n:
        return None
    spread = (r.n * r.xx - r.x**2) * (r.n * r.yy - r.y**2)
    return (r.n * r.xy - r.x * r.y) / spread**0.5 if spread > 0 else None


def kendall(df: DataFrame, a: str, b: str, most_pairs: int = MOST_PAIRS) -> float | None:
    """tau-b by counting inversions of the distinct pairs; more than most_pairs raise an error."""
    pairs = _complete(df, a, b).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    got = pairs.limit(most_pairs + 1).toPandas()
    if len(got) > most_pairs:
        raise ValueError(f"over {most_pairs} distinct pairs: round the values first")
    if not len(got):
        return None
    got = got.sort_values(["a", "b"])
    x, y, n = (got[c].to_numpy() for c in ("a", "b", "n"))
    total = int(n.sum())
    tied = lambda k: sum(int(m) * (int(m) - 1) // 2 for m in np.bincount(np.unique(k, return_inverse=True)[1], n).astype(np.int64))
    all_pairs, tx, ty, both = total * (total - 1) // 2, tied(x), tied(y), int((n.astype(np.int64) * (n - 1) // 2).sum())
    discordant = _inversions(np.unique(y, return_inverse=True)[1], n.astype(np.int64))
    # equal x are in ascending order of y, so inversions only count pairs of different x
    concordant = all_pairs - tx - ty + both - discordant
    spread = (all_pairs - tx) * (all_pairs - ty)
    return (concordant - discordant) / spread**0.5 if spread > 0 else None


def _inversions(y: np.ndarray, n: np.ndarray) -> int:
    """Weighted pairs i < j with y[i] > y[j], by a bottom-up merge sort."""
    total, width, y, n = 0, 1, y.copy(), n.copy()
    while width < len(y):
        for i in range(0, len(y) - width, 2 * width):
            m, e = i + width, min(i + 2 * width, len(y))
            sums = np.concatenate([np.cumsum(n[i:m][::-1])[::-1], [0]])
            total += int((sums[np.searchsorted(y[i:m], y[m:e], side="right")] * n[m:e]).sum())
            order = np.argsort(y[i:e], kind="stable")
            y[i:e], n[i:e] = y[i:e][order], n[i:e][order]
        width *= 2
    return total


def matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """column_a, column_b, correlation of each pair of numeric columns, in column order.
    Rows that lack either value count for other pairs only."""
    pairs = list(combinations(numeric_columns(df, columns), 2))
    schema = "column_a string, column_b string, correlation double"
    if method == "pearson":
        if not pairs:
            return df.sparkSession.createDataFrame([], schema)
        flat = df.agg(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), pearson(present(df, a), present(df, b)).alias("correlation")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
        return flat.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(pairs))])))
    one = {"spearman": spearman, "kendall": kendall}[method]
    known = ranked_correlations(df, sorted({c for p in pairs for c in p})) if method == "spearman" and pairs else {}
    return df.sparkSession.createDataFrame([(a, b, known[a, b] if (a, b) in known else one(df, a, b)) for a, b in pairs], schema)


def ranked_correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Spearman of each pair (either way) of the columns without missing values: each column
    is ranked once, as its ranks are the same in all pairs, and one aggregate has all pairs."""
    gaps = df.agg(*[F.count_if(present(df, c).isNull()).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    whole = [c for c, n in zip(columns, gaps, strict=True) if not n]
    if len(whole) < 2:
        return {}
    values = df.select(*[present(df, c).alias(f"v{i}") for i, c in enumerate(whole)])
    rows = values
    for i in range(len(whole)):
        counts = values.groupBy(f"v{i}").agg(F.count(F.lit(1)).alias("m"))
        rank = running_sum(counts, f"v{i}", F.col("m"), "before").select(f"v{i}", (F.col("before") + (F.col("m") + 1) / 2).alias(f"r{i}"))
        rows = rows.join(rank, f"v{i}")
    pairs = list(combinations(range(len(whole)), 2))
    got = rows.agg(*[pearson(F.col(f"r{i}"), F.col(f"r{j}")).alias(f"_{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = {(whole[i], whole[j]): r for (i, j), r in zip(pairs, got, strict=True)}
    return out | {(b, a): r for (a, b), r in out.items()}


def pearson(x: Column, y: Column) -> Column:
    """Over rows that have both values; null where a column doesn't vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(df: DataFrame, threshold: float = 0.7, method: str = "pearson", columns: list[str] | None = None) -> DataFrame:
    """Pairs of at least threshold in size, rounded to 3 places, largest first."""
    m = matrix(df, columns, method).filter(F.abs("correlation") >= threshold)
    return m.withColumn("correlation", F.round("correlation", 3)).orderBy(F.desc(F.abs("correlation")), "column_a", "column_b")


def target_codes(df: DataFrame, target: str) -> Column:
    """The target as numbers: classes of other types are numbered in sorted order, from 0."""
    if target in numeric_columns(df):
        return present(df, target)
    if isinstance(df.schema[target].dataType, T.BooleanType):
        return ref(target).cast("double")
    values = [r[0] for r in df.select(ref(target)).filter(ref(target).isNotNull()).distinct().limit(10_001).collect()]
    if len(values) < 2 or len(values) > 10_000:
        raise ValueError("a target has 2 to 10000 classes")
    codes = F.create_map(*[F.lit(x) for i, v in enumerate(sorted(values)) for x in (v, float(i))])
    return codes[ref(target)]


def target_correlation(df: DataFrame, target: str, method: str = "pearson", top_n: int | None = None) -> DataFrame:
    """feature, correlation (4 places), abs_correlation of numeric columns, largest first."""
    d = df.withColumn("_target", target_codes(df, target)).filter("_target is not null")
    features = [c for c in numeric_columns(df) if c != target]
    if method == "pearson":
        flat = d.agg(*[F.struct(F.lit(c).alias("feature"), pearson(present(df, c), F.col("_target")).alias("r")).alias(f"_{i}") for i, c in enumerate(features)])
        out = flat.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))
    else:
        one = {"spearman": spearman, "kendall": kendall}[method]
        out = df.sparkSession.createDataFrame([(c, one(d, c, "_target")) for c in features], "feature string, r double")
    out = out.filter("r is not null").select("feature", F.round("r", 4).alias("correlation"), F.round(F.abs("r"), 4).alias("abs_correlation")).orderBy(F.desc("abs_correlation"), "feature")
    return out.limit(top_n) if top_n else out
