"""Missing values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import carried
from .profile import missing, numeric_columns, present, ref, value_counts
from .quantiles import quantiles

#: Donors are compared in blocks of so many rows, with so many rows with gaps in one task.
BLOCK, CHUNK = 20_000, 20_000


def _fills(df: DataFrame, kinds: dict[str, str]) -> dict:
    """The value for each column with gaps by mean, median or mode."""
    names = list(kinds)
    row = df.agg(*[F.avg(present(df, c)) if kinds[c] == "mean" else F.lit(None) for c in names], *[F.count_if(missing(df, c)) for c in names]).first() if names else []
    gaps = [c for i, c in enumerate(names) if row[len(names) + i]]
    out = {c: row[i] for i, c in enumerate(names)} | {c: v[0] for c, v in quantiles(df, {c: [0.5] for c in gaps if kinds[c] == "median"}).items()}
    for c in gaps:
        if kinds[c] == "mode":  # the least of equally frequent ones
            best = df.filter(~missing(df, c)).groupBy(ref(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").first()
            out[c] = best and best.v
    return {c: out[c] for c in gaps if out[c] is not None}


def _filled(df: DataFrame, values: dict) -> DataFrame:
    """A column of integers takes a fill with a fraction as doubles."""
    def cell(c: str):
        if c not in values:
            return ref(c)
        v = F.lit(values[c])
        kind = df.schema[c].dataType.simpleString()
        whole = kind in ("tinyint", "smallint", "int", "bigint") and float(values[c]).is_integer() if isinstance(values[c], int | float) else True
        return F.when(missing(df, c), v.cast(kind if whole else "double")).otherwise(ref(c) if whole else ref(c).cast("double")).alias(c)

    return df.select(*[cell(c).alias(c) for c in df.columns])


def fill_missing(df: DataFrame, strategy: str = "auto", columns: list[str] | None = None, fill_value: object = 0, order_by: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """strategy: auto (median of numbers, mode of others), drop, mean, median (numbers
    only; other columns stay), mode, ffill and bfill (in order_by), constant."""
    cols = columns or df.columns
    numbers = numeric_columns(df, cols)
    if strategy == "drop":
        keep = F.lit(True)
        for c in cols:
            keep = keep & ~missing(df, c)
        return df.filter(keep)
    if strategy == "constant":
        return _filled(df, dict.fromkeys(cols, fill_value))
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise ValueError("order_by says which value is the last one")
        clean = df.withColumns({c: F.when(~missing(df, c), ref(c)) for c in cols})
        return carried(clean, list(cols), order_by, strategy == "ffill", keys)
    kinds = {"auto": {c: "median" if c in numbers else "mode" for c in cols}, "mean": dict.fromkeys(numbers, "mean"), "median": dict.fromkeys(numbers, "median"), "mode": dict.fromkeys(cols, "mode")}
    if strategy not in kinds:
        raise ValueError("no such strategy")
    return _filled(df, _fills(df, kinds[strategy]))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """value and n of the mode, by counts of values."""
    return value_counts(df, [column]).orderBy(F.desc("n"), "value").limit(1).select("value", "n")


class _Boxes:
    """The bounds of blocks of donors, by which a row with gaps finds the blocks it needs."""

    def __init__(self, rows: list, m: int, k: int):
        self.m, self.k, self.by = m, k, {}
        for r in rows:
            self.by.setdefault(r.g, []).append(r)
        for g, own in self.by.items():
            box = lambda of: np.array([[np.nan if v is None else v for v in of(r)] for r in own], dtype=float)  # noqa: E731, B023
            self.by[g] = np.array([r._block for r in own]), np.array([r.n for r in own]), box(lambda r: r.low), box(lambda r: r.high)

    def blocks(self, g: int, x: np.ndarray, reach: float | None) -> np.ndarray:
        """Without reach the block to look at first; with the distance of the k-th row found
        there, all others that may have one as near."""
        if g not in self.by:
            return np.array([], dtype=int)
        block, n, low, high = self.by[g]
        both = ~np.isnan(low - x)
        scale = self.m / np.maximum(both.sum(1), 1)
        least = np.sqrt(np.where(both, np.maximum(np.maximum(low - x, x - high), 0) ** 2, 0).sum(1) * scale)
        most = np.sqrt(np.where(both, np.maximum(np.abs(low - x), np.abs(high - x)) ** 2, 0).sum(1) * scale)
        first = block[np.lexsort((block, most, least, n < self.k))[0]]
        if reach is None:
            return np.array([first])
        order = np.argsort(most)
        enough = np.flatnonzero(n[order].cumsum() >= self.k)
        reach = min(reach, most[order][enough[0]] if len(enough) else np.inf)
        found = np.unique(block[least <= reach * (1 + 1e-9)])
        return found[found != first]


def _matrix(t: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([np.array(t.column(c).to_pylist(), dtype=float) for c in names])


def _nearest(holes: DataFrame, donors: DataFrame, xs: list[str], k: int) -> DataFrame:
    """g, xs, d, v: of each hole the k nearest donors of its block, at most CHUNK holes of a block at a time or so."""
    m = len(xs)
    per = holes.groupBy("_block", "g").agg((F.count(F.lit(1)) / CHUNK).cast("int").alias("_more"))
    left = holes.join(F.broadcast(per), ["_block", "g"]).withColumn("_chunk", F.expr(f"CAST(pmod(xxhash64({', '.join(xs)}), _more + 1) AS INT)")).drop("_more")
    times = per.select(F.col("_block").alias("_b"), F.col("g").alias("_g"), F.expr("sequence(0, _more)").alias("_times"))
    right = donors.join(F.broadcast(times), F.expr("_block = _b AND g = _g")).withColumn("_chunk", F.expr("explode(_times)")).select("_block", "g", "_chunk", *xs, "v")
    kinds = [("g", pa.int32()), *[(x, pa.float64()) for x in (*xs, "d", "v")]]

    def search(h: pa.Table, t: pa.Table) -> pa.Table:
        out = []
        if h.num_rows and t.num_rows:
            near, value, g = _matrix(t, xs), np.array(t.column("v").to_pylist(), dtype=float), h.column("g")[0].as_py()
            for x in _matrix(h, xs):
                diff = near - x
                n = (~np.isnan(diff)).sum(1)
                dist = np.where(n > 0, np.sqrt(np.nansum(diff**2, 1) * m / np.maximum(n, 1)), np.inf)
                ok = np.flatnonzero((dist <= np.partition(dist, min(k, len(dist)) - 1)[min(k, len(dist)) - 1]) & np.isfinite(dist))
                best = ok[np.lexsort((value[ok], dist[ok]))[:k]]
                out += [(g, *(None if np.isnan(v) else float(v) for v in x), float(dist[j]), float(value[j])) for j in best]
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.table([pa.array(v, t) for v, (_, t) in zip(cols, kinds, strict=True)], [c for c, _ in kinds])

    keys = ["_block", "g", "_chunk"]
    left = left.select(*keys, *xs)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "g int, " + ", ".join(f"{x} double" for x in (*xs, "d", "v")))


def knn_impute(df: DataFrame, columns: list[str], neighbours: int = 5, block: int = BLOCK) -> DataFrame:
    """Missing numbers become the mean over the nearest rows that have them. Distances use
    the given columns where both rows have a value, scaled up for those that lack one;
    without any, the column's mean is taken. Equal distances are settled by value.

    Rows with gaps are searched for once for each set of values they have; of donors that are
    equal in what is compared, only the `neighbours` with the least values can be taken. The
    donors left over are sorted into blocks of bounded size. A row looks at the nearest block
    first and then at those others alone that may have donors as near.
    """
    spark, k, m = df.sparkSession, neighbours, len(columns)
    xs = [f"_x{i}" for i in range(m)]
    d = df.withColumns({x: present(df, c) + F.lit(0.0) for x, c in zip(xs, columns, strict=True)})  # no -0.0
    d = d.withColumn("_has", sum((F.when(F.col(x).isNotNull(), F.lit(1 << i)).otherwise(0).cast("long") for i, x in enumerate(xs)), F.lit(0).cast("long")))
    means = d.agg(*[F.avg(x) for x in xs]).first()
    gaps = d.filter((F.col("_has") > 0) & (F.col("_has") < (1 << m) - 1))
    sets = sorted(r._has for r in gaps.select("_has").distinct().collect())
    # each set of known columns with each column to fill
    pairs = [(g, has, c) for g, (has, c) in enumerate((h, c) for h in sets for c in range(m) if not h >> c & 1)]
    table = F.broadcast(spark.createDataFrame(pairs, "g int, _known long, _c int"))
    holes = gaps.join(table, F.col("_has") == F.col("_known")).select("g", *xs).distinct()
    known = lambda i: F.col("_known").bitwiseAND(F.lit(1 << i)) != 0
    compared = F.col("_known").bitwiseAND(F.col("_has"))
    able = d.join(table, (compared != 0) & F.element_at(F.array(*xs), F.col("_c") + 1).isNotNull())
    cells = able.select("g", compared.alias("_set"), *[F.when(known(i), F.col(x)).alias(x) for i, x in enumerate(xs)], F.element_at(F.array(*xs), F.col("_c") + 1).alias("v"))
    place = F.row_number().over(Window.partitionBy("g", "_set", *xs).orderBy("v"))
    donors = cells.withColumn("_r", place).filter(F.col("_r") <= k).drop("_r").checkpoint()
    donors = donors.repartitionByRange(max(1, -(-donors.count() // block)), "g", "_set", *xs, "v").withColumn("_block", F.spark_partition_id()).checkpoint()
    side = lambda f: F.array(*map(f, xs))
    boxes = spark.sparkContext.broadcast(_Boxes(donors.groupBy("_block", "g", "_set").agg(side(F.min).alias("low"), side(F.max).alias("high"), F.count(F.lit(1)).alias("n")).collect(), m, k))
    kinds = [("g", pa.int32()), *[(x, pa.float64()) for x in xs], ("_block", pa.int32())]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach = b.column("_reach").to_pylist() if "_reach" in b.schema.names else [None] * b.num_rows
            to = [boxes.value.blocks(g, x, r) for g, x, r in zip(b.column("g").to_pylist(), _matrix(b, xs) if b.num_rows else [], reach, strict=True)]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(t) for t in to]), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c, _ in kinds[:-1]], pa.array(np.concatenate([[], *to]).astype(np.int32))], [c for c, _ in kinds])

    routed = "g int, " + "".join(f"{x} double, " for x in xs) + "_block int"
    key = [F.col("g"), *[F.coalesce(x, F.lit(0.0)).alias(x) for x in xs]]  # g tells which values are known
    first = _nearest(holes.mapInArrow(route, routed), donors, xs, k).checkpoint()
    reach = first.groupBy(*key).agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf")).alias("_reach"))
    same = [F.col(f"h.{x}").eqNullSafe(F.col(f"r.{x}")) if x == "g" else F.coalesce(f"h.{x}", F.lit(0.0)) == F.col(f"r.{x}") for x in ("g", *xs)]
    wider = holes.alias("h").join(reach.alias("r"), same, "left").select("h.*", F.coalesce("_reach", F.lit(float("inf"))).alias("_reach"))
    found = first.unionByName(_nearest(wider.mapInArrow(route, routed), donors, xs, k))
    nearest = found.groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "v"))), 1, k).alias("s"))
    value = nearest.select("g", *xs, F.expr("aggregate(s, 0D, (a, x) -> a + x.v) / size(s)").alias("v")).join(table, "g")
    wide = value.groupBy(F.col("_known").alias("_has"), *xs).agg(*[F.max(F.when(F.col("_c") == i, F.col("v"))).alias(f"_v{i}") for i in range(m)])
    j = d.select(*map(ref, df.columns), "_has", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in xs]).join(wide, ["_has", *xs], "left")
    return j.select(*[F.coalesce(present(df, c), f"_v{columns.index(c)}", F.lit(means[columns.index(c)]).cast("double")).alias(c) if c in columns else ref(c) for c in df.columns])
