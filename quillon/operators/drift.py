"""How far two tables with the same columns differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import moments, numeric_columns, value_counts


def numeric_drift(df: DataFrame, reference: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, drift: half of the sum of the differences of mean and standard deviation."""
    both = set(numeric_columns(df)) & set(numeric_columns(reference))
    cols = [c for c in columns or df.columns if c in both]
    a, b = (moments(d, cols).select("column_name", F.col("mean").alias(f"m{i}"), F.coalesce("std", F.lit(0.0)).alias(f"s{i}")) for i, d in ((0, df), (1, reference)))
    return a.join(F.broadcast(b), "column_name").select("column_name", ((F.abs(F.col("m0") - F.col("m1")) + F.abs(F.col("s0") - F.col("s1"))) / 2).alias("drift"))


def categorical_drift(df: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, drift: total variation distance of the shares of values, 0 to 1."""
    def shares(d: DataFrame, name: str) -> DataFrame:
        v = value_counts(d, columns)
        n = v.groupBy("column_name").agg(F.sum("n").alias("_n"))
        return v.join(F.broadcast(n), "column_name").select("column_name", "value", (F.col("n") / F.col("_n")).alias(name))

    j = shares(df, "p").join(shares(reference, "q"), ["column_name", "value"], "full")
    return j.groupBy("column_name").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("drift"))


def column_changes(df: DataFrame, reference: DataFrame) -> DataFrame:
    """column_name, change (new or missing) of columns that only one of the two has."""
    new, gone = (sorted(set(a.columns) - set(b.columns)) for a, b in ((df, reference), (reference, df)))
    return df.sparkSession.createDataFrame([*[(c, "new") for c in new], *[(c, "missing") for c in gone]], "column_name string, change string")


def drift(df: DataFrame, reference: DataFrame, threshold: float = 0.1) -> dict:
    common = [c for c in df.columns if c in reference.columns]
    numbers = [c for c in common if c in numeric_columns(df) and c in numeric_columns(reference)]
    others = [c for c in common if c not in numbers]
    found = {r.column_name: r.drift for r in numeric_drift(df, reference, numbers).collect()} if numbers else {}
    found |= {r.column_name: r.drift for r in categorical_drift(df, reference, others).collect()} if others else {}
    return {"new_columns": [c for c in df.columns if c not in common], "missing_columns": [c for c in reference.columns if c not in common], "common_columns": common, "drift": found, "drifted": [c for c in common if (found.get(c) or 0) > threshold]}
