"""Patterns of text columns, the quality score, and reports."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.validate import EMAIL
from . import profile as P
from .dedup import duplicate_rows

# Fixed values.
PATTERNS = {
    "email": EMAIL,
    "phone": r"^[\d\s()\-+.]{10,}$",
    "url": r"^https?://[^\s]+$",
    "ip_address": r"^\d{1,3}(\.\d{1,3}){3}$",
    "currency": r"^[$€£¥]?\s?\d+[\d,.]*$",
    "percentage": r"^\d+[.\d]*\s?%$",
}
WEIGHTS = {"completeness": 0.35, "uniqueness": 0.15, "validity": 0.30, "consistency": 0.20}
BANDS = [(90, "Excellent - Data is production-ready"), (75, "Good - Minor issues to address"), (60, "Fair - Requires cleaning"), (40, "Poor - Significant issues"), (0, "Critical - Major data quality problems")]


def patterns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, pattern, match_pct (of values that aren't null), detected (over half)."""
    cols = P.text_columns(df, columns)
    rules = {k: (lambda c, p=p: c.rlike(p)) for k, p in PATTERNS.items()} | {"date_string": lambda c: dates.parse(c).isNotNull()}
    out = {f"{c}\0{k}": {"n": F.count(P.ref(c)), "hit": F.count_if(rule(P.ref(c)))} for c in cols for k, rule in rules.items()}
    if not out:
        return df.sparkSession.createDataFrame([], "column_name string, pattern string, match_pct double, detected boolean")
    pct = F.when(F.col("n") > 0, F.col("hit") * 100.0 / F.col("n")).otherwise(0.0)
    key = F.split("column_name", "\0")
    return P.tidy(df, out).select(key[0].alias("column_name"), key[1].alias("pattern"), pct.alias("match_pct"), (pct > 50).alias("detected"))


def consistency(df: DataFrame) -> float:
    """The percentage of text and variant columns whose values are of one type; only a
    variant's can differ. 100 without such columns."""
    variants = [f.name for f in df.schema if isinstance(f.dataType, P.T.VariantType)]
    n = len(variants) + len(P.text_columns(df))
    if not variants:
        return 100.0
    kind = lambda c: F.when(~F.is_variant_null(P.ref(c)), F.regexp_extract(F.schema_of_variant(P.ref(c)), r"^\w+", 0))
    r = df.agg(*[F.count_distinct(kind(c)).alias(f"_{i}") for i, c in enumerate(variants)]).first()
    return 100.0 * (n - sum(k > 1 for k in r)) / n


def quality(df: DataFrame, capped: bool = False) -> dict:
    """completeness, uniqueness, validity, consistency, overall_score and interpretation.

    validity counts detected patterns over text columns, so a column with two patterns can
    take it over 100; capped=True bounds it. consistency is the share of text and variant
    columns whose values have one type.
    """
    stats = P.column_stats(df).collect()
    rows = stats[0].total if stats else 0
    cells = rows * len(stats)
    complete = 100.0 * (cells - sum(r.null_count for r in stats)) / cells if cells else 0.0
    numeric = {*P.numeric_columns(df), *P.columns_of(df, (P.T.BooleanType,))}
    unique = [min(r.unique_pct, 100.0) if r.column_name in numeric else 100 - abs(r.unique_pct - 50) for r in stats]
    texts = P.text_columns(df)
    hits = patterns(df).filter("detected").count() if texts and rows else 0
    validity = 100.0 * hits / len(texts) if texts else 100.0
    parts = {"completeness": complete, "uniqueness": sum(unique) / len(unique) if unique else 0.0, "validity": min(validity, 100.0) if capped else validity, "consistency": consistency(df)}
    score = sum(WEIGHTS[k] * v for k, v in parts.items())
    return parts | {"overall_score": score, "interpretation": next((text for least, text in BANDS if score >= least), BANDS[-1][1])}


def profile_dataset(df: DataFrame) -> dict:
    total = df.count()
    return {"rows": total, "columns": len(df.columns), "column_types": P.type_histogram(df), "missing": [r.asDict() for r in P.missing_values(df).collect()], "duplicate_rows": duplicate_rows(df).count(), "quality": quality(df)}


def report(df: DataFrame, output: str = "dict") -> dict | str:
    """All of the above, as dict, json or html."""
    rows = lambda d: [r.asDict() for r in d.collect()]  # noqa: E731  a row for each column
    out = {"dataset": profile_dataset(df), "summary": rows(P.summary_stats(df)), "cardinality": rows(P.cardinality(df)), "patterns": rows(patterns(df)), "distributions": rows(P.distributions(df))}
    if output == "dict":
        return out
    if output == "json":
        return json.dumps(out, default=str)
    if output != "html":
        raise ValueError("output is dict, json or html")
    q = out["dataset"]["quality"]
    head, body = list(out["summary"][0]) if out["summary"] else [], out["summary"]
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    table = "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in head) + "</tr>" for r in body)
    grade = "good" if q["overall_score"] >= 75 else "fair" if q["overall_score"] >= 60 else "poor"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Data profile</title></head><body><h1>Data profile</h1><p class='{grade}'>{q['overall_score']:.1f}: {html.escape(q['interpretation'])}</p><p>{out['dataset']['rows']} rows, {out['dataset']['columns']} columns, {out['dataset']['duplicate_rows']} duplicate rows</p><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in head)}</tr>{table}</table></body></html>"
