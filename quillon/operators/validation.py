"""Checks of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from . import anomaly, quality
from .dedup import duplicate_summary
from .profile import missing_values, ref, text_columns, tidy

LONGEST_NAME = 128


def validate(df: DataFrame) -> dict[str, list[str]]:
    """errors and warnings. Columns of one type can't mix types; instead, text columns that
    are half numbers and half other text are warned of."""
    errors, warnings = [], []
    if not df.columns:
        errors.append("no columns")
    names = [c.lower() for c in df.columns]
    errors += [f"column {n} is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
    errors += ["a column has no name" for c in df.columns if not c.strip()]
    warnings += [f"{c[:20]}...: a name of over {LONGEST_NAME} characters" for c in df.columns if len(c) > LONGEST_NAME]
    if errors:
        return {"errors": errors, "warnings": warnings}
    if df.isEmpty():
        return {"errors": ["no rows"], "warnings": warnings}
    warnings += [f"{r.column_name}: {r.null_pct:.1f} % nulls" for r in missing_values(df).collect() if r.null_pct > 95]
    share = tidy(df, {c: {"n": F.count(ref(c)), "numbers": F.count(text.to_number(ref(c)))} for c in text_columns(df)})
    warnings += [f"{r.column_name}: numbers and other text" for r in share.collect() if "n" in share.columns and 0.1 * r.n < r.numbers < 0.9 * r.n]
    return {"errors": errors, "warnings": warnings}


def validate_detailed(df: DataFrame) -> dict:
    base = validate(df)
    if base["errors"]:
        return base | {"recommendations": ["fix the errors first"]}
    q, dup = quality.quality(df), duplicate_summary(df).first()
    gaps, odd = missing_values(df).collect(), anomaly.outliers(df).collect()
    advice = []
    if q["overall_score"] < 60:
        advice.append(f"quality is {q['overall_score']:.1f}: clean the data before loading")
    advice += [f"{r.column_name}: {r.outlier_pct:.1f} % outliers" for r in odd if r.outlier_pct > 5]
    if sum(r.null_pct for r in gaps) / len(gaps) > 20:
        advice.append("over 20 % of all cells are missing")
    advice += [f"{r.column_name}: over half is missing" for r in gaps if r.mostly_missing]
    if dup.surplus_rows:
        advice.append(f"{dup.surplus_rows} duplicate rows")
    return base | {"quality": q, "missing": [r.asDict() for r in gaps], "outliers": [r.asDict() for r in odd], "duplicates": dup.asDict(), "recommendations": advice}


def validate_with_schema(df: DataFrame, schema) -> dict[str, list[str]]:
    """Columns that lack, nulls where none may be, and dates in another format than the
    schema's (over 10 % of all values: an error)."""
    absent = [c.name for c in schema.columns if c.name not in df.columns]
    errors, warnings = [], [f"no column {c}" for c in absent]
    checks = {}
    for c in schema.columns:
        if c.name in df.columns:
            bad = F.count_if(dates.parse(ref(c.name), [c.date_format]).isNull() & ref(c.name).isNotNull()) if c.date_format and c.name in text_columns(df) else F.lit(0).cast("long")
            checks[c.name] = {"n": F.count(ref(c.name)), "nulls": F.count_if(ref(c.name).isNull()), "bad": bad}
    for r in tidy(df, checks).collect() if checks else []:
        if r.nulls and not schema.get_column(r.column_name).nullable:
            errors.append(f"{r.column_name}: {r.nulls} nulls in a required column")
        if r.bad:
            (errors if r.bad > 0.1 * r.n else warnings).append(f"{r.column_name}: {r.bad} of {r.n} values don't fit {schema.get_column(r.column_name).date_format}")
    return {"errors": errors, "warnings": warnings}
