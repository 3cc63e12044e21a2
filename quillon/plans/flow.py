"""From raw table to one that is ready to load."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import casts, quality, validation
from ..operators.pipeline import Pipeline
from ..schema.canonical import CanonicalSchema, infer
from ..schema.ddl import create_table, load_sql
from ..schema.types import physical
from .load import LoadConfig


def platform_schema(schema: CanonicalSchema, platform: str, descriptions: bool = False) -> list[dict]:
    return [{"name": c.name, "type": physical(c.logical_type, platform, c.max_length, c.precision, c.scale), "mode": "NULLABLE" if c.nullable else "REQUIRED"} | ({"description": c.description or c.logical_type.name} if descriptions else {}) for c in schema.columns]


def preprocess(df: DataFrame, steps: list[str] | None = None, schema: CanonicalSchema | None = None) -> DataFrame:
    p = Pipeline(df, schema)
    if schema and not steps:
        return p.apply_schema_formats().df
    return p.run(steps or ["fix_whitespace", "standardize_column_names"]).df


def prepare_for_load(df: DataFrame, platform: str, table: str = "table", steps: list[str] | None = None, schema: CanonicalSchema | None = None, profile: bool = False, check: bool = True) -> dict:
    """data (lazy), schema, platform_schema, issues, and with profile, report of the raw rows.
    Issues are told, not raised."""
    out: dict = {"report": quality.report(df)} if profile else {}
    work = preprocess(df, steps, schema) if steps or schema else df
    issues = {"errors": [], "warnings": []}
    for found in ([validation.validate_with_schema(work, schema)] if schema else []) + ([validation.validate(work)] if check else []):
        for k in issues:
            issues[k] += found[k]
    data = casts.prepare(work)
    made = infer(data, table, standardize=False, cast=False)
    return out | {"data": data, "schema": made, "platform_schema": platform_schema(made, platform), "issues": issues}


def incremental_sql(df: DataFrame, table: str, cfg: LoadConfig, platform: str) -> str:
    return load_sql(infer(df, table), cfg, platform)


def ddl(df: DataFrame, table: str, platform: str) -> str:
    return create_table(infer(df, table), platform)
