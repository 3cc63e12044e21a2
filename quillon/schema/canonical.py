"""A schema that belongs to no platform: columns, layout hints, governance; YAML and dictionaries."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import standard_name
from ..operators import casts
from ..operators.profile import missing, ref, tidy
from .types import LogicalType, of_spark, physical, spark_type

BUCKETS = (255, 1000, 5000)


def given(v: object) -> bool:
    return v is not None and v is not False and v != []


@dataclass
class ColumnDefinition:
    name: str
    logical_type: LogicalType
    nullable: bool = True
    description: str | None = None
    source: str | None = None
    pii: bool = False
    tags: list[str] = field(default_factory=list)
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    date_format: str | None = None
    timezone: str | None = None
    original_name: str | None = None

    def validate(self) -> list[str]:
        out = [] if self.name and self.name.strip() else ["a column has no name"]
        temporal = (LogicalType.DATE, LogicalType.TIMESTAMP, LogicalType.TIMESTAMPTZ)
        if self.date_format and self.logical_type not in temporal:
            out.append(f"{self.name}: date_format is for dates and timestamps")
        if self.timezone and self.logical_type is not LogicalType.TIMESTAMPTZ:
            out.append(f"{self.name}: timezone is for TIMESTAMPTZ")
        if self.precision is not None and self.scale is not None and self.scale > self.precision:
            out.append(f"{self.name}: scale exceeds precision")
        return out


@dataclass
class OptimizationHints:
    partition_columns: list[str] = field(default_factory=list)
    cluster_columns: list[str] = field(default_factory=list)
    sort_columns: list[str] = field(default_factory=list)
    distribution_column: str | None = None
    partition_expiration_days: int | None = None
    require_partition_filter: bool = False
    transient: bool = False

    def has_optimizations(self) -> bool:
        return any(v for v in asdict(self).values())


@dataclass
class CanonicalSchema:
    table_name: str
    columns: list[ColumnDefinition]
    dataset_name: str | None = None
    project_id: str | None = None
    optimization: OptimizationHints | None = None
    description: str | None = None
    owner: str | None = None
    domain: str | None = None
    tags: list[str] = field(default_factory=list)
    created_from: str | None = None

    def get_column(self, name: str) -> ColumnDefinition | None:
        return next((c for c in self.columns if c.name == name), None)

    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def validate(self) -> list[str]:
        names = self.column_names()
        out = ([] if self.table_name else ["the table has no name"]) + ([] if names else ["no columns"])
        out += [f"column {n} is there twice" for n in sorted({n for n in names if names.count(n) > 1})]
        out += [e for c in self.columns for e in c.validate()]
        o = self.optimization or OptimizationHints()
        hinted = [*o.partition_columns, *o.cluster_columns, *o.sort_columns, *([o.distribution_column] if o.distribution_column else [])]
        return out + [f"hint names no column: {n}" for n in hinted if n not in names]

    def validate_metadata(self, required_table: tuple = ("description", "owner"), required_columns: tuple = ("description",)) -> list[str]:
        out = [f"table lacks {f}" for f in required_table if not getattr(self, f, None)]
        return out + [f"{c.name} lacks {f}" for c in self.columns for f in required_columns if getattr(c, f, None) in (None, "", [])]

    def to_spark(self) -> T.StructType:
        """Governance goes along as field metadata."""
        fields = []
        for c in self.columns:
            meta = {k: v for k, v in asdict(c).items() if given(v) and k not in ("name", "logical_type", "nullable", "precision", "scale")}
            fields.append(T.StructField(c.name, spark_type(c.logical_type, c.precision, c.scale), c.nullable, meta | {"logical_type": c.logical_type.value}))
        return T.StructType(fields)

    def to_dict(self) -> dict:
        out = asdict(self)
        for c in out["columns"]:
            c["logical_type"] = c["logical_type"].value
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    def data_dictionary(self, output: str = "markdown", platform: str | None = None) -> str:
        head = ["Column", "Type", "Nullable", "PII", "Description", "Source", "Tags"]
        kind = lambda c: physical(c.logical_type, platform, c.max_length, c.precision, c.scale) if platform else c.logical_type.name
        rows = [[c.name, kind(c), "yes" if c.nullable else "no", "yes" if c.pii else "no", c.description or "", c.source or "", ", ".join(c.tags)] for c in self.columns]
        if output == "json":
            return self.to_json()
        if output == "csv":
            text = io.StringIO()
            csv.writer(text).writerows([head, *rows])
            return text.getvalue()
        if output != "markdown":
            raise ValueError("output is markdown, csv or json")
        line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r) + " |"
        top = [f"# {self.table_name}", *([self.description] if self.description else []), *([f"Owner: {self.owner}"] if self.owner else [])]
        return "\n\n".join(top) + "\n\n" + "\n".join([line(head), "|" + "---|" * len(head), *map(line, rows)]) + "\n"


def from_spark(schema: T.StructType, table_name: str) -> CanonicalSchema:
    columns = []
    for f in schema:
        m = dict(f.metadata or {})
        kind = LogicalType(m.pop("logical_type")) if "logical_type" in m else of_spark(f.dataType)
        known = {k: v for k, v in m.items() if k in ColumnDefinition.__dataclass_fields__}
        if isinstance(f.dataType, T.DecimalType):
            known |= {"precision": f.dataType.precision, "scale": f.dataType.scale}
        columns.append(ColumnDefinition(f.name, kind, f.nullable, **known))
    return CanonicalSchema(table_name, columns, created_from="spark")


def infer(df: DataFrame, table_name: str, standardize: bool = True, cast: bool = True, **hints) -> CanonicalSchema:
    """From one aggregate that decides casts and one that counts nulls and lengths."""
    d = casts.auto_cast(df) if cast else df
    stats = {r.column_name: r for r in tidy(d, {c: {"nulls": F.count_if(missing(d, c)), "longest": F.max(F.length(ref(c))) if t == "string" else F.lit(None).cast("int")} for c, t in d.dtypes}).collect()}
    columns = []
    for f in d.schema:
        r, decimal = stats[f.name], isinstance(f.dataType, T.DecimalType)
        size = next((b for b in BUCKETS if r.longest is not None and r.longest <= b), None)
        columns.append(ColumnDefinition(standard_name(f.name) if standardize else f.name, of_spark(f.dataType), r.nulls > 0, max_length=size, precision=f.dataType.precision if decimal else None, scale=f.dataType.scale if decimal else None, original_name=f.name))
    return CanonicalSchema(table_name, columns, optimization=OptimizationHints(**hints) if hints else None, created_from="dataframe")


def substitute(value, env: dict | None = None):
    """${NAME} and ${NAME:-default} in strings, lists and dicts."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise ValueError(f"environment variable {m[1]} is not set")
        return m[2]

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", one, value)


def load_yaml(path: str, env: dict | None = None) -> CanonicalSchema:
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = substitute(yaml.safe_load(f), env)
    if not isinstance(raw, dict) or "table_name" not in raw or not raw.get("columns"):
        raise ValueError("a schema has table_name and columns")
    known = ColumnDefinition.__dataclass_fields__
    columns = [ColumnDefinition(**{k: LogicalType[v.upper()] if k == "logical_type" else v for k, v in ({"logical_type": c.get("logical_type", c.get("type", "STRING"))} | c).items() if k in known}) for c in raw["columns"]]
    hints = OptimizationHints(**raw["optimization"]) if raw.get("optimization") else None
    return CanonicalSchema(raw["table_name"], columns, optimization=hints, **{k: raw[k] for k in ("dataset_name", "project_id", "description", "owner", "domain", "tags", "created_from") if raw.get(k)})


def save_yaml(schema: CanonicalSchema, path: str) -> None:
    import yaml

    tidy_up = lambda d: {k: v for k, v in d.items() if given(v)}
    out = schema.to_dict()
    out["columns"] = [tidy_up(c | {"logical_type": c["logical_type"].upper()}) | {"nullable": c["nullable"]} for c in out["columns"]]
    if out.get("optimization"):
        out["optimization"] = tidy_up(out["optimization"])
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(tidy_up(out), f, sort_keys=False)
