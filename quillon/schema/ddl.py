"""CREATE TABLE, load and merge statements as text, for five warehouses and for Spark.

One description of each dialect, and one writer for all of them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from ..plans.load import DeleteStrategy, LoadConfig, LoadPattern, MergeStrategy
from .canonical import CanonicalSchema, OptimizationHints
from .types import LogicalType, physical


@dataclass(frozen=True)
class Dialect:
    """most_*: columns allowed (0: none). joined: how the pieces of a name are quoted."""

    name: str
    quote: str = "{}"
    whole_name: bool = False
    most_partition: int = 0
    most_cluster: int = 0
    most_sort: int = 0
    distribution: bool = False
    merge: bool = True
    if_not_exists: bool = True
    now: str = "CURRENT_TIMESTAMP"
    distinct: str = "{a} IS DISTINCT FROM {b}"
    true: str = "TRUE"
    false: str = "FALSE"
    timestamp: str = "TIMESTAMP"
    back: str = "{value} - INTERVAL '{n} {unit}'"
    delete: str = "DELETE FROM {target} t WHERE EXISTS (SELECT 1 FROM {source} s WHERE {on});"
    update: str = "UPDATE {target} t SET {sets} FROM {source} s WHERE {on};"


DIALECTS = {
    "bigquery": Dialect("bigquery", "`{}`", True, 1, 4, now="CURRENT_TIMESTAMP()", back="{value} - INTERVAL {n} {unit}"),
    "snowflake": Dialect("snowflake", most_cluster=4, now="CURRENT_TIMESTAMP()"),
    "redshift": Dialect("redshift", most_sort=400, distribution=True, merge=False, now="GETDATE()", distinct="(({a} <> {b}) OR ({a} IS NULL) <> ({b} IS NULL))", delete="DELETE FROM {target} USING {source} s WHERE {on};"),
    "postgresql": Dialect("postgresql", '"{}"', most_partition=1, most_cluster=32, merge=False),
    "sqlserver": Dialect("sqlserver", "[{}]", most_partition=1, most_cluster=16, if_not_exists=False, now="SYSUTCDATETIME()", true="1", false="0", timestamp="DATETIME2", back="DATEADD({unit}, -{n}, {value})", delete="DELETE t FROM {target} t JOIN {source} s ON {on};", update="UPDATE t SET {sets} FROM {target} t JOIN {source} s ON {on};"),
    "spark": Dialect("spark", "`{}`", most_partition=32, most_cluster=32, most_sort=32, now="current_timestamp()", distinct="NOT ({a} <=> {b})"),
}


def dialect(platform: str) -> Dialect:
    if platform not in DIALECTS:
        raise ValueError(f"platform is one of {list(DIALECTS)}")
    return DIALECTS[platform]


def table_ref(platform: str, table: str, dataset: str | None = None, project: str | None = None) -> str:
    d = dialect(platform)
    pieces = [p for p in (project, dataset, table) if p]
    return d.quote.format(".".join(pieces)) if d.whole_name else ".".join(d.quote.format(p) for p in pieces)


def check_hints(hints: OptimizationHints, platform: str) -> list[str]:
    d = dialect(platform)
    out = []
    for what, columns, most in (("partition", hints.partition_columns, d.most_partition), ("cluster", hints.cluster_columns, d.most_cluster), ("sort", hints.sort_columns, d.most_sort)):
        if len(columns) > most:
            out.append(f"{platform} takes {most} {what} columns at most" if most else f"{platform} has no {what} columns")
    if hints.distribution_column and not d.distribution:
        out.append(f"{platform} has no distribution key")
    return out


def _q(text: str) -> str:
    return text.replace("'", "''")


def create_table(schema: CanonicalSchema, platform: str, if_not_exists: bool = False, or_replace: bool = False, temporary: bool = False, buckets: int = 16) -> str:
    """One statement, followed by index and comment statements where a warehouse needs them."""
    errors = schema.validate() + check_hints(schema.optimization or OptimizationHints(), platform)
    if errors:
        raise ValueError("; ".join(errors))
    d, h = dialect(platform), schema.optimization or OptimizationHints()
    name, q = table_ref(platform, schema.table_name, schema.dataset_name, schema.project_id), d.quote.format if platform != "bigquery" else "{}".format
    lines = []
    for c in schema.columns:
        line = f"  {q(c.name)} {physical(c.logical_type, platform, c.max_length, c.precision, c.scale)}" + ("" if c.nullable else " NOT NULL")
        if c.description and platform == "bigquery":
            line += f' OPTIONS(description="{c.description.replace(chr(34), chr(92) + chr(34))}")'
        elif c.description and platform in ("snowflake", "spark"):
            line += f" COMMENT '{_q(c.description)}'"
        lines.append(line)
    words = ["CREATE", *(["OR REPLACE"] if or_replace and platform in ("snowflake", "bigquery") else []), *(["TRANSIENT"] if h.transient and platform == "snowflake" else []), *(["TEMPORARY"] if temporary and platform in ("snowflake", "postgresql", "redshift") else []), "TABLE", *(["IF NOT EXISTS"] if if_not_exists and d.if_not_exists and not or_replace else [])]
    out = [f"{' '.join(words)} {name} (", ",\n".join(lines), ")"]
    cols = lambda names: ", ".join(q(n) for n in names)
    after: list[str] = []
    if platform == "bigquery":
        if h.partition_columns:
            p = schema.get_column(h.partition_columns[0])
            out.append(f"PARTITION BY DATE({p.name})" if p.logical_type in (LogicalType.TIMESTAMP, LogicalType.TIMESTAMPTZ) else f"PARTITION BY {p.name}")
        out += [f"CLUSTER BY {cols(h.cluster_columns)}"] * bool(h.cluster_columns)
        options = [f"partition_expiration_days={h.partition_expiration_days}"] * bool(h.partition_expiration_days) + ["require_partition_filter=true"] * h.require_partition_filter + [f'description="{schema.description}"'] * bool(schema.description)
        out += [f"OPTIONS({', '.join(options)})"] * bool(options)
    elif platform == "snowflake":
        out += [f"CLUSTER BY ({cols(h.cluster_columns)})"] * bool(h.cluster_columns)
    elif platform == "redshift":
        out += [f"DISTSTYLE KEY\nDISTKEY({h.distribution_column})"] * bool(h.distribution_column)
        out += [f"SORTKEY({cols(h.sort_columns)})"] * bool(h.sort_columns)
    elif platform == "postgresql":
        out += [f"PARTITION BY RANGE ({cols(h.partition_columns)})"] * bool(h.partition_columns)
        after += [f"CREATE INDEX {schema.table_name}_idx ON {name} ({cols(h.cluster_columns)});"] * bool(h.cluster_columns)
        after += [f"COMMENT ON COLUMN {name}.{q(c.name)} IS '{_q(c.description)}';" for c in schema.columns if c.description]
    elif platform == "sqlserver":
        after += [f"CREATE CLUSTERED INDEX {schema.table_name}_idx ON {name} ({cols(h.cluster_columns)});"] * bool(h.cluster_columns)
    else:
        out.append("USING parquet")
        out += [f"PARTITIONED BY ({cols(h.partition_columns)})"] * bool(h.partition_columns)
        if h.cluster_columns:
            out.append(f"CLUSTERED BY ({cols(h.cluster_columns)})" + f" SORTED BY ({cols(h.sort_columns)})" * bool(h.sort_columns) + f" INTO {buckets} BUCKETS")
        out += [f"COMMENT '{_q(schema.description or '')}'"] * bool(schema.description)
    return "\n".join(["\n".join(out) + ";", *after])


def schema_json(schema: CanonicalSchema) -> str:
    """The JSON schema of BigQuery's loader."""
    return json.dumps([{"name": c.name, "type": physical(c.logical_type, "bigquery"), "mode": "NULLABLE" if c.nullable else "REQUIRED"} | ({"description": c.description} if c.description else {}) for c in schema.columns], indent=2)


def load_text(schema: CanonicalSchema, platform: str, path: str) -> str:
    """A command of the warehouse's client that loads a CSV file."""
    t = ".".join(p for p in (schema.dataset_name, schema.table_name) if p)
    return {
        "bigquery": f"bq load --source_format=CSV --skip_leading_rows=1 {t} {path} schema.json",
        "snowflake": f"snowsql -q \"PUT file://{path} @%{schema.table_name}; COPY INTO {t} FROM @%{schema.table_name} FILE_FORMAT = (TYPE = CSV SKIP_HEADER = 1);\"",
        "redshift": f"aws s3 cp {path} s3://BUCKET/ && psql -c \"COPY {t} FROM 's3://BUCKET/{path.rsplit('/', 1)[-1]}' IAM_ROLE 'ROLE' CSV IGNOREHEADER 1;\"",
        "postgresql": f"psql -c \"\\COPY {t} FROM '{path}' WITH (FORMAT csv, HEADER true);\"",
        "sqlserver": f"bcp {t} in {path} -c -t, -F 2",
        "spark": f"spark.read.option('header', True).csv('{path}').write.insertInto('{t}')",
    }[platform]


def staging(schema: CanonicalSchema, platform: str, cfg: LoadConfig | None = None) -> str:
    name = (cfg.staging_table if cfg else None) or f"{schema.table_name}_staging"
    copy = CanonicalSchema(name, schema.columns, schema.dataset_name if platform not in ("postgresql", "sqlserver") else None, schema.project_id)
    text = create_table(copy, platform, or_replace=True, temporary=platform == "postgresql")
    if platform == "postgresql":
        text = text[:-1] + "\nON COMMIT DROP;"
    return text.replace("[" + name, "[#" + name) if platform == "sqlserver" else text


def load_sql(schema: CanonicalSchema, cfg: LoadConfig, platform: str) -> str:
    """The statements that apply a pattern from the staging table, all nine on each platform."""
    cfg.validate()
    d, q = dialect(platform), dialect(platform).quote.format if platform != "bigquery" else "{}".format
    p, P = cfg.load_pattern, LoadPattern
    target = table_ref(platform, schema.table_name, schema.dataset_name, schema.project_id)
    source = table_ref(platform, cfg.staging_table or f"{schema.table_name}_staging", schema.dataset_name, schema.project_id)
    special = {cfg.operation_column, cfg.sequence_column} if p is P.CDC_MERGE else set()
    names = [c for c in schema.column_names() if c not in special]
    rest, keys = [c for c in names if c not in cfg.primary_keys], cfg.primary_keys
    cols, on = ", ".join(map(q, names)), " AND ".join(f"t.{q(k)} = s.{q(k)}" for k in keys)
    pick = ", ".join(f"s.{q(c)}" for c in names)
    differ = lambda cs: " OR ".join(d.distinct.format(a=f"t.{q(c)}", b=f"s.{q(c)}") for c in cs)
    insert = f"INSERT INTO {target} ({cols})\nSELECT {pick} FROM {source} s"
    missing = f"WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE {on})"
    moves = {MergeStrategy.UPDATE_SELECTIVE: cfg.update_columns or [], MergeStrategy.UPDATE_NONE: []}.get(cfg.merge_strategy, rest)
    sets = ", ".join(f"{q(c)} = s.{q(c)}" for c in moves)
    # the target's alias, or its name where a DELETE takes no alias
    here = lambda text: text if " t " in d.delete else text.replace("t.", f"{target}.")
    delete = lambda rows, more="": d.delete.format(target=target, source=rows, on=here(on) + more)
    update = lambda rows, what, more="": d.update.format(target=target, source=rows, sets=what, on=on + more)
    block = lambda *x: "BEGIN" + (" TRANSACTION" if platform != "postgresql" else "") + ";\n" + "\n".join(x) + "\nCOMMIT" + (" TRANSACTION" if platform == "bigquery" else "") + ";"
    if p is P.FULL_REFRESH:
        return block(f"DELETE FROM {target} WHERE 1 = 1;", insert + ";")
    if p is P.APPEND_ONLY:
        return insert + ";"
    if p is P.DELETE_INSERT:
        return block(delete(source), insert + ";")
    if p is P.INCREMENTAL_APPEND:
        return f"{insert}\n{missing};"
    if p is P.INCREMENTAL_TIMESTAMP:
        since = f"(SELECT COALESCE(MAX({q(cfg.incremental_column)}), CAST('1970-01-01' AS {d.timestamp})) FROM {target})"
        if cfg.lookback_window:
            n, unit = cfg.lookback_window.split()
            since = d.back.format(value=since, n=n, unit=unit.upper().rstrip("S"))
        return f"{insert}\nWHERE s.{q(cfg.incremental_column)} > {since};"
    if p in (P.UPSERT, P.SCD_TYPE1):
        changed = f" AND ({differ(rest)})" if cfg.merge_strategy is MergeStrategy.UPDATE_CHANGED and rest else ""
        if d.merge:
            matched = [f"WHEN MATCHED{changed} THEN UPDATE SET {sets}"] * bool(moves)
            return "\n".join([f"MERGE INTO {target} t", f"USING {source} s", f"ON {on}", *matched, f"WHEN NOT MATCHED THEN INSERT ({cols}) VALUES ({pick});"])
        return block(*[update(source, sets, changed)] * bool(moves), f"{insert}\n{missing};")
    if p is P.SCD_TYPE2:
        start, end, now = q(cfg.effective_date_column), q(cfg.expiration_date_column), q(cfg.is_current_column)
        plain = [c for c in names if c not in (cfg.effective_date_column, cfg.expiration_date_column, cfg.is_current_column)]
        expire = update(source, f"{end} = {d.now}, {now} = {d.false}", f" AND t.{now} = {d.true} AND ({differ(cfg.hash_columns)})")
        new = f"INSERT INTO {target} ({', '.join(map(q, plain))}, {start}, {end}, {now})\nSELECT {', '.join(f's.{q(c)}' for c in plain)}, {d.now}, CAST('9999-12-31' AS {d.timestamp}), {d.true} FROM {source} s\nWHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE {on} AND t.{now} = {d.true});"
        return block(expire, new)
    op = f"s.{q(cfg.operation_column)}"
    latest = f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {', '.join(map(q, keys))} ORDER BY {q(cfg.sequence_column or keys[0])} DESC) AS rn FROM {source}) x WHERE rn = 1)"
    gone = {DeleteStrategy.HARD_DELETE: "DELETE", DeleteStrategy.SOFT_DELETE: f"UPDATE SET {q(cfg.soft_delete_column or '')} = {d.true}"}.get(cfg.delete_strategy)
    all_sets = ", ".join(f"{q(c)} = s.{q(c)}" for c in rest)
    if d.merge:
        return "\n".join([f"MERGE INTO {target} t", f"USING {latest} s", f"ON {on}", *[f"WHEN MATCHED AND {op} = 'D' THEN {gone}"] * bool(gone), f"WHEN MATCHED AND {op} <> 'D' THEN UPDATE SET {all_sets}", f"WHEN NOT MATCHED AND {op} <> 'D' THEN INSERT ({cols}) VALUES ({pick});"])
    first = {DeleteStrategy.HARD_DELETE: delete(latest, f" AND {op} = 'D'"), DeleteStrategy.SOFT_DELETE: update(latest, f"{q(cfg.soft_delete_column or '')} = {d.true}", f" AND {op} = 'D'")}.get(cfg.delete_strategy)
    return block(*[first] * bool(first), update(latest, all_sets, f" AND {op} <> 'D'"), f"INSERT INTO {target} ({cols})\nSELECT {pick} FROM {latest} s\nWHERE {op} <> 'D' AND NOT EXISTS (SELECT 1 FROM {target} t WHERE {on});")


def high_watermark(schema: CanonicalSchema, column: str, platform: str) -> str:
    return f"SELECT COALESCE(MAX({column}), CAST('1970-01-01' AS {dialect(platform).timestamp})) FROM {table_ref(platform, schema.table_name, schema.dataset_name, schema.project_id)};"


def copy_text(table: str, path: str, platform: str, file_format: str = "CSV", delimiter: str = ",", header: bool = True, null_string: str = "", iam_role: str = "ROLE", on_error: str = "ABORT_STATEMENT", pattern: str | None = None) -> str:
    """A bulk load statement that runs in the warehouse."""
    if platform == "redshift":
        return f"COPY {table}\nFROM '{path}'\nIAM_ROLE '{iam_role}'\nFORMAT AS {file_format}" + (f"\nDELIMITER '{delimiter}'" + "\nIGNOREHEADER 1" * header if file_format == "CSV" else "") + ";"
    if platform == "snowflake":
        return f"COPY INTO {table}\nFROM {path}\nFILE_FORMAT = (TYPE = {file_format})" + (f"\nPATTERN = '{pattern}'" if pattern else "") + f"\nON_ERROR = {on_error};"
    if platform == "postgresql":
        return f"COPY {table} FROM '{path}' WITH (FORMAT csv, DELIMITER '{delimiter}', HEADER {str(header).lower()}, NULL '{null_string}');"
    if platform == "sqlserver":
        return f"BULK INSERT {table} FROM '{path}' WITH (FIELDTERMINATOR = '{delimiter}', ROWTERMINATOR = '\\n', FIRSTROW = {2 if header else 1});"
    raise ValueError("no bulk load statement for " + platform)


def maintenance(table: str, platform: str) -> list[str]:
    """Statements that refresh statistics, and reclaim space where that is a statement."""
    out = {"redshift": [f"VACUUM {table};", f"ANALYZE {table};"], "postgresql": [f"VACUUM ANALYZE {table};"], "sqlserver": [f"UPDATE STATISTICS {table};"], "spark": [f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS;"]}
    return out.get(platform, [])



def capabilities(platform: str) -> dict:
    d = dialect(platform)
    return {"partitioning": d.most_partition > 0, "clustering": d.most_cluster > 0, "sort_keys": d.most_sort > 0, "distribution": d.distribution, "merge": d.merge, "max_cluster_columns": d.most_cluster}


