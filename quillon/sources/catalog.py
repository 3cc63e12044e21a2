"""What the session's catalog knows of tables."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..schema.canonical import CanonicalSchema, OptimizationHints, from_spark
from ..schema.ddl import create_table


def exists(spark: SparkSession, table: str, database: str | None = None) -> bool:
    return spark.catalog.tableExists(f"{database}.{table}" if database else table)


def _details(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()
    return {r.col_name.strip(): r.data_type for r in rows if r.col_name}


def comment(spark: SparkSession, table: str) -> str | None:
    return _details(spark, table).get("Comment")


def hints(spark: SparkSession, table: str) -> OptimizationHints:
    cols = spark.catalog.listColumns(table)
    names = lambda text: [c.strip(" `") for c in (text or "").strip("[]").split(",") if c.strip(" `")]
    return OptimizationHints(partition_columns=[c.name for c in cols if c.isPartition], cluster_columns=[c.name for c in cols if c.isBucket], sort_columns=names(_details(spark, table).get("Sort Columns")))


def schema_of(spark: SparkSession, table: str) -> CanonicalSchema:
    out = from_spark(spark.table(table).schema, table.rsplit(".", 1)[-1])
    out.optimization, out.description = hints(spark, table), comment(spark, table)
    return out


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    return sorted(t.name.lower() for t in spark.catalog.listTables(database) if not t.isTemporary)


def tables(spark: SparkSession, database: str | None = None, counted: bool = False) -> DataFrame:
    """name, table_type, size_bytes (as far as the optimizer knows it), created (null for
    views), and row_count: with `counted`, by one count of each table, else null."""
    rows = []
    for t in spark.catalog.listTables(database):
        full = f"{'.'.join(t.namespace)}.{t.name}" if t.namespace else t.name
        size = Decimal(str(spark.table(full)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        made = None if t.isTemporary else _details(spark, full).get("Created Time")
        rows.append((t.name.lower(), t.tableType, size, made, spark.table(full).count() if counted else None))
    return spark.createDataFrame(rows, "name string, table_type string, size_bytes decimal(38,0), created string, row_count long")


def execute(spark: SparkSession, text: str) -> None:
    """Run statements that end in semicolons at the end of a line, one after another."""
    for statement in re.split(r";[ \t]*(?:\n|$)", text):
        if statement.strip():
            spark.sql(statement)


def databases(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())


def tree(spark: SparkSession) -> dict[str, list[str]]:
    """Databases and their tables; a database that can't be read has none."""
    out = {}
    for d in databases(spark):
        try:
            out[d] = list_tables(spark, d)
        except Exception:  # noqa: BLE001  no right to list it, or gone meanwhile
            out[d] = []
    return out


def create(spark: SparkSession, schema: CanonicalSchema, if_not_exists: bool = False) -> None:
    execute(spark, create_table(schema, "spark", if_not_exists))


def analyze(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
