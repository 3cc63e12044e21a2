"""Checks of whole tables, the cleaning chain, set operations, files and the catalog."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, keys, quality, validation
from ..operators import profile as P
from ..operators.pipeline import Pipeline
from ..plans import load as L
from ..schema.canonical import CanonicalSchema, ColumnDefinition
from ..schema.types import LogicalType
from ..sources import catalog, files
from . import add, made, table


def place(spark: SparkSession) -> str:
    """A new folder that all nodes share, or in local mode a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    return f"{shared or 'file://' + tempfile.mkdtemp(prefix='quillon-')}/q-{uuid.uuid4().hex}"


def said(spark: SparkSession, found: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(kind, m) for kind in ("errors", "warnings") for m in found[kind]], "kind string, message string")


HOLES = ["c_custkey", "CASE WHEN c_custkey % 50 = 0 THEN c_name END AS rare", "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE c_name END AS mixed"]
holes = made("customer", *HOLES)
add("validate_table", lambda s, d: said(s, validation.validate(holes(s, d))), """
SELECT 'warnings' AS kind, printf('rare: %.1f %% nulls', count(*) FILTER (c_custkey % 50 <> 0) * 100.0 / count(*)) AS message FROM customer
UNION ALL SELECT 'warnings', 'mixed: numbers and other text' FROM customer HAVING count(*) FILTER (c_custkey % 2 = 0) BETWEEN 0.1 * count(*) AND 0.9 * count(*)""")
DATED = ["CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderkey END AS id", "CASE WHEN o_orderkey % 4 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day", "CASE WHEN o_orderkey % 32 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END AS other"]
dated = made("orders", *DATED)
SHAPE = CanonicalSchema("orders", [ColumnDefinition("id", LogicalType.BIGINT, False), ColumnDefinition("day", LogicalType.DATE, date_format="%Y-%m-%d"), ColumnDefinition("other", LogicalType.DATE, date_format="%d/%m/%Y"), ColumnDefinition("gone", LogicalType.STRING)])
add("validate_schema", lambda s, d: said(s, validation.validate_with_schema(dated(s, d), SHAPE)), """
SELECT 'errors' AS kind, 'id: ' || count(*) FILTER (o_orderkey % 20 = 0) || ' nulls in a required column' AS message FROM orders
UNION ALL SELECT 'errors', 'day: ' || count(*) FILTER (o_orderkey % 4 = 0) || ' of ' || count(*) || ' values don''t fit %Y-%m-%d' FROM orders
UNION ALL SELECT 'warnings', 'other: ' || count(*) FILTER (o_orderkey % 32 = 0) || ' of ' || count(*) || ' values don''t fit %d/%m/%Y' FROM orders
UNION ALL SELECT 'warnings', 'no column gone'""")


def detailed(s, d):
    found = validation.validate_detailed(table(s, d, "events").select("user_id", "event_type"))
    return s.createDataFrame([(found["duplicates"]["total"], found["duplicates"]["surplus_rows"], len(found["missing"]), f"{found['duplicates']['surplus_rows']} duplicate rows" in found["recommendations"])], "total long, surplus long, columns int, advised boolean")


add("validate_detailed", detailed, "SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS surplus, 2::INT AS columns, sum(n - 1) > 0 AS advised FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")
PHONES = ["c_custkey", "CASE c_custkey % 4 WHEN 0 THEN '+44 20 7946 0958' WHEN 1 THEN '555-123-4567' WHEN 2 THEN '12-34' END AS phone"]
phones = made("customer", *PHONES)
CALLS = "(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+44 20 7946 0958' WHEN 1 THEN '555-123-4567' WHEN 2 THEN '12-34' END AS phone FROM customer)"


def flagged(step):
    def q(s, d):
        out = step(Pipeline(phones(s, d))).df
        flag = next(c for c in out.columns if c not in ("c_custkey", "phone"))
        return out.select("c_custkey", "phone", F.col(flag).alias("ok"))

    return q


add("val_phone_abroad", flagged(lambda p: p.validate_phone_numbers("phone", country="GB")), f"SELECT c_custkey, phone, coalesce(length(regexp_replace(phone, '\\D', '', 'g')) >= 10, false) AS ok FROM {CALLS}")
add("val_custom", flagged(lambda p: p.validate_custom("phone", lambda v: v is not None and v.startswith("+"))), f"SELECT c_custkey, phone, phone LIKE '+%' AS ok FROM {CALLS}")
add("schema_formats", lambda s, d: Pipeline(dated(s, d).select("id", "other"), SHAPE).apply_schema_formats().df, "SELECT CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 32 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS other FROM orders")
add("type_histogram", lambda s, d: s.createDataFrame(list(P.type_histogram(table(s, d, "lineitem")).items()), "dtype string, n long"), "SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' ELSE 'timestamp_ntz' END AS dtype, count(*) AS n FROM (DESCRIBE lineitem) GROUP BY 1")
add("key_best", lambda s, d: s.createDataFrame([(c,) for c in keys.best_key(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")) or []], "key string"), "SELECT 'o_orderkey' AS key FROM orders HAVING count(DISTINCT o_orderkey) = count(*)")


def report(s, d):
    out = quality.report(table(s, d, "nation"))
    one = out["dataset"]
    return s.createDataFrame([(one["rows"], one["columns"], one["duplicate_rows"], len(out["summary"]), sum(r["unique_count"] for r in out["cardinality"]))], "rows long, columns long, duplicates long, described long, distinct_values long")


add("report", report, "SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE nation)) AS columns, count(*) - count(DISTINCT nation) AS duplicates, (SELECT count(*) FROM (DESCRIBE nation)) AS described, (SELECT sum(len(list_distinct(v))) FROM (SELECT unnest([list(COLUMNS(*)::VARCHAR)]) AS v FROM nation))::BIGINT AS distinct_values FROM nation".replace("(SELECT sum(len(list_distinct(v))) FROM (SELECT unnest([list(COLUMNS(*)::VARCHAR)]) AS v FROM nation))::BIGINT", "(SELECT count(DISTINCT n_nationkey) + count(DISTINCT n_name) + count(DISTINCT n_regionkey) FROM nation)"))


def audited(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    old = o.filter("o_orderkey % 4 <> 0").selectExpr("*", "TIMESTAMP_NTZ '2000-01-01' AS made", "TIMESTAMP_NTZ '2000-01-01' AS changed")
    new = o.filter("o_orderkey % 4 <> 1").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus")
    return L.apply(old, new, L.LoadConfig(L.LoadPattern.UPSERT, ["o_orderkey"], merge_strategy=L.MergeStrategy.UPDATE_CHANGED, created_by_column="made", updated_by_column="changed", as_of="2024-01-01"))


add("load_audit", audited, """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 AND o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2000-01-01' END AS made,
  CASE WHEN o_orderkey % 4 = 0 OR (o_orderkey % 4 <> 1 AND o_orderkey % 3 = 0 AND o_orderstatus <> 'X') THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2000-01-01' END AS changed FROM orders""")
add("high_watermark", lambda s, d: s.createDataFrame([(L.high_watermark(table(s, d, "orders"), "o_orderdate"),)], table(s, d, "orders").select(F.col("o_orderdate").alias("high")).schema), "SELECT coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') AS high FROM orders")
SIDES = "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"
side = lambda s, d, x: table(s, d, "orders").filter(F.col("o_orderstatus") == x).select("o_custkey")
add("set_intersect", lambda s, d: side(s, d, "F").intersect(side(s, d, "O")), f"SELECT * FROM {SIDES[0]} INTERSECT SELECT * FROM {SIDES[1]}")
add("set_except", lambda s, d: side(s, d, "F").exceptAll(side(s, d, "O")), f"SELECT * FROM {SIDES[0]} EXCEPT ALL SELECT * FROM {SIDES[1]}")
add("drift_columns", lambda s, d: drift.column_changes(table(s, d, "nation"), table(s, d, "region").withColumnRenamed("r_name", "n_name")), "SELECT column_name, 'new' AS change FROM (DESCRIBE nation) WHERE column_name <> 'n_name' UNION ALL SELECT column_name, 'missing' FROM (DESCRIBE region) WHERE column_name <> 'r_name'")


def through_csv(s, d):
    path = place(s)
    files.write_csv(table(s, d, "part").select("p_partkey", "p_name", "p_retailprice"), path, delimiter="|")
    return files.read_csv(s, path, delimiter="|", schema="p_partkey long, p_name string, p_retailprice double")


add("file_csv", through_csv, "SELECT p_partkey::BIGINT AS p_partkey, p_name, p_retailprice FROM part")


def through_parquet(s, d):
    path = place(s)
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.write_partitions(o, path, ["o_orderstatus"])
    files.write_partitions(o.filter("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0)), path, ["o_orderstatus"])
    return files.load(s, path)


add("file_partitions", through_parquet, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")


def in_catalog(s, d):
    base, where = f"quillon_{uuid.uuid4().hex[:8]}", place(s)
    s.sql(f"CREATE DATABASE {base} LOCATION '{where}'")
    try:
        s.sql(f"CREATE TABLE {base}.kept (k BIGINT, p DOUBLE, st STRING) USING parquet PARTITIONED BY (st) COMMENT 'orders' LOCATION '{where}/kept'")
        table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.insertInto(f"{base}.kept")
        found = catalog.tables(s, base, counted=True).first()
        facts = {"exists": catalog.exists(s, "kept", base), "absent": catalog.exists(s, "none", base), "comment": catalog.comment(s, f"{base}.kept"), "partition": catalog.hints(s, f"{base}.kept").partition_columns[0], "columns": ",".join(catalog.schema_of(s, f"{base}.kept").column_names()), "tables": ",".join(catalog.list_tables(s, base)), "database": base in catalog.databases(s), "tree": ",".join(catalog.tree(s)[base]), "rows": found.row_count, "dated": found.created is not None}
    finally:
        s.sql(f"DROP DATABASE {base} CASCADE")
    return s.createDataFrame([(k, str(v).lower()) for k, v in facts.items()], "fact string, value string")


add("catalog", in_catalog, "SELECT * FROM (VALUES ('exists', 'true'), ('absent', 'false'), ('comment', 'orders'), ('partition', 'st'), ('columns', 'k,p,st'), ('tables', 'kept'), ('database', 'true'), ('tree', 'kept'), ('dated', 'true')) t(fact, value) UNION ALL SELECT 'rows', count(*)::VARCHAR FROM orders")
