import re

import pytest
from pyspark.sql import types as T

from quillon.plans.flow import prepare_for_load
from quillon.plans.load import DeleteStrategy, LoadConfig, LoadPattern
from quillon.schema import ddl
from quillon.schema.canonical import CanonicalSchema, ColumnDefinition, OptimizationHints, from_spark, infer, load_yaml, save_yaml, substitute
from quillon.schema.types import LogicalType, of_warehouse, physical, physical_of_spark
from quillon.sources.settings import Settings, check_table_name, hide_secrets, retry

L = LogicalType


def events(**hints):
    return CanonicalSchema("events", [ColumnDefinition("id", L.BIGINT, False, "key"), ColumnDefinition("at", L.TIMESTAMP), ColumnDefinition("amount", L.DECIMAL, precision=10, scale=0)], dataset_name="d", optimization=OptimizationHints(**hints))


def test_create_table_bigquery():
    assert ddl.create_table(events(partition_columns=["at"], cluster_columns=["id"]), "bigquery", if_not_exists=True) == 'CREATE TABLE IF NOT EXISTS `d.events` (\n  id INT64 NOT NULL OPTIONS(description="key"),\n  at TIMESTAMP,\n  amount NUMERIC(10,0)\n)\nPARTITION BY DATE(at)\nCLUSTER BY id;'


def test_create_table_runs_in_spark(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS d LOCATION '{tmp_path}'")
    try:
        spark.sql(ddl.create_table(events(), "spark").rstrip(";"))
        assert from_spark(spark.table("d.events").schema, "events").get_column("amount").precision == 10
    finally:
        spark.sql("DROP DATABASE d CASCADE")


@pytest.mark.parametrize("platform", list(ddl.DIALECTS))
@pytest.mark.parametrize("pattern", list(LoadPattern))
def test_every_pattern_has_sql(platform, pattern):
    cfg = LoadConfig(pattern, ["id"], incremental_column="at", hash_columns=["amount"], delete_strategy=DeleteStrategy.HARD_DELETE)
    cfg.lookback_window = "3 days"
    text = ddl.load_sql(events(), cfg, platform)
    assert "events" in text
    if platform == "sqlserver":  # it has no alias in DELETE and UPDATE, no INTERVAL, and TIMESTAMP is a row version there
        assert not re.search(r"DELETE FROM \S+ t\b|UPDATE \S+\.?\S* t SET|INTERVAL|AS TIMESTAMP", text)
    if platform == "redshift":
        assert not re.search(r"DELETE FROM \S+ t\b", text) and "t." not in (text.split("USING")[1].split(";")[0] if "USING" in text else "")


def test_statements_of_sqlserver_and_redshift():
    cfg = LoadConfig(LoadPattern.DELETE_INSERT, ["id"])
    assert "DELETE t FROM [d].[events] t JOIN [d].[events_staging] s ON t.[id] = s.[id];" in ddl.load_sql(events(), cfg, "sqlserver")
    assert "DELETE FROM d.events USING d.events_staging s WHERE d.events.id = s.id;" in ddl.load_sql(events(), cfg, "redshift")
    cfg = LoadConfig(LoadPattern.INCREMENTAL_TIMESTAMP, incremental_column="at", lookback_window="3 days")
    assert "DATEADD(DAY, -3, (SELECT COALESCE(MAX([at]), CAST('1970-01-01' AS DATETIME2))" in ddl.load_sql(events(), cfg, "sqlserver")


def test_narrow_types():
    assert physical_of_spark(T.ShortType(), "sqlserver") == "SMALLINT" and physical_of_spark(T.ByteType(), "sqlserver") == "TINYINT"
    assert physical_of_spark(T.FloatType(), "postgresql") == "REAL" and physical_of_spark(T.DayTimeIntervalType(), "postgresql") == "INTERVAL"
    assert physical_of_spark(T.DecimalType(10, 2), "postgresql") == "NUMERIC(10,2)" and physical_of_spark(T.LongType(), "redshift") == "BIGINT"


def test_limits():
    with pytest.raises(ValueError, match="4 cluster"):
        ddl.create_table(events(cluster_columns=["id", "at", "amount", "id", "at"]), "snowflake")
    with pytest.raises(ValueError, match="names no column"):
        ddl.create_table(events(cluster_columns=["x"]), "snowflake")


def test_types():
    assert of_warehouse("NUMBER(9,0)", "snowflake") is L.INTEGER and of_warehouse("NUMBER(38,0)", "snowflake") is L.BIGINT and of_warehouse("number", "snowflake") is L.DECIMAL
    assert of_warehouse("character varying(20)", "postgresql") is L.STRING and of_warehouse("nonsense", "redshift") is L.STRING
    assert physical(L.STRING, "redshift", 1000) == "VARCHAR(1000)" and physical(L.DECIMAL, "postgresql", None, 10, 0) == "NUMERIC(10,0)"


def test_yaml_round_trip(tmp_path):
    path = str(tmp_path / "s.yaml")
    save_yaml(events(partition_columns=["at"]), path)
    assert load_yaml(path).to_dict() == events(partition_columns=["at"]).to_dict()


def test_substitute():
    assert substitute({"a": ["${X:-y}", "${Z}"]}, {"Z": "z"}) == {"a": ["y", "z"]}
    with pytest.raises(ValueError):
        substitute("${NONE}", {})


def test_dictionary():
    s = events()
    assert "| id | BIGINT | no |" in s.data_dictionary() and s.data_dictionary("csv").splitlines()[0].startswith("Column,") and s.validate_metadata()


def test_infer_and_prepare(spark):
    df = spark.createDataFrame([("1", "yes", "2024-01-02", ""), ("2", "no", "2024-01-03", "b")], "`User ID` string, ok string, day string, note string")
    s = infer(df, "t")
    assert [(c.name, c.logical_type) for c in s.columns] == [("user_id", L.BIGINT), ("ok", L.BOOLEAN), ("day", L.TIMESTAMP), ("note", L.STRING)]
    out = prepare_for_load(df, "postgresql")
    assert out["data"].orderBy("user_id").first().note is None and out["platform_schema"][0]["type"] == "BIGINT"


def test_settings():
    s = Settings({"target": "pg", "connections": {"pg": {"type": "postgresql", "host": "h", "database": "d", "user": "u", "password": "${P}"}}}, {"P": "p"})
    assert s.get()["password"] == "p" and hide_secrets("postgresql://u:p@h password=p") == "postgresql://u:***@h password=***"
    with pytest.raises(ValueError):
        check_table_name("a; drop table b")


def test_retry_only_what_passes():
    calls = []

    @retry(3, sleep=calls.append)
    def f(error):
        raise error

    with pytest.raises(TimeoutError):
        f(TimeoutError())
    with pytest.raises(KeyError):
        f(KeyError("x"))
    assert len(calls) == 2
