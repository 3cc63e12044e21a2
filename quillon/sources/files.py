"""Reading and writing files, with the options of warehouse bulk loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import ref

FORMATS = ("csv", "json", "parquet", "orc")
ON_ERROR = {"ABORT": "FAILFAST", "ABORT_STATEMENT": "FAILFAST", "CONTINUE": "DROPMALFORMED", "SKIP_FILE": "PERMISSIVE"}
BAD = "_malformed"


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", null_string: str | None = None, encoding: str = "UTF-8", on_error: str = "ABORT", schema=None) -> DataFrame:
    """All columns as text unless a schema is given: types are decided by one aggregate later,
    not by a scan of the reader's own. on_error is ABORT, CONTINUE (malformed rows go) or
    SKIP_FILE (files with a malformed row go as a whole)."""
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {list(ON_ERROR)}")
    r = spark.read.option("header", header).option("sep", delimiter).option("encoding", encoding).option("mode", ON_ERROR[on_error]).option("multiLine", False)
    r = r.option("nullValue", null_string) if null_string is not None else r
    if on_error != "SKIP_FILE":
        return (r.schema(schema) if schema is not None else r).csv(path)
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema or r.csv(path).schema
    marked = r.option("columnNameOfCorruptRecord", BAD).option("columnPruning", False).schema(T.StructType([*kinds.fields, T.StructField(BAD, T.StringType())])).csv(path)
    marked = marked.select("*", F.col("_metadata.file_path").alias("_file"))
    # the first column is asked for as well, as Spark reads no file for the mark alone
    bad = marked.filter(F.col(BAD).isNotNull() & (F.length(F.coalesce(ref(kinds.names[0]).cast("string"), F.lit(""))) >= 0)).select(F.col("_file").alias("_bad")).distinct()
    return marked.join(F.broadcast(bad), F.col("_file") == F.col("_bad"), "left_anti").drop("_file", BAD)  # a row for each bad file


def load(spark: SparkSession, path: str, file_format: str = "parquet", pattern: str | None = None, **options) -> DataFrame:
    """Any format that Spark has a reader for; avro needs its package on the class path."""
    if file_format == "csv":
        return read_csv(spark, path, **options)
    r = spark.read.format(file_format).options(**options)
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).option("header", header).option("sep", delimiter).csv(path)


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def touched(target: DataFrame, source: DataFrame, partition: str, most: int = 10_000) -> DataFrame:
    """The target's rows in the partitions that source touches, as a literal filter, which
    prunes the scan; beyond `most` partitions, by a semi join."""
    values = [r[0] for r in source.select(ref(partition)).distinct().limit(most + 1).collect()]
    if len(values) > most:
        return target.join(source.select(ref(partition)).distinct(), partition, "left_semi")
    return target.filter(ref(partition).isin([v for v in values if v is not None]))


def swap(df: DataFrame, path: str) -> None:
    """Write df where it may itself be read from: beside the old folder first, then exchanged
    for it by renames. A failure before the renames leaves the old rows in place."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    df.write.parquet(new.toString())
    had = fs.exists(place)
    if had and not fs.rename(place, old):
        raise OSError(f"can't move {path}")
    if not fs.rename(new, place):
        if had:
            fs.rename(old, place)
        raise OSError(f"can't put the new rows at {path}")
    if had:
        fs.delete(old, True)


def compact(spark: SparkSession, path: str, files: int) -> None:
    swap(spark.read.parquet(path).repartition(files), path)


def query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, lower=None, upper=None, partitions: int = 1, **options) -> DataFrame:
    """A table of another database; with a column and its bounds, by parallel reads."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return r.load()
