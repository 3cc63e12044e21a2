"""Helpers that every corpus operator shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def find_package(spark: SparkSession) -> None:
    """Let Python workers that start elsewhere import this package where nothing else does,
    and have them give freed memory back, as they live on from stage to stage."""
    env = spark.sparkContext.environment
    env.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(1 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(1 << 20))
    env.setdefault("MALLOC_ARENA_MAX", "2")
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name: further columns, also ones
    that differ from these in case alone, can't clash with what an operator adds."""
    columns = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"_{columns.index(n)}").alias(n) for n in names])


def where_id(df: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """The rows of df, with all its columns, whose id is ("left_semi") or isn't
    ("left_anti") in the one column of ids. Null equals null."""
    columns = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(columns))])
    hit = ids.toDF("_hit").distinct()
    return plain.join(hit, F.col(f"_{columns.index(id_col)}").cast("long").eqNullSafe(F.col("_hit")), how).toDF(*columns)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text string, null texts as empty ones."""
    find_package(df.sparkSession)
    return pick(df, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir, or in local mode,
    where that is unset, a temporary folder of this session."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        shared = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its rows are then
    computed once, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing is going to read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A sieve has so many bits at most, 8 MB in all, and so may be broadcast at any scale.
SIEVE_BITS = 1 << 26


def sieved(df: DataFrame, number: Column, wanted: DataFrame) -> DataFrame:
    """The rows of df whose number (a 64-bit hash) may be in the one column of wanted: all
    that are, and few others while wanted has far fewer rows than SIEVE_BITS. Put before
    an inner join, it spares the shuffle of rows that can't match; the join still decides.
    (The optimizer would move a semi join below it.)"""
    at = F.pmod(wanted[wanted.columns[0]], F.lit(SIEVE_BITS))
    bits = wanted.select(F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    columns, own = df.columns, F.pmod(number, F.lit(SIEVE_BITS))
    d = df.withColumns({"_bucket": F.bitmap_bucket_number(own), "_bit": F.bitmap_bit_position(own).cast("int")})
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    return d.join(F.broadcast(bits), "_bucket").filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0).select(*columns)


def is_held(modulus: int, remainder: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo: the fixed folds. A null id is in no fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its n+1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_chunks(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes, a longer row alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
