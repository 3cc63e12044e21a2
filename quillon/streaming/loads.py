"""Load patterns over streams of files or events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.load import LoadConfig, apply
from ..sources.files import swap


def load_stream(stream: DataFrame, path: str, cfg: LoadConfig, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch is loaded into the table at path by cfg's pattern. All patterns that
    have keys give the same table when a batch is repeated after a failure."""
    def one(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        swap(apply(spark.read.parquet(path), batch, cfg), path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_of_key(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """A stream without rows whose key came before within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(F.count(F.lit(1)).alias("n"))
