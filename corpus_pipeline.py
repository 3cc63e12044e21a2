"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import cut, table, where_id
from quillon.llm.decontaminate import decontaminate
from quillon.llm.linededup import line_dedup, without_lines
from quillon.llm.neardup import one_of_each
from quillon.llm.packing import pack
from quillon.llm.tokens import default_path
from quillon.llm.toxicity import learn, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject. The model learns from the
    labelled rows of the raw table. Rows without an id go if one of them is rejected."""
    model = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rejected = toxicity(docs, model).filter("predicted = 1").select("doc_id")
    return where_id(docs, rejected, "left_anti")


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that came before; n_chars counts what is left."""
    out = without_lines(docs, line_dedup(docs))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return one_of_each(docs)


def benchmarks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_path())


STAGES = [("toxicity", toxic_out), ("line_dedup", lines_out), ("near_dedup", copies_out), ("decontamination", benchmarks_out), ("packing", packed)]

#: The first stage is a trained model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs, f"stage-{name}") if stage is not packed else docs
    return docs
