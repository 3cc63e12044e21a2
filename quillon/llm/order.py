"""Token-ID and binary output (training-order materialisation).

Every sequence gets a dense index, and a keyed Feistel permutation with cycle-walking
turns that into its slot in training order: a bijection of 0..n-1 that needs no shuffle
buffer and no state but the key. The index is the order of the rows in their files, or by
id, and so does not depend on how a cluster splits them. Slots are range-partitioned; each
shard is a file of `per_shard` consecutive slots at a fixed stride, so slot s is at byte
(s mod per_shard) * stride of shard s // per_shard, and a reader can resume at any slot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, find_package, release, table
from .shingles import mix
from .tokens import default_path, encoder

LENGTH, PER_SHARD, KEY, PAD = 512, 1024, 20240229, 50256
ROUNDS = 6


def feistel(x: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """The image of each x in 0..n-1 under a permutation of 0..n-1. A balanced network
    permutes the next power of four; values past n-1 walk on along their cycle."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(rounds, dtype=np.uint64) + np.uint64(key & (2**64 - 1)) * np.uint64(1))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & low)
        return (left << np.uint64(half)) | right

    out = once(np.asarray(x, np.uint64))
    while (far := np.flatnonzero(out >= np.uint64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


#: The first index of each file split is broadcast (16 bytes each) up to so many splits.
MOST_SPLITS = 1_000_000


def placed(df: DataFrame, id_col: str, text_col: str, in_file_order: bool) -> DataFrame:
    """doc_id, text, file and start (of the split that a row is in; rows of a split come in
    order). Unless df reads files as they are, it is first written in the order of ids and
    texts."""
    if not in_file_order:
        df = cut(documents(df, id_col, text_col).repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text"), "op10-documents")
        id_col, text_col = "doc_id", "text"
    find_package(df.sparkSession)
    marked = df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns) if c in (id_col, text_col)], F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    own, text = (F.col(f"_{df.columns.index(c)}") for c in (id_col, text_col))
    return marked.select(own.cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), "file", "start")


def sequences(docs: DataFrame, tokenizer: str, length: int, end: int) -> DataFrame:
    """doc_id, piece, ids (the document's ids and an end id, `length` at a time; 16-bit
    little-endian if the vocabulary allows, else 32-bit), file, start, and rank in the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), Counter()
        kind = "<u2" if enc.size <= 1 << 16 else "<u4"
        for b in batches:
            rows = []
            for doc_id, text, file, start in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                ids = np.append(np.frombuffer(enc.ids(text.as_py()), "<u4"), end).astype(kind)
                for k in range(0, len(ids), length):
                    rows.append((doc_id, k // length, ids[k : k + length].tobytes(), file, start, seen[file, start]))
                    seen[file, start] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "ids", "file", "start", "rank"])

    return docs.mapInArrow(run, "doc_id long, piece int, ids binary, file string, start long, rank long")


def materialise(df: DataFrame, tokenizer: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, pad: int = PAD, id_col: str = "doc_id", text_col: str = "text", in_file_order: bool = False) -> DataFrame:
    """One row per shard: shard, first_slot, n_sequences, stride, payload (n_sequences
    times stride bytes), doc_ids and pieces and lengths in slot order.

    A null or empty text is one sequence of the end id alone; short sequences are padded.
    Ids may be null or repeat. An empty table gives no shards; further columns are
    ignored. The same rows and key give the same shards on any cluster: rows are numbered
    by id and text, null ids first, or with `in_file_order`, for a df that reads files and
    does nothing else, in the order of the files' names and of their rows.
    """
    spark = df.sparkSession
    made = cut(sequences(placed(df, id_col, text_col, in_file_order), tokenizer, length, pad), "op10-sequences")
    splits = cut(made.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")), "op10-splits")
    total = splits.agg(F.sum("n")).first()[0] or 0
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    split = F.xxhash64("file", "start").alias("split")
    base = splits.select(split, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if splits.count() <= MOST_SPLITS else base

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = feistel(b.column("rank").to_numpy() + b.column("base").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("ids"), pa.array(s)], ["doc_id", "piece", "ids", "slot"])

    slotted = made.select("doc_id", "piece", "ids", "rank", split).join(base, "split").select("doc_id", "piece", "ids", "rank", "base").mapInArrow(slot, "doc_id long, piece int, ids binary, slot long")
    shards = -(-total // per_shard)
    ordered = slotted.withColumn("shard", F.floor(F.col("slot") / per_shard)).repartitionByRange(max(1, min(shards, 4 * spark.sparkContext.defaultParallelism + shards // 64)), "shard").sortWithinPartitions("slot")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if encoder(tokenizer).size <= 1 << 16 else 4
        filler = np.full(length, pad, f"<u{width}").tobytes()

        def row(held):
            n = [len(i) // width for _, _, i, _ in held]
            payload = b"".join(i + filler[len(i) :] for _, _, i, _ in held)
            cols = [[held[0][3] // per_shard], [held[0][3]], [len(held)], [length * width], [payload], [[d for d, *_ in held]], [[p for _, p, *_ in held]], [n]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "first_slot", "n_sequences", "stride", "payload", "doc_ids", "pieces", "lengths"])

        held: list = []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "piece", "ids", "slot")), strict=True):
                if held and r[3] // per_shard != held[0][3] // per_shard:
                    yield row(held)
                    held = []
                held.append(r)
        if held:
            yield row(held)

    return ordered.select("doc_id", "piece", "ids", "slot").mapInArrow(write, "shard long, first_slot long, n_sequences long, stride long, payload binary, doc_ids array<long>, pieces array<int>, lengths array<int>")


def write_shards(shards: DataFrame, path: str, mode: str = "error") -> None:
    """path/data/shard=<n>/: one file with the shard's payload as it is, at a fixed stride,
    and a line feed behind it. path/index: the other columns, as Parquet. Spark's writer
    commits the files, on any file system that it can write."""
    made = cut(shards, "op10-shards")
    made.select("shard", F.col("payload").cast("string").alias("value")).write.mode(mode).partitionBy("shard").text(f"{path}/data", lineSep="\n")
    made.drop("payload").repartitionByRange("shard").sortWithinPartitions("shard").write.mode(mode).parquet(f"{path}/index")
    release(made)


def read_from(spark: SparkSession, path: str, slot: int = 0) -> DataFrame:
    """slot, doc_id, piece, n_tokens, ids (binary, padded) from a slot on. Files of shards
    before it are not opened, and the scan of the index skips their rows."""
    index = spark.read.parquet(f"{path}/index")
    first = index.filter("first_slot > 0").select((F.col("first_slot") / F.col("shard")).cast("long")).first()
    shard = slot // first[0] if first else 0
    data = spark.read.format("binaryFile").load(f"{path}/data").filter(F.col("shard") >= shard).select(F.col("shard").cast("long"), "content")
    one = index.filter(F.col("shard") >= shard).join(data, "shard").select("first_slot", "stride", "content", F.posexplode(F.arrays_zip("doc_ids", "pieces", "lengths")).alias("k", "z"))
    out = one.select((F.col("first_slot") + F.col("k")).alias("slot"), "z.doc_ids", "z.pieces", "z.lengths", F.expr("substring(content, cast(k * stride as int) + 1, cast(stride as int))").alias("ids"))
    return out.toDF("slot", "doc_id", "piece", "n_tokens", "ids").filter(F.col("slot") >= slot)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest row for each shard."""
    s = materialise(table(spark, sf_dir, "documents"), default_path(), in_file_order=True)
    return s.select("shard", "first_slot", "n_sequences", "stride", F.length("payload").cast("long").alias("n_bytes"), F.crc32("payload").alias("payload_crc32"), F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n_tokens"), "doc_ids", "pieces")


