"""Benchmark decontamination (size-partitioned MinHash containment search).

Test items are partitioned by their number of shingles, [2^j, 2^(j+1)) each. For such a
class, documents are read in windows of 2^(j+2) shingles, each starting 2^(j+1) after the
last, so that every stretch as long as an item lies within a window, and the sizes of the
two sets differ by a bounded factor however long the document is. Windows and items get
one-permutation MinHash sketches: 64 bins, each with its smallest hash. An item and a
document are candidates when a window and the item agree in a bin, and are verified by
the exact share of the item's distinct shingles that the whole document holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_chunks, pick, table, text_buffers, where_id
from .shingles import mix, shingles, words

K, THRESHOLD = 5, 0.8
BINS = 64
#: Items are broadcast in blocks of at most so many shingles (8 bytes each), plus one item.
BLOCK_SHINGLES = 1_000_000
CHUNK = 2_000_000
SEED = np.uint64(0x5EED0B17)


@dataclass
class Block:
    """Items of one pass. flat holds the sorted distinct shingles of item i at
    first[i]:first[i+1]; sketch has, by size class, sorted bin keys and the items of each."""

    ids: np.ndarray
    first: np.ndarray
    flat: np.ndarray
    sketch: dict[int, tuple[np.ndarray, np.ndarray]]


def bin_keys(hashed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each (place, bin) that has a hash: the place, and a key of bin and least hash."""
    h = mix(hashed ^ SEED)
    order = np.lexsort((h, place * BINS + (h % np.uint64(BINS)).astype(np.int64)))
    cell = (place * BINS + (h % np.uint64(BINS)).astype(np.int64))[order]
    least = np.ones(len(cell), bool)
    least[1:] = cell[1:] != cell[:-1]
    return cell[least] // BINS, h[order][least]  # the low bits of the hash are its bin


def item_shingles(text: str, k: int) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    h, row, *_ = words(raw, np.array([0, len(raw)]))
    return np.unique(shingles(h, row, 1, k)[0])


def blocks(items: Iterator[tuple[int, str]], k: int = K, most: int = BLOCK_SHINGLES) -> Iterator[Block]:
    ids, sets, size = [], [], 0

    def made() -> Block:
        sizes = np.array([len(s) for s in sets])
        sketch = {}
        for j in sorted({int(n).bit_length() - 1 for n in sizes}):
            own = np.flatnonzero((sizes >= 1 << j) & (sizes < 1 << (j + 1)))
            at, key = bin_keys(np.concatenate([sets[i] for i in own]), np.repeat(own, sizes[own]))
            order = np.argsort(key, kind="stable")
            sketch[j] = key[order], at[order]
        return Block(np.array(ids, np.int64), np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(sets), sketch)

    for i, text in items:
        s = item_shingles(text or "", k)
        if not len(s):
            continue
        if ids and size + len(s) > most:
            yield made()
            ids, sets, size = [], [], 0
        ids.append(i)
        sets.append(s)
        size += len(s)
    if ids:
        yield made()


def windows(n: np.ndarray, first: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of class j over rows of n shingles that start at first: starts and lengths."""
    wide, step = 1 << (j + 2), 1 << (j + 1)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - wide) // step)), 0)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[row] + nth * step, np.minimum(wide, n[row] - nth * step)


def matches(data: np.ndarray, offsets: np.ndarray, block: Block, k: int, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of the pairs found in these texts."""
    rows = len(offsets) - 1
    h, row, *_ = words(data, offsets)
    sh, at = shingles(h, row, rows, k)
    n = np.bincount(at, minlength=rows)
    first = np.cumsum(n) - n
    pairs = set()
    hashed = mix(sh ^ SEED)
    for j, (keys, items) in block.sketch.items():
        # only a hash that is some item's least in its bin can make a window agree with it
        hit = np.flatnonzero(np.isin(hashed, keys))
        if not len(hit):
            continue
        start, length = windows(n, first, j)
        low = np.searchsorted(start + length, hit, side="right")  # both rise over all windows
        high = np.searchsorted(start, hit, side="right")
        which = np.repeat(np.arange(len(hit)), high - low)
        w = np.repeat(low, high - low) + np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        need = np.unique(w)
        inner = np.repeat(start[need], length[need]) + np.arange(int(length[need].sum())) - np.repeat(np.cumsum(length[need]) - length[need], length[need])
        place, least = bin_keys(sh[inner], np.repeat(need, length[need]))
        a, b = np.searchsorted(keys, least, side="left"), np.searchsorted(keys, least, side="right")
        for x in np.flatnonzero(b > a):
            r = int(at[start[place[x]]])
            pairs.update((r, int(i)) for i in items[a[x] : b[x]])
    own: dict[int, np.ndarray] = {}
    for r, i in sorted(pairs):
        if r not in own:
            own[r] = np.unique(sh[first[r] : first[r] + n[r]])
        q = block.flat[block.first[i] : block.first[i + 1]]
        shared = int(np.isin(q, own[r], assume_unique=True).sum())
        if shared >= threshold * len(q) - 1e-9:
            yield r, i, shared


def contained_items(df: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of each document that holds at
    least `threshold` of an item's distinct k-word shingles.

    An item of 1 to k-1 words is one shingle, which is found in texts of those same words
    only. Null and empty items and texts match nothing. Rows of either table that repeat,
    or have null ids, match one by one. Empty tables give no rows; further columns are
    ignored. However large the benchmark, it is used in blocks of bounded size.
    """
    spark = df.sparkSession
    docs = documents(df, id_col, text_col)
    items = pick(benchmark, item_col, text_col).select(F.col(item_col).cast("long"), text_col).filter(F.col(text_col).isNotNull())
    schema = "doc_id long, item_id long, n_shared long, n_shingles long, containment double"
    out = spark.createDataFrame([], schema)
    # a null id goes along as the least long
    rows = ((-(2**63) if r[0] is None else r[0], r[1]) for r in items.toLocalIterator())
    for block in blocks(rows, k):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                data, offsets = text_buffers(batch.column("text"))
                ids = batch.column("doc_id")
                for i, j in in_chunks(offsets, CHUNK):
                    found = list(matches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], b, k, threshold))
                    if found:
                        r, q, s = (np.array(c) for c in zip(*found, strict=True))
                        size = b.first[q + 1] - b.first[q]
                        item = b.ids[q]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + i)), pa.array(item, pa.int64(), mask=item == -(2**63)), pa.array(s, pa.int64()), pa.array(size, pa.int64()), pa.array(s / size)], ["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def decontaminate(df: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of df, as they are, that hold no item. Rows without an id are tested as
    well; one that holds an item takes all rows without an id with it."""
    return where_id(df, contained_items(df, benchmark, **how).select("doc_id"), "left_anti", how.get("id_col", "doc_id"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = """
WITH w AS (SELECT item_id AS id, true AS item, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM benchmark
           UNION ALL
           SELECT doc_id, false, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') FROM documents),
     s AS (SELECT DISTINCT id, item, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w WHERE len(w) > 0),
     n AS (SELECT id, count(*) AS n FROM s WHERE item GROUP BY id),
     m AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared FROM s q JOIN s d ON q.s = d.s WHERE q.item AND NOT d.item GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_shingles, n_shared / n AS containment
FROM m JOIN n ON n.id = item_id WHERE n_shared >= 0.8 * n - 1e-9
"""
