"""LM scoring (log-frequency Bloom filter).

The model interpolates bigrams with unigrams. Texts are packed into buckets of some MB, where
they stay. Each bucket sends its distinct words and bigrams with their training counts to
segments of the range of hashes, and gets back what it needs. Unigram counts are summed
exactly. Bigram counts are quantised on a geometric grid; a bigram of level j puts
(bigram, 1) to (bigram, j) into the segment's part of a Bloom filter, so probing levels in
turn until one is missing gives its quantised count. The filter grows with the entries. Up
to MAX_BYTES it is broadcast and probed by the buckets; beyond that the answers to the same
probes, which each segment makes as well, are used, with the same scores. Answers come in
the order of the question, without the hashes. The weight of a bigram depends on how often
its first word occurs and is fitted by EM on all training tokens, each left out in turn:
every bucket counts its tokens by class and by the logarithm of the ratio of the bigram's
probability to the unigram's, in steps of WIDTH.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, in_chunks, is_held, release, table, text_buffers
from .shingles import mix, words

BUCKET_BYTES = 8_000_000
SEGMENT_BYTES = 16_000_000
#: Texts are worked on in pieces of so many bytes, a longer text alone.
CHUNK = 1_000_000
#: Bits of the filter for each entry, hash functions, and most bytes of all segments that
#: are broadcast, as each Python worker holds them; a larger filter is probed by segment.
BITS, HASHES, MAX_BYTES = 12, 4, 64_000_000
GRID = np.unique(np.round(1.5 ** np.arange(60)).astype(np.int64))
U = np.uint64
END, START = U(0x656E64), U(0x7374617274)
#: Classes of the first word's count, and cells of ratios in each: 0 for none, then so wide.
CLASSES, CELLS, WIDTH = 40, 1000, 0.05
PRIOR = 0.2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the row of each."""
    h, row, *_ = words(data, offsets)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    out, at = np.full(len(h) + rows, END), np.repeat(np.arange(rows), n + 1)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(n + 1) - 1] = True
    out[~is_end] = h
    return out, at


def bigrams(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token, and a hash of both (48 bits, as a filter errs more than they do)."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[np.flatnonzero(np.diff(at, prepend=-1))] = START
    return before, mix(before * U(0x9E3779B97F4A7C15) ^ mix(t)) >> U(16)


def counted(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
    if n is None:
        return h[first], np.diff(np.append(first, len(h)))
    return h[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def level(count: np.ndarray) -> np.ndarray:
    """The largest j with GRID[j-1] <= count."""
    return np.searchsorted(GRID, count, side="right")


class Filter:
    """Segments (bits, bytes) by number."""

    def __init__(self, segments: list[tuple[int, np.ndarray]]):
        self.count = len(segments)
        self.first = np.concatenate([[0], np.cumsum([len(b) for _, b in segments])]) * 8
        self.bits = np.array([max(1, n) for n, _ in segments], np.uint64)
        self.bytes = np.concatenate([b for _, b in segments]) if segments else np.zeros(0, np.uint8)

    @staticmethod
    def places(h: np.ndarray, j: int, bits) -> Iterator[np.ndarray]:
        a, b = mix(h + U(j * 0x51ED27)), mix(h ^ U(j * 0xA5A5A5 + 0x77)) | U(1)
        for k in range(HASHES):
            with np.errstate(over="ignore"):
                yield (a + U(k) * b) % bits

    @classmethod
    def build(cls, h: np.ndarray, count: np.ndarray, most_bytes: int | None = None) -> tuple[int, np.ndarray]:
        """One segment of distinct h."""
        j = level(count)
        bits = max(64, BITS * int(j.sum()))
        bits = bits if most_bytes is None else min(bits, 8 * most_bytes)
        out = np.zeros(-(-bits // 8), np.uint8)
        for x in range(1, int(j.max(initial=0)) + 1):
            for p in cls.places(h[j >= x], x, U(bits)):
                np.bitwise_or.at(out, (p >> U(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & U(7)).astype(np.uint8)))
        return bits, out

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Quantised count of each h, 0 if it is not there."""
        seg = (h % U(self.count)).astype(np.int64)
        out, live, j = np.zeros(len(h), np.int64), np.arange(len(h)), 1
        while len(live) and j <= len(GRID):
            bits, first = self.bits[seg[live]], self.first[seg[live]]
            ok = np.ones(len(live), bool)
            for p in self.places(h[live], j, bits):
                at = p.astype(np.int64) + first
                ok &= (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[ok]
            out[live] = GRID[j - 1]
            j += 1
        return out


def _planes(*columns: np.ndarray) -> bytes:
    """Numbers byte by byte of all of them, which compresses zeros and sorted heads away."""
    raw = [c.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _numbers(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view(">u8").ravel().astype(np.uint64) for c in raw]


def _pack(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """bucket, blobs: compressed (doc_id, held, text) tables of at most CHUNK bytes each, a
    longer text alone. A bucket holds texts of one task."""
    d = docs.select("doc_id", is_held(5, 1).alias("held"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, held, size, made = zstandard.ZstdCompressor(level=3), [], 0, TaskContext.get().partitionId() << 32

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([held], pa.list_(pa.binary()))], ["bucket", "blobs"])

        for b in batches:
            offsets = text_buffers(b.column("text"))[1]
            for i, j in in_chunks(offsets, min(CHUNK, bucket_bytes)):
                part = b.slice(i, j - i)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                held.append(z.compress(sink.getvalue()))
                size += int(offsets[j] - offsets[i])
                if size >= bucket_bytes:
                    yield row()
                    held, size, made = [], 0, made + 1
        if held:
            yield row()

    return d.mapInArrow(run, "bucket long, blobs array<binary>")


def _unpack(blobs: Iterator[bytes]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each: the table, its tokens and their rows, the words before, the bigrams, and
    which tokens are for training."""
    for blob in blobs:
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as r:
            b = r.read_next_batch()
        t, at = tokens(*text_buffers(b.column("text")))
        yield b, t, at, *bigrams(t, at), ~np.asarray(b.column("held").to_numpy(zero_copy_only=False))[at]


def _by_segment(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of ascending h by segment, the segments found, and where each begins."""
    seg = (h % U(segments)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    found, first = np.unique(seg[order], return_index=True)
    return order, found, first


ROW = "seg int, kind int, bucket long, blob binary"


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["seg", "kind", "bucket", "blob"])


def _gather(blobs: DataFrame, segments: int) -> DataFrame:
    """Of each segment: the training counts of its words (kind 0) and the filter's counts of
    its bigrams (kind 3), by bucket in the order of the bucket's hashes; its part of the
    filter (kind 1, with the number of bits); the numbers of its training tokens and words
    (kind 2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, own in zip(batch.column("bucket").to_pylist(), batch.column("blobs"), strict=True):
                uni, two, rows = [], [], []
                for _, t, _, _, pair, train in _unpack(own.as_py()):
                    uni.append(counted(t, train.astype(np.int64)))
                    two.append(counted(pair, train.astype(np.int64)))
                for kind, got in ((0, uni), (1, two)):
                    h, n = counted(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
                    order, found, first = _by_segment(h, segments)
                    rows += [(int(g), kind, bucket, _planes(h[o], n[o])) for g, o in zip(found, np.split(order, first[1:]), strict=True)]
                yield from _rows(rows).to_batches()

    def add(group: pa.Table) -> pa.Table:
        seg, rows = group.column("seg")[0].as_py(), []
        sent: dict[int, list] = {0: [], 1: []}
        for kind, bucket, blob in zip(*(group.column(c) for c in ("kind", "bucket", "blob")), strict=True):
            sent[kind.as_py()].append((bucket.as_py(), *_numbers(blob.as_py(), 2)))
        for kind, got in sent.items():
            if not got:
                continue
            h, at = np.unique(np.concatenate([x for _, x, _ in got]), return_inverse=True)
            n = np.zeros(len(h), np.int64)
            np.add.at(n, at, np.concatenate([y for *_, y in got]).astype(np.int64))
            if kind == 0:
                rows.append((seg, 2, 0, _planes(np.array([n.sum(), (n > 0).sum()]))))
            else:
                bits, raw = Filter.build(h[n > 0], n[n > 0])
                rows.append((seg, 1, bits, raw.tobytes()))
                n = Filter([(bits, raw)]).counts(h)
            back = np.split(n[at], np.cumsum([len(x) for _, x, _ in got])[:-1])
            rows += [(seg, 3 * kind, bucket, _planes(x)) for (bucket, *_), x in zip(got, back, strict=True)]
        return _rows(rows)

    return blobs.mapInArrow(count, ROW).groupBy("seg").applyInArrow(add, ROW)


def _answers(h: np.ndarray, t: pa.Table, segments: int) -> np.ndarray:
    """The answer for each hash of a bucket, from rows seg, blob."""
    found, at = np.unique(h, return_inverse=True)
    n = np.zeros(len(found), np.int64)
    if len(found):
        got = sorted(zip(t.column("seg").to_pylist(), t.column("blob"), strict=True), key=lambda x: x[0])
        n[_by_segment(found, segments)[0]] = np.concatenate([_numbers(x.as_py(), 1)[0] for _, x in got]).astype(np.int64)
    return n[at]


def cells(c: np.ndarray, c1: np.ndarray, q: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Numbers of tokens by class and ratio, each token left out of the counts. c: counts
    of the tokens, c1 of the words before, q of both."""
    c, c1 = np.maximum(c - 1, 0), c1 - 1
    q = np.minimum(np.maximum(q - 1, 0), c1)
    use = c1 > 0
    p1, p2 = (c[use] + 0.5) / (total + 0.5 * (kinds + 1)), q[use] / c1[use]
    k = np.minimum(level(c1[use]), CLASSES - 1)
    with np.errstate(divide="ignore"):
        ratio = np.log(p2 / p1)
    cell = np.where(p2 > 0, np.clip(np.floor(np.maximum(ratio, -40) / WIDTH) + CELLS // 2, 1, CELLS - 1), 0).astype(np.int64)
    return np.bincount(k * CELLS + cell, minlength=CLASSES * CELLS)


def fitted(n: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Bigram weights by class from numbers of tokens by class and ratio, by EM."""
    n = n.reshape(CLASSES, CELLS).astype(float)
    ratio = np.exp((np.arange(CELLS) + 0.5 - CELLS // 2) * WIDTH)
    ratio[0] = 0
    weight = np.full(CLASSES, PRIOR)
    for _ in range(rounds):
        a = weight[:, None] * ratio[None]
        share = (n * a / (a + (1 - weight[:, None]))).sum(1)
        weight = (share + 2 * PRIOR) / (n.sum(1) + 2)
    return np.clip(weight, 0.001, 0.95)


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, segment_bytes: int = SEGMENT_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """For each row doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score;
    worked out at once and written.

    The model learns from the rows that are not held out. A null or empty text is its end
    token alone. Ids may be null (never held out) or repeat; each row counts. Without
    training rows all counts are 0. An empty table gives no rows; further columns are
    ignored. A text of any length is read whole.
    """
    spark = df.sparkSession
    docs = documents(df, id_col, text_col)
    size, starts = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 16), F.lit(0)), F.count_if(~is_held(5, 1))).first()
    segments = max(1, -(-size // segment_bytes))
    blobs = cut(_pack(docs, bucket_bytes), "op8-texts")
    gathered = cut(_gather(blobs, segments), "op8-counts")
    total, kinds, parts = 0, 0, [(64, np.zeros(8, np.uint8))] * segments
    for r in gathered.filter("kind = 2").select("blob").toLocalIterator():  # two numbers a segment
        a, b = _numbers(bytes(r.blob), 1)[0]
        total, kinds = total + int(a), kinds + int(b)
    filters = gathered.filter("kind = 1")
    whole = filters.agg(F.coalesce(F.sum(F.octet_length("blob").cast("long")), F.lit(0))).first()[0] <= max_bytes
    for r in filters.select("seg", "bucket", "blob").toLocalIterator() if whole else []:
        parts[r.seg] = (r.bucket, np.frombuffer(bytes(r.blob), np.uint8))
    bloom = spark.sparkContext.broadcast(Filter(parts)) if whole else None
    counts = gathered.filter("kind = 0" if whole else "kind in (0, 3)").select("bucket", "seg", "kind", "blob")

    def each(left: pa.Table, right: pa.Table):
        is_two = np.asarray(right.column("kind").to_numpy()) == 3
        held = [x for own in left.column("blobs") for x in _unpack(own.as_py())]
        none = np.zeros(0, np.uint64)
        counted_words = _answers(np.concatenate([none, *(t for _, t, *_ in held)]), right.filter(pa.array(~is_two)), segments)
        pairs = np.concatenate([none, *(x[4] for x in held)])
        if whole:
            found, place = np.unique(pairs, return_inverse=True)
            counted_pairs = bloom.value.counts(found)[place]
        else:
            counted_pairs = _answers(pairs, right.filter(pa.array(is_two)), segments)
        i = 0
        for b, t, at, before, _, train in held:
            c, q = counted_words[i : i + len(t)], counted_pairs[i : i + len(t)]
            i += len(t)
            c1 = np.empty_like(c)
            c1[1:] = c[:-1]
            c1[before == START] = starts
            yield b, at, train, c, c1, q

    def learn(left: pa.Table, right: pa.Table) -> pa.Table:
        n = np.zeros(CLASSES * CELLS, np.int64)
        for _, _, train, c, c1, q in each(left, right):
            n += cells(c[train], c1[train], q[train], total, kinds)
        cell = np.flatnonzero(n)
        return pa.table({"cell": pa.array(cell, pa.int32()), "n": pa.array(n[cell])})

    texts, looked = blobs.groupBy("bucket"), counts.groupBy("bucket")
    n = np.zeros(CLASSES * CELLS, np.int64)
    for r in texts.cogroup(looked).applyInArrow(learn, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():  # CLASSES x CELLS rows at most
        n[r.cell] = r.n
    weight = fitted(n)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for b, at, _, c, c1, q in each(left, right):
            rows = b.num_rows
            p1 = (c + 0.5) / (total + 0.5 * (kinds + 1))
            w = np.where(c1 > 0, weight[np.minimum(level(c1), CLASSES - 1)], 0.0)
            p = (1 - w) * p1 + w * np.minimum(q, c1) / np.maximum(c1, 1)
            out.append(pa.record_batch([b.column("doc_id"), b.column("held"), pa.array(np.bincount(at, minlength=rows)), pa.array(np.bincount(at[c > 0], minlength=rows)), pa.array(np.full(rows, total)), pa.array(np.bincount(at, np.log10(p1), rows)), pa.array(np.bincount(at, np.log10(p), rows))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out, None if out else schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])
    out = cut(texts.cogroup(looked).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "op8-scores")
    if bloom:
        bloom.destroy()
    release(blobs, gathered)
    return out


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
