"""MinHash near-dedup (BagMinHash).

A document is the multiset of its k-word shingles, and similarity is weighted Jaccard:
sum of least counts over sum of largest counts. BagMinHash draws for each shingle a Poisson
process over time and discretised weight. The weights are cut in dyadic blocks ([0,1),
[1,2), [2,4), [4,8) ...), and a block's process is a hierarchy: its first point falls in one
of its halves, quarters and so on down to a unit of weight, and each half that the point
did not fall in goes on from there with a process of its own. Halves above the shingle's
weight are never followed, and neither are processes past the time that the signature
needs, so a signature costs O(n + m log m) whatever the weights. Each point goes to a
component of the signature, whose value is its earliest point. Signatures are cut in
bands; documents that share a band are candidates and are verified by exact multiset
overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, in_chunks, release, table, text_buffers
from .components import components
from .shingles import mix, shingles, words

K, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
#: A shingle in the prefixes of more nodes than these is compared in blocks of so many.
BLOCK = 1000
CHUNK = 2_000_000
U = np.uint64
MASK = 2**64 - 1


def multisets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, shingle, count, sorted by row and shingle."""
    rows = len(offsets) - 1
    h, row, *_ = words(data, offsets)
    s, at = shingles(h, row, rows, k)
    order = np.lexsort((s, at))
    s, at = s[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return at[first], s[first], np.diff(np.append(first, len(s)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) / 2**53


def bagminhash(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Signatures (rows x m, times of the earliest points; inf in rows without shingles)."""
    sig = np.full((rows, m), np.inf)
    weight = np.bincount(row, count, rows)
    limit = np.where(weight > 0, m * (np.log(m) + 3) / np.maximum(weight, 1), 0)
    open_rows = weight > 0
    while open_rows.any():  # until all components of a row have a value no later than its limit
        own = np.flatnonzero(open_rows[row])
        # the blocks of levels that reach below a shingle's weight: who, first level, width, begin
        who, low, width = [own], [np.zeros(len(own), np.int64)], [np.ones(len(own), np.int64)]
        for b in range(int(count[own].max() - 1).bit_length()):
            has = own[count[own] > 1 << b]
            who.append(has)
            low.append(np.full(len(has), 1 << b))
            width.append(np.full(len(has), 1 << b))
        who, low, width = (np.concatenate(x) for x in (who, low, width))
        time, step = np.zeros(len(who)), np.zeros(len(who), np.uint64)
        while len(who):
            with np.errstate(over="ignore"):
                h = mix(shingle[who] + mix(low.astype(U) * U(0x9E3779B97F4A7C15) ^ (width.astype(U) << U(32))) + step * U(0xD1B54A32D192ED03))
            time = time - np.log(_uniform(h)) / width
            keep = time <= limit[row[who]]
            who, low, width, time, step, h = (x[keep] for x in (who, low, width, time, step, h))
            g = mix(h ^ U(0xC0FFEE))
            level = low + ((g >> U(32)) % width.astype(U)).astype(np.int64)
            part = ((g & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
            ok = level < count[who]
            np.minimum.at(sig, (row[who[ok]], part[ok]), time[ok])
            # the unit that the point fell in goes on, and so does each half beside its way there
            nexts = [(who[ok], level[ok], np.ones(int(ok.sum()), np.int64), time[ok], step[ok] + U(1))]
            half = 1
            while (wide := np.flatnonzero(width > half)).size:
                beside = level[wide] // half * half ^ half
                wide, beside = wide[beside < count[who[wide]]], beside[beside < count[who[wide]]]
                nexts.append((who[wide], beside, np.full(len(wide), half), time[wide], np.zeros(len(wide), np.uint64)))
                half *= 2
            who, low, width, time, step = (np.concatenate(x) for x in zip(*nexts, strict=True))
        open_rows &= np.isinf(sig).any(1)
        limit = np.where(open_rows, limit * 2, 0)
    return sig


def bands_of(sig: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """A 64-bit key of each band."""
    bits = sig.view(np.uint64)
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(depth):
            key = mix(key ^ bits[:, b * depth + r]) * U(0x9E3779B97F4A7C15) + U(r)
        out[:, b] = key
    return out.view(np.int64)


def sketches(docs: DataFrame, k: int, bands: int, depth: int) -> DataFrame:
    """doc_id, mark, node (128-bit digest of the multiset), weight, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in in_chunks(offsets, CHUNK):
                row, s, n = multisets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sig = bagminhash(row, s, n, j - i, bands * depth)
                weight = np.bincount(row, n, j - i).astype(np.int64)
                node = node_of(row, s, n, j - i)
                keys = bands_of(sig, bands, depth)
                has = weight > 0
                ends = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))])
                flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("mark").slice(i, j - i), node, pa.array(weight), flat], ["doc_id", "mark", "node", "weight", "bands"])

    return docs.mapInArrow(run, "doc_id long, mark long, node binary, weight long, bands array<long>")


def node_of(row: np.ndarray, s: np.ndarray, n: np.ndarray, rows: int) -> pa.Array:
    """Equal multisets have equal digests: two sums of mixed (shingle, count)."""
    two = np.zeros((rows, 2), np.uint64)
    with np.errstate(over="ignore"):
        v = mix(s ^ mix(n.astype(np.uint64)))
        np.add.at(two, (row, 0), v)
        np.add.at(two, (row, 1), mix(v ^ U(0xABCDEF)))
    return pa.array([x.tobytes() for x in two], pa.binary())


def bags_of(docs: DataFrame, k: int) -> DataFrame:
    """node and its multiset as sorted shingles and counts, in one binary, of rows whose
    text has that multiset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in in_chunks(offsets, CHUNK):
                row, s, n = multisets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                at = np.searchsorted(row, np.arange(j - i + 1))
                bag = [s[a:b].tobytes() + n[a:b].astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                node = batch.column("node").slice(i, j - i)
                same = pc.equal(node, node_of(row, s, n, j - i))
                yield pa.RecordBatch.from_arrays([node.filter(same), pa.array(bag, pa.binary()).filter(same)], ["node", "bag"])

    return docs.select("node", "text").mapInArrow(run, "node binary, bag binary")


def unbag(bags: DataFrame) -> DataFrame:
    """node, root, shingle s, count n of (node, root, bag)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                raw = part.column("bag").to_pylist()
                size = np.array([len(x) // 12 for x in raw])
                s = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(raw, size, strict=True)])
                n = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(raw, size, strict=True)]).astype(np.int64)
                who = pa.array(np.repeat(np.arange(len(raw)), size))
                yield pa.RecordBatch.from_arrays([part.column("node").take(who), part.column("root").take(who), pa.array(s), pa.array(n)], ["node", "root", "s", "n"])

    return bags.select("node", "root", "bag").mapInArrow(run, "node binary, root binary, s long, n long")


def overlap(a: bytes, b: bytes) -> float:
    n, m = len(a) // 12, len(b) // 12
    x, y = np.frombuffer(a, np.uint64, n), np.frombuffer(b, np.uint64, m)
    c, d = np.frombuffer(a, np.uint32, n, 8 * n), np.frombuffer(b, np.uint32, m, 8 * m)
    at = np.searchsorted(y, x)
    same = np.flatnonzero((at < m) & (y[np.minimum(at, m - 1)] == x)) if m else np.zeros(0, int)
    both = int(np.minimum(c[same], d[at[same]]).sum())
    return both / max(1, int(c.sum()) + int(d.sum()) - both)


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes with a similarity of at least threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.array([overlap(x.as_py(), y.as_py()) >= threshold - 1e-12 for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)], bool)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    left = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    both = left.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a binary, b binary")


def near_duplicates(df: DataFrame, k: int = K, threshold: float = THRESHOLD, bands: int = BANDS, depth: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row doc_id, class_id, class_size, kept, twin (it repeats the kept row's id
    and text), and mark (a hash of its text).

    Classes are the connected components of the links between documents of similarity
    `threshold` or more; class_id is the least id in the class, and the row with it is
    kept, of several such rows one. Equal multisets are one class without a comparison;
    texts without words (null, empty, blank) are equal ones. A text of 1 to k-1 words has
    one shingle. Rows with null ids are compared as all others; a class of such rows only
    has a null id and keeps one of them. Ids may repeat with equal or different texts. An
    empty table gives no rows; further columns are ignored.

    First all members of a band are compared with one leader, the member that meets most
    others in all its bands. What is in one component then needs no more comparisons.
    Members of bands that still span components are compared by among_rare(): no link
    between two of them is lost. What is lost are links of documents that share no band.
    """
    docs = documents(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    sketch = cut(sketches(docs, k, bands, depth), "op1-sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("rep")
    nodes = cut(sketch.groupBy("node").agg(rep, F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "op1-nodes")
    each = nodes.select("node", F.explode("bands").alias("band"))
    size = each.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = cut(each.join(size, "band"), "op1-met")  # bands of two nodes or more
    central = cut(met.groupBy("node").agg(F.sum("size").alias("meets")), "op1-central")
    leader = met.select("node", "band").join(central, "node").groupBy("band").agg(F.max(F.struct("meets", "node")).alias("l"))
    star = met.join(leader, "band").filter("node <> l.node").select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct()
    wanted = nodes.join(central, "node").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.mark").alias("_mark"))
    texts = docs.join(wanted, (F.col("mark") == F.col("_mark")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    bags = cut(bags_of(texts, k), "op1-bags")
    if bags.count() > central.count():  # rows that repeat with id and text
        bags = cut(bags.dropDuplicates(["node"]), "op1-bags")
    links = cut(verified(star, bags, threshold), "op1-links")
    root = cut(components(links, "op1-edges"), "op1-roots")
    more = cut(verified(among_rare(met, nodes, bags, root, threshold), bags, threshold), "op1-links")
    if not more.isEmpty():
        root = cut(components(root.toDF("a", "b").unionByName(more), "op1-edges"), "op1-roots")
    of_node = cut(nodes.select("node", "rep", "copies").join(root, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root")), "op1-of-node")
    release(met, central, bags, links, more, root, nodes)
    classes = of_node.groupBy("root").agg(F.min("rep").alias("first"), F.sum("copies").alias("class_size"))
    of_class = cut(of_node.select("node", "root").join(classes, "root").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.mark").alias("_mark"), "class_size", "root"), "op1-classes")
    release(of_node)
    out = sketch.select("doc_id", "mark", "node").join(of_class, "node").withColumn("first", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("_mark")))
    # of rows that repeat with id and text one is first; other rows are dealt by their own hash
    alike = Window.partitionBy("first", F.when(F.col("first"), F.xxhash64("root")).otherwise(F.xxhash64("doc_id", "mark"))).orderBy(F.lit(0))
    nth = F.row_number().over(alike)
    return out.select("doc_id", "class_id", "class_size", (F.col("first") & (nth == 1)).alias("kept"), (F.col("first") & (nth > 1)).alias("twin"), "mark")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The kept rows of near_duplicates(), as they are in df. Of rows that repeat with id
    and text any one stays."""
    near = cut(near_duplicates(df, id_col=id_col, text_col=text_col, **how).filter("kept or twin").select("doc_id", "mark", "twin"), "op1-kept")
    columns = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(columns))])
    own, mark = F.col(f"_{columns.index(id_col)}").cast("long"), F.xxhash64(F.coalesce(f"_{columns.index(text_col)}", F.lit("")))
    out = plain.join(near, own.eqNullSafe(F.col("doc_id")) & (mark == F.col("mark")), "left_semi")
    if not near.filter("twin").isEmpty():
        out = out.withColumn("nth", F.row_number().over(Window.partitionBy(own, mark).orderBy(F.lit(0)))).filter("nth = 1").drop("nth")
    return out.toDF(*columns)


def among_rare(met: DataFrame, nodes: DataFrame, bags: DataFrame, root: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of nodes of different components, in bands that span components,
    that may be similar, by prefix filter. Only shingles that several components have
    count. From the rarest to the most frequent, the first one that two similar documents
    share has enough weight behind it in both: threshold / (1 + threshold) of their total.
    A shingle's pairs are those of its members outside its largest component with all;
    shingles with many members are compared in blocks."""
    m = met.select("band", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    m = cut(m, "op1-rooted")
    wide = m.groupBy("band").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l <> _h").select("band")
    opened = m.join(wide, "band").select("node", "root").distinct().join(nodes.select("node", "weight"), "node")
    opened = cut(opened, "op1-open")
    cells = cut(unbag(bags.join(opened.select("node", "root"), "node")), "op1-cells")
    several = cells.groupBy("s").agg(F.min("root").alias("_l"), F.max("root").alias("_h"), F.count(F.lit(1)).alias("f")).filter("_l <> _h").select("s", "f")
    onward = Window.partitionBy("node").orderBy(F.desc("f"), F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = cells.join(several, "s").withColumn("ahead", F.sum("n").over(onward)).join(opened.select("node", "weight"), "node")
    prefix = cut(ahead.filter(F.col("ahead") >= threshold * F.col("weight") - 1e-9).select("s", "node", "root", "weight", "ahead"), "op1-prefixes")
    by_root = prefix.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c"))
    of_s = by_root.groupBy("s").agg(F.count(F.lit(1)).alias("_r"), F.max(F.struct("c", "root")).alias("_m"), F.sum("c").alias("_n"))
    of_s = of_s.filter("_r > 1").select("s", F.col("_m.root").alias("major"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    p = prefix.join(of_s, "s").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = p.filter("root <> major").drop("blocks", "major")
    y = p.select("s", F.col("other").alias("own"), F.col("own").alias("other"), *[F.col(c).alias(f"{c}_y") for c in ("node", "root", "weight", "ahead")])
    enough = F.least("ahead", "ahead_y") >= threshold / (1 + threshold) * (F.col("weight") + F.col("weight_y")) - 1e-9
    like = F.least("weight", "weight_y") >= threshold * F.greatest("weight", "weight_y") - 1e-9
    pairs = x.join(y, ["s", "own", "other"]).filter(enough & like & (F.col("root") != F.col("root_y")))
    return pairs.select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct()


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
