"""Line dedup (deletion-neighbourhood join), by DataFrame operations alone.

Two lines are near copies when one edit of a word (a word put in, left out or replaced)
makes them equal. Lines are split and hashed once, written, and reduced to distinct ones.
A line's neighbourhood is the line itself and each variant with one word deleted; equal
variants join lines one edit apart. Since an edit leaves the words outside one half as they
are, and those outside one quarter, only lines that share such a rest with another line
need variants at all. A variant's key is the XOR of hashes of (word, place), so the prefix
and suffix sums of one window give all of a line's keys in one pass. Joined lines are
verified word by word, and the earliest stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, release, sieved, table

#: A line of fewer words has no near copies by definition, as one edit would be over a fifth
#: of it (a similarity of 0.8 at least is asked for); its exact copies count.
LEAST_WORDS = 5


def keys(line: Column) -> list[Column]:
    """k1, k2: 128 bits that stand for the line."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, no (from 0), line: the text split at line feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def word_list(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(line, "\t\r\f\x0b", "    "), " "), "")


def rests(w: Column, parts: int) -> list[Column]:
    """Hashes of a line's words but for one of so many parts, for each part, cut for itself
    and for a partner with one word less."""
    n, out = F.size(w), []
    for m in (n, n - 1):  # of the shorter line of a pair, or of both
        for q in range(parts):
            before, behind = F.floor(m * q / parts).cast("int"), (m - F.floor(m * (q + 1) / parts)).cast("int")
            out.append(F.xxhash64(F.lit(q), m, F.slice(w, F.lit(1), before), F.slice(w, n - behind + 1, behind)))
    return out


def partnered(rest: DataFrame) -> DataFrame:
    """k1 of lines that share a rest with another one, of (k1, rests). Equal lines count as one."""
    each = rest.select("k1", F.explode("rests").alias("rest"))
    shared = cut(each.groupBy("rest").agg(F.min("k1").alias("_l"), F.max("k1").alias("_h")).filter("_l <> _h").select("rest"), "op9-rests")
    out = cut(sieved(each, F.col("rest"), shared).join(shared, "rest").select("k1").distinct(), "op9-partnered")
    release(shared)
    return out


def variants(lines: DataFrame) -> DataFrame:
    """key, first, n, cut (place of the deleted word, 0 for none), variant."""
    words = lines.select("key", "first", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
    here, left = F.xxhash64("word", "at"), F.xxhash64("word", F.col("at") - 1)
    by = Window.partitionBy("key").orderBy("at")
    words = words.select("key", "first", "n", "at", here.alias("here"), left.alias("left"))
    before = F.coalesce(F.bit_xor("here").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    all_left, to = F.bit_xor("left").over(Window.partitionBy("key")), F.bit_xor("left").over(by.rowsBetween(Window.unboundedPreceding, 0))
    full = before.bitwiseXOR(F.col("here"))
    rows = words.select("key", "first", "n", "at", before.bitwiseXOR(all_left.bitwiseXOR(to)).alias("less"), full.alias("full"))
    one = F.array(F.struct((F.col("at") + 1).alias("cut"), F.xxhash64(F.col("n") - 1, "less").alias("variant")))
    whole = F.when(F.col("at") == F.col("n") - 1, F.array(F.struct(F.lit(0).alias("cut"), F.xxhash64("n", "full").alias("variant"))))
    return rows.select("key", "first", F.inline(F.concat(one, F.coalesce(whole, F.array().cast("array<struct<cut:int,variant:bigint>>"))))).select("key", "first", "cut", "variant")


def within_one_edit(a: Column, b: Column) -> Column:
    """Of two lists of words."""
    def less(w: Column, i: Column) -> Column:
        return F.when(i == 0, w).otherwise(F.concat(F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, F.size(w))))

    return less(a, F.col("cut")) == less(b, F.col("other_cut"))


def near_copies(lines: DataFrame) -> DataFrame:
    """key, near (first place of the earliest line one edit away that comes before it),
    of lines (key, first, w)."""
    v = cut(variants(lines), "op9-variants")
    # fixed-width first: variants of one line only go before lines are compared by place
    pair = cut(v.select("variant", F.xxhash64("key").alias("h")).groupBy("variant").agg(F.min("h").alias("_l"), F.max("h").alias("_h")).filter("_l <> _h").select("variant"), "op9-pairs")
    v = cut(sieved(v, F.col("variant"), pair).join(pair, "variant").select("key", "first", "cut", "variant"), "op9-variants")
    # the earliest line of each variant: by deleted place for replaced words, without one for words left out
    at = v.groupBy("variant", "cut").agg(F.min(F.struct("first", "key")).alias("m"))
    by_place = v.filter("cut > 0").join(at, ["variant", "cut"]).select("key", "first", "cut", "m", F.col("cut").alias("other_cut"))
    by_whole = v.filter("cut > 0").join(at.filter("cut = 0").drop("cut"), "variant").select("key", "first", "cut", "m", F.lit(0).alias("other_cut"))
    longer = at.filter("cut > 0").groupBy("variant").agg(F.min(F.struct("m", F.col("cut").alias("c"))).alias("x"))
    by_longer = v.filter("cut = 0").join(longer, "variant").select("key", "first", "cut", F.col("x.m").alias("m"), F.col("x.c").alias("other_cut"))
    pairs = by_place.unionByName(by_whole).unionByName(by_longer).filter(F.col("m.first") < F.col("first"))
    best = pairs.groupBy("key", F.col("m.key").alias("other")).agg(F.min(F.struct("cut", "other_cut")).alias("c")).select("key", "other", "c.cut", "c.other_cut")
    words = lines.select("key", "first", "w")
    full = best.join(words.select("key", "w"), "key").join(words.select(F.col("key").alias("other"), F.col("first").alias("other_first"), F.col("w").alias("other_w")), "other")
    return full.filter(within_one_edit(F.col("w"), F.col("other_w"))).groupBy("key").agg(F.min("other_first").alias("near"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and removed (ascending numbers of lines, from 0) of rows that lose lines.

    A line goes when an equal line, or one with at least LEAST_WORDS words that is one
    edit of a word away, comes earlier: in a document with a smaller id, or higher up in
    the same one. The earlier line counts whether or not it goes itself. Words are runs
    without blanks, tabs, carriage returns, form and line feeds. Lines without words are
    never removed. A null text has no lines but an empty one. Rows with a null id come
    before all others, and rows with the same id count as one document: a line repeated
    in them at the same place goes from none of them. An empty table gives no rows.
    """
    docs = documents(df, id_col, text_col)
    split = lines_of(docs).select("doc_id", "no", *keys(F.col("line")), word_list(F.col("line")).alias("w")).filter(F.size("w") > 0)
    lines = cut(split.select("doc_id", "no", "k1", "k2", F.when(F.size("w") >= LEAST_WORDS, F.array(*rests(F.col("w"), 2))).alias("rests")), "op9-lines")
    place = F.struct("doc_id", "no")
    exact = lines.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("rests").alias("rests"))
    exact = cut(exact.select("k1", "k2", "first", (F.col("first") < F.col("last")).alias("several"), "rests"), "op9-distinct")
    # text is moved for lines that may have near copies only
    some = partnered(exact.filter("rests is not null").select("k1", "rests"))
    own = keys(F.col("line"))
    texts = sieved(lines_of(docs).select("line", *own), F.col("k1"), some).join(some, "k1").groupBy("k1", "k2").agg(F.first("line").alias("line"))
    texts = cut(texts.join(exact.select("k1", "k2", "first"), ["k1", "k2"]).select("k1", F.struct("k1", "k2").alias("key"), "first", word_list(F.col("line")).alias("w")).filter(F.size("w") >= LEAST_WORDS).withColumn("rests", F.array(*rests(F.col("w"), 4))), "op9-texts")
    closer = partnered(texts.select("k1", "rests"))
    near = cut(near_copies(cut(texts.join(closer, "k1").select("key", "first", "w"), "op9-closer")).select("key.k1", "key.k2", "near"), "op9-near")
    verdict = cut(exact.select("k1", "k2", "first", "several").join(near, ["k1", "k2"], "left").filter("several or near is not null"), "op9-verdicts")
    hit = sieved(lines.select("doc_id", "no", "k1", "k2"), F.col("k1"), verdict.select("k1")).join(verdict, ["k1", "k2"]).filter(F.col("near").isNotNull() | (F.col("first") < place))
    release(exact, some, texts, closer, near)
    return hit.select("doc_id", "no").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("no")).alias("removed"))


def stripped(df: DataFrame, removed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df with its columns by number, these lines taken out of its texts, and _removed."""
    columns = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(columns))])
    at, text = f"_{columns.index(id_col)}", f"_{columns.index(text_col)}"
    # split below the join, so that the lambda finds an array and doesn't split anew for each line
    out = plain.withColumn(text, F.split(text, "\n")).join(removed.toDF("_id", "_removed"), F.col(at).cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")
    stay = F.array_except(F.sequence(F.lit(0), F.size(text) - 1), "_removed")
    left = F.transform(stay, lambda i: F.get(text, i))
    return out.withColumn(text, F.array_join(F.when(F.col("_removed").isNull(), F.col(text)).otherwise(left), "\n"))


def without_lines(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with these lines taken out of its texts; all rows and columns stay."""
    return stripped(df, removed, id_col, text_col).drop("_removed").toDF(*df.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: doc_id, removed, n_removed, and the length and digest of what stays."""
    docs = table(spark, sf_dir, "documents")
    left = stripped(documents(docs), line_dedup(docs), "doc_id", "text").toDF("doc_id", "text", "removed")
    none = F.array().cast("array<int>")
    return left.select("doc_id", F.coalesce("removed", none).alias("removed"), F.coalesce(F.array_size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
