"""Toxicity (linear-chain conditional random field over words).

Words of labelled documents get labels by weak supervision: a greedy cover picks the word
and affix features that account for toxic training documents and scarcely occur in clean
ones; words with such a feature in a toxic document are toxic tokens. A two-state CRF
learns from these tokens, with emission weights on hashed features of a word and a
transition matrix. Its sequences are sentences. Forward-backward gives each word's
marginal; a document's score is the largest one, and words of at least 0.5 are its spans.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, is_held, pick, table

#: At most so many labelled documents of each class train the model.
TRAIN_DOCS = 1500
#: Hashed feature weights.
DIM = 1 << 18
#: Words whose scores a worker remembers.
MEMO = 100_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """Of a lower-case word: itself, and its prefixes and suffix."""
    return ["w" + word, *(f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n), *(f"s{word[-n:]}" for n in (3,) if len(word) > n)]


def slots(word: str) -> list[int]:
    from zlib import crc32

    return [crc32(f.encode()) & (DIM - 1) for f in features(word)]


def toxic_features(texts: list[str], labels: list[int], least: int = 5, purity: float = 0.98) -> set[str]:
    """Features in so few clean texts that those with them are toxic for a share of at
    least purity; each picked for most toxic texts that none explains so far, and for
    at least as many as least, and a hundredth of the toxic ones. Of features with equal counts, the shortest."""
    least = max(least, sum(labels) // 100)
    clean, holds, texts_of = Counter(), defaultdict(list), []
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        found = {f for w in set(WORD.findall(text.lower())) for f in features(w)}
        if label:
            for f in found:
                holds[f].append(i)
        else:
            clean.update(found)
        texts_of.append(found if label else None)
    fit = {f for f, v in holds.items() if len(v) >= least and len(v) / (len(v) + clean[f]) >= purity}
    left = Counter({f: len(holds[f]) for f in fit})
    chosen, covered = set(), set()
    while left:
        best = min(left, key=lambda f: (-left[f], clean[f], len(f), f))
        if left[best] < least:
            break
        chosen.add(best)
        for i in holds[best]:
            if i not in covered:
                covered.add(i)
                for f in texts_of[i]:
                    if f in left:
                        left[f] -= 1
        del left[best]
    return chosen


@dataclass
class Model:
    weights: np.ndarray  # of the toxic state, by feature slot
    bias: float
    edge: np.ndarray  # 2 x 2 transition scores


def marginals(unary: np.ndarray, edge: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward for many chains laid end to end. unary: score of state 1 over
    state 0 at each place. Gives P(state 1) of each place, and for each place but a
    chain's first the 2 x 2 pair marginals with the place before (zero at the first)."""
    n, chains = len(unary), len(lengths)
    p, pair = np.zeros(n), np.zeros((n, 2, 2))
    if not n:
        return p, pair
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    emit = np.exp(np.stack([-np.logaddexp(0, unary), unary - np.logaddexp(0, unary)], 1))
    step = np.exp(edge)
    alpha, beta = np.zeros((n, 2)), np.ones((n, 2))
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    for t in range(int(size[0])):
        at = first[: alive[t]] + t
        a = emit[at] if not t else (alpha[at - 1] @ step) * emit[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(int(size[0]) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        b = (emit[at + 1] * beta[at + 1]) @ step.T
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    p = both[:, 1] / both.sum(1)
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    joint = alpha[at - 1][:, :, None] * step[None] * (emit[at] * beta[at])[:, None, :]
    pair[at] = joint / joint.sum((1, 2), keepdims=True)
    return p, pair


def train_crf(sentences: list[list[str]], tags: list[list[int]], epochs: int = 4, rate: float = 0.5, l2: float = 1e-6, batch: int = 256, seed: int = 7) -> Model:
    """Adagrad on the conditional log-likelihood."""
    memo: dict[str, np.ndarray] = {}
    of = lambda w: memo.setdefault(w, np.asarray(slots(w))) if w not in memo else memo[w]
    weights, bias, edge = np.zeros(DIM), -2.0, np.zeros((2, 2))
    gw, gb, ge = np.full(DIM, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        order = rng.permutation(len(sentences))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            cells = [of(w) for k in part for w in sentences[k]]
            y = np.array([t for k in part for t in tags[k]], float)
            lengths = np.array([len(sentences[k]) for k in part])
            sizes = np.array([len(c) for c in cells])
            flat, who = np.concatenate(cells), np.repeat(np.arange(len(cells)), sizes)
            unary = np.bincount(who, weights[flat], len(cells)) + bias
            p, pair = marginals(unary, edge, lengths)
            miss = y - p
            first = np.zeros(len(y), bool)
            first[np.cumsum(lengths) - lengths] = True
            seen = np.zeros((2, 2))
            now, past = y[1:][~first[1:]].astype(int), y[:-1][~first[1:]].astype(int)
            np.add.at(seen, (past, now), 1)
            touched, inv = np.unique(flat, return_inverse=True)
            g = np.bincount(inv, miss[who]) - l2 * weights[touched]
            gw[touched] += g * g
            weights[touched] += rate * g / np.sqrt(gw[touched])
            d = miss.sum()
            gb += d * d
            bias += rate * d / np.sqrt(gb)
            e = seen - pair.sum(0) - 1e-4 * edge
            ge += e * e
            edge += rate * e / np.sqrt(ge)
    return Model(weights, float(bias), edge)


def fit(texts: list[str], labels: list[int]) -> Model:
    """From whole labelled texts: their sentences with a toxic word, and 15 % of the others. Without toxic ones no word is toxic."""
    cues = toxic_features(texts, labels)
    sentences, tags = [], []
    rng = np.random.Generator(np.random.PCG64(3))
    for text, label in zip(texts, labels, strict=True):
        for s in SENTENCE.findall(text.lower()):
            words = WORD.findall(s)
            if not words:
                continue
            tag = [int(bool(label) and not cues.isdisjoint(features(w))) for w in words]
            if any(tag) or rng.random() < 0.15:
                sentences.append(words)
                tags.append(tag)
    return train_crf(sentences, tags) if any(map(any, tags)) else Model(np.zeros(DIM), -12.0, np.zeros((2, 2)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, {}

    def unary(self, word: str) -> float:
        u = self.memo.get(word)
        if u is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = u = float(self.model.weights[slots(word)].sum()) + self.model.bias
        return u

    def texts(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """Score and toxic spans (first and last-plus-one character, marginal) of each."""
        unary, lengths, rows = [], [], []
        for row, text in enumerate(texts):
            low = text.lower()
            for s in SENTENCE.findall(low):
                if words := WORD.findall(s):
                    unary += map(self.unary, words)
                    lengths.append(len(words))
                    rows.append(row)
        score = np.zeros(len(texts))
        if not unary:
            for _ in texts:
                yield 0.0, []
            return
        lengths, rows = np.array(lengths), np.array(rows)
        p, _ = marginals_only(np.array(unary), self.model.edge, lengths)
        np.maximum.at(score, np.repeat(rows, lengths), p)
        for row, text in enumerate(texts):
            spans = []
            if score[row] >= 0.5:
                a, b = np.searchsorted(rows, [row, row + 1])
                k = int(lengths[:a].sum())
                low = text.lower()
                text_words = (m for s in SENTENCE.finditer(low) for m in WORD.finditer(low, s.start(), s.end()))
                for m in text_words if len(low) == len(text) else ():
                    if p[k] >= 0.5:
                        spans.append((m.start(), m.end(), float(p[k])))
                    k += 1
            yield float(score[row]), spans


def marginals_only(unary: np.ndarray, edge: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, None]:
    """As marginals(), in ratios and without pairs: r is P(1)/P(0) of what lies before
    (or behind), so each step is one division."""
    n = len(unary)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    e = np.exp(np.clip(unary, -60, 60))
    t = np.exp(edge)
    fore, back = np.empty(n), np.ones(n)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    r = np.ones(len(size))
    for k in range(int(size[0])):
        m = alive[k]
        at = first[:m] + k
        if k:
            q = r[:m]
            r = (t[0, 1] + q * t[1, 1]) / (t[0, 0] + q * t[1, 0]) * e[at]
        else:
            r = e[at]
        fore[at] = r
    for k in range(int(size[0]) - 2, -1, -1):
        at = first[: alive[k + 1]] + k
        q = e[at + 1] * back[at + 1]
        back[at] = (t[1, 0] + t[1, 1] * q) / (t[0, 0] + t[0, 1] * q)
    odds = fore * back
    return odds / (1 + odds), None


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """From labelled rows outside the held-out fold: of each class the train_docs distinct
    texts with the smallest hashes of their ids."""
    d = documents(docs, id_col, text_col)
    lab = pick(labels, id_col, "toxic").toDF("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~is_held(5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    taken = None
    for label in (0, 1):
        some = lab.filter(F.col("toxic") == label).orderBy(*order).limit(train_docs)
        taken = some if taken is None else taken.unionByName(some)
    # one task fits the bounded sample: the driver holds no texts, and another executor can redo it
    sample = d.join(F.broadcast(taken), "doc_id").select("toxic", "text", "doc_id").repartition(1)
    kinds = {"weights": pa.binary(), "bias": pa.float64(), "edge": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unique = {}
        for b in batches:
            for label, text, doc_id in zip(*(b.column(c).to_pylist() for c in ("toxic", "text", "doc_id")), strict=True):
                if text not in unique or unique[text][1] > doc_id:
                    unique[text] = (int(label), doc_id)
        ordered = sorted(unique.items(), key=lambda x: (x[1][1], x[0]))
        m = fit([t for t, _ in ordered], [v[0] for _, v in ordered])
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((m.weights.tobytes(), m.bias, m.edge.tobytes()), kinds.values(), strict=True)], list(kinds))

    row = sample.mapInArrow(run, "weights binary, bias double, edge binary").first()
    if row is None:
        return fit([], [])
    return Model(np.frombuffer(bytes(row.weights)), row.bias, np.frombuffer(bytes(row.edge)).reshape(2, 2))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row doc_id, held_out, score, predicted and spans (start, end in characters,
    marginal).

    Null and empty texts, and those without words, score 0. Each row is scored by itself,
    so ids may repeat or be null. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>"
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                got = list(scorer.texts(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([[{"start": a, "end": e, "p": p} for a, e, p in sp] for _, sp in got], spans)], ["doc_id", "score", "spans"])

    out = documents(docs, id_col, text_col).mapInArrow(run, schema)
    return out.select("doc_id", is_held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
