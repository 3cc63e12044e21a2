"""Best-fit packing (configuration linear program).

Pieces of at most `size` tokens go into as few sequences as can be. Only the histogram of
lengths matters for that, and it has at most `size` entries at any scale: the driver
solves the configuration LP over it by multiplicative weights, pricing configurations with
a knapsack dynamic program, rounds the solution, and packs the few pieces that rounding
leaves by best fit. The plan, a table of (length, range of ranks) -> (sequence, offset), is applied to the
pieces by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, table
from .tokens import default_path, encoder

SIZE = 1024
END = 2
#: The program is priced in so many rounds at most, or until the cover is so close to the
#: bound; each round takes so many steps of the weights, whose past counts by DAMPING.
ROUNDS, GAP, STEPS, DAMPING = 60, 0.003, 120, 0.05

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """start and length of the pieces of n tokens: all but the first have `size`."""
    first = (n - 1) % size + 1
    return [(0, first), *((i, size) for i in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces of documents(docs); rank counts pieces of equal length in one task (part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, part = encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        tail = np.asarray([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = enc.ids(text.as_py()) + tail
                for k, (start, n) in enumerate(cuts(len(ids) // 4, size)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.mapInArrow(run, PIECES)


def price(value: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """best: the largest total value of lengths (repeats allowed) that fit in 0..size, by
    dynamic programming over the capacity; pick: the place of one of them, -1 for none.
    Of equal values the largest length is picked."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(int(lengths[0]), size + 1):
        gain = (best[c - lengths[: fits[c]]] + value[: fits[c]])[::-1]
        k = int(np.argmax(gain))
        best[c], pick[c] = (gain[k], fits[c] - 1 - k) if gain[k] > best[c - 1] else (best[c - 1], -1)
    return best, pick


def filled(first: int, pick: np.ndarray, lengths: np.ndarray, most: np.ndarray, size: int) -> tuple[tuple[int, int], ...]:
    """The configuration of one piece of lengths[first] and the best filling of its rest,
    with no more of a length than there are: sorted (place of the length, pieces)."""
    out, c = Counter({first: 1}), size - int(lengths[first])
    while c > 0:
        k = int(pick[c])
        if k < 0:
            c -= 1
        else:
            if out[k] < most[k]:
                out[k] += 1
            c -= int(lengths[k])
    return tuple(sorted(out.items()))


def solve(histogram: dict[int, int], size: int, rounds: int = ROUNDS, gap: float = GAP) -> tuple[list[tuple[Counter, float]], float]:
    """Fractional (configuration, sequences) pairs that cover the histogram, and a lower
    bound on any covering, from the duals.

    It starts from a cover by configurations of one length each. Every round prices all
    configurations by the knapsack program for the weights of the lengths, adds the best
    one around each length, and lets weights act on both sides: a length's weight is
    multiplied by a power of demand over coverage, a configuration's share by the value of
    what it holds. The weights, scaled by the dearest configuration, are a dual solution.
    It ends when the cover is within `gap` of the best bound."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], float)
    alone = np.minimum(size // lengths, demand)
    known: dict[tuple, int] = {}
    row, col, times, share = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

    def add(configs: list[tuple], shares: list[float]) -> None:
        nonlocal row, col, times, share
        new = [(c, x) for c, x in dict(zip(configs, shares, strict=True)).items() if c not in known]
        cells = [(i, len(known) + j, n) for j, (c, _) in enumerate(new) for i, n in c]
        known.update({c: len(known) + j for j, (c, _) in enumerate(new)})
        if cells:
            i, j, n = zip(*cells, strict=True)
            row, col, times = np.append(row, i), np.append(col, j), np.append(times, n)
            share = np.append(share, [x for _, x in new])

    add([((i, int(n)),) for i, n in enumerate(alone)], (demand / alone).tolist())
    base = lengths / size
    weight, bound, best_cover, kept, best_known = base, 0.0, np.inf, share, list(known)
    for _ in range(rounds):
        best, pick = price(weight, lengths, size)
        bound = max(bound, float(demand @ weight / best[size]))
        if best_cover <= bound * (1 + gap):
            break
        add([filled(i, pick, lengths, demand, size) for i in range(len(lengths))], (0.1 * demand).tolist())
        mean = np.zeros(len(lengths))
        for _ in range(STEPS):
            ratio = demand / np.bincount(row, times * share[col], len(lengths))
            weight = base * ratio
            share = share * np.clip(np.bincount(col, times * weight[row], len(share)), 0.2, 5)
            base = base * ratio**DAMPING
            mean += weight / STEPS
        weight = mean
        # a cover: what is still missing is made up by configurations of one length
        missing = np.maximum(demand - np.bincount(row, times * share[col], len(lengths)), 0) / alone
        full = share.copy()
        full[: len(lengths)] += missing
        if full.sum() < best_cover:
            best_cover, kept = float(full.sum()), full
            best_known = list(known)
        # shares that have died out go, but for the configurations of one length
        live = (share > 1e-6) | (np.arange(len(share)) < len(lengths))
        place = np.cumsum(live) - 1
        known = {c: i for i, c in enumerate(c for c, ok in zip(known, live, strict=True) if ok)}
        cells = live[col]
        row, col, times, share = row[cells], place[col[cells]], times[cells], share[live]
    return [(Counter({int(lengths[i]): n for i, n in c}), float(x)) for c, x in zip(best_known, kept, strict=True) if x > 1e-6], bound


def from_program(left: Counter, size: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, sequences) pairs by rounding the linear program; takes their pieces
    out of left. Shares of full configurations are rounded down, then what is left of them
    up, the largest first, as far as pieces last; the program is solved anew for the
    rest. When full configurations give little, those with more room are taken as well."""
    out, slack, solved = [], 0, None
    while slack <= size and left:
        if solved is None:
            solved = sorted(solve(left, size, rounds)[0], key=lambda p: (-p[1], sorted(p[0].items())))
        before = sum(left.values())
        for up in (False, True):
            for config, x in solved:
                if size - sum(k * n for k, n in config.items()) > slack or (up and x < 1 / 8):
                    continue
                runs = min(1 if up else int(x), *(left[k] // n for k, n in config.items()))
                if runs > 0:
                    out.append((dict(config), runs))
                    for k, n in config.items():
                        left[k] -= n * runs
                        if not left[k]:
                            del left[k]
        if sum(left.values()) > 0.8 * before:  # accept more room in a sequence
            slack = 2 * slack + 1
        else:
            solved = None
    return out


def best_fit(left: Counter, size: int) -> list[tuple[dict[int, int], int]]:
    """(configuration, sequences) pairs: each takes the largest pieces that still fit, and
    is repeated as long as they last."""
    out = []
    while left:
        room, config = size, Counter()
        while fit := [x for x in left if x <= room and left[x] > config[x]]:
            x = max(fit)
            n = min(room // x, left[x] - config[x])
            config[x] += n
            room -= n * x
        runs = min(left[x] // n for x, n in config.items())
        out.append((dict(config), runs))
        for x, n in config.items():
            left[x] -= n * runs
            if not left[x]:
                del left[x]
    return out


def plan(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """(configuration, number of sequences) pairs that hold each piece exactly once: the
    rounded program, then best fit of the few pieces that are left."""
    left = Counter({x: n for x, n in histogram.items() if n})
    made = from_program(left, size, rounds)
    return made + best_fit(left, size)


def placed(made: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last-plus-one, pieces a sequence, first sequence, offset)."""
    rows, sequence, used = [], 0, Counter()
    for config, runs in made:
        offset = 0
        for x, n in sorted(config.items(), reverse=True):
            rows.append((x, used[x], used[x] + n * runs, n, sequence, offset))
            used[x] += n * runs
            offset += n * x
        sequence += runs
    return rows


def pack(df: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as an empty one, whose single piece is the end token. Ids may be
    null or repeat; each row is packed by itself. A text of more than `size` tokens,
    however long, is cut; all pieces but its first are full. An empty table gives no
    rows; further columns are ignored.
    """
    spark = df.sparkSession
    made = cut(pieces(documents(df, id_col, text_col), tokenizer, size, end), "op6-pieces")
    by_part = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    rows = placed(plan(histogram, size, rounds))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    # a search in the plan's ranges, which the driver made from at most `size` lengths
    at: dict[int, list] = {}
    for r in rows:
        at.setdefault(r[0], []).append(r[1:])
    shared = spark.sparkContext.broadcast({x: np.array(v, np.int64) for x, v in at.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            found, first = np.unique(n[order], return_index=True)
            for x, own in zip(found, np.split(order, first[1:]) if len(order) else [], strict=True):
                t = shared.value[int(x)]
                k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                inner = rank[own] - t[k, 0]
                sequence[own] = t[k, 3] + inner // t[k, 2]
                offset[own] = t[k, 4] + inner % t[k, 2] * x
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())
