"""Exact quantiles in bounded memory.

Spark's `percentile` brings a map of all distinct values to one task. Here a sketch of
bounded size gives two values around each rank, which are counted exactly: the rank is
one of them, or lies in one of the open intervals that they make. Such an interval has
about a thousandth of the values, and is gathered once it has LIMIT or less. The sketch
decides on the number of passes only.
"""

from __future__ import annotations

from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import present

#: Values gathered of an interval, intervals gathered or counted in one job, the sketch's accuracy.
LIMIT, AT_ONCE, ACCURACY = 100_000, 20, 4000


def _within(x: Column, low: float | None, high: float | None) -> Column:
    """x between these bounds (both left out), else null."""
    for keep in ([x > low] if low is not None else []) + ([x < high] if high is not None else []):
        x = F.when(keep, x)
    return x


def _ranked(d: DataFrame, ranks: dict[int, set[int]], n: list[int], limit: int) -> dict[tuple[int, int], float]:
    """The values at these ranks (from 0) of each column of d."""
    found: dict[tuple[int, int], float] = {}
    # column, bounds, values below, values between: the ranks that lie there
    open_: dict[tuple, set[int]] = {(i, None, None, 0, n[i]): r for i, r in ranks.items() if r}
    while open_:
        small = [b for b in open_ if b[4] <= limit]
        for at in range(0, len(small), AT_ONCE):
            own = small[at : at + AT_ONCE]
            cells = F.array(*[F.struct(F.lit(k).alias("k"), _within(F.col(f"_{b[0]}"), b[1], b[2]).alias("v")) for k, b in enumerate(own)])
            got = d.select(F.inline(cells)).filter("v is not null").toArrow()
            k, v = got.column("k").to_numpy(), got.column("v").to_numpy()
            for j, b in enumerate(own):
                values = np.sort(v[k == j])
                found |= {(b[0], r): float(values[r - b[3]]) for r in open_[b]}
        large = [b for b in open_ if b[4] > limit]
        nearer: dict[tuple, set[int]] = {}
        for at in range(0, len(large), AT_ONCE):
            own = large[at : at + AT_ONCE]
            spans = [[x for r in sorted(open_[b]) for x in (max(0.0, (r - b[3]) / b[4] - 2 / ACCURACY), min(1.0, (r - b[3]) / b[4] + 2 / ACCURACY))] for b in own]
            cuts = d.agg(*[F.percentile_approx(_within(F.col(f"_{b[0]}"), b[1], b[2]), s, ACCURACY).alias(f"_{k}") for k, (b, s) in enumerate(zip(own, spans, strict=True))]).first()
            edges = [sorted(set(c)) for c in cuts]
            counts = d.agg(*[F.count_if(test).alias(f"_{k}_{j}_{e}") for k, b in enumerate(own) for x in [_within(F.col(f"_{b[0]}"), b[1], b[2])] for j, c in enumerate(edges[k]) for e, test in enumerate((x < c, x == c))]).first()
            for k, b in enumerate(own):
                low, below = b[1], b[3]
                for j, c in enumerate([*edges[k], None]):
                    upto, same = (b[3] + counts[f"_{k}_{j}_0"], counts[f"_{k}_{j}_1"]) if c is not None else (b[3] + b[4], 0)
                    for r in open_[b]:
                        if below <= r < upto:
                            nearer.setdefault((b[0], low, c if c is not None else b[2], below, upto - below), set()).add(r)
                        elif upto <= r < upto + same:
                            found[b[0], r] = c
                    low, below = c, upto + same
        open_ = nearer
    return found


def quantiles(df: DataFrame, wanted: dict[str, list[float]], limit: int = LIMIT) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated as by `percentile`; null without values."""
    if not wanted:
        return {}
    d = df.select(*[present(df, c).alias(f"_{i}") for i, c in enumerate(wanted)])
    n = list(d.agg(*[F.count(c) for c in d.columns]).first())
    places = [[(n[i] - 1) * p for p in ps] if n[i] else [] for i, ps in enumerate(wanted.values())]
    value = _ranked(d, {i: {f(x) for x in at for f in (floor, ceil)} for i, at in enumerate(places)}, n, limit)

    def between(i: int, at: float) -> float:
        low, high = value[i, floor(at)], value[i, ceil(at)]
        return low + 0.0 if low == high else (ceil(at) - at) * low + (at - floor(at)) * high  # no -0.0, as either zero may be found

    return {c: [between(i, at) for at in places[i]] if n[i] else [None] * len(ps) for i, (c, ps) in enumerate(wanted.items())}
