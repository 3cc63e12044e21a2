"""Token counts (offset-mapped attribution).

Each whole document is encoded once; the byte lengths of its tokens give their spans, and
an interval join of two sorted lists (spans of tokens, spans of sections) gives each
section its tokens. A token that crosses a boundary goes, by `rule`, to the section of its
first character ("start"), of its last ("end"), or to the one that holds most of its bytes,
the earlier of two equal ones ("most"). Tokens of nothing but section breaks go to the
section before the break. So each token is counted once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, table
from .tokens import default_path, encoder

RULES = ("start", "end", "most")


def lines(raw: bytes) -> list[tuple[int, int]]:
    """The spans of lines, each with its line break, so that they cover the text."""
    at = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    ends = [*at.tolist(), *([len(raw)] if not len(at) or at[-1] < len(raw) else [])]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token. ends: the tokens' last-plus-one bytes; bounds: the
    sections' first bytes, ascending from 0, each section ending where the next begins."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.searchsorted(bounds, starts, side="right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "end":
        return last
    out = first.copy()
    for k in np.flatnonzero(last > first):
        cutting = np.concatenate([[starts[k]], bounds[first[k] + 1 : last[k] + 1], [ends[k]]])
        out[k] = first[k] + int(np.argmax(np.diff(cutting)))
    return out


def token_counts(df: DataFrame, tokenizer: str, sections: Callable[[bytes], list[tuple[int, int]]] = lines, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each section of each row: doc_id, section (from 0), start_char, end_char,
    n_tokens, n_crossing (its tokens that reach over a boundary), doc_tokens.

    A null or empty text has one empty section without tokens. Rows are treated one by
    one: ids may be null or repeat. An empty table gives no rows; other columns are
    ignored. `sections` gets UTF-8 and returns adjacent byte spans that cover it.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    schema = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            ids_of, out = b.column("doc_id").to_pylist(), [[] for _ in range(7)]
            for doc_id, value in zip(ids_of, b.column("text"), strict=True):
                text = value.as_py()
                raw = text.encode()
                spans = sections(raw) or [(0, 0)]
                bounds = np.array([s for s, _ in spans], np.int64)
                ends = np.cumsum(enc.token_bytes[np.frombuffer(enc.ids(text), "<u4")])
                n = len(spans)
                at = attribute(ends, bounds, rule) if len(ends) else np.zeros(0, np.int64)
                first = np.searchsorted(bounds, np.concatenate([[0], ends[:-1]]), side="right") - 1 if len(ends) else at
                last = np.searchsorted(bounds, ends - 1, side="right") - 1 if len(ends) else at
                chars = np.cumsum(np.concatenate([[0], (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80]))
                out[0] += [doc_id] * n
                out[1].append(np.arange(n, dtype=np.int32))
                out[2].append(chars[bounds])
                out[3].append(chars[[e for _, e in spans]])
                out[4].append(np.bincount(at, minlength=n))
                out[5].append(np.bincount(at[last > first], minlength=n))
                out[6].append(np.full(n, len(ends)))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            cols = [pa.array(out[0], pa.int64()), *(pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out[1:], kinds[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    return documents(df, id_col, text_col).mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document."""
    return token_counts(table(spark, sf_dir, "documents"), default_path())
