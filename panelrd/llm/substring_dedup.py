"""Substring dedup by relative Lempel-Ziv parsing: word passages that an earlier document already has.

Pieces of text that may hold the edges of repeated passages (repeats.py) are gathered to blocks, which serve as reference
blocks for each other: the word suffixes of all pieces are sorted, and the longest factor that a piece can copy at a
word from the pieces of earlier documents is its common prefix with the nearest such suffix on either side.  Each piece
is parsed greedily into such factors; one of at least `length` words is a duplicate span.  After a factor the parse
goes on `length` - 1 words before its end, so that a passage across a factor's boundary is found too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelrd.llm import repeats
from panelrd.llm.common import flat_text, map_arrow, row_key

LENGTH = 50
#: Words of an anchor of a window of LENGTH; different pieces of a bucket that one task compares.
ANCHOR, LIMIT = 8, 1024
_LAST = (1 << 63) - 1


def nearest_earlier(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one to the left, and to the right, with a smaller value (-1: none)."""

    def left(values: list[int]) -> np.ndarray:
        out, stack = [], []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] >= v:
                stack.pop()
            out.append(stack[-1] if stack else -1)
            stack.append(i)
        return np.array(out, dtype=np.int64)

    values = order.tolist()
    right = left(values[::-1])[::-1]
    return left(values), np.where(right >= 0, len(values) - 1 - right, -1)


def longest_factors(pieces: list[np.ndarray], order: np.ndarray, length: int) -> list[np.ndarray]:
    """For every word of a piece with `length` words to its end: how many words can be copied there from earlier rows' pieces."""
    sizes = np.array([len(p) for p in pieces])
    words = np.concatenate(pieces)
    begin = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begin, sizes)])
    piece = np.searchsorted(begin, starts, side="right") - 1
    stop = (begin + sizes)[piece]
    raw = words.astype(">u8").tobytes()
    keys = [raw[8 * a : 8 * b] for a, b in zip(starts.tolist(), stop.tolist())]
    rank = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    del keys
    found = np.zeros(len(starts), dtype=np.int64)
    for near in nearest_earlier(order[piece[rank]]):
        have = np.flatnonzero(near >= 0)
        a, b = rank[have], rank[near[have]]
        common, active = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
        most = np.minimum(stop[a] - starts[a], stop[b] - starts[b])
        while len(active):
            active = active[common[active] < most[active]]
            active = active[words[starts[a[active]] + common[active]] == words[starts[b[active]] + common[active]]]
            common[active] += 1
        found[a] = np.maximum(found[a], common)
    return np.split(found, np.cumsum(np.maximum(sizes - length + 1, 0))[:-1])


def relative_parse(longest: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Greedy factors of at least `length` words, as (start, end); parsing goes on where a window could cross the end."""
    out, at = [], 0
    longest = longest.tolist()
    while at < len(longest):
        n = longest[at]
        if n >= length:
            out.append((at, at + n))
            at += n - length + 1
        else:
            at += 1
    return out


def parsed(length: int):
    """Matcher: factors of open pieces relative to the pieces of earlier rows in the block."""

    def match(pieces: list[bytes], order: np.ndarray, is_open: np.ndarray) -> list[tuple[int, int, int]]:
        words = [np.frombuffer(p, ">u8").astype(np.uint64) for p in pieces]
        return [(i, a, b) for i, n in enumerate(longest_factors(words, order, length)) if is_open[i] for a, b in relative_parse(n, length)]

    return match


def duplicate_spans(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """Word spans (rid, start, end) of `docs` (rid, doc_id, text) that cover all windows that also start in a smaller doc_id."""
    what = repeats.Repeats("words", length, max(1, length * ANCHOR // LENGTH), True, limit)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return repeats.repeated_spans(docs.select("rid", order.alias("ord"), "text"), what, parsed(length), "rlz")


def dedup(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """Cut every word passage that an earlier document has out of (doc_id, text).

    Returns doc_id, n_words, n_removed, kept_sha256, kept (words that stay, joined by a space).  A word goes if a window of
    `length` words that covers it also starts in a document with a smaller doc_id; windows are judged on the input.
    Null text: no words.  A null doc_id is larger than all others.  Rows with equal ids do not remove each other.  An
    empty table gives no rows; other columns are not read.  Words are compared by 64-bit hashes.
    """
    rows = docs.select("doc_id", "text").withColumn("rid", row_key("doc_id", "text"))
    found = repeats.spans_of_rows(duplicate_spans(rows, length, limit))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            out = []
            for i, (starts, ends) in enumerate(repeats.covered(batch.column(2))):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()  # at the six ASCII spaces
                kept = words
                if starts:
                    stays = np.ones(len(words), dtype=bool)
                    for a, b in zip(starts, ends):
                        stays[a:b] = False
                    kept = list(compress(words, stays.tolist()))
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")))
            kind = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kind))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(found, "rid", "left").select("doc_id", "text", "spans")
    return map_arrow(joined, cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_substring_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")
