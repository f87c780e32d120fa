"""Suffix-array dedup: byte passages that occur more than once, found by two-stage suffix sorting.

Pieces of text that may hold the edges of repeated passages (repeats.py) are gathered to blocks; a block's suffix array is
built in two stages: suffixes smaller than their successors are sorted directly, the others are induced by scanning the
buckets of first bytes in order.  Neighbours in the array with a common prefix of `length` bytes are repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelrd.llm import repeats
from panelrd.llm.common import flat_text, map_arrow, row_key

LENGTH = 200
#: Bytes of an anchor of a window of LENGTH; different pieces of a bucket that one task compares.
ANCHOR, LIMIT = 40, 1024


def suffix_array(pieces: list[bytes], depth: int, length: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the pieces sorted by their first `depth` bytes, and the text: all pieces, each with an end mark after it.

    The text holds bytes plus one; an end mark is 0, and an earlier one is the smaller.  With `length`, the suffixes behind a
    piece's last window of that length are left out, but for those that the others are induced from.
    """
    raw = b"\0".join(pieces) + b"\0"
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(raw, dtype=np.uint8).astype(np.int16) + 1
    stops = np.cumsum(sizes + 1) - 1
    text[stops] = 0
    n = len(text)
    # stage one: types, and direct sorting of the suffixes that are smaller than their successors
    step = np.append(np.sign(np.diff(text)), 1)
    step[stops] = 1  # an end mark is smaller than whatever follows it
    decided = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]  # where the first difference to the right is
    smaller = step[following] > 0
    use = np.ones(n, dtype=bool)
    if length:  # up to the first directly sorted suffix at or behind the last window
        last = np.maximum(stops - length, stops - sizes)
        place = np.where(smaller, np.arange(n), n)
        upto = np.minimum.accumulate(place[::-1])[::-1][last]
        use = np.arange(n) <= np.repeat(upto, sizes + 1)
    direct = np.flatnonzero(smaller & use & (text > 0))
    stop_of = stops[np.searchsorted(stops, direct)]
    keys = [raw[a:b] for a, b in zip(direct.tolist(), np.minimum(direct + depth, stop_of).tolist())]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)]
    del keys
    # stage two: buckets in order; what precedes a suffix just placed, and is larger than it, goes to the front part of its own bucket
    bounds = np.searchsorted(text[direct], np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = [stops[use[stops]]]

    def scan(placed: np.ndarray, here: int) -> np.ndarray:
        before = placed[placed > 0] - 1
        before = before[~smaller[before] & (text[before] > 0)]
        byte = text[before]
        again = before[byte == here]
        later = byte > here
        before, byte = before[later], byte[later]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])) if len(byte) else []
        for a, b in zip(cut, [*cut[1:], len(byte)]):
            induced[byte[a]].append(before[a:b])
        return again

    scan(out[0], 0)
    for c in range(1, 257):
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = scan(wave, c)
        back = direct[bounds[c] : bounds[c + 1]]
        if len(back):
            out.append(back)
            scan(back, c)
    return np.concatenate(out), text


def common_prefixes(a: np.ndarray, b: np.ndarray, raw: bytes, most: int) -> np.ndarray:
    """Bytes that the texts at a[i] and b[i], of at least `most` bytes, have in common, counted up to `most` in words of eight."""
    word = np.ndarray(len(raw), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    found, active = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    for d in [*range(0, most - 7, 8), *([most - 8] if most % 8 and most > 8 else [])]:
        active = active[word[a[active] + d] == word[b[active] + d]]
        found[active] = d + 8
    if most < 8:
        data = np.frombuffer(raw + bytes(8), dtype=np.uint8)
        for d in range(most):
            active = active[data[a[active] + d] == data[b[active] + d]]
            found[active] = d + 1
    return found


def repeated_windows(length: int):
    """Matcher: windows of an open piece that start anywhere else in the block."""

    def match(pieces: list[bytes], order: np.ndarray, is_open: np.ndarray) -> list[tuple[int, int, int]]:
        array, _ = suffix_array(pieces, length, length)
        sizes = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(sizes)
        piece = np.searchsorted(ends, array, side="right")
        room = ends[piece] - 1 - array >= length
        array, piece = array[room], piece[room]
        if len(array) < 2:
            return []
        equal = common_prefixes(array[:-1], array[1:], b"\0".join(pieces) + b"\0", length) >= length
        hit = np.append(equal, False) | np.append(False, equal)
        hit &= is_open[piece]
        start = array[hit] - (ends - sizes)[piece[hit]]
        return list(zip(piece[hit].tolist(), start.tolist(), (start + length).tolist()))

    return match


def duplicate_spans(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """Byte spans (rid, start, end) of `docs` (rid, text) that cover all `length`-byte strings that also start elsewhere."""
    what = repeats.Repeats("bytes", length, max(1, length * ANCHOR // LENGTH), False, limit)
    return repeats.repeated_spans(docs.select("rid", F.lit(0).cast("long").alias("ord"), "text"), what, repeated_windows(length), "suffix")


def dedup(docs: DataFrame, length: int = LENGTH, limit: int = LIMIT) -> DataFrame:
    """Cut every repeated byte passage out of (doc_id, text).

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (binary: a cut may fall within a
    character).  Each byte covered by a `length`-byte string that also starts anywhere else, in the same text included, goes;
    strings are judged on the input.  Null text: empty.  Repeated rows are places of their own, so they remove each
    other; a null doc_id is an id like others; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select("doc_id", "text").withColumn("rid", row_key("doc_id", "text"))
    found = repeats.spans_of_rows(duplicate_spans(rows, length, limit))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            out = []
            for i, (starts, ends) in enumerate(repeats.covered(batch.column(2))):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)])) if len(starts) else raw
                out.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            kind = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kind))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(found, "rid", "left").select("doc_id", "text", "spans")
    return map_arrow(joined, cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")
