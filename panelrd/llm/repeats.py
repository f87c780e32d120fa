"""Exact search for repeated windows (runs of `length` units) across all documents, for bytes or words.

Every window is given one anchor: the run of `k` units in it with the smallest hash, the leftmost of equals.  Equal windows
have equal anchors at equal places, so windows need comparing only where their anchors are equal; neighbouring windows
share anchors, so a document has one record for about (length - k) / 2 units.  A record is its anchor's hash (`bucket`) and
the hash of all units that its windows cover (`content`).

* A bucket with one record repeats nowhere.
* Records with equal contents repeat each other whole.
* What is left are the records at the edges of repeated passages.  Their pieces of text meet in their buckets, where
  a matcher over suffix order finds the repeated windows.  A bucket with more than `limit` different pieces is split:
  its windows are dealt to cells by where in them the anchor stands, and each cell's windows to buckets by the units that
  all of the cell's windows share.  Equal windows stay together, and after a few splits a cell is one window, whose bucket
  holds equal pieces only.  So no bucket is large, and nothing is left out.

Everything is joined and grouped by hashes spread over all tasks; only pieces of at most 2 x length units travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelrd.llm.common import RangeHash, blocks, byte_values, flat_text, map_arrow, mix, signed, word_hashes, written

#: Each split deals the windows of a bucket to this many cells.
SPLIT = 4
_RECORD = "rid long, ord long, bucket long, content long, place long"
_PLAIN = ["rid", "ord", "bucket", "content", "place"]


@dataclass(frozen=True)
class Repeats:
    """What to look for: `unit` bytes or words, windows of `length`, anchors of `k`; by `earlier`, only windows that also
    start in a row with a smaller `ord` count, else all that start anywhere else."""

    unit: str
    length: int
    k: int
    earlier: bool
    limit: int

    @property
    def cells(self) -> list[int]:
        """Widths of the cells that windows are dealt to, split by split; the last is 1."""
        out = [self.length - self.k + 1]
        while out[-1] > 1:
            out.append(-(-out[-1] // SPLIT))
        return out


def packed(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Anchor place, and the first and last window's distance to it, in one number (`length` is below 65536)."""
    return (at.astype(np.int64) << 32) | ((at - lo).astype(np.int64) << 16) | (hi - lo).astype(np.int64)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 32
    lo = at - ((place >> 16) & 0xFFFF)
    return lo, lo + (place & 0xFFFF), at


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def records(values: np.ndarray, offsets: np.ndarray, what: Repeats) -> tuple[np.ndarray, ...] | None:
    """Row, first and last window start, anchor place, bucket and content of the records of rows of units."""
    n = len(values)
    if n < what.length:
        return None
    hashes = RangeHash(values)
    grams = hashes.every(what.k)
    bits = np.uint64(max(1, n.bit_length()))
    order = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(order, what.length - what.k + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(row[: len(anchor)] == row[what.length - 1 :])  # windows that cross no row's end
    if not len(inside):
        return None
    anchor = anchor[inside]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], len(inside)) - 1
    lo, hi, at = inside[first], inside[last], anchor[first]
    return row[lo], lo, hi, at, signed(grams[at]), signed(hashes(lo, hi + what.length))


def units(column: pa.Array, what: Repeats) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows (from, to) with their units' values and the offsets of the rows."""
    data, offsets = flat_text(column)
    for i, j in blocks(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if what.unit == "bytes":
            yield i, j, byte_values(part), at
        else:
            h, _, _, of = word_hashes(part, at)
            yield i, j, h, of


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def all_records(rows: DataFrame, what: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, order = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, _, values, offsets in units(batch.column(2), what):
                if (got := records(values, offsets, what)) is not None:
                    row, lo, hi, at, bucket, content = got
                    start = offsets[row]
                    columns = [rid[i + row], order[i + row], bucket, content, packed(lo - start, hi - start, at - start)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PLAIN)

    return map_arrow(rows.select("rid", "ord", "text"), run, _RECORD)


def with_pieces(rows: DataFrame, wanted: DataFrame, what: Repeats) -> DataFrame:
    """`wanted` (records, open, many) with their pieces of text: bytes, or big-endian 64-bit hashes of words."""
    names = [*_PLAIN[1:], "open", "many"]
    joined = rows.select("rid", "text").join(wanted.groupBy("rid").agg(F.collect_set(F.struct(*names)).alias("w")), "rid").select("rid", "text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            starts, flat = np.asarray(lists.offsets), lists.values
            fields = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in names}
            lo, hi, _ = unpacked(fields["place"])
            for i, j, values, offsets in units(batch.column(1), what):
                raw, size = (flat_text(batch.column(1).slice(i, j - i))[0].tobytes(), 1) if what.unit == "bytes" else (values.astype(">u8").tobytes(), 8)
                at = np.arange(starts[i], starts[j])
                row = np.repeat(np.arange(j - i), np.diff(starts[i : j + 1]))
                a = (offsets[row] + lo[at]) * size
                b = (offsets[row] + hi[at] + what.length) * size
                piece = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(rid[i + row])] + [pa.array(fields[k][at]) for k in names] + [pa.array(piece, pa.binary())], names=["rid", *names, "piece"])

    return map_arrow(joined, run, _RECORD + ", open boolean, many boolean, piece binary")


def split(items: DataFrame, width: int, what: Repeats) -> DataFrame:
    """Deal the windows of items to cells of `width` by the anchor's place in them, and the cells to buckets.

    A cell holds the windows that have between p and p + width - 1 units before the anchor; its bucket is the hash of the
    units that all of them share, from the start of its last window to the end of its first.
    """
    size = 1 if what.unit == "bytes" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            lows, highs, ats = unpacked(_numpy(batch, "place"))
            rows = zip(_numpy(batch, "rid").tolist(), _numpy(batch, "ord").tolist(), lows.tolist(), highs.tolist(), ats.tolist(), _numpy(batch, "open").tolist(), batch.column(batch.schema.get_field_index("piece")).to_pylist())
            for rid, order, lo, hi, at, is_open, piece in rows:
                values = np.frombuffer(piece, np.uint8 if size == 1 else ">u8")
                hashes = RangeHash(byte_values(values) if size == 1 else values.astype(np.uint64))
                p1 = np.arange((at - hi) // width, (at - lo) // width + 1) * width
                p2 = np.minimum(p1 + width - 1, what.length - what.k)
                first, last = np.maximum(lo, at - p2), np.minimum(hi, at - p1)  # the item's windows in the cell
                bucket = signed(mix(hashes(at - p1 - lo, at - p2 + what.length - lo) ^ mix((p1 * 65536 + width).astype(np.uint64))))
                content = signed(hashes(first - lo, last - lo + what.length))
                place = packed(first, last, np.full(len(p1), at))
                for c, (f, e) in enumerate(zip(first.tolist(), last.tolist())):
                    out.append((rid, order, int(bucket[c]), int(content[c]), int(place[c]), is_open, piece[(f - lo) * size : (e - lo + what.length) * size]))
            kind = [pa.int64()] * 5 + [pa.bool_(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kind)], names=[*_PLAIN, "open", "piece"])

    return map_arrow(items.select(*_PLAIN, "open", "piece"), run, _RECORD + ", open boolean, piece binary")


#: From pieces, their rows' ords and whether they are open: (number of the piece, start, end) of spans to remove.
Matcher = Callable[[list[bytes], np.ndarray, np.ndarray], list[tuple[int, int, int]]]


def matched(items: DataFrame, matcher: Matcher, block: int = 1 << 18) -> DataFrame:
    """Spans (rid, start, end) that the matcher finds, over whole buckets gathered to blocks of about `block` bytes."""
    kind = ("rid", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rid, order, place, is_open, piece = zip(*held)
            lo = unpacked(np.array(place, dtype=np.int64))[0]
            found = [(rid[i], int(lo[i] + a), int(lo[i] + b)) for i, a, b in matcher(list(piece), np.array(order, dtype=np.int64), np.array(is_open, dtype=bool))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], names=kind)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("bucket", "rid", "ord", "place", "open", "piece")]
            for bucket, *item in zip(*columns):
                if bucket != last and size >= block:
                    yield flush()
                    held, size = [], 0
                last = bucket
                held.append(tuple(item))
                size += len(item[-1])
        if held:
            yield flush()

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(items.repartition(n, "bucket").sortWithinPartitions("bucket"), run, "rid long, start long, end long")


def spans(items: DataFrame, what: Repeats) -> DataFrame:
    lo = F.shiftright("place", 32) - F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF))
    return items.select("rid", lo.alias("start"), (lo + F.col("place").bitwiseAND(F.lit(0xFFFF)) + what.length).alias("end"))


def sorted_out(items: DataFrame, what: Repeats, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans of records whose contents repeat whole; and the records that are left, with `many` (pieces in their bucket).

    Of records with equal contents one is left (by `earlier`: those of the first row), no more open where its span is
    known.  Buckets with one content only, or without an open record, are done.
    """
    one = F.min(F.struct("rid", "place")).alias("one")
    by_content = written(items.groupBy("bucket", "content").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.max("open").alias("open_class"), one), f"{name}-contents")
    undone = F.col("open_class") if what.earlier else F.col("open_class") & (F.col("n") == 1)
    by_bucket = by_content.groupBy("bucket").agg(F.count("*").alias("m"), F.min("first").alias("b_first"), F.max("first").alias("b_last"), F.max(undone).alias("undone"))
    by_bucket = by_bucket.filter("m > 1 AND undone" + (" AND b_first < b_last" if what.earlier else "")).drop("b_last", "undone")
    joined = items.join(by_content.drop("open_class"), ["bucket", "content"]).join(written(by_bucket, f"{name}-buckets"), "bucket", "left")
    same = (F.col("rid") == F.col("one.rid")) & (F.col("place") == F.col("one.place"))
    known, kept = (F.col("ord") > F.col("first"), F.col("ord") == F.col("first")) if what.earlier else (F.col("n") > 1, same)
    still = F.col("ord") > F.col("b_first") if what.earlier else F.col("n") == 1
    joined = joined.withColumn("known", known).withColumn("kept", kept & F.col("m").isNotNull()).filter("known OR kept")
    joined = joined.withColumn("open", F.col("open") & F.coalesce(still, F.lit(False))).withColumn("many", F.coalesce(F.col("m") > what.limit, F.lit(False)))
    joined = written(joined.select(*items.columns, "known", "kept", "many"), f"{name}-sorted")
    return spans(joined.filter("known"), what), joined.filter("kept").drop("known", "kept")


def repeated_spans(rows: DataFrame, what: Repeats, matcher: Matcher, name: str) -> DataFrame:
    """Spans (rid, start, end), in units, that cover exactly the repeated windows of `rows` (rid, ord, text)."""
    found = written(all_records(rows, what), f"{name}-records")
    if what.earlier:
        shared = found.groupBy("bucket").agg(F.min("ord").alias("b1"), F.max("ord").alias("b2")).filter("b1 < b2")
    else:
        shared = found.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    items = written(found.join(written(shared.select("bucket"), f"{name}-shared"), "bucket").withColumn("open", F.lit(True)), f"{name}-items")
    known, left = sorted_out(items, what, name)
    left = written(with_pieces(rows, left, what), f"{name}-pieces")
    parts = [known, matched(left.filter("NOT many"), matcher)]
    for i, width in enumerate(what.cells[1:]):
        many = left.filter("many")
        if many.isEmpty():
            break
        cells = written(split(many, width, what), f"{name}-cells{i}")
        known, left = sorted_out(cells, what, f"{name}-{i}")
        parts += [known, matched(left.filter("NOT many"), matcher)]
    return reduce(DataFrame.unionByName, parts)


def spans_of_rows(found: DataFrame) -> DataFrame:
    """All spans of a row in one array `spans`."""
    return found.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def covered(column: pa.Array) -> Iterator[tuple[list[int], list[int]]]:
    """For every row of `spans` the starts and ends of the maximal covered runs."""
    at = np.asarray(column.offsets)
    start, end = (column.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    for a, b, known in zip(at[:-1].tolist(), at[1:].tolist(), column.is_valid().to_pylist()):
        if not known or a == b:
            yield [], []
            continue
        order = np.argsort(start[a:b], kind="stable")
        s, reach = start[a:b][order], np.maximum.accumulate(end[a:b][order])
        new = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
        yield s[new].tolist(), reach[np.append(new[1:] - 1, b - a - 1)].tolist()
