"""Best-fit packing of tokenised documents into sequences, planned on the histogram of piece lengths.

The histogram has at most `capacity` rows, so it alone goes to the driver.  The planner packs counts, not documents:
lengths from the longest to the shortest, each into the fullest sequences that still have room, a whole group of equal
sequences at a time.  Documents then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelrd.llm.common import kept, map_arrow, written

#: Words whose ids a worker process remembers; beyond that it starts anew.
CACHE_WORDS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters on which Unicode versions and the rules for lower case agree; the pre-tokenizer's words over them.
_PLAIN = re.compile(r"[\t-\r -~\u00a1-\u024f]*")
_WORD = re.compile(r"""'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+""")
_WORD_END = "</w>"


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, from remembered ids of their words.

    For the word-level BPE vocabulary: it lowers case, drops white space and encodes each word by itself, and a
    word's last token alone ends in its end mark, so that many new words are encoded at once.  A text with other
    characters, or one that may hold a special token, goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.known = kept("tokens").setdefault(path, {})

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if not w.isalpha()]
        words = [w for w in words if w.isalpha()]
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = self._ids([" ".join(part)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, [0, *ends.tolist()], ends.tolist()))
            else:
                alone += part
        self.known.update(zip(alone, (x.tobytes() for x in self._ids(alone))))

    @staticmethod
    def _cut(text: str) -> list[str] | None:
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return None
        text = normalize("NFC", text).lower()
        mere = text.replace(" ", "").replace("\n", "")
        if any(x in mere for x in ("..", ".,", ",.", ",,")) or not mere.replace(".", "").replace(",", "").isalpha():
            return _WORD.findall(text)
        return text.replace(".", " . ").replace(",", " , ").split()  # mere letters and single marks

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._cut(t) for t in texts]
        words = set().union(*(x for x in split if x))
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        if new:
            self._learn(list(new))
        return [self._ids([t])[0].tobytes() if x is None else b"".join(map(self.known.__getitem__, x)) for t, x in zip(texts, split)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Token pieces of (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Every row of `docs` gives ceil(tokens / capacity) pieces; a null or empty text has the end id alone.
    """
    path = tokenizer or default_tokenizer()
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode([x or "" for x in part.column(1).to_pylist()])):
                    ids += end
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        got = ids[i : i + 4 * capacity]
                        out.append((doc_id, k, i // 4, len(got) // 4, zlib.crc32(got)) + ((np.frombuffer(got, "<u4").astype(np.int64),) if with_ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), kind)], schema=kind)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, ddl, keeps="tokens")


@dataclass
class Slots:
    """Slots of one length: ranks from first on, `each` to a sequence, at offset, offset + length, ..."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int
    each: int


def plan_slots(histogram: dict[int, int], capacity: int) -> list[Slots]:
    """Best fit, longest first, over a histogram {length: count}: each piece goes to the fullest sequence with room.

    Sequences with equal room are kept as runs of numbers, so a step places as many pieces as the run has.  The number of
    steps depends on the number of different lengths, not on the number of pieces.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    out: list[Slots] = []
    opened = 0

    def keep(room: int, first: int, count: int) -> None:
        if room:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = runs[room].pop()
                take = min(left, count)
                if take < count:
                    runs[room].append((first + take, count - take))
                if not runs[room]:
                    del runs[room], rooms[i]
                out.append(Slots(length, rank, take, first, capacity - room, 1))
                keep(room - length, first, take)
            else:
                each = min(capacity // length, left)
                count = left // each
                take = count * each
                out.append(Slots(length, rank, take, opened, 0, each))
                keep(capacity - each * length, opened, count)
                opened += count
            rank += take
            left -= take
    return out


def ranked_within_length(rows: DataFrame, chunks: int) -> DataFrame:
    """`rows` with rank: a number from 0 within each length, in two levels so that a common length is no one task's work."""
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(chunks)))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return rows.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside", "chunk")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents of (doc_id, text) into sequences of at most `capacity` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.  Only documents longer than
    `capacity` are cut.  Null and empty texts are the end id alone; repeated rows are packed each; a null doc_id stays
    null; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, end_id, with_ids), "pack-pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = sorted(plan_slots(histogram, capacity), key=lambda s: (s.length, s.first))
    lengths = np.array([s.length for s in slots], dtype=np.int64)
    first, sequence, offset, each = (np.array([getattr(s, k) for s in slots], dtype=np.int64) for k in ("first", "sequence", "offset", "each"))
    starts = {int(x): (int(i), int(j)) for x, i, j in zip(*np.unique(lengths, return_index=True), np.append(np.unique(lengths, return_index=True)[1][1:], len(lengths)))}
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = ranked_within_length(cut, chunks)
    fields = [f for f in ranked.schema.fields if f.name != "rank"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "rank"))
            at = np.zeros(len(rank), dtype=np.int64)
            for x in np.unique(length):
                mine = length == x
                i, j = starts[int(x)]
                at[mine] = i + np.searchsorted(first[i:j], rank[mine], side="right") - 1
            inside = rank - first[at]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(sequence[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * length)], names=[f.name for f in fields] + ["sequence_id", "offset"])

    return map_arrow(ranked, place, ddl)


def op4_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
