"""Document fingerprints by randomised edit embedding.

Every text is read by the same random walk: at step t the walker writes down the character it stands on and goes on to
the next one if a random bit, drawn for (t, character), says so.  Texts a few edits apart fall back into step soon after
each edit, so the Hamming distance of what was written stands for the edit distance.  The fingerprint keeps the hashed
characters written at some steps, for texts of any length 128 to 256 of them: steps have random levels, of which each
next one is half as frequent, and a text keeps those of the least level that is rare enough for its length.  Two
fingerprints are compared on the steps that both keep.  For search, bands of kept steps are buckets, and a bucket's
members are verified against its first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from panelrd.llm.common import map_arrow, mix, written

#: Kept steps of a text at most (about); steps after which the random tables repeat; walkers that go in step.
KEPT, PERIOD, TOGETHER = 256, 4093, 32
#: Bytes of text that are walked at once.
BLOCK = 4 << 20
_END = 255
_rng = np.random.default_rng(31)
_MOVE = _rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
_MOVE[:, _END] = 0
_MARK = _rng.integers(1, 16, (PERIOD, 256), dtype=np.uint8)
_MARK[:, _END] = 0
_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


@lru_cache(maxsize=4)
def _levels(bits: int) -> np.ndarray:
    """The level of each of the first 2^bits steps: the number of trailing zeros of its hash."""
    h = mix(np.arange(1, (1 << bits) + 1, dtype=np.uint64))
    low = h & (~h + np.uint64(1))
    return np.log2(low.astype(np.float64)).astype(np.int8)


def levels(n: int) -> np.ndarray:
    return _levels(max(16, int(n).bit_length()))[:n]


def level_of(n: int) -> int:
    """The level whose steps a text of n characters keeps."""
    return max(0, int(np.ceil(np.log2(max(1, 3 * n) / KEPT))))


@lru_cache(maxsize=64)
def _kept_steps(level: int, bits: int) -> np.ndarray:
    return np.flatnonzero(_levels(bits) >= level)


def kept_steps(level: int, n: int) -> np.ndarray:
    """Steps below 3n of at least `level`."""
    steps = _kept_steps(level, max(16, (3 * n).bit_length()))
    return steps[: np.searchsorted(steps, 3 * n)]


def classes(text: str) -> np.ndarray:
    """A byte for every character: itself below 128, else a hash; the end mark is another."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, points, 128 + (points * np.uint32(2654435761) >> np.uint32(16)) % 127).astype(np.uint8)


def walk(texts: list[np.ndarray]) -> list[np.ndarray]:
    """The marks that each text keeps (0 after its end).

    Walkers go in step while there are many; the last few, of long texts, go one by one.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    if not len(sizes) or not sizes[0]:
        return [np.zeros(0, np.uint8)] * len(texts)
    level = np.array([level_of(n) for n in sizes.tolist()], dtype=np.int64)
    room = [kept_steps(int(k), int(n)) for k, n in zip(level, sizes)]
    track = np.concatenate([np.append(texts[i], np.uint8(_END)) for i in order])
    begin = np.cumsum(sizes + 1) - sizes - 1
    marks = np.zeros((len(order), max(map(len, room)) + 1), dtype=np.uint8)
    of_step = levels(3 * int(sizes[0]) + 1)
    seen = np.zeros(64, dtype=np.int64)  # kept steps so far, by level
    active, place, step = np.arange(len(order)), begin.copy(), 0
    lowest = -level
    while step < 3 * sizes[0]:
        if step % 64 == 0:
            alive = track[place] != _END
            active, place = active[alive], place[alive]
            if len(active) < TOGETHER:
                break
            lowest = -level[active]
        here = track[place]
        k = int(of_step[step])
        first = int(np.searchsorted(lowest, -k))  # texts that keep steps of this level are the shorter ones
        if first < len(active):
            mine = active[first:]
            marks[mine, seen[level[mine]]] = _MARK[step % PERIOD][here[first:]]
        seen[: k + 1] += 1
        place += _MOVE[step % PERIOD][here]
        step += 1
    raw = track.tobytes()
    moves = [m.tobytes() for m in _MOVE]
    for r, at in zip(active.tolist(), place.tolist()):
        steps = room[r].tolist()
        t = step
        for k in range(int(seen[level[r]]), len(steps)):
            for a in range(t, steps[k], PERIOD):
                b = min(a + PERIOD, steps[k])
                i, j = a % PERIOD, a % PERIOD + b - a
                for m in moves[i:j] if j <= PERIOD else moves[i:] + moves[: j - PERIOD]:
                    at += m[raw[at]]
            t = steps[k]
            if raw[at] == _END:
                break
            marks[r, k] = _MARK[t % PERIOD][raw[at]]
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    for r, i in enumerate(order):
        out[i] = marks[r, : len(room[r])]
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """`characters:level:marks` of each text; a mark is a hex digit, and 0s at the end are left out."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < BLOCK):
            size += len(texts[j])
            j += 1
        for text, marks in zip(texts[i:j], walk([classes(t) for t in texts[i:j]])):
            out.append(f"{len(text)}:{level_of(len(text))}:{_DIGITS[marks].tobytes().decode().rstrip('0')}")
        i = j
    return out


def _marks(fingerprint: str, level: int) -> np.ndarray:
    n, own, digits = fingerprint.split(":")
    marks = np.frombuffer(digits.encode(), dtype=np.uint8)
    if int(own) < level:
        steps = kept_steps(int(own), int(n))[: len(marks)]
        marks = marks[levels(3 * int(n))[steps] >= level]
    return marks


def likeness(a: str, b: str) -> float:
    """Part of the steps kept by both, and written on by one at least, at which the marks agree; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    level = max(int(a.split(":")[1]), int(b.split(":")[1]))
    x, y = _marks(a, level), _marks(b, level)
    zero = _DIGITS[0]
    n = max(len(x), len(y))
    x, y = (np.append(v, np.full(n - len(v), zero, np.uint8)) for v in (x, y))
    used = (x != zero) | (y != zero)
    return float((x == y)[used].mean()) if used.any() else 0.0


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as many characters from the start of `following`."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(texts: list[str], prints: list[str], followers: list[str], next_prints: list[str]) -> list[tuple]:
    changed = [edited(t, f) for t, f in zip(texts, followers)]
    return [
        (len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), p, e, likeness(p, e), likeness(p, q))
        for t, c, p, e, q in zip(texts, changed, prints, fingerprints(changed), next_prints)
    ]


def fingerprinted_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text), of each text edited with the next one, and how near they and the next one's are.

    Next is by descending doc_id, null ids last, equal ids in an order that depends on their texts alone; the first follows the last.  The documents are dealt to
    ranges of ids once, with compressed texts; only the first and last document of each range are looked at again, to join the ranges.

    Null text: empty.  A single document follows itself.  An empty table gives no rows; other columns are not read.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "side", "text", "part"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        part_id = TaskContext.get().partitionId()  # ranges are numbered in the order of ids
        plain = zstandard.ZstdDecompressor().decompress

        def rows(out: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [id_kind, *kinds])], names=names)

        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            packed = batch.column(1).to_pylist()
            sizes = np.cumsum([zstandard.get_frame_parameters(x).content_size if x else 0 for x in packed])
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK)) + 1
                part = batch.slice(at, upto - at)
                at += part.num_rows
                ids, texts = part.column(0).to_pylist(), [plain(x).decode() if x else "" for x in part.column(1).to_pylist()]
                prints = fingerprints(texts)
                out = []
                if last is None:
                    out.append((ids[0], len(texts[0]), None, prints[0], None, None, None, "head", texts[0], part_id))
                else:
                    ids, texts, prints = [last[0], *ids], [last[1], *texts], [last[2], *prints]
                last = ids[-1], texts[-1], prints[-1]
                out += [(i, *row, None, None, part_id) for i, row in zip(ids, _compared(texts[:-1], prints[:-1], texts[1:], prints[1:]))]
                if out:
                    yield rows(out, id_kind)
        if last is not None:
            yield rows([(last[0], len(last[1]), None, last[2], None, None, None, "tail", last[1], part_id)], id_kind)

    order = F.col("doc_id").desc_nulls_last()

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [pack(x) if x else b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    packed = map_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), compress, f"doc_id {id_type}, text binary")
    dealt = packed.repartitionByRange(order).sortWithinPartitions(order, "text")
    found = written(map_arrow(dealt, run, f"doc_id {id_type}, {_ROW}, side string, text string, part long"), "fingerprints")
    heads, tails = (found.filter(F.col("side") == s).select("doc_id", "part", "fingerprint", "text") for s in ("head", "tail"))
    parts = sorted(r["part"] for r in heads.select("part").collect())  # a number for each range that has documents
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next long")
    heads = heads.select(F.col("part").alias("next"), F.col("fingerprint").alias("next_fingerprint"), F.col("text").alias("next_text"))
    pairs = tails.join(follows, "part").join(heads, "next")

    def join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, prints, following, next_prints = (batch.column(k).to_pylist() for k in (1, 2, 3, 4))
            out = _compared(text, prints, following, next_prints)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds))], names=names[:7])

    joined = map_arrow(pairs.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"), join_ranges, f"doc_id {id_type}, {_ROW}")
    return found.filter("side IS NULL").drop("side", "text", "part").unionByName(joined)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """`docs` with `_fingerprint` of text; null text: that of the empty text."""
    n, at = len(docs.columns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(n)] + [pa.array(prints, pa.string())], names=batch.schema.names[:n] + ["_fingerprint"])

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _fingerprint string")


def bands(fingerprint: str, count: int, rows: int) -> list[str]:
    """Buckets of a fingerprint: marks at sampled steps, of its own level and of the next coarser one."""
    own = int(fingerprint.split(":")[1])
    out = []
    for level in (own, own + 1):
        marks = _marks(fingerprint, level)
        for b in range(count):
            pick = np.random.default_rng([9, b]).permutation(96)[:rows]
            got = bytes(int(marks[i]) if i < len(marks) else 48 for i in pick)
            out.append(f"{level}.{b}.{got.decode()}")
    return out


def near_documents(docs: DataFrame, least: float = 0.6, count: int = 16, rows: int = 5) -> DataFrame:
    """Links (doc_id, near_id, likeness) between fingerprints that share a band, verified: likeness of at least `least`.

    In every bucket the members are compared with its smallest fingerprint's document only, so a bucket gives no more links
    than it has members.  Equal fingerprints are linked to the smallest id among them.  Rows without doc_id take no part.
    """
    prints = written(fingerprint_documents(docs.select("doc_id", "text").filter("doc_id IS NOT NULL")).select("doc_id", "_fingerprint"), "fingerprints-all")
    kinds = prints.groupBy("_fingerprint").agg(F.min("doc_id").alias("doc_id"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = bands(f, count, rows)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(keys), pa.int64()), pa.array([f] * len(keys)), pa.array(keys)], names=["doc_id", "f", "bucket"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, j, likeness(f, g)) for i, f, j, g in zip(*(batch.column(k).to_pylist() for k in range(4)))]
            got = [x for x in got if x[2] >= least]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "near_id", "likeness"])

    dealt = written(map_arrow(kinds.select(F.col("doc_id").cast("long"), "_fingerprint"), deal, "doc_id long, f string, bucket string"), "fingerprints-bands")
    hubs = written(dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "f")).alias("h"), F.count("*").alias("n")).filter("n > 1").select("bucket", "h"), "fingerprints-hubs")
    pairs = dealt.join(hubs, "bucket").filter(F.col("doc_id") != F.col("h.doc_id")).select("doc_id", "f", F.col("h.doc_id").alias("near_id"), F.col("h.f").alias("g")).distinct()
    links = map_arrow(pairs, verify, "doc_id long, near_id long, likeness double")
    same = prints.join(kinds.withColumnRenamed("doc_id", "near_id"), "_fingerprint").filter("doc_id != near_id").select(F.col("doc_id").cast("long"), F.col("near_id").cast("long"), F.lit(1.0).alias("likeness"))
    return links.unionByName(same)


def op2_edit_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprinted_with_next(docs)
