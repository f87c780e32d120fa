"""Helpers shared by the operators: intermediate tables, text buffers and vectorised hashing of words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a task hashes at once (numpy needs about 60 times as much); a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

#: Short rows that one task writes, in steps over tables whose size is known.
ROWS_PER_TASK = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

#: Words are `[^\x20\x09-\x0D]+`: only these six bytes separate them.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`, shared by driver and executors.

    Where it is unset, a temporary folder is taken if driver and executors are one local process (tests);
    on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="panelrd-shared-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts the lineage, survives lost executors.

    Where the number of its rows is known (about), as many tasks write it as the rows ask for: steps over small tables,
    repeated many times, then do not wait for hundreds of empty tasks.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="panelrd-code-")) / "panelrd_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted((root / "panelrd").rglob("*.py")):
            out.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(taken, name: str) -> str:
    """A column name that none of `taken` has, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def row_key(*columns: str):
    """A 64-bit key of a row: equal rows share it, so a repeated row gets its twin's result."""
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))


def flat_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about `size` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def cut_blocks(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE, size: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows, data, offsets) of about `size` bytes; a longer row is cut between words, so a row may go over several blocks.

    rows tells the row of each of a block's parts.
    """
    cuts = []
    for i in np.flatnonzero(np.diff(offsets) > size).tolist():
        at = int(offsets[i]) + size
        while at < offsets[i + 1]:
            while at < offsets[i + 1] and not (gap := between[data[at : min(at + 4096, offsets[i + 1])]]).any():
                at += 4096
            if at >= offsets[i + 1]:
                break
            at += int(gap.argmax())
            cuts.append(at)
            at += size
    every = np.sort(np.concatenate([offsets, np.asarray(cuts, dtype=offsets.dtype)]))
    rows = np.searchsorted(offsets, every[:-1], side="right") - 1
    for i, j in blocks(every, size):
        yield rows[i:j], data[every[i] : every[j]], every[i : j + 1] - every[i]


#: Bytes of input that a Python function over Arrow batches gets at once.
BATCH_BYTES = 8 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about BATCH_BYTES, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if n:
            step = max(1, int(n * BATCH_BYTES // max(batch.nbytes, 1)))
            for at in range(0, n, step):
                part = batch.slice(at, min(step, n - at))
                while part.nbytes > 2 * BATCH_BYTES and part.num_rows > 1:  # long rows stand together
                    yield part.slice(0, half := part.num_rows // 2)
                    part = part.slice(half)
                yield part


def give_back() -> None:
    """Return the memory that this worker has freed to the system: it stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What this worker remembers under `name`, from one task to the next of functions that keep it."""
    return _KEPT.setdefault(name, {})


def map_arrow(df: DataFrame, fn, ddl: str, keeps: str | None = None) -> DataFrame:
    """`df.mapInArrow(fn, ddl)` over slices bounded in bytes; at the end of each task its worker gives freed memory back.

    What the worker has `kept` under other names than `keeps` is forgotten: it does other work now.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [x for x in _KEPT if x != keeps]:
            del _KEPT[name]
        try:
            yield from fn(_parts(batches))
        finally:
            give_back()

    return df.mapInArrow(run, ddl)


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size > 4 * BLOCK_BYTES:  # a very long text: not kept
            return have[:n]
        _POWERS[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class RangeHash:
    """64-bit polynomial hashes of any ranges of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * _powers("up", n), out=self.sums[1:])
        self.down = _powers("down", n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _BASE)

    def every(self, k: int) -> np.ndarray:
        """The hash of each range of k values."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k] + np.uint64(k) * _BASE)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of the rows, and the offsets of the rows' words; `between` tells which bytes separate words."""
    space = between[data]
    begins = ~space
    begins[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    word = ~space
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the offsets of the rows' words."""
    start, end, at = words(data, offsets, between)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, at
    return RangeHash(byte_values(data))(start, end), start, end, at


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
