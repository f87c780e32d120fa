"""Approximate nearest neighbours by inner product: cross-polytope hashing.

Vectors are dealt to classes of nearly equal length.  In each they are scaled by its largest length and get one more
coordinate that makes them unit vectors, so that the largest inner product is the smallest angle.  A table hashes a unit
vector by fast pseudo-rotations (three rounds of random signs and a Hadamard transform) and the nearest signed axis; for many
vectors, several hashes are joined to a key, the last over fewer axes, so that buckets keep their size while the table
grows.  Queries probe, in every table of every class, the keys whose axes are next nearest.  How many tables and probes that
takes is measured: a bounded sample of queries is searched exactly, and of what finds enough of its neighbours, that is taken
which makes the fewest rows of vectors and probes.  A bucket's vectors and the queries that probe it meet in blocks of bounded size, where exact inner products are
taken.  Probes are taken in rounds, each up to three times what went before: a query brings along the score of its k-th best row so
far, and a block gives back only rows that reach it, so that a round makes few rows for a query however many buckets it probes.
Queries that found fewer rows than there are, or all where no choice finds enough, are searched against all rows, in blocks and
rounds of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelrd.llm.common import map_arrow, written

#: Vectors in a bucket (aimed at), rows of either side in a block.
BUCKET, BLOCK = 256, 2048
#: Largest length of a class over its smallest; tables and probes to choose from; queries searched exactly for that choice,
#: part of their neighbours that it must find, and part under which the index is not used.
LENGTHS, TABLES, PROBES = 1.25, (4, 8, 16, 32, 64), (4, 8, 12, 16, 24, 32, 64, 128)
TRIALS, AIM, LEAST = 64, 0.97, 0.92
#: Buckets or blocks that a query meets in its first round, and how many times as many it has met after each further one.
STEP = 4


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths; their number of columns is a power of two."""
    (rows, n), step = x.shape, 1
    x = np.ascontiguousarray(x.T)  # sums run over whole rows of numbers, however small the step
    while step < n:
        y = x.reshape(-1, 2, step, rows)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(n, rows)
        step *= 2
    return np.ascontiguousarray(x.T) / np.sqrt(n)


@dataclass
class CrossPolytope:
    """Hash tables `first` to `tables` - 1 over unit vectors of `dim` coordinates; `axes` has the axes used by each hash of a key."""

    dim: int
    axes: tuple[int, ...]
    tables: int
    seed: int = 5
    first: int = 0

    @classmethod
    def sized(cls, dim: int, rows: int, tables: int, bucket: int) -> CrossPolytope:
        wide, want, axes = 1 << (dim - 1).bit_length(), max(1.0, rows / bucket), []
        while want > 2 * wide:
            axes.append(wide)
            want /= 2 * wide
        axes.append(max(1, min(wide, 1 << max(0, round(np.log2(max(want, 1) / 2))))))
        return cls(dim, tuple(axes), tables)

    def rotated(self, v: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        wide = 1 << (self.dim - 1).bit_length()
        x = np.zeros((len(v), wide))
        x[:, : self.dim] = v
        for t in range(self.first, self.tables):
            for k in range(len(self.axes)):
                signs = np.random.default_rng([self.seed, t, k]).choice([-1.0, 1.0], (3, wide))
                y = x
                for s in signs:
                    y = hadamard(y * s)
                yield t, k, y[:, : self.axes[k]]

    def probes(self, v: np.ndarray, probes: int) -> np.ndarray:
        """Keys, rows x tables x probes: the nearest first; -1 where there are fewer."""
        out = np.full((len(v), self.tables - self.first, probes), -1, dtype=np.int64)
        keys = loss = None
        for t, k, y in self.rotated(v):
            signed = np.concatenate([y, -y], axis=1)
            m = min(probes, signed.shape[1])
            best = signed.argmax(axis=1)[:, None] if m == 1 else np.argsort(-signed, axis=1, kind="stable")[:, :m]
            value = np.take_along_axis(signed, best, axis=1)
            gap = (value[:, :1] - value) ** 2
            if k == 0:
                keys, loss = best.astype(np.int64), gap
            else:
                keys = (keys[:, :, None] * (2 * self.axes[k]) + best[:, None, :]).reshape(len(v), -1)
                loss = (loss[:, :, None] + gap[:, None, :]).reshape(len(v), -1)
            if loss.shape[1] > probes:
                first = np.argsort(loss, axis=1, kind="stable")[:, :probes]
                keys, loss = np.take_along_axis(keys, first, axis=1), np.take_along_axis(loss, first, axis=1)
            if k == len(self.axes) - 1:
                out[:, t - self.first, : keys.shape[1]] = keys * self.tables + t
        return out


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v array<double>) without null, empty, zero vectors and those with null or non-finite components."""
    v = vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(~bad & F.exists("v", lambda x: x != 0))


def _matrix(batch, name: str) -> np.ndarray:
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _lengths(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1, initial=0.0)
    most[most == 0] = 1
    return most * np.sqrt(((v / most[:, None]) ** 2).sum(axis=1))


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k best of a block by exact inner product, ties to smaller ids; a query's own id is left out.

    With `least`, only rows that reach a query's value in it.
    """
    rough = q @ v.T
    with np.errstate(over="ignore"):  # how far a product may be from the one summed row by row
        slack = 1e-14 * q.shape[1] * _lengths(q) * _lengths(v).max(initial=0.0)
    least = np.full(len(q_ids), -np.inf) if least is None else least
    floor = np.full(len(q_ids), -np.inf)
    np.subtract(least, slack, out=floor, where=np.isfinite(slack))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(np.fmax.reduce(rough, axis=1, initial=-np.inf) >= floor):
        r = rough[i]
        near = np.flatnonzero((r >= floor[i]) & (r > -np.inf) & (ids != q_ids[i]))
        if len(near) > k:
            near = near[r[near] >= np.partition(r[near], len(near) - k)[len(near) - k] - slack[i]]
        exact = (v[near] * q[i]).sum(axis=1)  # summed row by row, so a pair's value does not depend on its block
        near, exact = near[exact >= least[i]], exact[exact >= least[i]]
        first = np.lexsort((ids[near], -exact))[:k]
        out.append((np.full(len(first), q_ids[i]), ids[near][first], exact[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class LengthClass:
    """Vectors of nearly equal length: the largest length and the hash tables of the class."""

    longest: float
    index: CrossPolytope

    @property
    def whole(self) -> bool:
        """Few vectors: one table of two keys, of which every query probes both."""
        return self.index.axes == (1,)

    def lifted(self, v: np.ndarray, asks: bool) -> np.ndarray:
        scaled = v / (_lengths(v)[:, None] if asks else self.longest)
        lift = np.zeros((len(v), 1)) if asks else np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1, keepdims=True)))
        return np.concatenate([scaled, lift], axis=1)


def length_classes(base: DataFrame, dim: int, tables: int, bucket: int) -> dict[int, LengthClass]:
    found = base.groupBy("c").agg(F.count("*").alias("n"), F.max("length").alias("longest")).collect()  # bounded: the classes of all doubles
    out = {}
    for r in found:
        index = CrossPolytope.sized(dim + 1, r["n"], tables, bucket)
        out[r["c"]] = LengthClass(float(r["longest"]), CrossPolytope(dim + 1, (1,), 1) if index.axes == (1,) else index)
    return out


def _best_rows(base: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> list:
    """The k best rows of all of `base` for a bounded set of queries, with their vectors and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _vectors(batch.column(1))
            asked, near, score = best_of_block(q_ids, q, ids, v, k)
            at = {int(x): i for i, x in enumerate(ids.tolist())}
            rows = pa.array([at[int(x)] for x in near], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(near, pa.int64()), pa.array(score, pa.float64()), batch.column(1).take(rows), batch.column(2).take(rows)], names=["query_id", "id", "score", "v", "c"])

    found = map_arrow(base.select("id", "v", "c"), run, "query_id long, id long, score double, v array<double>, c int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).collect()  # TRIALS x k rows


def _vectors(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def measured_choice(best: list, q_ids: np.ndarray, q: np.ndarray, classes: dict[int, LengthClass], tables: Sequence[int], probes: Sequence[int], each: float = 0.0) -> tuple[int, int, float]:
    """(tables, probes, recall): the least work whose recall on the trial queries reaches AIM, or else the most work.

    Work is the rows that meet: in every table each query's probes, and the vectors, of which there are `each` for a query.
    """
    if not best:
        return tables[0], probes[0], 1.0
    of = {int(x): i for i, x in enumerate(q_ids.tolist())}
    rank = np.full((len(best), max(tables)), np.inf)
    for c in {r["c"] for r in best}:
        mine = [i for i, r in enumerate(best) if r["c"] == c]
        kind = classes[c]
        if kind.whole:
            rank[mine] = 0
            continue
        asked = sorted({of[best[i]["query_id"]] for i in mine})
        keys = dict(zip(asked, kind.index.probes(kind.lifted(q[asked], True), max(probes))))
        stored = kind.index.probes(kind.lifted(np.array([best[i]["v"] for i in mine], dtype=np.float64), False), 1)[:, :, 0]
        for i, key in zip(mine, stored):
            hit = keys[of[best[i]["query_id"]]] == key[:, None]
            rank[i] = np.where(hit.any(axis=1), hit.argmax(axis=1), np.inf)
    found = {(t, p): float((rank[:, :t].min(axis=1) < p).mean()) for t in tables for p in probes}
    enough = [x for x, recall in found.items() if recall >= AIM]
    t, p = min(enough, key=lambda x: (x[0] * (each + x[1]), x[0])) if enough else (max(tables), max(probes))
    return t, p, found[t, p]


def _blockwise(left: DataFrame, right: DataFrame, on: Sequence[str], k: int) -> DataFrame:
    """(query_id, vec_id, score): for each block of `on`, the k best of its rows `left` (id, v) for each of its queries `right` (id, v, least) that reach its `least`."""

    def rerank(v: pa.Table, q: pa.Table) -> pa.Table:
        if not v.num_rows or not q.num_rows:
            a = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            a = best_of_block(q["id"].to_numpy(), _matrix(q, "v"), v["id"].to_numpy(), _matrix(v, "v"), k, q["least"].to_numpy())
        return pa.table({"query_id": pa.array(a[0], pa.int64()), "vec_id": pa.array(a[1], pa.int64()), "score": pa.array(a[2], pa.float64())})

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(rerank, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")


def _in_rounds(asked: DataFrame, rounds: Sequence, search_round: Callable[[DataFrame, tuple], DataFrame], k: int) -> DataFrame:
    """The k best rows for each query of all rounds; each is given the queries with the score of their k-th best row so far (least)."""
    found = None
    for part in rounds:
        if found is None:
            new = search_round(asked.withColumn("least", F.lit(float("-inf"))), part)
        else:
            reached = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
            new = search_round(asked.join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), part)
            new = found.drop("rank").unionByName(new)
        found = written(_ranked(new, k), "ann-found")
    return found


def _ranges(first: int, n: int) -> list[tuple[int, int]]:
    """0 to n - 1 in ranges [i, j): the first of `first`, then each up to STEP times the end of the one before."""
    ends = [0, min(first, n)]
    while ends[-1] < n:
        ends.append(min(STEP * ends[-1], n))
    return list(zip(ends, ends[1:]))


def probe_rounds(tables: int, probes: int) -> list[tuple[int, int, int, int]]:
    """(table from, to, probe from, to) of each round: the first table's probes in ranges, then ranges of tables, whose vectors are dealt once."""
    return [(0, 1, *x) for x in _ranges(STEP, probes)] + [(*x, 0, probes) for x in _ranges(1, tables)[1:]]


def _exact(base: DataFrame, n: int, asked: DataFrame, n_asked: int, k: int) -> DataFrame:
    """The k best of all rows for each query, in blocks of BLOCK rows by BLOCK queries."""
    v_blocks, q_blocks = -(-n // BLOCK), -(-n_asked // BLOCK)
    dealt = lambda blocks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")
    each = lambda start, end: F.explode(F.sequence(F.lit(start), F.lit(end - 1)))
    rows = base.select("id", "v").withColumn("v_block", dealt(v_blocks, 1))

    def blocks(asked: DataFrame, part: tuple[int, int]) -> DataFrame:
        left = map_arrow(rows.filter(F.col("v_block").between(part[0], part[1] - 1)), _packed, "id long, v binary, v_block int").withColumn("q_block", each(0, q_blocks))
        right = map_arrow(asked.select("id", "v", "least"), _packed, "id long, v binary, least double").withColumn("q_block", dealt(q_blocks, 2)).withColumn("v_block", each(*part))
        return _blockwise(left, right, ["v_block", "q_block"], k)

    return _in_rounds(asked, _ranges(STEP, v_blocks), blocks, k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in _vectors(batch.column(1))], pa.binary()), batch.column(2)], names=batch.schema.names)


def search(vectors: DataFrame, queries: DataFrame, id_column: str, column: str, k: int = 20, tables: Sequence[int] = TABLES, probes: Sequence[int] = PROBES, bucket: int = BUCKET) -> DataFrame:
    """The k nearest rows of `vectors` found for each row of `queries` (both with id_column and column).

    Returns query_id, rank (from 1), vec_id, score (inner product, in double precision, of the original vectors), nearest
    first and ties to the smaller id; a row with the query's id is no candidate.  Unusable vectors (null, empty, zero, with
    null or non-finite components, or of another length than most) and null ids take no part; rows that repeat an id and a
    vector count once; every query has k rows if there are k candidates; an empty table gives no rows.  Vectors may differ in
    length by any factor.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    usable_rows = usable(vectors, id_column, column)
    stats = usable_rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if stats is None:
        return spark.createDataFrame([], result)
    dim = stats["dim"]
    most = F.array_max(F.transform("v", F.abs))
    length = F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x / F.col("most"), 2)))
    one_dim = lambda df: df.filter(F.size("v") == dim).dropDuplicates(["id", "v"])
    base = one_dim(usable_rows).withColumn("most", most).withColumn("length", length).drop("most")
    # a class has its middle at length 1, so that rounding does not deal unit vectors to two
    base = written(base.withColumn("c", F.floor(F.log("length") / F.lit(float(np.log(LENGTHS))) + 0.5).cast("int")), "ann-base")
    asked = written(one_dim(usable(queries, id_column, column)), "ann-asked")
    sizes = base.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], result)
    classes = length_classes(base, dim, max(tables), bucket)
    trial = asked.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(TRIALS).collect()
    q_ids, q = np.array([r["id"] for r in trial]), np.array([r["v"] for r in trial], dtype=np.float64)
    use, ask, recall = measured_choice(_best_rows(base, q_ids, q, k), q_ids, q, classes, tables, probes, sizes["n"] / n_asked)
    if recall < LEAST:
        return _exact(base, sizes["n"], asked, n_asked, k)

    def keyed(kind: LengthClass, c: int, ids: np.ndarray, raw: np.ndarray, v: np.ndarray, least: np.ndarray | None, probed: tuple[int, int]) -> pa.RecordBatch:
        asks = least is not None
        keys = kind.index.probes(kind.lifted(v, asks), 2 if asks and kind.whole else probed[1])[:, :, probed[0] :].reshape(len(ids), -1)
        row, col = np.nonzero(keys >= 0)
        columns = {"c": pa.array(np.full(len(row), c, np.int32)), "key": pa.array(keys[row, col]), "id": pa.array(ids[row]), "v": pa.array(raw[row], pa.binary())}
        return pa.RecordBatch.from_pydict(columns | ({"least": pa.array(least[row])} if asks else {}))

    def hashed(part: tuple[int, int, int, int], asks: bool):
        t, end, *probed = part
        indexes = {c: x if x.whole else LengthClass(x.longest, CrossPolytope(x.index.dim, x.index.axes, end, first=t)) for c, x in classes.items() if not x.whole or (t, probed[0]) == (0, 0)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    ids, v = some.column(0).to_numpy(), _vectors(some.column(1))
                    raw = np.array([x.tobytes() for x in v], dtype=object)
                    last = some.column(2).to_numpy()
                    lengths = _lengths(v)
                    for c, kind in indexes.items():
                        # no row of a class is nearer than both lengths allow
                        mine = np.flatnonzero(last <= lengths * kind.longest * (1 + 1e-9) + 1e-100 if asks else last == c)
                        for i in range(0, len(mine), 64 if asks else 512):
                            x = mine[i : i + (64 if asks else 512)]
                            yield keyed(kind, c, ids[x], raw[x], v[x], last[x] if asks else None, tuple(probed) if asks else (0, 1))

        return run

    hashed_to = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    count = lambda df, name: df.groupBy("c", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    def buckets(asked: DataFrame, part: tuple[int, int, int, int]) -> DataFrame:
        stored = map_arrow(base.select("id", "v", "c"), hashed(part, False), "c int, key long, id long, v binary")
        probing = map_arrow(asked.select("id", "v", "least"), hashed(part, True), "c int, key long, id long, v binary, least double")
        # how many blocks a bucket has on either side; buckets that nobody probes are left out
        blocks = written(count(stored, "v_blocks").join(count(probing, "q_blocks"), ["c", "key"]), "ann-blocks")
        on = ["c", "key", "v_block", "q_block"]
        left = stored.join(blocks, ["c", "key"]).withColumn("v_block", hashed_to("v_blocks", 1)).withColumn("q_block", each("q_blocks")).select(*on, "id", "v")
        right = probing.join(blocks, ["c", "key"]).withColumn("q_block", hashed_to("q_blocks", 2)).withColumn("v_block", each("v_blocks")).select(*on, "id", "v", "least")
        return _blockwise(left, right, on, k)

    found = _in_rounds(asked, probe_rounds(use, ask), buckets, k)
    # a query with fewer rows than there are candidates is searched against all rows
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, sizes["ids"] - 1)).select(F.col("query_id").alias("id"))
    short = written(asked.join(full, "id", "left_anti"), "ann-short")
    n_short = short.count()
    if not n_short:
        return found
    again = _exact(base, sizes["n"], short, n_short, k)
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(again)


def op9_nearest_neighbours(embeddings: DataFrame) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20, against all rows."""
    return search(embeddings, embeddings.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding")
