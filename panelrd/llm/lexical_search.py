"""Ranked lexical search: MaxScore whose bounds are tightened by pairs of terms.

Items (queries) are searched in blocks against all documents.  For the terms of a block of items the documents are read once into
a forward table, from which N, L and the document frequencies follow.  The index is a table of blocks of documents: the
postings of each term with their impacts, the largest impact of each term, and for pairs of terms the largest impact of both
together over their intersection, which is at most the sum of the two, and mostly less.

At query time an item's terms are units, pairs where one is stored and single terms else.  A unit adds at most its joint
maximum, or the larger single one, to a document's score.  Units whose bounds together stay under the score of the k-th
best document so far are not essential: only documents with a posting of an essential unit are looked at, and one that
cannot reach that score any more is dropped.  Each pair's joint maximum is also the score that some document reaches at
least, so the k-th largest of these over blocks is where the search begins, and a block below it is skipped whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelrd.llm.common import byte_values, RangeHash, cut_blocks, flat_text, lower_ascii, map_arrow, words, written

#: Best documents of an item; items and bytes of their texts searched at once; documents and postings of an index block.
TOP, ITEMS_AT_ONCE, ITEM_BYTES = 20, 4096, 16 << 20
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 500_000
_LAST = (1 << 63) - 1

#: Terms are `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`: in UTF-8 these bytes separate them.
_BETWEEN = np.zeros(256, dtype=bool)
for _first, _end in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BETWEEN[_first : _end + 1] = True


def terms_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, hashes, terms of each of the block's parts) for blocks of a text column: a hash for each term of it."""
    data, offsets = flat_text(column)
    for rows, part, at in cut_blocks(data, offsets, _BETWEEN):
        part = lower_ascii(part)
        start, end, of = words(part, at, _BETWEEN)
        hashes = RangeHash(byte_values(part))(start, end) if len(start) else np.zeros(0, np.uint64)
        yield np.repeat(rows, np.diff(of)), hashes, rows


def counted(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different (row, term) with their counts, in order."""
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], terms[first], np.diff(np.append(first, len(rows)))


def item_terms(items: DataFrame) -> DataFrame:
    """(item, terms, times) of (item_id, text): the hashes of an item's terms and how often it has them; repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(rows, hashes.view(np.int64)) for rows, hashes, _ in terms_of(batch.column(1))]
            rows, terms, times = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int64())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["item_id", "terms", "times"])

    kind = dict(items.dtypes)["item_id"]
    return map_arrow(items.select("item_id", F.col("text").cast("string").alias("text")).distinct(), run, f"item_id {kind}, terms array<long>, times array<long>")


def forward_table(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row with a term: its number of terms, and places in `vocabulary` with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            found = []
            for rows, hashes, _ in terms_of(batch.column(1)):
                n += np.bincount(rows, minlength=batch.num_rows)
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                found.append(counted(rows[known], at[known]))
            rows, terms, tfs = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            if len(found) > 1 and np.any(rows[1:] < rows[:-1]) | np.any((rows[1:] == rows[:-1]) & (terms[1:] <= terms[:-1])):  # a row in several blocks
                order = np.lexsort((terms, rows))
                rows, terms, tfs = rows[order], terms[order], tfs[order]
                first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])))
                rows, terms, tfs = rows[first], terms[first], np.add.reduceat(tfs, first)
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int32))) for x in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n long, terms array<int>, tfs array<int>")


@dataclass
class Queries:
    """Items as units of terms: unit u of item i has the places first and second (-1: none) in the vocabulary, with factors times * weight."""

    item: np.ndarray
    first: np.ndarray
    second: np.ndarray
    factor: np.ndarray
    factor_second: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> Queries:
        """Terms without weight are left out; the others are paired in order of their weights, so that like terms share a bound."""
        rows = []
        for i, (places, times) in enumerate(items):
            factor = weights[places] * times
            keep = np.argsort(-factor, kind="stable")[: int((factor > 0).sum())].tolist()
            for a in range(0, len(keep), 2):
                b = keep[a + 1] if a + 1 < len(keep) else None
                rows.append((i, places[keep[a]], -1 if b is None else places[b], factor[keep[a]], 0 if b is None else factor[b]))
        columns = [np.array(c, dtype=np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5
        return cls(*columns, starts=np.searchsorted(columns[0], np.arange(len(items) + 1)))


_INDEX = "doc_ids array<long>, terms array<int>, starts array<int>, rows array<int>, impacts array<int>, most array<int>, joint array<long>, attained array<long>"


def _index_block(doc_id: np.ndarray, n: np.ndarray, count: np.ndarray, terms: np.ndarray, tfs: np.ndarray, queries: Queries, scale: tuple[int, int]) -> tuple:
    """The row of _INDEX for one block of documents."""
    total, length = scale
    m = 75 + 25 * n * total // length
    rows = np.repeat(np.arange(len(n)), count)
    impacts = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[rows])
    order = np.argsort(terms, kind="stable")
    terms, rows, impacts = terms[order], rows[order], impacts[order]
    different, starts = np.unique(terms, return_index=True)
    ends = np.append(starts[1:], len(terms))
    most = np.maximum.reduceat(impacts, starts) if len(starts) else np.zeros(0, np.int64)
    joint = np.zeros(len(queries.item), dtype=np.int64)
    dense = np.zeros(len(n), dtype=np.int64)
    place = {int(t): k for k, t in enumerate(different.tolist())}
    for u, (a, b, fa, fb) in enumerate(zip(queries.first.tolist(), queries.second.tolist(), queries.factor.tolist(), queries.factor_second.tolist())):
        i, j = place.get(a), place.get(b)
        if i is None or j is None:
            continue
        if ends[i] - starts[i] < ends[j] - starts[j]:
            i, j, fa, fb = j, i, fb, fa
        mine, its = slice(starts[i], ends[i]), slice(starts[j], ends[j])
        dense[rows[mine]] = impacts[mine]
        both = dense[rows[its]]
        both = np.where(both > 0, fa * both + fb * impacts[its], 0)
        joint[u] = both.max()
        dense[rows[mine]] = 0
    alone = _unit_most(queries, different, most)
    reached = np.maximum(joint, alone)
    attained = np.maximum.reduceat(np.append(reached, 0), np.minimum(queries.starts[:-1], len(reached))) if len(queries.starts) > 1 else np.zeros(0, np.int64)
    attained = np.where(np.diff(queries.starts) > 0, attained, 0)
    return doc_id, different, np.append(starts, len(terms)), rows, impacts, most, joint, attained


def _at(different: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where `places` stand in `different`; -1 where they don't."""
    if not len(different):
        return np.full(len(places), -1)
    at = np.minimum(np.searchsorted(different, places), len(different) - 1)
    return np.where(different[at] == places, at, -1)


def _unit_most(queries: Queries, different: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The larger of the single maxima of each unit's terms."""
    padded = np.append(most, 0)
    return np.maximum(queries.factor * padded[_at(different, queries.first)], queries.factor_second * padded[_at(different, queries.second)])


def index_blocks(forward: DataFrame, queries: Queries, scale: tuple[int, int]) -> DataFrame:
    """The index over all rows of a forward table: a row for each block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.int64() if "long" in x else pa.int32()) for x in _INDEX.split(", ")]
        names = [x.split()[0] for x in _INDEX.split(", ")]

        def pack(held: list[tuple]) -> pa.RecordBatch:
            row = _index_block(*(np.concatenate(c) for c in zip(*held)), queries, scale)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

        held, docs, postings = [], 0, 0
        for batch in batches:
            ids = batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
            n, count = batch.column(1).to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            terms, tfs = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            ends = np.append(0, np.cumsum(count))
            i = 0
            while i < len(ids):
                j = min(len(ids), i + BLOCK_DOCS - docs, max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK_POSTINGS - postings, side="right")) - 1))
                held.append((ids[i:j], n[i:j], count[i:j], terms[ends[i] : ends[j]], tfs[ends[i] : ends[j]]))
                docs, postings = docs + j - i, postings + int(ends[j] - ends[i])
                i = j
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS or i < len(ids):
                    yield pack(held)
                    held, docs, postings = [], 0, 0
        if held:
            yield pack(held)

    return map_arrow(forward, run, _INDEX)


class BlockSearch:
    """The best documents of every item so far, and the scores to reach."""

    def __init__(self, queries: Queries, least: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.least = least.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(least)
        self.scored = 0

    def add(self, doc_ids: np.ndarray, terms: np.ndarray, starts: np.ndarray, rows: np.ndarray, impacts: np.ndarray, most: np.ndarray, joint: np.ndarray) -> None:
        q = self.queries
        bounds = np.maximum(joint, _unit_most(q, terms, most))
        first, second = _at(terms, q.first), _at(terms, q.second)
        for i in range(len(self.least)):
            units = np.arange(q.starts[i], q.starts[i + 1])
            units = units[bounds[units] > 0]
            units = units[np.argsort(bounds[units], kind="stable")]
            below = np.cumsum(bounds[units])  # what the units up to each can add together
            least = self.least[i]
            if not len(units) or below[-1] < least:
                continue
            essential = int(np.searchsorted(below, max(least, 1), side="left"))
            lists = [[(int(p[u]), int(f[u])) for p, f in ((first, q.factor), (second, q.factor_second)) if p[u] >= 0] for u in units]
            scores = np.zeros(len(doc_ids), dtype=np.int64)
            for unit in lists[essential:]:
                for at, factor in unit:
                    mine = slice(starts[at], starts[at + 1])
                    scores[rows[mine]] += factor * impacts[mine]
            rest = int(below[essential - 1]) if essential else 0
            live = np.flatnonzero((scores > 0) & (scores + rest >= least))
            for u in range(essential - 1, -1, -1):
                if not len(live):
                    break
                for at, factor in lists[u]:
                    mine = rows[starts[at] : starts[at + 1]]
                    where = np.minimum(np.searchsorted(mine, live), len(mine) - 1)
                    scores[live] += np.where(mine[where] == live, factor * impacts[starts[at] + where], 0)
                live = live[scores[live] + (int(below[u - 1]) if u else 0) >= least]
            self.scored += len(live)
            if len(live):
                self._keep(i, doc_ids[live], scores[live])

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.append(self.best[i][0], ids), np.append(self.best[i][1], scores)
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[i] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], scores[order[-1]])


def search_blocks(index: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in each task's part of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = BlockSearch(queries, least, k)
        for batch in batches:
            for r in range(batch.num_rows):
                search.add(*(batch.column(c).slice(r, 1).flatten().to_numpy().astype(np.int64) for c in range(7)))
        item = np.repeat(np.arange(len(least)), [len(b[0]) for b in search.best])
        ids, scores = (np.concatenate([b[c] for b in search.best]) if search.best else np.zeros(0, np.int64) for c in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _LAST), pa.array(scores)], names=["item", "doc_id", "score"])

    return map_arrow(index.select(*(x.split()[0] for x in _INDEX.split(", ")[:7])), run, "item long, doc_id long, score long")


def _search_at_once(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    found = items.collect()  # a bounded block of items
    hashes = [np.array(r["terms"], dtype=np.int64).view(np.uint64) for r in found]
    vocabulary = np.unique(np.concatenate(hashes)) if found else np.zeros(0, np.uint64)
    places = [(np.searchsorted(vocabulary, h), np.array(r["times"], dtype=np.int64)) for h, r in zip(hashes, found)]
    forward = written(forward_table(docs, vocabulary), "lexical-forward")
    size = forward.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    total, length = int(size["n"]), int(size["l"] or 1)
    holding = np.zeros(len(vocabulary), dtype=np.int64)
    for r in forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row for each term of the items
        holding[r["term"]] = r["df"]
    weights = np.floor(1000 * np.log((2.0 * total + 2) / (2.0 * holding + 1))).astype(np.int64)
    queries = Queries.of(places, weights)
    index = written(index_blocks(forward, queries, (total, length)), "lexical-index")
    reached = index.select(F.posexplode("attained").alias("item", "score")).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    least = np.zeros(len(found), dtype=np.int64)
    for r in reached.filter(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
        least[r["item"]] = r["score"]
    best = search_blocks(index, queries, least, k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
    kind = dict(items.dtypes)["item_id"]
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(found)], f"item long, item_id {kind}")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The `k` highest-scoring documents of (doc_id, text) for each of `items` (item_id, text): item_id, rank, doc_id, score.

    Items go in blocks of about `items_at_once`; each block is one pass over the documents.  Equal scores go by ascending doc_id, a
    null doc_id last.  Null and empty texts have no terms: such a document is not counted, such an item has no rows.  Repeated
    rows of `docs` are documents each, with a rank each; repeated rows of `items` count once; items that share an id but not
    a text are ranked each.  Empty tables give no rows; other columns are not read.  Terms are compared by 64-bit hashes.
    """
    known = written(item_terms(items).filter(F.size("terms") > 0), "lexical-items")
    size = known.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    parts = max(1, -(-size["n"] // items_at_once), -(-(size["terms"] or 0) * 16 // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id", "terms"), F.lit(parts))
    out = [_search_at_once(docs, known.filter(block == b) if parts > 1 else known, k) for b in range(parts)]
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first


def op13_ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP13_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '{_TERM}') AS terms FROM documents
), held AS (
  SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts
), counted AS (
  SELECT r, doc_id, n, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM held
), asked AS (
  SELECT q, item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM benchmark)
), times AS (
  SELECT q, item_id, term, count(*) AS times FROM asked GROUP BY ALL
), postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM counted WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), size AS (
  SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS l FROM texts WHERE len(terms) > 0
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, size GROUP BY term, n_docs
), scored AS (
  SELECT t.q, t.item_id, p.r, p.doc_id, CAST(sum(t.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n_docs) // s.l)))) AS BIGINT) AS score
  FROM times t JOIN postings p USING (term) JOIN weights w USING (term), size s GROUP BY t.q, t.item_id, p.r, p.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
