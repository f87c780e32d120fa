"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its leading tokens (one with a digit is a field).  In a leaf that lines
of enough documents reach, the lines are generalised to templates: at each place behind the leading tokens, a token that enough
documents, and a good part of the leaf's, have there is constant, all others and those with digits are variable fields.  A
template that recurs in enough documents, and has enough constants behind the leading tokens, is dropped everywhere but
in the document with the smallest id.  So is a line that recurs as it stands but for its digits.  A line of fewer tokens than the
tree asks for has a leaf of its own text, so it recurs only as it stands.

Counts are sums with a map-side combine, first over leaves, then over different lines of busy leaves only, so no leaf is
ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelrd.llm.common import blocks, free_name, flat_text, map_arrow, mix, row_key, signed, word_hashes, written

#: Documents that make a leaf, a token or a template common; least tokens of a line; leading tokens in the tree; least part of
#: a template's other tokens that must be constant; least part of a leaf's documents that have a constant token.
MIN_DOCS, MIN_TOKENS, DEPTH, CONSTANT_PART, SHARE = 10, 4, 3, 0.5, 0.1
_FIELD = np.uint64(0x5BD1E995)
_NEWLINE, _ZERO, _NINE = 10, 48, 57
_LAST = (1 << 63) - 1


@dataclass
class Lines:
    """Lines of a block: their row, number in it, leaf, and the hashes of their tokens."""

    row: np.ndarray
    number: np.ndarray
    leaf: np.ndarray
    first: np.ndarray
    count: np.ndarray
    tokens: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray, short_lines: bool, min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> Lines:
    """Lines of at least `min_tokens` tokens and, with `short_lines`, all others that hold any, whose tokens have no fields."""
    hashes, start, end, at = word_hashes(data, offsets)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return Lines(none, none, none, none, none, np.zeros(0, np.uint64))
    digits = np.append(0, np.cumsum((data >= _ZERO) & (data <= _NINE)))
    masked = digits[end] > digits[start]
    breaks = np.append(0, np.cumsum(data == _NEWLINE))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    number = breaks[start] - breaks[offsets[row]]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1])))
    count = np.diff(np.append(first, len(row)))
    short = count < max(min_tokens, depth)
    hashes = np.where(masked & ~np.repeat(short, count), _FIELD, hashes)
    if not short_lines:
        first, count, short = first[~short], count[~short], short[~short]
    leaf = count.astype(np.uint64)
    for k in range(max(min_tokens, depth)):
        on = np.flatnonzero(np.where(short, count, depth) > k)
        leaf[on] = mix(leaf[on] * np.uint64(31) + hashes[first[on] + k])
    return Lines(row[first], number[first], signed(leaf), first, count, hashes)


def leaves_of_documents(rows: DataFrame, short_lines: bool) -> DataFrame:
    """(rid, leaf, line) of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = flat_text(batch.column(1))
            for i, j in blocks(offsets):
                found = lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], short_lines)
                yield pa.RecordBatch.from_arrays([pa.array(rid[i + found.row]), pa.array(found.leaf), pa.array(found.number.astype(np.int32))], names=["rid", "leaf", "line"])

    return map_arrow(rows.select("rid", "text"), run, "rid long, leaf long, line int")


def tokens_of_lines(rows: DataFrame, wanted: DataFrame, short_lines: bool) -> DataFrame:
    """(rid, ord, line, leaf, whole, tokens): the token hashes of the lines in `wanted` (rid, line); whole is the hash of all."""
    by_row = wanted.groupBy("rid").agg(F.collect_set("line").alias("lines"))
    joined = rows.select("rid", "ord", "text").join(by_row, "rid").select("rid", "ord", "text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, order = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lines = batch.column(3).to_pylist()
            data, offsets = flat_text(batch.column(2))
            for i, j in blocks(offsets):
                found = lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], short_lines)
                asked = [set(x) for x in lines[i:j]]
                use = [k for k, (r, n) in enumerate(zip(found.row.tolist(), found.number.tolist())) if n in asked[r]]
                tokens = [signed(found.tokens[found.first[k] : found.first[k] + found.count[k]]) for k in use]
                whole = [int(signed(mix(np.array([(mix(t.view(np.uint64)) * (2 * np.arange(len(t), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64)])))[0]) for t in tokens]
                row = i + found.row[use] if use else np.zeros(0, np.int64)
                columns = [pa.array(rid[row]), pa.array(order[row]), pa.array(found.number[use].astype(np.int32)), pa.array(found.leaf[use]), pa.array(whole, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "ord", "line", "leaf", "whole", "tokens"])

    return map_arrow(joined, run, "rid long, ord long, line int, leaf long, whole long, tokens array<long>")


def recurring_lines(rows: DataFrame, min_docs: int = MIN_DOCS, constant_part: float = CONSTANT_PART, short_lines: bool = False, share: float = SHARE) -> DataFrame:
    """(rid, line) to drop from `rows` (rid, ord, text): lines of recurring templates, but for the document of least ord."""
    slim = written(leaves_of_documents(rows, short_lines), "lines-slim")
    busy = slim.select("rid", "leaf").distinct().groupBy("leaf").agg(F.count("*").alias("leaf_docs")).filter(F.col("leaf_docs") >= min_docs)
    busy = written(busy, "lines-busy")
    wanted = written(slim.join(busy, "leaf").select("rid", "line"), "lines-wanted")
    lines = written(tokens_of_lines(rows, wanted, short_lines), "lines-tokens")
    different = written(lines.groupBy("leaf", "whole").agg(F.count_distinct("rid").alias("docs"), F.first("tokens").alias("tokens")), "lines-different")
    size, field = F.size("tokens"), int(_FIELD)
    short = size < max(MIN_TOKENS, DEPTH)
    # a line that recurs as it stands, but for its fields
    plain = F.size(F.filter("tokens", lambda t: t != field))
    exact = different.filter((F.col("docs") >= min_docs) & (short | (plain >= constant_part * size))).select("leaf", "whole", F.xxhash64(F.lit("line"), "leaf", "whole").alias("template"))
    # and one that does so in its constants behind the leading tokens, which all lines of the leaf share
    token = different.filter(~short).select("leaf", "whole", "docs", F.posexplode("tokens").alias("place", "token")).filter((F.col("token") != field) & (F.col("place") >= DEPTH))
    often = token.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("n")).filter(F.col("n") >= min_docs)
    constant = written(often.join(busy, "leaf").filter(F.col("n") >= share * F.col("leaf_docs")).select("leaf", "place", "token"), "lines-constants")
    kept = token.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "whole").agg(F.count("*").alias("constants"), F.sum(F.xxhash64("place", "token").cast("decimal(38,0)")).alias("sum"))
    general = different.select("leaf", "whole", size.alias("size")).join(kept, ["leaf", "whole"]).filter(F.col("constants") >= constant_part * (F.col("size") - DEPTH))
    template = written(exact.unionByName(general.select("leaf", "whole", F.xxhash64(F.lit("template"), "leaf", "constants", "sum").alias("template"))), "lines-templates")
    placed = written(lines.select("rid", "ord", "line", "leaf", "whole").join(template, ["leaf", "whole"]).select("rid", "ord", "line", "template"), "lines-placed")
    recurring = placed.select("template", "rid", "ord").distinct().groupBy("template").agg(F.count("*").alias("n"), F.min("ord").alias("first")).filter(F.col("n") >= min_docs)
    return placed.join(written(recurring, "lines-recurring"), "template").filter(F.col("ord") > F.col("first")).select("rid", "line").distinct()


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, constant_part: float = CONSTANT_PART, short_lines: bool = False) -> DataFrame:
    """`docs` (doc_id, text and others) with _n_lines, _n_removed and _kept: the text without its recurring lines.

    Lines end at line feeds.  A null text stays null with no lines; an empty one has none.  A null doc_id is larger than all
    others.  Of documents with equal ids, all keep the first occurrence.  Lines of fewer than MIN_TOKENS tokens stay or,
    with `short_lines`, recur if they do so token for token.  All columns of `docs` stay, but for those named as the three new ones; an empty table gives no rows.
    """
    docs = docs.drop("_n_lines", "_n_removed", "_kept")
    columns = docs.columns
    rid, gone_lines = free_name(columns, "rid"), free_name(columns, "lines")
    keyed = docs.withColumn(rid, row_key("doc_id", "text"))
    rows = keyed.select(F.col(rid).alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), "text")
    dropped = recurring_lines(rows, min_docs, constant_part, short_lines).groupBy(F.col("rid").alias(rid)).agg(F.collect_set("line").alias(gone_lines))
    joined = keyed.join(dropped, rid, "left").select(*columns, gone_lines)
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                if not text:
                    out.append((0, 0, text))
                elif not lines:
                    out.append((text.count("\n") + 1, 0, text))
                else:
                    gone = set(lines)
                    every = text.split("\n")
                    out.append((len(every), len(gone), "\n".join(x for k, x in enumerate(every) if k not in gone)))
            n, removed, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(columns))] + [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "_n_lines", "_n_removed", "_kept"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(joined, cut, ddl + ", _n_lines long, _n_removed long, _kept string")


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"), short_lines=True)
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
