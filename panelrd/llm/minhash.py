"""Near-duplicates by MinHash: one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

Documents with equal shingle sets are one class.  A class is hashed once into BANDS x ROWS bins, of which empty ones borrow
from a bin drawn by a hash until that is not empty; each band of bins is a bucket.  Instead of all pairs, a bucket gives
the edges from its hub to its other members; the hub is the member whose buckets are largest in sum, which in a group of copies
is the text nearest to all of them.  Edges are confirmed on the full sets.  While a bucket holds members of several
components, the most central member of a component that had no hub yet becomes the next hub, until a round over all
buckets finds no new link or few of its edges, or for ROUNDS rounds.  Links that no hub has seen are then found exactly: the classes of buckets that still hold several
components are joined across components on the rarest shingles of each, of which two near classes must share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelrd.llm.common import RangeHash, blocks, flat_text, free_name, lower_ascii, map_arrow, mix, row_key, signed, word_hashes, written
from panelrd.llm.components import components

SHINGLE, SIMILARITY = 5, 75
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
#: Rounds of further hubs; the exact join finds what they leave.
ROUNDS = 8
#: A round that confirms fewer than one in so many of its edges is the last: each takes up to a row for every member of a bucket.
WORTH = 100
_PROBES = np.random.default_rng(77).integers(0, BINS, (2048, BINS))
_ODD = np.random.default_rng(78).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted different hashes of the `size`-word shingles of each row; fewer words are one shingle, none give an empty set."""
    hashes, _, _, at = word_hashes(lower_ascii(data), offsets)
    if not len(hashes):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    ranges = RangeHash(hashes)
    every = ranges.every(size) if len(hashes) >= size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        else:
            out.append(ranges(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows x BINS smallest hashes by bin; all sets must hold something."""
    out = np.zeros((len(sets), BINS), dtype=np.uint64)
    full = np.zeros((len(sets), BINS), dtype=bool)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << shift
    for i, s in enumerate(sets):
        first = np.searchsorted(s, edges)
        have = np.diff(np.append(first, len(s))) > 0
        out[i, have], full[i] = s[first[have]], have
    row, col = np.nonzero(~full)
    for probe in _PROBES:  # with one full bin, a probe fails to find it in all 2048 draws once in ten million bins
        if not len(row):
            break
        source = probe[col]
        hit = full[row, source]
        out[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for i, c in zip(row, col):  # then the next full bin
        out[i, c] = out[i, (c + 1 + int(np.argmax(np.roll(full[i], -c - 1)))) % BINS]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS)
    return mix((rows * _ODD).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def set_key(s: np.ndarray) -> int:
    return int(signed(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))])))[0])


def hashed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, n, class, buckets) of (doc_id, text); class and buckets are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column(2))
            n, key, buckets = [], [], []
            for i, j in blocks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                some = [s for s in sets if len(s)]
                bands = iter(signed(band_keys(signatures(some)))) if some else iter(())
                for s in sets:
                    n.append(len(s))
                    key.append(set_key(s) if len(s) else None)
                    buckets.append(next(bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "rid", "n", "class", "buckets"])

    rows = docs.select("doc_id", row_key("doc_id", "text").alias("rid"), "text")
    return map_arrow(rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, rid long, n long, class long, buckets array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, items array<long>) of the classes in `wanted` (class, rid), each from one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            data, offsets = flat_text(batch.column(1))
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            kind, items = [], []
            for i, j in blocks(offsets):
                for k, s in enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    if rid[i + k] != last:  # repeated rows come one after another
                        kind.append(i + k)
                        items.append(signed(s))
                    last = rid[i + k]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(kind, pa.int64())), pa.array(items, pa.list_(pa.int64()))], names=["class", "items"])

    rows = docs.select(row_key("doc_id", "text").alias("rid"), "text").join(wanted, "rid").select("rid", "text", "class")
    return map_arrow(rows, run, "class long, items array<long>")


def confirmed(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The edges (hub, class) whose sets share at least `similarity` per cent of their union."""
    member = edges.join(sets.withColumnRenamed("items", "a"), "class").select("hub", "class", "a")
    both = member.join(sets.select(F.col("class").alias("hub"), F.col("items").alias("b")), "hub")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(100 * shared >= similarity * (F.size("a") + F.size("b") - shared)).select(F.col("hub").alias("u"), F.col("class").alias("v"))


def apart_pairs(apart: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(hub, class): every pair of classes in `apart` (class, component), of different components, that can be near.

    Prefix filter: with shingles in one order for all, rare ones first, the first n - ceil(n * similarity / 100) + 1 shingles of
    two near sets share one, and behind the first that they share there must be enough of both.
    """
    held = sets.join(apart, "class").select("class", "component", F.size("items").alias("n"), "items")
    items = written(held.select("class", "component", "n", F.explode("items").alias("item")), "minhash-items")
    common = written(items.groupBy("item").agg(F.count("*").alias("often"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("often > 1"), "minhash-often")
    # shingles of a single class come before all others
    listed = items.join(common.select("item", "often"), "item").groupBy("class", "component", "n").agg(F.sort_array(F.collect_list(F.struct("often", "item"))).alias("s"))
    length = F.expr(f"n - (n * {similarity} + 99) div 100 + 1 - (n - size(s))")
    first = listed.filter(length > 0).select("class", "component", "n", F.expr("n - size(s)").alias("before"), F.slice("s", 1, length.cast("int")).alias("s"))
    first = first.select("class", "component", "n", "before", F.posexplode("s").alias("at", "s")).select("class", "component", "n", F.expr("before + at").alias("at"), F.col("s.item").alias("item"))
    first = written(first.join(common.filter("lo < hi").select("item"), "item"), "minhash-prefixes")
    other = first.select("item", *(F.col(c).alias(f"hub_{c}") for c in ("class", "component", "n", "at")))
    enough = F.expr(f"(100 + {similarity}) * least(n - at, hub_n - hub_at) >= {similarity} * (n + hub_n)")
    pairs = first.join(other, "item").filter((F.col("component") < F.col("hub_component")) & enough)
    return pairs.select(F.col("hub_class").alias("hub"), "class").distinct()


def classified(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """What near_duplicates returns, with rid (the row's key) and component (null without words)."""
    hashed = written(hashed_documents(docs), "minhash-docs")
    kinds = hashed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    kinds = written(kinds, "minhash-classes")
    places = kinds.select("class", F.explode("buckets").alias("bucket"))
    sizes = written(places.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "minhash-sizes")
    members = written(places.join(sizes, "bucket"), "minhash-members")
    size = members.count()
    weight = written(members.groupBy("class").agg(F.sum("size").alias("weight")).join(kinds.select("class", "n"), "class"), "minhash-weights", size)
    members = written(members.join(weight, "class").select("bucket", "class", "n", "weight"), "minhash-places", size)
    sets = written(full_sets(docs, kinds.select("rid", "class").join(weight.select("class"), "class")), "minhash-sets")
    hub_of = F.max(F.struct("weight", "class", "n")).alias("h")
    # the shared part of two sets is at most the smaller one
    could = 100 * F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")
    hubs = written(members.groupBy("bucket").agg(hub_of), "minhash-hubs", size)
    edges = members.join(hubs, "bucket").withColumn("hub", F.col("h.class")).withColumn("hub_n", F.col("h.n"))
    tested = written(edges.filter((F.col("class") != F.col("hub")) & could).select("hub", "class").distinct(), "minhash-edges0", size)
    links = written(confirmed(tested, sets, similarity), "minhash-links0")
    had = hubs.select("bucket", F.col("h.class").alias("hub"))
    step, worth = 0, True
    while True:
        step += 1
        reached = written(components(links, f"minhash{step}", size), f"minhash-reached{step}", size)
        # members by component; components that had a hub in a bucket are done there
        now = members.join(reached.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
        now = written(now, f"minhash-now{step}", size)
        if step > ROUNDS or not worth:
            break
        of_hub = now.join(had.withColumnRenamed("hub", "class"), ["bucket", "class"]).select("bucket", "component").distinct()
        hubs = now.join(of_hub, ["bucket", "component"], "left_anti").groupBy("bucket").agg(F.max(F.struct("weight", "class", "n", "component")).alias("h"))
        hubs = written(hubs, f"minhash-hubs{step}", size)
        edges = now.join(hubs, "bucket").filter(F.col("component") != F.col("h.component")).select(F.col("h.class").alias("hub"), "class", "n", F.col("h.n").alias("hub_n")).filter(could)
        pair = [F.greatest("hub", "class").alias("x"), F.least("hub", "class").alias("y")]
        fresh = edges.select("hub", "class", *pair).dropDuplicates(["x", "y"]).join(tested.select(*pair), ["x", "y"], "left_anti").select("hub", "class")
        fresh = written(fresh, f"minhash-edges{step}", size)
        if fresh.isEmpty():
            break
        new = written(confirmed(fresh, sets, similarity), f"minhash-links{step}")
        tested = tested.unionByName(fresh)
        found = new.count()
        if not found:
            break
        worth = found * WORTH >= fresh.count()
        had = had.unionByName(hubs.select("bucket", F.col("h.class").alias("hub")))
        links = links.unionByName(new)
    mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    apart = written(now.join(mixed, "bucket").select("class", "component").distinct(), "minhash-apart", size)
    if not apart.isEmpty():
        pair = [F.greatest("hub", "class").alias("x"), F.least("hub", "class").alias("y")]
        rest = apart_pairs(apart, sets, similarity).select("hub", "class", *pair).join(tested.select(*pair), ["x", "y"], "left_anti").select("hub", "class")
        new = written(confirmed(written(rest, "minhash-rest"), sets, similarity), "minhash-rest-links")
        if not new.isEmpty():
            reached = written(components(links.unionByName(new), "minhash-last", size), "minhash-reached-last", size)
    of_class = kinds.select("class", "least").join(reached.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    of_class = written(of_class, "minhash-of")
    least = written(of_class.groupBy("component").agg(F.min("least").alias("component_id")), "minhash-least")
    result = written(of_class.join(least, "component").select("class", "component", "component_id"), "minhash-result")
    joined = hashed.select("doc_id", "rid", "n", "class").join(result, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "rid", F.col("n").alias("n_shingles"), "component", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Components of (doc_id, text) under links of at least `similarity` per cent of shared 5-word shingles.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept (doc_id = component_id).
    Null texts and those without words are linked with nothing.  Repeated rows, and others with equal sets, are linked.
    A null doc_id is larger than all others, and its component_id is null if it reaches no other.  An empty table gives
    no rows; other columns are not read.  Shingles are compared by 64-bit hashes.
    """
    return classified(docs, similarity).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """`docs`, all columns, with one row of each component: that of the smallest doc_id.

    Of equal rows one stays, also of those without words, which are otherwise all kept.
    """
    found = classified(docs, similarity)
    group = [F.col("component"), F.when(F.col("component").isNull(), F.col("rid")).alias("alone")]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"]
    rid = free_name(docs.columns, "rid")
    kept = written(found.groupBy(*group).agg(first.alias(rid)).select(rid).distinct(), "minhash-kept")
    return docs.withColumn(rid, row_key("doc_id", "text")).join(kept, rid).dropDuplicates([rid]).select(*docs.columns)


def op3_minhash_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
