"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a weight and a schedule: its share of the tokens drawn at training time t in [0, 1] is proportional to
1 + slope (2t - 1).  Integrating the schedule gives the part of the source's target that is due by time t; inverting
that integral at a document's place in its source's token stream gives the document's training position.

The token stream of a source is its documents in the order of a hash of their ids, repeated until the target is met.
Places in the stream are prefix sums in two levels (within a hash bucket, then over the buckets), so that a source
with a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelrd.llm.common import row_key, written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: Sequence[float], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(at - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources from rows (source, source_size).

    The sources, by code point and null last, take the weights in turn and share `share` times the sum of sizes; a target
    stops at `most` times its source's size and the excess is shared again by weight until none is above.  That fixed
    point has a closed form: with the sources sorted by cap over weight, the first k are at their caps and the others
    get one common rate.  Windows without partitions run over one row per source only.
    """
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", _cycle(weights, F.col("place")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    below = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "place").rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("ratio", "place")
    rates = ranked.withColumn("rate", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
    common = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "place", "rate"))).over(every)["rate"]
    return rates.withColumn("common", common).select("source", "place", "weight", "source_size", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target"))


def curriculum_position(drawn: Column, slope: Column) -> Column:
    """The time t in [0, 1] by which the part `drawn` of a source's target is due: solves slope t^2 + (1 - slope) t = drawn."""
    flat = 1 - slope
    return 2 * drawn / (flat + F.sqrt(flat * flat + 4 * slope * drawn))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), slopes: Sequence[float] = (0.5, 0.0, -0.5), share: float = 1.5, most: int = 2, digits: int = 3) -> DataFrame:
    """How often each document of (doc_id, text, source) is drawn, and when.

    Returns one row per different document row: row_key, doc_id, source, n_rows (equal rows it stands for), size (words of
    one), source_size, target, copies, taken (words, of one row), positions (array of double, one for each copy).  A source's
    stream is cut at the document whose middle passes the target, so its taken words miss the target by half a document
    at most (by half of all its repeats where rows repeat).

    Null text: size 0.  Null source: a source of its own, last.  Null doc_id: any other id.  A source without words has
    target 0 and positions at 0.  Empty table: no rows.  Other columns are not read.
    """
    size = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_key("doc_id", "source", "text").alias("row_key"))
    size = size.groupBy("row_key", "doc_id", "source", "size").agg(F.count("*").alias("n_rows"))
    size = written(size.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes").withColumn("bucket", F.substring("h", 1, digits))
    mass = F.col("size") * F.col("n_rows")
    buckets = size.groupBy("source", "bucket").agg(F.sum(mass).alias("bucket_size"))
    targets = source_targets(size.groupBy("source").agg(F.sum(mass).alias("source_size")), weights, share, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    buckets = buckets.withColumnRenamed("source", "bucket_source").join(targets, F.col("bucket_source").eqNullSafe(F.col("source")))
    buckets = buckets.select(F.col("bucket_source"), F.col("bucket").alias("b"), "bucket_start", "place", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = size.withColumn("within", F.coalesce(F.sum(mass).over(within), F.lit(0)))
    placed = placed.join(buckets, F.col("source").eqNullSafe(F.col("bucket_source")) & (F.col("bucket") == F.col("b")))
    at = F.col("bucket_start") + F.col("within")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("at", at).withColumn("whole", whole)
    extra = (F.col("at") + mass / 2) < (F.col("target") - F.col("whole") * F.col("source_size"))
    placed = placed.withColumn("copies", F.least(F.lit(most), F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int"))
    slope = _cycle(slopes, F.col("place"))
    drawn = lambda k: F.when(F.col("target") > 0, F.least(F.lit(1.0), (k * F.col("source_size") + F.col("at")) / F.col("target"))).otherwise(F.lit(0.0))
    positions = F.filter(F.array(*(F.when(F.col("copies") > k, F.round(curriculum_position(drawn(k), slope), 9)) for k in range(most))), lambda x: x.isNotNull())
    return placed.select("row_key", "doc_id", "source", "n_rows", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), positions.alias("positions"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in training order: a row for every copy, all columns of `docs`, range-sorted by position.

    Equal rows are all drawn alike.  Extra columns stay; the operator's own columns have the prefix `_mix_`.
    """
    plan = mix(docs, **options).filter("copies > 0").select(F.col("row_key").alias("_mix_key"), F.explode("positions").alias("_mix_position"))
    keyed = docs.withColumn("_mix_key", row_key("doc_id", "source", "text"))
    return keyed.join(plan, "_mix_key").repartitionByRange(F.col("_mix_position"), F.col("_mix_key")).sortWithinPartitions("_mix_position", "_mix_key").select(*docs.columns)


def op10_mix_sources(docs: DataFrame) -> DataFrame:
    """Digest of `mix`, a row per document row, range-sorted by the first copy's training position."""
    plan = mix(docs).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    position = F.try_element_at("positions", F.lit(1))
    return plan.select("doc_id", "size", "source_size", "target", "taken", position.alias("position"), F.try_element_at("positions", F.lit(2)).alias("repeat_position")).repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


OP10_SQL = r"""
WITH s AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
q AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
c AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
  CASE (place - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope, 2.0::DOUBLE * source_size AS cap FROM q),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c),
m AS (SELECT rate AS common FROM r WHERE rate <= cap / weight ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT source, source_size, slope, CASE WHEN (SELECT common FROM m) IS NULL THEN cap ELSE least(cap, (SELECT common FROM m) * weight) END AS target FROM r),
p AS (SELECT s.doc_id, s.size, t.*, CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM p),
k AS (SELECT *, CAST(least(2, whole + CASE WHEN begins + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS copies,
  CASE WHEN target > 0 THEN least(1.0::DOUBLE, begins / target) ELSE 0.0::DOUBLE END AS u1,
  CASE WHEN target > 0 THEN least(1.0::DOUBLE, (source_size + begins) / target) ELSE 0.0::DOUBLE END AS u2 FROM w)
SELECT doc_id, size, source_size, target, size * copies AS taken,
  CASE WHEN copies > 0 THEN round(2 * u1 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u1)), 9) END AS position,
  CASE WHEN copies > 1 THEN round(2 * u2 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * u2)), 9) END AS repeat_position
FROM k
"""
