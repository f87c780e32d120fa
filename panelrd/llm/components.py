"""Connected components of links by alternating large and small stars, with every step written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelrd.llm.common import written


def _star(links: DataFrame, large: bool, name: str, rows: int) -> DataFrame:
    """Links (u, v), u > v, after one star step: neighbours of each node are linked to the smallest of them instead."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-least", rows)
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return written(out.filter("u != v").distinct(), f"{name}-star", rows)


def components(links: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of `links` (u, v): the smallest node that can be reached.

    `rows` is about how many links there are, where that is known.
    """
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), f"{name}-links", rows)
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = digest(links)
    while before[0]:
        links = _star(_star(links, True, name, 2 * before[0]), False, name, 2 * before[0])
        after = digest(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
