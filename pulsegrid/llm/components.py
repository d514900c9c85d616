"""Connected components of a large graph of document ids, by alternating large and small stars.

Each round replaces every node's links by links to its smallest neighbour; the rounds end when nothing changes, after
about log(n) of them. Links, components and nodes stay in DataFrames. The node that thousands link to is a hot join
key: the smallest neighbours are written out first, so that both sides of the join are plain exchanges, whose large
partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (u, v) with u > v; one round of stars over them."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m")), "least")
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return stored(out.where(F.col("u") != F.col("v")).distinct(), "links")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node with a link (columns a, b): the smallest id reachable from it."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = stored(pairs, "links")
    before = _state(now)
    while before[0]:
        now = _star(_star(now, True), False)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
