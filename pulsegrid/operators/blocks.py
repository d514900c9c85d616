"""Ordered computations per series that never put a whole series into one task.

A series is cut into blocks. Work inside a block is an ordinary window partitioned by (keys, block); what earlier
blocks contribute is a one-row summary per block, prefixed over the (few) blocks of the series and joined back.
Frames with a bounded reach need no summary: the rows within reach of the next block are copied into it (halo).
The row shuffle is by (keys, block), so a series holding a third of all rows is spread over all its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
OWN = "__own"
DEFAULT_WIDTH = 6 * 3600


class Run(NamedTuple):
    """One running aggregate: kind is sum, count, max, min, first or last (the last two skip nulls)."""

    kind: str
    value: Column
    inclusive: bool = True


_LOCAL = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def time_block(ts: str, width: int) -> Column:
    """Fixed time block. A series has one sample per instant, so a block holds at most ``width / step`` rows."""
    return F.floor(F.col(ts) / F.lit(width)).cast("long")


def width_for(
    df: DataFrame, keys: Sequence[str], ts: str, max_rows: int = 1_000_000, probe: int = 3600, widest: int = DEFAULT_WIDTH
) -> int:
    """Block width keeping the densest series block near ``max_rows``; one small aggregate job.

    Counts rows per (keys, probe slice) with map-side combine and narrows the width when a slice is too dense, so a
    series holding a third of all rows gets as many blocks as it needs while sparse ones keep wide blocks.
    """
    slices = df.groupBy(*keys, time_block(ts, probe).alias(BLOCK)).count()
    densest = slices.agg(F.max("count").alias("m")).first()["m"] or 1
    return max(1, min(widest, int(probe * max_rows / densest)))


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, Run], width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Running aggregates from the start of each series up to each row, in ``order`` (first column is the time)."""
    blocked = df.withColumn(BLOCK, time_block(order[0], width))
    part = [*keys, BLOCK]
    position = F.struct(*[F.col(c) for c in order])
    summary_aggs, carry_cols = [], []
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    for i, spec in enumerate(specs.values()):
        name = f"__c{i}"
        if spec.kind in ("first", "last"):
            pick = F.max_by if spec.kind == "last" else F.min_by
            summary_aggs.append(pick(spec.value, F.when(spec.value.isNotNull(), position)).alias(name))
        else:
            summary_aggs.append(_LOCAL[spec.kind](spec.value).alias(name))
        prefix = F.sum if spec.kind == "count" else _LOCAL[spec.kind]
        carry_cols.append(prefix(F.col(name)).over(before).alias(name))
    carry = blocked.groupBy(*part).agg(*summary_aggs).select(*part, *carry_cols)

    local = blocked
    window = Window.partitionBy(*part).orderBy(*order)
    for i, spec in enumerate(specs.values()):
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        local = local.withColumn(f"__l{i}", _LOCAL[spec.kind](spec.value).over(frame))
    joined = local.join(carry, part, "left")
    outs = []
    for i, (out, spec) in enumerate(specs.items()):
        here, past = F.col(f"__l{i}"), F.col(f"__c{i}")
        if spec.kind in ("sum", "count"):
            value = F.coalesce(past, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif spec.kind == "max":
            value = F.greatest(past, here)
        elif spec.kind == "min":
            value = F.least(past, here)
        elif spec.kind == "first":
            value = F.coalesce(past, here)
        else:
            value = F.coalesce(here, past)
        outs.append(value.alias(out))
    return joined.select(*[c for c in df.columns if c not in specs], *outs)


def run_since_reset(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    reset: Column,
    out: str,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Sum of ``value`` over the rows after the latest ``reset`` row (a reset row itself yields 0)."""
    part = [*keys, BLOCK]
    window = Window.partitionBy(*part).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        df.withColumn(BLOCK, time_block(order[0], width))
        .withColumn("__r", F.coalesce(reset, F.lit(False)).cast("int"))
        .withColumn("__v", F.when(F.col("__r") == 1, F.lit(0)).otherwise(value))
        .withColumn("__g", F.sum("__r").over(upto))
    )
    rows = rows.withColumn(
        "__s", F.sum("__v").over(Window.partitionBy(*part, "__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    )
    position = F.struct(*[F.col(c) for c in order])
    tails = rows.groupBy(*part).agg(F.max("__g").alias("__resets"), F.max_by("__s", position).alias("__tail"))
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    # blocks up to and including the latest one with a reset form a group; the carry is the sum of their tails
    tails = tails.withColumn(
        "__grp", F.sum((F.col("__resets") > 0).cast("int")).over(by_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    tails = tails.withColumn(
        "__open",
        F.sum("__tail").over(
            Window.partitionBy(*keys, "__grp").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    carry = tails.select(*part, F.lag("__open").over(by_block).alias("__in"))
    joined = rows.join(carry, part, "left")
    total = F.col("__s") + F.when(F.col("__g") == 0, F.coalesce(F.col("__in"), F.lit(0))).otherwise(F.lit(0))
    return joined.select(*[c for c in df.columns if c != out], total.alias(out))


def with_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "idx", width: int = DEFAULT_WIDTH, total: str | None = None):
    """0-based position of each row in its series; with ``total`` also the series' number of rows.

    One summary row per block gives both the place of its first row and the total; it meets the rows by (keys, block).
    """
    part = [*keys, BLOCK]
    blocked = df.withColumn(BLOCK, time_block(order[0], width))
    series = Window.partitionBy(*keys)
    before = F.sum("__n").over(series.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    sizes = blocked.groupBy(*part).agg(F.count("*").alias("__n")).select(*part, F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(series).alias("__total"))
    local = blocked.withColumn("__local", F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1)
    made = {out: (F.col("__before") + F.col("__local")).cast("long"), **({total: F.col("__total")} if total else {})}
    return local.join(sizes, part).select(*[c for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def row_halo(df: DataFrame, index: str, rows: int, halo: int) -> DataFrame:
    """Chunks of ``rows`` consecutive positions; the last ``halo`` rows of a chunk are also copied to the next."""
    if halo > rows:
        raise ValueError("halo must not exceed the chunk length")
    chunk = F.floor(F.col(index) / F.lit(rows)).cast("long")
    near_end = F.col(index) % F.lit(rows) >= F.lit(rows - halo)
    return (
        df.withColumn("__home", chunk)
        .withColumn(BLOCK, F.explode(F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
        .withColumn(OWN, F.col(BLOCK) == F.col("__home"))
        .drop("__home")
    )


def time_halo(df: DataFrame, ts: str, reach: int, width: int = DEFAULT_WIDTH, ahead: bool = False) -> DataFrame:
    """Time blocks; rows within ``reach`` of the next block are also copied there (and backwards if ``ahead``)."""
    width = max(width, reach)
    block = time_block(ts, width)
    offset = F.col(ts) - block * F.lit(width)
    copies = [F.when(offset >= F.lit(width - reach), block + 1)]
    if ahead:
        copies.append(F.when(offset <= F.lit(reach), block - 1))
    return (
        df.withColumn("__home", block)
        .withColumn(BLOCK, F.explode(F.array_compact(F.array(block, *copies))))
        .withColumn(OWN, F.col(BLOCK) == F.col("__home"))
        .drop("__home")
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies once the frames have been computed."""
    return df.where(F.col(OWN)).drop(BLOCK, OWN)
