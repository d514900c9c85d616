"""Reads of metric series: as-of lookups, tick grids, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import blocks, detect
from pulsegrid.operators.blocks import Run
from pulsegrid.session import cut


def instant(samples: DataFrame, keys: Sequence[str], at: int, lookback: int, ts: str = "t", value: str = "value"):
    """Latest value of each series in ``]at - lookback, at]`` with its time; partial aggregation before the shuffle."""
    inside = samples.where((F.col(ts) <= F.lit(at)) & (F.col(ts) > F.lit(at - lookback)))
    return inside.groupBy(*keys).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def dedupe_last(samples: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """One row per key: the one that arrived last (a mergeable aggregate, so duplicates never pile up in a task)."""
    rest = [c for c in samples.columns if c not in keys]
    latest = samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(arrival)).alias("__r"))
    return latest.select(*keys, "__r.*")


def tick_grid(samples: DataFrame, keys: Sequence[str], step: int, ts: str = "t") -> DataFrame:
    """Regular ticks covering each series from its first to its last sample (aligned to the step)."""
    span = samples.groupBy(*keys).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    first = F.ceil(F.col("__a") / step).cast("long") * step
    last = F.ceil(F.col("__b") / step).cast("long") * step
    return span.select(*keys, F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias(ts))


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    lookback: int | None = None,
    ts: str = "t",
    width: int = blocks.DEFAULT_WIDTH,
) -> DataFrame:
    """Backward as-of join: each left row gets the latest right row of its series at or before its time.

    Both sides are laid on one time line and the latest right row is carried forward, so the cost is linear and a
    hot series is spread over its blocks. Adds ``values`` and ``age``; they are null beyond the lookback.
    """
    left_cols = [c for c in left.columns if c not in (*keys, ts)]
    lhs = left.select(*keys, ts, F.lit(1).alias("__side"), F.struct(*left_cols).alias("__left") if left_cols else F.lit(1).alias("__left"))
    rhs = right.select(*keys, ts, F.lit(0).alias("__side"), F.struct(F.col(ts).alias("__t"), *values).alias("__right"))
    line = lhs.unionByName(rhs, allowMissingColumns=True)
    return _carried(line, keys, left_cols, values, lookback, ts, width)


def asof_of(
    rows: DataFrame, keys: Sequence[str], left: Column, columns: dict[str, Column], right: Column, values: dict[str, Column],
    lookback: int | None = None, ts: str = "t", probe: int = 3600,
) -> DataFrame:
    """``asof`` where both sides come from the rows of one table, read once; a row may be on both sides."""
    mine = F.struct(*[v.alias(n) for n, v in columns.items()])
    theirs = F.struct(F.col(ts).alias("__t"), *[v.alias(n) for n, v in values.items()])
    sides = [(left, {ts: F.col(ts), "__side": F.lit(1), "__left": mine}), (right, {ts: F.col(ts), "__side": F.lit(0), "__right": theirs})]
    line = detect.time_line(rows, keys, sides)
    width = blocks.width_for(line, keys, ts, probe=probe, widest=24 * probe)
    return _carried(line, keys, list(columns), list(values), lookback, ts, width)


def _carried(line: DataFrame, keys: Sequence[str], left_cols: Sequence[str], values: Sequence[str], lookback: int | None, ts: str, width: int) -> DataFrame:
    carried = blocks.running(line, keys, [ts, "__side"], {"__hit": Run("last", F.col("__right"))}, width)
    age = F.col(ts) - F.col("__hit.__t")
    fresh = F.lit(True) if lookback is None else age < F.lit(lookback)
    out = carried.where("__side = 1").select(
        *keys,
        ts,
        *[F.col(f"__left.{c}").alias(c) for c in left_cols],
        *[F.when(fresh, F.col(f"__hit.{v}")).alias(v) for v in values],
        F.when(fresh, age).alias("age"),
    )
    return out


def counter_increase(
    samples: DataFrame, keys: Sequence[str], reach: int, out: str = "increase", per_second: bool = False,
    ts: str = "t", value: str = "value", width: int = blocks.DEFAULT_WIDTH,
) -> DataFrame:
    """Reset-aware increase over the trailing ``reach`` seconds (both samples of a step inside), or rate per second.

    A drop counts as a restart from zero. No extrapolation to the edges of the window: the rate divides by the time
    between the first and the last sample inside it, and is null with fewer than two samples. A block is at least as
    wide as the reach: a window's rows have to meet in one task whatever the density, and Spark sorts and spills them.
    """
    haloed = blocks.time_halo(samples, ts, reach, max(width, reach))
    series = Window.partitionBy(*keys, blocks.BLOCK).orderBy(ts)
    frame = series.rangeBetween(-(reach - 1), 0)
    before = F.lag(value).over(series)
    delta = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = haloed.withColumn("__d", delta)
    total = F.sum("__d").over(frame) - F.first("__d").over(frame)
    elapsed = F.col(ts) - F.first(ts).over(frame)
    result = F.when(elapsed > 0, total / elapsed if per_second else total)
    return blocks.own_rows(rows.withColumn(out, result)).drop("__d")


def inner_matrix(long: DataFrame, keys: Sequence[str], features: Sequence[str], feature="feature", value="value"):
    """Wide rows for the ticks where every feature has a finite sample; empty as soon as one feature is empty."""
    present = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    wide = present.groupBy(*keys).pivot(feature, list(features)).agg(F.first(value))
    return wide.where(" and ".join(f"`{f}` is not null" for f in features))


def thin(ts: Column, start: Column | int, step: int = 15) -> Column:
    """Every other cycle, counted from the start of the window."""
    base = start if isinstance(start, Column) else F.lit(start)
    return F.pmod(F.floor((ts - base) / step), F.lit(2)) == 0


def training_window(rows: DataFrame, now: int, hours: float, regime_start: Column, ts: str = "t") -> DataFrame:
    return rows.where(F.col(ts) >= F.greatest(F.lit(now - int(hours * 3600)), F.coalesce(regime_start, F.lit(0))))
