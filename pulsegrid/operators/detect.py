"""Detectors as ordered computations: smoothing, votes, latches, islands, hold times."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import blocks
from pulsegrid.operators.blocks import Run
from pulsegrid.session import cut


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def smooth_and_vote(
    df: DataFrame, keys: Sequence[str], value: str, high, low, lam: float, n: int, index: str = "idx", out: str = "smoothed"
) -> DataFrame:
    """EWMA seeded with the first value, then the counts above ``high`` and below ``low`` in the last n rows.

    The EWMA is a geometric sum. Terms further back than ``reach`` rows weigh less than 1e-18, so chunks of
    positions with a halo of that reach give it to double precision in one shuffle and without a carry.
    """
    if not 0.0 < lam <= 1.0:
        raise ValueError("lambda must lie in ]0, 1]")
    if lam < 1.0:
        decade = -math.log10(1.0 - lam)
        reach = math.ceil(18 / decade)
        rows = max(reach + n, min(4096, int(200 / decade)))
        if (rows + min(rows, reach + n)) * decade > 280:  # a long vote at a short memory: the weights of one chunk would leave the doubles
            return _votes(smooth_and_vote(df, keys, value, math.inf, -math.inf, lam, 1, index, out).drop("__above", "__below"), keys, high, low, n, index, out)
    else:
        reach, rows = 1, max(4096, n)
    haloed = blocks.row_halo(df, index, rows, min(rows, reach + n))
    series = Window.partitionBy(*keys, blocks.BLOCK).orderBy(index)
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    lastn = series.rowsBetween(-(n - 1), 0)
    if lam < 1.0:
        position = (F.col(index) - (F.col(blocks.BLOCK) * rows - min(rows, reach + n))).cast("double")
        weight = F.pow(F.lit(1.0 - lam), position)
        term = F.when(F.col(index) == 0, F.col(value)).otherwise(F.col(value) * lam) / weight
        smoothed = weight * F.sum(term).over(upto)
    else:
        smoothed = F.col(value)
    out_df = (
        haloed.withColumn(out, smoothed)
        .withColumn("__above", F.sum((F.col(out) > _column(high)).cast("int")).over(lastn))
        .withColumn("__below", F.sum((F.col(out) < _column(low)).cast("int")).over(lastn))
    )
    return blocks.own_rows(out_df)


def _votes(smoothed: DataFrame, keys: Sequence[str], high, low, n: int, index: str, out: str) -> DataFrame:
    """The counts above and below in the last n rows, in chunks of their own."""
    haloed = blocks.row_halo(smoothed, index, max(4096, n), n)
    lastn = Window.partitionBy(*keys, blocks.BLOCK).orderBy(index).rowsBetween(-(n - 1), 0)
    return blocks.own_rows(haloed.withColumn("__above", F.sum((F.col(out) > _column(high)).cast("int")).over(lastn)).withColumn("__below", F.sum((F.col(out) < _column(low)).cast("int")).over(lastn)))


def ewma(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lam: float, out: str = "smoothed"):
    indexed = blocks.with_index(df, keys, order, "__idx")
    done = smooth_and_vote(indexed, keys, value, math.inf, -math.inf, lam, 1, "__idx", out)
    return done.drop("__idx", "__above", "__below")


def k_of_n(df: DataFrame, keys: Sequence[str], flag: Column, k: int, n: int, out: str, index: str = "idx") -> DataFrame:
    """True when at least k of the last n rows carry the flag (fewer rows than n are enough for a hit)."""
    if not 1 <= k <= n:
        raise ValueError("1 <= k <= n is required")
    haloed = blocks.row_halo(df.withColumn("__f", F.coalesce(flag, F.lit(False)).cast("int")), index, 4096, n)
    lastn = Window.partitionBy(*keys, blocks.BLOCK).orderBy(index).rowsBetween(-(n - 1), 0)
    return blocks.own_rows(haloed.withColumn(out, F.sum("__f").over(lastn) >= k)).drop("__f")


def hysteresis(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, high, low, k: int, n: int, lam: float,
    prefix: str = "", width: int = blocks.DEFAULT_WIDTH, index: str | None = None,
) -> DataFrame:
    """Smoothed value with open/close latch: adds smoothed, active, opened, closed (with ``prefix``).

    Opens when k of the last n smoothed values exceed ``high``; closes only when n full rows all lie below ``low``.
    The two conditions cannot hold together, so the state is simply the latest of them.
    """
    if not 1 <= k <= n:
        raise ValueError("1 <= k <= n is required")
    if not isinstance(high, Column) and not isinstance(low, Column) and not low < high:
        raise ValueError("the low threshold must be below the high one")
    idx = index or "__idx"
    rows = df if index else blocks.with_index(df, keys, order, idx, width)
    voted = smooth_and_vote(rows, keys, value, high, low, lam, n, idx, f"{prefix}smoothed")
    signal = F.when(F.col("__above") >= k, 1).when(F.col("__below") == n, 0)
    latched = blocks.running(
        voted, keys, order, {"__now": Run("last", signal), "__was": Run("last", signal, inclusive=False)}, width
    )
    now, was = F.coalesce("__now", F.lit(0)) == 1, F.coalesce("__was", F.lit(0)) == 1
    kept = latched.withColumn(f"{prefix}active", now).withColumn(f"{prefix}opened", now & ~was).withColumn(f"{prefix}closed", was & ~now)
    return kept.drop("__above", "__below", "__now", "__was", *([] if index else [idx]))


def suppress_opening(df: DataFrame, keys: Sequence[str], order: Sequence[str], wants: Column, suppressed: Column, width: int = blocks.DEFAULT_WIDTH):
    """Suppression blocks only the opening: active from the first unsuppressed row of a run of wanted rows."""
    rows = df.withColumn("__w", F.coalesce(wants, F.lit(False))).withColumn("__s", F.coalesce(suppressed, F.lit(False)))
    free = (F.col("__w") & ~F.col("__s")).cast("int")
    run = blocks.run_since_reset(rows, keys, order, free, ~F.col("__w"), "__free", width)
    return run.withColumn("active", F.col("__w") & (F.col("__free") > 0)).drop("__w", "__s", "__free")


def run_length(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, out: str = "run", width: int = blocks.DEFAULT_WIDTH):
    """Number of consecutive flagged rows ending at each row."""
    on = F.coalesce(flag, F.lit(False))
    return blocks.run_since_reset(df, keys, order, F.lit(1), ~on, out, width)


def episodes(df: DataFrame, keys: Sequence[str], flag: Column, hole: int, ts: str = "t", width: int = blocks.DEFAULT_WIDTH):
    """Maximal flagged periods.

    An episode ends at the first unflagged row, at the last flagged row before a hole longer than ``hole`` seconds,
    or at the last row of the series.
    """
    haloed = blocks.time_halo(df.withColumn("__on", F.coalesce(flag, F.lit(False))), ts, hole, width, ahead=True)
    series = Window.partitionBy(*keys, blocks.BLOCK).orderBy(ts)
    near_before = F.col(ts) - F.lag(ts).over(series) <= hole
    near_after = F.lead(ts).over(series) - F.col(ts) <= hole
    follows = F.coalesce(near_before & F.lag("__on").over(series), F.lit(False))
    ends = F.when(near_after & ~F.lead("__on").over(series), F.lead(ts).over(series)).otherwise(F.col(ts))
    marked = blocks.own_rows(haloed.withColumn("__start", F.col("__on") & ~follows).withColumn("__end", ends)).where("__on")
    numbered = blocks.running(marked, keys, [ts], {"__no": Run("sum", F.col("__start").cast("int"))}, width)
    return numbered.groupBy(*keys, "__no").agg(F.min(ts).alias("start"), F.max("__end").alias("end"), F.count("*").alias("rows")).drop("__no")


def hold_for(df: DataFrame, keys: Sequence[str], seconds: int, step: int, ts: str = "t", width: int = blocks.DEFAULT_WIDTH):
    """State of a rule whose expression returned these rows: pending, then firing once held for ``seconds``.

    A tick without a row resets the clock. Adds ``active_since`` and ``state``.
    """
    haloed = blocks.time_halo(df, ts, step, width)
    series = Window.partitionBy(*keys, blocks.BLOCK).orderBy(ts)
    starts = F.coalesce(F.col(ts) - F.lag(ts).over(series) > step, F.lit(True))
    marked = blocks.own_rows(haloed.withColumn("__st", F.when(starts, F.col(ts))))
    held = blocks.running(marked, keys, [ts], {"active_since": Run("last", F.col("__st"))}, width).drop("__st")
    return held.withColumn("state", F.when(F.col(ts) - F.col("active_since") >= seconds, "firing").otherwise("pending"))


def warmup_cycle(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "cycle", width: int = blocks.DEFAULT_WIDTH):
    """1-based number of scored rows since the model was installed (the model version is part of the keys)."""
    return blocks.running(df, keys, order, {out: Run("count", F.lit(1))}, width)


def plateau(
    df: DataFrame, keys: Sequence[str], features: Sequence[tuple[str, float]], window_rows: int = V.REGIME_WINDOW, index: str = "idx",
    entering: Sequence[str] = (),
) -> DataFrame:
    """True where the last ``window_rows`` rows are complete and every feature stays within its minimum effect.

    For each boolean column in ``entering``, adds whether it became true at this row (same pass).
    """
    haloed = blocks.row_halo(df, index, max(1024, window_rows), window_rows)
    frame = Window.partitionBy(*keys, blocks.BLOCK).orderBy(index).rowsBetween(-(window_rows - 1), 0)
    stable = F.col(index) >= window_rows - 1
    for name, effect in features:
        if effect > 0:
            low, high = F.percentile(name, F.lit(0.05)).over(frame), F.percentile(name, F.lit(0.95)).over(frame)
            stable = stable & (high - low <= effect)
    before = Window.partitionBy(*keys, blocks.BLOCK).orderBy(index)
    entered = [F.coalesce(F.col(c) & ~F.coalesce(F.lag(c).over(before), F.lit(False)), F.lit(False)).alias(f"{c}_entered") for c in entering]
    return blocks.own_rows(haloed.select("*", stable.alias("plateau"), *entered))


def first_run(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, float, int]], ts: str = "t", width: int = blocks.DEFAULT_WIDTH):
    """Earliest time at which any rule (feature, threshold, rows) has exceeded its threshold for that many rows.

    A run reaches d rows exactly where the last d rows all exceed, so all rules share one pass over a short halo.
    """
    indexed = blocks.with_index(df, keys, [ts], "__idx", width)
    haloed = blocks.row_halo(indexed, "__idx", 4096, max(rows for _, _, rows in rules))
    series = Window.partitionBy(*keys, blocks.BLOCK).orderBy("__idx")
    hit = F.lit(False)
    for feature, threshold, rows in rules:
        above = F.sum((F.col(feature) > threshold).cast("int")).over(series.rowsBetween(-(rows - 1), 0))
        hit = hit | (above == rows)
    return blocks.own_rows(haloed.withColumn("__hit", hit)).where("__hit").groupBy(*keys).agg(F.min(ts).alias("first_run"))


def time_line(rows: DataFrame, keep: Sequence[str], marks: Sequence[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """All sides of a sweep from one scan: a row stands on the line once for every mark whose condition it meets.

    A mark is a condition and the columns it fills; columns that only other marks fill are null. The line is cut,
    because an ordered step reads it twice and its block width is measured on it: the raw table is read once.
    """
    known = {name: value for _, values in marks for name, value in values.items()}
    blank = {name: F.when(F.lit(False), value) for name, value in known.items()}
    placed = [F.when(on, F.struct(*[values.get(n, blank[n]).alias(n) for n in known])) for on, values in marks]
    wanted = functools.reduce(operator.or_, [on for on, _ in marks])
    return cut(rows.where(wanted).select(*keep, F.inline(F.array_compact(F.array(*placed)))))


def first_in_window(
    windows: DataFrame, hits: DataFrame, keys: Sequence[str], start: str, end: str, ts: str = "t", width: int = blocks.DEFAULT_WIDTH
) -> DataFrame:
    """Earliest hit inside each window ``[start, end]`` of the same key, as ``first_hit`` (null when none).

    Time is reversed and the nearest later hit is carried to the window start: one linear pass, no pairs.
    """
    cols = [c for c in windows.columns if c not in keys]
    line = windows.select(*keys, (-F.col(start)).alias("__p"), F.lit(1).alias("__side"), F.struct(*cols).alias("__win")).unionByName(
        hits.select(*keys, (-F.col(ts)).alias("__p"), F.lit(0).alias("__side"), F.col(ts).alias("__hit")), allowMissingColumns=True
    )
    return _first_hits(line, keys, end, width)


def _first_hits(line: DataFrame, keys: Sequence[str], end: str, width: int) -> DataFrame:
    near = blocks.running(line, keys, ["__p", "__side"], {"__next": Run("last", F.col("__hit"))}, width)
    out = near.where("__side = 1").select(*keys, "__win.*", "__next")
    return out.withColumn("first_hit", F.when(F.col("__next") <= F.col(end), F.col("__next"))).drop("__next")


def first_in_window_of(
    rows: DataFrame, keys: Sequence[str], hit: Column, windows: Sequence[tuple[Column, dict[str, Column]]], start: str, end: str, ts: str = "t",
    by: dict[str, Column] | None = None, probe: int = 3600,
) -> DataFrame:
    """``first_in_window`` where hits and windows come from the rows of one table, read once.

    ``windows`` are (condition, columns, among them ``start`` and ``end``); a condition may stand several times. ``by``
    are further key columns of a hit, which every window gives among its own columns.
    """
    by = by or {}
    marks = [(hit, {"__p": -F.col(ts), "__side": F.lit(0), "__hit": F.col(ts), **by})]
    for on, columns in windows:
        own = F.struct(*[v.alias(n) for n, v in columns.items() if n not in by])
        marks.append((on, {"__p": -columns[start], "__side": F.lit(1), "__win": own, **{n: columns[n] for n in by}}))
    line = time_line(rows, keys, marks)
    keys = [*keys, *by]
    return _first_hits(line, keys, end, blocks.width_for(line, keys, "__p", probe=probe, widest=24 * probe))


def covered_by(
    points: DataFrame, windows: DataFrame, keys: Sequence[str], start: str, end: str, ts: str = "t", width: int = blocks.DEFAULT_WIDTH
) -> DataFrame:
    """Whether each point lies in any window of its key: running maximum of the window ends, no pairs."""
    cols = [c for c in points.columns if c not in keys]
    line = points.select(*keys, F.col(ts).alias("__p"), F.lit(1).alias("__side"), F.struct(*cols).alias("__pt")).unionByName(
        windows.select(*keys, F.col(start).alias("__p"), F.lit(0).alias("__side"), F.col(end).alias("__end")), allowMissingColumns=True
    )
    return _covered(line, keys, width)


def covered_by_of(
    rows: DataFrame, keys: Sequence[str], point: Column, columns: dict[str, Column], window: Column, start: Column, end: Column, ts: str = "t", probe: int = 3600
) -> DataFrame:
    """``covered_by`` where points and windows come from the rows of one table, read once; a row may be both."""
    own = F.struct(F.col(ts).alias(ts), *[v.alias(n) for n, v in columns.items()])
    sides = [(window, {"__p": start, "__side": F.lit(0), "__end": end}), (point, {"__p": F.col(ts), "__side": F.lit(1), "__pt": own})]
    line = time_line(rows, keys, sides)
    return _covered(line, keys, blocks.width_for(line, keys, "__p", probe=probe, widest=24 * probe))


def _covered(line: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    swept = blocks.running(line, keys, ["__p", "__side"], {"__max": Run("max", F.col("__end"))}, width)
    return swept.where("__side = 1").select(*keys, "__pt.*", F.coalesce(F.col("__max") >= F.col("__p"), F.lit(False)).alias("covered"))
