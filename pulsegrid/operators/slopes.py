"""Theil-Sen trends without lists of pairs.

The median of all pairwise slopes is selected, not sorted: a slope ``(y_j - y_i) / (t_j - t_i)`` is at most ``m`` exactly
where the residual ``y - m t`` of the later point isn't above that of the earlier one, so the slopes up to a trial value
are counted as inversions of the residuals, in ``n log n``. A group is cut into blocks of time. Every pair of
blocks is one row and one task: across two blocks a sorted side is searched, inside a block inversions are counted.
The counts of all block pairs add up; several trial values narrow the bracket at once, until it is as narrow as
doubles allow. A group whose pairs fit a task (``direct``) is one block and its median is taken there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pulsegrid.operators import summaries
from pulsegrid.session import cut, ship_package

#: Pairs that one task lists, points of a block, most blocks of a group, trial values of a round, slopes sampled by a task.
DIRECT, BLOCK_POINTS, BLOCKS, TRIALS, SAMPLED = 1 << 20, 1 << 16, 64, 15, 64
#: Width of a bracket, against the slope itself or the group's overall steepness, at which a slope is found.
WIDTH = 1e-13
#: Rows of the table of trial values up to which it is broadcast.
SMALL = 50_000


def inversions(ranks: np.ndarray, least: int = 64) -> int:
    """How many pairs of a sequence of different whole numbers stand in falling order."""
    n = len(ranks)
    size = least
    while size < n:
        size *= 2
    a = np.concatenate([ranks, np.arange(n, size) + (ranks.max() + 1 if n else 0)]).astype(np.int64).reshape(-1, least)
    later = np.triu(np.ones((least, least), dtype=bool), 1)
    found = sum(int(((part[:, :, None] > part[:, None, :]) & later).sum()) for part in np.array_split(a, max(1, len(a) // 256)))
    a = np.sort(a, axis=1)
    span, width = int(a.max()) + 1, least
    while width < size:
        halves = a.reshape(-1, 2, width) + np.arange(size // (2 * width))[:, None, None] * span
        place = np.searchsorted(halves[:, 0].ravel(), halves[:, 1].ravel()) - np.repeat(np.arange(len(halves)) * width, width)
        found += int((width - place).sum())
        a = np.sort(a.reshape(-1, 2 * width), axis=1)
        width *= 2
    return found


def slopes_upto(t: np.ndarray, y: np.ndarray, m: float) -> int:
    """Pairs of different times, in one block sorted by (t, y), whose slope is at most ``m``."""
    r = y - m * t
    ranks = np.empty(len(r), dtype=np.int64)
    ranks[np.lexsort((np.arange(len(r)), -t, r))] = np.arange(len(r))
    return inversions(ranks)


def slopes_across(t: np.ndarray, y: np.ndarray, later_t: np.ndarray, later_y: np.ndarray, m: float) -> int:
    """Pairs of a point and a later block's point whose slope is at most ``m``."""
    r = np.sort(y - m * t)
    return int(len(r) * len(later_t) - np.searchsorted(r, later_y - m * later_t, side="left").sum())


def fit_directly(t: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(slope, intercept, r2) from all pairs of a few points."""
    if len(t) < 2:
        return 0.0, float(y.mean()), 0.0
    i, j = np.triu_indices(len(t), 1)
    apart = t[i] != t[j]
    slopes = (y[j] - y[i])[apart] / (t[j] - t[i])[apart]
    del i, j, apart
    slope = float(np.median(slopes)) if len(slopes) else 0.0
    rest = y - slope * t
    intercept = float(np.median(rest))
    total = float(((y - y.mean()) ** 2).sum())
    return slope, intercept, 1.0 - float(((rest - intercept) ** 2).sum()) / total if len(slopes) and total > 0 else 0.0


def _small_groups(points: DataFrame, keys: list[str]) -> DataFrame:
    names = [*keys, "slope", "intercept", "r2", "last_t", "n"]
    kinds = [StructField(c, DoubleType()) for c in names[len(keys) : -1]]
    schema = StructType([*(points.schema[c] for c in keys), *kinds, StructField("n", LongType())])

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__t", "__y"])
        t, y = group["__t"].to_numpy(), group["__y"].to_numpy()
        return pd.DataFrame([(*key, *fit_directly(t, y), float(t[-1]), len(t))], columns=names)

    return points.groupBy(*keys).applyInPandas(fit, schema)


def block_pairs(points: DataFrame, block_points: int, blocks: int = BLOCKS) -> DataFrame:
    """(gid, sides): every pair of time blocks of a group, and every block with itself; ``points``: gid, __t, __y, n.

    Block limits are approximate quantiles of the times; equal times share a block. A block of a group of ``n`` points
    holds about ``block_points`` of them, or ``n / blocks`` beyond that many blocks.
    """
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    limits = points.groupBy("gid").agg(F.percentile_approx("__t", shares, F.lit(20_000)).alias("all"), F.first("n").alias("n"))
    count = F.least(F.lit(blocks), F.ceil(F.col("n") / block_points))
    # of the finest limits those that make ``count`` blocks
    wanted = F.filter(F.transform("all", lambda e, i: F.when(F.floor((i + 1) * count / blocks) > F.floor(i * count / blocks), e)), lambda e: e.isNotNull())
    limits = limits.select("gid", F.array_distinct(wanted).alias("limits"))
    placed = points.join(limits, "gid").withColumn("block", F.size(F.filter("limits", lambda e: e <= F.col("__t"))))
    packed = placed.groupBy("gid", "block").agg(F.first(F.size("limits")).alias("last"), F.sort_array(F.collect_list(F.struct("__t", "__y"))).alias("points"))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    # a fixed number of partitions: small rows mean much counting, so their size must not merge them into few tasks
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).repartition(parts, "gid", "a", "b")
    rows = met.groupBy("gid", "a", "b").agg(F.sort_array(F.collect_list(F.struct("block", "points"))).alias("sides"))
    return rows.where((F.col("a") == F.col("b")) | (F.size("sides") == 2)).select("gid", "sides")


def _sides(cell: pa.Scalar) -> list[tuple[np.ndarray, np.ndarray]]:
    return [tuple(s["points"].values.field(i).to_numpy() for i in (0, 1)) for s in cell.values]


def sampled(pairs: DataFrame, size: int = SAMPLED) -> DataFrame:
    """(gid, slope): a few slopes from every pair of blocks, the same ones in every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, cell in zip(batch.column("gid").to_pylist(), batch.column("sides")):
                (t, y), *more = _sides(cell)
                u, v = more[0] if more else (t, y)
                rng = np.random.default_rng([len(t), len(u), size])
                i, j = rng.integers(0, len(t), size), rng.integers(0, len(u), size)
                apart = t[i] != u[j]
                slopes = (v[j] - y[i])[apart] / (u[j] - t[i])[apart]
                yield pa.RecordBatch.from_arrays([pa.array([gid] * len(slopes), pa.int64()), pa.array(slopes)], names=["gid", "slope"])

    return pairs.mapInArrow(run, "gid long, slope double")


def counted(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(gid, which, counts): for each array of trial values how many of the group's slopes lie at or under each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, cell, asks in zip(batch.column("gid").to_pylist(), batch.column("sides"), batch.column("asks").to_pylist()):
                (t, y), *more = _sides(cell)
                known = {m: slopes_across(t, y, *more[0], m) if more else slopes_upto(t, y, m) for m in {m for a in asks for m in a["trials"]}}
                out = [(gid, a["which"], i, known[m]) for a in asks for i, m in enumerate(a["trials"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["gid", "which", "i", "n"])

    asks = asked.groupBy("gid").agg(F.collect_list(F.struct("which", "trials")).alias("asks"))  # two at most
    counts = pairs.join(asks, "gid").mapInArrow(run, "gid long, which long, i long, n long").groupBy("gid", "which", "i").agg(F.sum("n").alias("n"))
    return counts.groupBy("gid", "which").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("counts"))


def _trials(guess: bool) -> Column:
    """Values that cut a bracket evenly, or close around where its counts say that the rank lies, or step out of an open one."""
    steps = F.sequence(F.lit(1), F.lit(TRIALS))
    lo, hi, out = F.col("lo"), F.col("hi"), F.col("scale") * F.pow(F.lit(4.0), F.lit(-8.0))
    evenly = F.transform(steps, lambda k: lo + (hi - lo) * k / (TRIALS + 1))
    at = (F.col("rank") + 0.5 - F.col("n_lo")) / (F.col("n_hi") - F.col("n_lo"))
    around = F.array(*[F.least(F.greatest(at + d, F.lit(0.0)), F.lit(1.0)) * (hi - lo) + lo for e in (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 0.05, 0.2) for d in (-e, e)])
    above = F.transform(steps, lambda k: F.coalesce(lo, F.lit(0.0)) + out * F.pow(F.lit(4.0), k.cast("double")))
    below = F.transform(steps, lambda k: hi - out * F.pow(F.lit(4.0), k.cast("double")))
    return F.when(lo.isNotNull() & hi.isNotNull(), around if guess else evenly).when(hi.isNull(), above).otherwise(below)


def median_slopes(pairs: DataFrame, groups: DataFrame, rounds: int = 100) -> DataFrame:
    """(gid, slope) of groups (gid, slopes, scale): ``slopes`` pairs of different times, ``scale`` an overall steepness."""
    ranks = F.array(*[F.struct(F.lit(w).cast("long").alias("which"), r.cast("long").alias("rank")) for w, r in enumerate((F.floor((F.col("slopes") - 1) / 2), F.floor(F.col("slopes") / 2)))])
    points = [0.5 + s * d for d in (0.48, 0.4, 0.25, 0.15, 0.08, 0.04, 0.015) for s in (-1, 1)] + [0.5]
    first = sampled(pairs).groupBy("gid").agg(F.percentile("slope", F.array(*[F.lit(p) for p in sorted(points)])).alias("trials"))
    none = F.lit(None).cast("double")
    state = groups.select("gid", "scale", F.lit(0).cast("long").alias("n_lo"), F.col("slopes").alias("n_hi"), F.explode(ranks).alias("r"))
    state = state.select("gid", "scale", "r.*", none.alias("lo"), none.alias("hi"), "n_lo", "n_hi")
    state = cut(state.join(first, "gid", "left").withColumn("trials", F.coalesce("trials", _trials(False))))
    # nulls first: without both ends a bracket is open
    wide = F.col("hi").isNull() | F.col("lo").isNull() | (F.col("hi") - F.col("lo") > WIDTH * F.greatest(F.abs("lo"), F.abs("hi"), "scale"))
    for turn in range(rounds):
        open_ = state.where(wide)
        rows = open_.count()
        if not rows:
            means = state.groupBy("gid").agg(F.avg("hi").alias("slope"))
            return means
        asked = open_.select("gid", "which", "trials")
        got = counted(pairs, F.broadcast(asked) if rows <= SMALL else asked)
        met = state.join(got, ["gid", "which"], "left")
        both = F.arrays_zip(F.col("trials").alias("v"), F.col("counts").alias("n"))
        under, over = F.filter(both, lambda x: x["n"] <= F.col("rank")), F.filter(both, lambda x: x["n"] > F.col("rank"))
        ends = met.withColumns({"under": F.array_max(under), "over": F.array_min(over)})
        lower, upper = F.col("lo").isNull() | (F.col("under.v") > F.col("lo")), F.col("hi").isNull() | (F.col("over.v") < F.col("hi"))
        pick = lambda new, name, when, old: F.when(F.col(new).isNotNull() & when, F.col(f"{new}.{name}")).otherwise(F.col(old)).alias(old)
        state = ends.select("gid", "scale", "which", "rank", pick("under", "v", lower, "lo"), pick("over", "v", upper, "hi"), pick("under", "n", lower, "n_lo"), pick("over", "n", upper, "n_hi"))
        state = cut(state.withColumn("trials", _trials(guess=turn % 2 == 0)))
    raise ValueError("a median slope was not found")


def theil_sen(points: DataFrame, keys: Sequence[str], t: str = "t", y: str = "y", direct: int = DIRECT, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Median-of-pairs slope, intercept and R2 per group: columns slope, intercept, r2, last_t, n.

    Pairs of equal times have no slope; a group without any slope is flat. Points without a time or a value don't count.
    """
    ship_package()
    keys = list(keys)
    rows = points.select(*keys, F.col(t).cast("double").alias("__t"), F.col(y).cast("double").alias("__y"))
    rows = cut(rows.where(F.col("__t").isNotNull() & F.col("__y").isNotNull() & ~F.isnan("__t") & ~F.isnan("__y")))
    sizes = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("__t").alias("last_t"), ((F.max("__y") - F.min("__y")) / F.nullif(F.max("__t") - F.min("__t"), F.lit(0.0))).alias("scale"), F.avg("__y").alias("mean")
    )
    fits = F.col("n") * (F.col("n") - 1) / 2 <= direct
    large = cut(sizes.where(~fits).withColumn("gid", F.monotonically_increasing_id()))
    if large.isEmpty():
        return _small_groups(rows, keys)
    few = _small_groups(rows.join(sizes.where(fits).select(*keys), keys, "left_semi"), keys)

    many = cut(rows.join(large, keys).select("gid", "__t", "__y", "n", "mean"))
    ties = many.groupBy("gid", "__t").agg(F.count("*").alias("c")).groupBy("gid").agg(F.sum(F.expr("c * (c - 1) div 2")).alias("same"))
    groups = large.join(ties, "gid").select("gid", "scale", (F.expr("n * (n - 1) div 2") - F.col("same")).alias("slopes"))
    groups = cut(groups)
    # a level series has no steepness of its own: brackets then end at an absolute width
    sloped = groups.where("slopes > 0").withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    found = median_slopes(cut(block_pairs(many.join(sloped.select("gid"), "gid", "left_semi"), block_points)), sloped)
    flat = groups.where("slopes = 0").select("gid", F.lit(0.0).alias("slope"))
    rest = cut(many.join(cut(found.unionByName(flat)), "gid").withColumn("__r", F.col("__y") - F.col("slope") * F.col("__t")))
    level = summaries.exact_quantiles(rest, ["gid"], "__r", [0.5]).select("gid", F.col("q0").alias("intercept"))
    sums = rest.join(level, "gid").groupBy("gid").agg(
        F.sum(F.pow(F.col("__r") - F.col("intercept"), F.lit(2.0))).alias("res"), F.sum(F.pow(F.col("__y") - F.col("mean"), F.lit(2.0))).alias("tot"), F.first("intercept").alias("intercept"), F.first("slope").alias("slope")
    )
    r2 = F.when((F.col("tot") > 0) & F.col("scale").isNotNull(), 1.0 - F.col("res") / F.nullif("tot", F.lit(0.0))).otherwise(0.0)
    return few.unionByName(large.join(sums, "gid").select(*keys, "slope", "intercept", r2.alias("r2"), "last_t", "n"))
