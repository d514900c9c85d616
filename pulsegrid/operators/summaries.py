"""Grouped statistics: exact quantiles at any size, robust baselines, histograms, drift, trends, report slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import stats as S
from pulsegrid.session import cut


#: Shares at which a further round of ``exact_quantiles`` cuts a bracket.
_CUTS = 256


def _located(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every value beside each bracket of its group."""
    return rows.join(state.select(*keys, "__qs"), list(keys), "inner").select(*keys, "__v", F.explode("__qs").alias("__q"))


def _narrowed(rows: DataFrame, state: DataFrame, keys: Sequence[str], accuracy: int, slack: float) -> DataFrame:
    """Brackets cut once more: exact counts below and inside, and a sketch of the values inside."""
    value, low, high = F.col("__v"), F.col("__q.lo"), F.col("__q.hi")
    inside = (value >= low) & (value <= high)
    points = F.array(*[F.lit(i / _CUTS) for i in range(_CUTS + 1)])
    found = _located(rows, state, keys).groupBy(*keys, "__q").agg(
        F.count_if(value < low).alias("__below"), F.count_if(inside).alias("__in"), F.percentile_approx(F.when(inside, value), points, F.lit(accuracy)).alias("__cuts")
    )
    first, last = F.floor(F.col("__q.pos")) - F.col("__below"), F.ceil(F.col("__q.pos")) - F.col("__below") + 1
    a = F.floor((first / F.col("__in") - slack) * _CUTS).cast("int")
    b = F.ceil((last / F.col("__in") + slack) * _CUTS).cast("int")
    lo = F.when(a > 0, F.greatest(low, F.get("__cuts", a))).otherwise(low)
    hi = F.when(b < _CUTS, F.least(high, F.get("__cuts", b))).otherwise(high)
    cut_once = F.struct(F.col("__q.i").alias("i"), lo.alias("lo"), hi.alias("hi"), F.col("__q.pos").alias("pos"))
    # a bracket without a value holds no rank itself: its neighbours on either side do, and it stays as it is
    kept = F.when(F.col("__in") > 0, cut_once).otherwise(F.col("__q"))
    return found.groupBy(*keys).agg(F.collect_list(kept).alias("__qs")).join(state.select(*keys, "__n"), list(keys))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 20_000, most: int = 1_000_000
) -> DataFrame:
    """Exact quantiles (linear interpolation) of groups of any size, as columns ``q0, q1, ...`` plus ``n``.

    A mergeable sketch brackets each quantile to about ``8 / accuracy`` of its group; further rounds count and sketch
    inside the brackets until none can hold more than about ``most`` values off its ends. Only the distinct values in the
    last bracket are ranked, so the largest task doesn't grow with the group. A bracket is four times the error bound of
    its sketch, so it holds the wanted ranks (a miss would raise); the same steps serve groups of every size.
    """
    if not keys:
        whole = exact_quantiles(df.withColumn("__all", F.lit(0)), ["__all"], value, probs, accuracy, most)
        return whole.drop("__all")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__v"))
    slack = 4.0 / accuracy
    lows = [max(0.0, q - slack) for q in probs]
    highs = [min(1.0, q + slack) for q in probs]
    points = F.array(*[F.lit(p) for p in [*lows, *highs]])
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", points, F.lit(accuracy)).alias("__b"))
    m = len(probs)
    bounds = [
        F.struct(
            F.lit(i).alias("i"),
            (F.lit(float("-inf")) if lows[i] <= 0 else F.col("__b")[i]).alias("lo"),
            (F.lit(float("inf")) if highs[i] >= 1 else F.col("__b")[m + i]).alias("hi"),
            (F.lit(float(q)) * (F.col("__n") - 1)).alias("pos"),
        )
        for i, q in enumerate(probs)
    ]
    state = cut(sketch.select(*keys, "__n", F.array(*bounds).alias("__qs")))  # one row per group
    widest = (state.agg(F.max("__n").alias("n")).first()["n"] or 0) * 2 * slack
    while widest > most:
        state = cut(_narrowed(rows, state, keys, accuracy, slack))
        widest *= 2 / _CUTS + 2 * slack
    brackets = state.select(*keys, "__n", F.explode("__qs").alias("__q")).select(
        *keys, "__n", F.col("__q.i").alias("__i"), F.col("__q.lo").alias("__lo"), F.col("__q.hi").alias("__hi"), F.col("__q.pos").alias("__pos")
    )
    located = _located(rows, state, keys)
    # rows outside a bracket only count, and give their value next to it: mergeable, so they never leave the map side whole
    under, over = F.col("__v") < F.col("__q.lo"), F.col("__v") > F.col("__q.hi")
    tagged = located.select(
        *keys, F.col("__q.i").alias("__i"), F.when(~under & ~over, F.col("__v")).alias("__v"), (~over).cast("long").alias("__c"),
        F.when(under, F.col("__v")).alias("__under"), F.when(over, F.col("__v")).alias("__over"),
    )
    counted = tagged.groupBy(*keys, "__i", "__v").agg(F.sum("__c").alias("count"), F.max("__under").alias("__under"), F.min("__over").alias("__over"))
    bracket = Window.partitionBy(*keys, "__i")
    ranked = counted.select(
        *keys, "__i", "__v", "count", F.max("__under").over(bracket).alias("__under"), F.max("__over").over(bracket).alias("__over"),
        F.sum("count").over(bracket.orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)).alias("__end"),
    ).where("__v is not null")
    on = [*keys, "__i"]
    hit = ranked.join(brackets, on, "inner")
    start = F.col("__end") - F.col("count")
    k0, k1 = F.floor("__pos"), F.ceil("__pos")
    first, last = F.min(start), F.max("__end")

    def at(k: Column) -> Column:
        """The value of rank ``k``: inside the bracket, or the neighbour on either side."""
        inside = F.max(F.when((start <= k) & (k < F.col("__end")), F.col("__v")))
        return F.coalesce(inside, F.when(F.first(k) == first - 1, F.first("__under")), F.when(F.first(k) == last, F.first("__over")))

    picked = hit.groupBy(*on).agg(F.first("__pos").alias("__pos"), F.first("__n").alias("__n"), at(k0).alias("__a"), at(k1).alias("__z"))
    interpolated = picked.withColumn("__x", F.col("__a") + (F.col("__pos") - F.floor("__pos")) * (F.col("__z") - F.col("__a")))
    missed = F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")
    interpolated = interpolated.withColumn("__x", F.when(F.col("__x").isNull(), missed).otherwise(F.col("__x")))
    wide = [F.max(F.when(F.col("__i") == i, F.col("__x"))).alias(f"q{i}") for i in range(m)]
    return interpolated.groupBy(*keys).agg(F.max("__n").alias("n"), *wide)


def robust_baseline(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Median and floored MAD of groups bounded by the training window (one exchange for both passes)."""
    group = Window.partitionBy(*keys)
    centred = long.withColumn("__m", F.percentile(value, F.lit(0.5)).over(group))
    return (
        centred.groupBy(*keys)
        .agg(F.first("__m").alias("median"), F.percentile(F.abs(F.col(value) - F.col("__m")), F.lit(0.5)).alias("__mad"), F.count("*").alias("n"))
        .withColumn("mad_raw", S.mad_floor(F.col("__mad"), F.col("median")))
        .drop("__mad")
    )


def bin_of(value: Column, inner_edges: Column) -> Column:
    """Index of the half-open bin ``[a, b)``; the outer bins are unbounded."""
    return F.size(F.filter(inner_edges, lambda e: e <= value))


def histogram(df: DataFrame, keys: Sequence[str], value: str, inner_edges: Sequence[float]) -> DataFrame:
    edges = F.array(*[F.lit(float(e)) for e in inner_edges])
    return df.groupBy(*keys, bin_of(F.col(value), edges).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def psi(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "score", bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index of ``actual`` against the quantile bins of ``expected``, per key.

    Duplicate edges collapse; fewer than three edges give 0. Shares are clipped from below, not renormalised.
    """
    quantiles = exact_quantiles(expected, keys, value, [i / bins for i in range(bins + 1)])
    edges = quantiles.select(*keys, F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(bins + 1)])).alias("__e"))
    edges = edges.withColumn("__inner", F.when(F.size("__e") >= 3, F.slice("__e", F.lit(2), F.size("__e") - 2)).otherwise(F.array().cast("array<double>")))
    both = expected.select(*keys, value, F.lit(1).alias("__exp")).unionByName(actual.select(*keys, value, F.lit(0).alias("__exp")))
    counts = (
        both.join(edges.select(*keys, "__inner"), list(keys), "inner")
        .groupBy(*keys, bin_of(F.col(value), F.col("__inner")).alias("__bin"))
        .agg(F.sum("__exp").alias("__e"), F.sum(1 - F.col("__exp")).alias("__a"))
    )
    spine = edges.select(*keys, F.size("__e").alias("__k"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("__e") - 2, F.lit(0)))).alias("__bin"))
    filled = spine.join(counts, [*keys, "__bin"], "left").fillna(0, ["__e", "__a"])
    total = Window.partitionBy(*keys)
    shares = filled.withColumn("__pe", F.greatest(F.col("__e") / F.sum("__e").over(total), F.lit(eps))).withColumn(
        "__pa", F.greatest(F.try_divide(F.col("__a"), F.sum("__a").over(total)), F.lit(eps))
    )
    term = (F.col("__pa") - F.col("__pe")) * F.ln(F.col("__pa") / F.col("__pe"))
    return shares.groupBy(*keys).agg(F.when(F.max("__k") < 3, F.lit(0.0)).otherwise(F.sum(term)).alias("psi"))


def keep_hashed(df: DataFrame, key: Column, seed: int, limit: int) -> DataFrame:
    """At most ``limit`` rows without replacement, chosen by hash so that reruns agree (the sampling operator)."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))).limit(limit)


def slice_report(faults: DataFrame) -> DataFrame:
    """Recall, diagnosis, delays and discordant pairs for the total, the nominal faults and each slice.

    Input: node, fault, intensity, detected, threshold_detected, diagnosed (0/1), delay_s. A row feeds at most five
    slices; delays are whole cycles inside one fault window, so their exact percentiles keep few distinct values.
    """
    nominal = F.col("intensity") == 1.0
    tag = lambda s, k: F.struct(F.lit(s).alias("slice"), k.alias("key"))
    slices = F.array_compact(
        F.array(
            tag("total", F.lit("")),
            F.when(nominal, tag("nominal", F.lit(""))),
            tag("intensity", F.col("intensity").cast("string")),
            F.when(nominal, tag("fault", F.col("fault"))),
            F.when(nominal, tag("node", F.col("node"))),
        )
    )
    hit, seen = F.col("detected") == 1, F.col("threshold_detected") == 1
    delay = F.when(hit, F.col("delay_s"))
    grouped = (
        faults.withColumn("__s", F.explode(slices))
        .groupBy(F.col("__s.slice").alias("slice"), F.col("__s.key").alias("key"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(hit).alias("detected"),
            F.count_if(seen).alias("threshold_detected"),
            F.count_if(hit & (F.col("diagnosed") == 1)).alias("diagnosed"),
            F.percentile(delay, F.lit(0.25)).alias("delay_q1"),
            F.percentile(delay, F.lit(0.5)).alias("delay_median"),
            F.percentile(delay, F.lit(0.75)).alias("delay_q3"),
            F.count_if(hit & ~seen).alias("model_only"),
            F.count_if(seen & ~hit).alias("threshold_only"),
        )
    )
    out = grouped
    for name, k, n in (("recall", "detected", "n"), ("threshold_recall", "threshold_detected", "n"), ("diagnosis", "diagnosed", "detected")):
        share, low, high = S.wilson(F.col(k), F.col(n))
        out = out.withColumn(name, share).withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return out
