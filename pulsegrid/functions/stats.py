"""Scalar statistics used by the detectors, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published constants of the statistics used here.
MAD_CONSTANT = 0.6745
EULER_GAMMA = 0.5772156649015329
WILSON_Z = 1.96


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    return F.lit(MAD_CONSTANT) * (x - median) / mad


def mad_floor(mad: Column, median: Column, relative: float = 0.01, absolute: float = 0.01) -> Column:
    return F.greatest(mad, F.greatest(F.lit(relative) * F.abs(median), F.lit(absolute)))


def significance_floor(mad: Column, min_effect: Column, z_high: Column | float) -> Column:
    """MAD raised so that |z| > z_high implies a deviation above the minimum effect."""
    z = z_high if isinstance(z_high, Column) else F.lit(float(z_high))
    return F.greatest(mad, F.lit(MAD_CONSTANT) * min_effect / z)


def directional(dev: Column, direction: Column) -> Column:
    """Deviation with the harmless side set to zero."""
    zero = F.lit(0.0)
    return F.when(direction == "up", F.greatest(dev, zero)).when(direction == "down", F.least(dev, zero)).otherwise(dev)


def benign_clamp(x: Column, median: Column, direction: Column) -> Column:
    """Value with a harmless deviation snapped to the training median (forest input)."""
    return median + directional(x - median, direction)


def effect_term(dev: Column, min_effect: Column) -> Column:
    """Squared share of a minimum effect; features without one do not count."""
    return F.when(min_effect > 0, F.pow(dev / min_effect, F.lit(2.0))).otherwise(F.lit(0.0))


def combined_effect(terms: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, terms))


def c_n(n: Column) -> Column:
    """Mean length of an unsuccessful search in a binary tree of n points."""
    x = n.cast("double")
    general = F.lit(2.0) * (F.ln(F.when(x > 2, x - 1)) + F.lit(EULER_GAMMA)) - F.lit(2.0) * (x - 1) / F.when(x > 2, x)
    return F.when(n > 2, general).when(n == 2, F.lit(1.0)).otherwise(F.lit(0.0))


def kofn_probability(p: Column, k: int, n: int) -> Column:
    """Chance that at least k of n independent points exceed, each with probability p."""
    terms = [F.lit(float(math.comb(n, i))) * F.pow(p, F.lit(float(i))) * F.pow(F.lit(1.0) - p, F.lit(float(n - i))) for i in range(k, n + 1)]
    return reduce(lambda a, b: a + b, terms)


def hours_to_saturation(
    slope: Column, level: Column, r2: Column, capacity: float = 100.0, min_r2: float = 0.7, horizon: float = 8760.0
) -> tuple[Column, Column]:
    """(hours, reliable) from a fitted trend whose value now is ``level``."""
    growing = slope > F.lit(1e-9)
    hours = F.greatest(F.lit(0.0), F.least((F.lit(capacity) - level) / F.when(growing, slope), F.lit(horizon)))
    return (
        F.when(growing, hours).otherwise(F.lit(horizon)),
        F.when(growing & (r2 >= F.lit(min_r2)), F.lit(True)).otherwise(F.lit(False)),
    )


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column, Column]:
    """(share, low, high) of the Wilson interval; null where n is 0."""
    trials = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / trials
    d = F.lit(1.0) + F.lit(z * z) / trials
    centre = p + F.lit(z * z) / (F.lit(2.0) * trials)
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / trials + F.lit(z * z) / (F.lit(4.0) * trials * trials))
    low = F.when(trials.isNotNull(), F.greatest(F.lit(0.0), (centre - half) / d))
    high = F.when(trials.isNotNull(), F.least(F.lit(1.0), (centre + half) / d))
    return p, low, high


def f1(detected: Column, missed: Column, false_alarms: Column) -> Column:
    """Harmonic mean of precision and recall; 0 when nothing was found."""
    return F.coalesce(
        F.try_divide(F.lit(2.0) * detected, F.lit(2.0) * detected + missed + false_alarms), F.lit(0.0)
    )


def cyclic_hour(epoch: Column) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * F.pmod(epoch.cast("double"), F.lit(86400.0)) / F.lit(86400.0)
    return F.sin(angle), F.cos(angle)


def maintenance_announced(until: Column, now: Column, max_minutes: int = 30) -> Column:
    """An announcement counts while it lasts, unless it is longer than allowed."""
    left = until - now
    return F.coalesce((left > 0) & (left <= F.lit(max_minutes * 60 + 60)), F.lit(False))


def in_backup_slot(epoch: Column) -> Column:
    """The nightly slots 02:20-03:05 and 04:20-04:55 UTC."""
    minute = F.floor(F.pmod(epoch, F.lit(86400)) / 60)
    return minute.between(2 * 60 + 20, 3 * 60 + 5) | minute.between(4 * 60 + 20, 4 * 60 + 55)
