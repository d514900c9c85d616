"""Median slopes: counted, bracketed and selected against all pairs."""

import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import slopes

RNG = np.random.default_rng(11)


def plain(t, y):
    """Slope, intercept and r2 by listing the pairs."""
    i, j = np.triu_indices(len(t), 1)
    keep = t[i] != t[j]
    all_ = (y[j] - y[i])[keep] / (t[j] - t[i])[keep]
    slope = float(np.median(all_)) if len(all_) else 0.0
    level = float(np.median(y - slope * t))
    tot = ((y - y.mean()) ** 2).sum()
    return slope, level, 1 - ((y - level - slope * t) ** 2).sum() / tot if tot > 0 and len(all_) else 0.0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 500, 1000])
def test_inversions(n):
    a = RNG.permutation(n)
    assert slopes.inversions(a) == sum(int((a[:i] > a[i]).sum()) for i in range(n))


def test_slopes_up_to_a_value_with_ties():
    t = np.sort(RNG.integers(0, 40, 120)).astype(float)
    y = RNG.integers(0, 4, 120).astype(float)
    order = np.lexsort((y, t))
    t, y = t[order], y[order]
    i, j = np.triu_indices(120, 1)
    keep = t[i] != t[j]
    all_ = (y[j] - y[i])[keep] / (t[j] - t[i])[keep]
    for m in (-1.0, -0.5, 0.0, 0.25, 2.0):
        assert slopes.slopes_upto(t, y, m) == (all_ <= m).sum()
    a, b = t < 17, t >= 17
    crossing = (t[i] < 17) & (t[j] >= 17)
    every = (y[j] - y[i])[crossing] / (t[j] - t[i])[crossing]
    assert slopes.slopes_across(t[a], y[a], t[b], y[b], 0.125) == (every <= 0.125).sum()


def series():
    t = np.arange(361) / 60.0
    return {
        "noisy": (t, 3 * t + RNG.normal(0, 2, 361)),
        "outliers": (t, np.where(RNG.random(361) < 0.2, 900.0, -0.5 * t)),
        "steps": (t, np.floor(t)),
        "constant": (t, np.full(361, 7.0)),
        "counts": (t, RNG.integers(0, 3, 361).astype(float)),
        "doubled": (np.repeat(t[:180], 2), RNG.normal(0, 1, 360)),
        "falling": (t * 1e6, -1e-3 * t + 1e-6 * RNG.normal(0, 1, 361)),
        "instant": (np.full(50, 4.0), RNG.normal(0, 1, 50)),
        "two": (t[:2], np.array([1.0, 5.0])),
    }


@pytest.mark.parametrize(("direct", "block"), [(slopes.DIRECT, slopes.BLOCK_POINTS), (0, 50), (20_000, 400)])
def test_every_route_equals_the_pairs(spark, direct, block):
    made = series()
    table = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "t": t, "y": y}) for k, (t, y) in made.items()])).repartition(5)
    odd = spark.createDataFrame([("noisy", None, 4.0), ("noisy", 2.0, None), ("noisy", float("nan"), 1.0)], table.schema)
    got = {r.k: r for r in slopes.theil_sen(table.unionByName(odd), ["k"], direct=direct, block_points=block).collect()}
    assert set(got) == set(made)
    for k, (t, y) in made.items():
        want = plain(t, y)
        assert (got[k].slope, got[k].intercept, got[k].r2) == pytest.approx(want, rel=1e-9, abs=1e-11), k
        assert (got[k].last_t, got[k].n) == (t.max(), len(t))


def test_a_long_series_is_many_tasks(spark):
    n = 150_000
    t = np.arange(n, dtype=float)
    y = 0.25 * t + RNG.normal(0, 50, n)
    y[RNG.random(n) < 0.1] += 1e6
    table = spark.createDataFrame(pd.DataFrame({"k": "hot", "t": t, "y": y})).unionByName(spark.createDataFrame([("cold", float(i), 2.0 * i) for i in range(30)], "k string, t double, y double"))
    sized = table.where("k = 'hot'").selectExpr("0L gid", "t __t", "y __y", f"{n}L n")
    sides = slopes.block_pairs(sized, 1 << 14).selectExpr("transform(sides, s -> size(s.points)) sizes").collect()
    assert len(sides) == 55 and max(max(r["sizes"]) for r in sides) < 20_000
    got = {r.k: r for r in slopes.theil_sen(table, ["k"], block_points=1 << 14).collect()}
    assert got["cold"].slope == 2.0 and got["hot"].n == n
    # the slope's place among all pairs, counted over the whole series in one piece
    pairs = n * (n - 1) // 2
    below, upto = (slopes.slopes_upto(t, y, got["hot"].slope + d) for d in (-1e-9, 1e-9))
    assert below <= pairs // 2 <= upto
