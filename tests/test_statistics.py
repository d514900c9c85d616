"""Formula goldens and exact distributed statistics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import stats as S
from pulsegrid.operators import slopes, summaries


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_constants(spark):
    r = one(spark, S.c_n(F.lit(256)), S.c_n(F.lit(2)), S.c_n(F.lit(1)), S.kofn_probability(F.lit(0.1), 3, 4), S.mad_floor(F.lit(0.0), F.lit(50.0)))
    assert r[0] == pytest.approx(10.2448, abs=1e-3) and (r[1], r[2]) == (1.0, 0.0)
    assert r[3] == pytest.approx(4 * 0.1**3 * 0.9 + 0.1**4)
    assert r[4] == pytest.approx(0.5)


def test_floor_equals_minimum_effect(spark):
    mad = S.significance_floor(F.lit(0.1), F.lit(5.0), 3.5)
    above, below = one(spark, S.robust_z(F.lit(13.01), F.lit(8.0), mad), S.robust_z(F.lit(12.9), F.lit(8.0), mad))
    assert above > 3.5 > below


def test_midnight_is_continuous(spark):
    a, b = S.cyclic_hour(F.lit(86399)), S.cyclic_hour(F.lit(86400))
    r = one(spark, a[0], a[1], b[0], b[1])
    assert abs(r[0] - r[2]) < 1e-3 and abs(r[1] - r[3]) < 1e-3


def test_wilson_bounds(spark):
    cols = [c for k, n in ((424, 486), (0, 10), (10, 10), (0, 0)) for c in S.wilson(F.lit(k), F.lit(n))]
    r = one(spark, *cols)
    assert [round(x, 3) for x in r[:3]] == [0.872, 0.840, 0.899]
    assert r[4] == 0.0 and r[8] == 1.0 and r[9] is None


def test_maintenance_has_a_cap(spark):
    r = one(spark, S.maintenance_announced(F.lit(1900), F.lit(100)), S.maintenance_announced(F.lit(2000), F.lit(100)), S.maintenance_announced(F.lit(90), F.lit(100)))
    assert tuple(r) == (True, False, False)


def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    hot = np.concatenate([rng.exponential(50, 60_000), np.full(30_000, 3.0)])
    cold = rng.normal(0, 1, 11)
    pdf = pd.DataFrame({"k": ["hot"] * len(hot) + ["cold"] * 11, "v": np.concatenate([hot, cold])})
    qs = [0.0, 0.05, 0.3, 0.5, 0.95, 0.995, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(len(qs))] for r in summaries.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", qs).collect()}
    assert got["hot"] == pytest.approx(list(np.quantile(hot, qs)), abs=1e-12)
    assert got["cold"] == pytest.approx(list(np.quantile(cold, qs)), abs=1e-12)


def test_quantiles_in_rounds(spark):
    """A coarse sketch and a small bound need several rounds; ties, gaps and single rows in the same run."""
    rng = np.random.default_rng(2)
    groups = {"hot": np.concatenate([rng.exponential(50, 60_000), np.full(20_000, 3.0)]), "two": np.repeat([1.0, 9.0], 4000), "one": np.array([7.0]),
              "gap": np.concatenate([rng.normal(-1e6, 1, 3000), rng.normal(1e6, 1, 3000)])}
    pdf = pd.DataFrame([(k, v) for k, vs in groups.items() for v in vs], columns=["k", "v"])
    qs = [0.0, 0.02, 0.5, 0.9, 0.999, 1.0]
    got = {r.k: r for r in summaries.exact_quantiles(spark.createDataFrame(pdf).repartition(6), ["k"], "v", qs, accuracy=100, most=200).collect()}
    for k, vs in groups.items():
        assert [got[k][f"q{i}"] for i in range(len(qs))] == pytest.approx(list(np.quantile(vs, qs)), abs=1e-9) and got[k].n == len(vs)


def test_psi_levels(spark):
    rng = np.random.default_rng(1)
    frame = lambda x: spark.createDataFrame(pd.DataFrame({"target": "a", "score": x}))
    base, same, moved = rng.normal(0, 1, 5000), rng.normal(0, 1, 1000), rng.normal(1.5, 1, 1000)
    assert summaries.psi(frame(base), frame(same), ["target"]).first().psi < 0.1
    assert summaries.psi(frame(base), frame(moved), ["target"]).first().psi > 0.25
    assert summaries.psi(frame(np.ones(50)), frame(moved), ["target"]).first().psi == 0.0


def test_theil_sen_resists_outliers(spark):
    t = np.arange(50.0)
    y = 2 * t + 1
    y[[3, 17, 29, 44]] = 1000.0
    pts = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, y)] + [("one", 0.0, 5.0)] + [("flat", 1.0, 1.0), ("flat", 1.0, 3.0)], "k string, t double, y double")
    got = {r.k: r for r in slopes.theil_sen(pts, ["k"]).collect()}
    assert got["a"].slope == pytest.approx(2.0) and got["a"].intercept == pytest.approx(1.0)
    assert (got["one"].slope, got["one"].intercept, got["one"].r2) == (0.0, 5.0, 0.0)
    assert (got["flat"].slope, got["flat"].intercept, got["flat"].r2) == (0.0, 2.0, 0.0)


def test_saturation_in_nineteen_hours(spark):
    pts = spark.createDataFrame([("a", i * 60, 50 + 2 * i / 60) for i in range(361)], "k string, t long, value double")
    from pulsegrid.operators import lifecycle

    r = lifecycle.forecast(pts, ["k"], 361 * 60).first()
    assert r.hours == pytest.approx(19.0, abs=0.05) and r.reliable and r.n == 360


@pytest.mark.parametrize(("lam", "n"), [(0.99, 100), (0.4, 700), (0.999999, 3), (1.0, 5000), (0.05, 4)])
def test_smoothing_and_votes_at_any_setting(spark, lam, n):
    from pulsegrid.operators import detect

    values = [float((i * 37) % 11) for i in range(1500)]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, idx long, v double")
    got = detect.smooth_and_vote(rows, ["k"], "v", 5.0, 4.0, lam, n).orderBy("idx").collect()
    smoothed, above = None, []
    for r, v in zip(got, values):
        smoothed = v if smoothed is None else lam * v + (1 - lam) * smoothed
        above.append(smoothed > 5.0)
        assert abs(r.smoothed - smoothed) < 1e-9 and r["__above"] == sum(above[-n:])
