"""Replay folds, fault slots and calibration."""

import numpy as np
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import evaluate


def test_rolling_folds_match_the_definition(spark):
    step, n = 3600, 24 * 8
    start = 1_704_067_200
    rows = spark.createDataFrame([("a", start + i * step, [float(i)]) for i in range(n)], "target string, t long, x array<double>")
    got = {(r.day, r.role, r.t) for r in evaluate.rolling_folds(rows, step, 3, 1).collect()}
    expected = set()
    first = start // 86400
    for day in range(first + 3, first + 8):
        a = (day - 3) * 86400
        for i in range(n):
            t = start + i * step
            if a <= t < day * 86400 and ((t - a) // step) % 2 == 0:
                expected.add((day, "train", t))
            if t // 86400 == day:
                expected.add((day, "test", t))
    assert got == expected


def test_slots_cycle_faults_and_intensities(spark):
    days = spark.createDataFrame([("a", 5760), ("short", 100)], "node string, n int")
    catalogue = [("cpu", "cpu_host", 40.0), ("gone", "app_containers", -1.0)]
    got = evaluate.slots(days, catalogue, ["node"]).orderBy("slot").collect()
    starts = list(range(120, 5760 - 48, 200))
    assert [r.start for r in got] == starts and {r.node for r in got} == {"a"}
    for i, r in enumerate(got):
        assert r.feature == catalogue[i % 2][1]
        assert r.intensity == (1.0 if r.feature == "app_containers" else (0.25, 0.5, 1.0)[(i // 2) % 3])


def test_calibration_prefers_a_calm_feasible_setting(spark):
    rng = np.random.default_rng(0)
    z = np.abs(rng.normal(1.2, 0.8, 960))
    z[300:340] += 3.2
    z[600:604] += 4.0
    series = spark.createDataFrame([("a", 1_800_000_000 + i * 15, float(v)) for i, v in enumerate(z)], "target string, t long, z_max double")
    got = {(r.lam, r.k, r.n, r.z_high): r.opens for r in evaluate.replay_grid(series, ["target"]).collect()}
    assert len(got) == 36

    def opens(lam, k, n, high):
        s, active, above, below, count = None, False, [], [], 0
        for v in z:
            s = v if s is None else lam * v + (1 - lam) * s
            above, below = [*above, s > high][-n:], [*below, s < high - 1][-n:]
            if not active and sum(above) >= k:
                active, count = True, count + 1
            elif active and len(below) == n and all(below):
                active = False
        return count

    for setting, value in got.items():
        assert value == opens(*setting)


def test_ranking_puts_infeasible_last_and_missing_delays_behind(spark):
    rows = [("slow", True, 1.0, [500, 90]), ("none", True, 1.0, [None, 30]), ("bad", False, 0.1, [15, 15]), ("calm", True, 0.5, [120, 600])]
    df = spark.createDataFrame(rows, "setting string, feasible boolean, alerts_per_day double, delays array<int>")
    assert [r.setting for r in evaluate.rank_grid(df).collect()] == ["calm", "slow", "none", "bad"]


def test_decision_correctness_is_vacuous_without_decisions(spark):
    agent = "array<struct<t:double,type:string,alerte:string,action:string,decision:string,detail:string,code:string,verification:string>>"
    df = spark.createDataFrame([(1, "aucune", []), (2, "x", []), (3, "x", [(0.0, "decision", None, "x", "pause", None, None, None)])], f"i int, e string, agent {agent}")
    got = {r.i: r.ok for r in df.select("i", evaluate.decision_correct(F.col("e"), F.col("agent")).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_grace_covers_the_window():
    assert V.REPLAY_WARM + V.REPLAY_LENGTH + V.GRACE_CYCLES == 168
