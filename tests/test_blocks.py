"""Blocked ordered operators against brute force, with one key holding most rows."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.operators import blocks, detect, series
from pulsegrid.operators.blocks import Run


def rows(seed=1, n=1500):
    rnd = random.Random(seed)
    out = []
    for key, share in (("hot", 1.0), ("warm", 0.3), ("cold", 0.02)):
        for t in range(n):
            if rnd.random() < share:
                out.append((key, t * 15 + rnd.choice([0, 3]), round(rnd.uniform(0, 10), 3)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    raw = rows()
    return raw, spark.createDataFrame(raw, "k string, t long, v double").cache()


def by_key(raw):
    for key in sorted({r[0] for r in raw}):
        yield key, sorted(r[1:] for r in raw if r[0] == key)


def test_running_aggregates(data):
    raw, df = data
    odd = F.when(F.col("v") > 6, F.col("v"))
    got = blocks.running(
        df, ["k"], ["t"],
        {"s": Run("sum", F.col("v")), "n": Run("count", F.lit(1)), "mx": Run("max", F.col("v")), "mn": Run("min", F.col("v")),
         "lst": Run("last", odd), "prev": Run("last", odd, inclusive=False), "fst": Run("first", odd)}, width=600,
    ).orderBy("k", "t").collect()
    i = 0
    for _, seq in by_key(raw):
        total, last, first, seen = 0.0, None, None, []
        for t, v in seq:
            before = last
            total += v
            seen.append(v)
            if v > 6:
                last = v
                first = v if first is None else first
            r = got[i]
            i += 1
            assert abs(r.s - total) < 1e-9 and r.n == len(seen) and r.mx == max(seen) and r.mn == min(seen)
            assert (r.lst, r.prev, r.fst) == (last, before, first)
    assert i == len(got)


def test_run_since_reset(data):
    raw, df = data
    got = detect.run_length(df, ["k"], ["t"], F.col("v") > 2, width=90).orderBy("k", "t").collect()
    i = 0
    for _, seq in by_key(raw):
        run = 0
        for _, v in seq:
            run = run + 1 if v > 2 else 0
            assert got[i].run == run
            i += 1


def test_asof_matches_brute_force(spark, data):
    raw, df = data
    ticks = series.tick_grid(df, ["k"], 60)
    got = series.asof(ticks, df, ["k"], ["v"], 45, width=600).collect()
    table = {k: seq for k, seq in by_key(raw)}
    for r in got:
        hit = [(t, v) for t, v in table[r.k] if t <= r.t]
        fresh = bool(hit) and r.t - hit[-1][0] < 45
        assert r.v == (hit[-1][1] if fresh else None)


def test_counter_increase_resets_and_window(spark):
    values = [(0, 5.0), (15, 8.0), (30, 2.0), (45, 6.0), (200, 9.0), (215, 10.0)]
    df = spark.createDataFrame([("a", t, v) for t, v in values], "k string, t long, value double")
    got = {r.t: (r.increase, r.rate) for r in series.counter_increase(series.counter_increase(df, ["k"], 120), ["k"], 120, "rate", True).collect()}
    assert got[0] == (None, None)
    assert got[45][0] == 3 + 2 + 4  # the drop to 2 is a restart
    assert got[45][1] == pytest.approx(9 / 45)
    assert got[200] == (None, None)  # alone in its window
    assert got[215][0] == 1


def test_dense_counters_give_the_same_increase(data):
    _, df = data
    counter = df.withColumnRenamed("v", "value")
    wide = series.counter_increase(counter, ["k"], 300, "x", width=10_000)
    narrow = series.counter_increase(counter, ["k"], 300, "x", width=60)
    pick = lambda d: d.select("k", "t", F.round("x", 6).alias("x"))
    assert pick(wide).exceptAll(pick(narrow)).count() == 0 and narrow.count() == counter.count()


def test_episodes_holes_and_trailing(spark):
    points = [(0, 1), (15, 1), (30, 0), (45, 1), (200, 1), (215, 0), (230, 1), (245, 1)]
    df = spark.createDataFrame([("n", t, v) for t, v in points], "k string, t long, v int")
    got = [(r.start, r.end) for r in detect.episodes(df, ["k"], F.col("v") >= 1, 45, width=100).orderBy("start").collect()]
    assert got == [(0, 30), (45, 45), (200, 215), (230, 245)]


def test_first_hit_and_cover(spark):
    rnd = random.Random(5)
    spans = [("a" if rnd.random() < 0.8 else "b", s, s + rnd.randint(0, 300)) for s in (rnd.randint(0, 5000) for _ in range(200))]
    pts = [("a" if rnd.random() < 0.8 else "b", rnd.randint(0, 5400), i) for i in range(300)]
    w = spark.createDataFrame(spans, "k string, a long, b long")
    p = spark.createDataFrame(pts, "k string, t long, i int")
    for r in detect.covered_by(p, w, ["k"], "a", "b", width=500).collect():
        assert r.covered == any(k == r.k and a <= r.t <= b for k, a, b in spans)
    for r in detect.first_in_window(w, p, ["k"], "a", "b", width=500).collect():
        hits = [t for k, t, _ in pts if k == r.k and r.a <= t <= r.b]
        assert r.first_hit == (min(hits) if hits else None)


def test_both_sides_of_a_sweep_from_one_table(spark):
    """Points, hits and windows of one table, rows that are both, null kinds, a hot key; the raw table is not read again."""
    rnd = random.Random(9)
    rows = [("a" if rnd.random() < 0.8 else "b", rnd.randint(0, 9000), rnd.choice(["p", "w", "both", "x", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, kind string, i int")
    point, window = F.col("kind").isin("p", "both"), F.col("kind").isin("w", "both")
    points = [(k, t, i) for k, t, kind, i in rows if kind in ("p", "both")]
    spans = [(k, t, i) for k, t, kind, i in rows if kind in ("w", "both")]

    covered = detect.covered_by_of(df, ["k"], point, {"i": F.col("i")}, window, F.col("t") + 1, F.col("t") + 40, probe=300)
    got = {r.i: r.covered for r in covered.collect()}
    assert got == {i: any(k == sk and st + 1 <= t <= st + 40 for sk, st, _ in spans) for k, t, i in points}
    assert "kind" not in covered._jdf.queryExecution().optimizedPlan().toString()

    windows = [(window, {"i": F.col("i"), "a": F.col("t"), "b": F.col("t") + d, "name": F.lit(n)}) for n, d in (("p", 90), ("both", 300))]
    first = detect.first_in_window_of(df, ["k"], point, windows, "a", "b", by={"name": F.col("kind")}, probe=300)
    want = {}
    for k, t, i in spans:
        for n, d in (("p", 90), ("both", 300)):
            hits = [pt for pk, pt, kind, _ in rows if pk == k and kind == n and t <= pt <= t + d]
            want[i, n] = min(hits) if hits else None
    assert {(r.i, r["name"]): r.first_hit for r in first.collect()} == want

    near = series.asof_of(df, ["k"], point, {"i": F.col("i")}, window, {"at": F.col("t")}, 200, probe=300)
    for r in near.collect():
        before = [st for sk, st, _ in spans if sk == r.k and st <= r.t]
        at = max(before) if before and r.t - max(before) < 200 else None
        assert (r["at"], r.age) == (at, None if at is None else r.t - at)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.sampled_from([0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 9.0]), min_size=1, max_size=120),
    lam=st.sampled_from([0.2, 0.4, 1.0]),
    kn=st.sampled_from([(1, 1), (3, 4), (5, 8)]),
)
def test_latch_equals_automaton(spark, values, lam, kn):
    k, n = kn
    df = spark.createDataFrame([("a", i * 15, v) for i, v in enumerate(values)], "k string, t long, v double")
    got = detect.hysteresis(df, ["k"], ["t"], "v", 2.0, 1.0, k, n, lam, width=150).orderBy("t").collect()
    s, active, above, below = None, False, [], []
    for r, v in zip(got, values):
        s = v if s is None else lam * v + (1 - lam) * s
        above, below = [*above, s > 2.0][-n:], [*below, s < 1.0][-n:]
        was = active
        if not active and sum(above) >= k:
            active = True
        elif active and len(below) == n and all(below):
            active = False
        assert abs(r.smoothed - s) < 1e-9 and (r.active, r.opened, r.closed) == (active, active and not was, was and not active)


def test_block_width_follows_density(spark):
    dense = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") % 3600).alias("t"))
    assert blocks.width_for(dense, ["k"], "t", max_rows=1000) == 180


def test_bad_parameters():
    with pytest.raises(ValueError):
        detect.hysteresis(None, ["k"], ["t"], "v", 1.0, 2.0, 3, 4, 0.4)
    with pytest.raises(ValueError):
        detect.hysteresis(None, ["k"], ["t"], "v", 2.0, 1.0, 5, 4, 0.4)
    with pytest.raises(ValueError):
        detect.smooth_and_vote(None, ["k"], "v", 2.0, 1.0, 0.0, 4)
