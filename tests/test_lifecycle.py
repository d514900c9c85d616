"""Regimes in batch and stream, keyed state in event time, the registry and the training cycle."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import lifecycle, registry
from pulsegrid.session import cut
from pulsegrid.streaming import jobs, processors

SPEC = (("load", 0.0, 1e9, 2.0, "up", 60.0), ("pods", 0.0, 1e9, 1.5, "both", V.INF))
STEP = 60
T0 = 1_700_000_000 // STEP * STEP


def fleet_rows(spark, n=1500, parts=1):
    """``stair`` settles on new levels three times, ``brief`` has short peaks, ``hot`` rises above its critical level and stays."""
    rng = np.random.default_rng(21)
    i = np.arange(n)
    load = {
        "stair": 10 + 8 * (i >= 400) + 9 * (i >= 750) + 10 * (i >= 1150) + rng.normal(0, 0.3, n),
        "brief": 10 + 12 * ((i % 400 >= 300) & (i % 400 < 315)) + rng.normal(0, 0.3, n),
        "hot": 10 + 70.0 * (i >= 600) + rng.normal(0, 0.3, n),
        "fewer": 10 + 8 * (i >= 500) + rng.normal(0, 0.3, n),
    }
    pods = {k: np.full(n, 4.0) for k in load} | {"fewer": np.where(i >= 480, 2.0, 4.0)}
    made = pd.concat([pd.DataFrame({"target": k, "t": T0 + STEP * i, "x": list(np.stack([load[k], pods[k]], axis=1))}) for k in load])
    return cut(spark.createDataFrame(made, "target string, t long, x array<double>").repartition(parts))


def models_of(rows):
    base = lifecycle.fit_baseline(rows.where(F.col("t") < T0 + 300 * STEP), SPEC)
    return base.withColumns({
        "threshold": F.lit(0.6), "low_threshold": F.lit(0.5), "if_suspended": F.lit(False), "seasonal": F.lit(False), "version": F.lit(1), "regime_start": F.lit(0).cast("long"),
    })


def scores_of(rows):
    return rows.select("target", "t", F.when(F.col("x")[0] > 15, 0.8).otherwise(0.4).alias("score"))


def quiet():
    return F.col("t") % 7200 < 600


def stream_rows(rows):
    joined = lifecycle.attach(rows, models_of(rows)).join(scores_of(rows), ["target", "t"])
    critical = F.array(*[F.lit(s[5]) for s in SPEC])
    return joined.select("*", F.lit(1).alias("quality"), quiet().alias("suppressed"), critical.alias("critical")).drop("seasonal")


COLUMNS = ("target", "t", "active", "z_active", "if_effective", "regime")


def decisions(df):
    return {(r["target"], r["t"]): (r["active"], r["z_active"], bool(r["if_effective"] and (r["active"] or r["regime"])), r["regime"]) for r in df.collect()}


@pytest.fixture(scope="module")
def batch(spark):
    rows = fleet_rows(spark)
    found, regimes = lifecycle.detect_with_regimes(rows, scores_of(rows), models_of(rows), quiet(), SPEC, "pods", width=400 * STEP)
    return rows, cut(found), cut(regimes)


def test_several_regimes_for_one_target_and_none_where_they_do_harm(batch):
    _, found, regimes = batch
    per = {k: [r for r in sorted(regimes.collect(), key=lambda r: r["t"]) if r["target"] == k] for k in ("stair", "brief", "hot", "fewer")}
    assert [r["number"] for r in per["stair"]] == [1, 2, 3] and not per["brief"] and not per["hot"] and not per["fewer"]
    assert [round(r["plateau_median"][0]) for r in per["stair"]] == [18, 27, 37]
    assert all(r["t"] - r["regime_start"] >= V.REGIME_MINUTES * 60 for r in per["stair"])
    assert found.count() == 6000 and found.select("target", "t").distinct().count() == 6000
    # after its last regime the stair is calm again, while the hot target stays open
    tail = found.where(F.col("t") > T0 + 1400 * STEP).groupBy("target").agg(F.max(F.col("active").cast("int")).alias("a")).collect()
    assert {r["target"]: r["a"] for r in tail} == {"stair": 0, "brief": 0, "hot": 1, "fewer": 1}


def test_stream_over_many_batches_with_late_rows_equals_the_batch(spark, batch):
    rows, found, _ = batch
    table = cut(stream_rows(rows))
    path = jobs.new_folder(spark, "sliced")
    slices, n = 6, 1500
    late = 0
    for k in range(slices):
        lo, hi = T0 + k * n // slices * STEP, T0 + (k + 1) * n // slices * STEP
        table.where((F.col("t") >= lo) & (F.col("t") < hi)).coalesce(1).write.mode("append").parquet(path)
        if k in (1, 3):  # rows of an earlier time: inside the delay they reach the automaton, behind it they don't
            near = table.where((F.col("t") >= hi - 3600) & (F.col("t") < hi - 3000))
            far = table.where((F.col("t") >= T0) & (F.col("t") < T0 + 600))
            late += near.count()
            near.unionByName(far).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    detector = processors.Detector(lam=V.EWMA_LAMBDA, count_feature="pods", ttl=90 * 86400, report_late=True)
    out = cut(jobs.drain(jobs.keyed(stream, ["target"], detector, "t", "2 hours"), "late"))
    assert out.where("event_kind = 'late'").count() == late
    kept = out.where("event_kind is null or event_kind <> 'late'")
    assert kept.count() == 6000 and decisions(kept) == decisions(found)


def test_replay_in_slices_equals_one_piece(spark, batch):
    rows, found, _ = batch
    table = stream_rows(rows.where("target in ('stair', 'brief')"))
    stream = jobs.replay(table, "sliced", ["target"], slices=5, files=1)
    out = jobs.drain(jobs.keyed(stream, ["target"], processors.Detector(count_feature="pods"), "t"), "sliced")
    assert decisions(out) == decisions(found.where("target in ('stair', 'brief')"))


class Counter(processors.DocumentProcessor):
    """Rows seen of a key."""

    fields = ("k", "t", "n")
    schema = "k string, t long, n long"
    ttl = 1000

    def fresh(self):
        return {"n": 0}

    def step(self, key, doc, row):
        doc["n"] += 1
        return [(key[0], int(row.t), doc["n"])]


def test_state_of_a_silent_key_expires(spark):
    path = jobs.new_folder(spark, "ttl")
    steps = ([("a", 100), ("b", 100)], [("a", 900)], [("a", 1700)], [("a", 2600)], [("a", 3000), ("b", 3000)])
    for rows in steps:
        spark.createDataFrame(rows, "k string, t long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("k string, t long").option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.drain(jobs.keyed(stream, ["k"], Counter(), "t", "10 seconds"), "ttl")
    assert sorted(tuple(r) for r in out.collect()) == [("a", 100, 1), ("a", 900, 2), ("a", 1700, 3), ("a", 2600, 4), ("a", 3000, 5), ("b", 100, 1), ("b", 3000, 1)]


# ---------------------------------------------------------------- registry and training cycle
def plain_rows(spark, targets, start, n, shift=0.0, seed=1, step=300):
    rng = np.random.default_rng(seed)
    made = pd.concat([pd.DataFrame({"target": k, "t": start + step * np.arange(n), "x": list(np.stack([10 + shift + rng.normal(0, 1, n), np.full(n, 4.0)], axis=1))}) for k in targets])
    return spark.createDataFrame(made, "target string, t long, x array<double>")


def expected_of(spark, signatures):
    shape = {"names": F.array(*[F.lit(s[0]) for s in SPEC]), "min_effects": F.array(*[F.lit(s[3]) for s in SPEC]), "directions": F.array(*[F.lit(s[4]) for s in SPEC])}
    table = spark.createDataFrame([(k, "application" if s else "node", s) for k, s in signatures.items()], "target string, kind string, signature string")
    return table.select("target", "kind", "signature", *[c.alias(k) for k, c in shape.items()])


def outcomes(df):
    return {r["target"]: (r["outcome"], r["version"]) for r in df.collect()}


def in_force(reg, expected):
    return {r["target"]: r for r in reg.current(expected).collect()}


def test_training_cycles_chained_through_the_registry(spark):
    reg = registry.Registry(spark, jobs.new_folder(spark, "registry"))
    expected = expected_of(spark, {"app": "f1", "node": None, "new": None})
    start, hour = T0, 3600
    rows = cut(plain_rows(spark, ["app", "node"], start, 500).unionByName(plain_rows(spark, ["new"], start, 100)))
    now = start + 500 * 300
    assert reg.models() is None and reg.current(expected) is None
    assert outcomes(registry.train_cycle(reg, rows, SPEC, expected, now, trees=20)) == {"app": ("accepted", 1), "node": ("accepted", 1), "new": ("short", None)}
    first = in_force(reg, expected)
    assert {k: (r["version"], r["trained_at"], r["signature"], r["schema_version"]) for k, r in first.items()} == {"app": (1, now, "f1", V.MODEL_SCHEMA_VERSION), "node": (1, now, None, V.MODEL_SCHEMA_VERSION)}

    # a challenger that raises more false alarms than the champion: the champion stays, with a new training time
    later = now + 7 * hour
    spiky = rows.where("target <> 'new'").withColumn("x", F.when((F.col("t") >= now - 100 * 300) & (F.col("target") == "node") & (F.col("t") % 1500 == 0), F.array(F.lit(13.0), F.lit(4.0))).otherwise(F.col("x")))
    verdict = outcomes(registry.train_cycle(reg, cut(spiky), SPEC, expected, later, hours=1e6, trees=20))
    second = in_force(reg, expected)
    for k, (outcome, _) in verdict.items():
        assert second[k]["trained_at"] == later and second[k]["version"] == (2 if outcome == "accepted" else 1)
    assert reg.nodes(reg.current(expected)).select("target").distinct().count() == 2

    # a regime: the level moves, the forest is suspended, and the next challenger comes in without a comparison
    regimes = spark.createDataFrame([("node", later + 100, later - 2000, [25.0, 4.0])], "target string, t long, regime_start long, plateau_median array<double>")
    registry.accept_regimes(reg, regimes, expected)
    moved = in_force(reg, expected)
    assert moved["node"]["median"] == [25.0, 4.0] and moved["node"]["if_suspended"] and not moved["app"]["if_suspended"]
    due = lifecycle.should_train(reg.current(expected).select("target", "trained_at", "if_suspended", F.lit(False).alias("active"), F.lit(False).alias("drift"), F.lit(later).alias("last_attempt")), later + V.TRAIN_RETRY_SECONDS)
    assert {r["target"]: r["should_train"] for r in due.collect()} == {"app": False, "node": True}
    shifted = cut(rows.where("target <> 'new'").unionByName(plain_rows(spark, ["node"], later, 300, shift=15.0, seed=3)))
    third = outcomes(registry.train_cycle(reg, shifted, SPEC, expected, later + 300 * 300, trees=20))
    assert third["node"] == ("accepted", moved["node"]["version"] + 1)
    after = in_force(reg, expected)["node"]
    # only rows since the regime's start were learned from
    assert not after["if_suspended"] and after["median"][0] == pytest.approx(25, abs=0.5) and after["regime_start"] == later - 2000

    # other formulas: the application's model no longer fits, the node's does
    assert set(in_force(reg, expected_of(spark, {"app": "f2", "node": None}))) == {"node"}


def test_a_put_without_its_manifest_row_does_not_exist(spark):
    path = jobs.new_folder(spark, "registry")
    reg = registry.Registry(spark, path)
    model = spark.createDataFrame([("a", 1)], "target string, version int")
    reg.put(model, None, "first")
    model.withColumn("version", F.lit(2)).write.parquet(f"{path}/models/broken")
    assert [r["version"] for r in reg.models().collect()] == [1] and len(reg.entries()) == 1


def test_ordered_split_without_a_join_by_key(spark):
    rng = np.random.default_rng(4)
    sizes = {"hot": 3000, "cold": 7, "one": 1}
    table = spark.createDataFrame([(k, int(t)) for k, n in sizes.items() for t in rng.choice(10**6, n, replace=False)], "target string, t long").repartition(5)
    split = lifecycle.split_holdout(table, 0.2, width=50_000)
    got = {(r["target"], r["t"]): r["is_train"] for r in split.collect()}
    for k, n in sizes.items():
        times = sorted(t for key, t in got if key == k)
        assert [got[k, t] for t in times] == [i < int(np.floor(n * 0.8)) for i in range(n)]
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and all("__block" in line for line in plan.splitlines() if "Join" in line)
