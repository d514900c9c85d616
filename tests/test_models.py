"""Forest, baseline and champion/challenger behaviour on a small fleet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import features, forest, lifecycle
from tests import fleet

AT = fleet.AT


@pytest.fixture(scope="module")
def fitted(spark):
    models, nodes, _ = lifecycle.fit(fleet.table(spark, fleet.quiet(1, 1300), 0, 30), fleet.SPEC)
    return models, nodes, models.first()


def points(spark, xs):
    return fleet.table(spark, np.array(xs), 10_000_000, 15)


def judged(spark, fitted, *shifts):
    """Verdicts on points that leave the median by the given number of minimum effects, per feature."""
    models, nodes, m = fitted
    xs = [[m.median[i] + shift.get(n, 0) * m.min_effects[i] for i, n in enumerate(fleet.NAMES)] for shift in shifts]
    rows = points(spark, xs)
    return lifecycle.flags(rows, models, lifecycle.isolation_scores(rows, models, nodes)).orderBy("t").collect()


def test_one_far_feature_or_many_near_ones(spark, fitted):
    far, near = judged(spark, fitted, {"cpu_queue": 11}, dict.fromkeys(("cpu_host", "cpu_queue", "ram_queue_mb", "ram_base_mb", "web_ms"), 0.9))
    assert far.z_max > 3.5 and far.flagged
    assert near.z_max < 3.5 and near.score > near.threshold and near.effect >= 1 and near.flagged


def test_effects_add_up_as_squares(spark, fitted):
    shifts = ({"web_ms": 0.15}, {"ram_queue_mb": 0.6}, {"ram_queue_mb": 0.6, "ram_base_mb": -0.8}, {"ram_queue_mb": 0.6, "cpu_host": -5})
    small, part, whole, spared = judged(spark, fitted, *shifts)
    assert [small.effect, part.effect, whole.effect, spared.effect] == pytest.approx([0.15, 0.6, 1.0, 0.6], abs=1e-9)
    assert not small.flagged and not part.flagged and small.z_max < 1  # and less load never harms


def test_the_variable_of_a_fault(spark, fitted):
    down, full = judged(spark, fitted, {"web_ok": -2, "web_ms": 1}, {"ram_base_mb": 30, "net_rx_kb": 4})
    assert (down.top_feature, full.top_feature) == ("web_ok", "ram_base_mb")


def test_forest_is_calm_while_levels_wander(spark):
    wide = fleet.spreads(cpu_host=0.6, cpu_queue=0.4, net_rx_kb=12.0, ram_queue_mb=3.0, web_ms=15.0)
    models, nodes, _ = lifecycle.fit(fleet.table(spark, fleet.quiet(2, 1100, spread=wide), 0, 30), fleet.SPEC)
    # no feature moves by half of what matters, and the disk is being emptied
    moved = fleet.levels(cpu_host=31.8, disk_host=17.0, net_rx_kb=147.0, ram_queue_mb=312.5, web_ms=105.0)
    rows = points(spark, fleet.quiet(3, 300, moved, wide / 2))
    scored = lifecycle.isolation_scores(rows, models, nodes).join(models.select("target", "threshold"), "target")
    assert scored.where("score > threshold").count() < 300 * 0.02


def test_refit_gives_the_same_forest(spark, fitted):
    again, _, _ = lifecycle.fit(fleet.table(spark, fleet.quiet(1, 1300), 0, 30).repartition(7), fleet.SPEC)
    assert again.first().threshold == pytest.approx(fitted[2].threshold, abs=1e-12)


@pytest.mark.parametrize("n", [40, 256, 300, 1100, 5000])
def test_every_tree_gets_its_sample(spark, n):
    rows = fleet.table(spark, fleet.quiet(4, n), 0, 30).withColumn("copy", F.lit(1))
    roots = forest.fit_forest(rows, trees=12).where("node = 0").collect()
    assert [r["size"] for r in roots] == [min(n, V.TREE_SAMPLE)] * 12


def test_challenger_leaves_past_faults_out(spark, fitted):
    models, nodes, _ = fitted
    x = fleet.quiet(1, 1900)
    x[700:910, AT["cpu_queue"]] = 88
    new, _, verdict = lifecycle.champion_challenger(fleet.table(spark, x, 0, 30), fleet.SPEC, (models, nodes), trees=100)
    r = verdict.first()
    assert r.removed >= 205 and r.version == 2 and r.accepted
    assert new.first().median[AT["cpu_queue"]] < 14


def test_suspended_champion_is_replaced_and_seasonality_needs_history(spark, fitted):
    models, nodes, _ = fitted
    x = fleet.quiet(5, 700)
    old = models.withColumn("if_suspended", F.lit(True))
    _, _, verdict = lifecycle.champion_challenger(fleet.table(spark, x, 0, 300), fleet.SPEC, (old, nodes), trees=20)
    r = verdict.first()
    assert r.obsolete and r.accepted and r.seasonal
    assert not lifecycle.fit_baseline(fleet.table(spark, x, 0, 30), fleet.SPEC).first().span_hours >= V.SEASONAL_MIN_SPAN_HOURS


def test_scores_do_not_depend_on_slicing(spark, fitted):
    models, nodes, _ = fitted
    rows = fleet.table(spark, fleet.quiet(9, 400), 0, 900)
    a = forest.score(rows, nodes, slice_seconds=3600).select("t", F.round("score", 12).alias("s"))
    b = forest.score(rows, nodes, slice_seconds=10**9).select("t", F.round("score", 12).alias("s"))
    assert a.exceptAll(b).count() == 0 and a.count() == 400


def test_specs():
    app = features.application_spec(["mail"], base=False, web=True)
    assert [f[0] for f in app] == ["cpu_mail", "ram_mail_mb", "app_containers", "web_ok", "web_ms"]
    assert len(features.node_spec(False)) == 4 and len(features.node_spec(True)) == 8
