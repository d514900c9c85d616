"""Alert rules on golden series: which alert is pending or firing at which time."""

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.plans import rules as R

HOUR, DAY = 3600, 86400


def samples(spark, step, n, *series):
    rows = [(name, labels, i * step, float(value(i * step) if callable(value) else value)) for name, labels, value in series for i in range(n)]
    return spark.createDataFrame(rows, schemas.METRICS)


def states(spark, metrics, name, until):
    aligned = R.align(metrics, 15)
    out = R.evaluate(R.BY_NAME[name], aligned, R.Grid(15, 0, until)).cache()
    return lambda t: [(r.state, r.labels, r.summary) for r in out.where(F.col("t") == t).collect()]


def firing(at):
    return [s for s in at if s[0] == "firing"]


#: One rule per case: its samples (step, count, series), the labels that must fire, and seconds from which the condition holds.
#: Every case also carries series that must never fire.
CASES = {
    "AnomalieAIOps": (
        15, 40, [("aiops_anomaly_active", {"node": n}, v) for n, v in (("print-3", 1), ("appli-atlas", 1), ("mail-1", 0))]
        + [("aiops_target_info", {"node": n, "kind": k, "application": a}, 1) for n, k, a in (("print-3", "node", ""), ("appli-atlas", "application", "atlas"), ("mail-1", "node", ""))],
        [{"node": "print-3"}], 0,
    ),
    "AnomalieApplication": (
        15, 40, [("aiops_anomaly_active", {"node": n}, 1) for n in ("print-3", "appli-atlas")] + [("aiops_target_info", {"node": "appli-atlas", "kind": "application", "application": "atlas"}, 1)],
        [{"node": "appli-atlas", "application": "atlas"}], 0,
    ),
    "ApplicationHorsLigne": (
        15, 60, [("probe_success", {"job": j, "application": a, "instance": f"http://{a}.test/"}, v) for j, a, v in (("applications", "atlas", lambda t: t < 210), ("applications", "globe", 1), ("services", "wiki", 0))],
        [{"job": "applications", "application": "atlas", "instance": "http://atlas.test/"}], 210,
    ),
    "SauvegardeApplicationEchouee": (15, 30, [("pfe_backup_app_status", {"application": a, "node": "print-3"}, v) for a, v in (("atlas", lambda t: t < 90), ("globe", 1))], [{"application": "atlas", "node": "print-3"}], 90),
    "ServeurVideDetecte": (
        60, 20, [("pfe_parc_serveur", {"adresse": a, "etat": e, "inventaire": i, "node": "hub"}, 1) for a, e, i in (("192.0.2.5", "vide", ""), ("192.0.2.6", "vide", "mail-1"), ("192.0.2.7", "occupe", ""))],
        [{"adresse": "192.0.2.5", "etat": "vide", "inventaire": "", "node": "hub"}], 0,
    ),
    "DecouverteParcEnRetard": (
        300, 60, [("node_textfile_mtime_seconds", {"file": f, "node": "hub"}, 0) for f in ("/srv/pfe_parc.prom", "/srv/else.prom")], [{"file": "/srv/pfe_parc.prom", "node": "hub"}], 3 * HOUR + 15,
    ),
    "SynchronisationEchouee": (60, 45, [("pfe_sync_statut", {"node": n}, v) for n, v in (("hub", lambda t: t < 600), ("spare", 1))], [{"node": "hub"}], 600),
    "ApplicationArgoCDDegradee": (
        60, 45, [("pfe_argocd_app", {"node": "print-3", "application": a, "nom": a, "sync": s, "sante": h}, v) for a, s, h, v in (("atlas", "Unknown", "Missing", 0.5), ("globe", "Synced", "Progressing", 1))],
        [{"node": "print-3", "application": "atlas", "nom": "atlas", "sync": "Unknown", "sante": "Missing"}], 0,
    ),
    "EtatClusterMuet": (60, 45, [("node_textfile_mtime_seconds", {"node": "print-3", "file": "/srv/pfe_etat_cluster.prom"}, lambda t: min(t, 300))], [{"node": "print-3", "file": "/srv/pfe_etat_cluster.prom"}], 915),
    "CertificatBientotExpire": (
        300, 30, [("probe_ssl_earliest_cert_expiry", {"job": j, "application": a, "instance": f"https://{a}.test/"}, e) for j, a, e in (("applications", "atlas", 14 * DAY + 1200), ("applications", "globe", 90 * DAY), ("services", "wiki", DAY))],
        [{"job": "applications", "application": "atlas", "instance": "https://atlas.test/"}], 1200 + 15,
    ),
    "CertificatPlateformeBientotExpire": (
        300, 30, [("probe_ssl_earliest_cert_expiry", {"job": "services", "service": s, "instance": i}, DAY) for s, i in (("wiki", "https://wiki.test/start"), ("raw", "https://192.0.2.44:8443/"))],
        [{"job": "services", "service": "wiki", "instance": "https://wiki.test/start"}], 0,
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_pending_for_the_hold_time_then_firing(spark, name):
    step, n, series, expected, since = CASES[name]
    hold = R.BY_NAME[name].hold
    out = R.evaluate(R.BY_NAME[name], R.align(samples(spark, step, n, *series), 15), R.Grid(15, 0, (n - 1) * step))
    rows = out.where(F.col("t") <= (n - 1) * step).collect()
    assert {tuple(sorted(r.labels.items())) for r in rows} == {tuple(sorted(e.items())) for e in expected}
    assert min(r.t for r in rows) == since and max(r.t for r in rows) >= since + hold
    assert all((r.state == "firing") == (r.t - since >= hold) for r in rows)


def test_summaries_and_the_variable_of_an_anomaly(spark):
    degraded = samples(spark, 60, 20, *CASES["ApplicationArgoCDDegradee"][2])
    at = states(spark, degraded, "ApplicationArgoCDDegradee", 1200)
    assert [s[2] for s in at(1140)] == ["atlas: Unknown / Missing for 15 minutes"]
    m = samples(spark, 15, 8, ("aiops_top_feature", {"node": "print-3", "feature": "web_ms"}, 1), ("aiops_top_feature", {"node": "print-3", "feature": "cpu_queue"}, 0), ("aiops_top_feature_zscore", {"node": "print-3"}, -7.25))
    assert [(r.node, r.feature, r.z) for r in R.top_feature_text(R.align(m, 15)).where("t = 45").collect()] == [("print-3", "web_ms", -7.25)]


def test_absent_engine_fires_without_any_sample(spark):
    m = samples(spark, 15, 20, ("up", {"job": "node-exporter", "node": "print-3"}, 1))
    at = states(spark, m, "MoteurAIOpsArrete", 300)
    assert [s[0] for s in at(60)] == ["pending"] and [s[1] for s in firing(at(120))] == [{"job": "aiops-engine"}]


def test_cpu_from_counters(spark):
    m = samples(
        spark, 15, 40, ("node_cpu_seconds_total", {"mode": "idle", "cpu": "0", "node": "busy"}, lambda t: t * 0.1), ("node_cpu_seconds_total", {"mode": "idle", "cpu": "0", "node": "calm"}, lambda t: t * 0.9)
    )
    hot = firing(states(spark, m, "CpuEleve", 600)(300))
    assert [(s[1]["node"], s[2]) for s in hot] == [("busy", "CPU at 90 % on busy")]


def test_unreachable_node_masks_its_alerts(spark):
    m = R.align(
        samples(spark, 15, 20, ("up", {"job": "node-exporter", "node": "a"}, 0), ("aiops_data_quality", {"node": "a"}, 0), ("aiops_data_quality", {"node": "b"}, 0), ("pfe_sync_statut", {"node": "b"}, 0)), 15
    )
    alerts = R.evaluate_all(m, R.Grid(15, 0, 300), [R.BY_NAME[n] for n in ("NoeudInjoignable", "AIOpsAveugle")])
    shown = {(r.alertname, r.labels["node"]) for r in R.inhibit(alerts).where("t = 285").collect()}
    assert shown == {("NoeudInjoignable", "a"), ("AIOpsAveugle", "b")}


def test_every_rule_is_there():
    assert len(R.RULES) == 32 and len(R.BY_NAME) == 32 and all(r.reads for r in R.RULES)
