"""Policies, guards and verification."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import decisions
from pulsegrid.streaming import jobs, processors

ALERT = "alertname string, node string, application string, job string, source string, feature string, z double"


@pytest.fixture(scope="module")
def fleet(spark):
    nodes = spark.createDataFrame([("hub", False, True, False, 0), ("print-3", True, False, True, 1), ("mail-1", True, False, False, 2)], "name string, app boolean, monitoring boolean, k3s boolean, ord int")
    apps = spark.createDataFrame([("atlas", ["tiles", "routes", "search"]), ("globe", ["viewer"])], "application string, components array<string>")
    return nodes, apps


def plan(spark, fleet, name, node="print-3", application=None, job="", source="", feature=None, z=None, **kw):
    row = spark.createDataFrame([(name, node, application, job, source, feature, z)], ALERT)
    r = decisions.plan(row, *fleet, **kw).first()
    return r.plan_node, r.action, r.arg, r.reason


def app(feature=None, z=None, application="atlas", **kw):
    return dict(name="AnomalieApplication", application=application, feature=feature, z=z, **kw)


def nothing(reason, node="print-3"):
    return (node, None, "", reason)


#: Alerts by what the policy does with them: restart something, or leave it and say why.
RESTARTS = [
    *[(app(f"{kind}_{c}{unit}", z), ("print-3", "rollout-app", f"atlas/{c}", "component_overload")) for c in ("tiles", "routes", "search") for kind, unit, z in (("cpu", "", 3.6), ("ram", "_mb", 12.0))],
    (app("ram_viewer_mb", 5.5, "globe", node="appli-globe"), ("print-3", "rollout-app", "globe/viewer", "component_overload")),
    *[(dict(name="AnomalieAIOps", node=n, feature=f, z=z), ("print-3", "rollout-restart", "server", "server_overload")) for n in ("print-3", "mail-1") for f in V.SERVER_FEATURES for z in (None, 9.25)],
    *[(dict(name="AnomalieAIOps", feature=f, z=4.4), ("print-3", "stop-sonarqube", "", "host_overload")) for f in V.HOST_LOAD_FEATURES],
    (dict(name="MoteurAIOpsArrete", node=None), ("hub", "restart-container", "mon-aiops-engine", "engine_stopped")),
    *[(dict(name="CollecteurArrete", node="mail-1", job=j), ("mail-1", "restart-container", j, "collector_silent")) for j in V.COLLECTOR_JOBS],
    (dict(name="CollecteurArrete", node="hub", job="cadvisor"), ("hub", "restart-container", "cadvisor", "collector_silent")),
    (dict(name="NoeudInjoignable", node="mail-1"), ("mail-1", "restart-container", "node-exporter", "collector_silent")),
    (dict(name="DisquePleinPrevu", disk_cleanup=True), ("print-3", "clean-disk", "", "disk_full")),
]
LEFT_ALONE = [
    *[(dict(name="AnomalieAIOps", feature=f, z=-4.75), nothing("falling")) for f in ("cpu_server", "ram_host")],
    (app("cpu_search", -3.9), nothing("falling")),
    (dict(name="AnomalieAIOps", z=8.0), nothing("no_diagnosis")),
    (app(), nothing("no_diagnosis")),
    *[(dict(name="AnomalieAIOps", feature=f), nothing("no_safe_action")) for f in ("disk_host", "app_containers")],
    (dict(name="AnomalieAIOps", node="hub", feature="ram_server_mb"), nothing("no_safe_action", "hub")),
    (app("web_ms", 30.0), nothing("no_safe_action")),
    (app("ram_base_mb", 3.75), nothing("database_never_restarted")),
    (app("ram_viewer_mb", 6.0), nothing("component_not_listed")),  # a component of another application
    (app("cpu_tiles", 6.0, "ghost"), nothing("unknown_application")),
    (dict(name="ApplicationHorsLigne", node=None, application="globe"), nothing("self_healing")),
    (dict(name="CollecteurArrete", node="hub", job="cadvisor-k3s"), nothing("collector_not_listed", "hub")),
    (dict(name="CollecteurArrete", job="registry"), nothing("collector_not_listed")),
    (dict(name="NoeudInjoignable", node="stranger"), nothing("unknown_node", "stranger")),
    (dict(name="RamElevee", node="hub"), nothing("memory_high_no_action", "hub")),
    *[(dict(name=n, node="mail-1"), nothing("disk_cleanup_disabled", "mail-1")) for n in ("DisquePlein", "DisquePleinPrevu")],
    (dict(name="CopieDistanteEnRetard", source="backup"), nothing("own_alert")),
    (dict(name="CpuEleve", node="mail-1"), nothing("watch_only", "mail-1")),
]
CASES = RESTARTS + LEFT_ALONE


def test_policies(spark, fleet):
    got, expected = [], []
    plain = [(c, e) for c, e in CASES if "disk_cleanup" not in c]
    rows = [(c["name"], c.get("node", "print-3"), c.get("application"), c.get("job", ""), c.get("source", ""), c.get("feature"), c.get("z"), i) for i, (c, _) in enumerate(plain)]
    out = decisions.plan(spark.createDataFrame(rows, ALERT + ", i int"), *fleet).orderBy("i").collect()
    for r, (_, e) in zip(out, plain):
        got.append((r.plan_node, r.action, r.arg, r.reason))
        expected.append(e)
    assert got == expected
    assert plan(spark, fleet, "DisquePleinPrevu", disk_cleanup=True) == ("print-3", "clean-disk", "", "disk_full")


def test_no_control_node(spark, fleet):
    lone = spark.createDataFrame([("hub", False, True, False, 0)], "name string, app boolean, monitoring boolean, k3s boolean, ord int")
    assert plan(spark, (lone, fleet[1]), "AnomalieApplication", application="atlas", feature="cpu_tiles") == ("-", None, "", "no_control_node")


def guard(spark, rows, name, **kw):
    df = spark.createDataFrame([("agent", t, i, incident, key, code) for i, (t, incident, key, code) in enumerate(rows)], "scope string, t long, row_id long, incident string, action_key string, code int")
    out = jobs.drain(jobs.keyed(jobs.replay(df, name), ["scope"], processors.Guard(**kw)), name).orderBy("row_id").collect()
    return [r.decision for r in out]


def test_guard_order(spark):
    hour, rest = 3600, V.COOLDOWN_SECONDS
    # the pause is over exactly at its end; a third attempt on one incident is someone else's job
    assert guard(spark, [(5, "x", "a", 0), (4 + rest, "y", "a", 0), (5 + rest, "y", "a", 0)], "pause") == ["executee", "pause", "executee"]
    assert guard(spark, [(k * 2 * rest, "x", k_name, 0) for k, k_name in enumerate("abc")] + [(V.DAY + 2 * rest, "x", "a", 0)], "tries") == ["executee", "executee", "escalade", "executee"]
    quota = [(k, f"i{k}", f"act{k}", None) for k in range(4)] + [(hour - 1, "z", "late", 0), (hour, "z", "late", 0)]
    assert guard(spark, quota, "quota") == ["simulee"] * 3 + ["quota", "quota", "executee"]
    # failures in a row suspend for good; a success between them starts the count again
    broken = [(k * 2 * hour, f"i{k}", f"act{k}", code) for k, code in enumerate((7, 2, 0, 1, 9, 5, 0))]
    assert guard(spark, broken, "breaker") == ["executee"] * 6 + ["suspendu"]
    # no effect: the quota is not charged, the pause is
    idle = [(k, f"i{k}", f"act{k}", 3 + k % 2) for k in range(5)] + [(9, "other", "act1", 0), (10, "other", "new", 0)]
    assert guard(spark, idle, "idle") == ["executee"] * 5 + ["pause", "executee"]


def test_rows_of_one_time_follow_their_ids(spark):
    rows = [(60, f"i{k}", "same", 0) for k in range(6)]
    for parts in (1, 5):
        df = spark.createDataFrame([("agent", t, i, incident, key, code) for i, (t, incident, key, code) in enumerate(rows)][::-1], "scope string, t long, row_id long, incident string, action_key string, code int")
        out = jobs.drain(jobs.keyed(jobs.replay(df.repartition(parts), f"ties{parts}"), ["scope"], processors.Guard()), f"ties{parts}")
        assert [r.row_id for r in out.where("decision = 'executee'").collect()] == [0]


def test_guard_against_brute_force(spark):
    rnd = random.Random(4)
    rows = sorted((rnd.randint(0, 40_000), f"i{rnd.randint(0, 9)}", rnd.choice("abcde"), rnd.choice([0, 0, 0, 1, 3, None])) for _ in range(120))
    got = guard(spark, rows, "brute", breaker=4)
    allowed, quota, failures, suspended = [], [], 0, False
    for (t, incident, key, code), g in zip(rows, got):
        quota = [q for q in quota if t - q < 3600]
        tries = [a for a in allowed if a[1] == incident]
        count = 0
        for a in tries:  # attempts expire a day after the latest one
            count = count + 1
        last = max((a[0] for a in allowed if a[2] == key), default=None)
        if suspended:
            expected = "suspendu"
        elif count >= V.MAX_ATTEMPTS:
            expected = "escalade"
        elif last is not None and t - last < V.COOLDOWN_SECONDS:
            expected = "pause"
        elif len(quota) >= V.MAX_ACTIONS_PER_HOUR:
            expected = "quota"
        else:
            expected = "simulee" if code is None else "executee"
            allowed.append((t, incident, key))
            if code not in (3, 4):
                quota.append(t)
            if code is not None:
                failures = failures + 1 if code == 1 else 0
                suspended = failures >= 4
        assert g == expected


def test_verification(spark):
    acts = spark.createDataFrame([("RamElevee", "a", 0), ("RamElevee", "b", 0), ("MoteurAIOpsArrete", "m", 100)], "alertname string, node string, t long")
    fire = spark.createDataFrame([("RamElevee", "a", 0, 400), ("RamElevee", "b", 0, 200), ("MoteurAIOpsArrete", None, 390, 500)], "alertname string, node string, start long, end long")
    got = {(r.alertname, r.node): r.verification for r in decisions.verify(acts, fire).collect()}
    assert got == {("RamElevee", "a"): "persistant", ("RamElevee", "b"): "resolu", ("MoteurAIOpsArrete", "m"): "persistant"}


def test_only_actions_are_verified_and_unread_alerts_are_unknown(spark):
    acts = spark.createDataFrame(
        [("a", 0, "executee", True), ("b", 0, "simulee", True), ("c", 0, "pause", True), ("d", 0, "executee", False), ("e", 0, "executee", None)],
        "node string, t long, decision string, read boolean",
    ).withColumn("alertname", F.lit("RamElevee"))
    fire = spark.createDataFrame([("RamElevee", n, 0, 400) for n in "acd"], "alertname string, node string, start long, end long")
    done = decisions.verify(acts, fire, acted=F.col("decision").isin("executee", "simulee"), readable=F.col("read"))
    assert {r.node: r.verification for r in done.collect()} == {"a": "persistant", "b": "resolu", "d": "inconnu", "e": "inconnu"}
    assert "__known" not in done.columns


def test_maintenance_is_three_valued(spark):
    cols = [decisions.pre_guard(F.lit("x"), decisions.in_maintenance(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in ((True, None, True), (False, None, True), (None, None, False))]
    assert tuple(spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first()) == ("maintenance", None, "contexte_indisponible")


@pytest.mark.parametrize("processor", [processors.OncePerIncident(), processors.Guard()], ids=["once", "guard"])
def test_many_small_keys_need_no_frames(processor):
    """Processors with a key per user take rows and give rows; the state goes on from batch to batch."""

    class State:
        held = None

        def get(self):
            return self.held

        def exists(self):
            return self.held is not None

        def update(self, value):
            self.held = value

    processor.document = State()
    made = Row("t", "row_id", "incident", "action_key", "code")
    batches = [[made(9, 2, "i", "a", None), made(5, 1, "i", "a", 0)], [made(86_405, 4, "i", "b", 3), made(100, 3, "i", "b", None)]]
    out = [r for b in batches for r in processor.handleInputRows(("k",), iter(b), None)]
    assert all(isinstance(r, Row) for r in out)
    if isinstance(processor, processors.Guard):
        assert [(r.t, r.row_id, r.decision) for r in out] == [(5, 1, "executee"), (9, 2, "pause"), (100, 3, "simulee"), (86_405, 4, "escalade")]
    else:
        assert [tuple(r) for r in out] == [("k", 5, 1), ("k", 86_405, 4)]
