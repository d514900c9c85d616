"""Sources and sinks, read back from files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid import vocabulary as V
from pulsegrid.functions import inventory
from pulsegrid.operators import audit
from pulsegrid.sources import exposition, logs


def test_exposition_round_trip(spark, tmp_path):
    odd = 'quote " slash \\ line\nend \\n ' + "x" * 30_000
    rows = [("m_total", {"a": odd, "b": ""}, 1791854504.779), ("m_total", {}, 1e-4), ("up", {"node": "n"}, 0.0), ("up", {"node": "big"}, 3.0e15)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, value double")
    help_text = spark.createDataFrame([("up", "gauge", "Reachable")], "name string, kind string, text string")
    path = str(tmp_path / "out")
    exposition.write(exposition.render(df, help_text), path)
    text = [r.value for r in spark.read.text(path).collect()]
    assert "m_total 0.0001" in text and 'up{node="big"} 3000000000000000.0' in text and "# HELP up Reachable" in text
    assert any(line.endswith("} 1791854504.779") for line in text)
    back = {(r.name, json.dumps(r.labels, sort_keys=True)): r.value for r in exposition.read(spark, path).collect()}
    assert back == {(n, json.dumps(lab, sort_keys=True)): v for n, lab, v in rows}


def test_injections_with_optional_fields(spark, tmp_path):
    full = {"numero": 1, "scenario": "cpu_api", "noeud": "a", "t0": 0.5, "t_fin_panne": 9.0, "detections": {"ia": 61.0}, "variables_attendues": ["x"], "ia_attendue": True,
            "action_attendue": "aucune", "agent": [{"t": 1.0, "type": "decision", "action": "aucune", "decision": "aucune_action"}]}
    (tmp_path / "i.jsonl").write_text(json.dumps(full) + "\n\n" + json.dumps({"numero": 2, "interrompue": True, "detections": {}}) + "\n")
    got = {r.numero: r for r in logs.read_injections(spark, str(tmp_path / "i.jsonl")).collect()}
    assert got[1].detections == {"ia": 61.0} and got[1].agent[0].action == "aucune" and got[2].interrompue and got[2].detections == {}


def test_manifest_over_real_files(spark, tmp_path):
    for name, content in (("a.dump", b"one"), ("b.dump", b"two")):
        (tmp_path / "20240102T030405Z").mkdir(exist_ok=True)
        (tmp_path / "20240102T030405Z" / name).write_bytes(content)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = [f"{digest(b'one')}  a.dump", f"{digest(b'changed')} *b.dump", f"{digest(b'x')}  gone.dump", "not a line"]
    manifest = logs.parse_manifest(spark.createDataFrame([("20240102T030405Z", v) for v in lines], "set_name string, value string"))
    checked = {r.name: r.state for r in audit.check_manifest(logs.read_files(spark, str(tmp_path)), manifest).collect()}
    assert checked == {"a.dump": "ok", "b.dump": "corrupted", "gone.dump": "missing"}


def test_detection_log_needs_enough_rows(spark):
    rows = lambda n: spark.createDataFrame([(str(i), "1.5" if i % 10 else "bad") for i in range(n)], "epoch string, zscore_max string")
    assert logs.valid_scores(rows(200)).count() == 180
    with pytest.raises(Exception, match="fewer than 100 valid rows"):
        logs.valid_scores(rows(100)).count()


def test_broken_sample_lines_are_errors(spark):
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in exposition.parse(text("# HELP x", 'a{b="c"} 1.5 1700000000000', "d +Inf")).collect()] == [("a", {"b": "c"}, 1.5), ("d", {}, float("inf"))]
    for line in ("no value", "a{b=} x", "a one"):
        with pytest.raises(Exception, match="not a sample line"):
            exposition.parse(text(line)).collect()


def test_journal_rows_and_last_actions(spark):
    d = spark.createDataFrame(
        [("2026-10-13T10:00:00+0000", "decision", "executee", "restart", "a", "0", "x\ny" + "z" * 600), ("2026-10-13T11:00:00+0000", "decision", "simulee", "restart", "a", "", ""),
         ("broken", "decision", "executee", "restart", "a", "9", "")],
        "horodatage string, type string, decision string, action string, noeud string, code string, detail string",
    )
    j = logs.journal_rows(d)
    assert j.columns == list(V.JOURNAL_FIELDS)
    top = j.first()
    assert len(top.detail) == 500 and top.detail.startswith("x y") and top.verification == ""
    got = {(r.outcome, r.t) for r in logs.last_actions(j).collect()}
    assert got == {("succes", 1791885600), ("simulee", 1791889200)}


def test_alert_stream(spark, tmp_path):
    payload = {"alerts": [{"status": "firing", "labels": {"alertname": "A"}, "fingerprint": "f", "startsAt": "s"}, {"status": "resolved", "labels": {"alertname": "B"}}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text(json.dumps(payload) + "\n")
    from pulsegrid.streaming import jobs

    rows = jobs.drain(logs.stream_alerts(spark, str(tmp_path / "in")), "alerts").collect()
    assert [(r.labels["alertname"], r.fingerprint) for r in rows] == [("A", "f")]


def test_detections_are_partitioned(spark, tmp_path):
    d = spark.createDataFrame(
        [("a", 1_700_000_000, 0.123456, 0.2, False, 1.23456, 1.1, True, True, "cpu", 3.14159, [1.0])],
        "target string, t long, score double, if_smoothed double, if_effective boolean, z_max double, z_smoothed double, z_active boolean, active boolean, top_feature string, top_z double, x array<double>",
    )
    logs.write_detections(d, str(tmp_path / "log"))
    r = spark.read.parquet(str(tmp_path / "log")).where("target = 'a' and date = '2023-11-14'").first()
    assert (r.iforest_score, r.zscore_max, r.top_z, r.anomaly_active) == (0.12346, 1.2346, 3.142, 1)


def server(**own):
    """A roomy machine with nothing on it, and what a case changes."""
    base = {"systeme": "debian 12", "ram_mo": 16_384, "disque_libre_go": 250, "sudo": True, "cpu": 8, "nom_hote": "rack-9", "services_ecoute": "22"}
    flags = dict.fromkeys(("docker", "k3s_serveur", "k3s_agent", "pfe_runbook"), False)
    return json.dumps(base | flags | {"conteneurs": "", "k3s_version": ""} | own)


@pytest.mark.parametrize(
    "change, state",
    [({"disque_libre_go": 19}, "incompatible"), ({"ram_mo": 4095}, "incompatible"), ({"systeme": "fedora 41"}, "incompatible"), ({"sudo": False, "docker": True}, "incompatible"),
     ({"services_ecoute": "22 443 5432"}, "occupe"), ({"docker": True, "conteneurs": "wiki cache"}, "occupe"), ({"docker": True}, "vide"), ({}, "vide"),
     ({"k3s_agent": True, "ram_mo": 8192}, "applicatif"), ({"k3s_serveur": True}, "controle")],
)
def test_server_states(spark, change, state):
    row = spark.createDataFrame([(server(**change),)], "j string").select(F.from_json("j", schemas.PROBE).alias("p"))
    name, reason = inventory.classify(F.col("p"), ["debian 12"], 4096, 20)
    r = row.select(name.alias("s"), reason.alias("r")).first()
    assert r.s == state
    if "services_ecoute" in change:
        assert r.r == "listening ports: 443, 5432"


def test_retention_against_brute_force(spark):
    import datetime as dt
    import random

    rnd = random.Random(2)
    rows, kept = [], set()
    now = 1_700_000_000
    for source in ("a", "b", "c", "none"):
        days = sorted(rnd.sample(range(120), 60), reverse=True)
        sets = [(source, now - 3600 - (119 - d) * 86400, source != "none" and rnd.random() < 0.7) for d in days]
        rows += sets
        daily = weekly = 0
        last = None
        for s in sets:
            week = dt.datetime.fromtimestamp(s[1], dt.timezone.utc).isocalendar()[:2]
            if not s[2]:
                if now - s[1] < 86400:
                    kept.add(s[:2])
            elif daily < 7:
                daily, last = daily + 1, week
                kept.add(s[:2])
            elif weekly < 4 and week != last:
                weekly, last = weekly + 1, week
                kept.add(s[:2])
        if daily == 0:
            kept |= {s[:2] for s in sets}
    df = spark.createDataFrame(rows, "source string, epoch long, complete boolean")
    got = {(r.source, r.epoch) for r in audit.retention(df, ["source"], "epoch", "complete", now).where("keep").collect()}
    assert got == kept
