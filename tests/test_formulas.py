"""Metric series to features: ticks against brute force, every formula by hand."""

import random

from pulsegrid import vocabulary as V
from pulsegrid.operators import features, formulas

SAMPLES = "name string, labels map<string,string>, t long, value double"


def expected(points, t, reach, lookback):
    """(sample time, value, rate) of one series at a tick, from its definition."""
    fresh = [p for p in points if t - lookback < p[0] <= t]
    inside = [p for p in points if t - reach < p[0] <= t]
    grown = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
    return fresh and (*fresh[-1], grown / (inside[-1][0] - inside[0][0]) if len(inside) > 1 else None)


def test_ticks_against_brute_force(spark):
    rng = random.Random(5)
    lines = {}
    for cpu in range(4):
        t, value, points = rng.randrange(50), 0.0, []
        for _ in range(150):
            t += rng.choice([1, 7, 15, 15, 15, 40, 119, 120, 299, 300, 700])
            value = rng.random() if rng.random() < 0.1 else value + rng.random() * 20
            points.append((t, value))
        lines[str(cpu)] = points
    rows = [("node_cpu_seconds_total", {"cpu": c, "mode": "idle"}, t, v) for c, points in lines.items() for t, v in points]
    df = spark.createDataFrame(rows + [("unread", {}, 5, 1.0)], SAMPLES).repartition(5)
    for width in (300, 6 * 3600):  # blocks as short as the lookback, and one block
        got = {(r["labels"]["cpu"], r["t"]): (r["at"], r["value"], r["rate"]) for r in formulas.on_ticks(df, 15, width=width).collect()}
        want = {(c, t): e for c, points in lines.items() for t in range(0, points[-1][0] + 400, 15) if (e := expected(points, t, 120, 300))}
        assert got.keys() == want.keys()
        for k, (at, value, rate) in got.items():
            assert (at, value, rate is None) == (*want[k][:2], want[k][2] is None)
            assert rate is None or abs(rate - want[k][2]) < 1e-9


def pod(node, space, box, **more):
    return {"job": "cadvisor-k3s", "node": node, "container_label_io_kubernetes_pod_namespace": space, "container_label_io_kubernetes_container_name": box, **more}


def fleet(spark):
    mib = 1024.0 * 1024.0
    at0 = [
        ("node_memory_MemAvailable_bytes", {"node": "a"}, 25.0), ("node_memory_MemTotal_bytes", {"node": "a"}, 100.0),
        ("node_filesystem_avail_bytes", {"node": "a", "mountpoint": "/", "fstype": "ext4"}, 40.0), ("node_filesystem_size_bytes", {"node": "a", "mountpoint": "/", "fstype": "ext4"}, 200.0),
        ("node_filesystem_avail_bytes", {"node": "a", "mountpoint": "/data", "fstype": "ext4"}, 1.0),
        ("container_memory_working_set_bytes", pod("a", "default", "server", pod="1"), 10 * mib), ("container_memory_working_set_bytes", pod("a", "default", "server", pod="2"), 5 * mib),
        ("container_memory_working_set_bytes", pod("a", "default", "POD"), 9 * mib), ("container_memory_working_set_bytes", pod("a", "default", ""), 9 * mib),
        ("container_memory_working_set_bytes", pod("a", "shop", "api"), 7 * mib), ("container_memory_working_set_bytes", pod("b", "shop", "api"), 4 * mib),
        ("container_memory_working_set_bytes", pod("b", "shop", "postgres"), 3 * mib),
        ("container_memory_working_set_bytes", {**pod("b", "shop", "api", pod="other"), "job": "cadvisor"}, 100 * mib),
        ("probe_success", {"job": "applications", "application": "shop", "instance": "x"}, 1.0), ("probe_success", {"job": "applications", "application": "shop", "instance": "y"}, 0.0),
        ("probe_duration_seconds", {"job": "applications", "application": "shop"}, 0.25), ("probe_success", {"job": "services", "application": "shop"}, 0.0),
        ("node_memory_MemAvailable_bytes", {"node": "b"}, 50.0), ("node_memory_MemTotal_bytes", {"node": "b"}, 0.0), ("node_memory_MemAvailable_bytes", {}, 50.0),
    ]
    counters = [
        ("node_cpu_seconds_total", {"node": "a", "cpu": "0", "mode": "idle"}, 3.0), ("node_cpu_seconds_total", {"node": "a", "cpu": "1", "mode": "idle"}, 9.0), ("node_cpu_seconds_total", {"node": "a", "cpu": "1", "mode": "user"}, 99.0),
        ("node_network_receive_bytes_total", {"node": "a", "device": "eth0"}, 15360.0), ("node_network_receive_bytes_total", {"node": "a", "device": "eth1"}, 15360.0),
        *[("node_network_receive_bytes_total", {"node": "a", "device": d}, 1e9) for d in ("lo", "veth12", "docker0", "br-1", "cni0", "flannel.1")],
        ("container_cpu_usage_seconds_total", pod("a", "default", "server"), 3.0), ("container_cpu_usage_seconds_total", pod("b", "shop", "api"), 30.0),
    ]
    rows = [(n, labels, 0, v) for n, labels, v in at0] + [(n, labels, t, v * t / 15) for n, labels, v in counters for t in (0, 15)]
    return spark.createDataFrame(rows, SAMPLES)


def test_formulas(spark):
    spec = features.spec_table(spark, {"a": ("node", features.node_spec(True)), "b": ("node", features.node_spec(False)), "appli-shop": ("application", features.application_spec(["api", "site"], base=True))})
    out = formulas.features_of(fleet(spark), spec, 15).where("t = 15").collect()
    got = {(r["target"], r["feature"]): r["value"] for r in out}
    assert sorted((r["target"], r["ord"]) for r in out) == [("a", i) for i in range(8)] + [("appli-shop", i) for i in range(8)] + [("b", i) for i in range(4)]
    want = {
        "a": {"cpu_host": 60.0, "ram_host": 75.0, "disk_host": 80.0, "net_rx_kb": 2.0, "cpu_server": 20.0, "ram_server_mb": 15.0, "ram_postgres_mb": 0.0, "app_containers": 1.0},
        "b": {"cpu_host": None, "ram_host": None, "disk_host": None, "net_rx_kb": None},
        "appli-shop": {"cpu_api": 200.0, "ram_api_mb": 11.0, "cpu_site": 0.0, "ram_site_mb": 0.0, "ram_base_mb": 3.0, "app_containers": 2.0, "web_ok": 0.0, "web_ms": 250.0},
    }
    assert got.keys() == {(target, f) for target, values in want.items() for f in values}
    for (target, f), value in got.items():
        assert value is None if want[target][f] is None else abs(value - want[target][f]) < 1e-9, (target, f, value)
    assert formulas.features_of(fleet(spark).limit(0), spec, 15).count() == 0
    assert set(formulas.MEASURED) == {f[0] for f in V.HOST_FEATURES} | {"web_ok", "web_ms"}


def test_source_ages(spark):
    targets = spark.createDataFrame([("a", "node"), ("b", "node"), ("appli-shop", "application"), ("appli-mail", "application")], "target string, kind string")
    ages = formulas.source_ages(formulas.on_ticks(fleet(spark), 15), targets).where("t = 45")
    assert sorted((r["target"], r["source"], r["age"]) for r in ages.collect()) == [
        ("a", "cadvisor-k3s", 45), ("a", "node-exporter", 45), ("appli-mail", "cadvisor-k3s", 45), ("appli-shop", "cadvisor-k3s", 45), ("appli-shop", "sonde-web", 45),
        ("b", "cadvisor-k3s", 45), ("b", "node-exporter", 45),
    ]
