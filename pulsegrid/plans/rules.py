"""The alert rules over a metrics table, evaluated on a tick grid with hold times, inhibition and grouping.

``metrics`` is (name, labels MAP, t, value) aligned on the evaluation ticks. A rule expression returns the rows for
which it holds; :func:`evaluate` adds the hold time. ``reads`` names the metrics of a rule: store the table partitioned by name and
only those partitions are scanned.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.functions import labels as L
from pulsegrid.operators import detect, series, vector


GROUP = ["route", "alertname", "node", "job"]


class Grid(NamedTuple):
    """Evaluation ticks: step in seconds and, when known, the first and last tick.

    Give the range when a metric may be missing altogether: an absent metric has no sample to take it from. The counter
    windows (processor rates, ineffective actions) are in seconds and hold at least two samples of the table.
    """

    step: int
    start: int | None = None
    end: int | None = None
    rate_window: int = 120
    check_window: int = 900


class Rule(NamedTuple):
    name: str
    hold: int
    severity: str
    source: str
    expr: Callable[[DataFrame, Grid], DataFrame]
    summary: str
    reads: tuple[str, ...]


def pick(metrics: DataFrame, name: str, *matchers: tuple[str, str, str]) -> DataFrame:
    """Vector of one metric: t, labels, value."""
    return metrics.where((F.col("name") == name) & L.select_labels(F.col("labels"), *matchers)).select("t", "labels", "value")


def _keyed(v: DataFrame, *names: str) -> DataFrame:
    """Promote labels to columns, as join and grouping keys."""
    return v.select("*", *[L.label(F.col("labels"), n).alias(n) for n in names])


def _keep(v: DataFrame) -> DataFrame:
    return v.select("t", "labels", "value")


def _ticks(metrics: DataFrame, grid: Grid) -> DataFrame:
    """Evaluation ticks: the given range, else from the first to the last sample of the table."""
    if grid.start is not None and grid.end is not None:
        return metrics.sparkSession.range(grid.start, grid.end + 1, grid.step).select(F.col("id").alias("t"))
    span = metrics.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b", F.lit(grid.step).cast("long"))).alias("t"))


def _is(op: str, x, name: str, *matchers) -> Callable[[DataFrame, Grid], DataFrame]:
    return lambda m, grid: vector.compare(pick(m, name, *matchers), op, x)


def _per_series_ratio(m: DataFrame, part: str, whole: str, *matchers) -> DataFrame:
    left = pick(m, part, *matchers).withColumn("__k", L.render_labels(F.col("labels")))
    right = pick(m, whole, *matchers).select("t", L.render_labels(F.col("labels")).alias("__k"), F.col("value").alias("__w"))
    return left.join(right, ["t", "__k"]).select("t", "labels", ((1 - F.col("value") / F.col("__w")) * 100).alias("value"))


def _cpu(m: DataFrame, grid: Grid) -> DataFrame:
    idle = pick(m, "node_cpu_seconds_total", ("mode", "=", "idle")).withColumn("__s", L.render_labels(F.col("labels")))
    rates = series.counter_increase(idle, ["__s"], grid.rate_window, "rate", per_second=True).where("rate is not null")
    busy = _keyed(rates, "node").groupBy("t", "node").agg((100 - F.avg("rate") * 100).alias("value"))
    return vector.compare(busy, ">", 80).select("t", F.create_map(F.lit("node"), "node").alias("labels"), "value")


def _applications(m: DataFrame) -> DataFrame:
    return _keyed(pick(m, "aiops_target_info", ("kind", "=", "application")), "node", "application")


def _node_anomaly(m: DataFrame, grid: Grid) -> DataFrame:
    active = _keyed(vector.compare(pick(m, "aiops_anomaly_active"), "==", 1), "node")
    return _keep(vector.unless(active, _applications(m), ["t", "node"]))


def _app_anomaly(m: DataFrame, grid: Grid) -> DataFrame:
    active = _keyed(vector.compare(pick(m, "aiops_anomaly_active"), "==", 1), "node")
    joined = vector.many_to_one(active, _applications(m), ["t", "node"], ["application"])
    return joined.select("t", L.with_label(F.col("labels"), "application", F.col("application")).alias("labels"), "value")


def _disk_forecast(m: DataFrame, grid: Grid) -> DataFrame:
    soon = _keyed(vector.compare(pick(m, "aiops_forecast_hours_to_saturation", ("resource", "=", "disk")), "<", 24), "node")
    sure = _keyed(vector.compare(pick(m, "aiops_forecast_reliable", ("resource", "=", "disk")), "==", 1), "node")
    return _keep(vector.and_on(soon, sure, ["t", "node"]))


def _down_or_absent(job: str) -> Callable[[DataFrame, Grid], DataFrame]:
    def expr(m: DataFrame, grid: Grid) -> DataFrame:
        up = pick(m, "up", ("job", "=", job))
        gone = vector.absent(_ticks(m, grid), up, ["t"], {}).select("t", F.create_map(F.lit("job"), F.lit(job)).alias("labels"), "value")
        return vector.compare(up, "==", 0).unionByName(gone)

    return expr


def _file_stale(pattern: str, seconds: int) -> Callable[[DataFrame, Grid], DataFrame]:
    def expr(m: DataFrame, grid: Grid) -> DataFrame:
        files = pick(m, "node_textfile_mtime_seconds", ("file", "=~", pattern))
        age = files.withColumn("value", F.col("t") - F.col("value"))
        gone = vector.absent(_ticks(m, grid), files, ["t"], {}).select("t", F.create_map().cast("map<string,string>").alias("labels"), "value")
        return vector.compare(age, ">", seconds).unionByName(gone)

    return expr


def _expires(seconds: int, *matchers) -> Callable[[DataFrame, Grid], DataFrame]:
    return lambda m, grid: vector.compare(
        pick(m, "probe_ssl_earliest_cert_expiry", *matchers).withColumn("value", F.col("value") - F.col("t")), "<", seconds
    )


def _overdue(name: str, seconds: int) -> Callable[[DataFrame, Grid], DataFrame]:
    """Older than allowed, for timestamps that were ever set; the value stays the timestamp."""
    return lambda m, grid: pick(m, name).where((F.col("value") > 0) & (F.col("t") - F.col("value") > seconds))


def _recent_action(m: DataFrame, grid: Grid) -> DataFrame:
    last = pick(m, "pfe_agent_last_action_timestamp_seconds", ("outcome", "!=", "simulee"))
    return vector.compare(last.withColumn("value", F.col("t") - F.col("value")), "<", 900)


def _ineffective(m: DataFrame, grid: Grid) -> DataFrame:
    checks = pick(m, "pfe_agent_verifications_total", ("result", "=", "persistant")).withColumn("__s", L.render_labels(F.col("labels")))
    grown = series.counter_increase(checks, ["__s"], grid.check_window, "inc").where("inc is not null")
    return vector.compare(grown.withColumn("value", F.col("inc")), ">", 0).select("t", "labels", "value")


def _never_backed_up(m: DataFrame, grid: Grid) -> DataFrame:
    local = vector.compare(pick(m, "pfe_backup_last_success_timestamp_seconds"), "==", 0).withColumn("__k", L.render_labels(F.col("labels")))
    remote = vector.compare(pick(m, "pfe_backup_offsite_last_success_timestamp_seconds"), "==", 0).withColumn("__k", L.render_labels(F.col("labels")))
    return _keep(vector.or_on(local, remote, ["t", "__k"]))


_ROOT = (("mountpoint", "=", "/"), ("fstype", "=", "ext4"))
_NOT_AN_ADDRESS = ("instance", "!~", r"https://[0-9.]+(:[0-9]+)?/.*")
_MIN, _HOUR, _DAY = 60, 3600, 86400

# Rule names, hold times, severities, sources, metric names, label values and limits.
RULES: tuple[Rule, ...] = (
    Rule("NoeudInjoignable", 2 * _MIN, "critical", "", _is("==", 0, "up", ("job", "=", "node-exporter")), "Node {node} cannot be read", ("up",)),
    Rule("CpuEleve", 2 * _MIN, "warning", "", _cpu, "CPU at {value} % on {node}", ("node_cpu_seconds_total",)),
    Rule("RamElevee", 2 * _MIN, "warning", "",
         lambda m, grid: vector.compare(_per_series_ratio(m, "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes"), ">", 85), "Memory at {value} % on {node}", ("node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes")),
    Rule("DisquePlein", 5 * _MIN, "warning", "",
         lambda m, grid: vector.compare(_per_series_ratio(m, "node_filesystem_avail_bytes", "node_filesystem_size_bytes", *_ROOT), ">", 85), "Disk at {value} % on {node}", ("node_filesystem_avail_bytes", "node_filesystem_size_bytes")),
    Rule("AnomalieAIOps", _MIN, "warning", "", _node_anomaly, "Anomaly on node {node}", ("aiops_anomaly_active", "aiops_target_info")),
    Rule("AnomalieApplication", _MIN, "warning", "", _app_anomaly, "Anomaly on application {application}", ("aiops_anomaly_active", "aiops_target_info")),
    Rule("DisquePleinPrevu", 10 * _MIN, "warning", "", _disk_forecast, "Disk full in {value} h on {node} (reliable trend)", ("aiops_forecast_hours_to_saturation", "aiops_forecast_reliable")),
    Rule("AIOpsAveugle", 5 * _MIN, "warning", "", _is("==", 0, "aiops_data_quality"), "No trustworthy data for {node}", ("aiops_data_quality",)),
    Rule("MoteurAIOpsArrete", 2 * _MIN, "critical", "", _down_or_absent("aiops-engine"), "The detection engine does not answer", ("up",)),
    Rule("ServiceInjoignable", 3 * _MIN, "warning", "", _is("==", 0, "probe_success", ("job", "=", "services"), ("hors_build", "=", "non")), "{service} does not answer ({instance})", ("probe_success",)),
    Rule("ApplicationHorsLigne", 2 * _MIN, "critical", "", _is("==", 0, "probe_success", ("job", "=", "applications")), "Application {application} does not answer ({instance})", ("probe_success",)),
    Rule("CertificatBientotExpire", _HOUR, "warning", "deploiement", _expires(14 * _DAY, ("job", "=", "applications")), "Certificate of {application} expires within 14 days", ("probe_ssl_earliest_cert_expiry",)),
    Rule("CertificatPlateformeBientotExpire", _HOUR, "warning", "deploiement", _expires(14 * _DAY, ("job", "=", "services"), _NOT_AN_ADDRESS), "Certificate of {service} expires within 14 days", ("probe_ssl_earliest_cert_expiry",)),
    Rule("ServeurVideDetecte", 0, "info", "parc", _is("==", 1, "pfe_parc_serveur", ("etat", "=", "vide"), ("inventaire", "=", "")), "Empty server available: {adresse}", ("pfe_parc_serveur",)),
    Rule("DecouverteParcEnRetard", 30 * _MIN, "warning", "parc", _file_stale(r".*pfe_parc.prom", 3 * _HOUR), "No discovery for more than 3 h", ("node_textfile_mtime_seconds",)),
    Rule("SynchronisationEchouee", 15 * _MIN, "warning", "parc", _is("==", 0, "pfe_sync_statut"), "Synchronisation has failed for 15 minutes", ("pfe_sync_statut",)),
    Rule("ApplicationArgoCDDegradee", 15 * _MIN, "warning", "deploiement", _is("<", 1, "pfe_argocd_app"), "{application}: {sync} / {sante} for 15 minutes", ("pfe_argocd_app",)),
    Rule("EtatClusterMuet", 10 * _MIN, "warning", "deploiement", _file_stale(r".*pfe_etat_cluster.prom", 600), "Cluster state not read for 10 minutes", ("node_textfile_mtime_seconds",)),
    Rule("CollecteurArrete", 2 * _MIN, "warning", "", _is("==", 0, "up", ("job", "=~", "cadvisor|cadvisor-k3s")), "Collector {job} silent on {node}", ("up",)),
    Rule("ActionAutomatique", 0, "warning", "agent", _recent_action, "Action {action} executed on {node}: {outcome}", ("pfe_agent_last_action_timestamp_seconds",)),
    Rule("ActionAutomatiqueSansEffet", 0, "warning", "agent", _ineffective, "Action {action} did not clear its alert", ("pfe_agent_verifications_total",)),
    Rule("AgentRemediationArrete", 3 * _MIN, "critical", "agent", _down_or_absent("remediation-agent"), "The decision agent does not answer", ("up",)),
    Rule("AgentRemediationSuspendu", 0, "critical", "agent", _is("==", 1, "pfe_agent_suspended"), "The decision agent has suspended itself", ("pfe_agent_suspended",)),
    Rule("AgentNoeudInaccessible", 10 * _MIN, "warning", "agent", _is("==", 0, "pfe_agent_node_reachable"), "The decision agent cannot reach {node}", ("pfe_agent_node_reachable",)),
    Rule("SauvegardeEchouee", 0, "warning", "backup", _is("==", 0, "pfe_backup_last_status"), "Last backup of {node} failed", ("pfe_backup_last_status",)),
    Rule("SauvegardeEnRetard", 30 * _MIN, "warning", "backup", _overdue("pfe_backup_last_success_timestamp_seconds", 26 * _HOUR), "No backup of {node} for 26 h", ("pfe_backup_last_success_timestamp_seconds",)),
    Rule("CopieDistanteEnRetard", 30 * _MIN, "warning", "backup", _overdue("pfe_backup_offsite_last_success_timestamp_seconds", 26 * _HOUR), "No remote copy of {node} for 26 h", ("pfe_backup_offsite_last_success_timestamp_seconds",)),
    Rule("SauvegardeJamaisReussie", 30 * _HOUR, "warning", "backup", _never_backed_up, "No complete backup of {node} yet", ("pfe_backup_last_success_timestamp_seconds", "pfe_backup_offsite_last_success_timestamp_seconds")),
    Rule("SauvegardeRecueCorrompue", 0, "critical", "backup", _is("==", 0, "pfe_backup_received_valid"), "Latest set of {source} on {node} is corrupted", ("pfe_backup_received_valid",)),
    Rule("SauvegardeApplicationEchouee", 0, "warning", "backup", _is("==", 0, "pfe_backup_app_status"), "Database of {application} was not saved", ("pfe_backup_app_status",)),
    Rule("TestRestaurationEchoue", 0, "critical", "backup", _is("==", 0, "pfe_backup_restore_test_status"), "Restore test of {node} failed", ("pfe_backup_restore_test_status",)),
    Rule("TestRestaurationEnRetard", 0, "warning", "backup", _overdue("pfe_backup_restore_test_last_success_timestamp_seconds", 8 * _DAY), "No successful restore test of {node} for 8 days", ("pfe_backup_restore_test_last_success_timestamp_seconds",)),
)
BY_NAME = {r.name: r for r in RULES}


def align(samples: DataFrame, step: int, lookback: int = 300) -> DataFrame:
    """Samples of every series carried onto the evaluation ticks, up to the lookback."""
    keyed = samples.withColumn("__s", L.render_labels(F.col("labels")))
    # one more tick range at the end, so a series that stops is seen to go stale
    span = keyed.groupBy("name", "__s").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    first, last = F.ceil(F.col("a") / step) * step, F.floor((F.col("b") + lookback) / step) * step
    ticks = span.select("name", "__s", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("t"))
    on_grid = series.asof(ticks, keyed.select("name", "__s", "t", "labels", "value"), ["name", "__s"], ["labels", "value"], lookback)
    return on_grid.where("value is not null").select("name", "labels", "t", "value")


def evaluate(rule: Rule, metrics: DataFrame, grid: Grid) -> DataFrame:
    """Alert states over time: alertname, severity, source, labels, series, t, value, active_since, state."""
    rows = rule.expr(metrics, grid).withColumn("series", L.render_labels(F.col("labels")))
    held = detect.hold_for(rows, ["series"], rule.hold, grid.step)
    return held.select(
        F.lit(rule.name).alias("alertname"), F.lit(rule.severity).alias("severity"), F.lit(rule.source).alias("source"),
        "labels", "series", "t", "value", "active_since", "state",
        L.annotate(rule.summary, F.col("labels"), F.col("value")).alias("summary"),
    )


def evaluate_all(metrics: DataFrame, grid: Grid, rules=RULES) -> DataFrame:
    out = None
    for rule in rules:
        part = evaluate(rule, metrics, grid)
        out = part if out is None else out.unionByName(part)
    return out


def inhibit(alerts: DataFrame) -> DataFrame:
    """An unreachable node masks the warning and critical alerts of the same node at the same tick."""
    rows = alerts.withColumn("__node", L.label(F.col("labels"), "node"))
    down = rows.where((F.col("alertname") == "NoeudInjoignable") & (F.col("state") == "firing")).select("t", "__node").distinct()
    masked = F.col("severity").isin("warning", "critical") & (F.col("alertname") != "NoeudInjoignable")
    kept = rows.where(masked).join(down, ["t", "__node"], "left_anti")
    return rows.where(~masked).unionByName(kept).drop("__node")


def routed(firing: DataFrame, routes=V.ROUTES) -> DataFrame:
    """Firing alerts (alertname, severity, node, job, t, series) under every route that takes them.

    Adds ``route``; a label the route doesn't group by is empty.
    """
    out = None
    for name, *_, group, left_out in routes:
        taken = firing.where(~F.col("severity").isin(*left_out)) if left_out else firing
        labels = [(F.coalesce(c, F.lit("")) if c in group else F.lit("")).alias(c) for c in ("alertname", "node", "job")]
        part = taken.select(F.lit(name).alias("route"), *labels, "t", "series")
        out = part if out is None else out.unionByName(part)
    return out


def group_states(alerts: DataFrame, step: int, end: DataFrame) -> DataFrame:
    """Members of every alert group at the ticks where it fires, and at the two ticks after, up to the tick ``end``.

    The further ticks carry the news that a group went quiet. ``end`` is a table of one value, the last tick evaluated.
    """
    shifted = alerts.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("__k"))
    at = shifted.withColumns({"t": F.col("t") + F.col("__k") * step, "series": F.when(F.col("__k") == 0, F.col("series"))})
    members = F.sort_array(F.collect_set("series")).alias("members")
    return at.where(F.col("t") <= end.scalar()).groupBy(*GROUP, "t").agg(members)


def top_feature_text(metrics: DataFrame) -> DataFrame:
    """Diagnosis shown with an anomaly: (t, node, feature, z)."""
    feature = _keyed(vector.compare(pick(metrics, "aiops_top_feature"), "==", 1), "node", "feature")
    z = _keyed(pick(metrics, "aiops_top_feature_zscore"), "node")
    return feature.select("t", "node", "feature").join(z.select("t", "node", F.col("value").alias("z")), ["t", "node"], "left")

