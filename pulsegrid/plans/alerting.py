"""Queries: alert rules (R), decision policy (D), boards (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import labels as L
from pulsegrid.operators import audit, decisions, vector
from pulsegrid.plans import rules as R
from pulsegrid.plans import tables as T
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import COUNTER, EV, HOURLY, read
from pulsegrid.session import cut
from pulsegrid.streaming import jobs, processors

HOUR = 3600


COUNTERS = ("node_cpu_seconds_total", "pfe_agent_verifications_total")


def metrics(spark, sf, names):
    """The hourly matrix and the event counters read as the named metrics of the alert rules, one tick per hour."""
    m = T.hourly(spark, sf)
    if set(names) & set(COUNTERS):
        m = m.join(T.counters(spark, sf).withColumnRenamed("value", "counter"), ["target", "t"])
    node, t = F.col("target"), F.col("t")
    click, error, purchase, signup, view = (F.col(f) for f in T.FEATURES)
    flag = lambda c: c.cast("double")
    app = F.replace("target", F.lit("node"), F.lit("shop"))
    url = F.when(node == "node-0", F.lit("https://10.0.0.1:32252/")).otherwise(F.concat(F.lit("https://"), node, F.lit(".example.com/")))

    def sample(name, value, when=None, **labels):
        if name not in names:
            return None
        pairs = [x for k, v in labels.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))]
        row = F.struct(F.lit(name).alias("name"), F.create_map(*pairs).cast("map<string,string>").alias("labels"), value.cast("double").alias("value"))
        return row if when is None else F.when(when, row)

    root = {"mountpoint": "/", "fstype": "ext4", "node": node}
    samples = [
        sample("up", flag(error <= 2), job="node-exporter", node=node),
        sample("up", flag(view > 0), (node == "node-0") & (click > 0), job="aiops-engine"),
        sample("up", flag(signup > 0), (node == "node-1") & (view > 0), job="remediation-agent"),
        sample("up", flag(purchase > 0), job="cadvisor", node=node),
        sample("node_cpu_seconds_total", F.col("counter") * 360, mode="idle", node=node, cpu="0"),
        sample("node_memory_MemAvailable_bytes", view * 10 + 5, node=node),
        sample("node_memory_MemTotal_bytes", F.lit(100.0), node=node),
        sample("node_filesystem_avail_bytes", click * 10 + 4, **root),
        sample("node_filesystem_size_bytes", F.lit(100.0), **root),
        sample("aiops_anomaly_active", flag(error > 0), node=node),
        sample("aiops_target_info", F.lit(1.0), node=node, kind=F.when(node == "node-3", "application").otherwise("node"), application=F.when(node == "node-3", "shop").otherwise("")),
        sample("aiops_forecast_hours_to_saturation", purchase * 20, node=node, resource="disk"),
        sample("aiops_forecast_reliable", flag(signup > 0), node=node, resource="disk"),
        sample("aiops_data_quality", flag(view > 0), node=node),
        sample("probe_success", flag(click > 0), job="services", hors_build=F.when(node == "node-2", "oui").otherwise("non"), service=app, instance=url),
        sample("probe_success", flag(signup > 0), job="applications", application=app, instance=url),
        sample("probe_ssl_earliest_cert_expiry", t + click * 604800, job="applications", application=app, instance=url),
        sample("probe_ssl_earliest_cert_expiry", t + view * 604800, job="services", service=app, instance=url),
        sample("pfe_parc_serveur", F.lit(1.0), adresse=node, etat=F.when(purchase == 0, "vide").otherwise("occupe"), inventaire=F.when(node == "node-1", "known").otherwise("")),
        sample("node_textfile_mtime_seconds", t - error * 7200, (node == "node-2") & (view > 0), file="/host/pfe_parc.prom", node=node),
        sample("node_textfile_mtime_seconds", t - signup * 600, (node == "node-1") & (click > 0), file="/host/pfe_etat_cluster.prom", node=node),
        sample("pfe_sync_statut", flag(purchase > 0), node=node),
        sample("pfe_argocd_app", F.least(F.lit(1.0), signup * 0.5), application=app, nom=node),
        sample("pfe_agent_last_action_timestamp_seconds", t - click * 600, node=node, action="restart", outcome=F.when(node == "node-0", "simulee").otherwise("succes")),
        sample("pfe_agent_verifications_total", F.col("counter"), action=node, result=F.when(node == "node-3", "resolu").otherwise("persistant")),
        sample("pfe_agent_suspended", flag(view == 0), node=node),
        sample("pfe_agent_node_reachable", flag(click > 0), node=node),
        sample("pfe_backup_last_status", flag(error < 2), node=node),
        sample("pfe_backup_last_success_timestamp_seconds", F.when(node == "node-1", 0).otherwise(t - error * 72000), node=node),
        sample("pfe_backup_offsite_last_success_timestamp_seconds", F.when((node == "node-2") | (node == "node-1"), 0).otherwise(t - view * 72000), node=node),
        sample("pfe_backup_received_valid", flag(signup < 2), node=node, source="node-9"),
        sample("pfe_backup_app_status", flag(purchase > 0), application=app, node=node),
        sample("pfe_backup_restore_test_status", flag(error < 3), node=node),
        sample("pfe_backup_restore_test_last_success_timestamp_seconds", t - click * 345600, node=node),
    ]
    wanted = [x for x in samples if x is not None]
    return m.select("t", F.explode(F.array_compact(F.array(*wanted))).alias("s")).select("s.name", "s.labels", "t", "s.value")


_NODE = "'node=\"' || target || '\"'"
_APP = "replace(target, 'node', 'shop')"
_URL = "CASE WHEN target = 'node-0' THEN 'https://10.0.0.1:32252/' ELSE 'https://' || target || '.example.com/' END"
_ALL = "(SELECT unnest(generate_series(min(t), max(t), 3600)) AS t FROM m)"
_RATE = f"""(SELECT target, t, sum(d) OVER r - first_value(d) OVER r AS inc, t - first_value(t) OVER r AS el FROM
  (SELECT *, coalesce(CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END, 0) AS d FROM (SELECT target, t, value * {{scale}} AS value FROM c) WINDOW w AS (PARTITION BY target ORDER BY t))
  WINDOW r AS (PARTITION BY target ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW))"""


def _simple(condition: str, series: str = _NODE, value: str = "0", source: str = "m") -> str:
    return f"SELECT {series} AS series, t, ({value})::DOUBLE AS value FROM {source} WHERE {condition}"


# rows for which each rule expression holds, in SQL
_EXPR = {
    "NoeudInjoignable": _simple("error > 2", f"'job=\"node-exporter\",' || {_NODE}"),
    "CpuEleve": _simple("el > 0 AND 100 - inc / el * 100 > 80", value="100 - inc / el * 100", source=_RATE.format(scale=360)),
    "RamElevee": _simple("(1 - (view * 10 + 5) / 100) * 100 > 85", value="(1 - (view * 10 + 5) / 100) * 100"),
    "DisquePlein": _simple("(1 - (click * 10 + 4) / 100) * 100 > 85", "'fstype=\"ext4\",mountpoint=\"/\",' || " + _NODE, "(1 - (click * 10 + 4) / 100) * 100"),
    "AnomalieAIOps": _simple("error > 0 AND target <> 'node-3'", value="1"),
    "AnomalieApplication": _simple("error > 0 AND target = 'node-3'", "'application=\"shop\",' || " + _NODE, "1"),
    "DisquePleinPrevu": _simple("purchase * 20 < 24 AND signup > 0", _NODE + " || ',resource=\"disk\"'", "purchase * 20"),
    "AIOpsAveugle": _simple("view = 0"),
    "MoteurAIOpsArrete": _simple("target = 'node-0' AND click > 0 AND view = 0", "'job=\"aiops-engine\"'")
    + f" UNION ALL SELECT 'job=\"aiops-engine\"', t, 1.0 FROM {_ALL} WHERE t NOT IN (SELECT t FROM m WHERE target = 'node-0' AND click > 0)",
    "ServiceInjoignable": _simple("click = 0 AND target <> 'node-2'", f"'hors_build=\"non\",instance=\"' || {_URL} || '\",job=\"services\",service=\"' || {_APP} || '\"'"),
    "ApplicationHorsLigne": _simple("signup = 0", f"'application=\"' || {_APP} || '\",instance=\"' || {_URL} || '\",job=\"applications\"'"),
    "CertificatBientotExpire": _simple("click * 604800 < 1209600", f"'application=\"' || {_APP} || '\",instance=\"' || {_URL} || '\",job=\"applications\"'", "click * 604800"),
    "CertificatPlateformeBientotExpire": _simple("view * 604800 < 1209600 AND target <> 'node-0'", f"'instance=\"' || {_URL} || '\",job=\"services\",service=\"' || {_APP} || '\"'", "view * 604800"),
    "ServeurVideDetecte": _simple("purchase = 0 AND target <> 'node-1'", "'adresse=\"' || target || '\",etat=\"vide\",inventaire=\"\"'", "1"),
    "DecouverteParcEnRetard": _simple("target = 'node-2' AND view > 0 AND error * 7200 > 10800", "'file=\"/host/pfe_parc.prom\",' || " + _NODE, "error * 7200")
    + f" UNION ALL SELECT '', t, 1.0 FROM {_ALL} WHERE t NOT IN (SELECT t FROM m WHERE target = 'node-2' AND view > 0)",
    "SynchronisationEchouee": _simple("purchase = 0"),
    "ApplicationArgoCDDegradee": _simple("signup < 2", f"'application=\"' || {_APP} || '\",nom=\"' || target || '\"'", "least(1, signup * 0.5)"),
    "EtatClusterMuet": _simple("target = 'node-1' AND click > 0 AND signup * 600 > 600", "'file=\"/host/pfe_etat_cluster.prom\",' || " + _NODE, "signup * 600")
    + f" UNION ALL SELECT '', t, 1.0 FROM {_ALL} WHERE t NOT IN (SELECT t FROM m WHERE target = 'node-1' AND click > 0)",
    "CollecteurArrete": _simple("purchase = 0", "'job=\"cadvisor\",' || " + _NODE),
    "ActionAutomatique": _simple("click * 600 < 900 AND target <> 'node-0'", "'action=\"restart\",node=\"' || target || '\",outcome=\"succes\"'", "click * 600"),
    "ActionAutomatiqueSansEffet": _simple("el > 0 AND inc > 0 AND target <> 'node-3'", "'action=\"' || target || '\",result=\"persistant\"'", "inc", _RATE.format(scale=1)),
    "AgentRemediationArrete": _simple("target = 'node-1' AND view > 0 AND signup = 0", "'job=\"remediation-agent\"'")
    + f" UNION ALL SELECT 'job=\"remediation-agent\"', t, 1.0 FROM {_ALL} WHERE t NOT IN (SELECT t FROM m WHERE target = 'node-1' AND view > 0)",
    "AgentRemediationSuspendu": _simple("view = 0", value="1"),
    "AgentNoeudInaccessible": _simple("click = 0"),
    "SauvegardeEchouee": _simple("error >= 2"),
    "SauvegardeEnRetard": _simple("target <> 'node-1' AND error * 72000 > 93600", value="t - error * 72000"),
    "CopieDistanteEnRetard": _simple("target NOT IN ('node-1', 'node-2') AND view * 72000 > 93600", value="t - view * 72000"),
    "SauvegardeJamaisReussie": _simple("target IN ('node-1', 'node-2')"),
    "SauvegardeRecueCorrompue": _simple("signup >= 2", _NODE + " || ',source=\"node-9\"'"),
    "SauvegardeApplicationEchouee": _simple("purchase = 0", f"'application=\"' || {_APP} || '\",' || {_NODE}"),
    "TestRestaurationEchoue": _simple("error >= 3"),
    "TestRestaurationEnRetard": _simple("click * 345600 > 691200", value="t - click * 345600"),
}


def _held(name: str) -> str:
    rule = R.BY_NAME[name]
    return f"""rows_{name} AS ({_EXPR[name]}), isl_{name} AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY series ORDER BY t) AS g FROM rows_{name}),
  {name} AS (SELECT '{name}' AS alertname, '{rule.severity}' AS severity, series, t, value, min(t) OVER (PARTITION BY series, g) AS active_since,
    CASE WHEN t - min(t) OVER (PARTITION BY series, g) >= {rule.hold} THEN 'firing' ELSE 'pending' END AS state FROM isl_{name})"""


def _register(number: int, rule: R.Rule) -> None:
    @query(f"R{number}_{rule.name}", f"WITH {COUNTER}, {_held(rule.name)} SELECT series, t, round(value, 6) AS value, active_since, state FROM {rule.name}")
    def _(spark, sf):
        states = R.evaluate(rule, metrics(spark, sf, rule.reads), R.Grid(HOUR, rate_window=2 * HOUR + 1, check_window=2 * HOUR + 1))
        return states.select("series", "t", F.round("value", 6).alias("value"), "active_since", "state")


for _number, _rule in enumerate(R.RULES, 1):
    _register(_number, _rule)

_SHOWN = ("NoeudInjoignable", "RamElevee", "AnomalieAIOps", "ServeurVideDetecte", "SauvegardeEchouee")


@query("R33_inhibition", f"""WITH {COUNTER}, {", ".join(_held(n) for n in _SHOWN)}, a AS ({" UNION ALL ".join(f"SELECT * FROM {n}" for n in _SHOWN)}),
  k AS (SELECT *, regexp_extract(series, 'node="([^"]*)"', 1) AS node FROM a), down AS (SELECT DISTINCT t, node FROM k WHERE alertname = 'NoeudInjoignable' AND state = 'firing')
  SELECT alertname, series, t, state FROM k WHERE alertname = 'NoeudInjoignable' OR severity = 'info' OR (t, node) NOT IN (SELECT (t, node) FROM down)""")
def _(spark, sf):
    shown = [R.BY_NAME[n] for n in _SHOWN]
    alerts = R.evaluate_all(cut(metrics(spark, sf, {x for r in shown for x in r.reads})), R.Grid(HOUR), shown)
    return R.inhibit(alerts).select("alertname", "series", "t", "state")


_ROUTED = ("AnomalieAIOps", "ServeurVideDetecte", "CollecteurArrete")


def notified(spark, firing, end, name):
    """Firing alerts through both routes and the notification processor, as a stream over three steps of time."""
    states = R.group_states(R.routed(firing), HOUR, end)
    rows = jobs.replay(states, name, R.GROUP, slices=3)
    return jobs.drain(jobs.keyed(rows, R.GROUP, processors.Notifier(ttl=7 * 86400), "t", "2 hours"), name)


@query("R34_grouping_repeat", f"""WITH {COUNTER}, {", ".join(_held(n) for n in _ROUTED)}, a AS ({" UNION ALL ".join(f"SELECT * FROM {n}" for n in _ROUTED)}),
  f AS (SELECT *, regexp_extract(series, 'node="([^"]*)"', 1) AS node, regexp_extract(series, 'job="([^"]*)"', 1) AS job FROM a WHERE state = 'firing'),
  gs AS (SELECT 'mail' AS route, alertname, node, '' AS job, t, list_sort(list(DISTINCT series)) AS members FROM f WHERE severity <> 'info' GROUP BY ALL
    UNION ALL SELECT 'agent', alertname, node, job, t, list_sort(list(DISTINCT series)) FROM f GROUP BY ALL), {T.NOTIFIED}""")
def _(spark, sf):
    shown = [R.BY_NAME[n] for n in _ROUTED]
    samples = cut(metrics(spark, sf, {x for r in shown for x in r.reads}))
    alerts = R.evaluate_all(samples, R.Grid(HOUR), shown).where("state = 'firing'")
    firing = alerts.withColumns({n: L.label(F.col("labels"), n) for n in ("node", "job")})
    return notified(spark, firing, samples.agg(F.max("t")), "R34")


# ---------------------------------------------------------------- decisions
def fleet(spark):
    nodes = spark.createDataFrame(
        [("node-0", True, False, False, 0), ("node-1", True, False, True, 1), ("node-2", False, True, False, 2)], "name string, app boolean, monitoring boolean, k3s boolean, ord int"
    )
    apps = spark.createDataFrame([("shop-0", ["api", "site"]), ("shop-1", ["web"])], "application string, components array<string>")
    return nodes, apps


_NAMES = ("NoeudInjoignable", "CollecteurArrete", "MoteurAIOpsArrete", "RamElevee", "DisquePlein", "AnomalieAIOps", "CpuEleve")
_DIAGNOSES = ("cpu_server", "ram_server_mb", "ram_host", "net_rx_kb", "")
_APP_DIAGNOSES = ("cpu_api", "ram_site_mb", "ram_base_mb", "web_ok", "cpu_web", "")


def _pick(values, column):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))


def _sql_pick(values, expr):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{expr} + 1]"


_ALERTS_SQL = f"""al AS (SELECT event_id, {_sql_pick(_NAMES, 'event_id % 7')} AS alertname, target AS node, CASE WHEN event_id % 3 = 0 THEN 'jenkins' WHEN event_id % 3 = 1 THEN 'cadvisor' ELSE 'cadvisor-k3s' END AS job,
    CASE WHEN user_id % 13 = 0 THEN 'agent' ELSE '' END AS source, nullif({_sql_pick(_DIAGNOSES, 'user_id % 5')}, '') AS feature, CASE WHEN event_id % 4 = 0 THEN -value ELSE value END AS z FROM ev)"""


def node_alerts(spark, sf):
    ev = T.events(spark, sf)
    return ev.select(
        "event_id", _pick(_NAMES, F.col("event_id") % 7).alias("alertname"), F.col("target").alias("node"), F.lit(None).cast("string").alias("application"),
        _pick(("jenkins", "cadvisor", "cadvisor-k3s"), F.col("event_id") % 3).alias("job"), F.when(F.col("user_id") % 13 == 0, "agent").otherwise("").alias("source"),
        F.nullif(_pick(_DIAGNOSES, F.col("user_id") % 5), F.lit("")).alias("feature"), F.when(F.col("event_id") % 4 == 0, -F.col("value")).otherwise(F.col("value")).alias("z"),
    )


_HOSTS = "node IN ('node-0', 'node-1')"
PLAN_SQL = f"""pl AS (SELECT *, CASE WHEN alertname = 'MoteurAIOpsArrete' THEN 'node-2' ELSE node END AS tn FROM al),
  pa AS (SELECT *, CASE WHEN source IN ('agent', 'backup') THEN 'none:own_alert' WHEN tn = 'node-3' THEN 'none:unknown_node'
    WHEN alertname = 'NoeudInjoignable' THEN 'restart-container:node-exporter' WHEN alertname = 'CollecteurArrete' AND (job = 'cadvisor' OR job = 'cadvisor-k3s' AND {_HOSTS}) THEN 'restart-container:' || job
    WHEN alertname = 'CollecteurArrete' THEN 'none:collector_not_listed' WHEN alertname = 'MoteurAIOpsArrete' THEN 'restart-container:mon-aiops-engine'
    WHEN alertname = 'RamElevee' THEN CASE WHEN {_HOSTS} THEN 'stop-sonarqube:' ELSE 'none:memory_high_no_action' END WHEN alertname = 'DisquePlein' THEN 'none:disk_cleanup_disabled'
    WHEN alertname = 'AnomalieAIOps' THEN CASE WHEN feature IS NULL THEN 'none:no_diagnosis' WHEN z < 0 AND feature IN ('cpu_server', 'ram_server_mb', 'cpu_host', 'ram_host') THEN 'none:falling'
      WHEN {_HOSTS} AND feature IN ('cpu_server', 'ram_server_mb') THEN 'rollout-restart:server' WHEN {_HOSTS} AND feature IN ('cpu_host', 'ram_host') THEN 'stop-sonarqube:' ELSE 'none:no_safe_action' END
    ELSE 'none:watch_only' END AS p FROM pl),
  plans AS (SELECT *, CASE WHEN starts_with(p, 'none:') THEN NULL ELSE split_part(p, ':', 1) END AS action, CASE WHEN starts_with(p, 'none:') THEN '' ELSE split_part(p, ':', 2) END AS arg,
    CASE WHEN starts_with(p, 'rollout') THEN 'node-1' ELSE tn END AS plan_node FROM pa)"""


@query("D1_node_policy", f"WITH {EV}, {_ALERTS_SQL}, {PLAN_SQL} SELECT event_id, plan_node, coalesce(action, '') AS action, arg, CASE WHEN action IS NULL THEN split_part(p, ':', 2) ELSE '' END AS why FROM plans")
def _(spark, sf):
    nodes, apps = fleet(spark)
    plans = decisions.plan(node_alerts(spark, sf), nodes, apps)
    return plans.select("event_id", "plan_node", F.coalesce("action", F.lit("")).alias("action"), "arg", F.when(F.col("action").isNull(), F.col("reason")).otherwise("").alias("why"))


@query("D2_application_policy", f"""WITH {EV}, aa AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ApplicationHorsLigne' ELSE 'AnomalieApplication' END AS alertname, 'shop-' || user_id % 3 AS application,
    nullif({_sql_pick(_APP_DIAGNOSES, 'user_id % 6')}, '') AS feature, CASE WHEN event_id % 4 = 1 THEN -value ELSE value END AS z FROM ev),
  cc AS (SELECT *, CASE feature WHEN 'cpu_api' THEN 'api' WHEN 'ram_site_mb' THEN 'site' WHEN 'cpu_web' THEN 'web' WHEN 'ram_base_mb' THEN 'base' END AS comp FROM aa)
  SELECT event_id, 'node-1' AS plan_node, CASE WHEN application = 'shop-2' THEN 'unknown_application' WHEN alertname = 'ApplicationHorsLigne' THEN 'self_healing' WHEN feature IS NULL THEN 'no_diagnosis'
    WHEN feature = 'ram_base_mb' THEN 'database_never_restarted' WHEN comp IS NULL THEN 'no_safe_action' WHEN NOT (application = 'shop-0' AND comp IN ('api', 'site') OR application = 'shop-1' AND comp = 'web') THEN 'component_not_listed'
    WHEN z < 0 THEN 'falling' ELSE 'component_overload' END AS reason,
    CASE WHEN (application = 'shop-0' AND comp IN ('api', 'site') OR application = 'shop-1' AND comp = 'web') AND alertname <> 'ApplicationHorsLigne' AND z >= 0 THEN application || '/' || comp ELSE '' END AS arg FROM cc""")
def _(spark, sf):
    nodes, apps = fleet(spark)
    ev = T.events(spark, sf)
    alerts = ev.select(
        "event_id", F.when(F.col("event_id") % 5 == 0, "ApplicationHorsLigne").otherwise("AnomalieApplication").alias("alertname"), F.lit("appli").alias("node"),
        F.concat(F.lit("shop-"), (F.col("user_id") % 3).cast("string")).alias("application"), F.lit("").alias("job"), F.lit("").alias("source"),
        F.nullif(_pick(_APP_DIAGNOSES, F.col("user_id") % 6), F.lit("")).alias("feature"), F.when(F.col("event_id") % 4 == 1, -F.col("value")).otherwise(F.col("value")).alias("z"),
    )
    return decisions.plan(alerts, nodes, apps).select("event_id", "plan_node", "reason", "arg")


@query("D3_target_node", f"WITH {EV}, {_ALERTS_SQL}, {PLAN_SQL} SELECT event_id, tn AS target_node FROM pl")
def _(spark, sf):
    alerts = node_alerts(spark, sf)
    return alerts.select("event_id", decisions.target_node(F.col("alertname"), F.col("node"), F.lit("node-2")).alias("target_node"))


@query("D4_control_node", """SELECT coalesce(min_by(s_name, s_suppkey) FILTER (s_acctbal > 9900), min_by(s_name, s_suppkey) FILTER (s_nationkey % 3 = 0)) AS control FROM supplier""")
def _(spark, sf):
    nodes = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 3 == 0).alias("app"), (F.col("s_acctbal") > 9900).alias("k3s"), F.col("s_suppkey").alias("ord"))
    return decisions.control_node(nodes)


@query("D5_maintenance_check", f"""WITH {EV}, {_ALERTS_SQL}, {PLAN_SQL}, mm AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 6 = 0 OR event_id % 8 = 0 END AS maint FROM plans)
  SELECT event_id, CASE WHEN action IS NULL THEN 'aucune_action' WHEN maint IS NULL THEN 'contexte_indisponible' WHEN maint THEN 'maintenance' ELSE 'guards' END AS decision FROM mm""")
def _(spark, sf):
    nodes, apps = fleet(spark)
    plans = decisions.plan(node_alerts(spark, sf), nodes, apps)
    maint = decisions.in_maintenance(F.col("event_id") % 6 == 0, F.col("event_id") % 8 == 0, F.col("event_id") % 11 != 0)
    return plans.select("event_id", F.coalesce(decisions.pre_guard(F.col("action"), maint), F.lit("guards")).alias("decision"))


@query("D6_outcome_mapping", "SELECT CASE l_quantity::INT WHEN 0 THEN 'succes' WHEN 3 THEN 'rien_a_faire' WHEN 4 THEN 'refusee' ELSE 'echec' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf):
    code = F.col("l_quantity").cast("int")
    return read(spark, sf, "lineitem").select(decisions.outcome_of(code).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- boards
def _gauge(metrics_df, name, *by):
    rows = R.pick(metrics_df, name)
    return rows.select(*[L.label(F.col("labels"), b).alias(b) for b in by], "value")


_BOARD = (
    "pfe_backup_last_status", "pfe_backup_last_success_timestamp_seconds", "pfe_backup_offsite_last_success_timestamp_seconds",
    "pfe_backup_restore_test_status", "pfe_backup_restore_test_last_success_timestamp_seconds",
)


@query("B1_backup_board", f"""WITH {HOURLY} SELECT target AS node, max((error < 2)::INT)::DOUBLE AS status, CASE WHEN target <> 'node-1' THEN max(t - error * 72000) END AS last_success,
  CASE WHEN target NOT IN ('node-1', 'node-2') THEN max(t - view * 72000) END AS last_copy, max((error < 3)::INT)::DOUBLE AS restore_status, max(t - click * 345600) AS last_restore FROM m GROUP BY target""")
def _(spark, sf):
    m = cut(metrics(spark, sf, _BOARD))
    gauges = {
        "status": _gauge(m, "pfe_backup_last_status", "node"), "last_success": _gauge(m, "pfe_backup_last_success_timestamp_seconds", "node"),
        "last_copy": _gauge(m, "pfe_backup_offsite_last_success_timestamp_seconds", "node"), "restore_status": _gauge(m, "pfe_backup_restore_test_status", "node"),
        "last_restore": _gauge(m, "pfe_backup_restore_test_last_success_timestamp_seconds", "node"),
    }
    return audit.backup_board(gauges, ["node"], ["last_success", "last_copy", "last_restore"])


@query("B2_received_board", """WITH o AS (SELECT o_orderpriority AS node, o_orderstatus AS source, (epoch_us(o_orderdate) // 1000000) * CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS last, (o_custkey % 7 <> 0)::INT AS valid FROM orders)
  SELECT node, source, max(last) FILTER (last > 0)::DOUBLE AS last_set, max(valid)::DOUBLE AS valid, count(*)::DOUBLE AS sets FROM o GROUP BY 1, 2""")
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("node"), F.col("o_orderstatus").alias("source"), "o_custkey", (T.days("o_orderdate") * 86400).cast("double").alias("epoch"))
    gauge = lambda c: o.select("node", "source", c.cast("double").alias("value"))
    sets = o.groupBy("node", "source").agg(F.count("*").cast("double").alias("value"))
    gauges = {"last_set": gauge(F.when(F.col("source") == "P", 0).otherwise(F.col("epoch"))), "valid": gauge((F.col("o_custkey") % 7 != 0).cast("int")), "sets": sets}
    return audit.backup_board(gauges, ["node", "source"], ["last_set"])


@query("B3_application_board", f"""WITH {HOURLY}, st AS (SELECT {_APP} AS application, max((signup > 0)::INT)::DOUBLE AS state FROM m WHERE target <> 'node-3' GROUP BY 1 UNION ALL SELECT 'main', max((click > 0)::INT)::DOUBLE FROM m WHERE target = 'node-3'),
  vv AS (SELECT 'shop-' || p_size % 4 AS application, CASE WHEN p_partkey % 5 = 0 THEN 'main-' || substr(md5(p_name), 1, 7) ELSE 'v' || p_size END AS version FROM part),
  ve AS (SELECT application, max(version) AS version FROM vv WHERE regexp_full_match(version, '.+-[0-9a-f]{{7}}') AND application <> 'shop-2' GROUP BY 1
    UNION ALL SELECT application, max(version) FROM vv WHERE application = 'shop-2' AND NOT regexp_full_match(version, '.+-[0-9a-f]{{7}}') GROUP BY 1),
  an AS (SELECT {_APP} AS application, max(least(error, 1)) AS anomaly FROM m GROUP BY 1)
  SELECT application, state, version, anomaly FROM st FULL JOIN ve USING (application) FULL JOIN an USING (application)""")
def _(spark, sf):
    m = T.hourly(spark, sf)
    app = F.replace("target", F.lit("node"), F.lit("shop"))
    probed = m.where("target <> 'node-3'").groupBy(app.alias("application")).agg(F.max((F.col("signup") > 0).cast("double")).alias("state"))
    main = m.where("target = 'node-3'").agg(F.max((F.col("click") > 0).cast("double")).alias("state")).select(F.lit("main").alias("application"), "state")
    parts = read(spark, sf, "part").select(
        F.concat(F.lit("shop-"), (F.col("p_size") % 4).cast("string")).alias("application"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("main-"), F.substring(F.md5("p_name"), 1, 7))).otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("version"),
    )
    commit = L.is_commit_version(F.col("version"))
    shown = lambda df: df.groupBy("application").agg(F.max("version").alias("version"))
    listed = parts.where(~(commit & (F.col("application") == "shop-2")))
    versions = vector.or_on(shown(listed.where(commit)), shown(listed), ["application"])
    anomaly = m.groupBy(app.alias("application")).agg(F.max(F.least("error", F.lit(1.0))).alias("anomaly"))
    return vector.outer_merge([vector.or_on(probed, main, ["application"]), versions, anomaly], ["application"])


@query("B4_free_servers", "SELECT count(*) FILTER (s_acctbal < 3000 AND s_nationkey % 2 = 0) AS free FROM supplier")
def _(spark, sf):
    rows = read(spark, sf, "supplier").select(F.when(F.col("s_acctbal") < 3000, "vide").otherwise("occupe").alias("state"), F.when(F.col("s_nationkey") % 2 == 0, "").otherwise("known").alias("name"))
    return audit.free_servers(rows)
