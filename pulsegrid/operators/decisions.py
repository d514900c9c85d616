"""From alerts to planned actions: policies, control node, maintenance, outcomes, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.functions import labels as L
from pulsegrid.operators import blocks, detect


def control_node(nodes: DataFrame) -> DataFrame:
    """One row: the k3s control node, else the first node hosting an application, in inventory order."""
    able = nodes.where(F.col("k3s") | F.col("app"))
    return able.agg(F.min_by("name", F.struct((~F.col("k3s")).alias("a"), F.col("ord"))).alias("control"))


def monitoring_node(nodes: DataFrame) -> DataFrame:
    return nodes.where("monitoring").agg(F.min_by("name", "ord").alias("supervisor"))


def target_node(alertname: Column, node: Column, supervisor: Column) -> Column:
    """Alerts about the engine itself concern the monitoring node."""
    return F.when(alertname == "MoteurAIOpsArrete", supervisor).otherwise(node)


def plan(alerts: DataFrame, nodes: DataFrame, applications: DataFrame, api: str = "server", disk_cleanup: bool = False) -> DataFrame:
    """Planned action of every alert: columns plan_node, action (null = none), arg, reason, verify_node.

    Alerts: alertname, node, application, job, source, feature, z. Nodes: name, app, monitoring, k3s, ord.
    Applications: application, components. The policies are ordered rules; the first that applies wins.
    """
    located = alerts.withColumns({"control": control_node(nodes).scalar(), "supervisor": monitoring_node(nodes).scalar()})
    located = located.withColumn("__target", target_node(F.col("alertname"), F.col("node"), F.col("supervisor")))
    known = nodes.select(F.col("name").alias("__target"), F.col("app").alias("__hosts"), F.lit(True).alias("__known"))
    joined = located.join(known, "__target", "left").join(applications, "application", "left")

    name, feature, z = F.col("alertname"), F.col("feature"), F.col("z")
    own = F.coalesce(F.col("source").isin("agent", "backup"), F.lit(False))
    for_app = name.isin(*V.APPLICATION_ALERTS) & ~own
    hosts = F.coalesce("__hosts", F.lit(False))
    falling = F.coalesce(z < 0, F.lit(False))
    component = L.component_of(feature)
    target, control = F.col("__target"), F.col("control")
    none = F.lit(None).cast("string")

    def to(node: Column, action: Column | None, arg: Column | None, reason: str) -> Column:
        return F.struct(
            node.alias("plan_node"), (none if action is None else action).alias("action"),
            (F.lit("") if arg is None else arg).alias("arg"), F.lit(reason).alias("reason"),
        )

    on_control = F.coalesce(control, F.lit("-"))
    here = F.coalesce(target, F.lit("-"))
    restart = F.lit("restart-container")
    disk = F.lit("clean-disk") if disk_cleanup else None
    is_collector = F.col("job").isin(*V.COLLECTOR_JOBS) & ~((F.col("job") == "cadvisor-k3s") & ~hosts)
    load = feature.isin(*V.HOST_LOAD_FEATURES)
    server = feature.isin(*V.SERVER_FEATURES)
    rules = [
        (for_app & F.col("components").isNull(), to(on_control, None, None, "unknown_application")),
        (for_app & control.isNull(), to(F.lit("-"), None, None, "no_control_node")),
        (for_app & (name == "ApplicationHorsLigne"), to(on_control, None, None, "self_healing")),
        (for_app & feature.isNull(), to(on_control, None, None, "no_diagnosis")),
        (for_app & (feature == "ram_base_mb"), to(on_control, None, None, "database_never_restarted")),
        (for_app & component.isNull(), to(on_control, None, None, "no_safe_action")),
        (for_app & ~F.array_contains("components", component), to(on_control, None, None, "component_not_listed")),
        (for_app & falling, to(on_control, None, None, "falling")),
        (for_app, to(on_control, F.lit("rollout-app"), F.concat_ws("/", "application", component), "component_overload")),
        (own, to(here, None, None, "own_alert")),
        (F.col("__known").isNull(), to(here, None, None, "unknown_node")),
        (name == "NoeudInjoignable", to(target, restart, F.lit("node-exporter"), "collector_silent")),
        ((name == "CollecteurArrete") & F.coalesce(is_collector, F.lit(False)), to(target, restart, F.col("job"), "collector_silent")),
        (name == "CollecteurArrete", to(target, None, None, "collector_not_listed")),
        (name == "MoteurAIOpsArrete", to(target, restart, F.lit("mon-aiops-engine"), "engine_stopped")),
        ((name == "RamElevee") & hosts, to(target, F.lit("stop-sonarqube"), None, "memory_high")),
        (name == "RamElevee", to(target, None, None, "memory_high_no_action")),
        (name.isin("DisquePlein", "DisquePleinPrevu"), to(target, disk, None, "disk_full" if disk_cleanup else "disk_cleanup_disabled")),
        ((name == "AnomalieAIOps") & feature.isNull(), to(target, None, None, "no_diagnosis")),
        ((name == "AnomalieAIOps") & falling & (server | load), to(target, None, None, "falling")),
        ((name == "AnomalieAIOps") & hosts & server, to(F.coalesce(control, target), F.lit("rollout-restart"), F.lit(api), "server_overload")),
        ((name == "AnomalieAIOps") & hosts & load, to(target, F.lit("stop-sonarqube"), None, "host_overload")),
        (name == "AnomalieAIOps", to(target, None, None, "no_safe_action")),
    ]
    chosen = F
    for condition, outcome in rules:
        chosen = chosen.when(F.coalesce(condition, F.lit(False)), outcome)
    planned = joined.withColumn("__plan", chosen.otherwise(to(target, None, None, "watch_only")))
    return planned.select(
        *alerts.columns, "__plan.*", F.when(for_app, F.coalesce("node", F.lit(""))).otherwise(F.lit("")).alias("verify_node")
    )


def in_maintenance(announced: Column, engine: Column, available: Column) -> Column:
    """Three-valued: null when the state cannot be read, and the caller abstains."""
    return F.when(available, F.coalesce(announced, F.lit(False)) | F.coalesce(engine, F.lit(False)))


def pre_guard(action: Column, maintenance: Column) -> Column:
    """Decision before the guards, or null when the guards must judge."""
    return F.when(action.isNull(), "aucune_action").when(maintenance.isNull(), "contexte_indisponible").when(maintenance, "maintenance")


def outcome_of(code: Column) -> Column:
    chain = F
    for value, name in V.OUTCOMES.items():
        chain = chain.when(code == value, F.lit(name))
    return chain.otherwise(F.lit(V.OUTCOME_FAILED))


def verify(
    actions: DataFrame, firing: DataFrame, delay: int = V.VERIFY_DELAY, width: int = blocks.DEFAULT_WIDTH,
    acted: Column | None = None, readable: Column | None = None,
) -> DataFrame:
    """State of the alert ``delay`` seconds after each action: persistant when a firing interval covers that time.

    Actions: alertname, node, t, ... Firing: alertname, node, start, end. The engine alert has no node. ``acted``
    tells which actions were executed or simulated (the others are not verified), ``readable`` where the alerts could
    be read at that time (false or null: inconnu).
    """
    known = F.lit(True) if readable is None else F.coalesce(readable, F.lit(False))
    actions = (actions if acted is None else actions.where(acted)).withColumn("__known", known)
    blank = lambda df: df.withColumn("__n", F.when(F.col("alertname") == "MoteurAIOpsArrete", "").otherwise(F.col("node")))
    due = blank(actions).withColumn("verify_at", F.col("t") + delay)
    done = detect.covered_by(due, blank(firing), ["alertname", "__n"], "start", "end", "verify_at", width)
    verdict = F.when(~F.col("__known"), "inconnu").when(F.col("covered"), "persistant").otherwise("resolu")
    return done.withColumn("verification", verdict).drop("covered", "__n", "__known")


def failure_runs(outcomes: DataFrame, keys: list[str], order: list[str], failed: Column, width: int = blocks.DEFAULT_WIDTH) -> DataFrame:
    """Consecutive failures so far and whether the breaker has tripped at this row."""
    runs = detect.run_length(outcomes, keys, order, failed, "failures", width)
    return runs.withColumn("suspends", F.col("failures") >= V.FAILURE_BREAKER)
