"""Queries: streaming and stateful operators (T), and the sinks they feed (S8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import audit, decisions, features, lifecycle
from pulsegrid.plans import tables as T
from pulsegrid.plans.alerting import notified
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import EV, HOURLY, read
from pulsegrid.plans.windows import SUPPRESSED, suppressed
from pulsegrid.session import cut
from pulsegrid.sources import logs
from pulsegrid.streaming import jobs, processors

HOUR = 3600


def _detector_rows(spark, sf, quality):
    """Rows of the stepped fleet with the model of its first level and the forest's score beside them."""
    base = cut(features.matrix(T.stepped(spark, sf), T.FEATURES))
    rows = lifecycle.attach(base, T.step_models(base)).join(T.step_scores(base), ["target", "t"])
    critical = F.array(*[F.lit(s[5]) for s in T.STEP_SPEC])
    return rows.select(
        "target", "t", "x", quality.cast("int").alias("quality"), F.floor((F.col("t") % 86400) / HOUR).between(2, 7).alias("suppressed"), "score",
        "names", "median", "mad", "min_effects", "directions", critical.alias("critical"), "threshold", "low_threshold", "if_suspended", "version",
    )


def _detector():
    return processors.Detector(lam=T.LAM, warmup=20, count_feature="view", ttl=30 * 86400)


def _detections(spark, sf, name, quality=None):
    """The automaton in event time, over three steps of time."""
    rows = jobs.replay(_detector_rows(spark, sf, F.lit(1) if quality is None else quality), name, ["target"], slices=3)
    return jobs.drain(jobs.keyed(rows, ["target"], _detector(), "t", "2 hours"), name)


_WALK = "SELECT target, t, round(smoothed, 6) AS smoothed, z_active, by_forest AS if_effective, act AS active, coalesce(kind = 'regime', FALSE) AS regime FROM au WHERE rn > 0"


@query("T1_detector_automaton", f"WITH RECURSIVE {T.automaton_sql()} {_WALK}")
def _(spark, sf):
    return _detections(spark, sf, "T1").select("target", "t", F.round("z_smoothed", 6).alias("smoothed"), "z_active", "if_effective", "active", "regime")


@query("T2_abstention", f"WITH RECURSIVE {T.automaton_sql('x[2] <= 2')} {_WALK}")
def _(spark, sf):
    out = _detections(spark, sf, "T2", F.element_at("x", 2) <= 2)
    return out.select("target", "t", F.round("z_smoothed", 6).alias("smoothed"), "z_active", "if_effective", "active", "regime")


@query("T3_event_records", f"""WITH RECURSIVE {T.automaton_sql()} SELECT target, c_start AS start_epoch, t AS end_epoch, t - c_start AS duration_s, c_feature AS top_feature, round(c_z, 6) AS top_z, c_det AS detectors, kind
  FROM au WHERE kind IS NOT NULL""")
def _(spark, sf):
    out = _detections(spark, sf, "T3").where("event_kind in ('anomaly', 'regime')")
    return out.select(
        "target", F.col("event_start").alias("start_epoch"), F.col("t").alias("end_epoch"), (F.col("t") - F.col("event_start")).alias("duration_s"), F.col("event_feature").alias("top_feature"),
        F.round("event_z", 6).alias("top_z"), F.col("event_detectors").alias("detectors"), F.col("event_kind").alias("kind"),
    )


_EVENTS = """ch AS (SELECT *, coalesce(lag(open) OVER (PARTITION BY target ORDER BY t), FALSE) AS was FROM sp2), ed AS (SELECT *, sum((open AND NOT was)::INT) OVER (PARTITION BY target ORDER BY t) AS no FROM ch WHERE open <> was),
  evn AS (SELECT target, min(t) FILTER (open) AS start_epoch, max(t) FILTER (NOT open) AS end_epoch, max(top_feature) FILTER (open) AS top_feature, round(max(top_z) FILTER (open), 6) AS top_z FROM ed GROUP BY target, no)"""
_EVENTS_SQL = f"WITH RECURSIVE {SUPPRESSED}, {_EVENTS} SELECT target, start_epoch, end_epoch, end_epoch - start_epoch AS duration_s, top_feature, top_z, 'zscore' AS detectors FROM evn WHERE end_epoch IS NOT NULL"


@query("S8_event_log", _EVENTS_SQL)
def _(spark, sf):
    events = lifecycle.anomaly_events(cut(suppressed(spark, sf)).withColumns({"if_effective": F.lit(False), "z_active": F.col("wants")}), width=5 * 86400)
    return logs.event_rows(events.withColumn("top_z", F.round("top_z", 6)))


@query("T4_once_per_incident", f"""WITH RECURSIVE {EV}, a AS (SELECT user_id || ':' || feature AS incident, t, min(event_id) AS row_id FROM ev GROUP BY 1, 2),
  g AS (SELECT incident, min(t) AS t FROM a GROUP BY 1 UNION ALL SELECT incident, t FROM (SELECT a.incident, a.t, row_number() OVER (PARTITION BY g.incident, g.t ORDER BY a.t) AS r FROM g JOIN a ON a.incident = g.incident AND a.t >= g.t + 86400) WHERE r = 1)
  SELECT incident, t, row_id FROM g JOIN a USING (incident, t)""")
def _(spark, sf):
    ev = T.events(spark, sf).groupBy(F.concat_ws(":", F.col("user_id").cast("string"), "feature").alias("incident"), "t").agg(F.min("event_id").alias("row_id"))
    return jobs.drain(jobs.keyed(jobs.replay(ev, "T4"), ["incident"], processors.OncePerIncident()), "T4")


@query("T5_notification_repeat", f"""WITH {HOURLY}, f AS (SELECT target AS node, t, feature FROM (UNPIVOT m ON {", ".join(T.FEATURES)} INTO NAME feature VALUE value) WHERE value = 0),
  gs AS (SELECT route, 'CollecteurArrete' AS alertname, node, job, t, list_sort(list(feature)) AS members FROM f, (VALUES ('mail', ''), ('agent', 'cadvisor')) r(route, job) GROUP BY ALL), {T.NOTIFIED}""")
def _(spark, sf):
    # every feature silent for an hour is a firing member of its node's group
    silent = cut(T.hourly_long(spark, sf))
    firing = silent.where("value = 0").select(
        F.lit("CollecteurArrete").alias("alertname"), F.lit("warning").alias("severity"), F.col("target").alias("node"), F.lit("cadvisor").alias("job"), "t", F.col("feature").alias("series")
    )
    return notified(spark, firing, silent.agg(F.max("t")), "T5")


_GUARDED = f"""WITH RECURSIVE {EV},
  p AS (SELECT 'agent-' || user_id AS scope, t, event_id AS row_id, feature || ':' || (t // 86400) AS incident, target || ':' || feature || ':' AS act, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 END AS code,
    row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev),
  g AS (SELECT DISTINCT scope, 0::BIGINT AS rn, NULL::BIGINT AS t, NULL::BIGINT AS row_id, NULL::VARCHAR AS decision, NULL::VARCHAR AS outcome, 0::BIGINT AS failures,
      []::STRUCT(t BIGINT, incident VARCHAR, act VARCHAR, no BIGINT, charged BOOLEAN)[] AS log FROM p
    UNION ALL
    SELECT scope, rn, t, row_id, coalesce(refused, allowed), CASE WHEN refused IS NULL THEN outcome END,
      CASE WHEN refused IS NULL AND allowed = 'executee' THEN CASE WHEN outcome = 'echec' THEN failures + 1 ELSE 0 END ELSE failures END,
      CASE WHEN refused IS NULL THEN list_append(log, {{'t': t, 'incident': incident, 'act': act, 'no': no + 1, 'charged': outcome NOT IN ('rien_a_faire', 'refusee')}}) ELSE log END
    FROM (SELECT *, CASE WHEN failures >= {V.FAILURE_BREAKER} THEN 'suspendu' WHEN no >= {V.MAX_ATTEMPTS} THEN 'escalade' WHEN resting THEN 'pause' WHEN spent >= {V.MAX_ACTIONS_PER_HOUR} THEN 'quota' END AS refused FROM (
      SELECT p.scope, p.rn, p.t, p.row_id, p.incident, p.act, g.failures, g.log, CASE WHEN code IS NULL THEN 'simulee' ELSE 'executee' END AS allowed,
        CASE WHEN code IS NULL THEN 'simulee' WHEN code = 0 THEN 'succes' WHEN code = 3 THEN 'rien_a_faire' WHEN code = 4 THEN 'refusee' ELSE 'echec' END AS outcome,
        coalesce(list_max([x.no FOR x IN g.log IF x.incident = p.incident AND p.t - x.t < 86400]), 0) AS no,
        len([x FOR x IN g.log IF x.act = p.act AND p.t - x.t < {V.COOLDOWN_SECONDS}]) > 0 AS resting, len([x FOR x IN g.log IF x.charged AND p.t - x.t < 3600]) AS spent
      FROM g JOIN p ON p.scope = g.scope AND p.rn = g.rn + 1)))
  SELECT scope, t, row_id, decision, outcome FROM g WHERE rn > 0"""


@query("T6_guarded_decisions", _GUARDED)
def _(spark, sf):
    # one agent per user fleet: its quota and its breaker are its own state
    ev = T.events(spark, sf)
    planned = ev.select(
        F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("scope"), "t", F.col("event_id").alias("row_id"), F.concat_ws(":", "feature", F.expr("t div 86400").cast("string")).alias("incident"),
        F.concat_ws(":", "target", "feature", F.lit("")).alias("action_key"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 5).cast("int")).alias("code"),
    )
    return jobs.drain(jobs.keyed(jobs.replay(planned, "T6"), ["scope"], processors.Guard()), "T6")


@query("T7_delayed_verification", f"""WITH {HOURLY}, a AS (SELECT event_id, user_id, target, t FROM ev WHERE feature = 'purchase' AND (event_id % 3 = 0 OR event_id % 5 = 0)), f AS (SELECT user_id, t AS s, t + 7200 AS e FROM ev WHERE feature = 'error'),
  r AS (SELECT a.*, coalesce(m.signup > 0, FALSE) AS readable FROM a LEFT JOIN m ON m.target = a.target AND m.t = (a.t + 300) // 3600 * 3600)
  SELECT event_id, CASE WHEN NOT readable THEN 'inconnu' WHEN EXISTS (SELECT 1 FROM f WHERE f.user_id = r.user_id AND r.t + 300 BETWEEN s AND e) THEN 'persistant' ELSE 'resolu' END AS verification FROM r""")
def _(spark, sf):
    # simulated actions and successes are verified; an hour without a sign of its node's alert source leaves them unknown
    ev = T.events(spark, sf)
    name, node = F.lit("RamElevee").alias("alertname"), F.col("user_id").cast("string").alias("node")
    taken = ev.where("feature = 'purchase'").select(name, node, "target", "t", "event_id", F.expr("(t + 300) div 3600 * 3600").alias("hour"))
    alive = T.hourly(spark, sf).select("target", F.col("t").alias("hour"), (F.col("signup") > 0).alias("readable"))
    actions = taken.join(alive, ["target", "hour"], "left")
    firing = ev.where("feature = 'error'").select(name, node, F.col("t").alias("start"), (F.col("t") + 7200).alias("end"))
    acted = (F.col("event_id") % 3 == 0) | (F.col("event_id") % 5 == 0)
    return decisions.verify(actions, firing, width=T.width(ev, ["user_id"]), acted=acted, readable=F.col("readable")).select("event_id", "verification")


@query("T8_snapshot_carry", f"""WITH {EV}, d AS (SELECT 'n' || user_id AS node, t, max(feature) AS services, bool_or(feature <> 'error') AS ok FROM ev GROUP BY 1, 2)
  SELECT node, t, last_value(CASE WHEN ok THEN services END IGNORE NULLS) OVER (PARTITION BY node ORDER BY t) AS services FROM d""")
def _(spark, sf):
    ev = T.events(spark, sf)
    found = ev.groupBy(F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("node"), "t").agg(F.max("feature").alias("services"), F.bool_or(F.col("feature") != "error").alias("ok"))
    return jobs.drain(jobs.keyed(jobs.replay(found, "T8"), ["node"], processors.Snapshot()), "T8")


@query("T9_trailing_windows", f"""WITH {EV}, w AS (SELECT target, feature, us // 1800000000 * 1800 - unnest([0, 1800, 3600, 5400]) AS start, us, value FROM ev)
  SELECT target, feature, start, count(*) AS n, round(sum(value), 4) AS total, round(arg_max(value, us) - arg_min(value, us), 4) + 0 AS delta FROM w
  WHERE (start + 7200) * 1000 <= (SELECT max(us) // 1000 - 120000 FROM ev) GROUP BY 1, 2, 3""")
def _(spark, sf):
    # append: a window comes out once, when the watermark has passed its end, and its state goes
    source = read(spark, sf, "events")
    stream = jobs.follow(spark, source.schema, sf, "events")
    rows = stream.select(
        F.timestamp_micros(T.micros("ts")).alias("ts"), F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("target"), F.col("event_type").alias("feature"), "value"
    )
    windows = jobs.sliding(jobs.accepted(rows), ["target", "feature"], "ts", "value", "2 hours", "30 minutes")
    flat = windows.select("target", "feature", F.expr("unix_micros(w.start) div 1000000").alias("start"), "n", F.round("total", 4).alias("total"), (F.round("delta", 4) + 0).alias("delta"))
    return jobs.drain(flat, "T9")


@query("T10_announcement_extension", f"""WITH {EV}, s AS (SELECT user_id, t, max(value) AS v FROM ev WHERE feature = 'signup' GROUP BY 1, 2)
  SELECT user_id, t, round(max(t + v * 3600) OVER (PARTITION BY user_id ORDER BY t), 4) AS until_in_force FROM s""")
def _(spark, sf):
    ev = T.events(spark, sf).where("feature = 'signup'").groupBy("user_id", "t").agg(F.max("value").alias("v"))
    announced = ev.withColumn("until", F.col("t") + F.col("v") * HOUR)
    return audit.extend_announcement(announced, ["user_id"], "until", width=T.width(announced, ["user_id"])).select("user_id", "t", F.round("until_in_force", 4).alias("until_in_force"))


