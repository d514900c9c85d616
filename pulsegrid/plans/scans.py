"""Queries: sources and sinks (S), projections and filters (P), joins (J), set operations (U), sorts (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.functions import inventory, labels as L
from pulsegrid.operators import audit, detect, evaluate, features, formulas, series, slopes, summaries, vector
from pulsegrid.plans import tables as T
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import END, EV, FEATURES, HOUR, HOURLY, MID, read
from pulsegrid.session import cut
from pulsegrid.sources import exposition, logs

MONTH = 31 * 86400


@query("S1_instant_read", f"""WITH {EV} SELECT target, arg_max(value, us) AS value, max(us) AS at FROM ev
  WHERE t <= {END} AND t > {END - MONTH} GROUP BY target""")
def _(spark, sf):
    ev = T.events(spark, sf).select("target", F.col("us").alias("t"), "value")
    return series.instant(ev, ["target"], END * 1_000_000, MONTH * 1_000_000).withColumnRenamed("t", "at")


def _grid_sql(step: int, lookback: int, keys: str) -> str:
    return f"""sp AS (SELECT {keys}, unnest(generate_series((min(t) + {step - 1}) // {step} * {step}, (max(t) + {step - 1}) // {step} * {step}, {step})) AS t FROM s GROUP BY {keys}),
    hit AS (SELECT sp.*, s.value, sp.t - s.t AS age FROM sp ASOF LEFT JOIN s USING ({keys}, t)),
    got AS (SELECT * REPLACE (CASE WHEN age < {lookback} THEN value END AS value, CASE WHEN age < {lookback} THEN age END AS age) FROM hit)"""


_SERIES = f"{EV}, s AS (SELECT user_id, t, arg_max(value, us) AS value FROM ev GROUP BY 1, 2)"


def _user_series(spark, sf):
    ev = T.events(spark, sf).select("user_id", "t", "us", "value")
    # read four times below (ticks and samples, rows and summaries): deduplicated once
    return cut(series.dedupe_last(ev, ["user_id", "t"], "us").select("user_id", "t", "value"))


@query("S2_range_read", f"WITH {_SERIES}, {_grid_sql(86400, 86400, 'user_id')} SELECT user_id, t, value FROM got WHERE value IS NOT NULL")
def _(spark, sf):
    s = _user_series(spark, sf)
    ticks = series.tick_grid(s, ["user_id"], 86400)
    return series.asof(ticks, s, ["user_id"], ["value"], 86400, width=T.width(s, ["user_id"])).where("value is not null").select("user_id", "t", "value")


@query("S3_paged_range_read", f"WITH {EV} SELECT user_id, t, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM ev GROUP BY 1, 2")
def _(spark, sf):
    ev = T.events(spark, sf).select("user_id", "t", "event_id", "value")
    return series.dedupe_last(ev, ["user_id", "t"], "event_id").select("user_id", "t", "value", "event_id")


@query("S4_multi_series_instant", f"""WITH {EV} SELECT 'node="' || target || '",type="' || feature || '"' AS labels, arg_max(value, us) AS value
  FROM ev WHERE t <= {END} GROUP BY target, feature""")
def _(spark, sf):
    ev = T.events(spark, sf).select("target", "feature", F.col("us").alias("t"), "value")
    latest = series.instant(ev, ["target", "feature"], END * 1_000_000, MONTH * 1_000_000)
    labels = F.create_map(F.lit("type"), "feature", F.lit("node"), "target")
    return latest.select(L.render_labels(labels).alias("labels"), "value")


def _turn_samples(spark, sf):
    turns = read(spark, sf, "conversations")
    labels = F.create_map(
        F.lit("conv"), F.col("conv_id").cast("string"), F.lit("role"), "role", F.lit("text"), "text", F.lit("turn"), F.col("turn").cast("string")
    )
    return turns.select(F.lit("turn_size").alias("name"), labels.alias("labels"), (F.length("text") * 1234567.5).alias("value"))


@query("S5_exposition_source", """SELECT 'turn_size' AS name, conv_id::VARCHAR AS conv, role, text, turn::VARCHAR AS turn, length(text) * 1234567.5::DOUBLE AS value
  FROM conversations""")
def _(spark, sf):
    samples = _turn_samples(spark, sf)
    lines = samples.select(exposition.sample_line(F.col("name"), F.col("labels"), F.col("value")).alias("value"))
    parsed = exposition.parse(lines)
    return parsed.select("name", *[F.col("labels")[k].alias(k) for k in ("conv", "role", "text", "turn")], "value")


@query("S6_exposition_sink", r"""WITH x AS (SELECT *, replace(replace(replace(text, '\', '\\'), chr(10), '\n'), '"', '\"') AS esc FROM conversations)
  SELECT 'turn_size{conv="' || conv_id || '",role="' || role || '",text="' || esc || '",turn="' || turn || '"} ' ||
    printf('%.1f', length(text) * 1234567.5::DOUBLE) AS line FROM x
  UNION ALL SELECT '# HELP turn_size Characters of a turn' UNION ALL SELECT '# TYPE turn_size gauge'""")
def _(spark, sf):
    info = spark.createDataFrame([("turn_size", "gauge", "Characters of a turn")], "name string, kind string, text string")
    return exposition.render(_turn_samples(spark, sf), info).select(F.col("value").alias("line"))


_LOG_SQL = f"""{EV}, raw AS (SELECT target, CASE WHEN event_id % 50 = 0 THEN '' ELSE t::VARCHAR END AS epoch,
  CASE WHEN feature = 'error' THEN 'n/a' ELSE value::VARCHAR END AS zscore_max FROM ev)"""


@query("S7_detection_log_scan", f"""WITH {_LOG_SQL}, ok AS (SELECT target, try_cast(epoch AS DOUBLE) AS epoch, try_cast(zscore_max AS DOUBLE) AS zscore_max FROM raw)
  SELECT target, epoch, zscore_max FROM ok WHERE epoch IS NOT NULL AND zscore_max IS NOT NULL AND (SELECT count(*) FROM ok WHERE epoch IS NOT NULL AND zscore_max IS NOT NULL) >= 100""")
def _(spark, sf):
    ev = T.events(spark, sf)
    raw = ev.select(
        "target", F.when(F.col("event_id") % 50 == 0, "").otherwise(F.col("t").cast("string")).alias("epoch"),
        F.when(F.col("feature") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("zscore_max"),
    )
    return logs.valid_scores(raw)


@query("S9_injection_source", """SELECT doc_id::INT AS numero, lang AS scenario, source AS noeud, n_chars::DOUBLE AS t0, quality::DOUBLE AS ia,
  CASE WHEN toxic = 1 THEN 'error' END AS variable_ia, quality = 1 AS ia_attendue FROM labels JOIN documents USING (doc_id)""")
def _(spark, sf):
    joined = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    record = F.struct(
        F.col("doc_id").cast("int").alias("numero"), F.col("lang").alias("scenario"), F.col("source").alias("noeud"),
        F.col("n_chars").cast("double").alias("t0"), F.create_map(F.lit("ia"), F.col("quality").cast("double")).alias("detections"),
        F.when(F.col("toxic") == 1, "error").alias("variable_ia"), (F.col("quality") == 1).alias("ia_attendue"),
    )
    lines = joined.select(F.explode(F.array(F.to_json(record), F.lit("  "))).alias("value"))
    return logs.parse_injections(lines).select("numero", "scenario", "noeud", "t0", F.col("detections")["ia"].alias("ia"), "variable_ia", "ia_attendue")


@query("S10_journal_tail", """SELECT conv_id, turn, role AS type, substr(replace(text, chr(10), ' '), 1, 500) AS detail FROM conversations
  ORDER BY conv_id DESC, turn DESC LIMIT 20""")
def _(spark, sf):
    turns = read(spark, sf, "conversations")
    rows = turns.select("conv_id", "turn", F.col("role").alias("type"), F.col("text").alias("detail"))
    newest = logs.tail(rows, [F.col("conv_id").desc(), F.col("turn").desc()], 20)
    return newest.select("conv_id", "turn", logs.journal_field(F.col("type")).alias("type"), logs.journal_field(F.col("detail")).alias("detail"))


def _payloads(spark, sf):
    ev = T.events(spark, sf)
    alert = lambda status, name: F.struct(
        status.alias("status"), F.create_map(F.lit("alertname"), name, F.lit("node"), F.col("target")).alias("labels"),
        F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("fingerprint"), F.col("t").cast("string").alias("startsAt"),
    )
    firing = F.when(F.col("feature") == "error", "firing").otherwise("resolved")
    return ev.select("event_id", F.to_json(F.struct(F.array(alert(firing, F.col("feature")), alert(F.lit("resolved"), F.lit("noise"))).alias("alerts"))).alias("value"))


@query("S11_alert_source", f"WITH {EV} SELECT event_id, feature AS alertname, target AS node, 'f' || user_id AS fingerprint, t::VARCHAR AS starts_at FROM ev WHERE feature = 'error'")
def _(spark, sf):
    alerts = logs.firing_alerts(_payloads(spark, sf))
    return alerts.select("event_id", F.col("labels")["alertname"].alias("alertname"), F.col("labels")["node"].alias("node"), "fingerprint", F.col("startsAt").alias("starts_at"))


@query("S12_scrape_catalogue", """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'services' ELSE 'node-exporter' END AS job,
  CASE WHEN s_suppkey % 2 = 0 THEN 'gateway:9115' ELSE 'host-' || s_suppkey || ':9100' END AS address,
  CASE WHEN s_suppkey % 2 = 0 THEN 'host-' || s_suppkey || ':9100' ELSE '' END AS param_target,
  'instance="host-' || s_suppkey || ':9100",service="' || s_name || '"' AS labels FROM supplier""")
def _(spark, sf):
    probed = F.col("s_suppkey") % 2 == 0
    rows = read(spark, sf, "supplier").select(
        F.when(probed, "services").otherwise("node-exporter").alias("job"), F.format_string("host-%d:9100", "s_suppkey").alias("address"),
        F.create_map(F.lit("service"), "s_name").alias("labels"), probed.alias("probed"),
    )
    return logs.scrape_targets(rows, "gateway:9115").select("job", "address", "param_target", L.render_labels(F.col("labels")).alias("labels"))


_MANIFEST = """f AS (SELECT source AS set_name, 'doc-' || doc_id AS name, text, CASE WHEN doc_id % 97 = 5 THEN sha256(text || 'x') ELSE sha256(text) END AS sum,
   doc_id % 101 <> 7 AS present FROM documents)"""


@query("S13_manifest_scan", f"""WITH {_MANIFEST} SELECT set_name, count(*) AS files, count(*) FILTER (NOT present OR sum <> sha256(text)) AS bad,
  count(*) FILTER (NOT present OR sum <> sha256(text)) = 0 AS valid FROM f GROUP BY 1""")
def _(spark, sf):
    docs = read(spark, sf, "documents").select(
        F.col("source").alias("set_name"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "doc_id", F.encode("text", "utf-8").alias("content")
    )
    listed = docs.select("set_name", "name", F.when(F.col("doc_id") % 97 == 5, F.sha2(F.concat("content", F.encode(F.lit("x"), "utf-8")), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    found = docs.where(F.col("doc_id") % 101 != 7).drop("doc_id")
    return audit.valid_sets(audit.check_manifest(found, listed))


@query("S14_report_rows", """SELECT lang, count(*) AS n, sum(quality) AS detected, string_agg(DISTINCT quality || ':' || toxic, ';' ORDER BY quality || ':' || toxic) AS outcomes
  FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def _(spark, sf):
    joined = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    pair = F.concat_ws(":", F.col("quality").cast("string"), F.col("toxic").cast("string"))
    # the set of outcomes has four members at most
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("detected"), F.array_join(F.sort_array(F.collect_set(pair)), ";").alias("outcomes"))


# ---------------------------------------------------------------- projections, filters
def _labelled(spark, sf):
    ev = T.events(spark, sf)
    return ev.withColumn("labels", F.create_map(F.lit("node"), "target", F.lit("type"), "feature", F.lit("user"), F.col("user_id").cast("string")))


@query("P1_label_selector", f"""WITH {EV} SELECT event_id, target, feature, value FROM ev WHERE target <> 'node-3'
  AND NOT regexp_full_match(feature, 'view|sign.*') AND regexp_full_match(user_id::VARCHAR, '[0-9]*[02468]')""")
def _(spark, sf):
    chosen = L.select_labels(F.col("labels"), ("node", "!=", "node-3"), ("type", "!~", "view|sign.*"), None, ("user", "=~", "[0-9]*[02468]"), ("job", "=", ""))
    return _labelled(spark, sf).where(chosen).select("event_id", "target", "feature", "value")


@query("P2_comparison_filter", f"WITH {EV} SELECT event_id, target, value FROM ev WHERE value > 85 AND value <> 100")
def _(spark, sf):
    v = T.events(spark, sf).select("event_id", "target", "value")
    return vector.compare(vector.compare(v, ">", 85), "!=", 100)


@query("P3_plausibility", f"WITH {HOURLY} SELECT target, t FROM m WHERE click BETWEEN 0 AND 3 AND error BETWEEN 0 AND 2 AND view BETWEEN 0 AND 1000 AND purchase > 0")
def _(spark, sf):
    ok = features.plausible([(F.col("click"), 0, 3), (F.col("error"), 0, 2), (F.col("view"), 0, 1000)], F.col("purchase"))
    return T.hourly(spark, sf).where(ok).select("target", "t")


_MEANS = f"{EV}, a AS (SELECT target, t // 7200 * 7200 AS t, feature, avg(value) AS value, max(us) AS last FROM ev GROUP BY 1, 2, 3)"
_WIDE = "w AS (SELECT target, t, " + ", ".join(f"max(value) FILTER (feature = '{f}') AS {f}" for f in FEATURES) + ", max(last) AS last FROM a GROUP BY 1, 2)"


def _means(spark, sf):
    ev = T.events(spark, sf).select("target", (F.expr("t div 7200") * 7200).alias("t"), "feature", "value", "us")
    return ev.groupBy("target", "t", "feature").agg(F.avg("value").alias("value"), F.max("us").alias("last"))


@query("P4_quality_gate", f"""WITH {_MEANS}, {_WIDE}, g AS (SELECT target, t, CASE
    WHEN click IS NULL THEN 'missing:click' WHEN NOT click BETWEEN 0 AND 120 THEN 'implausible:click'
    WHEN view IS NULL THEN 'missing:view' WHEN NOT view BETWEEN 5 AND 150 THEN 'implausible:view'
    WHEN t + 7200 - last / 1000000 > 600 THEN 'stale:events' END AS reason FROM w)
  SELECT target, t, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS quality, coalesce(reason, '') AS reason FROM g""")
def _(spark, sf):
    wide = _means(spark, sf).groupBy("target", "t").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in ("click", "view")], F.max("last").alias("last")
    )
    age = F.col("t") + 7200 - F.col("last") / 1_000_000
    reason = features.quality([("click", 0, 120), ("view", 5, 150)], [("events", age)], 600)
    return wide.select("target", "t", F.when(reason.isNull(), 1).otherwise(0).alias("quality"), F.coalesce(reason, F.lit("")).alias("reason"))


@query("P5_spec_projection", f"""WITH {_MEANS}, spec(target, ord, feature) AS (SELECT 'node-' || n, o, f FROM (VALUES (0, 0, 'view'), (0, 1, 'error'), (1, 0, 'click'), (1, 1, 'signup'), (2, 0, 'purchase'), (3, 0, 'error')) x(n, o, f)),
  k AS (SELECT DISTINCT target, t FROM a)
  SELECT k.target, k.t, spec.ord, spec.feature, round(CASE WHEN spec.feature = 'signup' THEN coalesce(a.value, 0) ELSE a.value END, 6) AS value
  FROM k JOIN spec USING (target) LEFT JOIN a ON a.target = k.target AND a.t = k.t AND a.feature = spec.feature""")
def _(spark, sf):
    one = lambda *names: [(n, 0.0, 1e9, 1.0, "both", V.INF) for n in names]
    spec = features.spec_table(
        spark, {"node-0": ("node", one("view", "error")), "node-1": ("node", one("click", "signup")), "node-2": ("node", one("purchase")), "node-3": ("node", one("error"))}
    )
    long = cut(_means(spark, sf).select("target", "t", "feature", "value"))
    return features.project(long, spec, ["signup"]).select("target", "t", "ord", "feature", F.round("value", 6).alias("value"))


_FLEET_SPEC = {
    **{f"node-{n}": ("node", features.node_spec(n < 2)) for n in range(4)},
    "appli-shop": ("application", features.application_spec(["api"], base=True)),
}
_REACH, _LOOKBACK = 4 * 3600, 5 * 3600
_BOXES = ("server", "postgres", "POD", "api", "postgres", "")


def raw_samples(spark, sf):
    """The events read as raw metric samples: of every event type the series of (node, sub), at the seconds of its events."""
    seen = T.events(spark, sf).groupBy("feature", F.col("target").alias("node"), (F.col("user_id") % 6).alias("sub"), "t").agg(F.max("value").alias("v"))
    node, sub, v, up = F.col("node"), F.col("sub"), F.col("v"), F.col("t") % 604800
    text = sub.cast("string")
    box = F.element_at(F.array(*[F.lit(b) for b in _BOXES]), (sub + 1).cast("int"))
    space = F.when(sub < 3, "default").otherwise("shop")

    def sample(feature, name, value, when=None, **labels):
        pairs = [x for k, c in labels.items() for x in (F.lit(k), F.lit(c) if isinstance(c, str) else c)]
        made = F.struct(F.lit(name).alias("name"), F.create_map(*pairs).cast("map<string,string>").alias("labels"), value.cast("double").alias("value"))
        return F.when((F.col("feature") == feature) & (F.lit(True) if when is None else when), made)

    pod = {"job": "cadvisor-k3s", "node": node, "container_label_io_kubernetes_pod_namespace": space, "container_label_io_kubernetes_container_name": box}
    probe = {"job": "applications", "application": "shop", "instance": F.concat(node, text)}
    made = [
        sample("view", "node_memory_MemAvailable_bytes", v, node=node, instance=text),
        sample("view", "node_memory_MemTotal_bytes", 2 * v + 50, node=node, instance=text),
        sample("click", "node_cpu_seconds_total", up * 0.75, node=node, cpu=text, mode=F.when(sub < 4, "idle").otherwise("user")),
        sample("error", "node_network_receive_bytes_total", up * 2048, node=node, device=F.when(sub < 2, "lo").when(sub < 4, "veth1").otherwise(F.concat(F.lit("eth"), text))),
        sample("purchase", "container_memory_working_set_bytes", v * 1048576, **pod),
        sample("purchase", "container_cpu_usage_seconds_total", up * 0.25, **pod),
        sample("signup", "probe_success", (F.col("t") % 10 != 0).cast("int"), sub < 3, **probe),
        sample("signup", "probe_duration_seconds", v / 100, sub < 3, **probe),
        sample("signup", "node_filesystem_avail_bytes", v, sub >= 3, node=node, device=text, mountpoint="/", fstype="ext4"),
        sample("signup", "node_filesystem_size_bytes", v + 100, sub >= 3, node=node, device=text, mountpoint="/", fstype="ext4"),
    ]
    return seen.select("t", F.explode(F.array_compact(F.array(*made))).alias("m")).select("t", "m.*")


_SPEC_ROWS = ", ".join(f"('{target}', {i}, '{f[0]}')" for target, (_, spec) in _FLEET_SPEC.items() for i, f in enumerate(spec))


@query("P5_metric_features", f"""WITH {T.EV},
  sn AS (SELECT feature AS kind, target AS node, user_id % 6 AS sub, t, max(value) AS v FROM ev GROUP BY ALL),
  sm AS (SELECT *, t % 604800 AS up, lag(t % 604800) OVER (PARTITION BY kind, node, sub ORDER BY t) AS was FROM sn),
  tk AS (SELECT kind, node, sub, unnest(generate_series((min(t) + 3599) // 3600 * 3600, (max(t) + {_LOOKBACK}) // 3600 * 3600, 3600)) AS t FROM sn GROUP BY kind, node, sub),
  nw AS (SELECT tk.*, s.v, s.t AS seen FROM tk ASOF JOIN sn s ON s.kind = tk.kind AND s.node = tk.node AND s.sub = tk.sub AND s.t <= tk.t WHERE tk.t - s.t < {_LOOKBACK}),
  rt AS (SELECT tk.kind, tk.node, tk.sub, tk.t, (sum(CASE WHEN was IS NULL THEN 0 WHEN up < was THEN up ELSE up - was END) - arg_min(CASE WHEN was IS NULL THEN 0 WHEN up < was THEN up ELSE up - was END, s.t)) AS grown, max(s.t) - min(s.t) AS span
    FROM tk JOIN sm s ON s.kind = tk.kind AND s.node = tk.node AND s.sub = tk.sub AND s.t > tk.t - {_REACH} AND s.t <= tk.t GROUP BY ALL),
  rr AS (SELECT kind, node, sub, t, grown / span AS rate FROM rt WHERE span > 0),
  al AS (SELECT nw.*, rate, {list(_BOXES)}[sub + 1] AS box FROM nw LEFT JOIN rr USING (kind, node, sub, t)),
  vals AS (
    SELECT node AS target, t, 'cpu_host' AS feature, 100 - avg(rate * 0.75) * 100 AS value FROM al WHERE kind = 'click' AND sub < 4 AND rate IS NOT NULL GROUP BY ALL
    UNION ALL SELECT node, t, 'ram_host', (1 - avg(v) / avg(2 * v + 50)) * 100 FROM al WHERE kind = 'view' GROUP BY ALL
    UNION ALL SELECT node, t, 'disk_host', (1 - avg(v) / avg(v + 100)) * 100 FROM al WHERE kind = 'signup' AND sub >= 3 GROUP BY ALL
    UNION ALL SELECT node, t, 'net_rx_kb', sum(rate * 2) FROM al WHERE kind = 'error' AND sub >= 4 AND rate IS NOT NULL GROUP BY ALL
    UNION ALL SELECT node, t, 'cpu_server', sum(rate * 25) FROM al WHERE kind = 'purchase' AND sub = 0 AND rate IS NOT NULL GROUP BY ALL
    UNION ALL SELECT node, t, 'ram_server_mb', sum(v) FROM al WHERE kind = 'purchase' AND sub = 0 GROUP BY ALL
    UNION ALL SELECT node, t, 'ram_postgres_mb', sum(v) FROM al WHERE kind = 'purchase' AND sub = 1 GROUP BY ALL
    UNION ALL SELECT node, t, 'app_containers', count(DISTINCT box) FROM al WHERE kind = 'purchase' AND sub < 2 GROUP BY ALL
    UNION ALL SELECT 'appli-shop', t, 'cpu_api', sum(rate * 25) FROM al WHERE kind = 'purchase' AND sub = 3 AND rate IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'appli-shop', t, 'ram_api_mb', sum(v) FROM al WHERE kind = 'purchase' AND sub = 3 GROUP BY ALL
    UNION ALL SELECT 'appli-shop', t, 'ram_base_mb', sum(v) FROM al WHERE kind = 'purchase' AND sub = 4 GROUP BY ALL
    UNION ALL SELECT 'appli-shop', t, 'app_containers', count(DISTINCT box) FROM al WHERE kind = 'purchase' AND sub IN (3, 4) GROUP BY ALL
    UNION ALL SELECT 'appli-shop', t, 'web_ok', min((seen % 10 <> 0)::INT) FROM al WHERE kind = 'signup' AND sub < 3 GROUP BY ALL
    UNION ALL SELECT 'appli-shop', t, 'web_ms', max(v / 100) * 1000 FROM al WHERE kind = 'signup' AND sub < 3 GROUP BY ALL),
  spec(target, ord, feature) AS (VALUES {_SPEC_ROWS}), k AS (SELECT DISTINCT target, t FROM vals)
  SELECT k.target, k.t, spec.ord, spec.feature, round(coalesce(value, CASE WHEN spec.feature NOT IN {formulas.MEASURED} THEN 0 END), 6) + 0 AS value
  FROM k JOIN spec USING (target) LEFT JOIN vals ON vals.target = k.target AND vals.t = k.t AND vals.feature = spec.feature""")
def _(spark, sf):
    spec = features.spec_table(spark, _FLEET_SPEC)
    out = formulas.features_of(raw_samples(spark, sf), spec, HOUR, _REACH, _LOOKBACK, width=24 * HOUR)
    return out.select("target", "t", "ord", "feature", (F.round("value", 6) + 0).alias("value"))


@query("P6_target_catalogue", """WITH c AS (SELECT c_custkey, lower(replace(c_name, '#', CASE WHEN c_custkey % 9 = 0 THEN '_' ELSE '-' END)) AS app, lower(c_mktsegment) AS seg, c_custkey % 7 = 0 AS base, c_custkey % 11 = 0 AS twice
    FROM (SELECT c_custkey - c_custkey % 13 // 12 AS k, * FROM customer)),
  n AS (SELECT *, CASE WHEN c_custkey % 1000 < 2 THEN 'shared' ELSE app END AS name FROM c),
  d AS (SELECT *, count(*) OVER (PARTITION BY name) AS copies FROM n)
  SELECT c_custkey, concat_ws(',', CASE WHEN NOT regexp_full_match('appli-' || name, '[a-z0-9][a-z0-9-]{0,62}') THEN 'name' END,
    CASE WHEN NOT regexp_full_match(name, '[a-z0-9]([-a-z0-9]{0,61}[a-z0-9])?') THEN 'application' END,
    CASE WHEN base THEN 'component' END, CASE WHEN twice THEN 'duplicate_component' END, CASE WHEN copies > 1 THEN 'duplicate_target' END) AS errors FROM d""")
def _(spark, sf):
    c = read(spark, sf, "customer")
    app = F.lower(F.replace("c_name", F.lit("#"), F.when(F.col("c_custkey") % 9 == 0, "_").otherwise("-")))
    seg = F.lower("c_mktsegment")
    parts = F.array_compact(F.array(seg, F.when(F.col("c_custkey") % 7 == 0, "base"), F.when(F.col("c_custkey") % 11 == 0, seg)))
    item = F.to_json(F.struct(F.when(F.col("c_custkey") % 1000 < 2, "shared").otherwise(app).alias("application"), parts.alias("composants")))
    parsed = c.select("c_custkey", F.from_json(item, "application string, composants array<string>").alias("j")).select("c_custkey", "j.*")
    # copies are counted by a mergeable aggregate, never by gathering the targets of one name
    copies = parsed.groupBy("application").agg(F.count("*").alias("copies"))
    errors = inventory.target_errors(F.concat(F.lit(V.APP_PREFIX), "application"), F.col("application"), F.col("composants"), F.col("copies"))
    return parsed.join(copies, "application").select("c_custkey", F.array_join(errors, ",").alias("errors"))


@query("P7_application_catalogue", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([a-z]+)', 1) AS host FROM pages),
  e AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'argocd' ELSE host END AS name, regexp_replace(url, '[?#].*$', '') AS clean, url, page_id % 6 = 0 AS odd FROM p),
  f AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN clean ELSE url END AS u, CASE WHEN odd THEN 'Base 1' ELSE 'base_' || page_id END AS base_name FROM e)
  SELECT page_id, concat_ws(',', CASE WHEN NOT regexp_full_match(name, '[a-z][a-z0-9-]{1,30}[a-z0-9]') THEN 'name' END,
   CASE WHEN name IN ('default','kube-system','kube-public','kube-node-lease','argocd','plateforme') THEN 'reserved' END,
   CASE WHEN NOT regexp_full_match(base_name, '[a-z_][a-z0-9_]{0,62}') THEN 'base_name' END,
   CASE WHEN u <> '' AND NOT regexp_full_match(u, 'https?://[a-z0-9.-]+(:[0-9]{1,5})?/[A-Za-z0-9/._~-]*') THEN 'url' END) AS errors FROM f""")
def _(spark, sf):
    p = read(spark, sf, "pages").select("page_id", "url")
    name = F.when(F.col("page_id") % 10 == 0, "argocd").otherwise(F.regexp_extract("url", "://([a-z]+)", 1))
    url = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "[?#].*$", "")).otherwise(F.col("url"))
    base = F.when(F.col("page_id") % 6 == 0, "Base 1").otherwise(F.concat(F.lit("base_"), F.col("page_id").cast("string")))
    errors = inventory.catalogue_errors(name, F.array(F.lit("api"), F.lit("site")), base, url)
    return p.select("page_id", F.array_join(errors, ",").alias("errors"))


_REGIME = "CASE WHEN target = 'node-2' THEN 1706600000 WHEN target = 'node-1' THEN 1706000000 ELSE 0 END"


@query("P8_training_window", f"WITH {EV} SELECT target, count(*) AS n, min(t) AS first_t FROM ev WHERE t >= greatest({END} - 72 * 3600, {_REGIME}) GROUP BY 1")
def _(spark, sf):
    models = spark.createDataFrame([("node-2", 1706600000), ("node-1", 1706000000)], "target string, regime_start long")
    joined = T.events(spark, sf).select("target", "t").join(models, "target", "left")
    return series.training_window(joined, END, 72, F.col("regime_start")).groupBy("target").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query("P9_thinning", f"WITH {HOURLY} SELECT target, t, click FROM m WHERE ((t - 1704067200) // 3600) % 2 = 0")
def _(spark, sf):
    return T.hourly(spark, sf).where(series.thin(F.col("t"), 1704067200, HOUR)).select("target", "t", "click")


@query("P10_exclude_interrupted", """SELECT o_orderpriority AS scenario, count(*) AS windows, count(*) FILTER (o_orderstatus <> 'P') AS counted,
  round(sum(o_totalprice) FILTER (o_orderstatus <> 'P'), 2) AS total FROM orders GROUP BY 1""")
def _(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), "o_totalprice", (F.col("o_orderstatus") == "P").alias("interrompue"))
    windows, counted = evaluate.campaign_windows(orders)
    left = windows.groupBy("scenario").agg(F.count("*").alias("windows"))
    right = counted.groupBy("scenario").agg(F.count("*").alias("counted"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return left.join(right, "scenario", "left")


@query("P11_safe_projection", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").drop("c_acctbal")


# ---------------------------------------------------------------- joins
@query("J1_timestamp_inner_join", f"""WITH {_MEANS}, {_WIDE} SELECT target, t, {", ".join(f"round({f}, 6) AS {f}" for f in FEATURES)}
  FROM w WHERE {" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)}""")
def _(spark, sf):
    wide = series.inner_matrix(_means(spark, sf).drop("last"), ["target", "t"], FEATURES)
    return wide.select("target", "t", *[F.round(f, 6).alias(f) for f in FEATURES])


@query("J2_group_left", """SELECT c_custkey, n_name, round(c_acctbal * n_regionkey, 4) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0""")
def _(spark, sf):
    balance = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("node"), F.col("c_acctbal").alias("value"))
    info = read(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), "n_name", F.col("n_regionkey").cast("double").alias("value"))
    joined = vector.many_to_one(vector.compare(balance, ">", 0), info, ["node"], ["n_name"])
    return joined.select("c_custkey", "n_name", F.round("value", 4).alias("value"))


@query("J3_anti_join", f"WITH {HOURLY} SELECT target, t, error AS value FROM m x WHERE error > 0 AND NOT EXISTS (SELECT 1 FROM m y WHERE y.target = x.target AND y.t = x.t AND y.view > 0)")
def _(spark, sf):
    m = T.hourly(spark, sf)
    left = m.where("error > 0").select("target", "t", F.col("error").alias("value"))
    return vector.unless(left, m.where("view > 0"), ["target", "t"])


@query("J4_semi_join", "SELECT c_custkey, c_acctbal AS value FROM customer WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def _(spark, sf):
    low = read(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey", F.col("c_acctbal").alias("value"))
    open_orders = read(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return vector.and_on(low, open_orders, ["c_custkey"])


@query("J5_outer_merge", """WITH a AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
  b AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1), c AS (SELECT n_nationkey AS nation, n_name AS name FROM nation WHERE n_regionkey < 3)
  SELECT nation, customers, suppliers, name FROM a FULL JOIN b USING (nation) FULL JOIN c USING (nation)""")
def _(spark, sf):
    a = read(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = read(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))
    return vector.outer_merge([a, b, c], ["nation"])


@query("J6_asof_join", f"WITH {_SERIES}, {_grid_sql(6 * HOUR, 5 * HOUR, 'user_id')} SELECT user_id, t, value, age FROM got")
def _(spark, sf):
    s = _user_series(spark, sf)
    ticks = series.tick_grid(s, ["user_id"], 6 * HOUR)
    return series.asof(ticks, s, ["user_id"], ["value"], 5 * HOUR, width=T.width(s, ["user_id"])).select("user_id", "t", "value", "age")


_WINDOWS = f"{EV}, e AS (SELECT user_id, t, event_id FROM ev WHERE feature = 'error'), w AS (SELECT user_id, t AS t0, t + 7200 AS t1 FROM ev WHERE feature = 'purchase')"


@query("J7_interval_join", f"WITH {_WINDOWS} SELECT event_id, user_id, t, EXISTS (SELECT 1 FROM w WHERE w.user_id = e.user_id AND e.t BETWEEN w.t0 - 15 AND w.t1 + 600) AS covered FROM e")
def _(spark, sf):
    ev = T.events(spark, sf)
    error, purchase = F.col("feature") == "error", F.col("feature") == "purchase"
    return detect.covered_by_of(ev, ["user_id"], error, {"event_id": F.col("event_id")}, purchase, F.col("t") - 15, F.col("t") + 7800)


@query("J8_first_hit", f"""WITH {_WINDOWS} SELECT user_id, t0, (SELECT min(e.t) FROM e WHERE e.user_id = w.user_id AND e.t BETWEEN w.t0 AND w.t1 + 3600) - t0 AS delay FROM w""")
def _(spark, sf):
    ev = T.events(spark, sf)
    spans = (F.col("feature") == "purchase", {"t0": F.col("t"), "t1": F.col("t") + 7200 + HOUR})
    found = detect.first_in_window_of(ev, ["user_id"], F.col("feature") == "error", [spans], "t0", "t1")
    return found.select("user_id", "t0", (F.col("first_hit") - F.col("t0")).alias("delay"))


@query("J9_maintenance_lookup", f"""WITH {HOURLY}, mt AS (SELECT target, t, max(value) AS until FROM (SELECT target, t // 3600 * 3600 AS t, t + value AS value FROM ev WHERE feature = 'signup') GROUP BY 1, 2)
  SELECT m.target, m.t, m.click, round(mt.until, 6) AS until FROM m LEFT JOIN mt USING (target, t)""")
def _(spark, sf):
    ev = T.events(spark, sf).where("feature = 'signup'")
    announced = ev.select("target", (F.expr("t div 3600") * HOUR).alias("t"), (F.col("t") + F.col("value")).alias("u")).groupBy("target", "t").agg(F.round(F.max("u"), 6).alias("until"))
    return T.hourly(spark, sf).select("target", "t", "click").join(announced, ["target", "t"], "left")


_DAILY_POINTS = f"{HOURLY}, p AS (SELECT target, t // 86400 AS day, (t % 86400) / 3600.0::DOUBLE AS x, click + error + purchase + signup + view AS y FROM m)"
_SLOPES = "pairs AS (SELECT a.target, a.day, (b.y - a.y) / (b.x - a.x) AS s FROM p a JOIN p b ON a.target = b.target AND a.day = b.day AND a.x < b.x)"


def day_points(spark, sf):
    total = sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0]))
    return T.hourly(spark, sf).select("target", F.expr("t div 86400").alias("day"), ((F.col("t") % 86400) / 3600.0).alias("t"), total.alias("y"))


@query("J10_pairwise_slopes", f"WITH {_DAILY_POINTS}, {_SLOPES} SELECT target, day, count(*) AS pairs, round(quantile_cont(s, 0.5), 6) AS slope FROM pairs GROUP BY 1, 2")
def _(spark, sf):
    fitted = slopes.theil_sen(day_points(spark, sf), ["target", "day"]).where("n > 1")
    return fitted.select("target", "day", F.expr("n * (n - 1) div 2").alias("pairs"), F.round("slope", 6).alias("slope"))


@query("J11_parameter_grid", f"""WITH {EV}, g AS (SELECT lam, k, n, z FROM (VALUES (0.2), (0.3), (0.4)) a(lam), (VALUES (3, 4), (4, 6), (5, 8)) b(k, n), (VALUES (3.5), (4.0), (4.5), (5.0)) c(z))
  SELECT lam::DOUBLE AS lam, k::INT AS k, n::INT AS n, z::DOUBLE AS z_high, target, count(*) FILTER (value > z * 20) AS hits FROM ev, g GROUP BY ALL""")
def _(spark, sf):
    # counts per limit first: the grid multiplies four rows per node, not the events
    ev = T.events(spark, sf)
    counts = ev.groupBy("target").agg(*[F.count_if(F.col("value") > z * 20).alias(f"h{i}") for i, z in enumerate(V.GRID_Z_HIGH)])
    hits = F.array(*[F.col(f"h{i}") for i in range(len(V.GRID_Z_HIGH))])
    at = F.array_position(F.array(*[F.lit(z) for z in V.GRID_Z_HIGH]), F.col("g.z_high")).cast("int")
    spread = counts.select("target", hits.alias("h"), F.explode(evaluate.grid()).alias("g"))
    return spread.select("g.lam", "g.k", "g.n", "g.z_high", "target", F.element_at("h", at).alias("hits"))


@query("J12_undeclared_services", "SELECT p_partkey, p_name FROM part WHERE p_brand || '/' || p_type NOT IN (SELECT DISTINCT p_brand || '/' || p_type FROM part WHERE p_size > 40)")
def _(spark, sf):
    part = read(spark, sf, "part").withColumn("cible", F.concat_ws("/", "p_brand", "p_type"))
    return vector.unless(part, part.where("p_size > 40"), ["cible"]).select("p_partkey", "p_name")


@query("J13_known_inventory", "SELECT s_suppkey, coalesce(n_name, '') AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON s_nationkey = n_nationkey")
def _(spark, sf):
    known = read(spark, sf, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read(spark, sf, "supplier").join(known, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("name"))


@query("J14_reconciliation", """WITH a AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT % 9 AS n FROM orders WHERE o_orderkey % 17 <> 3), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT k, a.n AS before, b.n AS after FROM a FULL JOIN b USING (k) WHERE a.n IS DISTINCT FROM b.n""")
def _(spark, sf):
    before = read(spark, sf, "orders").where("o_orderkey % 17 <> 3").select(F.col("o_orderkey").alias("k"), (F.floor("o_totalprice").cast("long") % 9).alias("n"))
    after = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return audit.reconcile(before, after, ["k"])


@query("J15_author_listing", "SELECT c_custkey, c_name, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS day FROM customer JOIN orders ON c_custkey = o_custkey ORDER BY c_custkey, o_orderdate DESC")
def _(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", T.days("o_orderdate").alias("day"))
    return read(spark, sf, "customer").select("c_custkey", "c_name").join(orders, "c_custkey").orderBy("c_custkey", F.col("day").desc())


@query("J16_diagnosis_lookup", f"""WITH {EV}, a AS (SELECT event_id, user_id, us AS t FROM ev WHERE feature = 'error'), d AS (SELECT user_id, us AS t, feature AS top_feature, value AS z FROM ev WHERE feature <> 'error')
  SELECT a.event_id, coalesce(d.top_feature, '') AS feature, d.z FROM a ASOF LEFT JOIN d USING (user_id, t)""")
def _(spark, sf):
    ev = T.events(spark, sf).select("event_id", "user_id", F.col("us").alias("t"), "feature", "value")
    alert, found = F.col("feature") == "error", {"top_feature": F.col("feature"), "z": F.col("value")}
    out = series.asof_of(ev, ["user_id"], alert, {"event_id": F.col("event_id")}, ~alert, found, probe=HOUR * 1_000_000)
    return out.select("event_id", F.coalesce("top_feature", F.lit("")).alias("feature"), "z")


# ---------------------------------------------------------------- set operations
@query("U1_label_or", """WITH a AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS v FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 15 GROUP BY 1),
  b AS (SELECT s_nationkey AS nation, avg(s_acctbal) AS v FROM supplier GROUP BY 1)
  SELECT nation, round(v, 4) AS value FROM a UNION ALL SELECT nation, round(v, 4) FROM b WHERE nation NOT IN (SELECT nation FROM a)""")
def _(spark, sf):
    a = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("v"))
    b = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("v"))
    return vector.or_on(a, b, ["nation"]).select("nation", F.round("v", 4).alias("value"))


@query("U2_absent", f"WITH {HOURLY} SELECT DISTINCT t, 'engine' AS job, 1.0::DOUBLE AS value FROM m WHERE t NOT IN (SELECT t FROM m WHERE error > 2)")
def _(spark, sf):
    m = T.hourly(spark, sf)
    return vector.absent(m.select("t").distinct(), m.where("error > 2"), ["t"], {"job": "engine"})


@query("U3_timestamp_intersection", f"""WITH {EV} SELECT target, t // 600 AS t FROM ev WHERE feature = 'click' INTERSECT SELECT target, t // 600 FROM ev WHERE feature = 'error'""")
def _(spark, sf):
    ev = T.events(spark, sf).select("target", F.expr("t div 600").alias("t"), "feature")
    return ev.where("feature = 'click'").select("target", "t").intersect(ev.where("feature = 'error'").select("target", "t"))


@query("U4_port_difference", """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity::INT NOT IN (22, 53) THEN l_quantity::INT END,
  CASE WHEN l_quantity::INT + 3 NOT IN (22, 53) THEN l_quantity::INT + 3 END) AS others FROM lineitem""")
def _(spark, sf):
    q = F.col("l_quantity").cast("int")
    text = F.concat_ws(" ", (q + 3).cast("string"), q.cast("string"), F.lit("x"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(inventory.other_ports(text).cast("array<string>"), ",").alias("others"))


@query("U5_carry_forward", f"""WITH {EV}, f AS (SELECT DISTINCT user_id, feature FROM ev WHERE t >= {MID} AND user_id % 3 <> 1), p AS (SELECT DISTINCT user_id, feature FROM ev WHERE t < {MID})
  SELECT user_id, feature, 'new' AS origin FROM f UNION ALL SELECT user_id, feature, 'kept' FROM p WHERE user_id NOT IN (SELECT user_id FROM f)""")
def _(spark, sf):
    ev = T.events(spark, sf).select("user_id", "feature", "t")
    fresh = ev.where((F.col("t") >= MID) & (F.col("user_id") % 3 != 1)).select("user_id", "feature").distinct().withColumn("origin", F.lit("new"))
    previous = ev.where(F.col("t") < MID).select("user_id", "feature").distinct().withColumn("origin", F.lit("kept"))
    return audit.carry_snapshot(fresh, previous, fresh, "user_id")


# ---------------------------------------------------------------- sorts, limits
@query("O1_top_feature", f"WITH {T.SCORED} SELECT target, t, top_feature, round(top_z, 6) AS top_z FROM zs")
def _(spark, sf):
    return T.scored(spark, sf).select("target", "t", "top_feature", F.round("top_z", 6).alias("top_z"))


@query("O2_grid_ranking", """WITH s AS (SELECT o_orderpriority || o_orderstatus AS setting, count(*) FILTER (o_totalprice > 300000) AS a, count(*) AS n, min(o_custkey) AS d1, min(o_orderkey) AS d2 FROM orders GROUP BY 1),
  r AS (SELECT setting, a % 7 < 5 AS feasible, round(a / n * 1.0, 6) AS alerts_per_day, CASE WHEN d1 = 0 THEN 9999 ELSE d1 END + CASE WHEN d2 = 0 THEN 9999 ELSE d2 END AS total_delay FROM s)
  SELECT * FROM r ORDER BY NOT feasible, alerts_per_day, total_delay, setting LIMIT 1""")
def _(spark, sf):
    o = read(spark, sf, "orders")
    facts = o.groupBy(F.concat("o_orderpriority", "o_orderstatus").alias("setting")).agg(
        F.count_if(F.col("o_totalprice") > 300000).alias("a"), F.count("*").alias("n"), F.min("o_custkey").alias("d1"), F.min("o_orderkey").alias("d2")
    )
    results = facts.select("setting", (F.col("a") % 7 < 5).alias("feasible"), F.round(F.col("a") / F.col("n"), 6).alias("alerts_per_day"), F.array("d1", "d2").alias("delays"))
    return evaluate.rank_grid(results).limit(1).select("setting", "feasible", "alerts_per_day", "total_delay")


@query("O3_newest_first", "SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 86400000000 AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_custkey", T.days("o_orderdate").alias("day"))
    return logs.tail(rows, [F.col("day").desc(), F.col("o_orderkey")], 25)


@query("O4_signal_timeline", """SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_transform(list_sort([
    {v: l_quantity, k: 'ia'}, {v: round(l_discount * 500), k: 'zscore'}, {v: round(l_tax * 700), k: 'seuil'}]), lambda e: e.k || ' ' || e.v::INT || ' s'), ' / ') AS timeline FROM lineitem""")
def _(spark, sf):
    li = read(spark, sf, "lineitem")
    signals = F.create_map(F.lit("ia"), "l_quantity", F.lit("zscore"), F.round(F.col("l_discount") * 500).cast("int").cast("double"), F.lit("seuil"), F.round(F.col("l_tax") * 700).cast("int").cast("double"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", evaluate.timeline(signals).alias("timeline"))


@query("O5_hash_sample", "SELECT event_id, value FROM events ORDER BY md5(event_id || '-42') LIMIT 5000")
def _(spark, sf):
    return summaries.keep_hashed(read(spark, sf, "events").select("event_id", "value"), F.col("event_id"), 42, V.TRAIN_SCORES_CAP)


