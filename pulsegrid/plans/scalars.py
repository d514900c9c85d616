"""Queries: scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schemas
from pulsegrid.functions import inventory, labels as L, stats as S
from pulsegrid.operators import audit, lifecycle, series, slopes
from pulsegrid.plans import tables as T
from pulsegrid.plans.aggregates import THEIL
from pulsegrid.plans.registry import query
from pulsegrid.plans.scans import day_points
from pulsegrid.plans.tables import BASE, END, EV, SCORED, read


def _modelled(spark, sf):
    """One row per (target, t, feature) with the model values beside it."""
    base = T.rows(spark, sf)
    joined = lifecycle.attach(base, lifecycle.fit_baseline(base, T.SPEC))
    return lifecycle.deviations(joined).select(
        "target", "t", F.explode(F.arrays_zip("names", "x", "z", "zdir", "median", "mad", "directions", "min_effects")).alias("f")
    ).select("target", "t", F.col("f.names").alias("feature"), "f.x", "f.z", "f.zdir", "f.median", "f.mad", "f.directions", "f.min_effects")


@query("F1_robust_z", f"WITH {SCORED} SELECT target, t, feature, round(z, 6) AS z FROM zl")
def _(spark, sf):
    rows = _modelled(spark, sf)
    return rows.select("target", "t", "feature", F.round(S.robust_z(F.col("x"), F.col("median"), F.col("mad")), 6).alias("z"))


@query("F2_significance_floor", f"WITH {BASE} SELECT target, feature, round(mad_raw, 6) AS mad_raw, round(mad, 6) AS mad FROM model")
def _(spark, sf):
    models = lifecycle.fit_baseline(T.rows(spark, sf), T.SPEC)
    f = models.select("target", F.explode(F.arrays_zip("names", "mad_raw", "mad")).alias("f"))
    return f.select("target", F.col("f.names").alias("feature"), F.round("f.mad_raw", 6).alias("mad_raw"), F.round("f.mad", 6).alias("mad"))


@query("F3_directional_deviation", f"WITH {SCORED} SELECT target, t, feature, round(dev, 6) AS dev FROM zl")
def _(spark, sf):
    rows = _modelled(spark, sf)
    return rows.select("target", "t", "feature", F.round(S.directional(F.col("x") - F.col("median"), F.col("directions")), 6).alias("dev"))


@query("F4_directional_z_max", f"WITH {SCORED} SELECT target, t, round(z_max, 6) AS z_max FROM zs")
def _(spark, sf):
    return T.scored(spark, sf).select("target", "t", F.round("z_max", 6).alias("z_max"))


@query("F5_combined_effect", f"WITH {SCORED} SELECT target, t, round(effect, 6) AS effect, effect >= 1 AS relevant FROM zs")
def _(spark, sf):
    return T.scored(spark, sf).select("target", "t", F.round("effect", 6).alias("effect"), (F.col("effect") >= 1).alias("relevant"))


@query("F6_benign_clamp", f"""WITH {BASE} SELECT target, t, l.feature, round(CASE direction WHEN 'up' THEN greatest(value, median) WHEN 'down' THEN least(value, median) ELSE value END, 6) AS clamped
  FROM l JOIN model USING (target, feature)""")
def _(spark, sf):
    rows = _modelled(spark, sf)
    return rows.select("target", "t", "feature", F.round(S.benign_clamp(F.col("x"), F.col("median"), F.col("directions")), 6).alias("clamped"))


@query("F7_cyclic_hour", f"WITH {EV} SELECT event_id, round(sin(2 * pi() * (t % 86400) / 86400), 6) + 0 AS s, round(cos(2 * pi() * (t % 86400) / 86400), 6) + 0 AS c FROM ev")
def _(spark, sf):
    s, c = S.cyclic_hour(F.col("t"))
    return T.events(spark, sf).select("event_id", (F.round(s, 6) + 0).alias("s"), (F.round(c, 6) + 0).alias("c"))


@query("F8_average_path", f"""WITH {EV}, n AS (SELECT user_id, t // 86400 AS day, count(*) AS n FROM ev GROUP BY 1, 2)
  SELECT user_id, day, n, round(CASE WHEN n > 2 THEN 2 * (ln(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n WHEN n = 2 THEN 1 ELSE 0 END, 6) AS c FROM n""")
def _(spark, sf):
    n = T.events(spark, sf).groupBy("user_id", F.expr("t div 86400").alias("day")).agg(F.count("*").alias("n"))
    return n.select("user_id", "day", "n", F.round(S.c_n(F.col("n")), 6).alias("c"))


@query("F9_vote_probability", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS p FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, round(4 * p ** 3 * (1 - p) + p ** 4, 8) AS three_of_four, round(56 * p ** 5 * (1 - p) ** 3 + 28 * p ** 6 * (1 - p) ** 2 + 8 * p ** 7 * (1 - p) + p ** 8, 8) AS five_of_eight FROM p""")
def _(spark, sf):
    p = F.col("l_discount")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(S.kofn_probability(p, 3, 4), 8).alias("three_of_four"), F.round(S.kofn_probability(p, 5, 8), 8).alias("five_of_eight"),
    )


@query("F10_hours_to_saturation", f"""WITH {THEIL}, h AS (SELECT target, day, slope, r2, intercept + slope * last_x AS level FROM ts)
  SELECT target, day, round(CASE WHEN slope > 1e-9 THEN greatest(0, least((100 - level) / slope, 8760)) ELSE 8760 END, 4) AS hours, slope > 1e-9 AND r2 >= 0.01 AS reliable FROM h""")
def _(spark, sf):
    fit = slopes.theil_sen(day_points(spark, sf), ["target", "day"]).where("n > 1")
    hours, reliable = S.hours_to_saturation(F.col("slope"), F.col("intercept") + F.col("slope") * F.col("last_t"), F.col("r2"), min_r2=0.01)
    return fit.select("target", "day", F.round(hours, 4).alias("hours"), reliable.alias("reliable"))


@query("F11_maintenance", f"WITH {EV} SELECT event_id, value * 40 > 0 AND value * 40 <= 1860 AS maintenance FROM ev")
def _(spark, sf):
    ev = T.events(spark, sf)
    return ev.select("event_id", S.maintenance_announced(F.col("t") + F.col("value") * 40, F.col("t")).alias("maintenance"))


@query("F12_freshness_age", f"WITH {EV} SELECT user_id, feature, {END} - max(t) AS age FROM ev GROUP BY 1, 2")
def _(spark, sf):
    latest = series.instant(T.events(spark, sf), ["user_id", "feature"], END, 400 * 86400)
    return latest.select("user_id", "feature", (F.lit(END).cast("long") - F.col("t")).alias("age"))


@query("F13_age_thresholds", """SELECT o_orderkey, d <= 14 AS expiring, d > 14 AND d <= 92 AS ageing FROM (SELECT o_orderkey, 11535 - epoch_us(o_orderdate) // 86400000000 AS d FROM orders)""")
def _(spark, sf):
    age = F.lit(11535).cast("long") - T.days("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", (age <= 14).alias("expiring"), ((age > 14) & (age <= 92)).alias("ageing"))


@query("F14_label_replace", r"""SELECT page_id, CASE WHEN regexp_full_match(url, 'https?://([a-z.]+)/.*') THEN regexp_replace(url, '^https?://([a-z.]+)/.*$', '\1') ELSE 'none' END AS application, 'fixed' AS constant FROM pages""")
def _(spark, sf):
    labels = F.create_map(F.lit("url"), "url", F.lit("application"), F.lit("none"))
    return read(spark, sf, "pages").select(
        "page_id", L.label_replace(labels, "application", "$1", "url", r"https?://([a-z.]+)/.*").alias("application"), L.label_replace(labels, "constant", "fixed", "", "").alias("constant")
    )


@query("F15_sanitise_label", r"SELECT conv_id, turn, substr(regexp_replace(text, '[^A-Za-z0-9._:/@+ -]', '_', 'g'), 1, 200) AS label FROM conversations")
def _(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", L.sanitize(F.col("text")).alias("label"))


_IMAGE = "'reg.local:5000/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '-') || CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN ':v' || p_size ELSE ':main-' || substr(md5(p_name), 1, 7) END"


@query("F16_image_tag", f"""WITH i AS (SELECT p_partkey, {_IMAGE} AS image FROM part), l AS (SELECT p_partkey, split_part(image, '/', 3) AS last FROM i), v AS (SELECT p_partkey, CASE WHEN contains(last, ':') THEN split_part(last, ':', 2) ELSE 'latest' END AS version FROM l)
  SELECT p_partkey, version, regexp_full_match(version, '.+-[0-9a-f]{{7}}') AS preferred FROM v""")
def _(spark, sf):
    tag = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(":v"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(":main-"), F.substring(F.md5("p_name"), 1, 7)))
    image = F.concat(F.lit("reg.local:5000/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), tag)
    rows = read(spark, sf, "part").select("p_partkey", inventory.deployment_version(image).alias("version"))
    return rows.withColumn("preferred", L.is_commit_version(F.col("version")))


@query("F17_state_values", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1.0 WHEN o_orderpriority = '2-HIGH' OR o_orderstatus = 'P' THEN 0.5 ELSE 0.0 END::DOUBLE AS sync,
  CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END::DOUBLE AS build FROM orders""")
def _(spark, sf):
    sync = F.when(F.col("o_orderstatus") == "F", "Synced").when(F.col("o_orderstatus") == "P", "Unknown").otherwise("OutOfSync")
    health = F.when(F.col("o_orderpriority") == "1-URGENT", "Healthy").when(F.col("o_orderpriority") == "2-HIGH", "Progressing").otherwise("Degraded")
    result = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "UNSTABLE").otherwise("FAILURE")
    return read(spark, sf, "orders").select("o_orderkey", inventory.sync_state(sync, health).alias("sync"), inventory.build_state(result).alias("build"))


@query("F18_app_name", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'app-' || source ELSE source END AS name FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", L.app_name(F.concat(F.lit("app-"), "source"), "app-src3").alias("name"))


_FEATURE = "CASE l_linenumber % 4 WHEN 0 THEN 'cpu_c' || l_suppkey WHEN 1 THEN 'ram_c' || l_suppkey || '_mb' WHEN 2 THEN 'ram_' || l_suppkey ELSE 'web_ok' END"


@query("F19_component", f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 < 2 THEN 'c' || l_suppkey ELSE '' END AS component FROM lineitem")
def _(spark, sf):
    n, key = F.col("l_linenumber") % 4, F.col("l_suppkey").cast("string")
    feature = F.when(n == 0, F.concat(F.lit("cpu_c"), key)).when(n == 1, F.concat(F.lit("ram_c"), key, F.lit("_mb"))).when(n == 2, F.concat(F.lit("ram_"), key)).otherwise("web_ok")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(L.component_of(feature), F.lit("")).alias("component"))


@query("F20_signature", "SELECT c_custkey, substr(sha256(c_name || chr(10) || c_mktsegment), 1, 16) AS signature FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", L.signature(F.array("c_name", "c_mktsegment")).alias("signature"))


@query("F21_backup_slot", f"WITH {EV}, x AS (SELECT event_id, (t % 86400) // 60 AS m FROM ev) SELECT event_id, m BETWEEN 140 AND 185 OR m BETWEEN 260 AND 295 AS in_slot FROM x")
def _(spark, sf):
    return T.events(spark, sf).select("event_id", S.in_backup_slot(F.col("t")).alias("in_slot"))


@query("F22_set_epoch", "SELECT event_id, epoch_us(ts) // 1000000 AS epoch FROM events")
def _(spark, sf):
    rows = read(spark, sf, "events").withColumn("set_name", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    return rows.select("event_id", audit.set_epoch(F.col("set_name")).alias("epoch"))


@query("F23_service_explode", """WITH c AS (SELECT s_suppkey, s_name, s_suppkey % 5 AS k FROM supplier),
  d AS (SELECT s_suppkey, s_name, unnest(CASE WHEN k < 2 THEN [8080 + k] WHEN k < 4 THEN [443, 9000 + k] ELSE [] END) AS port, k >= 2 AS many FROM c)
  SELECT CASE WHEN many THEN s_name || ':' || port ELSE s_name END AS nom, '10.0.0.' || s_suppkey % 250 || ':' || port AS cible, 'docker' AS source, 'n' || s_suppkey AS noeud,
    CASE port WHEN 443 THEN 'https://10.0.0.' || s_suppkey % 250 || ':443/' WHEN 8080 THEN 'http://10.0.0.' || s_suppkey % 250 || ':8080/' ELSE '' END AS lien FROM d
  UNION ALL SELECT 'shop/' || s_name || ':' || 'http', '10.0.0.' || s_suppkey % 250 || ':' || 30000 + s_suppkey, 'kubernetes', 'n' || s_suppkey, 'http://10.0.0.' || s_suppkey % 250 || ':' || 30000 + s_suppkey || '/' FROM c WHERE k <> 0
  UNION ALL SELECT 'ingress shop/' || s_name || '/api', 'http://h' || s_suppkey || '.local/api', 'kubernetes', 'n' || s_suppkey, 'http://h' || s_suppkey || '.local/api' FROM c""")
def _(spark, sf):
    s = read(spark, sf, "supplier").withColumn("k", (F.col("s_suppkey") % 5).cast("int"))
    host = F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 250).cast("string"))
    node = F.concat(F.lit("n"), F.col("s_suppkey").cast("string"))
    ports = F.when(F.col("k") < 2, F.format_string("0.0.0.0:%d->80/tcp, :::53->53/tcp, 0.0.0.0:22->22/tcp", F.col("k") + 8080)).when(
        F.col("k") < 4, F.format_string("0.0.0.0:%d->9000/tcp, 0.0.0.0:443->443/tcp, 0.0.0.0:5353->5353/udp", F.col("k") + 9000)
    ).otherwise("127.0.0.1:80->80/tcp")
    docker = inventory.docker_services(s.select(F.col("s_name").alias("name"), ports.alias("ports"), host.alias("host"), node.alias("node")), [22])
    svc = F.struct(
        F.struct(F.when(F.col("k") == 0, "kube-system").otherwise("shop").alias("namespace"), F.col("s_name").alias("name")).alias("metadata"),
        F.struct(F.lit("NodePort").alias("type"), F.array(F.struct(F.lit("http").alias("name"), F.lit(80).alias("port"), (F.col("s_suppkey") + 30000).cast("int").alias("nodePort"))).alias("ports")).alias("spec"),
    )
    ing = F.struct(
        F.struct(F.lit("shop").alias("namespace"), F.col("s_name").alias("name")).alias("metadata"),
        F.struct(F.array(F.struct(F.format_string("h%d.local", "s_suppkey").alias("host"), F.struct(F.array(F.struct(F.lit("/api").alias("path"))).alias("paths")).alias("http"))).alias("rules")).alias("spec"),
    )
    listing = lambda item: s.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("json"), host.alias("host"), node.alias("node"))
    found = docker.unionByName(inventory.cluster_services(listing(svc))).unionByName(inventory.ingress_services(listing(ing)))
    return found.drop("type")


@query("F24_probe_classification", """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 11 AS k, l_quantity::INT AS q, l_partkey % 5 AS os FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 1 THEN 'supervision' WHEN k = 2 THEN 'controle' WHEN k = 3 THEN 'applicatif' WHEN os = 4 THEN 'incompatible' WHEN 1000 + q * 100 < 1800 THEN 'incompatible'
    WHEN q < 10 THEN 'incompatible' WHEN k = 4 THEN 'incompatible' WHEN k = 5 THEN 'occupe' WHEN k = 6 THEN 'occupe' WHEN k = 7 THEN 'occupe' ELSE 'vide' END AS state,
    CASE WHEN k = 1 THEN 'runs the monitoring stack' WHEN k = 2 THEN 'k3s control node v1' WHEN k = 3 THEN 'k3s agent' WHEN os = 4 THEN 'system ubuntu 24.04' WHEN 1000 + q * 100 < 1800 THEN (1000 + q * 100) || ' MB of memory (minimum 1800)'
    WHEN q < 10 THEN q || ' GB free (minimum 10)' WHEN k = 4 THEN 'no passwordless sudo' WHEN k = 5 THEN 'running containers: blog, db' WHEN k = 6 THEN 'already equipped, without k3s' WHEN k = 7 THEN 'listening ports: 80, 3306' ELSE 'empty' END AS reason FROM p""")
def _(spark, sf):
    k, q = F.col("l_suppkey") % 11, F.col("l_quantity").cast("int")
    record = F.struct(
        F.when(F.col("l_partkey") % 5 == 4, "ubuntu 24.04").otherwise("Debian 12").alias("systeme"), (q * 100 + 1000).alias("ram_mo"), q.alias("disque_libre_go"), (k != 4).alias("sudo"),
        F.when(k == 1, "mon-prometheus blog").when(k == 5, "db blog ").otherwise("").alias("conteneurs"), F.when(k == 2, "v1").otherwise("").alias("k3s_version"),
        (k == 2).alias("k3s_serveur"), (k == 3).alias("k3s_agent"), (k == 6).alias("pfe_runbook"), F.when(k == 7, "22 3306 53 80 x").otherwise("22 53").alias("services_ecoute"),
    )
    probed = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.from_json(F.to_json(record), schemas.PROBE).alias("probe"))
    state, reason = inventory.classify(F.col("probe"), ["debian 12", "debian 13"], 1800, 10)
    return probed.select("l_orderkey", "l_linenumber", "l_partkey", state.alias("state"), reason.alias("reason"))


@query("F25_keys", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'f' || l_partkey ELSE l_returnflag || ':' || CASE WHEN l_partkey % 3 = 1 THEN l_suppkey::VARCHAR ELSE '' END END || ':' || l_linenumber AS incident,
  l_suppkey || ':' || CASE WHEN l_linestatus = 'O' THEN 'restart' ELSE 'None' END || ':' || l_returnflag AS action FROM lineitem""")
def _(spark, sf):
    third = F.col("l_partkey") % 3
    incident = L.incident_key(
        F.when(third == 0, F.concat(F.lit("f"), F.col("l_partkey").cast("string"))).otherwise(""), F.col("l_returnflag"), F.when(third == 1, F.col("l_suppkey").cast("string")), F.col("l_linenumber").cast("string")
    )
    action = L.action_key(F.col("l_suppkey").cast("string"), F.when(F.col("l_linestatus") == "O", "restart"), F.col("l_returnflag"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", incident.alias("incident"), action.alias("action"))


@query("F26_annotations", f"WITH {EV} SELECT event_id, 'value ' || floor(value * 10)::INT || ' on ' || target || ' (' || feature || ') ' AS summary FROM ev")
def _(spark, sf):
    labels = F.create_map(F.lit("node"), "target", F.lit("type"), "feature")
    text = L.annotate("value {value} on {node} ({type}) {missing}", labels, F.floor(F.col("value") * 10).cast("double"))
    return T.events(spark, sf).select("event_id", text.alias("summary"))
