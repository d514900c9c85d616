"""Queries: aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import inventory, stats as S
from pulsegrid.operators import audit, evaluate, slopes, summaries, vector
from pulsegrid.plans import tables as T
from pulsegrid.plans.registry import query
from pulsegrid.plans.scans import _DAILY_POINTS, _SLOPES, day_points
from pulsegrid.plans.tables import BASE, EV, HOURLY, MID, read


@query("A1_label_aggregates", f"""WITH {EV} SELECT target, feature, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n
  FROM ev GROUP BY target, feature""")
def _(spark, sf):
    ev = T.events(spark, sf)
    return ev.groupBy("target", "feature").agg(
        F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n")
    )


@query("A2_nested_count", f"WITH {EV} SELECT target, count(DISTINCT user_id) AS containers FROM ev WHERE feature <> '' AND feature <> 'view' GROUP BY 1")
def _(spark, sf):
    ev = T.events(spark, sf).where("feature <> '' and feature <> 'view'").select("target", "user_id")
    # two mergeable steps: one row per container, then the count of those
    return ev.groupBy("target", "user_id").agg(F.lit(1).alias("one")).groupBy("target").agg(F.count("*").alias("containers"))


@query("A3_zero_default", f"""WITH {HOURLY}, e AS (SELECT target, t // 3600 * 3600 AS t, sum(value) AS v FROM ev WHERE feature = 'error' AND value > 60 GROUP BY 1, 2)
  SELECT target, t, round(coalesce(v, 0), 4) AS filled, round(v, 4) AS raw FROM m LEFT JOIN e USING (target, t)""")
def _(spark, sf):
    ev = T.events(spark, sf).where("feature = 'error' and value > 60")
    sums = ev.groupBy("target", (F.expr("t div 3600") * 3600).alias("t")).agg(F.sum("value").alias("value")).withColumn("raw", F.round("value", 4))
    filled = vector.zero_default(T.hourly(spark, sf).select("target", "t"), sums, ["target", "t"])
    return filled.select("target", "t", F.round("value", 4).alias("filled"), "raw")


@query("A4_utilisation", f"""WITH {EV}, b AS (SELECT target, t // 21600 AS t, avg(value) FILTER (feature = 'click') AS avail, avg(value) FILTER (feature = 'view') AS total FROM ev GROUP BY 1, 2)
  SELECT target, t, round((1 - avail / total) * 100, 6) AS ratio_of_averages, round(100 - avail, 6) AS busy, round(total / 1024, 9) AS kb FROM b WHERE total > 0 AND avail IS NOT NULL""")
def _(spark, sf):
    ev = T.events(spark, sf)
    only = lambda f: F.avg(F.when(F.col("feature") == f, F.col("value")))
    b = ev.groupBy("target", F.expr("t div 21600").alias("t")).agg(only("click").alias("avail"), only("view").alias("total")).where("total > 0 and avail is not null")
    return b.select("target", "t", F.round((1 - F.col("avail") / F.col("total")) * 100, 6).alias("ratio_of_averages"), F.round(100 - F.col("avail"), 6).alias("busy"), F.round(F.col("total") / 1024, 9).alias("kb"))


@query("A5_robust_center_scale", f"WITH {BASE} SELECT target, feature, round(median, 6) AS median, round(mad_raw, 6) AS mad FROM model")
def _(spark, sf):
    # counts per hour: a group holds one value per hour of the covered span
    base = summaries.robust_baseline(T.hourly_long(spark, sf), ["target", "feature"])
    return base.select("target", "feature", F.round("median", 6).alias("median"), F.round("mad_raw", 6).alias("mad"))


_QS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.995)


@query("A6_quantiles", f"WITH {EV} SELECT feature, count(*) AS n, {', '.join(f'round(quantile_cont(value, {q}), 6) AS q{i}' for i, q in enumerate(_QS))} FROM ev GROUP BY 1")
def _(spark, sf):
    q = summaries.exact_quantiles(T.events(spark, sf), ["feature"], "value", _QS)
    return q.select("feature", "n", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(len(_QS))])


@query("A7_histogram", f"""WITH {EV} SELECT feature, CASE WHEN value >= 200 THEN 4 WHEN value >= 100 THEN 3 WHEN value >= 50 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END::BIGINT AS bin, count(*) AS n FROM ev GROUP BY 1, 2""")
def _(spark, sf):
    return summaries.histogram(T.events(spark, sf), ["feature"], "value", [10, 50, 100, 200])


def psi_sql(expected: str, actual: str, key: str, value: str) -> str:
    """PSI per key of two sub-selects with columns key and value."""
    return f"""ex AS ({expected}), ac AS ({actual}),
  ed AS (SELECT {key}, list_sort(list_distinct(quantile_cont({value}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]))) AS e FROM ex GROUP BY 1),
  inn AS (SELECT {key}, len(e) AS k, CASE WHEN len(e) >= 3 THEN e[2:len(e) - 1] ELSE [] END AS inner_e FROM ed),
  spine AS (SELECT {key}, k, unnest(generate_series(0, greatest(k - 2, 0))) AS bin FROM inn),
  be AS (SELECT {key}, len(list_filter(inner_e, lambda x: x <= {value})) AS bin, count(*) AS n FROM ex JOIN inn USING ({key}) GROUP BY 1, 2),
  ba AS (SELECT {key}, len(list_filter(inner_e, lambda x: x <= {value})) AS bin, count(*) AS n FROM ac JOIN inn USING ({key}) GROUP BY 1, 2),
  sh AS (SELECT spine.{key} AS {key}, spine.k, greatest(coalesce(be.n, 0) / sum(coalesce(be.n, 0)) OVER (PARTITION BY spine.{key}), 1e-4) AS pe,
      greatest(coalesce(ba.n, 0) / sum(coalesce(ba.n, 0)) OVER (PARTITION BY spine.{key}), 1e-4) AS pa
    FROM spine LEFT JOIN be ON be.{key} = spine.{key} AND be.bin = spine.bin LEFT JOIN ba ON ba.{key} = spine.{key} AND ba.bin = spine.bin),
  psi AS (SELECT {key}, CASE WHEN max(k) < 3 THEN 0.0 ELSE sum((pa - pe) * ln(pa / pe)) END AS psi FROM sh GROUP BY 1)"""


@query("A8_psi", f"""WITH {EV}, {psi_sql(f"SELECT feature, value FROM ev WHERE t < {MID}", f"SELECT feature, value * 1.2 AS value FROM ev WHERE t >= {MID}", "feature", "value")}
  SELECT feature, round(psi, 6) AS psi FROM psi""")
def _(spark, sf):
    ev = T.events(spark, sf).select("feature", "value", "t")
    later = ev.where(F.col("t") >= MID).select("feature", (F.col("value") * 1.2).alias("value"))
    return summaries.psi(ev.where(F.col("t") < MID).select("feature", "value"), later, ["feature"], "value").select("feature", F.round("psi", 6).alias("psi"))


THEIL = f"""{_DAILY_POINTS}, {_SLOPES}, sl AS (SELECT target, day, quantile_cont(s, 0.5) AS slope FROM pairs GROUP BY 1, 2),
  ic AS (SELECT p.target, p.day, slope, quantile_cont(y - slope * x, 0.5) AS intercept, avg(y) AS mean_y, count(*) AS n, max(x) AS last_x FROM p JOIN sl USING (target, day) GROUP BY 1, 2, 3),
  ts AS (SELECT ic.target, ic.day, ic.slope, ic.intercept, ic.n, ic.last_x,
    CASE WHEN sum((y - mean_y) ** 2) > 0 THEN 1 - sum((y - intercept - slope * x) ** 2) / sum((y - mean_y) ** 2) ELSE 0 END AS r2 FROM p JOIN ic USING (target, day) GROUP BY ALL)"""


@query("A9_theil_sen", f"WITH {THEIL} SELECT target, day, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2 FROM ts")
def _(spark, sf):
    fitted = slopes.theil_sen(day_points(spark, sf), ["target", "day"]).where("n > 1")
    return fitted.select("target", "day", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


_FAULT_SQL = """SELECT doc_id, source AS node, lang AS fault, CASE n_chars % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END::DOUBLE AS intensity,
    quality AS detected, toxic AS threshold_detected, CASE WHEN n_chars % 5 < 4 THEN 1 ELSE 0 END AS diagnosed, (n_chars % 48) * 15 AS delay_s
  FROM labels JOIN documents USING (doc_id)"""


def _faults(spark, sf):
    """Labelled documents read as injected faults: quality = detected, toxic = seen by a fixed threshold."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = read(spark, sf, "labels").join(docs, "doc_id")
    third = F.col("n_chars") % 3
    return joined.select(
        "doc_id", F.col("source").alias("node"), F.col("lang").alias("fault"), F.when(third == 0, 1.0).when(third == 1, 0.5).otherwise(0.25).alias("intensity"),
        F.col("quality").alias("detected"), F.col("toxic").alias("threshold_detected"), F.when(F.col("n_chars") % 5 < 4, 1).otherwise(0).alias("diagnosed"),
        ((F.col("n_chars") % 48) * 15).alias("delay_s"),
    )


@query("A10_delay_summary", f"""WITH f AS ({_FAULT_SQL}) SELECT fault, count(*) FILTER (detected = 1) AS seen, count(*) AS total, quantile_cont(delay_s, 0.5) FILTER (detected = 1) AS median_s,
  min(delay_s) FILTER (detected = 1) AS min_s, max(delay_s) FILTER (detected = 1) AS max_s, round(100.0 * count(*) FILTER (detected = 1) / count(*), 6) AS share FROM f GROUP BY 1""")
def _(spark, sf):
    # delays are whole cycles inside one fault window: at most 48 distinct values per group
    delay = F.when(F.col("detected") == 1, F.col("delay_s"))
    return _faults(spark, sf).groupBy("fault").agg(
        F.count(delay).alias("seen"), F.count("*").alias("total"), F.percentile(delay, F.lit(0.5)).alias("median_s"), F.min(delay).alias("min_s"), F.max(delay).alias("max_s"),
        F.round(100.0 * F.count(delay) / F.count("*"), 6).alias("share"),
    )


@query("A11_recall_precision", f"""WITH f AS ({_FAULT_SQL}) SELECT node, round(sum(detected) / count(*), 6) AS recall, round(count(*) FILTER (detected = 1 AND diagnosed = 1) / greatest(sum(detected), 1), 6) AS precision,
  round(count(*) FILTER (threshold_detected = 1 AND detected = 0) / 24.0, 6) AS fp_per_hour FROM f GROUP BY 1""")
def _(spark, sf):
    hit = F.col("detected") == 1
    return _faults(spark, sf).groupBy("node").agg(
        F.round(F.sum("detected") / F.count("*"), 6).alias("recall"),
        F.round(F.count_if(hit & (F.col("diagnosed") == 1)) / F.greatest(F.sum("detected"), F.lit(1)), 6).alias("precision"),
        F.round(F.count_if(~hit & (F.col("threshold_detected") == 1)) / 24.0, 6).alias("fp_per_hour"),
    )


@query("A12_f1", f"""WITH f AS ({_FAULT_SQL}), g AS (SELECT node, fault, sum(detected) AS tp, sum(1 - detected) AS fn, sum(threshold_detected) AS fp FROM f GROUP BY 1, 2)
  SELECT node, fault, round(coalesce(2.0 * tp / nullif(2.0 * tp + fn + fp, 0), 0), 6) AS f1 FROM g""")
def _(spark, sf):
    g = _faults(spark, sf).groupBy("node", "fault").agg(F.sum("detected").alias("tp"), F.sum(1 - F.col("detected")).alias("fn"), F.sum("threshold_detected").alias("fp"))
    return g.select("node", "fault", F.round(S.f1(F.col("tp"), F.col("fn"), F.col("fp")), 6).alias("f1"))


def wilson_sql(k: str, n: str) -> tuple[str, str, str]:
    p, d = f"({k}) / nullif(({n}), 0)::DOUBLE", f"(1 + 3.8416 / nullif(({n}), 0)::DOUBLE)"
    c, h = f"({p} + 1.9208 / nullif(({n}), 0)::DOUBLE)", f"(1.96 * sqrt({p} * (1 - {p}) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n}))))"
    return p, f"CASE WHEN ({n}) > 0 THEN greatest(0, ({c} - {h}) / {d}) END", f"CASE WHEN ({n}) > 0 THEN least(1, ({c} + {h}) / {d}) END"


_W = wilson_sql("k", "n")


@query("A13_wilson", f"WITH f AS ({_FAULT_SQL}), g AS (SELECT node, fault, sum(detected) AS k, count(*) AS n FROM f GROUP BY 1, 2) SELECT node, fault, k::BIGINT AS k, n, round({_W[0]}, 6) AS p, round({_W[1]}, 6) AS low, round({_W[2]}, 6) AS high FROM g")
def _(spark, sf):
    g = _faults(spark, sf).groupBy("node", "fault").agg(F.sum("detected").alias("k"), F.count("*").alias("n"))
    p, low, high = S.wilson(F.col("k"), F.col("n"))
    return g.select("node", "fault", "k", "n", F.round(p, 6).alias("p"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _slice_sql() -> str:
    out = []
    for name, k, n in (("recall", "detected", "n"), ("threshold_recall", "threshold_detected", "n"), ("diagnosis", "diagnosed", "detected")):
        w = wilson_sql(k, n)
        out += [f"round({e}, 6) AS {name}{x}" for e, x in zip(w, ("", "_low", "_high"))]
    return ", ".join(out)


SLICES = f"""f AS ({_FAULT_SQL}),
  t AS (SELECT 'total' AS slice, '' AS key, * FROM f UNION ALL SELECT 'nominal', '', * FROM f WHERE intensity = 1 UNION ALL SELECT 'intensity', intensity::VARCHAR, * FROM f
    UNION ALL SELECT 'fault', fault, * FROM f WHERE intensity = 1 UNION ALL SELECT 'node', node, * FROM f WHERE intensity = 1),
  g AS (SELECT slice, key, count(*) AS n, count(*) FILTER (detected = 1) AS detected, count(*) FILTER (threshold_detected = 1) AS threshold_detected,
    count(*) FILTER (detected = 1 AND diagnosed = 1) AS diagnosed, quantile_cont(delay_s, 0.25) FILTER (detected = 1) AS delay_q1, quantile_cont(delay_s, 0.5) FILTER (detected = 1) AS delay_median,
    quantile_cont(delay_s, 0.75) FILTER (detected = 1) AS delay_q3, count(*) FILTER (detected = 1 AND threshold_detected = 0) AS model_only,
    count(*) FILTER (detected = 0 AND threshold_detected = 1) AS threshold_only FROM t GROUP BY 1, 2)"""


@query("A14_slice_table", f"WITH {SLICES} SELECT slice, key, n, detected, threshold_detected, diagnosed, delay_q1, delay_median, delay_q3, model_only, threshold_only, {_slice_sql()} FROM g")
def _(spark, sf):
    rates = [f"{a}{b}" for a in ("recall", "threshold_recall", "diagnosis") for b in ("", "_low", "_high")]
    report = summaries.slice_report(_faults(spark, sf))
    return report.select(*[c for c in report.columns if c not in rates], *[F.round(c, 6).alias(c) for c in rates])


@query("A15_false_alerts_per_day", f"""WITH {HOURLY}, d AS (SELECT target, t // 86400 AS day, count(*) AS hours, count(*) FILTER (error > 3) AS opens, max((error > 5)::INT) AS fixed FROM m GROUP BY 1, 2)
  SELECT target, sum(hours)::BIGINT AS hours, count(*) AS days, sum(opens)::BIGINT AS opens, round(sum(opens) / (sum(hours) / 24.0), 3) AS per_day, sum(fixed)::BIGINT AS threshold_days FROM d GROUP BY 1""")
def _(spark, sf):
    d = T.hourly(spark, sf).groupBy("target", F.expr("t div 86400").alias("day")).agg(F.count("*").alias("hours"), F.count_if(F.col("error") > 3).alias("opens"), F.max(F.expr("int(error > 5)")).alias("fixed"))
    return d.groupBy("target").agg(
        F.sum("hours").alias("hours"), F.count("*").alias("days"), F.sum("opens").alias("opens"), F.round(F.sum("opens") / (F.sum("hours") / 24.0), 3).alias("per_day"), F.sum("fixed").alias("threshold_days")
    )


INJECTION_SQL = """inj AS (SELECT l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_quantity < 12 THEN 'aucune' ELSE 'restart' END AS expected,
    CASE WHEN l_tax < 0.03 THEN 'aucune' WHEN l_tax < 0.06 THEN 'restart' ELSE NULL END AS action,
    CASE WHEN l_returnflag = 'A' THEN 'executee' WHEN l_returnflag = 'N' THEN 'pause' ELSE 'simulee' END AS decision,
    CASE WHEN l_discount > 0.04 THEN (l_quantity * 10)::DOUBLE END AS repaired_s,
    CASE WHEN l_partkey % 3 = 0 THEN (l_suppkey % 200)::DOUBLE END AS alert_s, CASE WHEN l_partkey % 2 = 0 THEN (l_suppkey % 90)::DOUBLE END AS ai_s,
    CASE WHEN l_partkey % 4 = 0 THEN 'cpu_hote' ELSE 'api' END AS scenario FROM lineitem)"""


def injections(spark, sf):
    """Line items read as injection records (one decision each)."""
    li = read(spark, sf, "lineitem")
    action = F.when(F.col("l_tax") < 0.03, "aucune").when(F.col("l_tax") < 0.06, "restart")
    decision = F.when(F.col("l_returnflag") == "A", "executee").when(F.col("l_returnflag") == "N", "pause").otherwise("simulee")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    record = F.struct(
        F.lit(0.0).alias("t"), F.lit("decision").alias("type"), none.alias("alerte"), action.alias("action"), text(decision).alias("decision"), none.alias("detail"), none.alias("code"), none.alias("verification")
    )
    empty = F.array().cast("array<struct<t:double,type:string,alerte:string,action:string,decision:string,detail:string,code:string,verification:string>>")
    pairs = F.array_compact(
        F.array(
            F.when(F.col("l_partkey") % 3 == 0, F.struct(F.lit("alerte").alias("k"), (F.col("l_suppkey") % 200).cast("double").alias("v"))),
            F.when(F.col("l_partkey") % 2 == 0, F.struct(F.lit("alerte_ia").alias("k"), (F.col("l_suppkey") % 90).cast("double").alias("v"))),
        )
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("numero"),
        F.when(F.col("l_quantity") < 12, "aucune").otherwise("restart").alias("action_attendue"),
        F.when(action.isNull(), empty).otherwise(F.array(record)).alias("agent"),
        F.when(F.col("l_discount") > 0.04, F.col("l_quantity") * 10).alias("repare_par_agent_s"),
        F.map_from_entries(pairs).alias("detections"),
        F.when(F.col("l_partkey") % 4 == 0, "cpu_hote").otherwise("api").alias("scenario"),
    )


_CORRECT = "CASE WHEN expected <> 'aucune' THEN coalesce(action = expected, FALSE) ELSE coalesce(action = 'aucune', TRUE) END"


@query("A16_decision_correctness", f"WITH {INJECTION_SQL} SELECT scenario, expected, count(*) AS n, count(*) FILTER ({_CORRECT}) AS correct FROM inj GROUP BY 1, 2")
def _(spark, sf):
    rows = injections(spark, sf).select("scenario", F.col("action_attendue").alias("expected"), evaluate.decision_correct(F.col("action_attendue"), F.col("agent")).alias("ok"))
    return rows.groupBy("scenario", "expected").agg(F.count("*").alias("n"), F.count_if("ok").alias("correct"))


@query("A17_repair_statistics", f"""WITH {INJECTION_SQL}, r AS (SELECT *, repaired_s IS NOT NULL AND coalesce(decision = 'executee' AND action IS NOT NULL, FALSE) AS repaired, least(alert_s, ai_s) AS first_alert FROM inj)
  SELECT scenario, count(*) FILTER (repaired) AS repaired, count(*) FILTER (expected <> 'aucune' AND scenario NOT IN ('cpu_hote', 'ram_hote')) AS repairable,
    quantile_cont(repaired_s, 0.5) FILTER (repaired) AS mttr_s, quantile_cont(greatest(0, repaired_s - first_alert), 0.5) FILTER (repaired_s IS NOT NULL AND first_alert IS NOT NULL) AS reaction_s FROM r GROUP BY 1""")
def _(spark, sf):
    base = injections(spark, sf)
    facts = evaluate.repair_facts(base.withColumn("numero", F.struct("scenario", "l_orderkey"))).withColumn("scenario", F.col("numero.scenario"))
    counts = facts.groupBy("scenario").agg(F.count_if("repaired").alias("repaired"), F.count_if("repairable").alias("repairable"))
    mttr = summaries.exact_quantiles(facts, ["scenario"], "mttr_s", [0.5]).select("scenario", F.col("q0").alias("mttr_s"))
    reaction = summaries.exact_quantiles(facts, ["scenario"], "reaction_s", [0.5]).select("scenario", F.col("q0").alias("reaction_s"))
    return counts.join(mttr, "scenario", "left").join(reaction, "scenario", "left")


@query("A18_counter_rollup", f"""WITH {EV}, d AS (SELECT feature, t // 86400 AS day, count(*) AS n, count(*) FILTER (target = 'node-0') AS ok FROM ev GROUP BY 1, 2)
  SELECT feature, sum(n)::BIGINT AS total, sum(ok)::BIGINT AS ok, round(sum(ok) / sum(n), 6) AS ratio FROM d GROUP BY 1""")
def _(spark, sf):
    ev = T.events(spark, sf)
    d = ev.groupBy("feature", F.expr("t div 86400").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("target") == "node-0").alias("ok"))
    return d.groupBy("feature").agg(F.sum("n").alias("total"), F.sum("ok").alias("ok")).withColumn("ratio", F.round(F.try_divide("ok", "total"), 6))


@query("A19_firing_count", "SELECT o_orderpriority AS severity, count(*) FILTER (o_orderstatus = 'F' AND o_custkey % 10 <> 3) AS firing FROM orders GROUP BY 1")
def _(spark, sf):
    live = (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 10 != 3)
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count_if(live).alias("firing"))


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("A20_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED))
def _(spark, sf):
    return audit.table_counts({t: read(spark, sf, t) for t in _COUNTED})


@query("A21_alerts_per_day", f"WITH {EV} SELECT user_id, count(*) FILTER (feature = 'error') AS opens, round(count(*) FILTER (feature = 'error') / greatest((max(t) - min(t)) / 86400.0::DOUBLE, 1e-6), 6) AS per_day FROM ev GROUP BY 1")
def _(spark, sf):
    days = F.greatest((F.max("t") - F.min("t")) / 86400.0, F.lit(1e-6))
    opens = F.count_if(F.col("feature") == "error")
    return T.events(spark, sf).groupBy("user_id").agg(opens.alias("opens"), F.round(opens / days, 6).alias("per_day"))


@query("A22_ready_share", """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS ready, count(*) FILTER (o_orderstatus <> 'P') AS desired FROM orders GROUP BY 1)
  SELECT o_custkey, CASE WHEN desired > 0 THEN round(ready / desired, 3) ELSE 0.0 END::DOUBLE AS share FROM g""")
def _(spark, sf):
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("ready"), F.count_if(F.col("o_orderstatus") != "P").alias("desired"))
    return g.select("o_custkey", inventory.ready_share(F.col("ready"), F.col("desired")).alias("share"))
