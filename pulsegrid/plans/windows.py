"""Queries: ordered operators (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import audit, blocks, decisions, detect, lifecycle, series
from pulsegrid.operators.blocks import Run
from pulsegrid.plans import tables as T
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import COUNTER, EV, HOURLY, LATCH, SCORED, SMOOTH, read
from pulsegrid.session import cut

KEY, ORDER, WIDE = ["target"], ["t"], 5 * 86400


def _increase_sql(source: str, key: str, reach: int) -> str:
    return f"""dl AS (SELECT *, coalesce(CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END, 0) AS d FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY t)),
  inc AS (SELECT {key}, t, value, sum(d) OVER r - first_value(d) OVER r AS inc, t - first_value(t) OVER r AS elapsed FROM dl
    WINDOW r AS (PARTITION BY {key} ORDER BY t RANGE BETWEEN {reach - 1} PRECEDING AND CURRENT ROW))"""


@query("W1_rate", f"WITH {COUNTER}, {_increase_sql('c', 'target', 21600)} SELECT target, t, round(CASE WHEN elapsed > 0 THEN inc / elapsed END, 9) AS rate FROM inc")
def _(spark, sf):
    rates = series.counter_increase(T.counters(spark, sf), KEY, 21600, "rate", per_second=True, width=WIDE)
    return rates.select("target", "t", F.round("rate", 9).alias("rate"))


_USER_COUNTER = f"""{EV}, uc AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id, t // 604800 ORDER BY us) AS v FROM ev), cc AS (SELECT user_id, t, max(v) AS value FROM uc GROUP BY 1, 2)"""


@query("W2_increase", f"WITH {_USER_COUNTER}, {_increase_sql('cc', 'user_id', 86400)} SELECT user_id, t, CASE WHEN elapsed > 0 THEN inc END::DOUBLE AS increase FROM inc")
def _(spark, sf):
    ev = T.events(spark, sf).select("user_id", "t", "us", F.expr("t div 604800").alias("week"))
    wide = T.width(ev, ["user_id"])
    counted = blocks.running(ev, ["user_id", "week"], ["t", "us"], {"value": Run("count", F.lit(1))}, wide)
    counter = counted.groupBy("user_id", "t").agg(F.max("value").cast("double").alias("value"))
    return series.counter_increase(counter, ["user_id"], 86400, width=wide).select("user_id", "t", "increase")


@query("W3_ewma", f"WITH RECURSIVE {SMOOTH} SELECT target, rn.t, round(smoothed, 6) AS smoothed FROM sm JOIN rn USING (target, rn)")
def _(spark, sf):
    z = T.scored(spark, sf).select("target", "t", "z_max")
    return detect.ewma(z, KEY, ORDER, "z_max", T.LAM).select("target", "t", F.round("smoothed", 6).alias("smoothed"))


@query("W4_k_of_n", f"WITH {HOURLY} SELECT target, t, sum((error > 1)::INT) OVER (PARTITION BY target ORDER BY t ROWS 5 PRECEDING) >= 2 AS hit FROM m")
def _(spark, sf):
    m = blocks.with_index(T.hourly(spark, sf), KEY, ORDER, "idx", WIDE)
    return detect.k_of_n(m, KEY, F.col("error") > 1, 2, 6, "hit").select("target", "t", "hit")


@query("W5_all_below", f"WITH {HOURLY} SELECT target, t, sum((click < 2)::INT) OVER (PARTITION BY target ORDER BY t ROWS 3 PRECEDING) = 4 AS calm FROM m")
def _(spark, sf):
    m = blocks.with_index(T.hourly(spark, sf), KEY, ORDER, "idx", WIDE)
    return detect.k_of_n(m, KEY, F.col("click") < 2, 4, 4, "calm").select("target", "t", "calm")


@query("W6_hysteresis", f"WITH RECURSIVE {LATCH} SELECT target, t, round(smoothed, 6) AS smoothed, active, opened, closed FROM lt")
def _(spark, sf):
    return T.latched(spark, sf).select("target", "t", F.round("smoothed", 6).alias("smoothed"), "active", "opened", "closed")


@query("W7_relevance_gate", f"WITH {SCORED} SELECT target, t, sum((effect >= 1)::INT) OVER (PARTITION BY target ORDER BY t ROWS 3 PRECEDING) >= 3 AS relevant FROM zs")
def _(spark, sf):
    rows = blocks.with_index(T.scored(spark, sf).select("target", "t", "effect"), KEY, ORDER, "idx", WIDE)
    return detect.k_of_n(rows, KEY, F.col("effect") >= 1, 3, 4, "relevant").select("target", "t", "relevant")


_FUSED = f"""{LATCH}, rv AS (SELECT *, sum((effect >= 1)::INT) OVER (PARTITION BY target ORDER BY t ROWS 3 PRECEDING) >= 3 AS relevant FROM lt),
  fu AS (SELECT *, active AND relevant AND target <> 'node-3' AS if_effective, z_max > 3.5 AS z_active FROM rv),
  wa AS (SELECT *, if_effective OR z_active AS wants FROM fu)"""


def _fused(spark, sf):
    rows = blocks.with_index(T.latched(spark, sf), KEY, ORDER, "idx", WIDE)
    voted = detect.k_of_n(rows, KEY, F.col("effect") >= 1, 3, 4, "relevant")
    fused = voted.withColumn("if_effective", F.col("active") & F.col("relevant") & (F.col("target") != "node-3")).withColumn("z_active", F.col("z_max") > 3.5)
    return fused.withColumn("wants", F.col("if_effective") | F.col("z_active"))


@query("W8_fused_decision", f"WITH RECURSIVE {_FUSED} SELECT target, t, if_effective, z_active, wants FROM wa")
def _(spark, sf):
    return _fused(spark, sf).select("target", "t", "if_effective", "z_active", "wants")


SUPPRESSED = f"""{LATCH}, su AS (SELECT *, active AS wants, rn <= 20 OR (t % 86400) // 3600 BETWEEN 2 AND 7 AS sup FROM lt),
  isl AS (SELECT *, sum((NOT wants)::INT) OVER (PARTITION BY target ORDER BY t) AS g FROM su),
  sp2 AS (SELECT *, wants AND sum((wants AND NOT sup)::INT) OVER (PARTITION BY target, g ORDER BY t) > 0 AS open FROM isl)"""


def suppressed(spark, sf):
    rows = blocks.with_index(T.latched(spark, sf), KEY, ORDER, "idx", WIDE)
    quiet = (F.col("idx") < 20) | F.floor((F.col("t") % 86400) / 3600).between(2, 7)
    return detect.suppress_opening(rows.withColumnRenamed("active", "wants"), KEY, ORDER, F.col("wants"), quiet, WIDE)


@query("W9_open_suppression", f"WITH RECURSIVE {SUPPRESSED} SELECT target, t, wants, open AS active FROM sp2")
def _(spark, sf):
    return suppressed(spark, sf).select("target", "t", "wants", "active")


_HOLES = f"""{EV}, o AS (SELECT target, t // 3600 * 3600 AS t, count(*) FILTER (feature <> 'view') AS v FROM ev GROUP BY 1, 2)"""
_EPISODES = """st AS (SELECT *, v >= 3 AS fl, lag(t) OVER w AS pt, lag(v) OVER w AS pv, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM o WINDOW w AS (PARTITION BY target ORDER BY t)),
  mk AS (SELECT *, CASE WHEN pt IS NULL OR t - pt > 7200 OR pv < 3 THEN 1 ELSE 0 END AS s, CASE WHEN nt - t <= 7200 AND nv < 3 THEN nt ELSE t END AS e FROM st WHERE fl),
  ep AS (SELECT target, sum(s) OVER (PARTITION BY target ORDER BY t) AS no, t, e FROM mk),
  eps AS (SELECT target, min(t) AS start, max(e) AS "end", count(*) AS rows FROM ep GROUP BY target, no)"""


def _holed(spark, sf):
    ev = T.events(spark, sf).select("target", (F.expr("t div 3600") * 3600).alias("t"), "feature")
    return cut(ev.groupBy("target", "t").agg(F.count_if(F.col("feature") != "view").alias("v")))


@query("W10_episodes", f'WITH {_HOLES}, {_EPISODES} SELECT target, start, "end", rows FROM eps')
def _(spark, sf):
    return detect.episodes(_holed(spark, sf), KEY, F.col("v") >= 3, 7200, width=WIDE)


@query("W11_run_length", f"""WITH {HOURLY}, d AS (SELECT *, t // 86400 AS day FROM m),
  r AS (SELECT target, day, t, {", ".join(f"sum(({f} > {x})::INT) OVER (PARTITION BY target, day ORDER BY t ROWS {n - 1} PRECEDING) = {n} AS h{i}" for i, (f, x, n) in enumerate((("click", 0, 4), ("error", 1, 2), ("view", 1, 3))))} FROM d)
  SELECT target, day, min(t) AS first_run FROM r WHERE h0 OR h1 OR h2 GROUP BY 1, 2""")
def _(spark, sf):
    m = T.hourly(spark, sf).withColumn("day", F.expr("t div 86400"))
    return detect.first_run(m, ["target", "day"], [("click", 0, 4), ("error", 1, 2), ("view", 1, 3)], width=86400)


@query("W12_hold_for", f"""WITH {HOURLY}, c1 AS (SELECT target, t, click AS value FROM m WHERE click > 0),
  g AS (SELECT *, t - 3600 * row_number() OVER (PARTITION BY target ORDER BY t) AS isl FROM c1), a AS (SELECT *, min(t) OVER (PARTITION BY target, isl) AS active_since FROM g)
  SELECT target, t, value, active_since, CASE WHEN t - active_since >= 7200 THEN 'firing' ELSE 'pending' END AS state FROM a""")
def _(spark, sf):
    rows = T.hourly(spark, sf).where("click > 0").select("target", "t", F.col("click").alias("value"))
    return detect.hold_for(rows, KEY, 7200, 3600, width=WIDE)


@query("W13_warmup_counter", f"WITH {HOURLY} SELECT target, t // 864000 AS model_version, t, row_number() OVER (PARTITION BY target, t // 864000 ORDER BY t) AS cycle FROM m WHERE click > 0")
def _(spark, sf):
    rows = T.hourly(spark, sf).where("click > 0").select("target", F.expr("t div 864000").alias("model_version"), "t")
    return detect.warmup_cycle(rows, ["target", "model_version"], ORDER, width=WIDE)


_FLAT = " AND ".join(
    f"quantile_cont({f}, 0.95) OVER w - quantile_cont({f}, 0.05) OVER w <= {x}" for f, x in (("click", 2.0), ("view", 3.0))
)


@query("W14_plateau", f"WITH {HOURLY} SELECT target, t, row_number() OVER (PARTITION BY target ORDER BY t) >= 120 AND {_FLAT} AS plateau FROM m WINDOW w AS (PARTITION BY target ORDER BY t ROWS 119 PRECEDING)")
def _(spark, sf):
    m = blocks.with_index(T.hourly(spark, sf).select("target", "t", "click", "view"), KEY, ORDER, "idx", WIDE)
    return detect.plateau(m, KEY, [("click", 2.0), ("view", 3.0), ("error", 0.0)]).select("target", "t", "plateau")


@query("W15_holdout_split", f"""WITH {EV}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
  SELECT user_id, event_id, i < floor(n * 0.8::DOUBLE) AS is_train FROM r""")
def _(spark, sf):
    rows = T.events(spark, sf).select("user_id", "event_id", F.col("us").alias("t"))
    split = lifecycle.split_holdout(rows, keys=["user_id"], width=T.width(rows, ["user_id"], hour=3600 * 1_000_000))
    return split.select("user_id", "event_id", "is_train")


@query("W16_latest_per_key", f"WITH {EV} SELECT user_id, feature, max(us) AS us, arg_max(value, us) AS value, arg_max(event_id, us) AS event_id FROM ev GROUP BY 1, 2")
def _(spark, sf):
    return audit.latest_per_key(T.events(spark, sf), ["user_id", "feature"], F.col("us"), ["us", "value", "event_id"])


_SETS = """s AS (SELECT DISTINCT o_custkey % 20 AS source, epoch_us(o_orderdate) // 1000000 AS epoch, (epoch_us(o_orderdate) // 86400000000) % 5 <> 0 AND o_custkey % 20 <> 7 AS complete FROM orders)"""
_NOW = 996624000


def _sets(spark, sf):
    orders = read(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("source"), T.days("o_orderdate").alias("day"))
    return orders.distinct().select("source", (F.col("day") * 86400).alias("epoch"), ((F.col("day") % 5 != 0) & (F.col("source") != 7)).alias("complete"))


@query("W17_retention", f"""WITH {_SETS}, w AS (SELECT *, isoyear(to_timestamp(epoch) AT TIME ZONE 'UTC') * 100 + week(to_timestamp(epoch) AT TIME ZONE 'UTC') AS wk FROM s),
  c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY epoch DESC) AS r FROM w WHERE complete),
  ld AS (SELECT source, min(wk) AS wk FROM c WHERE r <= 7 GROUP BY 1),
  wh AS (SELECT c.source, max(epoch) AS epoch, c.wk FROM c JOIN ld ON c.source = ld.source AND c.wk < ld.wk WHERE r > 7 GROUP BY 1, 3),
  wt AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY wk DESC) AS no FROM wh),
  k AS (SELECT source, epoch FROM c WHERE r <= 7 UNION ALL SELECT source, epoch FROM wt WHERE no <= 4)
  SELECT source, epoch, complete, CASE WHEN source NOT IN (SELECT source FROM c) THEN TRUE WHEN complete THEN (source, epoch) IN (SELECT (source, epoch) FROM k) ELSE {_NOW} - epoch < 86400 END AS keep FROM s""")
def _(spark, sf):
    return audit.retention(_sets(spark, sf), ["source"], "epoch", "complete", _NOW)


@query("W18_history_thinning", f"""WITH {_SETS} SELECT source, epoch, complete, CASE WHEN complete THEN row_number() OVER (PARTITION BY source, complete ORDER BY epoch DESC) <= 3 ELSE TRUE END AS keep_history FROM s""")
def _(spark, sf):
    return audit.keep_history(_sets(spark, sf), ["source"], "epoch", "complete")


@query("W19_failure_run", """WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS t, o_orderstatus = 'F' AS failed FROM orders),
  g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) AS g FROM o), r AS (SELECT *, sum(failed::INT) OVER (PARTITION BY o_custkey, g ORDER BY t, o_orderkey) AS n FROM g)
  SELECT o_custkey, o_orderkey, n::BIGINT AS failures, n >= 3 AS suspends FROM r""")
def _(spark, sf):
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", T.days("o_orderdate").alias("t"), "o_orderstatus")
    runs = decisions.failure_runs(orders, ["o_custkey"], ["t", "o_orderkey"], F.col("o_orderstatus") == "F", width=T.width(orders, ["o_custkey"], hour=30))
    return runs.select("o_custkey", "o_orderkey", "failures", "suspends")


@query("W20_first_signal", f"""WITH {EV}, w AS (SELECT event_id, user_id, t AS t0, t + 3600 AS t1 FROM ev WHERE feature = 'purchase'), h AS (SELECT user_id, t, feature FROM ev WHERE feature IN ('error', 'click', 'view')),
  d AS (SELECT unnest(['error', 'click', 'view']) AS detector)
  SELECT event_id, detector, (SELECT min(t) FROM h WHERE h.user_id = w.user_id AND h.feature = d.detector AND h.t BETWEEN t0 AND t1 + 120) - t0 AS delay FROM w, d""")
def _(spark, sf):
    ev = T.events(spark, sf)
    detectors, window = ("error", "click", "view"), {"event_id": F.col("event_id"), "t0": F.col("t"), "t1": F.col("t") + 3720}
    spans = [(F.col("feature") == "purchase", {**window, "detector": F.lit(d)}) for d in detectors]
    found = detect.first_in_window_of(ev, ["user_id"], F.col("feature").isin(*detectors), spans, "t0", "t1", by={"detector": F.col("feature")})
    return found.select("event_id", "detector", (F.col("first_hit") - F.col("t0")).alias("delay"))


