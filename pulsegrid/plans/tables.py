"""Telemetry views of the driver tables, each with the same view in SQL.

``events`` is read as fleet telemetry: a user is a series, users are spread over four nodes, an event type is a
feature. The hourly matrix (counts per node, hour and type, zero-filled) plays the feature matrix; it is
aggregated on the map side, so its size follows the time span and not the number of events.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.stats import EULER_GAMMA
from pulsegrid.operators import blocks, detect, features, lifecycle
from pulsegrid.session import cut
from pulsegrid.vocabulary import INF

HOUR = 3600
FEATURES = ("click", "error", "purchase", "signup", "view")
# name, lo, hi, min_effect, direction, critical
SPEC = (
    ("click", 0.0, 1e9, 2.0, "both", INF),
    ("error", 0.0, 1e9, 2.0, "up", INF),
    ("purchase", 0.0, 1e9, 2.0, "down", INF),
    ("signup", 0.0, 1e9, 2.0, "both", INF),
    ("view", 0.0, 1e9, 2.0, "both", INF),
)
Z_HIGH, Z_LOW, VOTE_K, VOTE_N, LAM = 2.0, 1.4, 3, 4, 0.4
# instants inside and at the end of the month covered by the events
MID, END = 1705363200, 1706745600


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def width(df: DataFrame, keys: list[str], ts: str = "t", hour: int = HOUR) -> int:
    """Block width for raw events: a day, or less where one series is dense (``hour`` in the unit of ``ts``)."""
    return blocks.width_for(df, keys, ts, probe=hour, widest=24 * hour)


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def days(ts: str) -> Column:
    return F.expr(f"datediff(cast({ts} as date), DATE'1970-01-01')").cast("long")


def events(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").withColumn("us", micros("ts"))
    return rows.select(
        "event_id", F.expr("us div 1000000").alias("t"), "us", "user_id",
        F.concat(F.lit("node-"), (F.col("user_id") % 4).cast("string")).alias("target"),
        F.col("event_type").alias("feature"), "value", "props",
    )


EV = """ev AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, epoch_us(ts) AS us, user_id,
  'node-' || (user_id % 4) AS target, event_type AS feature, value, props FROM events)"""


def hourly(spark: SparkSession, sf: str, step: int = HOUR) -> DataFrame:
    """Counts per (target, step) and feature, one row for every step of a target."""
    ev = events(spark, sf).select("target", (F.expr(f"t div {step}") * step).alias("t"), "feature")
    # one scan of the events: the counts are small and everything downstream reads them again
    counts = cut(ev.groupBy("target", "t").agg(*[F.count_if(F.col("feature") == f).cast("double").alias(f) for f in FEATURES]))
    span = counts.groupBy("target").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    spine = span.select("target", F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("t"))
    return spine.join(counts, ["target", "t"], "left").fillna(0.0, list(FEATURES))


def matrix_sql(step: int = HOUR) -> str:
    return f"""{EV},
m0 AS (SELECT target, t // {step} * {step} AS t, {", ".join(f"count(*) FILTER (feature = '{f}') AS {f}" for f in FEATURES)} FROM ev GROUP BY 1, 2),
sp AS (SELECT target, unnest(generate_series(min(t), max(t), {step})) AS t FROM m0 GROUP BY target),
m AS (SELECT sp.target, sp.t, {", ".join(f"coalesce({f}, 0)::DOUBLE AS {f}" for f in FEATURES)} FROM sp LEFT JOIN m0 USING (target, t))"""


HOURLY = matrix_sql()

SPEC_SQL = "spec(ord, feature, lo, hi, min_effect, direction) AS (VALUES " + ", ".join(
    f"({i}, '{s[0]}', {s[1]}::DOUBLE, {s[2]}::DOUBLE, {s[3]}::DOUBLE, '{s[4]}')" for i, s in enumerate(SPEC)
) + ")"

LONG = f"""{HOURLY}, {SPEC_SQL},
l AS (SELECT target, t, feature, value FROM (UNPIVOT m ON {", ".join(FEATURES)} INTO NAME feature VALUE value))"""

BASE = f"""{LONG},
md AS (SELECT target, feature, quantile_cont(value, 0.5) AS median FROM l GROUP BY ALL),
mr AS (SELECT l.target, l.feature, md.median,
    greatest(quantile_cont(abs(l.value - md.median), 0.5), greatest(0.01 * abs(md.median), 0.01)) AS mad_raw
  FROM l JOIN md USING (target, feature) GROUP BY l.target, l.feature, md.median),
model AS (SELECT mr.*, spec.ord, spec.min_effect, spec.direction, greatest(mad_raw, 0.6745 * min_effect / 3.5) AS mad
  FROM mr JOIN spec USING (feature))"""

SCORED = f"""{BASE},
dv AS (SELECT l.target, l.t, l.feature, l.value, ord, min_effect, mad,
    0.6745 * (value - median) / mad AS z,
    CASE direction WHEN 'up' THEN greatest(value - median, 0) WHEN 'down' THEN least(value - median, 0) ELSE value - median END AS dev
  FROM l JOIN model USING (target, feature)),
zl AS (SELECT *, 0.6745 * dev / mad AS zdir FROM dv),
zs AS (SELECT target, t, max(abs(zdir)) AS z_max, sqrt(sum((dev / min_effect) * (dev / min_effect))) AS effect,
    first(feature ORDER BY abs(zdir) DESC, ord) AS top_feature, first(zdir ORDER BY abs(zdir) DESC, ord) AS top_z
  FROM zl GROUP BY 1, 2)"""

SMOOTH = f"""{SCORED},
rn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t) AS rn FROM zs),
sm AS (SELECT target, rn, z_max AS smoothed FROM rn WHERE rn = 1
  UNION ALL SELECT rn.target, rn.rn, {LAM} * rn.z_max + {1 - LAM} * sm.smoothed FROM sm JOIN rn ON rn.target = sm.target AND rn.rn = sm.rn + 1)"""


def latch_sql(source: str, value: str, high: float, low: float, k: int, n: int, out: str, keys: str = "target") -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY t"
    return f"""{out}_v AS (SELECT *, sum(({value} > {high})::INT) {w} ROWS {n - 1} PRECEDING) AS above_n,
    sum(({value} < {low})::INT) {w} ROWS {n - 1} PRECEDING) AS below_n FROM {source}),
{out}_s AS (SELECT *, CASE WHEN above_n >= {k} THEN 1 WHEN below_n = {n} THEN 0 END AS sig FROM {out}_v),
{out}_a AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) {w} ROWS UNBOUNDED PRECEDING), 0) AS act FROM {out}_s),
{out} AS (SELECT *, act = 1 AS active, act = 1 AND coalesce(lag(act) {w}), 0) = 0 AS opened,
    act = 0 AND coalesce(lag(act) {w}), 0) = 1 AS closed FROM {out}_a)"""


LATCH = f"""{SMOOTH},
sj AS (SELECT rn.*, sm.smoothed FROM rn JOIN sm USING (target, rn)),
{latch_sql("sj", "smoothed", Z_HIGH, Z_LOW, VOTE_K, VOTE_N, "lt")}"""


#: Notifications of hourly groups ``gs`` (route, alertname, node, job, t, members), members never empty, up to the hour
#: before the last: on whole hours every look but the first of an hour is a repeat at most, so windows say it all.
NOTIFIED = """gl AS (SELECT *, lag(t) OVER w = t - 3600 AS goes_on, lag(members) OVER w AS before, lead(t) OVER w = t + 3600 AS stays FROM gs WINDOW w AS (PARTITION BY route, alertname, node, job ORDER BY t)),
  gk AS (SELECT *, CASE WHEN NOT coalesce(goes_on, FALSE) THEN 'first' WHEN route = 'mail' AND members <> before OR NOT list_has_all(before, members) THEN 'changed' ELSE 'repeat' END AS reason FROM gl),
  ga AS (SELECT *, max(t) FILTER (reason = 'first') OVER w AS since, max(t) FILTER (reason <> 'repeat') OVER w AS told FROM gk WINDOW w AS (PARTITION BY route, alertname, node, job ORDER BY t)),
  gn AS (SELECT route, alertname, node, job, t AS h, t + 30 AS t, since, len(members) AS alerts, reason FROM ga WHERE route = 'mail' AND (t - told) % 14400 = 0
    UNION ALL SELECT route, alertname, node, job, t + 3600, t + 3630, since, 0, 'resolved' FROM ga WHERE route = 'mail' AND NOT coalesce(stays, FALSE)
    UNION ALL SELECT route, alertname, node, job, t, t + 10, since, len(members), reason FROM ga WHERE route = 'agent'
    UNION ALL SELECT route, alertname, node, job, t, t + 1810, since, len(members), 'repeat' FROM ga WHERE route = 'agent')
  SELECT route, alertname, node, job, t, since, alerts, reason FROM gn WHERE h < (SELECT max(t) FROM m)"""


def hourly_long(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    return hourly(spark, sf).select("target", "t", F.explode(pairs).alias("p")).select("target", "t", "p.*")


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return features.matrix(hourly(spark, sf), FEATURES)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    base = rows(spark, sf)
    return lifecycle.deviations(lifecycle.attach(base, lifecycle.fit_baseline(base, SPEC)))


def latched(spark: SparkSession, sf: str) -> DataFrame:
    scores = cut(scored(spark, sf).select("target", "t", "z_max", "effect", "top_feature", "top_z"))
    return detect.hysteresis(scores, ["target"], ["t"], "z_max", Z_HIGH, Z_LOW, VOTE_K, VOTE_N, LAM, width=5 * 86400)


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Event counter of each target, sampled hourly, restarting from zero every seven days."""
    total = sum((F.col(f) for f in FEATURES[1:]), F.col(FEATURES[0]))
    counted = hourly(spark, sf).select("target", "t", total.alias("n"), F.expr("t div 604800").alias("week"))
    return blocks.running(counted, ["target", "week"], ["t"], {"value": blocks.Run("sum", F.col("n"))}, 86400).select("target", "t", "value")


COUNTER = f"""{HOURLY},
c AS (SELECT target, t, sum(click + error + purchase + signup + view) OVER (PARTITION BY target, t // 604800 ORDER BY t) AS value FROM m)"""


# ---------------------------------------------------------------- a fleet whose level rises in steps, for regimes and forests
MONTH, RISE, LEVEL_DAYS = 1704067200, 6.0, 10
STEP_SPEC = tuple((n, lo, hi, e, d, c) for (n, lo, hi, _, d, _), e, c in zip(SPEC, (2.0, 2.0, 3.0, 3.0, 3.0), (9.0, INF, INF, INF, INF)))
#: A fixed forest: for each feature one tree of two splits at quantiles of the first level, with the sizes of its leaves.
TREE_SHARES, TREE_SIZES = (0.9, 0.99), (230, 22, 4)
SCORE_HIGH, SCORE_LOW = 0.5, 0.485


def stepped(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly matrix with ``view`` raised by ``RISE`` every ten days, except on one node."""
    level = F.when(F.col("target") == "node-3", 0).otherwise(F.floor((F.col("t") - MONTH) / (LEVEL_DAYS * 86400)))
    return hourly(spark, sf).withColumn("view", F.col("view") + RISE * level)


def first_level(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("t") < MONTH + LEVEL_DAYS * 86400)


def fixed_forest(rows: DataFrame) -> DataFrame:
    """Nodes of the fixed forest, from the rows (target, t, x) of the first level."""
    a, b = TREE_SHARES
    long = first_level(rows).select("target", F.posexplode("x").alias("tree", "v"))
    cuts = long.groupBy("target", "tree").agg(F.percentile("v", F.lit(a)).alias("a"), F.percentile("v", F.lit(b)).alias("b"))
    node = lambda no, feature, split, left, right, size, depth: F.struct(
        F.lit(no).alias("node"), (feature if feature is not None else F.lit(-1)).cast("int").alias("feature"), split.cast("double").alias("split"), F.lit(left).alias("left"), F.lit(right).alias("right"),
        F.lit(size).alias("size"), F.lit(depth).alias("depth"),
    )
    low, mid, top = TREE_SIZES
    tree, zero = F.col("tree"), F.lit(0.0)
    made = F.array(node(0, tree, F.col("a"), 1, 2, low + mid + top, 0), node(1, None, zero, -1, -1, low, 1), node(2, tree, F.col("b"), 3, 4, mid + top, 1), node(3, None, zero, -1, -1, mid, 2), node(4, None, zero, -1, -1, top, 2))
    return cuts.select("target", "tree", F.explode(made).alias("n")).select("target", "tree", "n.*")


def step_models(rows: DataFrame) -> DataFrame:
    """Models of the first level: production limits, the fixed forest's thresholds."""
    base = lifecycle.fit_baseline(first_level(rows), STEP_SPEC)
    return base.withColumns({
        "threshold": F.lit(SCORE_HIGH), "low_threshold": F.lit(SCORE_LOW), "if_suspended": F.lit(False), "seasonal": F.lit(False), "version": F.lit(1), "regime_start": F.lit(0).cast("long"),
    })


def step_scores(rows: DataFrame) -> DataFrame:
    """Scores of the rows by the fixed forest (the walk of the library), harmless deviations clamped away."""
    return lifecycle.isolation_scores(rows, step_models(rows), fixed_forest(rows)).select("target", "t", F.round("score", 9).alias("score"))


def _c(n: int) -> float:
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


_EFFECTS = [s[3] for s in STEP_SPEC]


def _signed(i: int, value: str) -> str:
    return {"up": f"greatest({value}, 0)", "down": f"least({value}, 0)"}.get(STEP_SPEC[i][4], f"({value})")


STEPPED = f"""{HOURLY},
hs AS (SELECT target, t, click, error, purchase, signup, view + CASE WHEN target = 'node-3' THEN 0 ELSE {RISE} * ((t - {MONTH}) // {LEVEL_DAYS * 86400}) END AS view FROM m),
hx AS (SELECT target, t, [{", ".join(FEATURES)}] AS x FROM hs),
hl AS (SELECT target, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM hx WHERE t < {MONTH + LEVEL_DAYS * 86400}),
hm AS (SELECT target, i, quantile_cont(v, 0.5) AS med, quantile_cont(v, {TREE_SHARES[0]}) AS a, quantile_cont(v, {TREE_SHARES[1]}) AS b FROM hl GROUP BY 1, 2),
hd AS (SELECT hl.target, hl.i, med, a, b, greatest(greatest(quantile_cont(abs(v - med), 0.5), greatest(0.01 * abs(med), 0.01)), 0.6745 * (CASE hl.i {" ".join(f"WHEN {i + 1} THEN {e}" for i, e in enumerate(_EFFECTS))} END) / 3.5) AS mad
  FROM hl JOIN hm ON hm.target = hl.target AND hm.i = hl.i GROUP BY hl.target, hl.i, med, a, b),
hq AS (SELECT target, list(med ORDER BY i) AS med, list(mad ORDER BY i) AS mad, list(a ORDER BY i) AS a, list(b ORDER BY i) AS b FROM hd GROUP BY 1),
hw AS (SELECT hx.*, med, mad, a, b, [{", ".join(f"med[{i + 1}] + {_signed(i, f'x[{i + 1}] - med[{i + 1}]')}" for i in range(5))}] AS cx FROM hx JOIN hq USING (target)),
hr AS (SELECT target, t, x, med, mad, (t % 86400) // 3600 BETWEEN 2 AND 7 AS sup,
    round(pow(2.0, -({" + ".join(f"CASE WHEN cx[{i}] <= a[{i}] THEN {1 + _c(TREE_SIZES[0])!r} WHEN cx[{i}] <= b[{i}] THEN {2 + _c(TREE_SIZES[1])!r} ELSE {2 + _c(TREE_SIZES[2])!r} END" for i in range(1, 6))}) / 5 / {_c(sum(TREE_SIZES))!r}), 9) AS score FROM hw)"""


def automaton_sql(kept: str = "TRUE", warmup: int = 20, high: float = 3.5, low: float = 2.5, window: int = 120, lasting: int = 1800) -> str:
    """The decision automaton of a target over STEPPED rows, row by row, as recursive SQL (``au``; regimes applied)."""
    frame = "PARTITION BY target ORDER BY t"
    flat = " AND ".join(f"quantile_cont(x[{i + 1}], 0.95) OVER f - quantile_cont(x[{i + 1}], 0.05) OVER f <= {e}" for i, e in enumerate(_EFFECTS))
    level = ", ".join(f"quantile_cont(x[{i + 1}], 0.5) OVER f" for i in range(5))
    dev = ", ".join(_signed(i, f"r.x[{i + 1}] - s.med[{i + 1}]") for i in range(5))
    votes = lambda name, test: f"list_append({name}, {test})[-{VOTE_N}:]"
    count = lambda name: f"len([y FOR y IN {name} IF y])"
    return f"""{STEPPED},
  hk AS (SELECT * FROM hr WHERE {kept}),
  ha AS (SELECT *, row_number() OVER ({frame}) AS rn, {flat} AS flat, [{level}] AS level FROM hk WINDOW f AS ({frame} ROWS {window - 1} PRECEDING)),
  hb AS (SELECT *, flat AND rn >= {window} AND x[1] < {STEP_SPEC[0][5]} AS steady FROM ha),
  au AS (
    SELECT DISTINCT target, 0::BIGINT AS rn, NULL::BIGINT AS t, med, NULL::DOUBLE AS sm, []::BOOLEAN[] AS ab, []::BOOLEAN[] AS be, FALSE AS za, NULL::DOUBLE AS fs, []::BOOLEAN[] AS fa, []::BOOLEAN[] AS fb, FALSE AS fo,
      []::BOOLEAN[] AS rel, FALSE AS act, NULL::BIGINT AS ev, NULL::VARCHAR AS ef, NULL::DOUBLE AS ez, NULL::VARCHAR AS ed, FALSE AS susp, NULL::DOUBLE AS z_max, NULL::DOUBLE AS smoothed, FALSE AS z_active, FALSE AS by_forest,
      NULL::BIGINT AS c_start, NULL::VARCHAR AS c_feature, NULL::DOUBLE AS c_z, NULL::VARCHAR AS c_det, NULL::VARCHAR AS kind FROM hb
    UNION ALL
    SELECT target, rn, t, CASE WHEN reg THEN level ELSE med END, CASE WHEN NOT reg THEN sm END, CASE WHEN reg THEN [] ELSE ab END, CASE WHEN reg THEN [] ELSE be END, za AND NOT reg, CASE WHEN NOT reg THEN fs END,
      CASE WHEN reg THEN [] ELSE fa END, CASE WHEN reg THEN [] ELSE fb END, fo AND NOT reg, CASE WHEN reg THEN [] ELSE rel END, wants AND NOT reg,
      CASE WHEN reg OR NOT wants THEN NULL WHEN was THEN ev ELSE t END, CASE WHEN reg OR NOT wants THEN NULL WHEN was THEN ef ELSE tf END, CASE WHEN reg OR NOT wants THEN NULL WHEN was THEN ez ELSE tz END,
      CASE WHEN reg OR NOT wants THEN NULL WHEN was THEN ed ELSE dets END, susp OR reg, z_max, sm, za, byf,
      CASE WHEN over THEN ev END, CASE WHEN over THEN ef END, CASE WHEN over THEN ez END, CASE WHEN over THEN ed END, CASE WHEN reg THEN 'regime' WHEN over THEN 'anomaly' END
    FROM (SELECT *, reg OR (was AND NOT wants) AS over, concat_ws('+', CASE WHEN byf THEN 'iforest' END, CASE WHEN za THEN 'zscore' END) AS dets FROM (
      SELECT *, wants AND was AND ev + {lasting} <= t AND steady AND xv >= med[5] AS reg FROM (
      SELECT * EXCLUDE (w0, b0), w0 AND NOT held AS wants, b0 AND NOT held AS byf FROM (
      SELECT *, (w0 AND NOT was AND (rn <= {warmup} OR sup)) AS held FROM (
      SELECT *, b0 OR za AS w0 FROM (
      SELECT *, fo AND {count("rel")} >= {VOTE_K} AND NOT susp AS b0 FROM (
      SELECT * EXCLUDE (za, fo), CASE WHEN {count("ab")} >= {VOTE_K} THEN TRUE WHEN len(be) = {VOTE_N} AND {count("be")} = {VOTE_N} THEN FALSE ELSE za END AS za,
        CASE WHEN {count("fa")} >= {VOTE_K} THEN TRUE WHEN len(fb) = {VOTE_N} AND {count("fb")} = {VOTE_N} THEN FALSE ELSE fo END AS fo FROM (
      SELECT * EXCLUDE (ab, be, fa, fb, rel), {votes("ab", f"sm > {high}")} AS ab, {votes("be", f"sm < {low}")} AS be, {votes("fa", f"fs > {SCORE_HIGH}")} AS fa, {votes("fb", f"fs < {SCORE_LOW}")} AS fb,
        {votes("rel", "effect >= 1")} AS rel FROM (
      SELECT * EXCLUDE (sm, fs), CASE WHEN sm IS NULL THEN z_max ELSE {LAM} * z_max + {1 - LAM} * sm END AS sm, CASE WHEN fs IS NULL THEN score ELSE {LAM} * score + {1 - LAM} * fs END AS fs,
        (['{"', '".join(FEATURES)}'])[list_position(az, z_max)] AS tf, z[list_position(az, z_max)] AS tz FROM (
      SELECT *, list_max(az) AS z_max FROM (
      SELECT *, [{", ".join(f"abs(z[{i}])" for i in range(1, 6))}] AS az FROM (
      SELECT *, [{", ".join(f"0.6745 * dev[{i}] / mad[{i}]" for i in range(1, 6))}] AS z, sqrt({" + ".join(f"(dev[{i + 1}] / {e}) * (dev[{i + 1}] / {e})" for i, e in enumerate(_EFFECTS))}) AS effect FROM (
      SELECT s.target, r.rn, r.t, s.med, s.sm, s.ab, s.be, s.za, s.fs, s.fa, s.fb, s.fo, s.rel, s.act AS was, s.ev, s.ef, s.ez, s.ed, s.susp, r.level, r.steady, r.sup, r.score, r.mad, r.x[5] AS xv, [{dev}] AS dev
      FROM au s JOIN hb r ON r.target = s.target AND r.rn = s.rn + 1))))))))))))))"""
