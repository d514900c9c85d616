"""Queries: models (M), evaluation and calibration (E)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import blocks, detect, evaluate, features, forest, lifecycle, registry
from pulsegrid.plans import tables as T
from pulsegrid.plans.aggregates import INJECTION_SQL, injections, psi_sql
from pulsegrid.plans.registry import query
from pulsegrid.plans.tables import BASE, EV, HOURLY, SCORED, latch_sql, read
from pulsegrid.plans.windows import _EPISODES, _HOLES, _holed
from pulsegrid.session import cut
from pulsegrid.streaming import jobs

KEY, WIDE = ["target"], 5 * 86400


@query("M1_fit_baseline", f"""WITH {BASE}, n AS (SELECT target, count(*) AS n, (max(t) - min(t)) / 3600.0::DOUBLE AS span FROM m GROUP BY 1)
  SELECT target, feature, round(median, 6) AS median, round(mad, 6) AS mad, n AS n_samples, round(span, 6) AS span_hours FROM model JOIN n USING (target)""")
def _(spark, sf):
    models = lifecycle.fit_baseline(T.rows(spark, sf), T.SPEC)
    f = models.select("target", "n_samples", "span_hours", F.explode(F.arrays_zip("names", "median", "mad")).alias("f"))
    return f.select("target", F.col("f.names").alias("feature"), F.round("f.median", 6).alias("median"), F.round("f.mad", 6).alias("mad"), "n_samples", F.round("span_hours", 6).alias("span_hours"))


@query("M2_augmentation", f"WITH {HOURLY} SELECT target, 4 * count(*) AS rows, 0::BIGINT AS beyond, TRUE AS centred FROM m GROUP BY 1")
def _(spark, sf):
    base = T.rows(spark, sf)
    effects = F.array(*[F.lit(s[3]) for s in T.SPEC])
    shaken = forest.augment(base.withColumn("x0", F.col("x")), effects)
    off = F.exists(F.zip_with("x", "x0", lambda a, b: F.abs(a - b)), lambda d: d > 1.0)
    drift = F.avg(F.aggregate(F.zip_with("x", "x0", lambda a, b: a - b), F.lit(0.0), lambda a, b: a + b))
    return shaken.groupBy("target").agg(F.count("*").alias("rows"), F.count_if(off).alias("beyond"), (F.abs(drift) < 0.2).alias("centred"))


def _forest(spark, sf):
    base = cut(T.rows(spark, sf))
    shaken = forest.augment(base, F.array(*[F.lit(s[3]) for s in T.SPEC]))
    return base, shaken, cut(forest.fit_forest(shaken.select("target", "t", "copy", "x")))


@query("M3_forest_fit", f"WITH {HOURLY} SELECT target, 200::BIGINT AS trees, least(256, 4 * count(*))::BIGINT AS sample, TRUE AS shallow, TRUE AS complete FROM m GROUP BY 1")
def _(spark, sf):
    _, _, nodes = _forest(spark, sf)
    trees = nodes.groupBy("target", "tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).alias("root"), F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("leaves"), F.max("depth").alias("depth")
    )
    return trees.groupBy("target").agg(
        F.count("*").alias("trees"), F.max("root").alias("sample"), (F.max("depth") <= 8).alias("shallow"), F.bool_and(F.col("root") == F.col("leaves")).alias("complete")
    )


@query("M4_forest_score")
def _(spark, sf):
    base, _, nodes = _forest(spark, sf)
    return forest.score(base, nodes).select("target", "t", F.round("score", 6).alias("score"))


@query("M5_thresholds", f"WITH {SCORED}, q AS (SELECT target, quantile_cont(z_max, 0.995) AS hi, quantile_cont(z_max, 0.5) AS c FROM zs GROUP BY 1) SELECT target, round(hi, 6) AS threshold, round(c + 0.5 * (hi - c), 6) AS low_threshold FROM q")
def _(spark, sf):
    limits = forest.thresholds(T.scored(spark, sf).select("target", F.col("z_max").alias("score")))
    return limits.select("target", F.round("threshold", 6).alias("threshold"), F.round("low_threshold", 6).alias("low_threshold"))


@query("M6_flags", f"WITH {SCORED} SELECT target, t, z_max > 3.5 OR (target <> 'node-3' AND effect / 2 > 0.9 AND effect >= 1) AS flagged FROM zs")
def _(spark, sf):
    base = T.rows(spark, sf)
    models = lifecycle.fit_baseline(base, T.SPEC).withColumns({"threshold": F.lit(0.9), "low_threshold": F.lit(0.5), "if_suspended": F.col("target") == "node-3", "seasonal": F.lit(False), "version": F.lit(1)})
    scores = T.scored(spark, sf).select("target", "t", (F.col("effect") / 2).alias("score"))
    return lifecycle.flags(base, models, scores).select("target", "t", "flagged")


@query("M7_champion_challenger")
def _(spark, sf):
    base = cut(T.rows(spark, sf))
    old_models, old_nodes, _ = lifecycle.champion_challenger(base.where(F.col("t") < T.MID), T.SPEC)
    champion = (old_models.withColumn("if_suspended", F.col("target") == "node-3"), old_nodes)
    _, _, verdict = lifecycle.champion_challenger(base, T.SPEC, champion)
    return verdict.select(
        "target", "accepted", "obsolete", "seasonal", "removed", "n_train", "n_holdout", F.round("challenger_fpr", 6).alias("challenger_fpr"), F.round("champion_fpr", 6).alias("champion_fpr"), "version"
    )


@query("M8_retrain_predicate", """WITH s AS (SELECT c_custkey, 100000 - c_custkey * 7 % 40000 AS trained_at, c_custkey % 4 = 0 AS no_model, c_custkey % 5 = 0 AS active, c_custkey % 6 = 0 AS susp, c_custkey % 3 = 0 AS drift, 100000 - c_custkey % 5000 AS last FROM customer)
  SELECT c_custkey, CASE WHEN no_model THEN 100000 - last >= 120 WHEN active THEN FALSE WHEN susp THEN 100000 - last >= 120 WHEN 100000 - last < 3600 THEN FALSE ELSE drift OR 100000 - trained_at >= 21600 END AS should_train FROM s""")
def _(spark, sf):
    key = F.col("c_custkey")
    state = read(spark, sf, "customer").select(
        "c_custkey", F.when(key % 4 != 0, 100000 - key * 7 % 40000).alias("trained_at"), (key % 5 == 0).alias("active"), (key % 6 == 0).alias("if_suspended"), (key % 3 == 0).alias("drift"), (100000 - key % 5000).alias("last_attempt")
    )
    return lifecycle.should_train(state, 100000).select("c_custkey", "should_train")


_REGIME_SPEC = tuple((n, lo, hi, e, d, c) for (n, lo, hi, _, d, _), e, c in zip(T.SPEC, (2.0, 2.0, 3.0, 3.0, 3.0), (4.0, V.INF, V.INF, V.INF, V.INF)))


@query("M9_regime_change", f"""WITH {BASE}, r AS (SELECT m.*, row_number() OVER w AS rn, (m.t // 3600) % 200 >= 40 AS active,
    {" AND ".join(f"quantile_cont({s[0]}, 0.95) OVER f - quantile_cont({s[0]}, 0.05) OVER f <= {s[3]}" for s in _REGIME_SPEC)} AS flat FROM m
    WINDOW w AS (PARTITION BY target ORDER BY t), f AS (PARTITION BY target ORDER BY t ROWS 119 PRECEDING)),
  st AS (SELECT *, last_value(CASE WHEN active AND NOT coalesce(pa, FALSE) THEN t END IGNORE NULLS) OVER (PARTITION BY target ORDER BY t) AS start FROM (SELECT *, lag(active) OVER (PARTITION BY target ORDER BY t) AS pa FROM r)),
  ok AS (SELECT target, min(t) AS t, min_by(start, t) AS regime_start, min_by(rn, t) AS rn FROM st WHERE active AND t - start >= 1800 AND rn >= 120 AND flat AND click < 4
    AND view >= (SELECT median FROM model WHERE model.target = st.target AND feature = 'view') GROUP BY 1)
  SELECT ok.target, ok.t, regime_start, quantile_cont(r.click, 0.5) AS click, quantile_cont(r.view, 0.5) AS view FROM ok JOIN r ON r.target = ok.target AND r.rn <= ok.rn AND r.rn > ok.rn - 120 GROUP BY 1, 2, 3""")
def _(spark, sf):
    base = T.rows(spark, sf)
    scored = lifecycle.attach(base, lifecycle.fit_baseline(base, T.SPEC)).withColumn("active", F.expr("(t div 3600) % 200 >= 40"))
    found = lifecycle.regime_candidates(cut(scored), _REGIME_SPEC, count_feature="view", width=WIDE)
    return found.select("target", "t", "regime_start", F.col("plateau_median")[0].alias("click"), F.col("plateau_median")[4].alias("view"))


def _step_detections(spark, sf):
    base = cut(features.matrix(T.stepped(spark, sf), T.FEATURES))
    quiet = F.floor((F.col("t") % 86400) / 3600).between(2, 7)
    return lifecycle.detect_with_regimes(base, cut(T.step_scores(base)), T.step_models(base), quiet, T.STEP_SPEC, "view", warmup=20, lam=T.LAM, width=WIDE)


@query("M9_regime_loop", f"""WITH RECURSIVE {T.automaton_sql()} SELECT target, t, c_start AS regime_start, row_number() OVER (PARTITION BY target ORDER BY t) AS number, med[1] AS click, med[5] AS view FROM au WHERE kind = 'regime'""")
def _(spark, sf):
    _, regimes = _step_detections(spark, sf)
    return regimes.select("target", "t", "regime_start", F.col("number").cast("long").alias("number"), F.col("plateau_median")[0].alias("click"), F.col("plateau_median")[4].alias("view"))


@query("W8_regime_decisions", f"WITH RECURSIVE {T.automaton_sql()} SELECT target, t, round(smoothed, 6) AS smoothed, z_active, by_forest AS if_effective, act AS active, coalesce(kind = 'regime', FALSE) AS regime FROM au WHERE rn > 0")
def _(spark, sf):
    found, _ = _step_detections(spark, sf)
    return found.select("target", "t", F.round("z_smoothed", 6).alias("smoothed"), "z_active", (F.col("if_effective") & (F.col("active") | F.col("regime"))).alias("if_effective"), "active", "regime")


@query("M4_fixed_forest", f"WITH {T.STEPPED} SELECT target, t, score FROM hr")
def _(spark, sf):
    return T.step_scores(cut(features.matrix(T.stepped(spark, sf), T.FEATURES)))


@query("M10_drift", f"""WITH {SCORED}, rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t DESC) AS r FROM zs),
  {psi_sql("SELECT target, z_max AS score FROM rk WHERE r > 240", "SELECT target, z_max AS score FROM rk WHERE r <= 240", "target", "score")}
  SELECT target, round(psi, 6) AS psi, psi > 0.25 AS drift FROM psi WHERE target <> 'node-2'""")
def _(spark, sf):
    scores = T.scored(spark, sf).select("target", "t", F.col("z_max").alias("score"))
    indexed = cut(blocks.with_index(scores.withColumn("back", -F.col("t")), KEY, ["back"], "r", WIDE))
    suspended = spark.createDataFrame([("node-2", True)], "target string, if_suspended boolean")
    value = lifecycle.drift(indexed.where("r < 240").select("target", "score"), indexed.where("r >= 240").select("target", "score"), suspended)
    return value.select("target", F.round("psi", 6).alias("psi"), "drift")


@query("M11_saturation_forecast", f"""WITH {HOURLY}, f AS (SELECT target, feature, t, value FROM (UNPIVOT m ON click, view INTO NAME feature VALUE value) WHERE t >= {T.END} - 360000 AND t <= {T.END}),
  p AS (SELECT target, feature, (t - min(t) OVER (PARTITION BY target, feature)) / 3600.0::DOUBLE AS x, value AS y FROM f),
  sl AS (SELECT a.target, a.feature, quantile_cont((b.y - a.y) / (b.x - a.x), 0.5) AS slope FROM p a JOIN p b ON a.target = b.target AND a.feature = b.feature AND a.x < b.x GROUP BY 1, 2),
  ic AS (SELECT p.target, p.feature, slope, quantile_cont(y - slope * x, 0.5) AS b0, avg(y) AS my, max(x) AS lx FROM p JOIN sl USING (target, feature) GROUP BY 1, 2, 3),
  r AS (SELECT target, feature, slope, b0 + slope * lx AS level, 1 - sum((y - b0 - slope * x) ** 2) / sum((y - my) ** 2) AS r2 FROM p JOIN ic USING (target, feature) GROUP BY target, feature, slope, b0, lx)
  SELECT target, feature, round(slope, 6) AS slope, round(r2, 6) AS r2, round(CASE WHEN slope > 1e-9 THEN greatest(0, least((100 - level) / slope, 8760)) ELSE 8760 END, 4) AS hours, slope > 1e-9 AND r2 >= 0.7 AS reliable FROM r""")
def _(spark, sf):
    found = lifecycle.forecast(T.hourly_long(spark, sf).where("feature in ('click', 'view')"), ["target", "feature"], T.END, 100)
    return found.select("target", "feature", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), F.round("hours", 4).alias("hours"), "reliable")


@query("M12_model_registry", """WITH v AS (SELECT c_nationkey AS target, c_custkey AS version, CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 5 END AS sv, c_mktsegment AS sig, c_custkey % 3 AS f, c_acctbal AS threshold FROM customer),
  ok AS (SELECT * FROM v WHERE sv = 5 AND f <> 1 AND (target % 2 = 0 OR sig = 'BUILDING')) SELECT 'n' || target AS target, max(version) AS version, arg_max(threshold, version) AS threshold FROM ok GROUP BY 1""")
def _(spark, sf):
    key = F.col("c_custkey")
    target = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    shape = {"min_effects": F.array(F.lit(2.0), F.lit(1.0)), "directions": F.array(F.lit("up"), F.lit("both"))}
    models = read(spark, sf, "customer").select(
        target.alias("target"), key.alias("version"), F.when(key % 4 == 0, 4).otherwise(V.MODEL_SCHEMA_VERSION).alias("schema_version"), F.col("c_mktsegment").alias("signature"),
        F.when(key % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("names"), *[c.alias(k) for k, c in shape.items()], F.col("c_acctbal").alias("threshold"),
    )
    expected = read(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "node").otherwise("application").alias("kind"),
        F.lit("BUILDING").alias("signature"), F.array(F.lit("a"), F.lit("b")).alias("names"), *[c.alias(k) for k, c in shape.items()],
    )
    return lifecycle.usable_models(models, expected).select("target", "version", "threshold")


@query("M12_registry_cycle", """WITH v AS (SELECT c_nationkey AS k, c_custkey AS version, CASE WHEN c_custkey % 4 = 0 THEN 4 ELSE 5 END AS sv, c_mktsegment AS sig, c_acctbal AS threshold, c_custkey % 1000 AS trained FROM customer),
  ok AS (SELECT k, max(version) AS version, arg_max(threshold, version) AS threshold, arg_max(trained, version) AS trained FROM v WHERE sv = 5 AND (k % 2 = 0 OR sig = 'BUILDING') GROUP BY 1),
  d AS (SELECT *, k % 5 = 4 AS short, k % 3 = 0 AS accepted FROM ok)
  SELECT 'n' || k AS target, version + CASE WHEN NOT short AND accepted THEN 1 ELSE 0 END AS version, CASE WHEN NOT short AND accepted THEN 0.5 ELSE threshold END AS threshold,
    CASE WHEN short THEN trained ELSE 200000 END AS trained_at, short OR NOT accepted AS champion FROM d""")
def _(spark, sf):
    key, target = F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    shape = {"names": F.array(F.lit("a")), "min_effects": F.array(F.lit(2.0)), "directions": F.array(F.lit("up"))}
    table = registry.Registry(spark, jobs.new_folder(spark, "registry"))
    table.put(read(spark, sf, "customer").select(
        target.alias("target"), key.alias("version"), F.when(key % 4 == 0, 4).otherwise(V.MODEL_SCHEMA_VERSION).alias("schema_version"), F.col("c_mktsegment").alias("signature"),
        (key % 1000).cast("long").alias("trained_at"), F.col("c_acctbal").cast("double").alias("threshold"), *[c.alias(k) for k, c in shape.items()],
    ), None, "first")
    expected = read(spark, sf, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "node").otherwise("application").alias("kind"), F.lit("BUILDING").alias("signature"), *[c.alias(k) for k, c in shape.items()]
    )
    champions = cut(table.current(expected))
    number = F.substring("target", 2, 9).cast("int")
    decided = champions.where(number % 5 != 4).select("target", (number % 3 == 0).alias("accepted"), (F.col("version") + F.when(number % 3 == 0, 1).otherwise(0)).alias("version"))
    challengers = champions.select("target", "version", F.lit(0.5).alias("threshold"), *[c.alias(k) for k, c in shape.items()])
    table.put(registry.settled(decided, champions, challengers, expected, 200_000), None, "train")
    now = table.current(expected)
    return now.select("target", "version", "threshold", "trained_at", (F.col("threshold") != 0.5).alias("champion"))


@query("M13_tuning_override", """WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '4.5' WHEN 1 THEN '{oops' END AS z, CASE c_custkey % 5 WHEN 0 THEN '5' END AS k FROM customer)
  SELECT c_custkey, coalesce(try_cast(z AS DOUBLE), 3.5)::DOUBLE AS z_high, 2.5::DOUBLE AS z_low, 0.4::DOUBLE AS ewma_lambda, coalesce(try_cast(k AS INT), 3) AS vote_k, 4 AS vote_n, try_cast(z AS DOUBLE) IS NOT NULL OR k IS NOT NULL AS tuned FROM t""")
def _(spark, sf):
    none = F.lit(None).cast("string")
    key = F.col("c_custkey")
    targets = read(spark, sf, "customer").select(key.alias("target"))
    tuning = read(spark, sf, "customer").select(
        key.alias("target"), F.when(key % 4 == 0, "4.5").when(key % 4 == 1, "{oops").alias("z_high"), none.alias("z_low"), none.alias("ewma_lambda"), F.when(key % 5 == 0, "5").alias("vote_k"), none.alias("vote_n")
    )
    return lifecycle.apply_tuning(targets, tuning).withColumnRenamed("target", "c_custkey")


# ---------------------------------------------------------------- evaluation
#: The operator's least rows of a fold, for a cycle of an hour instead of ``SCORE_STEP`` seconds.
E1_ROWS = V.REPLAY_MIN_ROWS * V.SCORE_STEP // 3600


@query("E1_rolling_replay", f"""WITH RECURSIVE {HOURLY}, d AS (SELECT target, unnest(generate_series(min(t) // 86400 + 3, max(t) // 86400)) AS day FROM m GROUP BY target),
  tr AS (SELECT d.target, d.day, m.t, unnest([{{f: 'click', v: click}}, {{f: 'error', v: error}}, {{f: 'purchase', v: purchase}}, {{f: 'signup', v: signup}}, {{f: 'view', v: view}}]) AS c FROM d JOIN m ON m.target = d.target AND m.t >= (d.day - 3) * 86400 AND m.t < d.day * 86400 AND ((m.t - (d.day - 3) * 86400) // 3600) % 2 = 0),
  md AS (SELECT target, day, c.f AS f, quantile_cont(c.v, 0.5) AS med FROM tr GROUP BY 1, 2, 3),
  mm AS (SELECT tr.target, tr.day, c.f AS f, med, greatest(greatest(quantile_cont(abs(c.v - med), 0.5), greatest(0.01 * abs(med), 0.01)), 0.6745 * 2 / 3.5) AS mad FROM tr JOIN md ON md.target = tr.target AND md.day = tr.day AND md.f = c.f GROUP BY tr.target, tr.day, c.f, med),
  te AS (SELECT d.target, d.day, m.t, unnest([{{f: 'click', v: click}}, {{f: 'error', v: error}}, {{f: 'purchase', v: purchase}}, {{f: 'signup', v: signup}}, {{f: 'view', v: view}}]) AS c FROM d JOIN m ON m.target = d.target AND m.t // 86400 = d.day),
  zz AS (SELECT te.target, te.day, t, max(abs(0.6745 * CASE c.f WHEN 'error' THEN greatest(c.v - med, 0) WHEN 'purchase' THEN least(c.v - med, 0) ELSE c.v - med END / mad)) AS z_max FROM te JOIN mm ON mm.target = te.target AND mm.day = te.day AND mm.f = c.f GROUP BY 1, 2, 3),
  ok AS (SELECT target, day FROM (SELECT target, day, count(DISTINCT t) AS n FROM tr GROUP BY 1, 2) JOIN (SELECT target, day, count(DISTINCT t) AS k FROM te GROUP BY 1, 2) USING (target, day) WHERE n >= {E1_ROWS} AND k >= {E1_ROWS}),
  rn AS (SELECT *, row_number() OVER (PARTITION BY target, day ORDER BY t) AS rn FROM zz JOIN ok USING (target, day)),
  sm AS (SELECT target, day, rn, z_max AS s FROM rn WHERE rn = 1 UNION ALL SELECT rn.target, rn.day, rn.rn, 0.4 * rn.z_max + 0.6 * sm.s FROM sm JOIN rn ON rn.target = sm.target AND rn.day = sm.day AND rn.rn = sm.rn + 1),
  sj AS (SELECT rn.*, sm.s AS smoothed FROM rn JOIN sm USING (target, day, rn)), {latch_sql("sj", "smoothed", 2.0, 1.4, 3, 4, "lt", "target, day")}
  SELECT target, day, count(*)::DOUBLE AS hours, count(*) FILTER (opened) AS opens FROM lt GROUP BY 1, 2""")
def _(spark, sf):
    base = features.matrix(T.hourly(spark, sf), T.FEATURES)
    folds = cut(evaluate.rolling_folds(base, step=3600, min_rows=E1_ROWS))
    keyed = folds.withColumn("target", F.concat_ws("|", "target", F.col("day").cast("string")))
    models = lifecycle.fit_baseline(keyed.where("role = 'train'").select("target", "t", "x"), T.SPEC)
    scored = lifecycle.deviations(lifecycle.attach(keyed.where("role = 'test'").select("target", "t", "x"), models)).select("target", "t", "z_max")
    replayed = detect.hysteresis(cut(scored), KEY, ["t"], "z_max", 2.0, 1.4, 3, 4, 0.4, width=86400)
    part = F.split("target", r"\|")
    return replayed.groupBy(part[0].alias("target"), part[1].cast("long").alias("day")).agg(F.count("*").cast("double").alias("hours"), F.count_if("opened").alias("opens"))


QUARTER = 900
E_NAMES = ("cpu_host", "ram_host", "disk_host", "cpu_server", "ram_server_mb")
E_SPEC = tuple((n, 0.0, 30.0, 2.0, d, V.INF) for n, d in zip(E_NAMES, ("up", "up", "up", "up", "both")))
E_CATALOGUE = (("surcharge", "cpu_host", 8.0), ("pression", "ram_host", 12.0), ("boucle", "cpu_server", 10.0), ("fuite", "ram_server_mb", 16.0))
E_RULES = (("cpu_host", 3, 8), ("ram_host", 2, 8), ("disk_host", 2, 20))

_INJECTED = f"""{T.matrix_sql(QUARTER)},
  ix AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY target) AS n FROM m),
  sl AS (SELECT target, unnest(range(120, n - 48, 200)) AS start FROM (SELECT target, max(n) AS n FROM ix GROUP BY 1)),
  ct(no, fault, feature, effect) AS (VALUES {", ".join(f"({i}, '{a}', '{b}', {c}::DOUBLE)" for i, (a, b, c) in enumerate(E_CATALOGUE))}),
  so AS (SELECT target, start, (start - 120) // 200 AS slot, fault, feature, effect, [0.25, 0.5, 1.0][((start - 120) // 200 // 4) % 3 + 1]::DOUBLE AS intensity FROM sl JOIN ct ON ct.no = ((start - 120) // 200) % 4),
  w AS (SELECT so.*, ix.t, i - start + 120 AS o, click, error, purchase, signup, "view" FROM so JOIN ix ON ix.target = so.target AND ix.i BETWEEN so.start - 120 AND so.start + 47),
  rp AS (SELECT *, CASE WHEN o BETWEEN 120 AND 159 THEN intensity * CASE WHEN feature = 'ram_host' THEN 1 ELSE least(1, (o - 119) / 8.0) END ELSE 0 END::DOUBLE AS lift FROM w),
  ij AS (SELECT target, slot, start, fault, feature, effect, intensity, t, o,
    least(30, greatest(0, click + CASE feature WHEN 'cpu_host' THEN effect * lift WHEN 'cpu_server' THEN 25 * lift ELSE 0 END)) AS cpu_host,
    least(30, greatest(0, error + CASE feature WHEN 'ram_host' THEN effect * lift WHEN 'ram_server_mb' THEN effect * lift / 400 * 100 ELSE 0 END)) AS ram_host,
    least(30, greatest(0, purchase)) AS disk_host, least(30, greatest(0, signup + CASE feature WHEN 'cpu_server' THEN effect * lift ELSE 0 END)) AS cpu_server,
    least(30, greatest(0, "view" + CASE feature WHEN 'ram_server_mb' THEN effect * lift ELSE 0 END)) AS ram_server_mb FROM rp)"""


def _quarter_rows(spark, sf):
    return features.matrix(T.hourly(spark, sf, QUARTER), T.FEATURES)


def _injected(spark, sf):
    base = blocks.with_index(_quarter_rows(spark, sf), KEY, ["t"], "i", WIDE)
    days = base.groupBy("target").agg(F.count("*").alias("n"))
    slot_table = evaluate.slots(days, E_CATALOGUE, KEY)
    windows = evaluate.slot_rows(base, slot_table, KEY)
    return windows.withColumn("x", evaluate.injected(F.col("x"), E_NAMES, [(s[1], s[2]) for s in E_SPEC], 400.0))


@query("E2_fault_injection", f"WITH {_INJECTED} SELECT target, slot, t, o AS \"offset\", fault, intensity, {', '.join(f'round({n}, 6) AS {n}' for n in E_NAMES)} FROM ij")
def _(spark, sf):
    rows = _injected(spark, sf)
    return rows.select("target", "slot", "t", "offset", "fault", "intensity", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(E_NAMES)])


_REPLAYED = f"""{_INJECTED}, un AS (SELECT target, t, unnest([{", ".join(f"{{n: '{n}', o: {i}, v: {f}}}" for i, (n, f) in enumerate(zip(E_NAMES, ("click", "error", "purchase", "signup", '"view"'))))}]) AS c FROM m),
  d0 AS (SELECT target, c.n AS n, quantile_cont(c.v, 0.5) AS med FROM un GROUP BY 1, 2),
  d1 AS (SELECT un.target, c.n AS n, med, greatest(greatest(quantile_cont(abs(c.v - med), 0.5), greatest(0.01 * abs(med), 0.01)), 0.6745 * 2 / 3.5) AS mad FROM un JOIN d0 ON d0.target = un.target AND d0.n = c.n GROUP BY un.target, c.n, med),
  iu AS (SELECT target, slot, o, unnest([{", ".join(f"{{n: '{n}', o: {i}, v: {n}}}" for i, n in enumerate(E_NAMES))}]) AS c FROM ij),
  zf AS (SELECT iu.target, slot, iu.o, c.n AS n, c.o AS ord, 0.6745 * CASE WHEN c.n = 'ram_server_mb' THEN c.v - med ELSE greatest(c.v - med, 0) END / mad AS z FROM iu JOIN d1 ON d1.target = iu.target AND d1.n = c.n),
  zt AS (SELECT target, slot, o AS t, max(abs(z)) AS z_max, first(n ORDER BY abs(z) DESC, ord) AS top_feature FROM zf GROUP BY 1, 2, 3),
  rn AS (SELECT *, row_number() OVER (PARTITION BY target, slot ORDER BY t) AS rn FROM zt),
  sm AS (SELECT target, slot, rn, z_max AS s FROM rn WHERE rn = 1 UNION ALL SELECT rn.target, rn.slot, rn.rn, 0.4 * rn.z_max + 0.6 * sm.s FROM sm JOIN rn ON rn.target = sm.target AND rn.slot = sm.slot AND rn.rn = sm.rn + 1),
  sj AS (SELECT rn.*, sm.s AS smoothed FROM rn JOIN sm USING (target, slot, rn)), {latch_sql("sj", "smoothed", 2.0, 1.4, 3, 4, "lt", "target, slot")},
  fx AS (SELECT target, slot, o, {", ".join(f"sum(({n} > {x})::INT) OVER (PARTITION BY target, slot ORDER BY o ROWS {k - 1} PRECEDING) = {k} AS h{i}" for i, (n, x, k) in enumerate(E_RULES))} FROM ij WHERE o >= 120),
  fh AS (SELECT target, slot, min(o) - 120 AS fx FROM fx WHERE h0 OR h1 OR h2 GROUP BY 1, 2),
  facts AS (SELECT target, slot, max(CASE WHEN t = 119 THEN act END) AS before, min(CASE WHEN opened AND t >= 120 THEN t END) AS hit FROM lt GROUP BY 1, 2),
  mt AS (SELECT facts.target, facts.slot, fault, feature, intensity, round(effect * intensity, 2) AS effect, hit, fx, top_feature FROM facts JOIN so USING (target, slot) LEFT JOIN fh USING (target, slot)
    LEFT JOIN zt ON zt.target = facts.target AND zt.slot = facts.slot AND zt.t = facts.hit WHERE coalesce(before, 0) = 0)"""


def _replayed(spark, sf):
    models = lifecycle.fit_baseline(_quarter_rows(spark, sf), E_SPEC)
    rows = cut(_injected(spark, sf).select("target", "slot", "offset", "x", "fault", "feature", "intensity", "fault_effect"))
    scored = lifecycle.deviations(lifecycle.attach(rows.withColumn("t", F.col("offset")), models))
    kept = cut(scored.select("target", "slot", "offset", "x", "fault", "feature", "intensity", "fault_effect", "z_max", "top_feature"))
    # a slot window has 168 rows, so one block holds it
    return detect.hysteresis(kept, ["target", "slot"], ["offset"], "z_max", 2.0, 1.4, 3, 4, 0.4, width=4096)


@query("E3_already_active", f"WITH RECURSIVE {_REPLAYED} SELECT target, slot, max(CASE WHEN t = 119 THEN act END) = 1 AS excluded FROM lt GROUP BY 1, 2")
def _(spark, sf):
    rows = _replayed(spark, sf)
    return rows.groupBy("target", "slot").agg((F.max(F.when(F.col("offset") == V.REPLAY_WARM - 1, F.col("active").cast("int"))) == 1).alias("excluded"))


@query("E4_detection_match", f"""WITH RECURSIVE {_REPLAYED} SELECT target, slot, fault, feature, intensity, effect, (hit IS NOT NULL)::INT AS detected, (hit - 120) * 15 AS delay_s, CASE WHEN hit IS NOT NULL THEN top_feature END AS top_feature,
  coalesce(top_feature = feature AND hit IS NOT NULL, FALSE)::INT AS diagnosed, (fx IS NOT NULL AND fx < 48)::INT AS threshold_detected, CASE WHEN fx < 48 THEN fx * 15 END AS threshold_delay_s FROM mt""")
def _(spark, sf):
    return evaluate.match_faults(cut(_replayed(spark, sf)), ["target", "slot"], E_RULES, E_NAMES)


@query("E5_paired_comparison", f"WITH RECURSIVE {_REPLAYED} SELECT fault, count(*) AS n, count(*) FILTER (hit IS NOT NULL AND NOT (fx IS NOT NULL AND fx < 48)) AS model_only, count(*) FILTER (hit IS NULL AND fx < 48) AS threshold_only FROM mt GROUP BY 1")
def _(spark, sf):
    faults = evaluate.match_faults(cut(_replayed(spark, sf)), ["target", "slot"], E_RULES, E_NAMES)
    hit, seen = F.col("detected") == 1, F.col("threshold_detected") == 1
    return faults.groupBy("fault").agg(F.count("*").alias("n"), F.count_if(hit & ~seen).alias("model_only"), F.count_if(seen & ~hit).alias("threshold_only"))


def _grid_sql() -> str:
    parts = []
    for lam in V.GRID_LAMBDA:
        name = f"s{int(lam * 10)}"
        parts.append(
            f"{name} AS (SELECT target, rn, z_max AS v FROM rn WHERE rn = 1 UNION ALL SELECT rn.target, rn.rn, {lam} * rn.z_max + {1 - lam} * {name}.v FROM {name} JOIN rn ON rn.target = {name}.target AND rn.rn = {name}.rn + 1)"
        )
    settings = []
    for lam in V.GRID_LAMBDA:
        for k, n in V.GRID_VOTE:
            for high in V.GRID_Z_HIGH:
                no, h = len(settings), high / 2
                name = f"g{no}"
                parts.append(f"{name}j AS (SELECT target, t, v FROM s{int(lam * 10)} JOIN rn USING (target, rn)), {latch_sql(name + 'j', 'v', h, h - 0.5, k, n, name)}")
                settings.append(f"SELECT target, {no} AS setting, {lam}::DOUBLE AS lam, {k} AS k, {n} AS n, {high}::DOUBLE AS z_high, count(*) FILTER (opened) AS opens FROM {name} GROUP BY 1")
    return f"WITH RECURSIVE {SCORED}, rn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t) AS rn FROM zs), {', '.join(parts)} {' UNION ALL '.join(settings)}"


@query("E6_grid_calibration", _grid_sql())
def _(spark, sf):
    # counts are calmer than real scores: doubling z halves the limits of the grid
    z = T.scored(spark, sf).select("target", "t", (F.col("z_max") * 2).alias("z_max"))
    return evaluate.replay_grid(cut(z), KEY, width=WIDE).select("target", "setting", "lam", "k", "n", "z_high", "opens")


#: Three faults of the calibration stream (name, first row, last row) and the delay in seconds each may take.
_FAULTS = (("cpu", 200, 239), ("memory", 350, 389), ("network", 500, 539))
_LIMITS = {"cpu": 120, "memory": 600, "network": 120}
_CALM = 0.6  # outside the faults the stream is this much calmer than the counts


def _calibration_sql() -> str:
    """Every setting on the quiet series (as E6_grid_calibration) and on the fault stream, fused and ranked."""
    scale = f"CASE WHEN {' OR '.join(f'rn BETWEEN {a} AND {b}' for _, a, b in _FAULTS)} THEN 4 ELSE {_CALM} END"
    parts = [f"fs AS (SELECT target, rn AS t, rn, z_max * {scale} AS z, effect * {scale} / 10 AS sc, effect * {scale} >= 1 AS rel FROM rn)"]
    for lam in V.GRID_LAMBDA:
        no = int(lam * 10)
        for series, value in (("z", f"fz{no}"), ("sc", f"ff{no}")):
            parts.append(f"{value} AS (SELECT target, rn, {series} AS v FROM fs WHERE rn = 1 UNION ALL SELECT fs.target, fs.rn, {lam} * fs.{series} + {1 - lam} * {value}.v FROM {value} JOIN fs ON fs.target = {value}.target AND fs.rn = {value}.rn + 1)")
    opened = []
    setting = 0
    for lam in V.GRID_LAMBDA:
        for k, n in V.GRID_VOTE:
            forest = f"fo{setting}"
            parts.append(f"{forest}j AS (SELECT target, t, v FROM ff{int(lam * 10)} JOIN fs USING (target, rn)), {latch_sql(forest + 'j', 'v', 0.5, 0.4, k, n, forest)}")
            for high in V.GRID_Z_HIGH:
                name = f"fg{setting}"
                parts.append(f"{name}j AS (SELECT target, t, v FROM fz{int(lam * 10)} JOIN fs USING (target, rn)), {latch_sql(name + 'j', 'v', high, high - 1, k, n, name)}")
                parts.append(
                    f"{name}u AS (SELECT target, t, act, lag(act) OVER (PARTITION BY target ORDER BY t) AS was FROM (SELECT z.target, z.t, z.active OR (f.active AND rv >= {k}) AS act FROM {name} z JOIN {forest} f USING (target, t)"
                    f" JOIN (SELECT target, t, sum(rel::INT) OVER (PARTITION BY target ORDER BY t ROWS {n - 1} PRECEDING) AS rv FROM fs) USING (target, t)))"
                )
                opened.append(f"SELECT target, {setting} AS setting, t FROM {name}u WHERE act AND NOT coalesce(was, FALSE)")
                setting += 1
    base = _grid_sql()
    head, tail = base[: base.index(" SELECT target, 0 AS setting")], base[base.index(" SELECT target, 0 AS setting") + 1 :]
    spans = ", ".join(f"('{name}', {a}, {b + V.GRACE_CYCLES})" for name, a, b in _FAULTS)
    delay = lambda name: f"(min(t - a) FILTER (name = '{name}')) * 15"
    missing = " + ".join(f"coalesce(nullif(d{i}, 0), {V.MISSING_DELAY})" for i in range(3))
    return f"""{head}, quiet AS ({tail}), {", ".join(parts)}, op AS ({" UNION ALL ".join(opened)}), fw(name, a, b) AS (VALUES {spans}),
  hit AS (SELECT op.*, name, a FROM op LEFT JOIN fw ON op.t BETWEEN a AND b),
  per AS (SELECT target, setting, {", ".join(f"{delay(n)} AS d{i}" for i, n in enumerate(_LIMITS))}, count(*) FILTER (name IS NULL) AS false_alarms FROM hit GROUP BY 1, 2),
  dy AS (SELECT target, greatest((max(t) - min(t)) / 86400.0, 1e-6) AS days FROM rn GROUP BY 1),
  al AS (SELECT quiet.target, quiet.setting, opens / days AS alerts_per_day, d0, d1, d2, coalesce(false_alarms, 0) AS false_alarms FROM quiet JOIN dy USING (target) LEFT JOIN per USING (target, setting)),
  fe AS (SELECT *, false_alarms = 0 AND {" AND ".join(f"coalesce(d{i} <= {limit}, FALSE)" for i, limit in enumerate(_LIMITS.values()))} AS feasible, {missing} AS total_delay FROM al)
  SELECT target, setting, round(alerts_per_day, 6) AS alerts_per_day, d0, d1, d2, false_alarms, feasible::INT AS feasible, total_delay,
    row_number() OVER (PARTITION BY target ORDER BY feasible DESC, alerts_per_day, total_delay, setting) AS place FROM fe"""


@query("E6_calibration", _calibration_sql())
def _(spark, sf):
    scores = cut(T.scored(spark, sf).select("target", "t", "z_max", "effect"))
    numbered = blocks.with_index(scores, KEY, ["t"], "rn", WIDE).withColumn("rn", F.col("rn").cast("long") + 1)
    in_fault = F.lit(False)
    for _, a, b in _FAULTS:
        in_fault = in_fault | F.col("rn").between(a, b)
    scale = F.when(in_fault, 4).otherwise(_CALM)
    stream = numbered.select(
        "target", F.col("rn").alias("t"), (F.col("z_max") * scale).alias("z_max"), (F.col("effect") * scale / 10).alias("score"), (F.col("effect") * scale >= 1).alias("relevant"),
        F.lit(0.5).alias("threshold"), F.lit(0.4).alias("low_threshold"),
    )
    faults = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for n, a, b in _FAULTS])
    events = scores.select("target").distinct().select("target", F.explode(faults).alias("e")).select("target", "e.*")
    quiet = scores.select("target", "t", (F.col("z_max") * 2).alias("z_max"))
    ranked = evaluate.calibrate(quiet, stream, events, _LIMITS, width=WIDE)
    # the settings of a target are 36 rows, whatever the length of its series
    best_first = Window.partitionBy("target").orderBy(F.col("feasible").cast("int").desc(), "alerts_per_day", "total_delay", "setting")
    return ranked.withColumn("place", F.row_number().over(best_first)).select(
        "target", "setting", F.round("alerts_per_day", 6).alias("alerts_per_day"), *[F.col("delays")[i].alias(f"d{i}") for i in range(3)], "false_alarms",
        F.col("feasible").cast("int").alias("feasible"), "total_delay", "place",
    )


@query("E7_episode_labelling", f"""WITH {_HOLES}, {_EPISODES}, w AS (SELECT target, t AS t0, t + 300 AS t1 FROM ev WHERE feature = 'view' AND value > 100),
  lb AS (SELECT eps.*, EXISTS (SELECT 1 FROM w WHERE w.target = eps.target AND eps.start BETWEEN t0 - 15 AND t1 + 600) AS tp FROM eps)
  SELECT count(*) FILTER (tp) AS tp, count(*) FILTER (NOT tp) AS fp, round(count(*) FILTER (tp) / count(*), 6) AS precision, round(count(*) FILTER (NOT tp) / 720.0, 6) AS fp_per_hour FROM lb""")
def _(spark, sf):
    eps = detect.episodes(_holed(spark, sf), KEY, F.col("v") >= 3, 7200, width=WIDE).withColumnRenamed("target", "node")
    ev = T.events(spark, sf).where("feature = 'view' and value > 100")
    windows = ev.select(F.col("target").alias("noeud"), F.col("t").alias("t0"), (F.col("t") + 300).alias("t_fin_panne"))
    out = evaluate.precision(evaluate.label_episodes(eps, windows), F.lit(720.0))
    return out.select("tp", "fp", F.round("precision", 6).alias("precision"), F.round("fp_per_hour", 6).alias("fp_per_hour"))


@query("E8_detector_table", f"""WITH {INJECTION_SQL}, d AS (SELECT unnest(['ia', 'zscore', 'iforest', 'alerte_ia', 'seuil', 'alerte']) AS detector),
  x AS (SELECT detector, CASE detector WHEN 'alerte_ia' THEN ai_s WHEN 'alerte' THEN alert_s END AS delay FROM inj, d WHERE CASE WHEN detector = 'alerte' THEN scenario = 'api' ELSE expected <> 'aucune' END)
  SELECT detector, count(*) AS total, count(delay) AS seen, quantile_cont(delay, 0.5) AS median_s, min(delay) AS min_s, max(delay) AS max_s, round(count(delay) / count(*), 6) AS recall FROM x GROUP BY 1""")
def _(spark, sf):
    rows = injections(spark, sf).withColumn("ia_attendue", F.col("action_attendue") != "aucune")
    table = evaluate.detector_table(rows, F.col("scenario") == "api")
    return table.select("detector", "total", "seen", "median_s", "min_s", "max_s", F.round("recall", 6).alias("recall"))


@query("E9_diagnosis_accuracy", """SELECT count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS "right", count(*) FILTER (o_orderpriority <> '5-LOW') AS named FROM orders WHERE o_orderstatus <> 'P'""")
def _(spark, sf):
    rows = read(spark, sf, "orders").select(
        (F.col("o_orderstatus") != "P").alias("ia_attendue"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("variable_ia"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("variables_attendues")
    )
    return evaluate.diagnosis(rows)


@query("E10_campaign_report", f"""WITH {INJECTION_SQL} SELECT l_orderkey AS numero, scenario, CASE WHEN l_linenumber < 10 THEN '0' || l_linenumber ELSE l_linenumber::VARCHAR END || ':00' AS debut_utc, ai_s AS alerte_ia_s, alert_s AS alerte_dispo_s,
  expected AS action_attendue, coalesce(action || ':' || decision, '') AS actions_agent, repaired_s AS repare_s FROM inj""")
def _(spark, sf):
    rows = injections(spark, sf).withColumns(
        {"t0": (F.col("l_linenumber") * 3600).cast("double"), "duree_panne": F.lit(0.0), "variable_ia": F.lit("").cast("string"), "retour_calme_s": F.lit(None).cast("double")}
    )
    return evaluate.report_rows(rows).select("numero", "scenario", "debut_utc", "alerte_ia_s", "alerte_dispo_s", "action_attendue", "actions_agent", "repare_s")


@query("E11_quiet_preconditions", f"""WITH {EV}, x AS (SELECT *, (t % 86400) // 60 AS mi FROM ev) SELECT event_id, concat_ws(',', CASE WHEN user_id % 9 = 0 THEN 'model_not_ready' END, CASE WHEN event_id % 10 = 0 THEN 'warming_up' END,
  CASE WHEN value > 120 THEN 'maintenance' END, CASE WHEN feature = 'error' THEN 'anomaly' END, CASE WHEN event_id % 6 = 0 THEN 'alert' END, CASE WHEN mi BETWEEN 140 AND 185 OR mi BETWEEN 260 AND 295 THEN 'backup_slot' END) AS reasons FROM x""")
def _(spark, sf):
    ev = T.events(spark, sf)
    reasons = evaluate.quiet_reasons(
        F.col("user_id") % 9 != 0, F.col("event_id") % 10 == 0, F.col("t") + F.col("value") - 120, F.col("feature") == "error", F.col("event_id") % 6 == 0, F.col("t")
    )
    return ev.select("event_id", F.array_join(reasons, ",").alias("reasons"))


