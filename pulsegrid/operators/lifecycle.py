"""Models per target: fit, score, compare, retire, forecast.

A model is one row: target, version, names, median, mad, if_median, min_effects, directions, threshold,
low_threshold, seasonal, if_suspended, trained_at, n_samples, span_hours, regime_start. Rows to score carry
(target, t, x) with ``x`` in the order of ``names``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.functions import stats as S
from pulsegrid.operators import blocks, detect, forest, slopes, summaries
from pulsegrid.session import cut

SCORING = ("names", "median", "mad", "if_median", "min_effects", "directions", "threshold", "low_threshold", "seasonal", "if_suspended", "version")


def spec_arrays(spec: Sequence[tuple]) -> dict[str, Column]:
    return {
        "names": F.array(*[F.lit(s[0]) for s in spec]),
        "min_effects": F.array(*[F.lit(float(s[3])) for s in spec]),
        "directions": F.array(*[F.lit(s[4]) for s in spec]),
    }


def fit_baseline(rows: DataFrame, spec: Sequence[tuple], z_high: float = V.Z_HIGH) -> DataFrame:
    """Median and significance-floored MAD of each feature: one row per target, arrays in feature order."""
    long = rows.select("target", "t", F.posexplode("x").alias("i", "value"))
    arrays = spec_arrays(spec)
    effects = arrays["min_effects"]
    base = summaries.robust_baseline(long, ["target", "i"])
    floored = base.withColumn("mad", S.significance_floor(F.col("mad_raw"), effects[F.col("i")], z_high))
    # at most one entry per feature of the spec
    packed = floored.groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("i", "median", "mad_raw", "mad"))).alias("__f"), F.max("n").alias("n_samples")
    )
    extent = rows.groupBy("target").agg(((F.max("t") - F.min("t")) / 3600.0).alias("span_hours"))
    get = lambda name: F.transform("__f", lambda f: f[name])
    return packed.join(extent, "target").select(
        "target",
        *[c.alias(k) for k, c in arrays.items()],
        get("median").alias("median"),
        get("mad_raw").alias("mad_raw"),
        get("mad").alias("mad"),
        get("median").alias("if_median"),
        "n_samples",
        "span_hours",
    )


def deviations(rows: DataFrame, prefix: str = "") -> DataFrame:
    """Add signed z (``z``), directional z (``zdir``), ``z_max``, ``effect``, ``top_feature`` and ``top_z``.

    Expects the model columns beside ``x``. The first feature in spec order wins a tie.
    """
    x, med, mad = F.col("x"), F.col("median"), F.col("mad")
    zdir = F.transform(x, lambda v, i: F.lit(S.MAD_CONSTANT) * S.directional(v - med[i], F.col("directions")[i]) / mad[i])
    out = rows.withColumn("z", F.transform(x, lambda v, i: S.robust_z(v, med[i], mad[i]))).withColumn("zdir", zdir)
    terms = F.transform(x, lambda v, i: S.effect_term(S.directional(v - med[i], F.col("directions")[i]), F.col("min_effects")[i]))
    sizes = F.transform("zdir", lambda v: F.abs(v))
    out = out.withColumn("z_max", F.array_max(sizes)).withColumn("effect", F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))
    at = F.array_position(sizes, F.col("z_max"))
    return out.withColumn("__top", at.cast("int")).withColumns(
        {"top_feature": F.element_at("names", F.col("__top")), "top_z": F.element_at("zdir", F.col("__top"))}
    ).drop("__top")


def attach(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with the columns of the model of their target (models are one row per target)."""
    return rows.join(models.select("target", *[c for c in SCORING if c in models.columns]), "target", "inner")


def isolation_scores(rows: DataFrame, models: DataFrame, nodes: DataFrame) -> DataFrame:
    """Forest score of each row, on the clamped (and seasonal) input of its model."""
    design = attach(rows, models).select(
        "target", "t", forest.forest_input(F.col("x"), F.col("if_median"), F.col("directions"), F.col("t"), F.col("seasonal")).alias("x")
    )
    return forest.score(design, nodes).select("target", "t", "score")


def fit(rows: DataFrame, spec: Sequence[tuple], trees: int = V.TREES, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, forest nodes, training scores) of every target from its training window."""
    base = fit_baseline(rows, spec).withColumn("seasonal", F.col("span_hours") >= V.SEASONAL_MIN_SPAN_HOURS)
    base = cut(base.withColumns({"if_suspended": F.lit(False), "version": F.lit(1), "regime_start": F.lit(0).cast("long")}))
    with_model = rows.join(base.select("target", "if_median", "directions", "min_effects", "seasonal"), "target")
    clamped = with_model.withColumn("x", F.transform("x", lambda v, i: S.benign_clamp(v, F.col("if_median")[i], F.col("directions")[i])))
    shaken = forest.augment(clamped, F.col("min_effects"), seed=seed)
    sin, cos = S.cyclic_hour(F.col("t"))
    design = cut(shaken.select("target", "t", "copy", F.when(F.col("seasonal"), F.concat("x", F.array(sin, cos))).otherwise(F.col("x")).alias("x")))
    nodes = cut(forest.fit_forest(design, trees, seed=seed))
    limits = forest.thresholds(forest.score(design, nodes))
    models = cut(base.join(limits, "target"))
    return models, nodes, isolation_scores(rows, models, nodes)


def flags(rows: DataFrame, models: DataFrame, scores: DataFrame, z_high: float = V.Z_HIGH) -> DataFrame:
    """Abnormal rows: directional z beyond the limit, or a high and relevant forest score (z only when suspended)."""
    scored = deviations(attach(rows, models)).join(scores, ["target", "t"], "left")
    by_z = F.col("z_max") > z_high
    by_forest = (F.col("score") > F.col("threshold")) & (F.col("effect") >= 1.0) & ~F.col("if_suspended")
    return scored.withColumn("flagged", by_z | F.coalesce(by_forest, F.lit(False)))


def split_holdout(rows: DataFrame, holdout: float = 0.2, keys: Sequence[str] = ("target",), width: int = blocks.DEFAULT_WIDTH) -> DataFrame:
    """Time-ordered split: ``is_train`` on the first floor(n * (1 - holdout)) rows of each key."""
    indexed = blocks.with_index(rows, keys, ["t"], "__i", width, total="__n")
    return indexed.withColumn("is_train", F.col("__i") < F.floor(F.col("__n") * F.lit(1 - holdout))).drop("__i", "__n")


def champion_challenger(
    rows: DataFrame, spec: Sequence[tuple], champion: tuple[DataFrame, DataFrame] | None = None, trees: int = V.TREES, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(challenger models, challenger nodes, decisions): fit on the older 80 %, compare false alarms on the rest.

    Rows the champion flags are left out when at least half remain. A champion suspended by a regime change is
    replaced without comparison.
    """
    kept = rows
    removed = rows.select("target").distinct().withColumn("removed", F.lit(0).cast("long"))
    if champion is not None:
        models, nodes = champion
        judged = cut(flags(rows, models, isolation_scores(rows, models, nodes)).select("target", "t", "x", "flagged"))
        tally = judged.groupBy("target").agg(F.count("*").alias("__n"), F.count_if(~F.col("flagged")).alias("__k"))
        enough = F.col("__k") >= 0.5 * F.col("__n")
        removed = tally.select("target", F.when(enough, F.col("__n") - F.col("__k")).otherwise(0).alias("removed"))
        kept = judged.join(tally, "target").where(~enough | ~F.col("flagged")).select("target", "t", "x")
    kept = cut(split_holdout(kept))
    train, test = kept.where("is_train").drop("is_train"), kept.where("not is_train").drop("is_train")
    new_models, new_nodes, _ = fit(train, spec, trees, seed)
    extent = kept.groupBy("target").agg(
        ((F.max("t") - F.min("t")) / 3600.0).alias("span_hours"), F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_holdout")
    )

    def false_positive_rate(models, nodes, name):
        flagged = flags(test, models, isolation_scores(test, models, nodes))
        return flagged.groupBy("target").agg(F.avg(F.col("flagged").cast("double")).alias(name))

    decisions = extent.join(false_positive_rate(new_models, new_nodes, "challenger_fpr"), "target", "left").join(removed, "target", "left")
    if champion is None:
        decisions = decisions.withColumns(
            {"champion_fpr": F.lit(None).cast("double"), "obsolete": F.lit(False), "accepted": F.lit(True), "version": F.lit(1)}
        )
    else:
        models, nodes = champion
        old = models.select("target", F.col("if_suspended").alias("obsolete"), F.col("version").alias("__v"))
        decisions = (
            decisions.join(false_positive_rate(models, nodes, "champion_fpr"), "target", "left")
            .join(old, "target", "left")
            .withColumn("obsolete", F.coalesce("obsolete", F.lit(False)))
            .withColumn(
                "accepted",
                F.col("__v").isNull() | F.col("obsolete") | (F.coalesce("challenger_fpr", F.lit(0.0)) <= F.coalesce("champion_fpr", F.lit(0.0)) + V.FPR_TOLERANCE),
            )
            .withColumn("version", F.coalesce(F.col("__v"), F.lit(0)) + 1)
            .drop("__v")
        )
        new_models = new_models.drop("version", "regime_start").join(decisions.select("target", "version"), "target").join(
            models.select("target", "regime_start"), "target", "left"
        )
    return new_models, new_nodes, decisions.withColumn("seasonal", F.col("span_hours") >= V.SEASONAL_MIN_SPAN_HOURS)


def detect_batch(
    rows: DataFrame, scores: DataFrame | None, models: DataFrame, suppressed: Column, warmup: int = V.WARMUP_CYCLES,
    k: int = V.VOTE_K, n: int = V.VOTE_N, lam: float = V.EWMA_LAMBDA, z_high: float = V.Z_HIGH, z_low: float = V.Z_LOW,
    width: int = blocks.DEFAULT_WIDTH,
) -> DataFrame:
    """The whole decision chain over accepted rows: detectors, relevance vote, fusion, suppressed openings.

    ``suppressed`` is evaluated on the rows (maintenance); the warm-up of the model is added. Intermediate results
    are cut so that the two readers of each ordered step do not recompute the scoring. Where the rows have a column
    ``cycle`` (0-based), it counts for the warm-up instead of their place among ``rows``.
    """
    keys, order = ["target"], ["t"]
    cycle = F.col("cycle") if "cycle" in rows.columns else F.col("idx")
    scored = deviations(attach(rows, models))
    if scores is not None:
        scored = scored.join(scores, ["target", "t"], "left")
    else:
        scored = scored.withColumn("score", F.lit(0.0))
    scored = scored.withColumn("__sup", suppressed)
    indexed = cut(blocks.with_index(scored, keys, order, "idx", width))
    zed = detect.hysteresis(indexed, keys, order, "z_max", z_high, z_low, k, n, lam, "z_", width, index="idx")
    if scores is not None:
        zed = detect.hysteresis(cut(zed), keys, order, "score", F.col("threshold"), F.col("low_threshold"), k, n, lam, "if_", width, index="idx")
    else:
        zed = zed.withColumns({"if_smoothed": F.lit(0.0), "if_active": F.lit(False), "if_opened": F.lit(False)})
    voted = detect.k_of_n(zed, keys, F.col("effect") >= 1.0, k, n, "relevant", "idx")
    fused = cut(
        voted.withColumn("if_effective", F.col("if_active") & F.col("relevant") & ~F.col("if_suspended"))
        .withColumn("wants", F.col("if_effective") | F.col("z_active"))
        .withColumn("__sup", F.col("__sup") | (cycle < warmup))
    )
    return detect.suppress_opening(fused, keys, order, F.col("wants"), F.col("__sup"), width)


def anomaly_events(detections: DataFrame, keys: Sequence[str] = ("target",), width: int = blocks.DEFAULT_WIDTH) -> DataFrame:
    """One row per closed anomaly: start, end (first inactive row), duration, variable and detectors at the start."""
    rows = detections.withColumn("__a", F.col("active").cast("int"))
    prev = blocks.running(rows, keys, ["t"], {"__p": blocks.Run("last", F.col("__a"), inclusive=False)}, width)
    opens = (F.col("__a") == 1) & (F.coalesce("__p", F.lit(0)) == 0)
    closes = (F.col("__a") == 0) & (F.col("__p") == 1)
    detectors = F.concat_ws("+", F.when(F.col("if_effective"), "iforest"), F.when(F.col("z_active"), "zscore"))
    edges = prev.where(opens | closes).select(*keys, "t", opens.alias("__o"), "top_feature", "top_z", detectors.alias("detectors"))
    numbered = blocks.running(edges, keys, ["t"], {"__no": blocks.Run("sum", F.col("__o").cast("int"))}, width)
    first = lambda c: F.max(F.when(F.col("__o"), F.col(c))).alias(c)
    closed = numbered.groupBy(*keys, "__no").agg(
        F.min("t").alias("start_epoch"), F.max(F.when(~F.col("__o"), F.col("t"))).alias("end_epoch"), first("top_feature"), first("top_z"), first("detectors")
    )
    return closed.where("end_epoch is not null").withColumn("duration_s", F.col("end_epoch") - F.col("start_epoch")).drop("__no")


def drift(recent: DataFrame, reference: DataFrame, suspended: DataFrame | None = None) -> DataFrame:
    """PSI of the last full score window of each target against its training scores, with the drift verdict."""
    value = summaries.psi(reference, recent, ["target"], "score")
    if suspended is not None:
        value = value.join(suspended.where("if_suspended").select("target"), "target", "left_anti")
    return value.withColumn("drift", F.col("psi") > V.PSI_THRESHOLD)


def forecast(samples: DataFrame, keys: Sequence[str], now: Column | int, hours: float = V.FORECAST_HOURS, t: str = "t", y: str = "value"):
    """Hours to saturation per resource from the last hours of its series (at least 30 points)."""
    base = now if isinstance(now, Column) else F.lit(now)
    recent = samples.where((F.col(t) >= base - int(hours * 3600)) & (F.col(t) <= base))
    first = recent.groupBy(*keys).agg(F.min(t).alias("__t0"))
    points = recent.join(first, list(keys)).select(*keys, ((F.col(t) - F.col("__t0")) / 3600.0).alias("t"), F.col(y).alias("y"))
    fitted = slopes.theil_sen(points, keys).where(F.col("n") >= V.FORECAST_MIN_POINTS)
    hours_left, reliable = S.hours_to_saturation(F.col("slope"), F.col("intercept") + F.col("slope") * F.col("last_t"), F.col("r2"))
    return fitted.withColumn("hours", hours_left).withColumn("reliable", reliable)


def should_train(models: DataFrame, now: Column | int) -> DataFrame:
    """Retrain predicate over targets with columns trained_at, if_suspended (null = no model), active, drift, last_attempt."""
    at = now if isinstance(now, Column) else F.lit(now)
    since = at - F.coalesce("last_attempt", F.lit(0))
    retry = since >= V.TRAIN_RETRY_SECONDS
    due = F.coalesce("drift", F.lit(False)) | (at - F.col("trained_at") >= V.RETRAIN_HOURS * 3600)
    verdict = (
        F.when(F.col("trained_at").isNull(), retry)
        .when(F.coalesce("active", F.lit(False)), F.lit(False))
        .when(F.coalesce("if_suspended", F.lit(False)), retry)
        .when(since < V.MIN_RETRAIN_GAP_MINUTES * 60, F.lit(False))
        .otherwise(due)
    )
    return models.withColumn("should_train", verdict)


def usable_models(models: DataFrame, expected: DataFrame) -> DataFrame:
    """Newest model of each target that fits the configured features (and formulas, for applications): the highest
    version and, where rows have a ``trained_at``, the latest of its rows."""
    same = models.alias("m").join(expected.alias("e"), "target")
    fits = (
        (F.col("m.schema_version") == V.MODEL_SCHEMA_VERSION)
        & (F.col("m.names") == F.col("e.names"))
        & (F.col("m.min_effects") == F.col("e.min_effects"))
        & (F.col("m.directions") == F.col("e.directions"))
        & ((F.col("e.kind") != "application") | (F.col("m.signature").eqNullSafe(F.col("e.signature"))))
    )
    rows = same.where(fits).select("target", *[F.col(f"m.{c}") for c in models.columns if c != "target"])
    rest = [c for c in models.columns if c != "target"]
    newest = F.struct("version", "trained_at") if "trained_at" in models.columns else F.col("version")
    return rows.groupBy("target").agg(F.max_by(F.struct(*rest), newest).alias("__m")).select("target", "__m.*")


def apply_tuning(targets: DataFrame, tuning: DataFrame) -> DataFrame:
    """Calibrated settings where present, defaults elsewhere; values that do not parse are ignored."""
    defaults = {"z_high": V.Z_HIGH, "z_low": V.Z_LOW, "ewma_lambda": V.EWMA_LAMBDA, "vote_k": V.VOTE_K, "vote_n": V.VOTE_N}
    joined = targets.join(tuning, "target", "left")
    cols = []
    for name, default in defaults.items():
        kind = "int" if isinstance(default, int) else "double"
        cols.append(F.coalesce(F.col(name).try_cast(kind), F.lit(default)).alias(name))
    tuned = F.coalesce(*[F.col(n).try_cast("double") for n in defaults]).isNotNull()
    return joined.select(*targets.columns, *cols, tuned.alias("tuned"))


def rebaseline(models: DataFrame, accepted: DataFrame) -> DataFrame:
    """After an accepted regime (target, plateau_median, regime_start): new median, forest suspended."""
    joined = models.join(accepted.select("target", "plateau_median", F.col("regime_start").alias("__rs")), "target", "left")
    hit = F.col("plateau_median").isNotNull()
    return (
        joined.withColumn("median", F.coalesce("plateau_median", "median"))
        .withColumn("regime_start", F.coalesce("__rs", "regime_start"))
        .withColumn("if_suspended", F.col("if_suspended") | hit)
        .drop("plateau_median", "__rs")
    )


def regime_candidates(
    detections: DataFrame, spec: Sequence[tuple], step: int = V.SCORE_STEP, minutes: int = V.REGIME_MINUTES,
    rows: int = V.REGIME_WINDOW, count_feature: str | None = None, width: int = blocks.DEFAULT_WIDTH,
) -> DataFrame:
    """First acceptable regime change of each target: durable, stable over the last rows, not critical.

    Input rows: target, t, x, active, median (of the model in force). Returns target, t (acceptance), regime_start
    and plateau_median. Applying it and scoring the later rows again gives the next one.
    """
    keys = ["target"]
    names = [s[0] for s in spec]
    wide = detections.select("target", "t", "active", "median", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    indexed = blocks.with_index(wide, keys, ["t"], "idx", width)
    flat = detect.plateau(indexed, keys, [(s[0], s[3]) for s in spec], rows, entering=["active"])
    opened = F.when(F.col("active_entered"), F.col("t"))
    began = blocks.running(flat, keys, ["t"], {"start": blocks.Run("last", opened)}, width)
    safe = F.lit(True)
    for name, critical in ((s[0], s[5]) for s in spec):
        if critical != V.INF:
            safe = safe & (F.col(name) < critical)
    if count_feature:
        safe = safe & (F.col(count_feature) >= F.col("median")[names.index(count_feature)])
    ready = F.col("active") & (F.col("t") - F.col("start") >= minutes * 60) & F.col("plateau") & safe
    first = began.where(ready).groupBy("target").agg(F.min("t").alias("t"), F.min_by("start", "t").alias("regime_start"), F.min_by("idx", "t").alias("__i"))
    # the accepted window is the last ``rows`` scored rows: a fixed number per target
    back = indexed.join(first.select("target", "__i"), "target").where((F.col("idx") <= F.col("__i")) & (F.col("idx") > F.col("__i") - rows))
    medians = back.groupBy("target").agg(F.array(*[F.percentile(n, F.lit(0.5)) for n in names]).alias("plateau_median"))
    return first.drop("__i").join(medians, "target")


def steady_rows(
    rows: DataFrame, spec: Sequence[tuple], count_feature: str | None = None, window: int = V.REGIME_WINDOW, width: int = blocks.DEFAULT_WIDTH
) -> DataFrame:
    """``rows`` (target, t, x) with ``cycle`` (place in the series), ``steady`` (the last ``window`` rows are a plateau below all critical
    levels) and ``x_count`` (the feature that must not be under its median in force). None of it depends on a model."""
    names = [s[0] for s in spec]
    wide = rows.withColumns({f"__x{i}": F.col("x")[i] for i in range(len(names))})
    indexed = blocks.with_index(wide, ["target"], ["t"], "cycle", width)
    flat = detect.plateau(indexed, ["target"], [(f"__x{i}", s[3]) for i, s in enumerate(spec)], window, "cycle")
    safe = F.lit(True)
    for i, s in enumerate(spec):
        if s[5] != V.INF:
            safe = safe & (F.col(f"__x{i}") < s[5])
    counted = F.col(f"__x{names.index(count_feature)}") if count_feature else F.lit(None).cast("double")
    return flat.withColumns({"steady": F.col("plateau") & safe, "x_count": counted}).select(*rows.columns, "cycle", "steady", "x_count")


def detect_with_regimes(
    rows: DataFrame, scores: DataFrame | None, models: DataFrame, suppressed: Column, spec: Sequence[tuple], count_feature: str | None = None,
    minutes: int = V.REGIME_MINUTES, window: int = V.REGIME_WINDOW, rounds: int = 1000, width: int = blocks.DEFAULT_WIDTH, **settings,
) -> tuple[DataFrame, DataFrame]:
    """(detections, regimes): the decision chain with every regime change applied where it is accepted.

    A fixed point over the targets that still change: decide on a target's tail, find the first row at which its open
    anomaly has lasted ``minutes`` on a steady, harmless plateau, keep the rows up to it, set the median to that of the
    last ``window`` rows, suspend the forest and decide again on what lies behind with fresh detectors. A round reads
    the tails of the targets that changed in the round before, and the loop ends when none does: as many rounds as
    the target with the most regimes has, plus one. Detections: the columns of :func:`detect_batch` and ``regime`` (the
    accepting row, inactive from there). Regimes: target, t, regime_start, plateau_median, number.
    """
    names = [s[0] for s in spec]
    tails = cut(steady_rows(rows, spec, count_feature, window, width))
    history, done, regimes = tails.select("target", "cycle", "x"), [], []
    models = cut(models)
    for number in range(1, rounds + 1):
        found = cut(detect_batch(tails, scores, models, suppressed, width=width, **settings))
        began = _with_start(found, width)
        lasting = F.col("active") & (F.col("t") > F.col("start")) & (F.col("t") - F.col("start") >= minutes * 60) & F.col("steady")
        if count_feature:
            lasting = lasting & (F.col("x_count") >= F.col("median")[names.index(count_feature)])
        first = began.where(lasting).groupBy("target").agg(F.min("t").alias("__at"), F.min_by("start", "t").alias("regime_start"), F.min_by("cycle", "t").alias("__cycle"))
        first = cut(first)
        kept = found.join(first.select("target", "__at"), "target", "left").where(F.col("__at").isNull() | (F.col("t") <= F.col("__at")))
        regime = F.coalesce(F.col("t") == F.col("__at"), F.lit(False))
        done.append(kept.withColumn("regime", regime).withColumn("active", F.col("active") & ~regime).drop("__at"))
        if first.isEmpty():
            break
        back = history.join(first.select("target", "__cycle"), "target").where((F.col("cycle") <= F.col("__cycle")) & (F.col("cycle") > F.col("__cycle") - window))
        medians = back.groupBy("target").agg(F.array(*[F.percentile(F.col("x")[i], F.lit(0.5)) for i in range(len(names))]).alias("plateau_median"))
        accepted = cut(first.join(medians, "target").select("target", F.col("__at").alias("t"), "regime_start", "plateau_median"))
        regimes.append(accepted.withColumn("number", F.lit(number)))
        models = cut(rebaseline(models.join(accepted.select("target"), "target", "left_semi"), accepted))
        tails = cut(tails.join(accepted.select("target", F.col("t").alias("__at")), "target").where(F.col("t") > F.col("__at")).drop("__at"))
    else:
        raise ValueError("regimes keep changing; raise rounds")
    union = lambda parts: functools.reduce(lambda a, b: a.unionByName(b), parts)
    none = first.select("target", F.col("__at").alias("t"), "regime_start", F.lit(None).cast("array<double>").alias("plateau_median"), F.lit(0).alias("number"))
    return union(done), union(regimes) if regimes else none


def _with_start(found: DataFrame, width: int) -> DataFrame:
    """``start``: where the anomaly that is open at a row began."""
    before = blocks.running(found.withColumn("__a", F.col("active").cast("int")), ["target"], ["t"], {"__was": blocks.Run("last", F.col("__a"), inclusive=False)}, width)
    opens = F.when(F.col("active") & (F.coalesce("__was", F.lit(0)) == 0), F.col("t"))
    return blocks.running(before, ["target"], ["t"], {"start": blocks.Run("last", opens)}, width).drop("__a", "__was")
