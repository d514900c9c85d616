"""Evaluation: replays with injected faults, campaign statistics, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.functions import stats as S
from pulsegrid.operators import blocks, detect
from pulsegrid.session import cut


def slots(days: DataFrame, catalogue: Sequence[tuple[str, str, float]], keys: Sequence[str], rows: str = "n") -> DataFrame:
    """Fault slots of each replayed day: one every ``REPLAY_SPACING`` rows, faults in turn, intensities cycling.

    A fault on the container count is always injected at full intensity.
    """
    last = F.col(rows) - V.REPLAY_LENGTH - V.GRACE_CYCLES - 1
    starts = F.when(last >= V.REPLAY_WARM, F.sequence(F.lit(V.REPLAY_WARM), last.cast("int"), F.lit(V.REPLAY_SPACING))).otherwise(F.array().cast("array<int>"))
    positioned = days.select(*keys, F.posexplode(starts).alias("slot", "start"))
    size = len(catalogue)
    entry = F.array(*[F.struct(F.lit(n).alias("fault"), F.lit(f).alias("feature"), F.lit(float(e)).alias("fault_effect")) for n, f, e in catalogue])
    levels = F.array(*[F.lit(x) for x in V.REPLAY_INTENSITIES])
    chosen = positioned.withColumn("__c", entry[F.col("slot") % size])
    intensity = F.when(F.col("__c.feature") == "app_containers", 1.0).otherwise(levels[F.floor(F.col("slot") / size) % 3])
    return chosen.select(*keys, F.col("slot").cast("long").alias("slot"), F.col("start").cast("long").alias("start"), "__c.*", intensity.alias("intensity"))


def slot_rows(rows: DataFrame, slot_table: DataFrame, keys: Sequence[str], index: str = "i") -> DataFrame:
    """Rows of every slot window (warm-up, fault, grace) with ``offset`` in the window.

    Windows overlap by less than one spacing, so a row belongs to at most three of them; the row computes which
    slots cover it and meets them by equality, not by a range comparison.
    """
    span = V.REPLAY_WARM + V.REPLAY_LENGTH + V.GRACE_CYCLES
    last = F.floor(F.col(index) / V.REPLAY_SPACING)
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - span + 1) / V.REPLAY_SPACING))
    reach = rows.withColumn("slot", F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))))
    return reach.join(slot_table, [*keys, "slot"], "inner").withColumn("offset", F.col(index) - F.col("start") + V.REPLAY_WARM)


RAMPED = ("ram_server_mb", "cpu_host", "cpu_server")


def injected(x: Column, names: Sequence[str], bounds: Sequence[tuple[float, float]], host_ram_mb: Column | float | None = None) -> Column:
    """Feature vector with the fault of its slot added and clipped to the plausible range.

    Three features rise over eight cycles; a leak also weighs on the host memory, an application loop on its CPU.
    """
    step = F.col("offset") - V.REPLAY_WARM
    inside = (step >= 0) & (step < V.REPLAY_LENGTH)
    ramp = F.when(F.col("feature").isin(*RAMPED), F.least(F.lit(1.0), (step + 1) / V.REPLAY_RAMP)).otherwise(F.lit(1.0))
    push = F.when(inside, F.col("fault_effect") * F.col("intensity") * ramp).otherwise(0.0)
    lift = F.when(inside, F.col("intensity") * ramp).otherwise(0.0)
    out = []
    for i, name in enumerate(names):
        add = F.when(F.col("feature") == name, push).otherwise(0.0)
        if name == "ram_host" and host_ram_mb is not None and "ram_server_mb" in names:
            share = host_ram_mb if isinstance(host_ram_mb, Column) else F.lit(float(host_ram_mb))
            add = add + F.when(F.col("feature") == "ram_server_mb", push / share * 100).otherwise(0.0)
        if name == "cpu_host" and "cpu_server" in names:
            add = add + F.when(F.col("feature") == "cpu_server", lift * 25).otherwise(0.0)
        low, high = bounds[i]
        out.append(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x[i] + add)))
    return F.array(*out)


def match_faults(replayed: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, float, int]], names: Sequence[str], width: int = 4096) -> DataFrame:
    """One row per injected fault: first opening inside the fault window, diagnosis, fixed thresholds.

    Faults whose detector was already active just before the injection are left out. Input rows carry offset, x,
    active, opened, top_feature, fault, feature, intensity, fault_effect.
    """
    end = V.REPLAY_WARM + V.REPLAY_LENGTH + V.GRACE_CYCLES
    seen = F.col("opened") & (F.col("offset") >= V.REPLAY_WARM) & (F.col("offset") < end)
    wide = replayed.select("*", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    fixed = detect.first_run(wide.where(F.col("offset") >= V.REPLAY_WARM), keys, rules, "offset", width).withColumn("__fx", F.col("first_run") - V.REPLAY_WARM)
    facts = replayed.groupBy(*keys).agg(
        F.max(F.when(F.col("offset") == V.REPLAY_WARM - 1, F.col("active").cast("int"))).alias("__before"),
        F.min(F.when(seen, F.col("offset"))).alias("__hit"),
        F.min_by("top_feature", F.when(seen, F.col("offset"))).alias("__top"),
        F.first("fault").alias("fault"), F.first("feature").alias("feature"), F.first("intensity").alias("intensity"), F.first("fault_effect").alias("fault_effect"),
    )
    out = facts.where(F.coalesce("__before", F.lit(0)) == 0).join(fixed.select(*keys, "__fx"), list(keys), "left")
    hit = F.col("__hit").isNotNull()
    by_rule = F.coalesce(F.col("__fx") < V.REPLAY_LENGTH + V.GRACE_CYCLES, F.lit(False))
    return out.select(
        *keys, "fault", "feature", "intensity", F.round(F.col("fault_effect") * F.col("intensity"), 2).alias("effect"),
        hit.cast("int").alias("detected"),
        F.when(hit, (F.col("__hit") - V.REPLAY_WARM) * V.SCORE_STEP).alias("delay_s"),
        F.when(hit, F.col("__top")).alias("top_feature"),
        F.coalesce(F.col("__top") == F.col("feature"), F.lit(False)).cast("int").alias("diagnosed"),
        by_rule.cast("int").alias("threshold_detected"),
        F.when(by_rule, F.col("__fx") * V.SCORE_STEP).alias("threshold_delay_s"),
    )


def grid() -> Column:
    """The 36 calibration settings, as an array to explode."""
    return F.array(
        *[
            F.struct(
                F.lit(no).alias("setting"), F.lit(lam).alias("lam"), F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(high).alias("z_high"), F.lit(high - 1.0).alias("z_low")
            )
            for no, (lam, k, n, high) in enumerate((lam, k, n, high) for lam in V.GRID_LAMBDA for k, n in V.GRID_VOTE for high in V.GRID_Z_HIGH)
        ]
    )


def _grid_latch(indexed: DataFrame, keys: Sequence[str], value: str, high: Column, low: Column, width: int) -> DataFrame:
    """Latch signal (1 opens, 0 closes) of every calibration setting at every row, with the setting's columns.

    Smoothing depends on lambda only and is computed once per lambda; the votes of all settings share one pass.
    """
    smooth = None
    for lam in V.GRID_LAMBDA:
        one = detect.smooth_and_vote(indexed, keys, value, F.lit(float("inf")), F.lit(float("-inf")), lam, 1).drop("__above", "__below")
        one = one.withColumn("lam", F.lit(lam))
        smooth = one if smooth is None else smooth.unionByName(one)
    settings = smooth.withColumn("__g", F.explode(F.filter(grid(), lambda g: g["lam"] == F.col("lam")))).select(*indexed.columns, "smoothed", "__g.*")
    by = [*keys, "setting"]
    frames = sorted({n for _, n in V.GRID_VOTE})
    series_of = Window.partitionBy(*by, blocks.BLOCK).orderBy("idx")
    above, below = (F.col("smoothed") > high).cast("int"), (F.col("smoothed") < low).cast("int")
    counted = {}
    for n in frames:
        lastn = series_of.rowsBetween(-(n - 1), 0)
        counted[f"__a{n}"], counted[f"__b{n}"] = F.sum(above).over(lastn), F.sum(below).over(lastn)
    haloed = blocks.row_halo(settings, "idx", 4096, max(frames)).withColumns(counted)
    signal = F
    for n in frames:
        mine = F.col("n") == n
        signal = signal.when(mine & (F.col(f"__a{n}") >= F.col("k")), 1).when(mine & (F.col(f"__b{n}") == n), 0)
    return cut(blocks.own_rows(haloed.withColumn("signal", signal)).drop(*counted, "smoothed"))


_SETTING = ("lam", "k", "n", "z_high", "z_low")


def replay_grid(series: DataFrame, keys: Sequence[str], value: str = "z_max", width: int = 6 * 3600) -> DataFrame:
    """Openings of every calibration setting on a real score series: columns setting, lam, k, n, z_high, opens, days."""
    indexed = cut(blocks.with_index(series.select(*keys, "t", value), keys, ["t"], "idx", width))
    voted = _grid_latch(indexed, keys, value, F.col("z_high"), F.col("z_low"), width).drop("idx", value)
    by = [*keys, "setting"]
    was = blocks.running(voted, by, ["t"], {"__was": blocks.Run("last", F.col("signal"), inclusive=False)}, width)
    opened = (F.col("signal") == 1) & (F.coalesce("__was", F.lit(0)) == 0)
    return was.groupBy(*by, *_SETTING).agg(
        F.count_if(opened).alias("opens"), F.greatest((F.max("t") - F.min("t")) / 86400.0, F.lit(1e-6)).alias("days")
    )


def grid_faults(stream: DataFrame, events: DataFrame, limits: dict[str, int], keys: Sequence[str] = ("target",), step: int = V.SCORE_STEP, width: int = 6 * 3600):
    """Feasibility of every setting on a fault stream: no false alarm, and each fault seen within its limit.

    Stream: keys, t (row number), z_max, score, relevant, threshold, low_threshold. Events: keys, name, start, end (row
    numbers). The forest detector keeps the thresholds of its model; only its smoothing and votes vary.
    """
    keys = list(keys)
    by = [*keys, "setting"]
    indexed = blocks.with_index(stream, keys, ["t"], "idx", width)
    for k, n in V.GRID_VOTE:
        indexed = detect.k_of_n(indexed, keys, F.col("relevant"), k, n, f"__rel{n}")
    indexed = cut(indexed)
    z = _grid_latch(indexed, keys, "z_max", F.col("z_high"), F.col("z_low"), width)
    forest = _grid_latch(indexed, keys, "score", F.col("threshold"), F.col("low_threshold"), width)
    pair = z.withColumnRenamed("signal", "__z").join(forest.select(*by, "t", F.col("signal").alias("__f")), [*by, "t"])
    states = blocks.running(pair, by, ["t"], {"__zn": blocks.Run("last", F.col("__z")), "__fn": blocks.Run("last", F.col("__f"))}, width)
    voted = F
    for _, n in V.GRID_VOTE:
        voted = voted.when(F.col("n") == n, F.col(f"__rel{n}"))
    on = lambda c: F.coalesce(c, F.lit(0)) == 1
    active = on(F.col("__zn")) | (on(F.col("__fn")) & voted)
    fused = cut(states.select(*by, "t", active.cast("int").alias("__a")))
    was = blocks.running(fused, by, ["t"], {"__was": blocks.Run("last", F.col("__a"), inclusive=False)}, width)
    opens = cut(was.where((F.col("__a") == 1) & (F.coalesce("__was", F.lit(0)) == 0)).select(*by, "t"))

    spans = events.withColumn("setting", F.explode(F.transform(grid(), lambda g: g["setting"]))).withColumn("__end", F.col("end") + V.GRACE_CYCLES)
    seen = detect.first_in_window(spans, opens, by, "start", "__end", width=width).withColumn("delay", (F.col("first_hit") - F.col("start")) * step)
    per_fault = [F.max(F.when(F.col("name") == n, F.col("delay"))).alias(f"__d{i}") for i, n in enumerate(limits)]
    delays = seen.groupBy(*by).agg(*per_fault)
    lone = detect.covered_by(opens, spans, by, "start", "__end", width=width).groupBy(*by).agg(F.count_if(~F.col("covered")).alias("false_alarms"))
    in_time = F.lit(True)
    for i, limit in enumerate(limits.values()):
        in_time = in_time & F.coalesce(F.col(f"__d{i}") <= limit, F.lit(False))
    joined = delays.join(lone, by, "left").fillna(0, ["false_alarms"])
    return joined.select(*by, F.array(*[F.col(f"__d{i}").cast("int") for i in range(len(limits))]).alias("delays"), "false_alarms", ((F.col("false_alarms") == 0) & in_time).alias("feasible"))


def calibrate(real: DataFrame, stream: DataFrame, events: DataFrame, limits: dict[str, int], width: int = 6 * 3600) -> DataFrame:
    """All settings of a target with alerts per day on its real log and feasibility on the fault stream; best first."""
    quiet = replay_grid(real, ["target"], "z_max", width).withColumn("alerts_per_day", F.col("opens") / F.col("days"))
    return rank_grid(quiet.join(grid_faults(stream, events, limits, width=width), ["target", "setting"]))


def rank_grid(results: DataFrame) -> DataFrame:
    """Feasible settings first, then fewest alerts per day, then the smallest total delay (a missing one counts 9999)."""
    total = F.aggregate(F.transform("delays", lambda d: F.coalesce(F.nullif(d, F.lit(0)), F.lit(V.MISSING_DELAY))), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    return results.withColumn("total_delay", total).orderBy((~F.col("feasible")).cast("int"), "alerts_per_day", "total_delay", "setting")


def campaign_windows(injections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows, counted): interrupted injections still delimit their window but enter no statistic."""
    return injections, injections.where(~F.coalesce("interrompue", F.lit(False)))


def label_episodes(episodes: DataFrame, windows: DataFrame, margin: int = 600, step: int = V.SCORE_STEP) -> DataFrame:
    """Episode -> true positive when it starts inside a window of its node."""
    spans = windows.select(F.col("noeud").alias("node"), (F.col("t0") - step).alias("__from"), (F.col("t_fin_panne") + margin).alias("__to"))
    return detect.covered_by(episodes, spans, ["node"], "__from", "__to", "start").withColumnRenamed("covered", "true_positive")


def precision(labelled: DataFrame, hours: Column) -> DataFrame:
    tp, fp = F.count_if("true_positive"), F.count_if(~F.col("true_positive"))
    return labelled.agg(tp.alias("tp"), fp.alias("fp")).select(
        "tp", "fp", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"), (F.col("fp") / hours).alias("fp_per_hour")
    )


DETECTORS = ("ia", "zscore", "iforest", "alerte_ia", "seuil")


def detector_table(counted: DataFrame, availability: Column) -> DataFrame:
    """Recall and delays of each detector over the injections where one is expected.

    Availability alerts have their own denominator: the scenarios that raise one.
    """
    entry = lambda d, expected: F.struct(F.lit(d).alias("detector"), expected.alias("expected"), F.col("detections")[d].alias("delay"))
    rows = counted.select(F.explode(F.array(*[entry(d, F.col("ia_attendue")) for d in DETECTORS], entry("alerte", availability))).alias("d")).select("d.*").where("expected")
    # an injection contributes one delay per detector: the groups are campaign-sized
    return rows.groupBy("detector").agg(
        F.count("*").alias("total"), F.count("delay").alias("seen"), F.percentile("delay", F.lit(0.5)).alias("median_s"),
        F.min("delay").alias("min_s"), F.max("delay").alias("max_s"),
    ).withColumn("recall", F.col("seen") / F.col("total"))


def diagnosis(counted: DataFrame) -> DataFrame:
    expected = counted.where("ia_attendue")
    return expected.agg(
        F.count_if(F.coalesce(F.array_contains("variables_attendues", F.col("variable_ia")), F.lit(False))).alias("right"),
        F.count_if(F.coalesce(F.col("variable_ia"), F.lit("")) != "").alias("named"),
    )


def decisions_of(rows: Column) -> Column:
    return F.filter(F.coalesce(rows, F.array().cast("array<struct<t:double,type:string,alerte:string,action:string,decision:string,detail:string,code:string,verification:string>>")), lambda r: r["type"] == "decision")


def decision_correct(expected: Column, rows: Column) -> Column:
    """The expected action was chosen, or nothing but "aucune" when none is expected."""
    actions = F.transform(decisions_of(rows), lambda r: r["action"])
    return F.when(expected != "aucune", F.array_contains(actions, expected)).otherwise(F.forall(actions, lambda a: a == "aucune"))


def repair_facts(counted: DataFrame) -> DataFrame:
    """Per injection: correct, executed, repaired, repairable, reaction."""
    executed = F.exists(decisions_of(F.col("agent")), lambda r: r["decision"] == "executee")
    alert = F.least(F.col("detections")["alerte"], F.col("detections")["alerte_ia"], F.col("detections")["seuil"])
    repaired = F.col("repare_par_agent_s").isNotNull() & executed
    return counted.select(
        "numero",
        decision_correct(F.col("action_attendue"), F.col("agent")).alias("correct"),
        executed.alias("executed"),
        repaired.alias("repaired"),
        ((F.col("action_attendue") != "aucune") & ~F.col("scenario").isin("cpu_hote", "ram_hote")).alias("repairable"),
        F.when(repaired, F.col("repare_par_agent_s")).alias("mttr_s"),
        F.when(alert.isNotNull() & F.col("repare_par_agent_s").isNotNull(), F.greatest(F.lit(0.0), F.col("repare_par_agent_s") - alert)).alias("reaction_s"),
    )


def timeline(detections: Column) -> Column:
    """Signals of an injection in order of appearance, as text (a map holds one entry per detector)."""
    ordered = F.array_sort(F.transform(F.map_entries(detections), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["k"], F.lit(" "), F.format_string("%.0f", e["v"]), F.lit(" s"))), " / ")


def report_rows(counted: DataFrame) -> DataFrame:
    """Flat campaign report: one row per injection with its actions joined by ``;``."""
    actions = F.array_join(F.transform(decisions_of(F.col("agent")), lambda r: F.concat_ws(":", r["action"], r["decision"])), ";")
    d = F.col("detections")
    return counted.select(
        "numero", "scenario", F.date_format(F.timestamp_seconds(F.col("t0")), "HH:mm").alias("debut_utc"), F.col("duree_panne").alias("duree_panne_s"),
        d["ia"].alias("ia_s"), d["zscore"].alias("zscore_s"), d["iforest"].alias("iforest_s"), d["alerte_ia"].alias("alerte_ia_s"), d["seuil"].alias("seuil_s"),
        d["alerte"].alias("alerte_dispo_s"), "variable_ia", "action_attendue", actions.alias("actions_agent"),
        F.col("repare_par_agent_s").alias("repare_s"), F.col("retour_calme_s").alias("calme_s"),
    )


def quiet_reasons(ready: Column, warmup: Column, maintenance_until: Column, active: Column, alerting: Column, now: Column) -> Column:
    """Why an injection may not start at this instant; empty when all is quiet."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = [
        (no(ready), "model_not_ready"), (yes(warmup), "warming_up"), (yes(maintenance_until > now), "maintenance"),
        (yes(active), "anomaly"), (yes(alerting), "alert"), (S.in_backup_slot(now), "backup_slot"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))


def rolling_folds(rows: DataFrame, step: int = V.SCORE_STEP, train_days: int = V.TRAIN_HOURS // 24, min_rows: int = V.REPLAY_MIN_ROWS) -> DataFrame:
    """Rolling-origin folds of (target, t, x): columns day, role (train or test).

    Each row replays its own day and, at every other cycle, trains the next ``train_days`` days; folds with too few
    rows on either side are skipped. The rows grow by a constant factor only.
    """
    day = F.floor(F.col("t") / V.DAY)
    first = rows.groupBy("target").agg(F.floor(F.min("t") / V.DAY).alias("__first"), F.floor(F.max("t") / V.DAY).alias("__last"))
    # even cycles counted from the start of the training window; windows start on whole days
    even = F.pmod(F.floor((F.col("t") % V.DAY) / step) + (day % 2) * (V.DAY // step), F.lit(2))
    roles = [F.struct(day.alias("day"), F.lit("test").alias("role"))]
    for ahead in range(1, train_days + 1):
        start = (day + ahead - train_days) % 2 * (V.DAY // step)
        keep = F.pmod(even + start, F.lit(2)) == 0
        roles.append(F.when(keep, F.struct((day + ahead).alias("day"), F.lit("train").alias("role"))))
    spread = rows.withColumn("__f", F.explode(F.array_compact(F.array(*roles)))).select(*rows.columns, "__f.*")
    inside = spread.join(first, "target").where((F.col("day") >= F.col("__first") + train_days) & (F.col("day") <= F.col("__last"))).drop("__first", "__last")
    sizes = inside.groupBy("target", "day").agg(F.count_if(F.col("role") == "train").alias("__a"), F.count_if(F.col("role") == "test").alias("__b"))
    enough = sizes.where((F.col("__a") >= min_rows) & (F.col("__b") >= min_rows)).select("target", "day")
    return inside.join(enough, ["target", "day"], "left_semi").select(*rows.columns, "day", "role")
