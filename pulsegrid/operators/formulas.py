"""From metric series to features: every formula of every target in one pass over the samples.

Samples are (name, labels MAP, t, value), at most one per series and second (``series.dedupe_last``). The target of a
sample, and the component its feature is named after, are read from its labels, so the work doesn't grow with the number of targets or features.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.functions import labels as L
from pulsegrid.operators import blocks

COUNTERS = ("node_cpu_seconds_total", "node_network_receive_bytes_total", "container_cpu_usage_seconds_total")
GAUGES = (
    "node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes", "node_filesystem_avail_bytes", "node_filesystem_size_bytes",
    "container_memory_working_set_bytes", "probe_success", "probe_duration_seconds",
)
#: Features that stay missing without a series; all others are 0 then.
MEASURED = tuple(f[0] for f in V.HOST_FEATURES + V.APP_WEB_FEATURES)
MIB = 1024.0 * 1024.0


class Hosted(NamedTuple):
    """The application that a node may host: its namespace and the containers of its API and its database."""

    namespace: str = "default"
    api: str = "server"
    database: str = "postgres"


def on_ticks(samples: DataFrame, step: int, reach: int = 120, lookback: int = 300, width: int = blocks.DEFAULT_WIDTH) -> DataFrame:
    """Every series at the ticks it is fresh at: (name, labels, t, at, value, rate).

    ``value`` is its latest sample (taken ``at``) if that is under ``lookback`` seconds old. ``rate`` is a counter's growth per
    second over the trailing ``reach`` seconds, between the first and the last sample inside; a drop is a restart from
    zero; null with fewer than two samples. One shuffle, by series and time block; a block keeps the ticks inside it and
    gets the samples that reach into it.
    """
    if reach > lookback:
        raise ValueError("the lookback covers the window of the rates")
    width = max(width, lookback)
    named = samples.where(F.col("name").isin(*COUNTERS, *GAUGES)).withColumn("__s", L.render_labels(F.col("labels")))
    line = Window.partitionBy("name", "__s", blocks.BLOCK).orderBy("t")
    before = F.lag("value").over(line)
    growth = F.when(before.isNull(), F.lit(0.0)).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    counter = F.col("name").isin(*COUNTERS)
    rows = blocks.time_halo(named, "t", lookback, width).withColumns({"__d": growth, "__next": F.lead("t").over(line)})
    rows = rows.withColumn("__p", F.sum("__d").over(line))
    # the few samples of the window, with the growth up to each; a tick picks the first one inside its own window
    rows = rows.withColumn("__w", F.collect_list(F.when(counter, F.struct("t", F.col("__p").alias("p")))).over(line.rangeBetween(-(reach - 1), 0)))
    last = F.least(F.col("__next") - 1, F.col("t") + (lookback - 1))
    first, last = (F.ceil(F.col("t") / step) * step).cast("long"), (F.floor(last / step) * step).cast("long")
    ticks = F.when(last >= first, F.sequence(first, last, F.lit(step).cast("long")))
    ticked = rows.withColumn("at", F.col("t")).withColumn("t", F.explode(ticks)).where(blocks.time_block("t", width) == F.col(blocks.BLOCK))
    start = F.element_at(F.filter("__w", lambda w: w["t"] > F.col("t") - reach), 1)
    start = F.when(counter & (F.col("at") > F.col("t") - reach), start)
    rate = F.when(F.col("at") > start["t"], (F.col("__p") - start["p"]) / (F.col("at") - start["t"]))
    return ticked.select("name", "labels", "t", "at", "value", rate.alias("rate"))


def _parts(hosted: Hosted) -> Column:
    """What a series contributes to: (target, feature, how, part, v, item), none where it matters to no formula."""
    name, value, rate = F.col("name"), F.col("value"), F.col("rate")
    at = lambda key: L.label(F.col("labels"), key)
    is_ = lambda *matchers: L.select_labels(F.col("labels"), *matchers)
    node, space, box = at("node"), at("container_label_io_kubernetes_pod_namespace"), at("container_label_io_kubernetes_container_name")
    pods = is_(("job", "=", "cadvisor-k3s"))
    here = pods & (space == hosted.namespace) & (node != "")
    app = F.concat(F.lit(V.APP_PREFIX), space)
    root = is_(("mountpoint", "=", "/"), ("fstype", "=", "ext4"))
    probed = is_(("job", "=", "applications"))
    site = F.concat(F.lit(V.APP_PREFIX), at("application"))
    named_box = (box != "") & (box != "POD")
    cpu, memory = name == "container_cpu_usage_seconds_total", name == "container_memory_working_set_bytes"

    def part(when: Column, target: Column, feature: str | Column, how: str, v: Column, part: int = 0, item: Column | None = None) -> Column:
        made = F.struct(
            target.alias("target"), (F.lit(feature) if isinstance(feature, str) else feature).alias("feature"), F.lit(how).alias("how"), F.lit(part).alias("part"),
            v.cast("double").alias("v"), (F.lit(None) if item is None else item).cast("string").alias("item"),
        )
        return F.when(when & v.isNotNull() & (target != ""), made)

    return F.array_compact(F.array(
        part((name == "node_cpu_seconds_total") & is_(("mode", "=", "idle")), node, "cpu_host", "free", rate),
        part(name == "node_memory_MemAvailable_bytes", node, "ram_host", "used", value),
        part(name == "node_memory_MemTotal_bytes", node, "ram_host", "used", value, 1),
        part((name == "node_filesystem_avail_bytes") & root, node, "disk_host", "used", value),
        part((name == "node_filesystem_size_bytes") & root, node, "disk_host", "used", value, 1),
        part((name == "node_network_receive_bytes_total") & is_(("device", "!~", V.VIRTUAL_DEVICES)), node, "net_rx_kb", "sum", rate / 1024),
        part(cpu & here & (box == hosted.api), node, "cpu_server", "sum", rate * 100),
        part(memory & here & (box == hosted.api), node, "ram_server_mb", "sum", value / MIB),
        part(memory & here & (box == hosted.database), node, "ram_postgres_mb", "sum", value / MIB),
        part(memory & here & named_box, node, "app_containers", "count", value, item=box),
        part(cpu & pods & named_box, app, F.concat(F.lit("cpu_"), box), "sum", rate * 100),
        part(memory & pods & named_box, app, F.concat(F.lit("ram_"), box, F.lit("_mb")), "sum", value / MIB),
        part(memory & pods & (box == "postgres"), app, "ram_base_mb", "sum", value / MIB),
        part(memory & pods & named_box, app, "app_containers", "count", value, item=box),
        part((name == "probe_success") & probed, site, "web_ok", "min", value),
        part((name == "probe_duration_seconds") & probed, site, "web_ms", "max", value * 1000),
    ))


def measure(ticked: DataFrame, hosted: Hosted = Hosted()) -> DataFrame:
    """Values of all formulas that have a series: (target, t, feature, value).

    Averages, sums and extremes are combined on the map side; of a target's containers only the names are gathered.
    """
    parts = ticked.select("t", F.explode(_parts(hosted)).alias("p")).select("t", "p.*")
    v, first, how = F.col("v"), F.col("part") == 0, F.col("how")
    sums = parts.groupBy("target", "t", "feature", "how").agg(
        F.avg(F.when(first, v)).alias("a"), F.avg(F.when(~first, v)).alias("b"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.collect_set("item").alias("items")
    )
    value = (
        F.when(how == "free", 100 - F.col("a") * 100)
        .when(how == "used", F.try_divide(F.col("b") - F.col("a"), F.col("b")) * 100)
        .when(how == "sum", F.col("s")).when(how == "count", F.size("items").cast("double")).when(how == "min", F.col("lo")).otherwise(F.col("hi"))
    )
    return sums.select("target", "t", "feature", value.alias("value"))


def features_of(samples: DataFrame, spec: DataFrame, step: int, reach: int = 120, lookback: int = 300, hosted: Hosted = Hosted(), width: int = blocks.DEFAULT_WIDTH) -> DataFrame:
    """Features of the configured targets (``features.spec_table``) at every tick at which a target has any series.

    Returns the columns of the spec, ``t`` and ``value``: 0 where a feature that counts as 0 has no series, null where a
    measured one has none. Series of targets or features outside the spec are left out.
    """
    found = measure(on_ticks(samples, step, reach, lookback, width), hosted)
    # a target's values at a tick are one small map; the spec, also small, meets it as one array a target
    values = found.groupBy("target", "t").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("__v"))
    wanted = spec.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("ord", *[c for c in spec.columns if c not in ("target", "ord")]))).alias("__f"))
    rows = values.join(wanted, "target").select("target", "t", "__v", F.explode("__f").alias("f"))
    value = F.coalesce(F.col("__v")[F.col("f.feature")], F.when(~F.col("f.feature").isin(*MEASURED), 0.0))
    return rows.select("target", "t", "f.*", value.alias("value"))


def source_ages(ticked: DataFrame, targets: DataFrame) -> DataFrame:
    """Age in seconds of the latest sample of every source of a target: (target, t, source, age).

    ``targets`` is (target, kind). A node has its exporter and its container collector; an application has its probe
    and, as its pods run anywhere, the freshest container collector of the fleet.
    """
    name, node = F.col("name"), L.label(F.col("labels"), "node")
    pods = (name == "container_memory_working_set_bytes") & L.select_labels(F.col("labels"), ("job", "=", "cadvisor-k3s"))
    probe = (name == "probe_success") & L.select_labels(F.col("labels"), ("job", "=", "applications"))
    entry = lambda when, owner, source: F.when(when, F.struct(owner.alias("owner"), F.lit(source).alias("source")))
    sources = F.array_compact(F.array(
        entry(name == "node_memory_MemAvailable_bytes", node, "node-exporter"), entry(pods & (node != ""), node, "cadvisor-k3s"), entry(pods, F.lit("*"), "cadvisor-k3s"),
        entry(probe, F.concat(F.lit(V.APP_PREFIX), L.label(F.col("labels"), "application")), "sonde-web"),
    ))
    aged = ticked.select("t", (F.col("t") - F.col("at")).alias("age"), F.explode(sources).alias("s")).groupBy("s.owner", "t", "s.source").agg(F.min("age").alias("age"))
    reads = F.array_compact(F.array(F.col("target"), F.when(F.col("kind") == "application", F.lit("*"))))
    return targets.select("target", F.explode(reads).alias("owner")).join(aged, "owner").select("target", "t", "source", "age")
