"""Servers, services, deployments and catalogues: classification and validation rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.functions import labels as L


def listening_ports(text: Column) -> Column:
    digits = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda p: p.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.transform(digits, lambda p: p.cast("int"))))


def other_ports(text: Column) -> Column:
    """Listening ports beyond those of an empty server."""
    return F.array_except(listening_ports(text), F.array(*[F.lit(p) for p in V.EMPTY_SERVER_PORTS]))


def classify(probe: Column, systems: list[str], min_ram: int, min_disk: int) -> tuple[Column, Column]:
    """(state, reason) of a probed server; the first rule that applies wins."""
    listed = F.coalesce(probe["conteneurs"], F.lit(""))
    containers = F.array_sort(F.array_distinct(F.filter(F.split(listed, " "), lambda c: c != "")))
    expected = "|".join(str(p) for p in V.EMPTY_SERVER_PORTS)
    busy_port = F.coalesce(probe["services_ecoute"], F.lit("")).rlike(rf"(?:^| )(?!0*(?:{expected})(?: |$))[0-9]+(?: |$)")
    system = F.lower(F.coalesce(probe["systeme"], F.lit("")))
    ports = F.array_join(other_ports(probe["services_ecoute"]).cast("array<string>"), ", ")
    ram = F.coalesce(probe["ram_mo"], F.lit(0))
    disk = F.coalesce(probe["disque_libre_go"], F.lit(0))
    version = F.trim(F.coalesce(probe["k3s_version"], F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    rules = [
        (listed.rlike("(?:^| )mon-prometheus(?: |$)"), "supervision", text("runs the monitoring stack")),
        (yes(probe["k3s_serveur"]), "controle", F.trim(text("k3s control node ", version))),
        (yes(probe["k3s_agent"]), "applicatif", F.trim(text("k3s agent ", version))),
        (~system.isin([s.lower() for s in systems]), "incompatible", text("system ", F.coalesce(F.nullif(system, F.lit("")), F.lit("unknown")))),
        (ram < min_ram, "incompatible", text(ram.cast("string"), f" MB of memory (minimum {min_ram})")),
        (disk < min_disk, "incompatible", text(disk.cast("string"), f" GB free (minimum {min_disk})")),
        (~yes(probe["sudo"]), "incompatible", text("no passwordless sudo")),
        (F.trim(listed) != "", "occupe", text("running containers: ", F.array_join(containers, ", "))),
        (yes(probe["pfe_runbook"]), "occupe", text("already equipped, without k3s")),
        (busy_port, "occupe", text("listening ports: ", ports)),
    ]
    state, reason = F, F
    for condition, name, why in rules:
        state, reason = state.when(condition, F.lit(name)), reason.when(condition, why)
    return state.otherwise(F.lit("vide")), reason.otherwise(text("empty"))


def docker_ports(ports: Column, excluded: list[int]) -> Column:
    """Published TCP ports (all interfaces) of a container listing, without the excluded ones."""
    items = F.transform(F.split(F.coalesce(ports, F.lit("")), ", "), lambda p: F.regexp_extract(F.trim(p), r"^0\.0\.0\.0:(\d+)->\d+/tcp$", 1))
    found = F.transform(F.filter(items, lambda p: p != ""), lambda p: p.cast("int"))
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*[F.lit(p) for p in excluded]).cast("array<int>"))))


def web_link(host: Column, port: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in V.WEB_PORTS.items() for x in item])
    scheme = table[port]
    return F.when(scheme.isNotNull(), F.concat(scheme, F.lit("://"), host, F.lit(":"), port.cast("string"), F.lit("/"))).otherwise(F.lit(""))


def docker_services(containers: DataFrame, excluded: list[int]) -> DataFrame:
    """One row per published port of (name, ports, host, node)."""
    ports = containers.withColumn("__p", docker_ports(F.col("ports"), excluded))
    single = F.size("__p") == 1
    rows = ports.select("name", "host", "node", single.alias("__one"), F.explode("__p").alias("port"))
    return rows.select(
        F.when(F.col("__one"), F.col("name")).otherwise(F.concat_ws(":", "name", F.col("port").cast("string"))).alias("nom"),
        F.lit("tcp").alias("type"),
        F.concat_ws(":", "host", F.col("port").cast("string")).alias("cible"),
        F.lit("docker").alias("source"),
        F.col("node").alias("noeud"),
        web_link(F.col("host"), F.col("port")).alias("lien"),
    )


K8S_SERVICES = "items array<struct<metadata:struct<namespace:string,name:string>,spec:struct<type:string,ports:array<struct<name:string,port:int,nodePort:int>>>>>"
K8S_INGRESSES = (
    "items array<struct<metadata:struct<namespace:string,name:string>,"
    "spec:struct<rules:array<struct<host:string,http:struct<paths:array<struct<path:string>>>>>>>>"
)


def cluster_services(listing: DataFrame) -> DataFrame:
    """Node-port services out of JSON listings (json, host, node)."""
    parsed = listing.select("host", "node", F.explode(F.from_json("json", K8S_SERVICES)["items"]).alias("s"))
    exposed = parsed.where((F.col("s.metadata.namespace") != "kube-system") & F.col("s.spec.type").isin("NodePort", "LoadBalancer"))
    ports = exposed.select("host", "node", "s.metadata.*", F.explode("s.spec.ports").alias("p")).where(F.coalesce("p.nodePort", F.lit(0)) != 0)
    shown = F.coalesce(F.nullif(F.col("p.name"), F.lit("")), F.col("p.port").cast("string"))
    secure = (F.col("p.port") == 443) | (shown == "https")
    plain = (F.col("p.port") == 80) | (shown == "http")
    target = F.concat_ws(":", "host", F.col("p.nodePort").cast("string"))
    link = F.when(secure, F.concat(F.lit("https://"), target, F.lit("/"))).when(plain, F.concat(F.lit("http://"), target, F.lit("/"))).otherwise("")
    return ports.select(
        F.concat(F.col("namespace"), F.lit("/"), F.col("name"), F.lit(":"), shown).alias("nom"),
        F.lit("tcp").alias("type"), target.alias("cible"), F.lit("kubernetes").alias("source"), F.col("node").alias("noeud"), link.alias("lien"),
    )


def ingress_services(listing: DataFrame) -> DataFrame:
    parsed = listing.select("host", "node", F.explode(F.from_json("json", K8S_INGRESSES)["items"]).alias("i"))
    rules = parsed.select(F.col("host").alias("__ip"), "node", "i.metadata.*", F.explode("i.spec.rules").alias("r"))
    paths = rules.select("__ip", "node", "namespace", "name", F.coalesce("r.host", "__ip").alias("h"), F.explode("r.http.paths").alias("p"))
    path = F.coalesce(F.nullif(F.col("p.path"), F.lit("")), F.lit("/"))
    url = F.concat(F.lit("http://"), F.col("h"), path)
    return paths.select(
        F.concat(F.lit("ingress "), F.col("namespace"), F.lit("/"), F.col("name"), path).alias("nom"),
        F.lit("http").alias("type"), url.alias("cible"), F.lit("kubernetes").alias("source"), F.col("node").alias("noeud"), url.alias("lien"),
    )


def sync_state(sync: Column, health: Column) -> Column:
    return F.when((sync == "Synced") & (health == "Healthy"), 1.0).when((health == "Progressing") | (sync == "Unknown"), 0.5).otherwise(0.0)


def build_state(result: Column) -> Column:
    return F.when(result == "SUCCESS", 1.0).when(result == "UNSTABLE", 0.5).otherwise(0.0)


def ready_share(ready: Column, desired: Column) -> Column:
    return F.when(desired > 0, F.round(F.coalesce(ready, F.lit(0)) / F.when(desired > 0, desired), 3)).otherwise(F.lit(0.0))


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for bad, code in checks]))


def target_errors(name: Column, application: Column, components: Column, copies: Column) -> Column:
    """Broken rules of an application target (empty array when valid); ``copies`` counts targets of the same name."""
    return _errors(
        (~name.rlike(V.NODE_NAME), "name"),
        (~application.rlike(V.K8S_NAME), "application"),
        (F.size(components) == 0, "no_component"),
        (F.exists(components, lambda c: ~c.rlike(V.K8S_NAME) | (c == "base")), "component"),
        (F.size(F.array_distinct(components)) < F.size(components), "duplicate_component"),
        (copies > 1, "duplicate_target"),
    )


def catalogue_errors(name: Column, components: Column, base_name: Column, url: Column) -> Column:
    """Broken rules of a catalogue entry."""
    return _errors(
        (~name.rlike(V.CATALOGUE_NAME), "name"),
        (name.isin(*V.RESERVED_NAMES), "reserved"),
        (F.size(components) == 0, "no_component"),
        (F.exists(components, lambda c: ~c.rlike(V.CATALOGUE_COMPONENT)), "component"),
        (F.array_contains(components, "base"), "base_component"),
        (F.size(F.array_distinct(components)) < F.size(components), "duplicate_component"),
        (~base_name.rlike(V.CATALOGUE_BASE), "base_name"),
        ((url != "") & ~url.rlike(V.CATALOGUE_URL), "url"),
    )


def deployment_version(image: Column) -> Column:
    return L.sanitize(L.image_tag(image))
