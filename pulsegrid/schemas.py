"""Explicit schemas of the inputs; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("t", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)
ALERT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("startsAt", T.StringType()),
    ]
)
ALERT_PAYLOAD = T.StructType([T.StructField("alerts", T.ArrayType(ALERT))])
AGENT_ROW = T.StructType(
    [T.StructField("t", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("type", "alerte", "action", "decision", "detail", "code", "verification")]
)
INJECTION = T.StructType(
    [
        T.StructField("numero", T.IntegerType()),
        T.StructField("scenario", T.StringType()),
        T.StructField("nom", T.StringType()),
        T.StructField("noeud", T.StringType()),
        T.StructField("t0", T.DoubleType()),
        T.StructField("t_fin_panne", T.DoubleType()),
        T.StructField("duree_panne", T.DoubleType()),
        T.StructField("detections", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("variable_ia", T.StringType()),
        T.StructField("variables_attendues", T.ArrayType(T.StringType())),
        T.StructField("ia_attendue", T.BooleanType()),
        T.StructField("action_attendue", T.StringType()),
        T.StructField("repare_par_agent_s", T.DoubleType()),
        T.StructField("retour_calme_s", T.DoubleType()),
        T.StructField("interrompue", T.BooleanType()),
        T.StructField("reconstruit", T.BooleanType()),
        T.StructField("agent", T.ArrayType(AGENT_ROW)),
    ]
)
PROBE = T.StructType(
    [
        T.StructField("nom_hote", T.StringType()),
        T.StructField("systeme", T.StringType()),
        T.StructField("cpu", T.IntegerType()),
        T.StructField("ram_mo", T.IntegerType()),
        T.StructField("disque_libre_go", T.IntegerType()),
        T.StructField("sudo", T.BooleanType()),
        T.StructField("docker", T.BooleanType()),
        T.StructField("conteneurs", T.StringType()),
        T.StructField("k3s_version", T.StringType()),
        T.StructField("k3s_serveur", T.BooleanType()),
        T.StructField("k3s_agent", T.BooleanType()),
        T.StructField("pfe_runbook", T.BooleanType()),
        T.StructField("services_ecoute", T.StringType()),
    ]
)
PACKED_FORESTS = "target string, roots binary, feature binary, split binary, below binary, above binary, ends binary, base double"
FOREST_NODES = "target string, tree int, node int, feature int, split double, left int, right int, size long, depth int"
