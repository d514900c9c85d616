"""Logs and reports: detections, events, decisions, injections, alerts, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import schemas
from pulsegrid import vocabulary as V

MIN_LOG_ROWS = 100


def detection_rows(detections: DataFrame) -> DataFrame:
    """Detections with the fixed columns of the log, numbers cut to the logged precision."""
    return detections.select(
        "target",
        F.col("t").cast("long").alias("epoch"),
        F.round("score", 5).alias("iforest_score"),
        F.round("if_smoothed", 5).alias("iforest_smoothed"),
        F.col("if_effective").cast("int").alias("iforest_active"),
        F.round("z_max", 4).alias("zscore_max"),
        F.round("z_smoothed", 4).alias("zscore_smoothed"),
        F.col("z_active").cast("int").alias("zscore_active"),
        F.col("active").cast("int").alias("anomaly_active"),
        "top_feature",
        F.round("top_z", 3).alias("top_z"),
        "x",
    )


def write_detections(detections: DataFrame, path: str) -> None:
    """Append to the log, one directory per day and target (rows are clustered by both before writing)."""
    dated = detection_rows(detections).withColumn("date", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd"))
    dated.repartition("date", "target").write.mode("append").partitionBy("date", "target").parquet(path)


def valid_scores(raw: DataFrame, minimum: int = MIN_LOG_ROWS) -> DataFrame:
    """Log rows (text columns epoch, zscore_max) that parse; an error when fewer than ``minimum`` remain."""
    parsed = raw.select(
        *[c for c in raw.columns if c not in ("epoch", "zscore_max")],
        F.col("epoch").try_cast("double").alias("epoch"),
        F.col("zscore_max").try_cast("double").alias("zscore_max"),
    ).where("epoch is not null and zscore_max is not null")
    enough = parsed.agg(F.when(F.count("*") >= minimum, True).otherwise(F.raise_error(F.lit(f"fewer than {minimum} valid rows in the detection log")))).scalar()
    return parsed.where(enough)


def read_detection_csv(spark: SparkSession, path: str) -> DataFrame:
    names = [*V.DETECTION_FIELDS]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return valid_scores(spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path))


def event_rows(events: DataFrame) -> DataFrame:
    return events.select("target", *V.EVENT_FIELDS)


def journal_field(value: Column) -> Column:
    """One line of at most 500 characters; missing reads as empty."""
    return F.substring(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), 1, V.JOURNAL_FIELD_LENGTH)


def journal_rows(decisions: DataFrame) -> DataFrame:
    present = set(decisions.columns)
    return decisions.select(*[journal_field(F.col(c) if c in present else F.lit("")).alias(c) for c in V.JOURNAL_FIELDS])


def tail(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows, newest first (a top-n: every task keeps n rows)."""
    return df.orderBy(*order).limit(n)


def last_actions(journal: DataFrame) -> DataFrame:
    """Latest executed or simulated action per node, action and outcome, from the journal."""
    rows = journal.where((F.col("type") == "decision") & F.col("decision").isin("executee", "simulee"))
    code = F.col("code").try_cast("int")
    chain = F.when(F.col("decision") == "simulee", F.lit("simulee"))
    for value, name in V.OUTCOMES.items():
        chain = chain.when(code == value, F.lit(name))
    at = F.unix_timestamp(F.try_to_timestamp(F.col("horodatage"), F.lit("yyyy-MM-dd'T'HH:mm:ssZ")))
    return (
        rows.select(F.col("noeud").alias("node"), "action", chain.otherwise(F.lit(V.OUTCOME_FAILED)).alias("outcome"), at.alias("t"))
        .where("t is not null")
        .groupBy("node", "action", "outcome")
        .agg(F.max("t").alias("t"))
    )


def parse_injections(lines: DataFrame, column: str = "value") -> DataFrame:
    rows = lines.where(F.trim(F.col(column)) != "")
    return rows.select(F.from_json(F.col(column), schemas.INJECTION).alias("i")).select("i.*")


def read_injections(spark: SparkSession, path: str) -> DataFrame:
    return parse_injections(spark.read.text(path))


def firing_alerts(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Alerts of notification payloads that are firing, batch or stream."""
    parsed = payloads.withColumn("__p", F.from_json(F.col(column), schemas.ALERT_PAYLOAD))
    rows = parsed.select(*[c for c in payloads.columns if c != column], F.explode("__p.alerts").alias("a"))
    return rows.select(*[c for c in payloads.columns if c != column], "a.*").where("status = 'firing'")


def stream_alerts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return firing_alerts(raw)


def scrape_targets(targets: DataFrame, gateway: str) -> DataFrame:
    """Relabelled scrape targets of (job, address, labels, probed): a probed address becomes the instance label."""
    relabelled = F.map_concat(F.col("labels"), F.create_map(F.lit("instance"), F.col("address")))
    return targets.select(
        "job", F.when(F.col("probed"), F.lit(gateway)).otherwise(F.col("address")).alias("address"),
        F.when(F.col("probed"), F.col("address")).otherwise(F.lit("")).alias("param_target"), relabelled.alias("labels"),
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of backup sets (set_name, name, content) out of ``<root>/<set>/<file>``."""
    parts = F.split("path", "/")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.element_at(parts, -2).alias("set_name"), F.element_at(parts, -1).alias("name"), "content"
    )


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(set_name, name, sha256) out of checksum lines ``<sha256>  <file>`` with their ``set_name``."""
    pattern = r"^([0-9a-fA-F]{64}) [ *](.+)$"
    return lines.where(F.col("value").rlike(pattern)).select(
        "set_name", F.regexp_extract("value", pattern, 2).alias("name"), F.lower(F.regexp_extract("value", pattern, 1)).alias("sha256")
    )


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Small final report as one file (rows are already aggregated)."""
    writer = rows.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
