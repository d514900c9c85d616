"""A versioned table of models, and the training cycle that feeds it.

A put writes the models and their forests below a name of their own and then adds one row to the manifest, in one job of
its own: what no manifest row names does not exist, so a reader sees a put whole or not at all, whenever a writer or an
executor dies. Nothing is overwritten. The newest model of a target is the one of the highest version and, within it, of
the latest training time: a champion that has stood against its challenger is put again with a new time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import lifecycle
from pulsegrid.session import cut

MANIFEST = "batch string, reason string, models long"


class Registry:
    """Models below ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, models: DataFrame, nodes: DataFrame | None = None, reason: str = "") -> str:
        """Add model rows (target, version, ...) and the forest nodes (target, version, ...) that belong to them."""
        batch = uuid.uuid4().hex
        models.write.parquet(f"{self.path}/models/{batch}")
        if nodes is not None:
            nodes.write.parquet(f"{self.path}/nodes/{batch}")
        count = self.spark.read.parquet(f"{self.path}/models/{batch}").count()
        row = self.spark.createDataFrame([(batch, reason + ("+nodes" if nodes is not None else ""), count)], MANIFEST).coalesce(1)
        row.write.mode("append").parquet(f"{self.path}/manifest")
        return batch

    def entries(self) -> list[tuple[str, str, int]]:
        """The manifest: one row for each put."""
        try:
            return [tuple(r) for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _all(self, kind: str, batches: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{kind}/{b}" for b in batches]) if batches else None

    def models(self) -> DataFrame | None:
        return self._all("models", [b for b, *_ in self.entries()])

    def current(self, expected: DataFrame) -> DataFrame | None:
        """The newest model of each target that fits what is configured for it, see :func:`lifecycle.usable_models`."""
        models = self.models()
        return None if models is None else lifecycle.usable_models(models, expected)

    def nodes(self, models: DataFrame) -> DataFrame | None:
        """Forest nodes of these models."""
        all_ = self._all("nodes", [b for b, reason, _ in self.entries() if reason.endswith("+nodes")])
        return None if all_ is None else all_.join(models.select("target", "version"), ["target", "version"], "left_semi").drop("version")


def settled(decisions: DataFrame, champions: DataFrame | None, challengers: DataFrame, expected: DataFrame, now: int) -> DataFrame:
    """Model rows to put after comparisons (target, accepted, version): the challenger where it is accepted, stamped with
    schema version, signature and training time, otherwise the champion with the time alone."""
    made = challengers.join(decisions.where("accepted").select("target", F.col("version").alias("__v")), "target").drop("version").withColumnRenamed("__v", "version")
    stamped = made.join(expected.select("target", "signature"), "target").withColumns({"schema_version": F.lit(V.MODEL_SCHEMA_VERSION), "trained_at": F.lit(now).cast("long")})
    if champions is None:
        return stamped
    kept = champions.join(decisions.where("not accepted").select("target"), "target", "left_semi")
    return stamped.unionByName(kept.withColumn("trained_at", F.lit(now).cast("long")), allowMissingColumns=True)


def train_cycle(
    registry: Registry, rows: DataFrame, spec: Sequence[tuple], expected: DataFrame, now: int, hours: float = V.TRAIN_HOURS,
    least: int = V.MIN_SAMPLES, trees: int = V.TREES, seed: int = 42,
) -> DataFrame:
    """One training of every target of ``rows`` (target, t, x): target, n, outcome, version.

    The window is the last ``hours``, from the start of the regime in force at the earliest. A target with less than
    ``least`` rows in it is left as it is ("short"). Others train a challenger, which replaces the champion ("accepted")
    or leaves it, refreshed, in place ("rejected"). Everything that changes is one put.
    """
    champions = registry.current(expected)
    window = rows.where((F.col("t") >= int(now - hours * 3600)) & (F.col("t") <= now))
    if champions is not None:
        champions = cut(champions)
        window = window.join(champions.select("target", "regime_start"), "target", "left").where(F.col("t") >= F.coalesce("regime_start", F.lit(0))).drop("regime_start")
    window = cut(window)
    sizes = rows.select("target").distinct().join(window.groupBy("target").agg(F.count("*").alias("n")), "target", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ready = window.join(sizes.where(F.col("n") >= least).select("target"), "target", "left_semi")
    old = None if champions is None else champions.select("target")
    parts = []
    if champions is not None:
        nodes = registry.nodes(champions)
        if nodes is None:
            raise ValueError("the models in force have no forests")
        known = cut(ready.join(old, "target", "left_semi"))
        if not known.isEmpty():
            parts.append((known, (champions.join(known.select("target").distinct(), "target", "left_semi"), nodes)))
    fresh = cut(ready if old is None else ready.join(old, "target", "left_anti"))
    if not fresh.isEmpty():
        parts.append((fresh, None))
    verdicts = None
    for some, champion in parts:
        models, forest, decisions = lifecycle.champion_challenger(some, spec, champion, trees, seed)
        decisions = cut(decisions.select("target", "accepted", "version"))
        put = cut(settled(decisions, champion and champion[0], models, expected, now).withColumn("regime_start", F.coalesce("regime_start", F.lit(0).cast("long"))))
        won = decisions.where("accepted").select("target", "version")
        registry.put(put, forest.join(won, "target"), "train")
        verdicts = decisions if verdicts is None else verdicts.unionByName(decisions)
    if verdicts is None:
        verdicts = sizes.where("false").select("target", F.lit(False).alias("accepted"), F.lit(0).alias("version"))
    outcome = F.when(F.col("n") < least, "short").when(F.col("accepted"), "accepted").otherwise("rejected")
    return sizes.join(verdicts, "target", "left").select("target", "n", outcome.alias("outcome"), "version")


def accept_regimes(registry: Registry, regimes: DataFrame, expected: DataFrame) -> DataFrame:
    """Puts the models in force again with the level of their target's latest regime and a suspended forest."""
    latest = regimes.groupBy("target").agg(F.max_by(F.struct("regime_start", "plateau_median"), "t").alias("r")).select("target", "r.*")
    models = registry.current(expected)
    moved = cut(lifecycle.rebaseline(models.join(latest.select("target"), "target", "left_semi"), latest).withColumn("trained_at", F.col("trained_at") + 1))
    registry.put(moved, None, "regime")
    return moved
