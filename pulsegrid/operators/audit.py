"""Backup and inventory audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V
from pulsegrid.operators import blocks, vector


def set_epoch(name: Column) -> Column:
    """Time in the name of a backup set (yyyymmddThhmmssZ)."""
    return F.unix_timestamp(F.to_timestamp(F.concat(name, F.lit("+0000")), "yyyyMMdd'T'HHmmss'Z'xx"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__l")).select(*keys, "__l.*")


def retention(sets: DataFrame, source: Sequence[str], epoch: str, complete: str, now: Column | int, daily: int = V.KEEP_DAILY, weekly: int = V.KEEP_WEEKLY):
    """Which sets the rotation keeps: the newest complete ones, then the newest of each older uncovered ISO week.

    Incomplete sets stay for a day; a source without any complete set loses nothing. A source has at most one set
    per backup run, so its history is bounded by its age.
    """
    at = now if isinstance(now, Column) else F.lit(now)
    day = F.timestamp_seconds(F.col(epoch).cast("long"))
    week = F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.extract(F.lit("WEEK"), day)
    rows = sets.withColumn("__week", week)
    newest = Window.partitionBy(*source, complete).orderBy(F.col(epoch).desc())
    ranked = rows.withColumn("__rank", F.row_number().over(newest))
    is_daily = F.col(complete) & (F.col("__rank") <= daily)
    # ranking is newest first, so a week is covered exactly when it is not older than the last daily week
    last_daily = F.min(F.when(is_daily, F.col("__week"))).over(Window.partitionBy(*source))
    older = F.col(complete) & ~is_daily & (F.col("__week") < last_daily)
    flagged = ranked.withColumn("__daily", is_daily).withColumn("__older", older)
    in_week = Window.partitionBy(*source, "__older", "__week").orderBy(F.col(epoch).desc())
    heads = flagged.withColumn("__head", F.col("__older") & (F.row_number().over(in_week) == 1))
    by_week = Window.partitionBy(*source).orderBy(F.col(epoch).desc()).rowsBetween(Window.unboundedPreceding, 0)
    numbered = heads.withColumn("__no", F.sum(F.col("__head").cast("int")).over(by_week))
    any_complete = F.max(F.col(complete).cast("int")).over(Window.partitionBy(*source)) == 1
    keep = (
        F.when(~any_complete, F.lit(True))
        .when(F.col("__daily"), F.lit(True))
        .when(F.col("__head") & (F.col("__no") <= weekly), F.lit(True))
        .when(~F.col(complete) & (at - F.col(epoch) < V.DAY), F.lit(True))
        .otherwise(F.lit(False))
    )
    return numbered.withColumn("keep", keep).drop("__week", "__rank", "__daily", "__older", "__head", "__no")


def keep_history(sets: DataFrame, source: Sequence[str], epoch: str, complete: str, newest: int = V.KEEP_HISTORY) -> DataFrame:
    """Heavy artefacts stay only in the newest complete sets of each source."""
    order = Window.partitionBy(*source, complete).orderBy(F.col(epoch).desc())
    return sets.withColumn("keep_history", F.when(F.col(complete), F.row_number().over(order) <= newest).otherwise(F.lit(True)))


def check_manifest(files: DataFrame, manifest: DataFrame, keys: Sequence[str] = ("set_name", "name")) -> DataFrame:
    """State of every listed file: ok, missing, or corrupted. Files: keys + content; manifest: keys + sha256."""
    actual = files.select(*keys, F.sha2("content", 256).alias("__actual"))
    joined = manifest.join(actual, list(keys), "left")
    state = F.when(F.col("__actual").isNull(), "missing").when(F.col("__actual") == F.lower("sha256"), "ok").otherwise("corrupted")
    return joined.select(*keys, state.alias("state"))


def valid_sets(checked: DataFrame, by: Sequence[str] = ("set_name",)) -> DataFrame:
    return checked.groupBy(*by).agg(F.count("*").alias("files"), F.count_if(F.col("state") != "ok").alias("bad")).withColumn("valid", F.col("bad") == 0)


def reconcile(before: DataFrame, after: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Keys whose counts differ between two snapshots (absent on one side counts as different)."""
    left, right = before.withColumnRenamed(count, "before"), after.withColumnRenamed(count, "after")
    return left.join(right, list(keys), "full").where(~F.col("before").eqNullSafe(F.col("after")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def backup_board(gauges: dict[str, DataFrame], by: Sequence[str], timestamps: Sequence[str] = ()) -> DataFrame:
    """One row per label set with the maximum of each gauge; timestamps of zero mean "never" and are dropped."""
    boards = []
    for name, df in gauges.items():
        rows = df.where(F.col("value") > 0) if name in timestamps else df
        boards.append(rows.groupBy(*by).agg(F.max("value").alias(name)))
    return vector.outer_merge(boards, by)


def free_servers(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count_if((F.col("state") == "vide") & (F.coalesce("name", F.lit("")) == "")).alias("free"))


def extend_announcement(df: DataFrame, keys: Sequence[str], until: str, ts: str = "t", width: int = blocks.DEFAULT_WIDTH) -> DataFrame:
    """End of maintenance in force at each announcement: a later one never shortens it."""
    return blocks.running(df, keys, [ts], {"until_in_force": blocks.Run("max", F.col(until))}, width)


def carry_snapshot(fresh: DataFrame, previous: DataFrame, reached: DataFrame, node: str = "noeud") -> DataFrame:
    """New service list: what was found, plus the known services of nodes that could not be reached."""
    kept = previous.join(reached.select(node).distinct(), node, "left_anti")
    return fresh.unionByName(kept)
