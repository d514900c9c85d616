"""Label-set algebra on instant vectors.

A vector is a DataFrame with key columns (labels, and the tick when evaluated over a range) and ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {
    ">": lambda v, x: v > x,
    "<": lambda v, x: v < x,
    ">=": lambda v, x: v >= x,
    "<=": lambda v, x: v <= x,
    "==": lambda v, x: v == x,
    "!=": lambda v, x: v != x,
}


def compare(vector: DataFrame, op: str, scalar) -> DataFrame:
    """Keep the rows whose value satisfies the comparison; the value itself is unchanged."""
    return vector.where(_COMPARE[op](F.col("value"), scalar))


def aggregate_by(vector: DataFrame, kind: str, by: Sequence[str]) -> DataFrame:
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[kind]
    return vector.groupBy(*by).agg(agg("value").alias("value"))


def many_to_one(vector: DataFrame, info: DataFrame, on: Sequence[str], copy: Sequence[str]) -> DataFrame:
    """Multiply by the matching row of ``info`` and copy some of its labels (no hint: the planner sizes the sides)."""
    right = info.select(*on, *copy, F.col("value").alias("__factor"))
    return (
        vector.drop(*copy).join(right, list(on), "inner").withColumn("value", F.col("value") * F.col("__factor")).drop("__factor")
    )


def unless(vector: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return vector.join(other.select(*on).distinct(), list(on), "left_anti")


def and_on(vector: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return vector.join(other.select(*on), list(on), "left_semi")


def or_on(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows, then right rows whose key is absent on the left."""
    extra = right.join(left.select(*on).distinct(), list(on), "left_anti")
    return left.unionByName(extra, allowMissingColumns=True)


def absent(ticks: DataFrame, vector: DataFrame, on: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """One row of value 1, labelled by the equality matchers, at every tick where the vector is empty."""
    missing = ticks.join(vector.select(*on).distinct(), list(on), "left_anti")
    return missing.select("*", *[F.lit(v).alias(k) for k, v in labels.items()], F.lit(1.0).alias("value"))


def zero_default(spine: DataFrame, vector: DataFrame, on: Sequence[str], default: float = 0.0) -> DataFrame:
    """One row per spine row even where the vector is empty."""
    return spine.join(vector, list(on), "left").withColumn("value", F.coalesce("value", F.lit(default)))


def outer_merge(boards: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of rollups on one label set (each already has one row per key)."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), boards)


def drop_zero(value: Column) -> Column:
    """Timestamps of 0 mean "never" and read as missing."""
    return F.when(value > 0, value)
