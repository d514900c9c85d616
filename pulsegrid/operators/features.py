"""Feature specifications, quality gates and feature matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import vocabulary as V

SPEC_SCHEMA = "target string, kind string, ord int, feature string, lo double, hi double, min_effect double, direction string, critical double"


def node_spec(hosts_app: bool) -> tuple[tuple, ...]:
    return V.HOST_FEATURES + (V.HOSTED_APP_FEATURES if hosts_app else ())


def application_spec(components: Sequence[str], base: bool = False, web: bool = True) -> tuple[tuple, ...]:
    per_component = tuple((f[0].format(c=c), *f[1:]) for c in components for f in V.COMPONENT_FEATURES)
    return per_component + ((V.APP_BASE_FEATURE,) if base else ()) + (V.APP_COUNT_FEATURE,) + (V.APP_WEB_FEATURES if web else ())


def spec_table(spark: SparkSession, specs: dict[str, tuple[str, Sequence[tuple]]]) -> DataFrame:
    """Dimension of all features of all targets, in order: {target: (kind, spec)}."""
    rows = [(target, kind, i, *f) for target, (kind, spec) in specs.items() for i, f in enumerate(spec)]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def project(long: DataFrame, spec: DataFrame, zero_filled: Sequence[str] = V.ZERO_FILLED) -> DataFrame:
    """Samples of the configured features only, with their order and bounds; a zero-filled feature is 0 when absent.

    The spec is a small dimension the planner broadcasts when its size allows.
    """
    ticks = long.select("target", "t").distinct().join(spec, "target")
    joined = ticks.join(long, ["target", "t", "feature"], "left")
    return joined.withColumn("value", F.when(F.col("value").isNull() & F.col("feature").isin(*zero_filled), 0.0).otherwise(F.col("value")))


def plausible(values: Sequence[tuple[Column, float, float]], count: Column | None = None) -> Column:
    """Every feature present, finite and within its bounds, and at least one container where there is a count."""
    ok = F.lit(True)
    for value, low, high in values:
        ok = ok & F.coalesce(value.between(low, high) & ~F.isnan(value), F.lit(False))
    return ok if count is None else ok & (count > 0)


def quality(values: Sequence[tuple[str, float, float]], ages: Sequence[tuple[str, Column]], limit: float = V.MAX_STALENESS_SECONDS) -> Column:
    """First problem of a row, or null: missing or implausible in feature order, then a stale source."""
    chain = F
    for name, low, high in values:
        v = F.col(name)
        chain = chain.when(v.isNull() | F.isnan(v), F.lit(f"missing:{name}"))
        chain = chain.when(~v.between(low, high), F.lit(f"implausible:{name}"))
    for source, age in ages:
        chain = chain.when(age.isNull() | F.isnan(age.cast("double")) | (age > limit), F.lit(f"stale:{source}"))
    return chain.otherwise(F.lit(None).cast("string"))


def matrix(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows (target, t, x) with the features as one array in spec order."""
    return wide.select("target", "t", F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
