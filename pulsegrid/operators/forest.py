"""Isolation forests per target: bounded per-tree samples, tree building in tasks, vectorised scoring."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pulsegrid import schemas
from pulsegrid import vocabulary as V
from pulsegrid.functions import stats as S
from pulsegrid.session import ship_package

_TREES_PER_TASK = 20
_SPACE = float(2**64)
#: Types of a packed forest's arrays: roots, feature, split, below, above, ends.
_PACKED = ("<i4", "<i2", "<f8", "<i4", "<i4", "<f8")


def _tasks(df: DataFrame) -> int:
    """Partitions for Python work: an explicit number keeps small inputs from being coalesced into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*parts: Column) -> Column:
    """Uniform number in [0, 1[ fixed by its inputs, so retries and reruns draw the same."""
    return (F.xxhash64(*parts).cast("double") + F.lit(2.0**63)) / F.lit(_SPACE)


def augment(rows: DataFrame, min_effects: Column, copies: int = V.AUGMENT_COPIES, ratio: float = V.AUGMENT_RATIO, seed: int = 42):
    """Copies shaken by up to ``ratio`` of the minimum effects; they replace the originals."""
    noise = lambda x, i: x + (unit_hash(F.col("target"), F.col("t"), F.col("copy"), i, F.lit(seed)) * 2 - 1) * ratio * min_effects[i]
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("x", F.transform("x", noise))


def forest_input(x: Column, median: Column, directions: Column, t: Column, seasonal: Column) -> Column:
    """Harmless deviations snapped to the median; hour of day appended when the model is seasonal."""
    clamped = F.transform(x, lambda v, i: S.benign_clamp(v, median[i], directions[i]))
    sin, cos = S.cyclic_hour(t)
    return F.when(seasonal, F.concat(clamped, F.array(sin, cos))).otherwise(clamped)


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[tuple] = []
    stack = [(np.arange(len(points)), 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = node
        part = points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_features):
            nodes.append([node, -1, -1, 0.0, -1, -1, len(rows), depth])
            continue
        feature = int(rng.choice(open_features))
        # strictly below the maximum, so that both sides keep at least one row
        split = float(min(rng.uniform(low[feature], high[feature]), np.nextafter(high[feature], low[feature])))
        nodes.append([node, 0, feature, split, -1, -1, len(rows), depth])
        goes_left = part[:, feature] <= split
        stack.append((rows[~goes_left], depth + 1, node, 1))
        stack.append((rows[goes_left], depth + 1, node, 0))
    return nodes


def fit_forest(augmented: DataFrame, trees: int = V.TREES, sample: int = V.TREE_SAMPLE, seed: int = 42) -> DataFrame:
    """Forest nodes per target from rows (target, t, copy, x).

    Each tree takes the ``sample`` rows of its target with the smallest hash for that tree. Rows whose hash lies beyond
    the expected ``sample`` smallest by eight standard deviations are not exploded, by one formula at every size: about
    ``1.75 * sample * trees`` rows of a target pass whatever the training size, and a tree short of rows is as
    good as excluded (below 1e-12).
    """
    ship_package()
    draw = lambda tree: unit_hash(F.col("target"), F.col("t"), F.col("copy"), tree, F.lit(seed))
    sizes = augmented.groupBy("target").agg(F.count("*").alias("__n"))
    share = F.lit(float(sample)) / F.col("__n")
    # a binomial count of mean m undercuts m - 8 sqrt(m) with a chance below 1e-14
    bound = F.least(F.lit(1.0), share + F.lit(8.0) * F.sqrt(share / F.col("__n")) + F.lit(64.0) / F.col("__n"))
    sized = augmented.join(sizes.select("target", bound.alias("__bound")), "target")
    drawn = sized.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: draw(k) < F.col("__bound"))))
    drawn = drawn.withColumn("__h", draw(F.col("tree")))
    order = Window.partitionBy("target", "tree").orderBy("__h", "t", "copy")
    chosen = drawn.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= sample)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        target = group["target"].iloc[0]
        for tree, rows in group.groupby("tree", sort=True):
            points = np.vstack(rows.sort_values("__r")["x"].to_numpy())
            rng = np.random.default_rng([seed, int(tree), zlib.crc32(str(target).encode())])
            limit = int(np.ceil(np.log2(max(2, len(points)))))
            out.extend((target, int(tree), n[0], n[2], n[3], n[4], n[5], n[6], n[7]) for n in _grow(points, rng, limit))
        return pd.DataFrame(out, columns=["target", "tree", "node", "feature", "split", "left", "right", "size", "depth"])

    batch = F.floor(F.col("tree") / _TREES_PER_TASK).alias("__batch")
    spread = chosen.select("target", "tree", "__r", "x", batch).repartition(_tasks(augmented), "target", "__batch")
    return spread.groupBy("target", "__batch").applyInPandas(build, schemas.FOREST_NODES)


def _average_path(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n))
    out[n == 2] = 1.0
    big = n > 2
    m = n[big].astype(float)
    out[big] = 2.0 * (np.log(m - 1) + S.EULER_GAMMA) - 2.0 * (m - 1) / m
    return out


def _walk(points, roots, feature, split, below, above, ends) -> np.ndarray:
    """Mean path length of every point over all trees at once (points x trees, one step per level)."""
    at = np.tile(roots, (len(points), 1))
    row = np.arange(len(points))[:, None]
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return ends[at].mean(axis=1)
        goes_up = points[row, np.where(inner, f, 0)] > split[at]
        at = np.where(inner, np.where(goes_up, above[at], below[at]), at)


def packed(nodes: DataFrame) -> DataFrame:
    """One row per target from its forest nodes: flat arrays in which children are absolute places and ends path lengths."""
    ship_package()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((group["node"].to_numpy(), group["tree"].to_numpy()))
        column = {c: group[c].to_numpy()[order] for c in ("tree", "feature", "split", "left", "right", "size", "depth")}
        _, roots, sizes = np.unique(column["tree"], return_index=True, return_counts=True)
        offset = np.repeat(roots, sizes)
        arrays = [roots, column["feature"], column["split"], column["left"] + offset, column["right"] + offset, column["depth"] + _average_path(column["size"])]
        base = float(_average_path(np.array([column["size"][roots].max()]))[0])
        return pd.DataFrame([[group["target"].iloc[0], *[a.astype(kind).tobytes() for a, kind in zip(arrays, _PACKED)], base]])

    return nodes.groupBy("target").applyInPandas(pack, schemas.PACKED_FORESTS)


def score(rows: DataFrame, nodes: DataFrame, slice_seconds: int = 30 * 86400) -> DataFrame:
    """Isolation score of every row (target, t, x, ...): 2^(-mean path / c(psi)).

    Rows are grouped by (target, time slice), so a hot target is spread over its slices; a slice meets one row, the
    packed forest of its target (26 bytes a node, at most trees * 2 * sample nodes). A target has one row per instant
    (times its augmented copies), so a slice is bounded by its length and outweighs the forest sent to it.
    """
    ship_package()
    sliced = rows.withColumn("__slice", F.floor(F.col("t") / slice_seconds))
    pairs = sliced.select("target", "__slice").distinct()
    forests = packed(nodes).join(pairs, "target").withColumnsRenamed({"target": "__owner", "__slice": "__part"})
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    names = rows.columns

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left[names].assign(score=[])
        if not len(right):
            return left[names].assign(score=np.nan)
        own = right.iloc[0]
        arrays = [np.frombuffer(own[c], dtype=kind) for c, kind in zip(("roots", "feature", "split", "below", "above", "ends"), _PACKED)]
        points = np.vstack(left["x"].to_numpy())
        mean = np.concatenate([_walk(points[i : i + 4096], *arrays) for i in range(0, len(points), 4096)])
        return left[names].assign(score=np.power(2.0, -mean / own["base"]))

    n = _tasks(rows)
    left, right = sliced.repartition(n, "target", "__slice"), forests.repartition(n, "__owner", "__part")
    return left.groupBy("target", "__slice").cogroup(right.groupBy("__owner", "__part")).applyInPandas(walk, schema)


def thresholds(scored: DataFrame, percentile: float = V.IF_PERCENTILE, ratio: float = 0.5) -> DataFrame:
    """High threshold = upper percentile of the training scores; the low one lies between it and the median."""
    both = scored.groupBy("target").agg(
        F.percentile("score", F.lit(percentile)).alias("threshold"), F.percentile("score", F.lit(0.5)).alias("__c")
    )
    return both.withColumn("low_threshold", F.col("__c") + ratio * (F.col("threshold") - F.col("__c"))).drop("__c")
