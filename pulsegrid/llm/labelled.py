"""Labelled rows: which are held out, the bounded sample that a classifier is fitted on, and the task that fits it."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stored


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, text in UTF-8, y) of at most ``rows`` labelled documents that pass ``learn``, picked by a hash of their
    ids. A null label is none, of several labels the largest counts."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` small rows are broadcast


def fitted(rows: DataFrame, fit: Callable[[list[tuple[int, bytes, int]]], object]) -> object:
    """``fit`` of a bounded sample, run in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "y")))}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(found)))], pa.binary())], names=["model"])

    made = stored(rows, "sample").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([])
