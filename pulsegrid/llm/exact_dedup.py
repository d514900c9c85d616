"""Exact dedup: a cuckoo-filter index of live content digests with insertion and deletion.

Texts are equal when they are the same after lower-casing A-Z; a null text counts as empty. Of equal texts the row
with the largest ``doc_id`` stays. The index (see :mod:`reference_index`) is sharded by digest; a hit of a shard's
filter is verified against the SHA-256 content digests stored in that bucket.

Defined cases: rows that repeat a ``doc_id`` are rows of their own (``group_size`` counts them, all with the id that
stays are kept); a row with a null ``doc_id`` is a member of its group, and stays only if all ids of the group are null.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import scratch, with_columns
from pulsegrid.llm.reference_index import ReferenceIndex


def content_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, doc_id): the SHA-256 of the normalised text of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = with_columns(slim, lambda: lambda texts: [pa.array([hashlib.sha256(x.lower()).digest() for x in texts], pa.binary())], [T.StructField("key", T.BinaryType())], keep=["doc_id"])
    return made.select("key", "doc_id")


class ContentIndex:
    """Live content of a growing and shrinking corpus."""

    def __init__(self, index: ReferenceIndex | None = None) -> None:
        self.index = index

    def insert(self, docs: DataFrame, text: str = "text") -> ContentIndex:
        spark = docs.sparkSession
        path = scratch(spark, "content-holders")
        content_digests(docs, text).write.option("compression", "zstd").parquet(path)
        index = self.index or ReferenceIndex.create(spark, spark.read.parquet(path).count())
        return ContentIndex(index.insert(path))

    def delete(self, doc_ids: DataFrame) -> ContentIndex:
        return ContentIndex(self.index.delete(doc_ids))

    def groups(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of every live row."""
        found = self.index.holders().join(self.index.entries(), "key")
        return found.select("doc_id", F.col("top").alias("keep_id"), F.col("refs").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top")).alias("kept"), F.lower(F.hex("key")).alias("text_sha256"))


def dedup_exact(docs: DataFrame, text: str = "text") -> DataFrame:
    return ContentIndex().insert(docs, text).groups()
