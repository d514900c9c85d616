"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. A key of at least
``least_chars`` code points that at least ``least_docs`` documents hold loses all its lines, except in the document
with the largest id that holds it.

Defined cases: a null or empty text is one empty line, which never goes. ``doc_id`` is taken as unique; rows that
repeat an id count as documents of their own and share the decisions on their id. A row with a null ``doc_id`` counts
nowhere and loses nothing. Other columns and nulls in them don't matter; an empty table gives an empty one. A key is
held as its 128-bit BLAKE2b digest. A text is handled whole, in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import SPACE, fresh, pieces, scratch, with_columns
from pulsegrid.llm.reference_index import ReferenceIndex

LEAST_CHARS = 20
LEAST_DOCS = 3


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The digest of a line's key; None for a key that is too short to count."""
    key = line.strip(SPACE).lower()  # of bytes: A-Z only
    if len(key) < least_chars or (len(key) < 4 * least_chars and len(key.decode()) < least_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_holders(docs: DataFrame, text: str, least_chars: int) -> DataFrame:
    """(key, doc_id): each key of each document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                keys, ids = [], []
                for i, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    if i is not None and body:
                        own = {k for k in (line_key(x, least_chars) for x in body.split(b"\n")) if k}
                        keys += own
                        ids += [i] * len(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "key binary, doc_id long")


class LineIndex:
    """Incremental, reversible line dedup over batches of documents."""

    def __init__(self, index: ReferenceIndex | None = None, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> None:
        self.index, self.least_chars, self.least_docs = index, least_chars, least_docs

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        spark = docs.sparkSession
        path = scratch(spark, "line-holders")
        line_holders(docs, text, self.least_chars).write.option("compression", "zstd").parquet(path)
        index = self.index or ReferenceIndex.create(spark, spark.read.parquet(path).count())
        return LineIndex(index.insert(path), self.least_chars, self.least_docs)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        return LineIndex(self.index.delete(doc_ids), self.least_chars, self.least_docs)

    def dropped_keys(self) -> DataFrame:
        """(doc_id, keys): the digests of the lines that each document loses, for documents that lose any."""
        often = self.index.entries().where(F.col("refs") >= self.least_docs)
        lost = self.index.holders().join(often, "key").where(F.col("doc_id") != F.col("top"))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with the kept lines as its text, and ``n_lines`` and ``n_dropped`` behind the own columns."""
        least, columns = self.least_chars, docs.columns
        row, keys = fresh("_row", columns), fresh("_keys", columns)
        packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row))
        lost = self.dropped_keys().withColumnRenamed("keys", keys)
        joined = packed.join(lost, "doc_id", "left").select(F.col(f"{row}.*"), F.col(keys))
        kept, n_lines, n_dropped = (fresh(x, [*columns, keys]) for x in ("_kept", "n_lines", "n_dropped"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in pieces(whole, text):
                    texts, lines, drops = [], [], []
                    for body, gone in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(keys).to_pylist()):
                        all_lines = (body or b"").split(b"\n")
                        own = set(gone or ())
                        left = [x for x in all_lines if line_key(x, least) not in own] if own else all_lines
                        texts.append(b"\n".join(left) if own else body)
                        lines.append(len(all_lines))
                        drops.append(len(all_lines) - len(left))
                    arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text else batch.column(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines, pa.int64()), pa.array(drops, pa.int64())], names=[*columns, n_lines, n_dropped])

        return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())]))


def dedup_lines(docs: DataFrame, text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``docs`` without repeated lines, see :meth:`LineIndex.apply`."""
    return LineIndex(None, least_chars, least_docs).insert(docs, text).apply(docs, text)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    slim = docs.select("doc_id", "text")
    field = T.StructField("kept_sha256", T.StringType())
    return with_columns(dedup_lines(slim), lambda: lambda texts: [[hashlib.sha256(x).hexdigest() for x in texts]], [field], keep=["doc_id", "n_lines", "n_dropped"])
