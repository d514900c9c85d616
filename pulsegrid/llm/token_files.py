"""Token ids in bit-packed files: fixed width, block offsets, random access.

A file set is a Parquet table of blocks in ascending ``doc_id`` order. A block holds whole documents: their ids, where
each one ends inside the block, and the packed ids. Every id takes ``bits`` bits, the least that hold the vocabulary:
eight ids fill ``bits`` bytes, least significant bit first, so id ``i`` starts at bit ``i * bits`` and any range of
a block can be unpacked alone. ``first`` counts the ids before the block in its part, and the parts' totals give the
global place.

Texts are encoded as the library does by default: strings of the file's added tokens become those tokens.

Defined cases: a null or empty text is a document with the end id alone; rows that repeat a ``doc_id`` stay next to
each other, each with a place of its own; a null ``doc_id`` sorts first. A block closes at ``block_ids`` ids; a longer
document is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.byte_bpe import codec
from pulsegrid.llm.common import pieces, scratch

SCHEMA = "part int, first long, bits int, n_ids long, doc_ids array<long>, ends array<long>, payload binary"
BLOCK_IDS = 1 << 18
END_ID = 2
#: Widths whose packed ids are plain little-endian integers.
WORDS = {8: "u1", 16: "<u2", 32: "<u4"}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` (at most 32) bits each, padded to whole groups of eight."""
    if bits in WORDS:
        return np.pad(ids.astype(WORDS[bits]), (0, -len(ids) % 8)).tobytes()
    lanes = np.zeros((-(-len(ids) // 8), 8), dtype=np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), dtype=np.uint8)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        moved = lanes[:, j] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, at + k] |= (moved >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a packed block, reading only the groups that hold them."""
    if bits in WORDS:
        return np.frombuffer(payload, dtype=WORDS[bits], count=stop - start, offset=start * bits // 8).astype(np.uint32)
    group, end = start // 8, -(-stop // 8)
    data = np.frombuffer(payload, dtype=np.uint8, count=(end - group) * bits, offset=group * bits).reshape(-1, bits)
    out = np.zeros((len(data), 8), dtype=np.uint32)
    for j in range(8):
        at, shift = divmod(j * bits, 8)
        value = np.zeros(len(data), dtype=np.uint64)
        for k in range(-(-(bits + shift) // 8)):
            value |= data[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[start - 8 * group : stop - 8 * group]


def write_token_files(docs: DataFrame, path: str, source: str, pattern: str, vocabulary: int, text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every text, adds ``end_id`` and writes the blocks below ``path``."""
    bits = bits_for(max(vocabulary, end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source, pattern, added=True)
        part, first = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        ends: list[int] = []
        end = np.array([end_id], dtype=c.ids)

        def block() -> pa.RecordBatch:
            packed = pack(np.concatenate(ids), bits)
            types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, first, bits, ends[-1], doc_ids, ends, packed), types)], names=["part", "first", "bits", "n_ids", "doc_ids", "ends", "payload"])

        for whole in batches:
            for batch in pieces(whole, "text"):
                for i, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    own = c.encode(body or b"")
                    if ends and ends[-1] + len(own) + 1 > block_ids:
                        yield block()
                        first += ends[-1]
                        ids, doc_ids, ends = [], [], []
                    ids += [own, end]
                    doc_ids.append(i)
                    ends.append((ends[-1] if ends else 0) + len(own) + 1)
        if ends:
            yield block()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks below ``path``."""
    return spark.read.schema(SCHEMA).parquet(path)


def part_starts(blocks: DataFrame) -> DataFrame:
    """(part, before): how many ids come before each part in the whole set; a row for each part."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def documents_of(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the blocks, from their packed ids.

    Blocks are unpacked where they are read; only the documents' rows meet the parts' places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, bits, n, doc_ids, ends, payload = (batch.column(c)[row].as_py() for c in ("part", "first", "bits", "n_ids", "doc_ids", "ends", "payload"))
                ids = unpack(payload, bits, 0, n).astype("<u4", copy=False)
                begins = [0, *ends[:-1]]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                columns = (doc_ids, [first + a for a in begins], [b - a for a, b in zip(begins, ends)], sums)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ends), pa.int32()), *(pa.array(x, pa.int64()) for x in columns)], names=["part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(run, "part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(blocks), "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_file_rows(docs: DataFrame, source: str, pattern: str, vocabulary: int, path: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` and reads them back, see :func:`documents_of`."""
    path = path or scratch(docs.sparkSession, "token-files")
    write_token_files(docs, path, source, pattern, vocabulary)
    return documents_of(read_token_files(docs.sparkSession, path))
