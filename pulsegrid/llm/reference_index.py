"""A reversible index of content digests: exact reference counts per shard, fronted by a cuckoo filter per shard.

State of one version, in a table in the shared folder, every row of a shard next to the others:

* ``entry``: a live digest, how many documents hold it (``refs``) and the largest of their ids (``top``);
* ``filter``: the shard's cuckoo filter over its live digests.

A change arrives as digests already summed inside each map task, so that a digest held by a third of all documents is
a handful of rows. In the shard's task the filter is asked first. A miss is a new digest: it is stored and inserted. A
hit is verified against the stored digests of that bucket; a verified one changes its count, a false one is stored as
new. A count that falls to zero deletes the digest from table and filter. A filter that overflows is rebuilt at twice
the size from the stored digests. ``holders`` (digest, doc_id) is kept beside it, so that a deletion can find the
next largest holder; it makes every change reversible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import scratch
from pulsegrid.llm.cuckoo import CuckooFilter

STATE = "shard int, kind string, key binary, refs long, top long, table binary"
#: Rows that one step asks the filter about.
STEP = 4096
#: Digests that a shard is laid out for when an index is created.
SHARD_KEYS = 50_000
LEAST_SHARDS = 64


def shards_for(holders: int) -> int:
    return max(LEAST_SHARDS, -(-holders // SHARD_KEYS))


def summed(holders: DataFrame, shards: int, sign: int = 1) -> DataFrame:
    """(key, doc_id) rows to (shard, key, refs, top), summed inside each task only: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) >= 200_000:
                yield from flush(waiting)
                waiting = []
        if waiting:
            yield from flush(waiting)

    def flush(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(waiting)
        t = t.group_by("key").aggregate([([], "count_all"), ("doc_id", "max")])
        keys = t.column("key").combine_chunks()
        n = t.num_rows
        width = len(keys[0].as_py()) if n else 1
        start = np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint8).reshape(n, width)[:, 8:12].copy().view(np.uint32)[:, 0]
        refs = np.asarray(t.column("count_all")) * sign
        out = pa.table({"shard": pa.array((start % shards).astype(np.int32)), "kind": pa.array(["change"] * n, pa.string()), "key": keys, "refs": pa.array(refs, pa.int64()), "top": t.column("doc_id_max").combine_chunks(), "table": pa.nulls(n, pa.binary())})
        yield from out.to_batches()

    return holders.select("key", "doc_id").mapInArrow(run, STATE)


class Shard:
    """The live digests of one shard and their filter."""

    def __init__(self, entries: pa.Table, table: bytes | None) -> None:
        self.keys: list[bytes | None] = entries.column("key").to_pylist()
        self.refs: list[int] = entries.column("refs").to_pylist()
        self.tops: list[int | None] = entries.column("top").to_pylist()
        self.bucket = {k: i for i, k in enumerate(self.keys)}
        self.filter = CuckooFilter(len(self.keys), table)
        if table is None:
            self._rebuild(len(self.keys))

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.array([int.from_bytes(k[:8], "little") for k in keys], dtype=np.uint64)

    def _rebuild(self, capacity: int) -> None:
        live = self.hashes(list(self.bucket))
        while True:
            self.filter = CuckooFilter(capacity)
            if self.filter.insert(live):
                return
            capacity = 2 * max(capacity, 64)

    def add(self, keys: list[bytes], refs: list[int], tops: list[int | None]) -> None:
        """One step: distinct ``keys`` with positive ``refs``."""
        perhaps = self.filter.contains(self.hashes(keys))
        new = []
        for key, n, top, hit in zip(keys, refs, tops, perhaps.tolist()):
            at = self.bucket.get(key) if hit else None
            if at is None:
                self.bucket[key] = len(self.keys)
                self.keys.append(key)
                self.refs.append(n)
                self.tops.append(top)
                new.append(key)
            else:
                self.refs[at] += n
                self.tops[at] = max((x for x in (self.tops[at], top) if x is not None), default=None)
        if new and (len(self.bucket) > self.filter.capacity or not self.filter.insert(self.hashes(new))):
            self._rebuild(2 * len(self.bucket))

    def remove(self, keys: list[bytes], refs: list[int]) -> None:
        """One step: distinct ``keys`` with the (positive) number of holders that go; unknown keys are left alone."""
        perhaps = self.filter.contains(self.hashes(keys))
        gone = []
        for key, n, hit in zip(keys, refs, perhaps.tolist()):
            at = self.bucket.get(key) if hit else None
            if at is None:
                continue
            self.refs[at] -= n
            if self.refs[at] <= 0:
                self.keys[at] = None
                del self.bucket[key]
                gone.append(key)
        if gone:
            self.filter.delete(self.hashes(gone))

    def rows(self, shard: int) -> pa.Table:
        live = list(self.bucket.values())
        n = len(live)
        return pa.table({
            "shard": pa.array([shard] * (n + 1), pa.int32()),
            "kind": pa.array(["entry"] * n + ["filter"], pa.string()),
            "key": pa.array([self.keys[i] for i in live] + [None], pa.binary()),
            "refs": pa.array([self.refs[i] for i in live] + [n], pa.int64()),
            "top": pa.array([self.tops[i] for i in live] + [None], pa.int64()),
            "table": pa.array([None] * n + [self.filter.to_bytes()], pa.binary()),
        })


def changed(group: pa.Table) -> pa.Table:
    """One shard's task: old state and changes in, new state out."""
    import pyarrow.compute as pc

    shard = group.column("shard")[0].as_py()
    kind = group.column("kind")
    stored_filter = group.filter(pc.equal(kind, "filter")).column("table").to_pylist()
    state = Shard(group.filter(pc.equal(kind, "entry")), stored_filter[0] if stored_filter else None)
    change = group.filter(pc.equal(kind, "change"))
    for sign, work in ((1, state.add), (-1, state.remove)):
        part = change.filter(pc.greater(change.column("refs"), 0) if sign > 0 else pc.less(change.column("refs"), 0))
        keys, refs, tops = (part.column(c).to_pylist() for c in ("key", "refs", "top"))
        at = 0
        while at < len(keys):
            step: dict[bytes, list] = {}  # a digest that several tasks have sent is one key of a step
            for k, n, top in zip(keys[at : at + STEP], refs[at : at + STEP], tops[at : at + STEP]):
                row = step.setdefault(k, [0, None])
                row[0] += abs(n)
                row[1] = max((x for x in (row[1], top) if x is not None), default=None)
            args = [list(step), [r[0] for r in step.values()]]
            work(*args, [r[1] for r in step.values()]) if sign > 0 else work(*args)
            at += STEP
    return state.rows(shard)


class ReferenceIndex:
    """Digests of documents with insertion and deletion; each change writes a new version, old ones stay readable."""

    def __init__(self, spark: SparkSession, shards: int, state: str | None = None, holders: list[str] | None = None) -> None:
        self.spark, self.shards, self.state, self.holder_paths = spark, shards, state, holders or []

    @classmethod
    def create(cls, spark: SparkSession, expected_holders: int) -> ReferenceIndex:
        return cls(spark, shards_for(expected_holders))

    def _version(self, changes: DataFrame, holders: list[str]) -> ReferenceIndex:
        rows = changes
        if self.state:
            rows = rows.unionByName(self.spark.read.schema(STATE).parquet(self.state))
        path = scratch(self.spark, "reference-index")
        rows.groupBy("shard").applyInArrow(changed, STATE).write.option("compression", "zstd").parquet(path)
        return ReferenceIndex(self.spark, self.shards, path, holders)

    def insert(self, holders_path: str) -> ReferenceIndex:
        """Adds the (key binary, doc_id long) rows of the table at ``holders_path``, a pair at most once."""
        rows = self.spark.read.schema("key binary, doc_id long").parquet(holders_path)
        return self._version(summed(rows, self.shards), [*self.holder_paths, holders_path])

    def delete(self, doc_ids: DataFrame) -> ReferenceIndex:
        """Takes documents out again: after it, the index is as if they had never been inserted."""
        gone = doc_ids.select("doc_id").distinct()
        all_holders = self.holders()
        left = scratch(self.spark, "holders")
        all_holders.join(gone, "doc_id", "left_anti").write.option("compression", "zstd").parquet(left)
        leaving = all_holders.join(gone, "doc_id", "left_semi")
        next_index = self._version(summed(leaving, self.shards, -1), [left])
        touched = leaving.groupBy("key").agg(F.count("*").alias("n")).select("key")
        tops = next_index.holders().join(touched, "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("_top"))
        state = self.spark.read.schema(STATE).parquet(next_index.state).join(tops, "key", "left")
        path = scratch(self.spark, "reference-index")
        state.select("shard", "kind", "key", "refs", F.coalesce("_top", "top").alias("top"), "table").write.option("compression", "zstd").parquet(path)
        return ReferenceIndex(self.spark, self.shards, path, [left])

    def holders(self) -> DataFrame:
        return self.spark.read.schema("key binary, doc_id long").parquet(*self.holder_paths)

    def entries(self) -> DataFrame:
        """(key, refs, top) of the live digests."""
        return self.spark.read.schema(STATE).parquet(self.state).where("kind = 'entry'").select("key", "refs", "top")

    def filters(self) -> DataFrame:
        """(shard, live, table) of the shards' filters, for callers that test digests before asking the table."""
        return self.spark.read.schema(STATE).parquet(self.state).where("kind = 'filter'").select("shard", F.col("refs").alias("live"), "table")
