"""Wiring of the streaming operators: keyed processors, sliding windows, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulsegrid.session import cut, shared_dir, ship_package
from pulsegrid.streaming.processors import DocumentProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, keys: list[str], processor: DocumentProcessor, event_time: str | None = None, delay: str = "120 seconds") -> DataFrame:
    """Apply a processor to a stream, one state document per key.

    With ``event_time`` (a column of seconds) the stream has a watermark ``delay`` behind its latest row: rows behind
    it are dropped before the processor, and its timers fire when the watermark passes them.
    """
    spark = rows.sparkSession
    ship_package()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "None" if event_time is None else "EventTime"
    if event_time is not None:
        rows = rows.withColumn("event_time", F.timestamp_seconds(event_time)).withWatermark("event_time", delay)
    groups = rows.groupBy(*keys)
    transform = groups.transformWithState if processor.rowwise else groups.transformWithStateInPandas
    return transform(processor, processor.schema, "Append", mode)


def accepted(rows: DataFrame, ts: str = "ts", delay: str = "120 seconds") -> DataFrame:
    """Late rows are dropped after the staleness limit."""
    return rows.withWatermark(ts, delay)


def sliding(rows: DataFrame, keys: list[str], ts: str, value: str, length: str, slide: str) -> DataFrame:
    """Trailing range windows of a sample stream: count, sum and last minus first value."""
    by_time = lambda pick: pick(F.col(value), F.col(ts))
    return rows.groupBy(*keys, F.window(ts, length, slide).alias("w")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), (by_time(F.max_by) - by_time(F.min_by)).alias("delta")
    )


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available into a parquet table of the shared folder and return that table."""
    spark = stream.sparkSession
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(_replace(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _replace(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def follow(spark: SparkSession, schema: StructType, folder: str, table: str) -> DataFrame:
    """The files of ``table`` below ``folder`` as a stream, whether it is one file or a folder of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/{table}.parque[t]")


def replay(table: DataFrame, name: str, keys: list[str] | None = None, slices: int = 1, ts: str = "t", files: int = 1000) -> DataFrame:
    """A finished table as a stream: written to the shared folder and read back as a source, at most ``files`` a batch.

    With ``slices`` the rows come in that many steps of time. A slice is written after the one before it, and the rows
    that a key has in it are one file's, so files in the order of their writing keep every key's rows in order.
    """
    spark = table.sparkSession
    path = new_folder(spark, f"{name}-input")
    if slices == 1:
        table.write.parquet(path)
    else:
        table = cut(table)
        first, last = table.agg(F.min(ts), F.max(ts)).first()
        step = max(1, -(-((last or 0) + 1 - (first or 0)) // slices))
        for k in range(slices):
            lo = (first or 0) + k * step
            part = table.where((F.col(ts) >= lo) & (F.col(ts) < lo + step))
            (part.repartition(*keys) if keys else part).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
