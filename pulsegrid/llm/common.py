"""What the operators of this subpackage share: scratch tables, text batches, tokenizer files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import shared_dir

#: The bytes that count as white space in every contract here: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores in front until no column has it (names clash regardless of case)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def with_columns(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list]], fields: list[T.StructField], keep: list[str] | None = None, column: str = "text", rows: int = 1000, size: int = 8_000_000) -> DataFrame:
    """``docs`` with columns computed from whole texts, inside the tasks that read them (no shuffle).

    ``make`` is called once per task and gives a function from a list of UTF-8 texts (null: empty) to one array per
    field. ``keep`` names the input columns that stay (default all). Texts are handed over at most ``rows`` at a time
    and in pieces of about ``size`` bytes, which bounds a worker's memory; a longer text makes a piece of its own.
    """
    keep = docs.columns if keep is None else keep
    inner = fresh("_text", keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(column).alias(inner))
    schema = T.StructType([docs.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for whole in batches:
            for batch in pieces(whole, inner, rows, size):
                work = work or make()
                texts = [x or b"" for x in batch.column(inner).cast(pa.binary()).to_pylist()]
                made = work(texts)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(x, type=t) if not isinstance(x, pa.Array) else x for x, t in zip(made, arrow_types(fields))], names=[*keep, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def arrow_types(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]


def pieces(batch: pa.RecordBatch, column: str, rows: int = 1000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive slices of at most ``rows`` rows and about ``size`` bytes of ``column``."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)
