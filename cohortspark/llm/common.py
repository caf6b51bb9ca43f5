"""Shared helpers: tables, stored stages, and row-wise Arrow functions."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.session import shared_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(frame: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """The frame written to the shared folder and read again; this cuts the lineage, and lost executors cost nothing."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_SHIPPED: set[str] = set()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each application, so that they can import it.

    Batches for Python workers are kept to eight megabytes, unless the session has a bound of its own: a worker holds
    a batch several times over, and the usual bound is 64 megabytes.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="cohortspark-"), "cohortspark_source.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def parts(spark: SparkSession) -> int:
    """The number of partitions that the session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to few rows and to a few megabytes (one row at least), so that outputs stay small."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            piece = batch.slice(at, n)
            while n > 1 and piece.nbytes > size:
                n = max(1, n // 2)
                piece = batch.slice(at, n)
            yield piece
            at += n


def free_names(frame: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, each with so many underscores before it that no column of the frame has it."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def map_batches(
    frame: DataFrame, columns: list, function: Callable[[pa.RecordBatch], list], schema: str, rows: int = 256
) -> DataFrame:
    """function turns a slice of the columns into the lists or arrays of the result's columns.

    Only the columns named are read, under names of their own, so other columns of the frame cannot clash.
    """
    chosen = frame.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)])
    ship(frame.sparkSession)
    empty = frame.sparkSession.createDataFrame([], schema)
    arrow = pa.schema([(f.name, arrow_type(f.dataType.simpleString())) for f in empty.schema.fields])

    def run(batches):
        for piece in slices(batches, rows):
            out = function(piece)
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, arrow)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return chosen.mapInArrow(run, empty.schema)


def with_columns(frame: DataFrame, inputs: list[str], function: Callable[[list[list]], list], schema: str, rows: int = 256) -> DataFrame:
    """The frame with new columns from `schema`; function turns lists of the inputs' values into lists of theirs.

    All other columns pass through as they are, whatever their types; a column that the frame has already under a
    new one's name is an error, so use names of one's own.
    """
    ship(frame.sparkSession)
    new = frame.sparkSession.createDataFrame([], schema).schema
    if clash := {f.name.lower() for f in new} & {c.lower() for c in frame.columns}:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    at = [frame.columns.index(c) for c in inputs]
    types = [(f.name, arrow_type(f.dataType.simpleString())) for f in new]

    def run(batches):
        for piece in slices(batches, rows):
            made = function([piece.column(i).to_pylist() for i in at])
            arrays = [*piece.columns, *[pa.array(x, t) for x, (_, t) in zip(made, types)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*piece.schema.names, *[n for n, _ in types]])

    return frame.mapInArrow(run, type(new)([*frame.schema.fields, *new.fields]))


def arrow_type(name: str) -> pa.DataType:
    """The Arrow type of a simple Spark type."""
    if name.startswith("array<"):
        return pa.list_(arrow_type(name[6:-1]))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(), "smallint": pa.int16(), "timestamp": pa.timestamp("us", "UTC"),
    }[name]
