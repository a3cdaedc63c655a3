"""Shared helpers of the training-data operators: reading, durable cuts and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.storage import shared_folder, shared_path

#: Characters of text that one step of a Python operator holds at a time.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder, so that lost executors cost a reread."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the cluster's shared folder: a cut like ``durable``, in compressed columns."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[dict[str, list]]:
    """Columns as Python lists, a bounded number of characters at a time; a null text comes out as None."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).nbytes / batch.num_rows
        step = max(1, int(limit // max(1.0, sizes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}


def map_slices(
    df: DataFrame, text: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: T.StructType
) -> DataFrame:
    """Apply ``make()`` (called once a task) to bounded slices of ``df``; it returns columns of ``schema``."""
    names = schema.names

    def run(batches):
        arrow = to_arrow_schema(schema)
        work = make()
        for part in slices(batches, text):
            out = work(part)
            if len(out[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def id_bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string")) % modulus
