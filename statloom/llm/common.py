"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType, StringType, StructType

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 512
#: Bytes of an Arrow batch under small_batches(); a longer row is a batch of its own.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about ``BATCH_BYTES`` at most, unless a smaller size is set.

    10,000 whole texts can take tens of MB, of which an executor and its Python
    workers hold several copies. The size is a setting of the session, as results
    are planned when they are read; it changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def local(spark: SparkSession, rows: list[tuple], schema: StructType) -> DataFrame:
    """A few rows of the driver as a frame; numbers and strings go without a Python worker, which createDataFrame() starts for a list."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if not all(isinstance(f.dataType, IntegralType | StringType) for f in schema):
        return spark.createDataFrame(rows, schema)
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow), schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Apply a per-row function inside Arrow batches.

    ``make`` runs once per task and returns the row function, which gets the
    columns of ``df`` in order and returns a tuple in the order of ``schema``.
    Only ``SLICE_ROWS`` rows are Python objects at any time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = [row(*x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)
