"""Readers and writers by file ending, and dataset information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings and formats.
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc"}


def ending(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower()


def read(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """CSV (with a header), TSV, Parquet, ORC or JSON lines, by the path's ending; without a schema CSV types are inferred."""
    kind = ending(path)
    if kind not in FORMATS:
        raise ValueError(f"unknown ending .{kind}; there are {', '.join(FORMATS)}")
    reader = spark.read.options(**options)
    if FORMATS[kind] == "csv":
        reader = reader.options(header=options.get("header", True), sep=options.get("sep", "\t" if kind == "tsv" else ","))
        reader = reader if schema else reader.option("inferSchema", True)
    return (reader.schema(schema) if schema else reader).format(FORMATS[kind]).load(path)


def write(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Write in the format of the path's ending, a file per partition."""
    kind = ending(path)
    if kind not in FORMATS:
        raise ValueError(f"unknown ending .{kind}")
    writer = df.write.mode(mode).format(FORMATS[kind])
    if FORMATS[kind] == "csv":
        writer = writer.options(header=True, sep="\t" if kind == "tsv" else ",")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def info(df: DataFrame) -> DataFrame:
    """A row per column: name, type and nulls, with the number of rows."""
    wide = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(df.columns)))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("dtype"), F.col(f"z{i}").alias("null_count"), F.col("__n").alias("n_rows")) for i, (c, k) in enumerate(df.dtypes)]
    return wide.select(F.inline(F.array(*rows)))
