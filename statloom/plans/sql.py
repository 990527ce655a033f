"""Read-only SQL over named frames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_READ = re.compile(r"^\s*(?:--[^\n]*\n\s*)*(select|with|values|show|describe|desc|explain|table)\b", re.I)
_WRITES = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|merge|attach|copy|load|set|cache|refresh|grant|revoke|call)\b", re.I)


def read_only(statement: str) -> str:
    """The statement, if it only reads and is a single one; strings and comments aren't looked at."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`", "''", statement), flags=re.S)
    if not _READ.match(statement) or ";" in bare.strip().rstrip(";") or _WRITES.search(bare):
        raise ValueError("only a single reading statement is accepted")
    return statement.strip().rstrip(";")


def query(spark: SparkSession, statement: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a reading statement; frames are visible under their names."""
    for name, df in (frames or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(read_only(statement))


def tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES").select("tableName", "isTemporary")


def schema(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in spark.table(table).schema], "column string, dtype string, nullable boolean")
