"""Sources without a reader in Spark: Stata, SAS, Excel and SQLite files, and CSV and JSON text.

A Stata, SAS or Excel path may be a folder or a pattern of files with one layout; every file is read by one task, in pieces
where the format allows it, and is at most 2 GB. Their numbers are doubles, because their missing values are. A SQLite file
must lie where every executor sees it; a table is read in ranges of its row ids.
"""

from __future__ import annotations

import csv
import io
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..plans.sql import read_only

#: Rows of a piece that is read at once.
PIECE = 50_000
#: Rows that a text of a whole result may have.
MAX_TEXT_ROWS = 100_000


def _plain(piece: pd.DataFrame) -> pa.Table:
    """Numbers as doubles, times as timestamps, everything else as text."""
    out = {}
    for name, values in piece.items():
        if pd.api.types.is_datetime64_any_dtype(values):
            out[str(name)] = pa.array(values, pa.timestamp("us"), from_pandas=True)
        elif pd.api.types.is_bool_dtype(values):
            out[str(name)] = pa.array(values, pa.bool_(), from_pandas=True)
        elif pd.api.types.is_numeric_dtype(values):
            out[str(name)] = pa.array(values.astype("float64"), pa.float64(), from_pandas=True)
        else:
            out[str(name)] = pa.array([None if pd.isna(v) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v) for v in values], pa.string())
    return pa.table(out)


def _read_files(spark: SparkSession, path: str, pieces) -> DataFrame:
    """The rows of all files of a path; `pieces` turns a file's bytes into tables. The first file gives the columns."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def header(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield pa.record_batch({"header": [next(pieces(content.as_py())).schema.serialize().to_pybytes()]})

    first = files.orderBy("path").limit(1).select("content").mapInArrow(header, "header binary").first()
    if first is None:
        raise FileNotFoundError(path)
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(first["header"])))
    names = schema.names

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                for table in pieces(content.as_py()):
                    if table.schema.names != names:
                        raise ValueError(f"columns {table.schema.names} where the first file has {names}")
                    yield from table.cast(schema).to_batches()

    return files.select("content").mapInArrow(rows, from_arrow_schema(schema, prefer_timestamp_ntz=True))


def read_stata(spark: SparkSession, path: str, labels: bool = True) -> DataFrame:
    """Stata .dta files; labelled values as their labels, unless `labels` is false."""

    def pieces(content: bytes) -> Iterator[pa.Table]:
        with pd.read_stata(io.BytesIO(content), iterator=True, convert_categoricals=labels) as reader:
            yield _plain(reader.read(PIECE))
            while True:
                try:
                    piece = reader.read(PIECE)
                except StopIteration:
                    return
                if piece.empty:
                    return
                yield _plain(piece)

    return _read_files(spark, path, pieces)


def read_sas(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """SAS files, .xpt transport files or .sas7bdat."""
    kind = "xport" if path.lower().endswith((".xpt", ".xport")) else "sas7bdat"

    def pieces(content: bytes) -> Iterator[pa.Table]:
        with pd.read_sas(io.BytesIO(content), format=kind, encoding=encoding, chunksize=PIECE) as reader:
            for piece in reader:
                yield _plain(piece)

    return _read_files(spark, path, pieces)


#: Names of the parts of a spreadsheet file.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(reference: str) -> int:
    out = 0
    for letter in reference:
        if not letter.isalpha():
            break
        out = out * 26 + ord(letter.upper()) - 64
    return out - 1


def _sheet(content: bytes, sheet: str | int) -> list[list]:
    """The cells of a sheet, row by row: floats, booleans, text or None."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in parts.namelist():
            root = ElementTree.fromstring(parts.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(_MAIN + "t")) for item in root.iter(_MAIN + "si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(parts.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), links[s.get(_LINK)]) for s in ElementTree.fromstring(parts.read("xl/workbook.xml")).iter(_MAIN + "sheet")]
        target = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets)[sheet]
        out: list[list] = []
        with parts.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
            for _, row in ElementTree.iterparse(stream):
                if row.tag != _MAIN + "row":
                    continue
                cells: list = []
                for cell in row.iter(_MAIN + "c"):
                    at = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = cell.find(_MAIN + "v"), cell.get("t", "n")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                    elif value is not None and value.text is not None and kind != "e":
                        cells[at] = shared[int(value.text)] if kind == "s" else value.text == "1" if kind == "b" else float(value.text) if kind == "n" else value.text
                out.append(cells)
                row.clear()
        return out


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet of .xlsx files, by name or place; its first row names the columns. Columns of numbers only are doubles, of
    booleans only booleans, others text. Dates come as day numbers (day 0 is 1899-12-30)."""

    def pieces(content: bytes) -> Iterator[pa.Table]:
        grid = _sheet(content, sheet)
        names = [str(n) if n is not None else f"column_{i + 1}" for i, n in enumerate(grid[0])] if grid else []
        out = {}
        for i, name in enumerate(names):
            values = [row[i] if i < len(row) else None for row in grid[1:]]
            kinds = {type(v) for v in values if v is not None}
            if kinds == {float}:
                out[name] = pa.array(values, pa.float64())
            elif kinds == {bool}:
                out[name] = pa.array(values, pa.bool_())
            else:
                out[name] = pa.array([None if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in values], pa.string())
        yield pa.table(out)

    return _read_files(spark, path, pieces)


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _sqlite_fields(con: sqlite3.Connection, sql: str) -> pa.Schema:
    """The narrowest type that holds all values of each column of a query, as SQLite's columns have no type of their own."""
    names = [d[0] for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description]
    said = con.execute("SELECT " + ", ".join(f"group_concat(DISTINCT typeof({_quoted(n)}))" for n in names) + f" FROM ({sql})").fetchone()
    out = []
    for name, kinds in zip(names, said):
        found = set((kinds or "").split(",")) - {"null", ""}
        kind = pa.int64() if found == {"integer"} else pa.float64() if found and found <= {"integer", "real"} else pa.binary() if found == {"blob"} else pa.string()
        out.append(pa.field(name, kind))
    return pa.schema(out)


def _sqlite_value(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_string(kind):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    return float(value) if pa.types.is_floating(kind) else value


def _sqlite_rows(path: str, sql: str, schema: pa.Schema, bounds: tuple = ()) -> Iterator[pa.RecordBatch]:
    con = _connect(path)
    try:
        cursor = con.execute(sql, bounds)
        while found := cursor.fetchmany(PIECE):
            columns = [pa.array([_sqlite_value(v, f.type) for v in values], f.type) for f, values in zip(schema, zip(*found))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
    finally:
        con.close()


def read_sqlite(spark: SparkSession, path: str, table: str, parts: int = 64) -> DataFrame:
    """A table of a SQLite file, read in `parts` ranges of row ids (a table without row ids: in one)."""
    con = _connect(path)
    try:
        schema = _sqlite_fields(con, f"SELECT * FROM {_quoted(table)}")
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
        except sqlite3.OperationalError:
            return query_sqlite(spark, path, f"SELECT * FROM {_quoted(table)}")
    finally:
        con.close()
    low, high = low or 0, high or 0
    step = max(1, -(-(high - low + 1) // parts))
    sql = f"SELECT * FROM {_quoted(table)} WHERE rowid >= ? AND rowid < ?"

    def rows(batches):
        for batch in batches:
            for start in batch.column(0).to_pylist():
                yield from _sqlite_rows(path, sql, schema, (start, start + step))

    return spark.range(low, high + 1, step, parts).mapInArrow(rows, from_arrow_schema(schema, prefer_timestamp_ntz=True))


def query_sqlite(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """The rows of a read-only query, run by SQLite in one task. The driver runs it once before, for the types."""
    sql = read_only(sql)
    con = _connect(path)
    try:
        schema = _sqlite_fields(con, sql)
    finally:
        con.close()

    def rows(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from _sqlite_rows(path, sql, schema)

    return spark.range(0, 1, 1, 1).mapInArrow(rows, from_arrow_schema(schema, prefer_timestamp_ntz=True))


def sqlite_tables(spark: SparkSession, path: str) -> DataFrame:
    """Names and kinds of the tables and views of a SQLite file."""
    con = _connect(path)
    try:
        found = con.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()
    finally:
        con.close()
    return spark.createDataFrame(found, "name string, kind string")


def sqlite_schema(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The columns of a SQLite table: name, declared type, whether nulls may occur, place in the primary key (0: not in it)."""
    con = _connect(path)
    try:
        found = [(c[1], c[2], not c[3], c[5]) for c in con.execute(f"PRAGMA table_info({_quoted(table)})")]
    finally:
        con.close()
    if not found:
        raise ValueError(f"there is no table {table}")
    return spark.createDataFrame(found, "column string, dtype string, nullable boolean, key int")


def from_csv_string(spark: SparkSession, text: str, separator: str = ",") -> DataFrame:
    """The rows of a CSV text with a header; types are inferred from all of it."""
    options = pa.csv.ParseOptions(delimiter=separator, newlines_in_values=True)
    table = pa.csv.read_csv(io.BytesIO(text.encode()), parse_options=options, read_options=pa.csv.ReadOptions(block_size=max(1, len(text.encode()) + 1)))
    table = pa.table({n: c.cast(pa.string()) if pa.types.is_null(c.type) else c.cast(pa.timestamp("us")) if pa.types.is_timestamp(c.type) else c for n, c in zip(table.column_names, table.columns)})
    return spark.createDataFrame(table)


def _bounded(df: DataFrame, max_rows: int) -> list:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write them to files instead")
    return rows


def to_csv_string(df: DataFrame, max_rows: int = MAX_TEXT_ROWS) -> str:
    """A CSV text with a header; nulls are empty. Refuses more than `max_rows` rows."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    writer.writerows(_bounded(df, max_rows))
    return out.getvalue()


def to_json_string(df: DataFrame, max_rows: int = MAX_TEXT_ROWS) -> str:
    """A JSON list of objects, nulls included. Refuses more than `max_rows` rows."""
    rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("row"))
    return "[" + ",".join(r["row"] for r in _bounded(rows, max_rows)) + "]"


def iter_chunks(df: DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    """The rows in order, `rows` at a time; the driver holds one partition and one chunk."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        held.append(tuple(row))
        if len(held) == rows:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)
