"""Readers of formats that Spark has none for, against the libraries that write them."""

import json
import sqlite3
import zipfile

import pandas as pd
import pytest

from statloom.sources import files


def test_stata_files_with_labels_and_missing_values(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for i in range(2):
        frame = pd.DataFrame({"n": [1, 2, None], "s": ["a", "", "ü"], "t": pd.to_datetime(["2020-01-01", None, "2021-05-06"]), "k": pd.Categorical(["x", "y", "x"])})
        frame.to_stata(tmp_path / "d" / f"{i}.dta", write_index=False, version=118)
    got = files.read_stata(spark, str(tmp_path / "d" / "*.dta"))
    assert got.dtypes == [("n", "double"), ("s", "string"), ("t", "timestamp_ntz"), ("k", "string")]
    rows = sorted(map(tuple, got.select("n", "s", "k").collect()), key=str)
    assert rows == sorted([(1.0, "a", "x"), (2.0, "", "y"), (None, "ü", "x")] * 2, key=str)
    assert got.where("t is null").count() == 2
    with pytest.raises(Exception):
        files.read_stata(spark, str(tmp_path / "none" / "*.dta"))


def test_excel_sheets_by_name_and_place(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>v</t></is></c><c r="C1" t="str"><v>ok</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c></row><row><c r="B3"><v>2</v></c></row></sheetData></worksheet>')
    for sheet in ("one", 0):
        got = files.read_excel(spark, str(path), sheet)
        assert got.dtypes == [("name", "string"), ("v", "double"), ("ok", "boolean")]
        assert [tuple(r) for r in got.orderBy("v").collect()] == [("ab", 1.5, True), (None, 2.0, None)]


def test_sqlite_tables_queries_and_schemas(spark, tmp_path):
    path = str(tmp_path / "f.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, v, mixed)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i * 3, f"n{i}", i / 2 if i % 2 else i, "x" if i == 5 else i) for i in range(100)])
        con.execute("CREATE TABLE empty (a INTEGER)")
        con.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, w INTEGER) WITHOUT ROWID")
        con.execute("INSERT INTO keyed VALUES ('a', 1), ('b', NULL)")
    con.close()
    got = files.read_sqlite(spark, path, "t", 7)
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("v", "double"), ("mixed", "string")]
    assert sorted(r["id"] for r in got.collect()) == [i * 3 for i in range(100)]
    assert files.read_sqlite(spark, path, "empty").count() == 0
    assert sorted(map(tuple, files.read_sqlite(spark, path, "keyed").collect())) == [("a", 1), ("b", None)]
    assert files.query_sqlite(spark, path, "SELECT count(*) AS n, sum(v) AS s FROM t;").first()["n"] == 100
    with pytest.raises(ValueError):
        files.query_sqlite(spark, path, "DELETE FROM t")
    assert [tuple(r) for r in files.sqlite_tables(spark, path).collect()] == [("empty", "table"), ("keyed", "table"), ("t", "table")]
    assert [tuple(r) for r in files.sqlite_schema(spark, path, "t").collect()][:2] == [("id", "INTEGER", True, 1), ("name", "TEXT", False, 0)]


def test_texts_and_chunks(spark):
    df = files.from_csv_string(spark, 'a,b,c\n1,"x, y",\n2,"line\nbreak",\n')
    assert [tuple(r) for r in df.collect()] == [(1, "x, y", None), (2, "line\nbreak", None)]
    assert files.to_csv_string(df) == 'a,b,c\n1,"x, y",\n2,"line\nbreak",\n'
    assert json.loads(files.to_json_string(df)) == [{"a": 1, "b": "x, y", "c": None}, {"a": 2, "b": "line\nbreak", "c": None}]
    with pytest.raises(ValueError):
        files.to_csv_string(spark.range(11), 10)
    assert [len(c) for c in files.iter_chunks(spark.range(0, 25, 1, 3), 10)] == [10, 10, 5]
    assert list(files.iter_chunks(spark.range(0), 10)) == []
