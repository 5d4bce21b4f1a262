"""Workbooks written and read back; gates of a build."""

from __future__ import annotations

import datetime
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from rollbook.operators import gates
from rollbook.sources import books, workbooks


def test_books_hold_all_rows(spark, tmp_path):
    rows = [(i, f"name {i} <&>\"'", float(i) / 4, None if i % 3 else "  two\nlines ", datetime.date(2024, 1, 1 + i % 28), 10**17 + i, "=1+1") for i in range(250)]
    df = spark.createDataFrame(rows, "id int, name string, share double, note string, day date, big bigint, formula string").repartition(3)
    found = books.write(df, str(tmp_path / "out"), "A/B: report", rows=40)
    files = found.orderBy("path").collect()
    assert sum(r["n_rows"] for r in files) == 250 and max(r["n_rows"] for r in files) == 40
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r["path"].rsplit("/", 1)[-1] for r in files)
    read = workbooks.rows(spark, str(tmp_path / "out")).orderBy("file", "row").collect()
    assert {tuple(r["cells"]) for r in read if r["row"] == 1} == {("id", "name", "share", "note", "day", "big", "formula")}
    want = {(str(i), n, str(s).removesuffix(".0"), note or "", str(day), str(big), f) for i, n, s, note, day, big, f in rows}
    assert {tuple(r["cells"]) for r in read if r["row"] > 1} == want and len([r for r in read if r["row"] > 1]) == 250
    with zipfile.ZipFile(files[0]["path"]) as book:
        assert all(ElementTree.fromstring(book.read(n)) is not None for n in book.namelist())
        assert b'name="A B  report"' in book.read("xl/workbook.xml")


def test_odd_books(spark, tmp_path):
    assert books.write(spark.range(0).select(F.lit("x").alias("a")), str(tmp_path / "none"), "s").count() == 0
    df = spark.createDataFrame([("\x00a\x0bb", float("nan"), True, [1, None])], "t string, x double, b boolean, l array<int>")
    books.write(df, str(tmp_path / "odd"), "")
    assert [r["cells"] for r in workbooks.rows(spark, str(tmp_path / "odd")).where("row = 2").collect()] == [["ab", "nan", "True", "[1, None]"]]
    with pytest.raises(ValueError):
        books.write(df, str(tmp_path), "s", rows=books.MOST_ROWS)


def test_gates(spark):
    df = spark.createDataFrame([(1, "a", None, "f.xlsx :: Change"), (2, " ", "x", "F.XLSX :: other"), (3, None, "y", None)], "id int, email string, phone string, sheet_name string")
    checks = gates.content(df, {"email": 1, "phone": 3, "gone": 0}, {"change": 1, "f.xlsx": 3})
    assert sorted(map(tuple, checks.collect())) == [("filled", "email", 1, 1, True), ("filled", "gone", 0, 0, True), ("filled", "phone", 2, 3, False), ("sheet", "change", 1, 1, True), ("sheet", "f.xlsx", 2, 3, False)]
    found = spark.createDataFrame([("q", 1), ("q", 2)], "query string, id int")
    every = checks.unionByName(gates.samples(spark.createDataFrame([("q",), ("r",)], "query string"), found))
    assert tuple(gates.passed(every).first()) == (False, ["filled:phone", "sample:r", "sheet:f.xlsx"])
    assert tuple(gates.passed(every.where("ok")).first()) == (True, []) and gates.passed(every.limit(0)).first()["passed"]
    empty = gates.content(df.limit(0), {"email": 0})
    assert [tuple(r) for r in empty.collect()] == [("filled", "email", 0, 0, True)]
