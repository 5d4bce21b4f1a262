"""Workbooks written by a small writer of our own, read back as records."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from rollbook.sources import workbooks as w

_M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def letters(i):
    return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)


def write(path, sheets):
    shared = sorted({c for _, rows in sheets for r in rows for c in r if isinstance(c, str) and c})
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_M}" xmlns:r="{_R}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_M}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        for i, (_, rows) in enumerate(sheets, 1):
            cell = lambda r, k, c: f'<c r="{letters(k)}{r}" t="s"><v>{shared.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{letters(k)}{r}"><v>{float(c)}</v></c>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_M}"><sheetData>' + "".join(f'<row r="{r}">' + "".join(cell(r, k, c) for k, c in enumerate(row) if c not in ("", None)) + "</row>" for r, row in enumerate(rows, 1) if row) + "</sheetData></worksheet>")


PLAIN = [["MERCHANT NAME", "Merchant ID", "TID", "Email", "EMAIL ALERTS", "phone", "phone"], ["RED SUN", "2ISW00000000001", 20000001, "a@example.com", "Y", "", "0800"], ["BLUE MOON", "", "2ISW0002", "", "N", "1", "2"], ["", "", "", "", "Y"]]
TITLED = [["Report of terminals"], [], ["Prepared by us", "", "", "x"], ["merchantName", "MX CODE", "State"], ["GREEN TREE", "MX10001", "LAGOS"]]
STACKED = [["MERCHANT NAME", "TID"], ["ONE", "10000001"], [], ["MERCHANT NAME", "OLD BANK ACC NO", "MONTH OF REQUEST"], ["TWO", "1000000001", "05/02/2024"], ["THREE", "1000000002", "2024-03-01 00:00:00"], ["NAME    VALUE LONG\nNAME    V\nName: 3, dtype: str", "", ""]]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    write(tmp_path / "in" / "one.xlsx", [("Plain", PLAIN), ("Titled", TITLED)])
    write(tmp_path / "in" / "sub" / "two.xlsx", [("Empty", [])])
    (tmp_path / "in" / "~$one.xlsx").write_bytes(b"lock")
    return tmp_path


def test_headers(spark):
    rows = spark.createDataFrame([("Merchant Account Name",), ("oldBankAccNo",), ("EMAIL ALERTS",), ("PTSP_fee",), ("mid",), ("midday",), ("Contact Person",), ("x",), ("",), ("Bank Name",)], "h string")
    assert [r[0] for r in rows.select(w.field_of(F.col("h"))).collect()] == ["merchant_name", "account_number", None, None, "merchant_id", "merchant_id", "contact_name", None, None, "bank"]


def test_records_of_plain_and_titled_sheets(spark, folder):
    (folder / "in" / "~$one.xlsx").unlink()
    got = [r.asDict() for r in w.load(spark, str(folder / "in")).orderBy("sheet_name", "row_number").collect()]
    assert [(r["sheet_name"], r["row_number"], r["merchant_name"]) for r in got] == [("one.xlsx :: Plain", 2, "RED SUN"), ("one.xlsx :: Plain", 3, "BLUE MOON"), ("one.xlsx :: Titled", 5, "GREEN TREE")]
    assert (got[0]["tid"], got[0]["phone"], got[1]["phone"], got[2]["mxcode"], got[2]["state"]) == ("20000001", "0800", "1", "MX10001", "LAGOS")
    assert '"EMAIL ALERTS":"Y"' in got[0]["raw_data"] and len({r["id"] for r in got}) == 3


def test_records_of_stacked_sheets(spark, tmp_path):
    write(tmp_path / "s.xlsx", [("S", STACKED)])
    got = [r.asDict() for r in w.load(spark, str(tmp_path), stacked=True).orderBy("row_number").collect()]
    assert [(r["merchant_name"], r["tid"], r["account_number"], r["onboarded_date"]) for r in got] == [("ONE", "10000001", "", ""), ("TWO", "", "1000000001", "2024-02-05"), ("THREE", "", "1000000002", "2024-03-01"), ("VALUE LONG", "", "", "")]


def test_files_and_changes(spark, folder):
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in w.files(spark, str(folder / "in")).collect()) == ["one.xlsx", "two.xlsx"]
    before = spark.createDataFrame(w.hashes(spark, str(folder / "in")).collect())
    write(folder / "in" / "one.xlsx", [("Plain", PLAIN[:2])])
    write(folder / "in" / "three.xlsx", [("Plain", PLAIN)])
    (folder / "in" / "sub" / "two.xlsx").unlink()
    got = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in w.changes(w.hashes(spark, str(folder / "in")), before).collect()}
    assert got == {"one.xlsx": "changed", "two.xlsx": "removed", "three.xlsx": "new"}


def test_files_are_followed_and_none_is_taken_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = lambda: sorted(r["merchant_name"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    run = lambda: w.follow(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")).awaitTermination(120)
    write(tmp_path / "in" / "a.xlsx", [("S", PLAIN)])
    run()
    assert names() == ["BLUE MOON", "RED SUN"]
    write(tmp_path / "in" / "b.xlsx", [("S", TITLED)])
    run()
    assert names() == ["BLUE MOON", "GREEN TREE", "RED SUN"]
