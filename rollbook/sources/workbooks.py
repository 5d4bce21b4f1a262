"""Workbooks as rows: which files there are and what has changed, their sheets' cells, header rows, and records.

A sheet comes as rows of cells (file, sheet, row, cells). Headers are found by how many cells name a known column, a
stacked sheet has several, and every data row is read under the last header above it. All of that is column
expressions; only the unpacking of a file's XML is Python, a file at a time.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions.identifiers import clean_date
from rollbook.functions.text import _text, any_of, squeeze

#: What columns are called, by field, in the order in which names are tried; each name is tried whole, as a beginning, then as a part.
HEADERS = {
    "merchant_name": ("merchant name", "dba", "trading name", "merchant"), "merchant_id": ("merchant id", "mid"), "mxcode": ("mxcode", "mx code", "merchant code"), "payable_code": ("payable code", "payable id"),
    "tid": ("tid", "terminal id", "terminal code"), "terminal_serial": ("terminal serial", "serial"), "slip_header": ("slip header",), "email": ("email", "e mail"), "phone": ("phone", "mobile", "telephone"),
    "address": ("address", "physical addr", "location", "street", "city", "town"), "lga": ("lga", "local government"), "contact_name": ("contact name", "contact person", "contact"), "contact_title": ("title", "contact title"),
    "account_name": ("account name",), "account_number": ("account no", "account number", "acct no", "bank account", "bank acc no", "old bank acc no", "new bank acc no", "bank acc"), "bank_code": ("bank code", "old bank code", "new bank code"),
    "bank": ("bank", "bank name"), "state_code": ("state code",), "state": ("state",), "bvn": ("bvn", "bank verification number"), "ptsp": ("ptsp",), "terminal_type": ("terminal type", "terminal model", "device type"),
    "deployment_status": ("deployment status", "status"), "remarks": ("remark", "reason", "comment", "description"), "alias": ("alias", "ussd", "short code"), "static_acc_no": ("static acc", "static account"),
    "onboarded_date": ("month of request", "date created", "created date", "onboarded date", "request date", "date of request"),
}
#: Headers that look like a field's and are not.
EXCLUDED = ("bank acc type", "old bank acc type", "new bank acc type", "account type", "client secret", "client id", "email alerts", "email alert", "fee", "ptsp fee", "settlement bank fee", "amount to acquirer")
#: Fields of which a record must have one.
CONTENT = ("merchant_name", "merchant_id", "mxcode", "payable_code", "tid", "terminal_serial", "slip_header", "email", "phone", "address", "contact_name", "account_name", "account_number", "alias", "bank", "state", "onboarded_date")
#: Rows that are searched for a sheet's header, and the least known cells and share of a header.
TOP_ROWS, LEAST_KNOWN, LEAST_SHARE, LEAST_SHARE_STACKED = 25, 2, 0.5, 0.4
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def files(spark: SparkSession, folder: str, pattern: str = "*.xls*") -> DataFrame:
    """(path, mtime, size) of all files under the folder whose name fits, open ones' lock files aside. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", F.unix_micros("modificationTime").alias("mtime"), F.col("length").alias("size"))


def hashes(spark: SparkSession, folder: str, pattern: str = "*.xls*") -> DataFrame:
    """(path, hash): SHA-256 of each file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", F.sha2("content", 256).alias("hash"))


def changes(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, status): new, changed, unchanged or removed, by hash."""
    both = current.select("path", F.col("hash").alias("_now")).join(recorded.select("path", F.col("hash").alias("_then")), "path", "full")
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_now") == F.col("_then"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def _place(reference: str) -> int:
    """The column, from 0, of a cell's reference such as AB12."""
    n = 0
    for ch in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _sheets(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row from 1, cells) of a workbook's sheets, in order; numbers as they are written, without a trailing .0."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag.endswith("}si"):
                    shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
                    item.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        for sheet in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iterfind("m:sheets/m:sheet", _NS):
            target = targets[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as data:
                number = 0
                for _, row in ElementTree.iterparse(data):
                    if not row.tag.endswith("}row"):
                        continue
                    number = int(row.get("r") or number + 1)
                    cells: list[str] = []
                    for c in row.iterfind("m:c", _NS):
                        at = _place(c.get("r")) if c.get("r") else len(cells)
                        cells += [""] * (at + 1 - len(cells))
                        value = c.findtext("m:v", "", _NS)
                        if c.get("t") == "s":
                            value = shared[int(value)]
                        elif c.get("t") == "inlineStr":
                            value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                        cells[at] = value[:-2] if re.fullmatch(r"\d+\.0", value) else value
                    yield sheet.get("name"), number, cells
                    row.clear()


def rows(spark: SparkSession, folder: str, pattern: str = "*.xlsx") -> DataFrame:
    """(file, sheet, row, cells) of all workbooks under a folder: a file is read by one task, its rows leave it in batches."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                held: list[dict] = []
                for sheet, number, cells in _sheets(content):
                    held.append({"file": path.rsplit("/", 1)[-1], "sheet": sheet, "row": number, "cells": cells})
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, _ROWS)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, _ROWS)

    return found.mapInArrow(unpack, "file string, sheet string, row int, cells array<string>")


_ROWS = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])


def clean_cell(c: Column) -> Column:
    """A cell without outer white space; of a pasted printout (lines of a label and a value) the longest value."""
    text = F.trim(F.regexp_replace(_text(c), " ", " "))
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*Name:\s*\d+,\s*dtype:\s*\w+\s*$"))
    values = F.transform(lines, lambda x: F.trim(F.when(x.rlike(r"\S\s{2,}"), F.regexp_replace(x, r"^\s*\S+(?: \S+)*\s{2,}", "")).otherwise(x)))
    longest = F.reduce(values, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(text.contains("\n"), longest).otherwise(text)


def field_of(header: Column) -> Column:
    """The field that a header names, or null: its words compared whole, then as a beginning, then as a part, never inside a word."""
    words = F.regexp_replace(F.regexp_replace(_text(header), " ", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    clean = F.lower(squeeze(F.regexp_replace(words, "[_-]", " ")))
    out = F.lit(None).cast("string")
    tests = (lambda n: clean == n, lambda n: clean.startswith(n), lambda n: clean.rlike(rf"(?<![a-z0-9]){re.escape(n)}(?![a-z0-9])"))
    for test in reversed(tests):
        for field, names in reversed(HEADERS.items()):
            out = F.when(any_of([test(n) for n in names]), F.lit(field)).otherwise(out)
    return F.when(clean.isin(*EXCLUDED) | clean.rlike(r"(?:^| )fees?\b"), F.lit(None).cast("string")).otherwise(out)


def with_headers(sheet_rows: DataFrame, stacked: bool = False) -> DataFrame:
    """Rows with is_header: of each sheet the row among the first that names most columns; if stacked, every row that names enough."""
    cells = F.transform("cells", clean_cell)
    known = F.size(F.filter("_c", lambda x: (x != "") & field_of(x).isNotNull()))
    filled = F.size(F.filter("_c", lambda x: x != ""))
    counted = sheet_rows.withColumn("_c", cells).withColumn("_known", known).withColumn("_filled", filled)
    share = LEAST_SHARE_STACKED if stacked else LEAST_SHARE
    able = (F.col("_known") >= LEAST_KNOWN) & (F.col("_known") >= share * F.col("_filled"))
    if stacked:
        return counted.withColumn("is_header", able).withColumn("cells", F.col("_c")).drop("_c", "_known", "_filled")
    best = counted.where(able & (F.col("row") <= TOP_ROWS)).groupBy("file", "sheet").agg(F.min_by("row", F.struct(-F.col("_known"), "row")).alias("_at"))
    return counted.join(best, ["file", "sheet"], "left").withColumn("is_header", F.coalesce(F.col("row") == F.col("_at"), F.lit(False))).withColumn("cells", F.col("_c")).drop("_c", "_known", "_filled", "_at")


def records(found: DataFrame) -> DataFrame:
    """Records from rows with is_header: a column per field of HEADERS, sheet_name (file :: sheet), row_number, and raw_data, the filled cells as JSON by header.

    A row is read under the last header above it in its sheet. Of several columns of one field the first filled one
    counts. Rows above any header, blank rows and rows without any of CONTENT are left out. Only header rows are held
    against the fields' names, once for each.
    """
    order = Window.partitionBy("file", "sheet").orderBy("row")
    heads = found.where("is_header").select("file", "sheet", F.col("row").alias("_from"), F.lead("row").over(order).alias("_to"), F.col("cells").alias("_head"), F.transform("cells", field_of).alias("_fields"))
    data = found.where("not is_header").alias("d").join(heads.alias("h"), ["file", "sheet"]).where("row > _from and (_to is null or row < _to)")
    cells = F.filter(F.arrays_zip(F.col("_head").alias("head"), F.col("_fields").alias("field"), F.col("cells").alias("cell")), lambda x: F.coalesce(x["cell"], F.lit("")) != "")
    data = data.withColumn("_z", cells).where(F.size("_z") > 0)
    of = lambda f: F.coalesce(F.get(F.filter("_z", lambda x: x["field"] == f), F.lit(0))["cell"], F.lit(""))
    columns = [(clean_date(of(f)) if f == "onboarded_date" else of(f)).alias(f) for f in HEADERS]
    named = F.filter(F.transform("_z", lambda x: F.struct(F.coalesce(x["head"], F.lit("")).alias("k"), x["cell"].alias("v"))), lambda x: x["k"] != "")
    names = F.array_distinct(F.transform(named, lambda x: x["k"]))
    raw = F.to_json(F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(named, lambda x: x["k"] == n), F.lit(0))["v"])))
    out = data.select(F.concat_ws(" :: ", "file", "sheet").alias("sheet_name"), F.col("row").alias("row_number"), *columns, raw.alias("raw_data"))
    return out.where(any_of([F.col(c) != "" for c in CONTENT if c in HEADERS]))


def load(spark: SparkSession, folder: str, stacked: bool = False) -> DataFrame:
    """All records of the workbooks under a folder, numbered (id) by file, sheet and row."""
    found = records(with_headers(rows(spark, folder), stacked))
    return found.select(F.xxhash64("sheet_name", "row_number").alias("id"), *found.columns)


def follow(spark: SparkSession, folder: str, checkpoint: str, sink: str, stacked: bool = False):
    """Workbooks as they arrive: each micro-batch unpacks new files and appends their records to a Parquet sink; run again it takes up where it stopped.

    Returns the running query (trigger availableNow): files that are there, and none twice.
    """
    source = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.xlsx").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def take(batch: DataFrame, number: int) -> None:
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                    found = [{"file": path.rsplit("/", 1)[-1], "sheet": s, "row": n, "cells": c} for s, n, c in _sheets(content)]
                    if found:
                        yield pa.RecordBatch.from_pylist(found, _ROWS)

        unpacked = batch.select("path", "content").mapInArrow(unpack, "file string, sheet string, row int, cells array<string>")
        records(with_headers(unpacked, stacked)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
