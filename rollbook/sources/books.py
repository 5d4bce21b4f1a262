"""Workbooks as a sink: the rows of a DataFrame as .xlsx files of one sheet, each partition's its own."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from typing import BinaryIO
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rollbook.sources.shared import written

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml."
#: Rows of a sheet that the format allows, its header among them, and characters that XML does not.
MOST_ROWS = 1_048_576
_BARRED = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")


def _xml(text: str) -> str:
    return escape(_BARRED.sub("", text), {'"': "&quot;"})


def _cell(value: object, style: int = 0) -> str:
    """Numbers as numbers, all else as text, which is never read as a formula; nothing for null. A number that spreadsheets would round is text."""
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool):
        if value == value and abs(value) < 10**15:
            return f"<c><v>{value}</v></c>"
    look = f' s="{style}"' if style else ""
    return f'<c t="inlineStr"{look}><is><t xml:space="preserve">{_xml(str(value))}</t></is></c>'


class _Book:
    """A workbook that is written row by row; no sheet is ever held in memory."""

    def __init__(self, out: BinaryIO, sheet: str, header: list[str]):
        self.out, self.rows = out, 0
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
        parts = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{_TYPE}{t}+xml"/>' for p, t in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
        self.zip.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{parts}</Types>')
        self.zip.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="{_xml(re.sub(r"[][*?:/\\]", " ", sheet)[:31]) or "Sheet"}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        fonts, fill, line = '<fonts count="2"><font/><font><b/></font></fonts>', '<fills count="1"><fill/></fills>', '<borders count="1"><border/></borders>'
        self.zip.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}">{fonts}{fill}{line}<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
        self.sheet.write(("<row>" + "".join(_cell(h, 1) for h in header) + "</row>").encode())

    def add(self, row: tuple) -> None:
        self.sheet.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
        self.rows += 1

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()
        self.out.close()


def write(df: DataFrame, folder: str, sheet: str, rows: int = 100_000) -> DataFrame:
    """Writes df as workbooks of ``rows`` rows at most under a folder that all executors reach; (path, n_rows) of each.

    Files are named by sheet, partition and number, and appear whole: a task that runs again, or twice, writes the
    same names. Dates, arrays and the like are text. An empty partition makes no file, and an empty table none. Cells
    are written whole; spreadsheets show the first 32,767 characters.
    """
    if not 0 < rows < MOST_ROWS:
        raise ValueError(f"a sheet holds a header and up to {MOST_ROWS - 1} rows")
    header, stem = list(df.columns), re.sub(r"\W+", "_", sheet)

    def unload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        book, done, place = None, [], ("", "")

        def finish() -> None:
            book.close()
            system.move(*place)
            done.append((place[1], book.rows))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if book is not None and book.rows == rows:
                    finish()
                    book = None
                if book is None:
                    name = f"{stem}-{context.partitionId():05d}-{len(done):05d}"
                    place = (f"{base}/.{name}.{context.taskAttemptId()}", f"{base}/{name}.xlsx")
                    book = _Book(system.open_output_stream(place[0], compression=None), sheet, header)
                book.add(row)
        if book is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "n_rows"])

    return written(df.mapInArrow(unload, "path string, n_rows bigint"), "books")
