"""Spreadsheets (Office Open XML): the sheets of a workbook and the cells of a sheet as text.

A sheet has 1,048,576 rows at most by its format, so the driver reads it; the file itself is read by Spark, wherever it is.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession

from ..diagnostics import fail

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats of dates and times. Fixed values.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class Workbook:
    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
            book = self._xml("xl/workbook.xml")
            links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        except (zipfile.BadZipFile, KeyError, ET.ParseError):
            fail("unsupported-file-type", "this is no workbook")
        self.sheets = {s.get("name"): self._place(links[s.get(LINK)]) for s in book.iter(f"{MAIN}sheet")}
        late = next(book.iter(f"{MAIN}workbookPr"), None)
        self.zero = dt.datetime(1904, 1, 1) if late is not None and late.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        has = set(self.zip.namelist())
        self.texts = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in has else []
        self.dates = self._date_styles() if "xl/styles.xml" in has else []

    def _xml(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    @staticmethod
    def _place(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _date_styles(self) -> list[bool]:
        """For each cell style whether it shows a date."""
        styles = self._xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
        shows = lambda n: n in DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(n, "").lower())))
        return [shows(int(x.get("numFmtId", 0))) for formats in styles.iter(f"{MAIN}cellXfs") for x in formats]

    def rows(self, sheet: str) -> Iterator[list[str | None]]:
        if sheet not in self.sheets:
            fail("QUERY_SOURCE_NOT_FOUND", f"there is no sheet {sheet!r}", sheets=list(self.sheets))
        for _, row in ET.iterparse(self.zip.open(self.sheets[sheet])):
            if row.tag == f"{MAIN}row":
                cells: list[str | None] = []
                for cell in row:
                    at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(self.text(cell))
                yield cells
                row.clear()

    def text(self, cell: ET.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
        if value is None or value.text is None or kind == "e":
            return None
        if kind == "s":
            return self.texts[int(value.text)]
        if kind == "b":
            return "true" if value.text == "1" else "false"
        style = int(cell.get("s", 0))
        if kind == "n" and style < len(self.dates) and self.dates[style]:
            moment = self.zero + dt.timedelta(seconds=round(float(value.text) * 86400))
            return moment.strftime("%Y-%m-%d" if moment.time() == dt.time() else "%Y-%m-%dT%H:%M:%S")
        return f"{float(value.text):.0f}" if kind == "n" and re.fullmatch(r"-?\d+(\.0*)?([eE]\+?\d+)?", value.text) and float(value.text).is_integer() else value.text


def column_number(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - ord("A") + 1
    return n - 1


def workbook(spark: SparkSession, path: str) -> Workbook:
    return Workbook(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def content_of(sheets: dict[str, list[list[Any]]]) -> bytes:
    """A workbook of sheets of rows: numbers, booleans, texts and blanks."""
    space = f'xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"'
    out = io.BytesIO()

    def cell(v: Any) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {space}><sheets>" + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {space}><sheetData>" + "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def save(spark: SparkSession, path: str, sheets: dict[str, list[list[Any]]]) -> None:
    """Writes a workbook to any place that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content_of(sheets)))
    out.close()
