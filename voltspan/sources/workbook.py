"""Spreadsheets, read as a stream of cells with where they stand."""

from __future__ import annotations

import datetime
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_ROWS, MOST_CELLS, MOST_CHARS = 250_000, 10_000_000, 32_767
SCHEMA = "path string, sheet string, row int, col int, ref string, text string, kind string, flags array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATES = {*range(14, 23), *range(45, 48)}


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def serial_to_iso(value: float, epoch_1904: bool = False) -> str:
    start = datetime.datetime(1904, 1, 1) if epoch_1904 else datetime.datetime(1899, 12, 30)
    at = start + datetime.timedelta(seconds=round(value * 86400))
    return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(sep=" ")


def _dates(book: zipfile.ZipFile) -> list[bool]:
    """Of each cell format, whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): bool(re.search(r"[ymdhs]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", f.get("formatCode", "").lower()))) for f in root.iter(f"{_MAIN}numFmt")}
    formats = root.find(f"{_MAIN}cellXfs")
    return [own.get(i, i in _DATES) for i in (int(x.get("numFmtId", 0)) for x in (formats if formats is not None else []))]


def cells(data: bytes, only: str = "") -> Iterator[tuple]:
    """(sheet, row, col, ref, text, kind, flags) of the sheets whose name ends with a text; ValueError beyond the bounds.

    Kinds: number, text, boolean, date, error. Flags: FORMULA, FORMULA_WITHOUT_VALUE, LONG_TEXT.
    """
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, si in ET.iterparse(io.BytesIO(book.read("xl/sharedStrings.xml"))):
            if si.tag == f"{_MAIN}si":
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
                si.clear()
    dates = _dates(book)
    root = ET.fromstring(book.read("xl/workbook.xml"))
    pr = root.find(f"{_MAIN}workbookPr")
    late = pr is not None and pr.get("date1904") in ("1", "true")
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    n_cells = 0
    for sheet in root.iter(f"{_MAIN}sheet"):
        name = sheet.get("name")
        if not name.endswith(only):
            continue
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        n_rows = 0
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
            for _, row in ET.iterparse(stream):
                if row.tag != f"{_MAIN}row":
                    continue
                n_rows += 1
                at = 0
                for c in row.iter(f"{_MAIN}c"):
                    n_cells += 1
                    if n_rows > MOST_ROWS or n_cells > MOST_CELLS:
                        raise ValueError(f"sheet {name!r} is too large")
                    ref = c.get("r")
                    at = column_number(ref) if ref else at + 1
                    value, formula, kind = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}f"), c.get("t", "n")
                    flags = ["FORMULA"] if formula is not None else []
                    if formula is not None and value is None:
                        flags.append("FORMULA_WITHOUT_VALUE")
                    text = None if value is None else value.text or ""
                    if kind == "s" and text is not None:
                        text, kind = shared[int(text)], "text"
                    elif kind == "inlineStr":
                        text, kind = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), "text"
                    elif kind == "n" and text is not None and int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
                        text, kind = serial_to_iso(float(text), late), "date"
                    else:
                        kind = {"n": "number", "str": "text", "b": "boolean", "e": "error", "d": "date"}.get(kind, "text")
                    if text is not None and len(text) > MOST_CHARS:
                        flags.append("LONG_TEXT")
                    if text is not None or flags:
                        yield name, int(row.get("r", n_rows)), at, ref, text, kind, flags
                row.clear()


def read_workbooks(spark: SparkSession, path: str, only: str = "") -> DataFrame:
    """Cells of workbooks; a part of a workbook goes on as soon as it is read. One that breaks a bound or is damaged ends with a row
    of kind error and the reason as its text, and the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows: list[tuple] = []
                found = cells(data, only)
                while True:
                    try:
                        cell = next(found, None)
                    except (ValueError, KeyError, SyntaxError, EOFError, zipfile.BadZipFile) as e:
                        rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}", "error", None))
                        break
                    if cell is None:
                        break
                    rows.append((name, *cell))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
