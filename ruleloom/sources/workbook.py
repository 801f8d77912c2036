"""Excel workbooks (.xlsx): one task per workbook streams the chosen sheets into rows of text cells.

A workbook is a zip of XML parts and cannot be split, but the format itself bounds a sheet to about a million rows.
The choice of sheets reaches the reader, which opens no part of another sheet. A first pass reads the headers alone, and
of the shared texts as many as a header refers to.
Numbers stay as the file holds them, so codes with leading zeros survive; dates stay serial numbers.
"""

from __future__ import annotations

import io
import re
import sys
import zipfile
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.schema import ROW, SHEET, SOURCE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHEET_NO = "_sheet_no"
ROWS_SCHEMA = f"{SOURCE} string, {SHEET} string, {SHEET_NO} int, {ROW} long, cells map<string,string>"
BATCH_ROWS = 5000
RELATION_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"  # fixed value


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parts(element, name: str) -> list:
    return [e for e in element.iter() if _local(e.tag) == name]


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Sheet names with their part names, in workbook order."""
    relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in _parts(relations, "Relationship")}
    sheets = _parts(ElementTree.fromstring(book.read("xl/workbook.xml")), "sheet")
    found = [(s.get("name"), targets[s.get(RELATION_ID)]) for s in sheets]
    return [(n, t.lstrip("/") if t.startswith("/") else f"xl/{t}") for n, t in found]


def _plain_text(item) -> str:
    """The text of a string item without its phonetic guides."""
    guides = {id(t) for guide in _parts(item, "rPh") for t in guide.iter()}
    return "".join(t.text or "" for t in _parts(item, "t") if id(t) not in guides)


class _SharedStrings:
    """The texts that cells refer to by number, read as far as they are asked for."""

    def __init__(self, book: zipfile.ZipFile):
        self.known: list[str] = []
        self.rest = self._read(book)

    @staticmethod
    def _read(book: zipfile.ZipFile) -> Iterator[str]:
        if "xl/sharedStrings.xml" not in book.namelist():
            return
        with book.open("xl/sharedStrings.xml") as part:
            for _, element in ElementTree.iterparse(part):
                if _local(element.tag) == "si":
                    yield _plain_text(element)
                    element.clear()

    def __getitem__(self, number: int) -> str:
        self.known += islice(self.rest, max(0, number + 1 - len(self.known)))
        return self.known[number]


def _cell_text(cell, strings: _SharedStrings) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _plain_text(cell)
    values = _parts(cell, "v")
    if not values or values[0].text is None:
        return None
    text = values[0].text
    if kind == "s":
        return strings[int(text)]
    if kind == "b":
        return "True" if text == "1" else "False"
    return text


def _sheet_rows(book: zipfile.ZipFile, part_name: str, strings: _SharedStrings) -> Iterator[dict[int, str | None]]:
    with book.open(part_name) as part:
        for _, element in ElementTree.iterparse(part):
            if _local(element.tag) == "row":
                row, at = {}, 0
                for cell in _parts(element, "c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else at
                    row[at] = _cell_text(cell, strings)
                    at += 1
                yield row
                element.clear()


def _header_names(row: dict[int, str | None]) -> dict[int, str]:
    """Names by place; an empty one becomes ``_c`` and its place, a repeated one gets its place behind it."""
    names = {i: (name or "").strip() for i, name in row.items()}
    often = Counter(n.lower() for n in names.values())
    return {i: f"_c{i}" if not n else n if often[n.lower()] == 1 else f"{n}{i}" for i, n in names.items()}


def wanted_sheets(sheet: str) -> list[str] | None:
    """'' takes the first sheet of every file (no names), 'A,B' the named ones, '*' all (None)."""
    return None if sheet.strip() == "*" else [n.strip() for n in sheet.split(",") if n.strip()]


def _chosen_sheets(book: zipfile.ZipFile, wanted: list[str] | None, strings: _SharedStrings) -> Iterator[tuple]:
    """Number, name, header and rows of the chosen sheets; one without a header is no sheet."""
    for number, (name, part) in enumerate(_sheet_parts(book)):
        if wanted and name not in wanted:
            continue
        rows = _sheet_rows(book, part, strings)
        header = _header_names(next(rows, {}))
        if header:
            yield number, name, header, rows
            if wanted == []:
                return


def _read_rows(header_only: bool, wanted: list[str] | None):
    """Function for mapInPandas over (path, content)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [SOURCE, SHEET, SHEET_NO, ROW, "cells"]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    for number, name, header, rows in _chosen_sheets(book, wanted, _SharedStrings(book)):
                        if header_only:
                            cells = {n: None for n in header.values()}
                            yield pd.DataFrame([(path, name, number, -1, cells)], columns=columns)
                            continue
                        found = ((path, name, number, i, {n: row.get(at) for at, n in header.items()}) for i, row in enumerate(rows))
                        while batch := list(islice(found, BATCH_ROWS)):
                            yield pd.DataFrame(batch, columns=columns)

    return read


def workbook_rows(files: DataFrame, sheet: str = "") -> DataFrame:
    """(path, content) of workbooks to one table of text columns with provenance; naming only absent sheets is an error.

    Columns come in the order of their first appearance in the sheets.
    """
    files, wanted = files.select("path", "content"), wanted_sheets(sheet)
    headers = files.mapInPandas(_read_rows(True, wanted), ROWS_SCHEMA)
    names = headers.select(SHEET_NO, F.posexplode(F.map_keys("cells")).alias("at", "name"))
    found = names.groupBy("name").agg(F.min(F.struct(SHEET_NO, "at")).alias("first")).orderBy("first", "name").collect()
    if wanted and not found:
        raise ValueError(f"none of the sheets {wanted} exists")
    cells = [F.try_element_at("cells", F.lit(r["name"])).alias(r["name"]) for r in found]
    return files.mapInPandas(_read_rows(False, wanted), ROWS_SCHEMA).select(*cells, SOURCE, SHEET, ROW)


def read_workbooks(spark: SparkSession, paths: Sequence[str], sheet: str = "") -> DataFrame:
    files = spark.read.format("binaryFile").load(list(paths))
    return workbook_rows(files, sheet)
