"""Files made from table rows that Spark itself does not write, to have something the sources can read."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = "http://schemas.openxmlformats.org"  # fixed value: name space of the workbook format


def workbook_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook: text cells inline, numbers as numbers, None as no cell."""
    main = f'xmlns="{PARTS}/spreadsheetml/2006/main" xmlns:r="{PARTS}/officeDocument/2006/relationships"'

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        names = enumerate(sheets, start=1)
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in names)
        book.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{listed}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        relations = f'<Relationships xmlns="{PARTS}/package/2006/relationships">{links}</Relationships>'
        book.writestr("xl/_rels/workbook.xml.rels", relations)
        for i, rows in enumerate(sheets.values(), start=1):
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return buffer.getvalue()


def workbooks_of(header: list[str], sheet_column: str):
    """Function for applyInPandas: one chunk of rows to one workbook (path, content), a sheet per value."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sheets = {
            str(name): [header, *part[header].astype(object).values.tolist()]
            for name, part in rows.groupby(sheet_column, sort=True)
        }
        return pd.DataFrame({"path": [f"book-{key[0]}.xlsx"], "content": [workbook_bytes(sheets)]})

    return build


def in_gbk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Function for mapInPandas: (name, text) to (name, content) in an encoding Spark does not write."""
    for frame in frames:
        name = frame.columns[0]
        yield pd.DataFrame({name: frame[name], "content": [t.encode("gbk") for t in frame["text"]]})
