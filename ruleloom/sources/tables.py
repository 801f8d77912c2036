"""Table sources: CSV (and Spark's own formats) as text columns with provenance."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.dedup import union_by_name
from ruleloom.schema import ROW, SHEET, SOURCE, quoted
from ruleloom.session import data_files, full_paths
from ruleloom.sources.delimited import ASCII_BASED, headers, read_records

log = logging.getLogger(__name__)


# Endings of files and folders, and the format each stands for.
ENDINGS = {".csv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc", ".xlsx": "xlsx"}


def present_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist, in the order given, complete and with patterns filled in; the others are reported.

    A file that a pattern finds is a source of its own, a folder is one source.
    """
    found: list[str] = []
    for p in paths:
        here = full_paths(spark, p)
        if not here:
            log.warning("no such path, skipped: %s", p)
        found += [h for h in here if h not in found]
    return found


def format_of(spark: SparkSession, path: str) -> str:
    """The format by the ending of a path, or of the data files in a folder without one; unknown ones are an error."""
    ending = os.path.splitext(path.rstrip("/"))[1].lower()
    if ending in ENDINGS:
        return ENDINGS[ending]
    inside = {ENDINGS.get(os.path.splitext(f)[1].lower()) for f in data_files(spark, path)}
    if len(inside) == 1 and None not in inside:
        return inside.pop()
    raise ValueError(f"the format of {path!r} is not known by its ending; name it")


def file_path() -> Column:
    """The path of the file a row comes from; Spark gives it with blanks and the like escaped."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def with_provenance(df: DataFrame) -> DataFrame:
    """Source path, empty sheet name and a row number that grows in read order within each file."""
    return df.select(
        *(F.col(quoted(c)) for c in df.columns),
        file_path().alias(SOURCE),
        F.lit("").alias(SHEET),
        F.monotonically_increasing_id().alias(ROW),
    )


def read_csv(spark: SparkSession, path, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """CSV (file, folder, glob, or a list with one header) as text, nothing inferred.

    Fields may hold line breaks, and come back as they were written; large files are split all the same. Where no field
    holds a line break, ``multi_line=False`` lets Spark read the records by itself. An encoding that is not based on
    ASCII takes one task per file.
    """
    if multi_line and encoding.upper() in ASCII_BASED:
        listed = headers(spark, path, encoding)
        if listed:
            return read_records(spark, path, listed[0][1], encoding)  # a file of the folder with other columns is an error
    settings = dict(header=True, quote='"', escape='"', encoding=encoding, multiLine=multi_line)
    return with_provenance(spark.read.csv(path, enforceSchema=False, **settings))


def as_text(df: DataFrame) -> DataFrame:
    """All columns but the provenance as text."""
    data = [F.col(quoted(c)).cast("string").alias(c) for c in df.columns if c not in (SOURCE, SHEET, ROW)]
    return df.select(*data, SOURCE, SHEET, ROW)


def read_table(
    spark: SparkSession, path, sheet: str = "*", format: str | None = None, encoding: str = "UTF-8", multi_line: bool = True
) -> DataFrame:
    """One table, or a list of paths of one format and header."""
    paths = [path] if isinstance(path, str) else list(path)
    kind = format or format_of(spark, paths[0])
    if kind == "xlsx":
        from ruleloom.sources.workbook import read_workbooks

        return read_workbooks(spark, paths, sheet)
    if kind == "parquet":
        order = F.col("_metadata.row_index")  # the row number of the file itself
        return spark.read.parquet(*paths).select("*", file_path().alias(SOURCE), F.lit("").alias(SHEET), order.alias(ROW))
    if kind == "json":
        return with_provenance(spark.read.json(paths, primitivesAsString=True))
    if kind == "orc":
        return with_provenance(spark.read.orc(paths))
    if kind == "csv":
        return read_csv(spark, paths, encoding, multi_line)
    raise ValueError(f"format {kind!r} is not read")


PLACE = r"^[A-Za-z0-9]+:(?://[^/]*)?"  # the scheme and host of a path


def place_of(path: str) -> str:
    """A path without scheme, host and escapes."""
    return re.sub(PLACE, "", unquote(path)).rstrip("/")


def _csv_columns(spark: SparkSession, paths: list[str], encoding: str) -> dict[str, list[str]]:
    """The columns of each path; one job reads the headers of all files."""
    named, columns = {place_of(p): p for p in paths}, {}
    for file, found in headers(spark, paths, encoding):
        above = place_of(file)
        while above and above not in named:
            above = above.rpartition("/")[0]
        columns.setdefault(named.get(above), found)
    return columns


def read_tables(
    spark: SparkSession, paths: Sequence[str], sheet: str = "", format: str | None = None, encoding: str = "UTF-8", multi_line: bool = True
) -> DataFrame:
    """All present tables in one, columns by name; there is a scan for each format and header, not for each path.

    Typed columns stay typed, so that number rules reach their scan, unless the tables disagree on a type.
    """
    found = present_paths(spark, paths)
    if not found:
        raise FileNotFoundError("none of the paths exists")
    kinds = {p: format or format_of(spark, p) for p in found}
    texts = [p for p, kind in kinds.items() if kind == "csv"]
    ascii_based = encoding.upper() in ASCII_BASED
    columns = _csv_columns(spark, texts, encoding) if texts and ascii_based else {}
    alike: dict[tuple, list[str]] = {}
    for p, kind in kinds.items():
        alike.setdefault((kind, _schema_key(spark, p, kind, encoding, columns)), []).append(p)
    parts = []
    for (kind, key), ps in alike.items():
        split = kind == "csv" and multi_line and ascii_based and key
        parts.append(read_records(spark, ps, list(key), encoding) if split else read_table(spark, ps, sheet, kind, encoding, multi_line))
    types: dict[str, set[str]] = {}
    for name, dtype in (t for p in parts for t in p.dtypes):
        types.setdefault(name, set()).add(dtype)
    if any(len(dtypes) > 1 for dtypes in types.values()):
        parts = [as_text(p) for p in parts]
    return union_by_name(parts)


def _schema_key(spark: SparkSession, path: str, kind: str, encoding: str, columns: dict[str, list[str]]) -> tuple:
    """What paths must share to be read by one scan."""
    if kind == "csv":
        if encoding.upper() in ASCII_BASED:
            return tuple(columns.get(path, ()))
        return tuple(spark.read.csv(path, header=True, quote='"', escape='"', encoding=encoding).columns)
    if kind in ("parquet", "orc"):
        return tuple(spark.read.format(kind).load(path).dtypes)
    return (path,) if kind == "json" else ()


def select_sheets(df: DataFrame, sheet: str, ordinal: str = "_sheet_no") -> DataFrame:
    """'' takes the first sheet of every file, 'A,B' the named ones, '*' all; naming only absent ones is an error."""
    wanted = sheet.strip()
    if wanted == "*":
        return df
    if wanted == "":
        firsts = df.groupBy(SOURCE).agg(F.min(ordinal).alias("__first"))
        same = df[SOURCE].eqNullSafe(firsts[SOURCE]) & (F.col(ordinal) == F.col("__first"))
        return df.join(firsts, same, "left_semi")
    names = [n.strip() for n in wanted.split(",") if n.strip()]
    chosen = df.filter(F.col(SHEET).isin(*names))
    if chosen.isEmpty():
        raise ValueError(f"none of the sheets {names} exists")
    return chosen


def source_name() -> Column:
    """The base name of a source path without folder and ending."""
    return F.regexp_extract(F.col(SOURCE), r"([^/]*?)(?:\.[^./]*)?$", 1)
