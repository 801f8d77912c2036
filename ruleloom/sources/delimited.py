"""CSV files as records, read by many tasks also where fields hold line breaks.

A line of a file begins a record if the number of quotes before it is even. So each split of a file reports whether its
own number is odd, a prefix sum over the splits of a file tells in which state each begins, and every task then knows its
first record. Splits that begin inside a field are rare; their first lines belong to the record before, and only these
lines are gathered and sent to the task that holds its beginning. Records are parsed by Spark.

Where Spark splits files depends on the files of a scan, on settings and on the cores there are, so one scan must not be
held against another: where fields hold line breaks, the lines are read once more and checkpointed, split by split, many
to a row, and all steps read these.

Lines end with a line feed, with or without a carriage return before it. Inside quotes nothing is changed: carriage
returns, line feeds and blanks come back as they are. A field that is nothing is null, two quotes are the empty text.
A header has to end within the first split of its file.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleloom.schema import ROW, SHEET, SOURCE
from ruleloom.session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

WRITTEN = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
NOTHING = "\x00nothing\x00"  # stands for a field without characters while a record is parsed; two quotes are not null then
PARSED = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "lineSep": "\n", "nullValue": NOTHING}
PACK = 1 << 13  # bytes of lines that are kept as one row
ASCII_BASED = ("UTF-8", "UTF8", "US-ASCII", "ISO-8859-1")  # quotes and line feeds are bytes of their own, and Spark decodes a line


def file_lines(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """``file, start, line``: the lines of files with the place of the split that each comes from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), line.alias("line"))


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``file, start, lines``: neighbouring lines of a split in one text of about ``PACK`` bytes, or a longer line alone."""
    lines = batch.column("line")
    files = pc.dictionary_encode(batch.column("file"))
    file, start = files.indices.to_numpy(), batch.column("start").to_numpy()
    size = np.cumsum(pc.binary_length(lines).to_numpy().astype(np.int64) + 1) // PACK
    edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])) + 1
    edges = np.concatenate([[0], edges, [len(lines)]]) if len(lines) else np.zeros(1, np.int64)
    packed = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), lines), "\n")
    first = pa.array(edges[:-1], pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("file").take(first), batch.column("start").take(first), packed], names=["file", "start", "lines"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from map(_pack, batches)


def _kept_lines(lines: DataFrame) -> DataFrame:
    """The lines, packed and checkpointed; a split stays in one partition, in order."""
    spark = lines.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return lines.mapInArrow(_packed, "file string, start long, lines string").checkpoint()


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array, np.ndarray]]:
    """The stretches of a packed batch that come from one split, with the number of quotes of each line."""
    files = pc.dictionary_encode(batch.column("file"))
    file, start = files.indices.to_numpy(), batch.column("start").to_numpy()
    lines = pc.split_pattern(batch.column("lines"), "\n")
    edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if low < high:
            own = lines.slice(low, high - low).flatten()
            quotes = pc.count_substring(own, '"').to_numpy().astype(np.int64)
            yield files.dictionary[int(file[low])].as_py(), int(start[low]), own, quotes


class _Split:
    """The records of a split, line by line; ``open_`` is a record whose last line has not come yet."""

    def __init__(self, inside: bool):
        self.skipping, self.open_, self.first = inside, [], True
        self.head: list[str] = []  # lines that belong to the record of an earlier split

    def records(self, lines: pa.Array, quotes: np.ndarray) -> list[str] | pa.Array:
        if not self.skipping and not self.open_ and not (quotes & 1).any():
            return lines
        out = []
        for line, many in zip(lines.to_pylist(), quotes.tolist()):
            if self.skipping:
                self.head.append(line)
                self.skipping = many % 2 == 0
                continue
            inside = bool(self.open_)
            if inside:
                self.open_.append(line)
            if (many % 2 == 1) == inside:  # no record is open behind this line
                out.append("\n".join(self.open_) if inside else line)
                self.open_ = []
            elif not inside:
                self.open_ = [line]
        return out


def _splits(batches: Iterator[pa.RecordBatch], inside: set) -> Iterator[tuple[str, int, _Split, list[str] | pa.Array | None]]:
    """Records as they come; None at the end of a split."""
    now, split = None, None
    for batch in batches:
        for file, start, lines, quotes in _runs(batch):
            if (file, start) != now:
                if split is not None:
                    yield *now, split, None
                now, split = (file, start), _Split((file, start) in inside)
            yield file, start, split, split.records(lines, quotes)
    if split is not None:
        yield *now, split, None


def _heads(inside: set):
    """The first lines of the splits that begin inside a field, and whether a record begins in the split at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, split, records in _splits(batches, inside):
            if records is None and (file, start) in inside:
                rows = [[file], [start], ["\n".join(split.head)], [not split.skipping]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["file", "start", "head", "ends"])

    return run


def _first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for file, start, split, records in _splits(map(_pack, batches), set()):
        text = "\n".join(split.open_) if records is None else records[0] if len(records) else None
        if file not in seen and start == 0 and text is not None:
            seen.add(file)
            text = text if isinstance(text, str) else text.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([text])], names=["file", "header"])


def column_names(header: str) -> list[str]:
    """The names that a header gives, as Spark makes them: nothing becomes ``_c`` and its place, a repeated one gets its place."""
    names = next(csv.reader([header.removeprefix("﻿").removesuffix("\r")], strict=False), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def headers(spark: SparkSession, paths, encoding: str = "UTF-8") -> list[tuple[str, list[str]]]:
    """The files below some paths and the columns of each, in one job."""
    first = file_lines(spark, paths, encoding).filter("start = 0").mapInArrow(_first_records, "file string, header string")
    return sorted((r["file"], column_names(r["header"])) for r in first.collect())  # a row per file


def _continued(lines: DataFrame) -> tuple[set, dict]:
    """The splits that begin inside a field, and what the last record of a split is continued by."""
    odd = (F.sum(F.char_length("lines") - F.char_length(F.replace("lines", F.lit('"')))) % 2).alias("odd")
    own = lines.groupBy("file", "start").agg(odd)
    before = Window.partitionBy("file").orderBy("start")  # a row per split of a file
    state = F.coalesce(F.sum("odd").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    split = own.select("file", "start", state.alias("state"), F.lag("start").over(before).alias("previous")).filter("state = 1").collect()
    if not split:
        return set(), {}
    inside = {(r["file"], r["start"]) for r in split}
    some = lines.filter(F.col("file").isin(sorted({f for f, _ in inside})))
    found = {(r["file"], r["start"]): r for r in some.mapInArrow(_heads(inside), "file string, start long, head string, ends boolean").collect()}
    tails: dict = {}
    previous = {(r["file"], r["start"]): (r["file"], r["previous"]) for r in split}
    for place in sorted(inside):
        owner = previous[place]
        while owner in inside and not found[owner]["ends"]:
            owner = previous[owner]
        tails.setdefault(owner, []).append(found[place]["head"])
    return inside, {owner: "\n".join(heads) for owner, heads in tails.items()}


def _whole_records(inside: set, tails: dict, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for file, start, split, records in _splits(batches, inside):
            if records is None:
                records = ["\n".join([*split.open_, tails[file, start]] if (file, start) in tails else split.open_)] if split.open_ else []
            if not len(records):
                continue
            number = 0 if split.first else number
            rows = records if isinstance(records, pa.Array) else pa.array(records, pa.string())
            places = np.arange(number, number + len(rows)) + start
            number += len(rows)
            if split.first and start == 0:
                if column_names(rows[0].as_py()) != columns:
                    raise ValueError(f"the header of {file} does not conform to the columns {columns}")
                rows, places = rows.slice(1), places[1:]
            split.first = False
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(places, pa.int64()), rows], names=["file", "place", "record"])

    return run


def _plain_records(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _whole_records(set(), {}, columns)(map(_pack, batches))

    return run


def _folder_value(file: Column, name: str) -> Column:
    """What a folder says about a column, as in ``name=value``."""
    found = F.regexp_extract(F.regexp_extract(file, f"/{re.escape(name)}=[^/]*/", 0), "=(.*)/", 1)
    shown = F.coalesce(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), found)
    shown = F.coalesce(F.try_url_decode(F.replace(shown, F.lit("+"), F.lit("%2B"))), shown)  # once for the folder, once for the path
    return F.when(shown != "__HIVE_DEFAULT_PARTITION__", shown)


def read_records(spark: SparkSession, path, columns: list[str], encoding: str = "UTF-8", provenance: bool = True) -> DataFrame:
    """The rows of files with those columns as text, then columns that folders name, then, if asked for, the source, an
    empty sheet name, and a number that grows within a file."""
    lines = file_lines(spark, path, encoding)
    record = "file string, place long, record string"
    if lines.filter((F.char_length("line") - F.char_length(F.replace("line", F.lit('"')))) % 2 == 1).isEmpty():
        records = lines.mapInArrow(_plain_records(columns), record)  # each line is a record, however files are split
    else:
        lines = _kept_lines(lines)
        inside, tails = _continued(lines)
        records = lines.mapInArrow(_whole_records(inside, tails, columns), record)
    text = F.regexp_replace("record", "\r$", "")
    records = records.select("file", "place", F.when(F.col("record").endswith("\r"), text).otherwise(F.col("record")).alias("record")).filter("record != ''")
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = records.select("file", "place", F.from_csv("record", schema, PARSED).alias("r"))
    own = [F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)]
    own += [_folder_value(F.col("file"), c).alias(c) for c in spark.read.text(path).columns if c != "value"]
    if not provenance:
        return parsed.select(*own)
    source = F.coalesce(F.try_url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), F.col("file"))
    return parsed.select(*own, source.alias(SOURCE), F.lit("").alias(SHEET), F.col("place").alias(ROW))
