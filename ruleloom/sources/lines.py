"""Text lines: plain text and Markdown files."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.schema import ROW, SOURCE
from ruleloom.sources.tables import file_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOM = "\ufeff"


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """UTF-8 text, split over tasks: _source_file, _row_idx, line (a byte order mark is dropped)."""
    return spark.read.text(paths).select(
        file_path().alias(SOURCE),
        F.monotonically_increasing_id().alias(ROW),
        F.regexp_replace("value", f"^{BOM}", "").alias("line"),
    )


def _decode_gbk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = []
        for content in frame["content"]:
            try:
                texts.append(content.decode("gbk"))
            except UnicodeDecodeError:
                texts.append(content.decode("utf-8", errors="ignore"))
        yield pd.DataFrame({SOURCE: frame[SOURCE], "text": texts})


def decoded_files(files: DataFrame) -> DataFrame:
    """(_source_file, content) to (_source_file, text): UTF-8 where valid, else GBK, else what UTF-8 can read."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    utf8 = files.filter(valid).select(SOURCE, F.col("content").cast("string").alias("text"))
    other = files.filter(~valid).select(SOURCE, "content").mapInPandas(_decode_gbk, f"{SOURCE} string, text string")
    return utf8.unionByName(other)


def read_mixed_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Small text files of unknown encoding, each file read as a whole: _source_file, _row_idx, line."""
    files = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias(SOURCE), "content")
    return split_lines(decoded_files(files))


def split_lines(texts: DataFrame) -> DataFrame:
    """(_source_file, text) to its lines; a line break at the end opens no further line."""
    body = F.regexp_replace(F.regexp_replace("text", f"^{BOM}", ""), r"\r?\n$", "")
    return texts.select(SOURCE, F.posexplode(F.split(body, r"\r?\n")).alias("__pos", "line")).select(
        SOURCE, F.col("__pos").cast("long").alias(ROW), "line"
    )
