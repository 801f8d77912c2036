"""Row positions and per-source limits that hold when one source has most of the rows.

A plain ``row_number`` over a source, or over the table, puts it into one task. Here the rows are dealt into ranges of
their order; the sizes of the ranges, a row for each, are added up in order, and the rows are numbered in their range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.schema import quoted
from ruleloom.session import staged

BLOCK_ROWS = 1 << 17
SALTS = 64
WINDOW_LIMIT = 1000  # up to here Spark itself cuts each task's rows before the shuffle; beyond, rows are numbered
POSITION = "_position"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(quoted(n)) for n in names]


def with_position(df: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Add ``_position``, 1-based in read order within ``group``; null comes first."""
    sort = _cols([*group, *order])
    # Written once, since the ranges are drawn from a sample and have to stay as they are.
    rows = staged(df.repartitionByRange(*sort).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__rows"))
    # A row per range: as many as there are tasks, however many rows the table has.
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*sort)).cast("long")
    ranked = rows.withColumn("__rank", rank).join(F.broadcast(offsets), "__range")
    place = F.col("__before") + F.col("__rank")
    if not group:
        return ranked.select(*_cols(df.columns), place.alias(POSITION))
    ranked = ranked.withColumns({"__place": place, "__g": F.struct(*_cols(group))})
    starts = ranked.groupBy("__g").agg((F.min("__place") - 1).alias("__start"))
    return ranked.join(starts, "__g").select(*_cols(df.columns), (F.col("__place") - F.col("__start")).alias(POSITION))


def _first_rows(df: DataFrame, n: int, group: Sequence[str], index: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*_cols(group)).orderBy(F.col(quoted(index))))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def limit_per_source(df: DataFrame, n: int, group: Sequence[str], index: str) -> DataFrame:
    """The first ``n`` rows of every source; a null index comes first."""
    if n > WINDOW_LIMIT:
        return with_position(df, [index], group).filter(F.col(POSITION) <= n).select(*_cols(df.columns))
    # Each task sends at most n rows of a source; the salt keeps those of a large source from meeting in one task.
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(quoted(index)), F.lit(SALTS)))
    part = _first_rows(salted, n, [*group, "__salt"], index)
    return _first_rows(part, n, group, index).select(*_cols(df.columns))


def in_read_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """A total sort, range-partitioned; the row number in the key spreads large sources."""
    return df.orderBy(*_cols(order))
