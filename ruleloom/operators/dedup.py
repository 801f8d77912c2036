"""Keep-first deduplication, unions and append.

``row_number() = 1`` over the key is cut to one row per key and task before the shuffle (Spark's window group
limit), so a key that holds a third of all rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.schema import quoted

MATCHED_CODE = "_matched_code"


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in the given order; null is a key like any other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def dedup_keys(df: DataFrame, key: str | None, column: str | None) -> list[Column]:
    """The key column where the table has it, else the normalised column with the matched code."""
    if key and key in df.columns:
        return [F.col(quoted(key))]
    if not column or column not in df.columns:
        raise ValueError(f"no column to deduplicate by: neither key {key!r} nor column {column!r} exists")
    code = X.blank_null(F.col(MATCHED_CODE)) if MATCHED_CODE in df.columns else F.lit("")
    return [X.normalize_strict(X.blank_null(F.col(quoted(column)).cast("string"))), code]


def dedup(df: DataFrame, order_by: Sequence[str], key: str | None = None, column: str | None = None) -> DataFrame:
    return keep_first(df, dedup_keys(df, key, column), [F.col(quoted(c)) for c in order_by])


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, columns by name, gaps null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def append(
    old: DataFrame,
    new: DataFrame,
    order_by: Sequence[str],
    key: str | None = None,
    column: str | None = None,
) -> DataFrame:
    """Old and new rows, deduplicated over both; old rows win."""
    both = union_by_name([old.withColumn("__new", F.lit(0)), new.withColumn("__new", F.lit(1))])
    order = [F.col("__new"), *(F.col(quoted(c)) for c in order_by)]
    return keep_first(both, dedup_keys(both, key, column), order).drop("__new")
