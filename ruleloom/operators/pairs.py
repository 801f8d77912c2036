"""Bilingual sentence pairs: pairing of lines, filters, sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.operators.ordering import BLOCK_ROWS
from ruleloom.schema import quoted

NUMBERING = r"^[0-9]+[.)、]?$"  # fixed value: a line that holds nothing but a list number


def pair_lines(
    lines: DataFrame,
    group: Sequence[str],
    index: str,
    line: str = "line",
    is_zh: Column | None = None,
    skip_numbering: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Join consecutive Chinese lines and pair them with the next other line: group, pair_idx, zh, en.

    A Chinese line belongs to the nearest other line after it. Files are looked at in blocks of row numbers, and a
    block that has no such line asks the blocks after it, so no file is ever in one task as a whole. The Chinese lines
    of one pair do meet in one task, since they become one text. Chinese lines
    at the end of a file and other lines without Chinese before them give no pair. ``pair_idx`` is the row number
    of the pair's second line.
    """
    by = [F.col(quoted(g)) for g in group]
    text = X.strip(X.blank_null(F.col(quoted(line))))
    rows = lines.select(
        F.struct(*by).alias("__g"),
        F.col(quoted(index)).cast("long").alias("__i"),
        text.alias("__text"),
        (X.has_chinese(text) if is_zh is None else is_zh).alias("__zh"),
    ).filter(F.col("__text") != "")
    if skip_numbering:
        rows = rows.filter(~F.col("__text").rlike(NUMBERING))
    rows = rows.withColumn("__block", F.expr(f"__i div {block_rows}"))

    other = F.when(~F.col("__zh"), F.col("__i"))
    in_block = Window.partitionBy("__g", "__block")
    ahead = in_block.orderBy("__i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.partitionBy("__g").orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy("__g", "__block").agg(F.min(other).alias("__first"))
    firsts = firsts.select("__g", "__block", F.min("__first").over(later).alias("__later"))

    paired = rows.withColumn("__near", F.min(other).over(ahead)).join(firsts, ["__g", "__block"])
    paired = paired.withColumn("pair_idx", F.coalesce("__near", "__later"))
    zh_part = F.when(F.col("__zh"), F.struct("__i", "__text"))
    en_text = F.when(~F.col("__zh"), F.col("__text"))
    return (
        paired.filter(F.col("pair_idx").isNotNull())
        .groupBy("__g", "pair_idx")
        .agg(F.sort_array(F.collect_list(zh_part)).alias("__parts"), F.max(en_text).alias("en"))
        .filter(F.size("__parts") > 0)
        .select("__g.*", "pair_idx", F.array_join(F.col("__parts")["__text"], "").alias("zh"), "en")
    )


def complete_pairs(df: DataFrame) -> DataFrame:
    """Pairs whose two sides are non-empty texts."""
    return df.filter((F.col("zh") != "") & (F.col("en") != ""))


def dataset_named(df: DataFrame, name: str) -> DataFrame:
    """One data set by name; an unknown name gives no rows."""
    return df.filter(F.col("dataset") == name)


def sample_pairs(df: DataFrame, k: int = 3, seed: int | None = None) -> DataFrame:
    """k random rows: those with the least hashes of seed and texts, so that the same seed draws the same rows.

    Every task keeps its k smallest draws, so k rows per task are all that moves. Without a seed each run differs.
    """
    seed = random.getrandbits(32) if seed is None else seed
    texts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in df.columns]
    draw = F.md5(F.concat_ws("\n", F.lit(str(seed)), *texts))
    return df.withColumn("__draw", draw).orderBy("__draw").limit(k).drop("__draw")
