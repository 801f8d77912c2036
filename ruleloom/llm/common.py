"""What the operators of this subpackage share: words, row keys, and sampling of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The separators of the two kinds of words.
SPACES = r"[\x20\x09-\x0D]+"
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A plain word where the letters A-Z have not been lowered yet.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def spaced_words(text: Column) -> Column:
    """Words between blanks; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def plain_words(text: Column) -> Column:
    """Lower-cased words of letters and digits; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SIGNS), "")


def text_key(text: Column) -> Column:
    """With the id of a row it names the row: rows that agree in both have the same result."""
    return F.coalesce(F.xxhash64(text), F.lit(0)) + F.coalesce(F.octet_length(text), F.lit(-1))


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def bounded(df: DataFrame, key: Column, bound: int, rows: int) -> DataFrame:
    """About ``bound`` rows, drawn by a hash of their key, and all of them if there are no more."""
    if rows <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / rows))


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns as the struct ``row``, so that no name an operator uses can clash with them."""
    return docs.select(F.struct(*(column(c) for c in docs.columns)).alias("row"), *more)


def unwrapped(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def without(docs: DataFrame, gone: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose id and text key are not among ``gone_id, gone_key``."""
    rows = wrapped(docs, column(doc_id).alias("own_id"), text_key(column(text)).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_key") == F.col("gone_key"))
    return unwrapped(rows.join(gone, same, "left_anti"))


def one_of_each(docs: DataFrame, named: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` for each id and text key among ``gone_id, gone_key``."""
    rows = wrapped(docs, column(doc_id).alias("own_id"), text_key(column(text)).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_key") == F.col("gone_key"))
    return unwrapped(rows.join(named, same, "left_semi").dropDuplicates(["own_id", "own_key"]))
