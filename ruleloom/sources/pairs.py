"""Bilingual pair sources and sinks: JSON and Markdown files, data sets by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import text as X
from ruleloom.operators.pairs import complete_pairs, pair_lines
from ruleloom.schema import ROW, SOURCE
from ruleloom.session import path_exists
from ruleloom.sources.lines import read_lines


def _side(item: Column, name: str) -> Column:
    """A side of a pair if it is a text; numbers, lists and the like are none."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string")).alias(name)


def read_pairs_json(spark: SparkSession, path: str, array_file: bool = True) -> DataFrame:
    """Pairs from JSON: whole files that hold one array, or (``array_file=False``) one object per line."""
    raw = spark.read.text(path, wholetext=array_file)
    item = F.explode(F.from_json("value", "array<variant>")) if array_file else F.try_parse_json("value")
    items = raw.select(item.alias("item"))
    return complete_pairs(items.select(_side(F.col("item"), "zh"), _side(F.col("item"), "en")))


def read_pairs_markdown(spark: SparkSession, path: str, skip_numbering: bool = False) -> DataFrame:
    return pair_lines(read_lines(spark, path), [SOURCE], ROW, skip_numbering=skip_numbering)


def read_datasets(spark: SparkSession, root: str) -> DataFrame:
    """All data sets below a folder, with their name in ``dataset``; sides that are no text are null."""
    items = spark.read.schema("value string, dataset string").text(root).select(F.try_parse_json("value").alias("item"), "dataset")
    return items.select(_side(F.col("item"), "zh"), _side(F.col("item"), "en"), "dataset")


def dataset_names(spark: SparkSession, root: str) -> list[str]:
    """The names of the data sets, from the folder listing alone."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith("dataset="))


def write_pairs_json(df: DataFrame, path: str) -> None:
    df.select("zh", "en").write.json(path)


def write_pairs_markdown(df: DataFrame, path: str) -> None:
    """Chinese line, English line, empty line per pair; pairs with an empty side are left out."""
    sides = df.select(X.strip(X.blank_null("zh")).alias("zh"), X.strip(X.blank_null("en")).alias("en"))
    complete_pairs(sides).select(F.concat_ws("\n", "zh", "en", F.lit(""))).write.text(path)


def write_datasets(df: DataFrame, root: str) -> None:
    """One folder per data set."""
    df.select("dataset", "zh", "en").write.partitionBy("dataset").json(root)


def import_pairs(df: DataFrame, root: str, name: str) -> str:
    """Store pairs under the first free name of user_x, user_x_1, ... and return it."""
    spark = df.sparkSession
    base, n = f"user_{name}", 0
    free = base
    while path_exists(spark, f"{root}/dataset={free}"):
        n += 1
        free = f"{base}_{n}"
    df.select("zh", "en").write.json(f"{root}/dataset={free}")
    return free
