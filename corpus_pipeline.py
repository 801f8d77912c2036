"""From raw documents to a training mix, in five stages.

Each stage takes what its predecessor kept, as a table read again from Parquet. The first four return the columns of
``documents``; the last returns how often each document is taken. Rows, columns and texts that a stage doesn't judge
pass unchanged; the handling of nulls, empty texts and repeated rows is that of the operator a stage calls.

The quality list is learned and the mix is drawn, so SQL can't express the rows of ``run``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import decontaminate, line_dedup, minhash, mixing, quality
from ruleloom.llm.common import read_table
from ruleloom.session import staged


NEAR = 80  # hundredths of shingles that near copies share at least


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list accept."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that an earlier line equals or nearly equals, by a word in 20; ``n_chars`` follows the text.

    Documents that lose every word are copies as a whole, and go.
    """
    cleaned = line_dedup.cleaned(docs, grown=True, emptied=False)
    return cleaned.select(
        *((F.char_length("text").cast(t).alias(c) if c == "n_chars" else F.col(c)) for c, t in cleaned.dtypes)
    )


def keep_first_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicated(docs, similar=NEAR)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items."""
    return decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, so that the sources meet their targets."""
    found = mixing.mixed(docs)
    return found.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("MinHash near-dedup", keep_first_of_near),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
