"""The two batch jobs: screen files by rules, and match a column of files against a requirement list."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.dedup import dedup_keys, keep_first
from ruleloom.operators.match import best_match, parse_requirements
from ruleloom.operators.ordering import limit_per_source
from ruleloom.operators.rules import as_rule_set
from ruleloom.operators.screen import screen, source_totals
from ruleloom.schema import ROW, SHEET, SOURCE
from ruleloom.session import staged
from ruleloom.sources.lines import read_mixed_lines
from ruleloom.sources.sinks import (
    NUMBER,
    OUTPUT,
    append_result,
    next_version,
    read_by_source,
    unknown_keys,
    with_output_name,
    write_by_source,
    write_result,
    write_table,
)
from ruleloom.sources.tables import present_paths, read_tables

log = logging.getLogger(__name__)
ORDER = [NUMBER, SOURCE, SHEET, ROW]  # as the sources were given


def _read(spark: SparkSession, paths: Sequence[str], sheet: str, limit: int | None, reading: dict) -> DataFrame:
    rows = with_output_name(read_tables(spark, paths, sheet, **reading), paths)
    return rows if limit is None else limit_per_source(rows, limit, [SOURCE, SHEET], ROW)


def _write(hits: DataFrame, out: str, key, column, merge_only, append, deduplicate, format) -> None:
    order = [F.col(c) for c in ORDER]
    if not merge_only:
        part = hits
        if deduplicate:
            part = keep_first(hits, [F.col(OUTPUT), *dedup_keys(hits, key, column)], order)
        old = read_by_source(hits.sparkSession, f"{out}/by_source", format) if append else None
        if old is not None and deduplicate:
            # Only rows with keys that their source has not been written with; nothing older is rewritten.
            keys = lambda d: [k.cast("string") for k in (F.col(OUTPUT), *dedup_keys(d, key, column))]
            part = unknown_keys(staged(part, "part"), old, keys)
        write_by_source(part.drop(NUMBER), f"{out}/by_source", format, append)
    merged = f"{out}/merged"
    write = append_result if append else write_result
    write(hits.drop(OUTPUT), merged, ORDER, key, column, deduplicate, format)


def _counted(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias(name))


def screen_files(
    spark: SparkSession,
    paths: Sequence[str],
    rules,
    out: str,
    sheet: str = "",
    limit: int | None = None,
    key: str | None = "PersonID",
    column: str | None = "Major",
    merge_only: bool = False,
    append: bool = False,
    deduplicate: bool = True,
    format: str = "parquet",
    reading: dict | None = None,
    **settings,
) -> DataFrame:
    """Screen all files, write the hits per source and merged, and return the rows and hits per source.

    ``reading`` are settings of ``read_tables``: format, encoding, multi_line. The diagnostics of the rules are
    written beside the result, with one row per finding.
    """
    found = present_paths(spark, paths)
    rows = _read(spark, found, sheet, limit, reading or {})
    if deduplicate:
        dedup_keys(rows, key, column)  # before any work, if there is nothing to deduplicate by
    rule_set = as_rule_set(spark, rules)
    findings = rule_set.diagnostics(spark, rows.columns)
    for f in findings.collect():  # at most a few per rule
        log.warning("rule %s on %s: %s", f["rule_id"], f["column"], f["problem"])
    write_table(findings, next_version(spark, f"{out}/diagnostics"))
    hits = staged(screen(rows, rule_set, hits_only=True, **settings), "hits")
    _write(hits, out, key, column, merge_only, append, deduplicate, format)
    return source_totals(_counted(rows, OUTPUT, "rows"), _counted(hits, OUTPUT, "hits"), OUTPUT)


def match_files(
    spark: SparkSession,
    paths: Sequence[str],
    requirements: str,
    out: str,
    column: str = "Major",
    threshold: float = 0.8,
    sheet: str = "",
    limit: int | None = None,
    key: str | None = None,
    merge_only: bool = False,
    append: bool = False,
    deduplicate: bool = True,
    format: str = "parquet",
    reading: dict | None = None,
) -> DataFrame:
    """Keep the rows whose column matches a requirement, with the matched name, code and score; counts as above."""
    found = present_paths(spark, paths)
    reqs = parse_requirements(read_mixed_lines(spark, [requirements]))
    rows = _read(spark, found, sheet, limit, reading or {})
    if deduplicate:
        dedup_keys(rows, key, column)
    hits = staged(best_match(rows, column, reqs, threshold).filter("_match"), "matched")
    _write(hits, out, key, column, merge_only, append, deduplicate, format)
    return source_totals(_counted(rows, OUTPUT, "rows"), _counted(hits, OUTPUT, "hits"), OUTPUT)
