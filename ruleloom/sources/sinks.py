"""Result sinks: per source, merged, appended; rule table export."""

from __future__ import annotations

import json
import logging
import posixpath
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.dedup import MATCHED_CODE, append, dedup, dedup_keys, union_by_name
from ruleloom.schema import RULE_COLUMNS, SOURCE, quoted
from ruleloom.session import data_files, path_exists, staged
from ruleloom.sources.delimited import WRITTEN, headers, read_records
from ruleloom.sources.tables import PLACE, format_of, place_of, source_name

log = logging.getLogger(__name__)
BATCH = "_batch"
OUTPUT, NUMBER = "_source", "_source_no"
BROADCAST_FILES = 100_000  # names of files, a few hundred bytes each
PART, PARTS = "_part", 64  # appended rows lie by the hash of their key, so that a batch reads the parts it has keys of
BROADCAST_BYTES = 32 << 20  # keys of one batch, as text, up to which they are broadcast to the old result
LAYER, MOST_LAYERS = "-", 16  # a layer's folder is its version's name, this and a number
KEYED = "_keyed"  # file beside the rows that notes what they are deduplicated by
FORMATS = ("parquet", "csv", "json", "orc")


def _format(name: str) -> str:
    if name in FORMATS:
        return name
    log.warning("format %s is not written, CSV is", name)
    return "csv"


def output_names(paths: Sequence[str]) -> dict[str, str]:
    """Path to output name: the base name; equal base names of different paths get a number."""
    used, names = Counter(), {}
    for p in paths:
        base = posixpath.splitext(posixpath.basename(p.rstrip("/")))[0]
        used[base] += 1
        names[p] = base if used[base] == 1 else f"{base}_{used[base]}"
    return names


def with_output_name(df: DataFrame, paths: Sequence[str] = ()) -> DataFrame:
    """Add ``_source``, the output name of the path a row comes from (else of its file), and ``_source_no``, its place
    in the list of paths. The names are joined by file; the table of files is that of the scan's own listing."""
    named = {place_of(p): (number, name) for number, (p, name) in enumerate(output_names(paths).items())}
    rows = []
    files = {place_of(f) for f in df.inputFiles()} if named else set()
    # Lines that were checkpointed have lost their scan; its files are listed again.
    lost = [p for p in paths if not any(f == place_of(p) or f.startswith(f"{place_of(p)}/") for f in files)]
    if lost and len(lost) == len([p for p in lost if path_exists(df.sparkSession, p)]):
        files |= {place_of(f) for f in df.sparkSession.read.option("recursiveFileLookup", True).text(lost).inputFiles()}
    for file in files:
        above = file
        while above and above not in named:
            above = above.rpartition("/")[0]
        if above:
            rows.append((file, *named[above]))
    if not rows:
        return df.withColumns({OUTPUT: source_name(), NUMBER: F.lit(0)})
    known = df.sparkSession.createDataFrame(rows, f"__file string, {NUMBER} int, __name string")
    place = F.regexp_replace(F.col(SOURCE), PLACE, "")
    joined = df.join(F.broadcast(known) if len(rows) <= BROADCAST_FILES else known, place == F.col("__file"), "left")
    return joined.select(*(F.col(quoted(c)) for c in df.columns), F.coalesce("__name", source_name()).alias(OUTPUT), NUMBER)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a result; a format Spark does not write becomes CSV."""
    writer = df.write.mode(mode).format(_format(format))
    if _format(format) == "csv":
        writer = writer.options(**WRITTEN)
    writer.save(path)


def write_by_source(df: DataFrame, path: str, format: str = "parquet", append: bool = False) -> None:
    """All sources (by ``_source``) in one job, a folder for each; a large source is written by many tasks."""
    spread = df.hint("rebalance", F.col(OUTPUT))
    writer = spread.write.mode("append" if append else "errorifexists").partitionBy(OUTPUT).format(_format(format))
    if _format(format) == "csv":
        writer = writer.options(**WRITTEN)
    writer.save(path)


def read_by_source(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame | None:
    """What earlier runs have written per source; None if there is nothing."""
    if not data_files(spark, path):
        return None
    if _format(format) == "csv":
        return _read_csv_result(spark, path)
    return spark.read.format(_format(format)).load(path)


def _read_csv_result(spark: SparkSession, path: str) -> DataFrame:
    listed = headers(spark, path)
    if not listed:
        return spark.read.csv(path, header=True)
    return read_records(spark, path, listed[0][1], provenance=False)


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []
    return sorted(n for n in names if n.startswith(prefix))


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Versions and their layers, oldest first; one whose writing broke off has no success mark."""
    return [n for n in _children(spark, path, "v") if path_exists(spark, f"{path}/{n}/_SUCCESS")]


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The newest finished version of a result, without the layers upon it."""
    done = [n for n in _finished(spark, path) if LAYER not in n]
    return f"{path}/{done[-1]}" if done else None


def next_version(spark: SparkSession, path: str) -> str:
    """The path for a new version of a result; no version is ever written over."""
    names = _children(spark, path, "v")
    return f"{path}/v{(int(names[-1][1:].split(LAYER)[0]) if names else 0) + 1:06d}"


def _layers(spark: SparkSession, path: str) -> list[str]:
    """The newest version and the finished layers upon it, in the order they were written; none if there is no version."""
    base = latest_version(spark, path)
    name = posixpath.basename(base) if base else None
    return [f"{path}/{n}" for n in _finished(spark, path) if n == name or n.startswith(f"{name}{LAYER}")] if base else []


def _next_layer(spark: SparkSession, path: str, base: str) -> str:
    taken = _children(spark, path, f"{posixpath.basename(base)}{LAYER}")
    return f"{base}{LAYER}{(int(taken[-1].split(LAYER)[1]) if taken else 0) + 1:06d}"


def read_result(spark: SparkSession, path: str) -> DataFrame:
    layers = _layers(spark, path)
    if not layers:
        raise FileNotFoundError(f"no finished result below {path}")
    return _read_layers(spark, layers)


def _read_layers(spark: SparkSession, layers: Sequence[str]) -> DataFrame:
    """Rows of all layers, columns by name, in the types of the newest layer that has them; one without files adds none."""
    filled = [layer for layer in layers if data_files(spark, layer)] or list(layers[:1])
    rows = _read_version(spark, filled[0])
    for layer in filled[1:]:
        added = _read_version(spark, layer)
        rows = _alike(rows, added).unionByName(added, allowMissingColumns=True)
    return rows


def _read_version(spark: SparkSession, version: str) -> DataFrame:
    kind = format_of(spark, version)
    if kind == "csv":
        return _read_csv_result(spark, version)
    return spark.read.format(kind).load(version)


def _keyed_by(df: DataFrame, key: str | None, column: str | None) -> str:
    """What rows are told apart by, as a result notes it beside its rows."""
    return json.dumps([key] if key and key in df.columns else [column, MATCHED_CODE in df.columns])


def _note(spark: SparkSession, path: str, text: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{KEYED}")
    out = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop_path, True)
    out.write(bytearray(text.encode()))
    out.close()


def _noted(spark: SparkSession, path: str) -> str | None:
    """The note of a version or layer; one written without deduplication, or broken off before its note, has none."""
    if not path_exists(spark, f"{path}/{KEYED}"):
        return None
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{KEYED}")
    note = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(note, "UTF-8")
    finally:
        note.close()


def _write_noted(df: DataFrame, target: str, format: str, note: str | None) -> str:
    write_table(df, target, format)
    if note is not None:
        _note(df.sparkSession, target, note)
    return target


def write_result(
    df: DataFrame,
    path: str,
    order_by: Sequence[str],
    key: str | None = None,
    column: str | None = None,
    deduplicate: bool = True,
    format: str = "parquet",
) -> str:
    """Write the next version of the result below ``path`` from these rows alone."""
    target = next_version(df.sparkSession, path)
    if not deduplicate:
        return _write_noted(df, target, format, None)
    return _write_noted(dedup(df, order_by, key, column), target, format, _keyed_by(df, key, column))


def append_result(
    df: DataFrame,
    path: str,
    order_by: Sequence[str],
    key: str | None = None,
    column: str | None = None,
    deduplicate: bool = True,
    format: str = "parquet",
) -> str:
    """Add rows to the result below ``path`` as a layer upon its newest version; old rows win.

    A layer holds only rows with keys that no older layer has, and of those only the keys are read. Where older rows
    were not deduplicated, or by another key, and at every ``MOST_LAYERS``-th layer, the result is written anew as the
    next version, so that reading never meets many layers.
    """
    spark = df.sparkSession
    layers = _layers(spark, path)
    if not layers:
        return write_result(df, path, order_by, key, column, deduplicate, format)
    old = _read_layers(spark, layers)
    alike = _alike(old, df)
    note = _keyed_by(union_by_name([alike.limit(0), df.limit(0)]), key, column) if deduplicate else None
    full = len(layers) >= MOST_LAYERS
    if not deduplicate:
        rows = alike.unionByName(df, allowMissingColumns=True) if full else df
    elif full or any(_noted(spark, layer) != note for layer in layers):
        full, rows = True, append(alike, df, order_by, key, column)
    else:
        fresh = staged(dedup(df, order_by, key, column), "fresh")
        rows = unknown_keys(fresh, alike, lambda d: dedup_keys(d, key, column))
    target = next_version(spark, path) if full else _next_layer(spark, path, layers[0])
    return _write_noted(rows, target, format, note)


def compact(spark: SparkSession, path: str, format: str = "parquet") -> str:
    """Write the newest version and its layers as one new version."""
    layers = _layers(spark, path)
    notes = {_noted(spark, layer) for layer in layers}
    note = notes.pop() if len(notes) == 1 else None
    return _write_noted(read_result(spark, path), next_version(spark, path), format, note)


def drop_older(spark: SparkSession, path: str) -> list[str]:
    """Remove the finished versions before the newest one, with their layers; nobody may be reading them."""
    kept = _layers(spark, path)
    older = [n for n in _finished(spark, path) if kept and n < posixpath.basename(kept[0])]
    for name in older:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return older


def unknown_keys(fresh: DataFrame, old: DataFrame, keys: Callable[[DataFrame], list[Column]]) -> DataFrame:
    """The rows of ``fresh``, which is read twice, with keys that no old row has.

    Of the old rows only the keys are read, and they are first cut down to the fresh ones, which are broadcast up to a
    measured size; so the old side is shuffled only against many new keys.
    """
    keyed = fresh.withColumn("__key", F.struct(*keys(fresh)))
    wanted = keyed.select("__key")
    size = wanted.agg(F.sum(F.octet_length(F.to_json("__key")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    known = old.select(F.struct(*keys(old)).alias("__key")).join(wanted, "__key", "left_semi")
    return keyed.join(known.distinct(), "__key", "left_anti").drop("__key")


def _alike(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows in the types of the new ones, which a text format does not keep."""
    types = dict(new.dtypes)
    return old.select(*(F.col(quoted(c)).cast(types[c]).alias(c) if types.get(c, t) != t else F.col(quoted(c)) for c, t in old.dtypes))


def append_batch(
    batch: DataFrame, batch_id: int, path: str, order_by: Sequence[str], key: str | None, column: str | None = None
) -> None:
    """Write the rows of one batch whose key no earlier batch has written; nothing older is rewritten.

    A batch owns one folder and overwrites it, so a batch that is run again after a loss leaves the same rows.
    Of earlier batches only the keys are read, only in the parts that this batch has keys of, and they are first cut
    down to the keys of this batch.
    """
    spark = batch.sparkSession
    hashed = F.pmod(F.xxhash64(*dedup_keys(batch, key, column)), F.lit(PARTS)).cast("int")
    fresh = dedup(batch, order_by, key, column).withColumn(PART, hashed)
    fresh = rows = staged(fresh, "fresh")
    old = _read_batches(spark, path)
    if old is not None:
        parts = [r[0] for r in fresh.select(PART).distinct().collect()]  # PARTS numbers at most
        old = old.filter((F.col(BATCH) < batch_id) & F.col(PART).isin(parts))
        rows = unknown_keys(fresh, old, lambda d: dedup_keys(d, key, column))
    rows.write.mode("overwrite").partitionBy(PART).parquet(f"{path}/{BATCH}={batch_id}")


def _batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that are completely written."""
    names = _children(spark, path, f"{BATCH}=")
    return sorted(int(n.split("=")[1]) for n in names if path_exists(spark, f"{path}/{n}/_SUCCESS"))


def _read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All finished batches; one without rows has no files. None if no batch has any."""
    done = [f"{path}/{BATCH}={n}" for n in _batches(spark, path)]
    done = [d for d in done if data_files(spark, d)]
    return spark.read.option("basePath", path).parquet(*done) if done else None


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    batches = _read_batches(spark, path)
    if batches is None:
        raise FileNotFoundError(f"no row has been appended below {path}")
    return batches.drop(PART)


def append_increment(
    df: DataFrame, path: str, order_by: Sequence[str], key: str | None = None, column: str | None = None
) -> int:
    """Add the rows with new keys as the next batch: for results too large to be written anew at every append."""
    number = max(_batches(df.sparkSession, path), default=-1) + 1
    append_batch(df, number, path, order_by, key, column)
    return number


def export_rules(rules: DataFrame, path: str) -> None:
    """A rule table as CSV with header, in one file since it is small by definition."""
    rules.select(*RULE_COLUMNS).coalesce(1).write.csv(path, **WRITTEN | {"emptyValue": ""})
