"""The same rules on file streams, and an incremental append with deduplication."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ruleloom.operators.dedup import dedup_keys
from ruleloom.operators.screen import screen
from ruleloom.sources.sinks import append_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MOST_WAITING = 50_000  # rows of a task that wait until they are cut to one a key


def screen_stream(stream: DataFrame, rules, path: str, checkpoint: str, **settings) -> StreamingQuery:
    """Screen every file that has arrived and write the hits; rules keep no state, so no watermark is needed."""
    hits = screen(stream, rules, hits_only=True, **settings)
    return (
        hits.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order_by: Sequence[str],
    key: str | None = None,
    column: str | None = None,
) -> StreamingQuery:
    """Append what arrives to a result that holds every key once; the first batch with a key wins."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, path, order_by, key, column)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _first_rows(rows: pa.Table, keys: Sequence[str], order_by: Sequence[str]) -> pa.Table:
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order_by], null_placement="at_start")
    rows = rows.take(order)
    numbered = rows.select(keys).append_column("__number", pa.array(range(rows.num_rows), pa.int64()))
    first = numbered.group_by(keys, use_threads=False).aggregate([("__number", "min")])
    return rows.take(first.column("__number_min"))


def _firsts(keys: Sequence[str], order_by: Sequence[str]):
    """Function for mapInArrow: the first row of each key among those of the task and micro-batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, rows = None, [], 0

        def cut() -> pa.Table:
            return _first_rows(pa.Table.from_batches([*(kept.to_batches() if kept else ()), *waiting]), keys, order_by)

        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows > max(MOST_WAITING, kept.num_rows if kept else 0):
                kept, waiting, rows = cut(), [], 0
        if waiting or kept:
            yield from cut().to_batches()

    return run


def dedup_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order_by: Sequence[str],
    key: str | None = None,
    column: str | None = None,
) -> StreamingQuery:
    """The same as ``append_stream`` with the keys that were seen in Spark's state store, so that no written row is read.

    Within a micro-batch the first row of a key by ``order_by`` stays, nulls first; each task sends one row a key, so a
    hot key is no hot partition. The result is a folder of Parquet files with a row a key; state grows with the keys,
    for which the RocksDB provider (``spark.sql.streaming.stateStore.providerClass``) is made.
    """
    names = [f"__key{i}" for i in range(len(dedup_keys(stream, key, column)))]
    keyed = stream.withColumns(dict(zip(names, dedup_keys(stream, key, column))))
    first = _firsts(names, order_by)
    local = keyed.mapInArrow(first, keyed.schema)
    whole = local.repartition(*names).mapInArrow(first, keyed.schema)
    return (
        whole.dropDuplicates(names)
        .drop(*names)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
