"""Suffix-array deduplication: bytes covered by a long string that also starts elsewhere are removed.

1. Every string of ``length`` bytes has an anchor, the place of its least ``GRAM``-byte hash (the leftmost of equals),
   which depends on the string alone. Neighbouring strings share anchors; the strings of one anchor are a segment, and
   each string lies in exactly one. Equal strings lie in segments of equal anchor hash.
2. Segments are counted by anchor hash. One that occurs once holds no repeated string. Equal segments are folded; all
   strings of a segment that occurs twice are repeated.
3. What is left is anchors with different segments. One copy of each segment goes to a shard by its anchor hash, whose
   suffix array and permuted common prefixes tell the repeated strings.
4. Spans are carried back to all places of their segments, merged, and cut out.

An anchor with more than ``HOT`` different segments is not put in one shard: its strings are counted one by one, by
hash, with partial sums, which spreads over all tasks. Joins on the anchor deal one with more than ``SPLIT`` segments to
several tasks; only the list of such anchors is broadcast, at most one for every ``SPLIT`` (or ``HOT``) segments.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; rows that agree in id and text are
copies of each other; a text that repeats itself loses those parts; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm import suffix as S
from ruleloom.llm import tokens as K
from ruleloom.llm.common import column, text_key
from ruleloom.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 400
GRAM = 64
PIECE = 8 << 20  # bytes of a very long text that are looked at together
SHARD_BYTES = 1 << 20
HOT = 1500
SPLIT = 2000  # segments of one anchor that are joined together
PLACE_BITS = np.uint64(24)


def _least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes the place of the least, the leftmost of equals."""
    place = np.arange(len(hashes), dtype=np.uint64)
    ranked = (hashes >> PLACE_BITS << PLACE_BITS) | place
    padded = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(hashes)] = ranked
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(hashes) - width + 1
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def segments(part: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Segments of some texts that lie one after the other: text number, anchor hash, segment hash, start, strings."""
    if len(part) < length:
        return None
    sums = K.prefix_sums(K.BYTE_VALUES[part])
    starts = np.arange(len(part) - gram + 1)
    hashes = K.mix(K.stretch_hashes(sums, starts, starts + gram))
    anchors = _least_places(hashes, length - gram + 1)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(anchors)]
    valid = bounds[1:][owner] - np.arange(len(anchors)) >= length
    fresh = np.ones(len(anchors), bool)
    fresh[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(fresh)
    strings = np.diff(np.append(first, len(anchors)))
    first, strings = first[valid[first]], strings[valid[first]]
    at = anchors[first]
    whole = K.stretch_hashes(sums, first, first + strings + length - 1)
    whole = K.mix(whole + K.mix((at - first).astype(np.uint64) * np.uint64(1 << 32) + strings.astype(np.uint64)))
    return owner[first], hashes[at], whole, first - bounds[owner[first]], strings


def _pieces(offsets: np.ndarray, length: int):
    """Rows to look at together as ``(rows, bounds)``; a very long text comes in pieces that overlap by less than a string."""
    for first, last in K.slices(offsets):
        begin, end = int(offsets[first]), int(offsets[last])
        if last - first > 1 or end - begin <= PIECE:
            yield np.arange(first, last), offsets[first : last + 1], 0
            continue
        for start in range(begin, max(end - length + 1, begin + 1), PIECE):
            yield np.array([first]), np.array([start, min(start + PIECE + length - 1, end)]), start - begin


def _segmented(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.byte_column(batch.column("text"))
            for rows, bounds, shift in _pieces(offsets, length):
                found = segments(data[bounds[0] : bounds[-1]], bounds - bounds[0], length, gram)
                if found is None:
                    continue
                owner, anchor, whole, start, strings = found
                # Equal segments of one text: the first stands for all in the counts.
                order = np.lexsort((whole, owner))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (whole[order][1:] != whole[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                heads = np.flatnonzero(fresh)
                times = np.zeros(len(order), np.int64)
                times[order[heads]] = np.diff(np.append(heads, len(order)))
                number = pa.array(rows[owner])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(number), batch.column("key").take(number), pa.array(K.as_long(anchor)),
                        pa.array(K.as_long(whole)), pa.array(start + shift), pa.array(strings), pa.array(times),
                    ],
                    names=["id", "key", "anchor", "segment", "start", "strings", "times"],
                )

    return run


def _runs(starts: np.ndarray, owner: np.ndarray, length: int):
    """Covered spans from the sorted starts of repeated strings, within each owner."""
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] - starts[:-1] > length) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(starts))[: len(heads)] - 1  # no starts, no spans
    return owner[heads], starts[heads], starts[tails] + length


def _sorted_shard(length: int):
    """Repeated strings among the segments of a shard, as spans relative to the segment."""

    def run(table: pa.Table) -> pa.Table:
        anchors, names = table.column("anchor").to_numpy(), table.column("segment").to_numpy()
        _, chosen = np.unique(names, return_index=True)  # a row may come twice
        raw = table.column("bytes").take(pa.array(chosen)).to_pylist()
        sizes = np.array([len(x) for x in raw]) + 1
        text = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        text[ends - 1] = 0  # between segments
        owner = np.repeat(np.arange(len(raw)), sizes)
        valid = ends[owner] - 1 - np.arange(len(text)) >= length
        found = S.repeated_starts(text, S.suffix_array(text, 257), valid, length)
        begins = (ends - sizes)[owner[found]]
        who, low, high = _runs(found - begins, owner[found], length)
        at = chosen[who]
        return pa.table([pa.array(anchors[at]), pa.array(names[at]), pa.array(low), pa.array(high)], names=["anchor", "segment", "low", "high"])

    return run


def _strings(length: int):
    """The hashes of all strings of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column("bytes")[row].as_py(), np.uint8)
                starts = np.arange(len(raw) - length + 1)
                sums = K.prefix_sums(K.BYTE_VALUES[raw])
                hashes = K.as_long(K.mix(K.stretch_hashes(sums, starts, starts + length)))
                same = lambda name: pa.array(np.full(len(starts), batch.column(name)[row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([same("anchor"), same("segment"), pa.array(starts), pa.array(hashes)], names=["anchor", "segment", "low", "string"])

    return run


def _met(placed: DataFrame, repeated: DataFrame) -> DataFrame:
    """The segments of repeated anchors; an anchor with more than ``SPLIT`` segments is dealt to several tasks."""
    heavy = repeated.filter("parts > 1").select("anchor", "parts")
    part = F.coalesce(F.pmod(F.xxhash64("segment", "id", "key", "start"), F.col("parts")), F.lit(0))
    dealt = placed.join(F.broadcast(heavy), "anchor", "left").withColumn("part", part).drop("parts")
    copied = repeated.select("anchor", "differs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(copied, ["anchor", "part"]).drop("part")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, key, spans``: the merged spans ``start, end`` to remove, of the texts that have any."""
    gram = min(GRAM, length)
    rows = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), column(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("key", "anchor", "segment", "start", "strings", "times"))])
    placed = staged(rows.filter(F.octet_length("text") >= length).mapInArrow(_segmented(length, gram), schema), "segments")
    repeated = placed.groupBy("anchor").agg(
        F.sum("times").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"), F.ceil(F.count("*") / F.lit(SPLIT)).alias("parts")
    )
    repeated = repeated.filter("n > 1").select("anchor", (F.col("low") < F.col("high")).alias("differs"), "parts")
    met = staged(_met(placed, staged(repeated, "anchors")), "repeated")
    kinds = met.groupBy("anchor", "segment").agg(
        F.sum("times").alias("n"), F.first("differs").alias("differs"), F.min(F.struct("id", "key", "start", "strings")).alias("row")
    )
    kinds = staged(kinds, "kinds")

    # One copy of each segment whose anchor has several.
    wanted = kinds.filter("differs").select("anchor", "segment", F.col("row.*")).withColumnsRenamed({"id": "row_id", "key": "row_key"})
    hot = wanted.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot"))
    size = wanted.agg(F.coalesce(F.sum(F.col("strings") + length), F.lit(0))).first()[0]
    same = rows["id"].eqNullSafe(wanted["row_id"]) & (rows["key"] == wanted["row_key"])
    cut = F.substring(F.col("text").cast("binary"), F.col("start").cast("int") + 1, (F.col("strings") + (length - 1)).cast("int"))
    copies = staged(rows.join(wanted, same).select("anchor", "segment", cut.alias("bytes")), "copies")
    copies = copies.join(F.broadcast(hot), "anchor", "left").withColumn("hot", F.col("hot").isNotNull())
    shards = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    dealt = copies.filter("not hot").select("anchor", "segment", "bytes", shard.alias("shard")).repartition(shards, "shard")
    kind = "anchor long, segment long, low long, high long"
    sorted_out = dealt.groupBy("shard").applyInArrow(_sorted_shard(length), kind)
    single = copies.filter("hot").dropDuplicates(["anchor", "segment"]).select("anchor", "segment", "bytes")
    strings = single.mapInArrow(_strings(length), "anchor long, segment long, low long, string long")
    twice = strings.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    counted = strings.join(twice, "string").select("anchor", "segment", "low", (F.col("low") + length).alias("high"))
    whole = kinds.filter("n > 1").select("anchor", "segment", F.lit(0).cast("long").alias("low"), (F.col("row.strings") + (length - 1)).alias("high"))
    hit = staged(sorted_out.unionByName(counted).unionByName(whole), "hits")

    there = met.select("id", "key", "anchor", "segment", "start").join(hit, ["anchor", "segment"])
    there = there.select("id", "key", F.struct((F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end")).alias("span"))
    # A text has no more spans than bytes, so its list is bounded by the text itself.
    listed = there.groupBy("id", "key").agg(F.sort_array(F.collect_set("span")).alias("all"))
    return staged(listed.select("id", "key", F.col("all").alias("spans")), "spans")


def _cut(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.byte_column(batch.column("text"))
            listed = batch.column("spans")
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                found = listed[i]
                kept, removed, count, at = hashlib.sha256(), 0, 0, 0
                pieces = []
                if found.is_valid:
                    flat = found.values
                    starts, ends = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                    reach = np.maximum.accumulate(ends)
                    heads = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
                    for low, high in zip(starts[heads].tolist(), reach[np.append(heads[1:], len(starts)) - 1].tolist()):
                        pieces.append(raw[at:low])
                        removed, count, at = removed + high - low, count + 1, high
                pieces.append(raw[at:])
                for piece in pieces:
                    kept.update(piece)
                for values, value in zip(out, (len(raw), removed, count, kept.hexdigest(), b"".join(map(bytes, pieces)) if with_bytes else None)):
                    values.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [batch.column("id"), *(pa.array(v, t) for v, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(arrays[: 6 if with_bytes else 5], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_bytes else 5])

    return run


def cut_out(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_bytes: bool = True) -> DataFrame:
    """Per row ``id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes."""
    found = spans(docs, doc_id, text, length)
    rows = docs.select(column(doc_id).alias("id"), text_key(column(text)).alias("key"), column(text).cast("string").alias("text"))
    same = rows["id"].eqNullSafe(found["id"]) & (rows["key"] == found["key"])
    joined = rows.join(found, same, "left").select(rows["id"], rows["text"], found["spans"])
    fields = [rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    return joined.mapInArrow(_cut(with_bytes), T.StructType(fields + [T.StructField("kept", T.BinaryType())] * with_bytes))


def report(docs: DataFrame) -> DataFrame:
    return cut_out(docs, with_bytes=False).withColumnRenamed("id", "doc_id")
