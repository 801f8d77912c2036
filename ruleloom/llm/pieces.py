"""SentencePiece encoding and decoding of texts through a table of their distinct chunks.

A chunk is a run of whitespace markers and what follows it up to the next one; its body is the chunk without the first
marker. No piece of a model that this operator takes has a marker behind another character, so no piece and no merge
crosses a chunk, and each chunk is segmented as if it stood alone.

1. Each task finds its chunks on the bytes of its texts and sends each distinct body of a slice once, with its count;
   Spark adds the counts up. The table has ``TABLE_BYTES`` at most: of a corpus with more distinct chunks it holds the
   most frequent ones, by a threshold on the count. Each of them is segmented once, spread over all tasks.
2. The table goes to the tasks as sorted hashes, bodies and ids. A body is looked up by its hash and then compared byte
   by byte. The rare ones that the table does not hold are segmented where they stand, once in a slice: a join would
   shuffle a row for each of their places, and cost more than the model does.
3. The ids are joined back by position, with an id for the beginning and one for the end. Decoding looks up the
   characters of each id, and leaves out the marker that the encoding has put before the text.

Nothing but distinct bodies and their counts is shuffled; texts stay where they are.

Defined results: a null text is empty, an empty one has two ids and decodes to the empty text; a text of blanks has
markers alone; a very long text is worked on in pieces that end before a blank, and a very long chunk in one; rows
repeat their result; ties cannot change a result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm import tokens as K
from ruleloom.llm.common import column
from ruleloom.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKER = "▁"  # fixed value: the mark of a blank
MARKER_BYTES = MARKER.encode()
TABLE_BYTES = 64 << 20  # of bodies, ids and hashes that tasks hold of the distinct chunks
SLICE = 2 << 20  # bytes worked on at a time
BLANK_AFTER_WORD = re.compile(rb"[\x21-\x7F] ")


@cache
def _loaded(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def read_model(path: str) -> bytes:
    """The bytes of a model file, if the method is right for it."""
    with open(path, "rb") as file:
        model = file.read()
    processor = _loaded(model)
    pieces = map(processor.id_to_piece, range(processor.get_piece_size()))
    probe = " a  b"  # blanks neither folded nor cut, and one put before
    if any(MARKER in p.lstrip(MARKER) for p in pieces) or processor.decode(processor.encode(probe)) != probe:
        raise ValueError(f"{path}: pieces cross whitespace markers, or the model changes blanks")
    return model


def _body_ids(model: bytes, bodies: list[str]) -> list[list[int]]:
    """The ids of chunks; the model itself puts a marker before a text that is not empty."""
    processor = _loaded(model)
    if not bodies:
        return []
    return [found or [processor.piece_to_id(MARKER)] for found in processor.encode(bodies, num_threads=1)]


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """``row, start, end, whether it begins the row``: rows, the very long ones cut before blanks."""
    for row in range(len(offsets) - 1):
        low, high = int(offsets[row]), int(offsets[row + 1])
        first = True
        while high - low > SLICE:
            raw = data[low + SLICE : high].tobytes()
            met = BLANK_AFTER_WORD.search(raw)
            if met is None:
                break
            cut = low + SLICE + met.start() + 1
            yield row, low, cut, first
            low, first = cut, False
        yield row, low, high, first


def _grouped(stretches: Iterator[tuple[int, int, int, bool]]) -> Iterator[list[tuple[int, int, int, bool]]]:
    """Neighbours that lie together in about ``SLICE`` bytes."""
    group: list = []
    for stretch in stretches:
        if group and stretch[2] - group[0][1] > SLICE:
            yield group
            group = []
        group.append(stretch)
    if group:
        yield group


def _chunks(part: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of stretches that lie one after the other: place, start and end of the body."""
    n = len(part)
    size = np.zeros(n, np.int64)  # of the marker that begins here
    size[part == 0x20] = 1
    if n >= 3:
        wide = np.flatnonzero((part[:-2] == MARKER_BYTES[0]) & (part[1:-1] == MARKER_BYTES[1]) & (part[2:] == MARKER_BYTES[2]))
        size[wide] = 3
    marks = np.flatnonzero(size)
    after = np.zeros(n + 4, bool)  # a marker ends before this place
    after[marks + size[marks]] = True
    filled = np.diff(np.append(starts, n)) > 0
    after[starts[filled]] = first[filled]  # the marker that is put before a text
    begins = (size > 0) & ~after[:n]
    begins[starts[filled & first]] = True
    place = np.flatnonzero(begins)
    implied = np.zeros(n, bool)
    implied[starts[filled & first]] = True
    bodies = place + np.where(implied[place], 0, size[place])
    return place, bodies, np.append(place[1:], n)


def _hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(part):
        return K.mix(np.zeros(len(starts), np.uint64))
    return K.mix(K.stretch_hashes(K.prefix_sums(K.BYTE_VALUES[part]), starts, ends) + (ends - starts).astype(np.uint64))


def _slices(batch: pa.RecordBatch):
    """The texts of a batch in slices: stretches, bytes, start of each stretch, chunks."""
    data, offsets = K.byte_column(batch.column("text"))
    for group in _grouped(_stretches(data, offsets)):
        part = data[group[0][1] : group[-1][2]]
        starts = np.array([s[1] for s in group]) - group[0][1]
        yield group, part, starts, *_chunks(part, starts, np.array([s[3] for s in group]))


def _distinct_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, part, _, _, low, high in _slices(batch):
            if len(low):
                _, at, times = np.unique(_hashes(part, low, high), return_index=True, return_counts=True)
                bodies = K.as_strings(part, low[at], high[at] - low[at])
                yield pa.RecordBatch.from_arrays([bodies, pa.array(times)], names=["body", "n"])


def _segmenting(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _body_ids(model, batch.column("body").to_pylist())
            raw = [np.array(ids, "<u4").tobytes() for ids in found]
            yield pa.RecordBatch.from_arrays([batch.column("body"), pa.array(raw, pa.binary())], names=["body", "ids"])

    return run


def distinct_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table ``body, n``: every distinct chunk with its count."""
    texts = docs.select(column(text).cast("string").alias("text")).filter(F.octet_length("text") > 0)
    counted = texts.mapInArrow(_distinct_bodies, "body string, n long").groupBy("body").agg(F.sum("n").alias("n"))
    return staged(counted, "chunks")


def segmented(chunks: DataFrame, model: bytes) -> DataFrame:
    """``body, ids`` (unsigned, 4 bytes each) of the chunks that tasks hold: all, or the most frequent ones that fit."""
    grade = F.floor(F.log2("n") * 8)
    size = F.sum(F.octet_length("body") * 3 + 28).alias("size")  # an id to two bytes, and one
    sizes = {r["grade"]: r["size"] for r in chunks.groupBy(grade.alias("grade")).agg(size).collect()}  # 512 rows at most
    room, least = TABLE_BYTES, None
    for g in sorted(sizes, reverse=True):
        room -= sizes[g]
        if room < 0:
            break
        least = g
    held = chunks.filter(grade >= least) if least is not None else chunks.limit(0)
    return held.select("body").mapInArrow(_segmenting(model), "body string, ids binary")


class _Table:
    """Bodies by their hashes, with their ids."""

    def __init__(self, rows: pa.Table):
        flat, ends = K.byte_column(rows.column("body"))
        base = int(ends[0])
        flat, ends = flat[base : int(ends[-1])], ends - base
        parts = ((flat[ends[low] : ends[high]], ends[low : high + 1] - ends[low]) for low, high in K.slices(ends))
        hashes = [_hashes(part, own[:-1], own[1:]) for part, own in parts]  # in slices: they take 8 bytes a byte, many times
        hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        hashes, at = np.unique(hashes, return_index=True)  # of two bodies with one hash, one is held
        self.hashes, self.start, self.size, self.flat = hashes, ends[:-1][at], np.diff(ends)[at], flat
        ids, ends = K.byte_column(rows.column("ids"))
        base = int(ends[0])
        self.ids = ids[base : int(ends[-1])].view("<u4") if len(ids) else np.zeros(0, "<u4")
        self.first, self.many = (ends[:-1][at] - base) // 4, np.diff(ends)[at] // 4

    def found(self, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each body its row, and whether it is there."""
        hashes = _hashes(part, low, high)
        if not len(self.hashes):
            return np.zeros(len(low), np.int64), np.zeros(len(low), bool)
        row = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = (self.hashes[row] == hashes) & (self.size[row] == high - low)
        some = np.flatnonzero(known)
        sizes = self.size[row[some]]
        wrong = K.gathered(part, low[some], sizes) != K.gathered(self.flat, self.start[row[some]], sizes)
        if wrong.any():
            known[some[np.unique(np.repeat(np.arange(len(some)), sizes)[wrong])]] = False
        return row, known


def _slice_ids(table: _Table, model: bytes, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the chunks of a slice by position, and how many each chunk has."""
    row, known = table.found(part, low, high)
    first, many, ids = table.first, table.many, table.ids
    if not known.all():
        other = np.flatnonzero(~known)
        bodies = [part[a:b].tobytes() for a, b in zip(low[other].tolist(), high[other].tolist())]
        number = {body: i for i, body in enumerate(dict.fromkeys(bodies))}
        found = _body_ids(model, [body.decode() for body in number])
        row = row.copy()
        row[other] = len(first) + np.array([number[b] for b in bodies])
        more = np.array([len(x) for x in found])
        first = np.append(first, len(ids) + np.append(0, np.cumsum(more)[:-1]))
        many = np.append(many, more)
        ids = np.concatenate([ids, *(np.array(x, "<u4") for x in found)])
    return K.gathered(ids, first[row], many[row]), many[row]


class _Surfaces:
    """What each id stands for in a text."""

    def __init__(self, model: bytes):
        processor = _loaded(model)
        raw = []
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            if processor.is_control(i) or processor.is_unknown(i):
                raw.append(b"")
            else:
                raw.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(i) else piece.replace(MARKER, " ").encode())
        self.size = np.array([len(x) for x in raw])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.unknown = processor.unk_id()

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return K.gathered(self.flat, self.start[ids], self.size[ids])


def _encoding(model: bytes, table, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, surfaces, processor = _Table(table.value), _Surfaces(model), _loaded(model)
        begin, end = (np.array([i], "<u4") for i in (processor.bos_id(), processor.eos_id()))
        for batch in batches:
            out: list[list] = [[], [], []]
            ids, shown, count = [begin], [], 1
            for group, part, starts, place, low, high in _slices(batch):
                found, many = _slice_ids(held, model, part, low, high)
                ends = np.append(0, np.cumsum(many))[np.searchsorted(place, np.append(starts, len(part)))].tolist()
                text = surfaces.bytes_of(found)
                cuts = np.append(0, np.cumsum(surfaces.size[found]))[ends].tolist()
                for i, (row, _, _, _) in enumerate(group):
                    while len(out[0]) < row:  # the stretches of the row before are complete
                        _add(out, ids + [end], shown, digests)
                        ids, shown = [begin], []
                    ids.append(found[ends[i] : ends[i + 1]])
                    shown.append(text[cuts[i] : cuts[i + 1]])
            while len(out[0]) < batch.num_rows:
                _add(out, ids + [end], shown, digests)
                ids, shown = [begin], []
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(v, t) for v, t in zip(out, _types(digests)))], names=["id", *_names(digests)]
            )

    return run


def _names(digests: bool) -> list[str]:
    return ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]


def _types(digests: bool) -> list[pa.DataType]:
    return [pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string()]


def _add(out: list[list], ids: list[np.ndarray], shown: list[np.ndarray], digests: bool) -> None:
    """One row, from the ids and the bytes of its stretches; the first byte is the marker put before the text."""
    out[0].append(sum(map(len, ids)))
    if digests:
        numbers, text = hashlib.sha256(), hashlib.sha256()
        for x in ids:
            numbers.update(x)
        for i, x in enumerate(shown):
            text.update(x[1:] if i == 0 else x)
        out[1].append(numbers.hexdigest())
        out[2].append(text.hexdigest())
    else:
        out[1].append(np.concatenate(ids).astype(np.int32))
        out[2].append(b"".join(map(bytes, shown))[1:].decode())


def encoded(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row ``id, n_tokens, ids, decoded``: all ids with begin and end, and the text they decode to.

    With ``digests`` the last two are ``ids_sha256, decoded_sha256`` of the same, and no list leaves a task.
    """
    spark = docs.sparkSession
    held = segmented(distinct_chunks(docs, text), model).toArrow()  # TABLE_BYTES at most
    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("text"))
    kinds = [T.LongType(), T.StringType() if digests else T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, t) for c, t in zip(_names(digests), kinds))])
    return rows.mapInArrow(_encoding(model, spark.sparkContext.broadcast(held), digests), schema)


def _decoding(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _loaded(model)
        for batch in batches:
            texts = [processor.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])

    return run


def decoded(rows: DataFrame, model: bytes, row_id: str = "id", ids: str = "ids") -> DataFrame:
    """Per row ``id, decoded``: the text of any list of ids; a null list is empty."""
    asked = rows.select(column(row_id).alias("id"), column(ids).cast("array<int>").alias("ids"))
    return asked.mapInArrow(_decoding(model), T.StructType([asked.schema["id"], T.StructField("decoded", T.StringType())]))


def report(docs: DataFrame, path: str) -> DataFrame:
    return encoded(docs, read_model(path), digests=True).withColumnRenamed("id", "doc_id")


def model_path(spark: SparkSession, name: str) -> str:
    """The file of a public tokenizer, whose folder ``ruleloom.tokenizers`` names if it is not that of the package."""
    folder = spark.conf.get("ruleloom.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
