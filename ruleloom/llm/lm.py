"""Language-model scores by a weighted backoff automaton over a smoothed bigram model of the whole corpus.

States are the root and one state per word. The arc of a counted bigram (v, w) leads from state v to state w with the
weight log10((c(vw) + STRENGTH * p(w)) / (c(v) + STRENGTH)); every state has a failure arc to the root with the weight
log10(STRENGTH / (c(v) + STRENGTH)), and the root's arcs weigh log10 p(w), p(w) = (c(w) + 1) / (N + V + 1). Arcs of
a state and its failure arc together sum to one. A text is one traversal from the begin state over its words to the end
token: an arc if there is one, else the failure arc and the root's arc.

No model is broadcast and no n-gram cut off. The corpus is dealt into blocks of about ``BLOCK_BYTES`` of text; a block
sends the sorted hashes of its different n-grams with its own counts to ranges of the hash space, a range adds up what
all blocks sent, and sends each block the totals in the order it asked; the block's arcs are then at hand, and its
texts are traversed. What moves is in proportion to the corpus. A frequent n-gram is one entry a block.

Defined results: a null, empty or blank text has the end token alone; rows with null ids count by the hash of the
empty text; repeated rows count each; without training texts every token is unknown (N = V = 0); an empty table gives
no rows; a word longer than a block is a word; further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.llm import tokens as K
from ruleloom.llm.common import column, id_bucket, text_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRENGTH = 8.0  # words that a state's prior counts for
BLOCK_BYTES = 12 << 20  # of text
RANGE_BYTES = 3 << 20  # of text, whose n-grams a range gathers
END, BEGIN = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
PAIR_FACTOR = np.uint64(0xD6E8FEB86659FD93)
TAG = np.uint64(0xA0761D6478BD642F)


def _sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of some texts with the end token of each, the token before each, and the tokens per text."""
    found, counts = [], []
    for first, last in K.slices(offsets):
        words, n = K.word_hashes(data, offsets[first : last + 1])
        found.append(words)
        counts.append(n)
    words, n = np.concatenate(found), np.concatenate(counts)
    ends = np.cumsum(n + 1) - 1
    tokens = np.empty(len(words) + len(n), np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word], tokens[ends] = words, END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[0] = BEGIN
    before[ends[:-1] + 1] = BEGIN
    return tokens, before, n + 1


def _pairs(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(before * PAIR_FACTOR + TAG) + tokens)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, the start of each different key in it, and the number of the key at each place."""
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _ngrams(table: pa.Table):
    """All n-grams of a block: unigram and bigram keys of each place, and whether the place belongs to training."""
    data, offsets = K.byte_column(table.column("text"))
    tokens, before, n = _sequence(data, offsets)
    train = np.repeat(table.column("train").to_numpy(zero_copy_only=False).astype(bool), n)
    return np.concatenate([K.mix(tokens ^ TAG), _pairs(tokens, before)]), train, n


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal rank together: the upper ones are mostly zero, and compress in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _asked(ranges: int):
    """A block's question to each range it touches: its n-grams, as steps between sorted hashes, and its own counts."""

    def run(table: pa.Table) -> pa.Table:
        keys, train, _ = _ngrams(table)
        order, starts, _ = _grouped(keys)
        counts = np.add.reduceat(np.concatenate([train, train])[order].astype(np.uint32), starts, dtype=np.uint32)
        keys = keys[order][starts]
        place = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        heads = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1))
        steps, own = [], []
        for begin, end in zip(heads, [*heads[1:], len(keys)]):
            steps.append(_planes(np.diff(keys[begin:end], prepend=np.uint64(0))))
            own.append(_planes(counts[begin:end]))
        block = [table.column("block")[0].as_py()] * len(heads)
        return pa.table(
            [pa.array(place[heads].astype(np.int64)), pa.array(block, pa.int64()), pa.array(steps, pa.binary()), pa.array(own, pa.binary())],
            names=["range", "block", "steps", "own"],
        )

    return run


def _answered(table: pa.Table) -> pa.Table:
    """Totals of a range, for each block in the order of its question."""
    keys = [np.cumsum(_unplaned(raw, np.uint64), dtype=np.uint64) for raw in table.column("steps").to_pylist()]
    own = [_unplaned(raw, np.uint32) for raw in table.column("own").to_pylist()]
    sizes = [len(k) for k in keys]
    keys, own = np.concatenate(keys), np.concatenate(own)
    order, starts, number = _grouped(keys)
    totals = np.add.reduceat(own[order].astype(np.int64), starts)
    result = np.empty(len(keys), np.int64)
    result[order] = totals[number]
    parts = [_planes(part) for part in np.split(result, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("range"), table.column("block"), pa.array(parts, pa.binary())], names=["range", "block", "totals"])


def _traversed(known: dict, id_type):
    """Scores of a block's texts, from the totals of its n-grams."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, _, n = _ngrams(texts)
        order, _, number = _grouped(keys)
        place = np.argsort(answers.column("range").to_numpy())
        raw = answers.column("totals").to_pylist()
        totals = np.concatenate([_unplaned(raw[i], np.int64) for i in place])
        counts = np.empty(len(keys), np.int64)
        counts[order] = totals[number]
        word, pair = counts[: len(counts) // 2], counts[len(counts) // 2 :]
        starts = np.cumsum(n) - n
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[starts] = known["texts"]  # the begin state
        base = np.log10((word + 1) / (known["tokens"] + known["words"] + 1))
        prior = 10.0**base
        arc = np.log10((pair + STRENGTH * prior) / (context + STRENGTH))
        fail = np.log10(STRENGTH / (context + STRENGTH)) + base
        weight = np.where(pair > 0, arc, fail)
        sums = [np.add.reduceat(x, starts) for x in ((word > 0).astype(np.int64), base, weight)]
        return pa.table(
            [texts.column("id"), texts.column("train"), pa.array(n, pa.int64()), *(pa.array(x) for x in sums)],
            names=["id", "train", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the training texts: their different tokens, and in a row of its own the numbers of tokens and of texts."""
    for batch in batches:
        batch = batch.filter(batch.column("train"))
        if not batch.num_rows:
            continue
        tokens, _, n = _sequence(*K.byte_column(batch.column("text")))
        words = K.as_long(np.unique(tokens))
        zeros = np.zeros(len(words), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(zeros), pa.array(zeros)], names=["word", "tokens", "texts"])
        sums = [pa.array([None], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([len(n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(sums, names=["word", "tokens", "texts"])


def scored(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``id, train, n_tokens, n_known, base_score, score, train_tokens``; ``train`` says which texts teach."""
    rows = docs.select(
        column(doc_id).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"),
        text_key(column(text)).alias("key"),
    )
    seen = rows.select("train", "text").mapInArrow(_distinct_words, "word long, tokens long, texts long")
    seen = seen.groupBy("word").agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"))
    # The count of a null word is 0, so the sums' row is no word.
    known = seen.agg(*(F.coalesce(x, F.lit(0)).alias(k) for k, x in (("words", F.count("word")), ("tokens", F.sum("tokens")), ("texts", F.sum("texts")))))
    known = known.first().asDict()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    blocks, ranges = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // RANGE_BYTES))
    # By id and text, so that neither copies of a text nor rows without an id meet in one block.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "key", F.lit("block")), F.lit(blocks))).drop("key").repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_asked(ranges), "range long, block long, steps binary, own binary")
    answers = asked.groupBy("range").applyInArrow(_answered, "range long, block long, totals binary")
    id_field = dealt.schema["id"]
    schema = T.StructType(
        [id_field, T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_traversed(known, id_field.dataType), schema)
    return found.withColumn("train_tokens", F.lit(known["tokens"]).cast("long"))


def report(docs: DataFrame) -> DataFrame:
    held_out = id_bucket(F.col("doc_id"), 7) == 2
    found = scored(docs, ~held_out)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
