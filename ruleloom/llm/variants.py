"""Spelling variants: words that differ by one letter, found by pairs of trie nodes.

Words are the runs of letters of all texts, some of them with a letter deleted by a rule on their row. They are numbered
by count, the most frequent first, and then by code points. A node of the forward trie is a prefix, one of the reversed
trie a suffix.

1. Tasks count the words of a slice of bytes; Spark adds the counts up.
2. Every node has a number that is unique among those of its side and length. A node of up to ``PACKED`` letters is
   numbered by its letters, so the nodes that most words share need no table. Longer ones take the number of the first
   word, in sorted order, that passes through them; words that share such a node share their first letters, by which
   they are dealt, and lie beside each other there.
3. A word with a place skipped is the pair (node of what is before, node of what is behind), a word whole is such a pair
   at each place. Words with the same pair after skipping differ by a replaced letter; a word whose pair at some place
   is another's after skipping lacks that letter. So equal pairs of integers give exactly the neighbours of a word.
4. At most one word for each letter of the alphabet skips to the same pair, and one word is whole there. The rows of a
   pair are brought together, and each learns how many of the others are its neighbours and the first of them, so no
   pair of words is written.
   Of a run of equal letters only the first is left out, so that a neighbour counts once.
5. The form of a word is its most frequent neighbour, if that is ``TIMES`` as frequent. Counts at least double along
   forms, so roots are found by a few rounds in which each word takes the form of its form.

Defined results: a null text has no words and a null id counts as the empty text; a very long word is a word; of equally
frequent neighbours the least in code-point order is taken; repeated rows count again; texts without words and an empty
table give no rows; further columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm import tokens as K
from ruleloom.llm.common import column
from ruleloom.session import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The letters, of which those from U+00C0 to U+00FF are two bytes of which the first is this.
WIDE = 0xC3
SPOILED = 97  # a run in so many loses a letter
MIN_LETTERS, MIN_TIMES, TIMES = 5, 3, 2
BASE, PACKED = 91, 9  # more than there are letters; so many fit in a number
STEPPED = 64  # bytes of a run up to which its checksum is taken in step with others

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[WIDE, *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
CODES = {chr(c): i + 1 for i, c in enumerate([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])}
WHOLE, SKIPPED, SKIPPED_FIRST = 0, 1, 2


def _crc_table() -> np.ndarray:
    """The checksum of each byte, as its state is advanced by it."""
    return np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


CRC = _crc_table()


def _checksums(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of runs of bytes, each going on from a checksum."""
    out = state.astype(np.uint32)
    for i in np.flatnonzero(sizes > STEPPED).tolist():
        out[i] = zlib.crc32(low[starts[i] : starts[i] + sizes[i]].tobytes(), int(out[i]))
    short = np.flatnonzero(sizes <= STEPPED)
    order = short[np.argsort(-sizes[short], kind="stable")]
    at, now = starts[order], out[order] ^ np.uint32(0xFFFFFFFF)
    open_ = np.searchsorted(-sizes[order], -np.arange(STEPPED), side="left")  # runs longer than that
    for step in range(STEPPED):
        n = int(open_[step])
        if not n:
            break
        now[:n] = CRC[(now[:n] ^ low[at[:n] + step]) & np.uint32(0xFF)] ^ (now[:n] >> np.uint32(8))
    out[order] = now ^ np.uint32(0xFFFFFFFF)
    return out


def _runs(part: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the runs of letters of some texts that lie one after the other."""
    inside = IS_LETTER[part]
    inside[1:] |= part[:-1] == WIDE
    head = np.zeros(len(part) + 1, bool)
    head[bounds] = True  # where a row begins, a run does
    edge = np.append(inside, False)
    starts = np.flatnonzero(inside & (head[:-1] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (head[1:] | ~edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.byte_column(batch.column("text"))
        seeds = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column("id").to_pylist()], np.uint32)
        for first, last in K.slices(offsets):
            low = K.LOWERED[data[int(offsets[first]) : int(offsets[last])]]
            if not len(low):
                continue
            starts, ends, row = _runs(low, offsets[first : last + 1] - int(offsets[first]))
            wide = np.append(0, np.cumsum(low == WIDE))
            letters = ends - starts - (wide[ends] - wide[starts])
            some = letters >= MIN_LETTERS
            starts, sizes, row, letters = starts[some], (ends - starts)[some], row[some], letters[some]
            sums = _checksums(low, starts, sizes, seeds[first + row])
            spoiled = sums % SPOILED == 0
            words, counts = [], []
            for i in np.flatnonzero(spoiled).tolist():
                run, at = low[starts[i] : starts[i] + sizes[i]].tobytes().decode(), int(sums[i]) % int(letters[i])
                words.append(run[:at] + run[at + 1 :])
            words = [w for w in words if len(w) >= MIN_LETTERS]
            starts, sizes = starts[~spoiled], sizes[~spoiled]
            if len(starts):
                hashes = K.mix(K.stretch_hashes(K.prefix_sums(K.BYTE_VALUES[low]), starts, starts + sizes) + sizes.astype(np.uint64))
                _, at, place, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                # Words that share a hash with another one are counted by themselves.
                same = sizes == sizes[at[place]]
                fits = np.flatnonzero(same)
                wrong = K.gathered(low, starts[fits], sizes[fits]) != K.gathered(low, starts[at[place[fits]]], sizes[fits])
                same[fits[np.unique(np.repeat(np.arange(len(fits)), sizes[fits])[wrong])]] = False
                for i in np.flatnonzero(~same).tolist():
                    counts[place[i]] -= 1
                    words.append(low[starts[i] : starts[i] + sizes[i]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([K.as_strings(low, starts[at], sizes[at]), pa.array(counts)], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.ones(len(words), np.int64))], names=["word", "n"])


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: the words of all texts that are long and frequent enough."""
    rows = docs.select(F.coalesce(column(doc_id).cast("string"), F.lit("")).alias("id"), column(text).cast("string").alias("text"))
    counted = rows.filter(F.octet_length("text") > 0).mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_TIMES)


def _first_passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted words, for each node of more than ``PACKED`` letters the number of the first word that passes it."""
    before, nodes = "", []
    for batch in batches:
        out = []
        for number, path in zip(batch.column("number").to_pylist(), batch.column("path").to_pylist()):
            shared = 0
            for a, b in zip(path, before):
                if a != b:
                    break
                shared += 1
            kept = nodes[: max(shared - PACKED, 0)]
            before, nodes = path, kept + [number] * (len(path) - PACKED - len(kept))
            out.append(nodes)
        yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array(out, pa.list_(pa.int64()))], names=["number", "nodes"])


def _long_nodes(listed: DataFrame, path) -> DataFrame:
    """``number, nodes`` of the words that have nodes of more than ``PACKED`` letters on that side."""
    rows = listed.select("number", path.alias("path")).filter(F.char_length("path") > PACKED)
    dealt = rows.repartition(F.substr("path", F.lit(1), F.lit(PACKED + 1))).sortWithinPartitions("path")
    return dealt.mapInArrow(_first_passing, "number long, nodes array<long>")


def _path(letters: str, more: list[int] | None) -> list[int]:
    """The nodes that a word passes, by length from 0 on."""
    nodes, at = [0], 0
    for letter in letters[:PACKED]:
        at = at * BASE + CODES[letter]
        nodes.append(at)
    return nodes + (more or [])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of nodes of each word, whole and with a place skipped."""
    names = ["number", "kind", "lengths", "before", "behind"]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("number", "word", "prefixes", "suffixes")]
        out: list[list] = [[], [], [], [], []]
        for number, word, prefixes, suffixes in zip(*columns):
            n = len(word)
            before, behind = _path(word, prefixes), _path(word[::-1], suffixes)[::-1]
            out[0] += [number] * (2 * n + 1)
            out[1] += [WHOLE] * (n + 1)
            out[1] += [SKIPPED_FIRST, *(SKIPPED if a == b else SKIPPED_FIRST for a, b in zip(word, word[1:]))]
            out[2] += [i << 32 | n - i for i in range(n + 1)]
            out[2] += [i << 32 | n - i - 1 for i in range(n)]
            out[3] += before + before[:-1]
            out[4] += behind + behind[1:]
        kinds = (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)


def _told(rows: pa.Table) -> pa.RecordBatch:
    """What each row of some whole pairs, in order, learns: how many neighbours, and the first of them."""
    number, kind, *key = (rows.column(c).to_numpy() for c in ("number", "kind", "lengths", "before", "behind"))
    fresh = np.ones(len(number), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, len(number)))
    ends, none = heads + sizes - 1, np.iinfo(np.int64).max
    has_whole = kind[ends] == WHOLE  # the word that is whole there comes last
    shorter, skipping = np.where(has_whole, number[ends], none), sizes - has_whole
    leaves = kind == SKIPPED_FIRST
    longer, first_longer = np.add.reduceat(leaves.astype(np.int64), heads), np.minimum.reduceat(np.where(leaves, number, none), heads)
    second = np.where(skipping > 1, number[np.minimum(heads + 1, ends)], none)
    of = np.repeat(np.arange(len(heads)), sizes)
    other = np.where(fresh, second[of], number[heads][of])
    near = np.where(kind == WHOLE, longer[of], skipping[of] - 1 + (leaves & has_whole[of]))
    best = np.where(kind == WHOLE, first_longer[of], np.minimum(other, np.where(leaves, shorter[of], none)))
    some = near > 0
    return pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(near[some]), pa.array(best[some])], names=["number", "near", "best"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs come in order; the last one of a batch waits for the next batch, as it may go on there."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        if not len(rows):
            continue
        same = np.logical_and.reduce([rows.column(c).to_numpy() == rows.column(c)[-1].as_py() for c in ("lengths", "before", "behind")])
        at = int(np.argmax(same))
        if at:
            yield _told(rows.slice(0, at))
        kept = rows.slice(at)
    if kept is not None:
        yield _told(kept)


def neighbours(listed: DataFrame) -> DataFrame:
    """Per word that has any: ``number, n_near, best``, how many neighbours it has and the number of the first."""
    sides = {"prefixes": _long_nodes(listed, F.col("word")), "suffixes": _long_nodes(listed, F.reverse("word"))}
    nodes = listed.select("number", "word")
    for side, long in sides.items():
        nodes = nodes.join(long.withColumnRenamed("nodes", side), "number", "left")
    pairs = nodes.mapInArrow(_paired, "number long, kind byte, lengths long, before long, behind long")
    pair = ["lengths", "before", "behind"]
    dealt = pairs.repartition(*pair).sortWithinPartitions(*pair, F.col("kind") == WHOLE, "number")
    found = dealt.mapInArrow(_met, "number long, near long, best long")
    return found.groupBy("number").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word ``word, n, n_near, form, form_n, root``."""
    listed = staged(words(docs, doc_id, text), "words").orderBy(F.desc("n"), "word")
    listed = staged(listed.withColumn("number", F.monotonically_increasing_id()), "numbered")
    near = staged(listed.select("number", "n").join(neighbours(listed), "number", "left"), "near")
    forms = listed.select(F.col("number").alias("best"), F.col("n").alias("form_n"))
    forms = near.filter("best is not null").select("number", "n", "best").join(forms, "best").filter(F.col("form_n") >= TIMES * F.col("n"))
    forms = staged(forms.select("number", F.col("best").alias("form"), "form_n"), "forms")

    # Each round doubles the steps along forms; counts double too, so there are six rounds at most.
    steps = forms.select("number", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("number").alias("root"), F.col("root").alias("next"))
        moved = staged(steps.join(ahead, "root", "left").select("number", "root", "next"), "roots")
        steps = moved.select("number", F.coalesce("next", "root").alias("root"))
        if moved.filter("next is not null").isEmpty():
            break

    named = lambda number, word: listed.select(F.col("number").alias(number), F.col("word").alias(word))
    told = forms.join(steps, "number").join(named("form", "form_word"), "form").join(named("root", "root_word"), "root")
    told = told.select("number", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root"))
    found = listed.join(near.select("number", "n_near"), "number").join(told, "number", "left")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    return variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
